"""Which file, unit and entity a path belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.paths import directory, entity_key, fallback_unit
from revlens.operators.cleaning import glob_regex


def stem(path: Column) -> Column:
    """The last segment of the entity key."""
    return F.element_at(F.split(entity_key(path), "/"), -1)


def joined_path(base: Column, relative: Column) -> Column:
    """A relative path from a directory, without . and .. steps."""
    start = F.filter(F.split(base, "/"), lambda x: x != "")

    def step(parts: Column, x: Column) -> Column:
        up = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.when((x == "") | (x == "."), parts).when(x == "..", up).otherwise(F.concat(parts, F.array(x)))

    return F.array_join(F.aggregate(F.split(relative, "/"), start, step), "/")


def alive_snapshot(files: DataFrame, tree: DataFrame) -> DataFrame:
    """files(repo, path, ...) and the paths that tree(repo, path, blob) has besides, with alive and blob by the tree alone."""
    known = files.drop("alive", "blob")
    t = tree.select("repo", "path", "blob").dropDuplicates(["repo", "path"])
    return known.join(t, ["repo", "path"], "full").withColumn("alive", F.col("blob").isNotNull())


def path_index(files: DataFrame) -> DataFrame:
    """One row of files(repo, path, file, alive) for each path: a file that is alive before others, then the first."""
    order = Window.partitionBy("repo", "path").orderBy(F.desc("alive"), "file")
    return files.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def find_file(files: DataFrame, wanted: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """asked, file for wanted(asked, and repo where only one is meant): the file at that path, else the only living one whose path ends so; no row where there is none, or several.

    With roots(repo, root), where repositories lie, a path that begins with a slash is looked for in the repository that it
    lies in. Of several repositories with one path the first by name has it.
    """
    columns = ["asked", "repo"] if "repo" in wanted.columns else ["asked"]
    w = wanted.select(*columns).distinct().withColumnRenamed("repo", "in_repo").withColumn("rel", F.regexp_replace("asked", r"^(\./)+", ""))
    w = w if "in_repo" in w.columns else w.withColumn("in_repo", F.lit(None).cast("string"))
    meant = (F.col("in_repo") == F.col("repo")) | F.col("in_repo").isNull()
    known = path_index(files)
    first = lambda d: d.groupBy("asked", "in_repo").agg(F.min_by("file", F.struct("repo", "file")).alias("file"))
    found = first(known.join(w, (F.col("path") == F.col("rel")) & meant))
    if roots is not None:
        # A path meets a root at one of its own beginnings.
        parts = F.split("asked", "/")
        starts = w.filter(F.col("asked").startswith("/")).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
        r = roots.select(F.col("repo").alias("root_repo"), F.regexp_replace("root", "/+$", "").alias("root"))
        inside = starts.join(r, "root").withColumn("below", F.expr("substring(asked, length(root) + 2)"))
        inside = first(known.join(inside, (F.col("path") == F.col("below")) & (F.col("repo") == F.col("root_repo")) & meant))
        found = inside.unionByName(found.join(inside, ["asked"], "left_anti"))
    # Ends are compared by their last name first, so that paths meet by a key.
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rest = w.join(found.select(F.col("asked").alias("_asked"), F.col("in_repo").alias("_in")), (F.col("asked") == F.col("_asked")) & F.col("in_repo").eqNullSafe(F.col("_in")), "left_anti").withColumn("name", name(F.col("rel")))
    ends = files.filter("alive").withColumn("name", name(F.col("path"))).join(rest, "name").filter(F.col("path").endswith(F.concat(F.lit("/"), F.col("rel"))) & meant)
    ends = ends.groupBy("asked", "in_repo").agg(F.min("file").alias("file"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return found.unionByName(ends).select(*columns[:1], *([F.col("in_repo").alias("repo")] if len(columns) > 1 else []), "file")


def resolve_units(files: DataFrame, manual: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """files(repo, path, ...) with unit and unit_kind: by the first glob of manual(repo, place, glob, unit, kind) that fits, else by the longest of roots(repo, root, unit, kind) above the path, else by directory.

    depth fixes how many directories name a unit in the last case. Roots at the top of a repository name no unit.
    """
    own = files.select("repo", "path").distinct()
    m = manual.select(F.col("repo").alias("_repo"), "place", glob_regex(F.col("glob")).alias("_regex"), "unit", "kind")
    m = own.join(m, (F.col("repo") == F.col("_repo")) & F.regexp_like("path", F.col("_regex"))).groupBy("repo", "path").agg(F.min_by(F.struct("unit", "kind"), "place").alias("by_hand"))
    # A path meets a root at one of its own beginnings, so that roots are joined by a key.
    parts = F.split("path", "/")
    starts = own.select("repo", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root")).filter(F.col("root") != F.col("path"))
    r = starts.join(roots.filter("root <> \'\'").select("repo", "root", "unit", "kind"), ["repo", "root"]).groupBy("repo", "path").agg(F.max_by(F.struct("unit", "kind"), F.length("root")).alias("by_root"))
    out = files.join(m, ["repo", "path"], "left").join(r, ["repo", "path"], "left")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    fixed = None if depth is None else F.when(F.size(dirs) == 0, "(root)").otherwise(F.array_join(F.slice(dirs, 1, max(1, depth)), "/"))
    by_dir = F.struct((fallback_unit(F.col("path")) if fixed is None else fixed).alias("unit"), F.lit("dir").alias("kind"))
    found = F.coalesce("by_hand", "by_root", by_dir)
    return out.withColumn("unit", found["unit"]).withColumn("unit_kind", found["kind"]).drop("by_hand", "by_root")


def group_entities(files: DataFrame) -> DataFrame:
    """files(repo, path, file, alive, test, lang, unit, links, component) with entity, entity_kind and entity_unit.

    Files share an entity by directory and stem; what a living file links to, by paths from its directory, joins its
    entity. An entity's kind is that of its first file that is a component, else template where all its files are, else
    file; its unit is that of its first file that is no test.
    """
    own = files.withColumn("_key", entity_key(F.col("path")))
    links = own.filter("alive").select("repo", "_key", "file", F.explode("links").alias("link"), directory(F.col("path")).alias("dir"))
    links = links.select("repo", joined_path(F.col("dir"), F.col("link")).alias("path"), F.struct("file", "_key").alias("by"))
    # The last file that links somewhere decides.
    links = links.groupBy("repo", "path").agg(F.max("by").alias("by"))
    target = path_index(files).select("repo", "path", F.col("file").alias("_file"))
    links = links.join(target, ["repo", "path"]).select(F.col("repo").alias("_repo"), "_file", F.col("by._key").alias("_linked"))
    f = own.join(links, (F.col("repo") == F.col("_repo")) & (F.col("file") == F.col("_file")), "left").withColumn("entity", F.coalesce("_linked", "_key")).drop("_repo", "_file", "_linked", "_key")
    first = lambda value, when: F.min_by(F.when(when, F.col(value)), F.when(when, F.col("file")))
    e = f.groupBy("repo", "entity").agg(
        first("component", F.col("component").isNotNull()).alias("_component"),
        F.min(F.col("lang") == "template").alias("_templates"),
        F.coalesce(first("unit", ~F.col("test")), F.min_by("unit", "file")).alias("entity_unit"),
    )
    e = e.withColumn("entity_kind", F.coalesce("_component", F.when(F.col("_templates"), "template").otherwise("file"))).drop("_component", "_templates")
    return f.join(e, ["repo", "entity"])


def unit_label(repo: Column, unit: Column, repos: Column) -> Column:
    """The unit, after its repo where there are several."""
    return F.when(repos > 1, F.concat_ws(":", repo, unit)).otherwise(unit)
