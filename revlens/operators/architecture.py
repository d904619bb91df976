"""Architectural units of repositories, read from their manifests and trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.paths import directory, file_name
from revlens.operators.cleaning import attribute_excludes
from revlens.plans.staging import stage

# Manifests, directories that are not the repository's own, and what tells a federated front end.
MANIFESTS = ("angular.json", "nx.json", "project.json", "package.json", "composer.json")
IGNORED = ("node_modules", "vendor", "dist", ".angular", ".nx", "coverage")
FEDERATION_FILE = r"^((module-)?federation\.config|webpack(\.[a-z]+)?\.config)\.(js|ts|mjs|cjs|json)$"
FEDERATION_CONTENT = r"ModuleFederationPlugin|withModuleFederation(Plugin)?|withNativeFederation|@module-federation/|shareAll\s*\("
TEST = r"\.spec\.|/test/|/tests/|/e2e/|/spec/|^tests/|^spec/"
#: Units in the order in which they are looked for: of several with one root the first stays, packages give way to others.
WORKSPACE, PROJECT, PACKAGE, LAYER, FEATURE, FEDERATED = range(6)

_UNIT = "repo string, rank int, at string, sub int, unit string, kind string, root string, tags array<string>, source string"


def own_files(tree: DataFrame) -> DataFrame:
    """tree(repo, path, content) with name and dir, without what lies in ignored directories."""
    own = ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED)))
    return tree.select("repo", "path", "content").filter(own).withColumns({"name": file_name(F.col("path")), "dir": directory(F.col("path"))})


def manifests(tree: DataFrame) -> DataFrame:
    """repo, path, name, dir, text, json of the files that units are read from; json is null where the text is none."""
    wanted = F.col("name").isin(*MANIFESTS) | F.col("name").rlike(FEDERATION_FILE)
    text = F.coalesce(F.decode("content", "utf-8"), F.lit(""))
    return own_files(tree).filter(wanted).select("repo", "path", "name", "dir", text.alias("text")).withColumn("json", F.try_parse_json("text"))


def _of(json: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(json, path, kind)


def _unit(df: DataFrame, rank: int, at: Column, unit: Column, kind: Column | str, root: Column, source: str, tags: Column | None = None, sub: int = 0) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    tags = F.array().cast("array<string>") if tags is None else tags
    return df.select("repo", F.lit(rank).alias("rank"), at.alias("at"), F.lit(sub).alias("sub"), unit.alias("unit"), kind.alias("kind"), root.alias("root"), tags.alias("tags"), F.lit(source).alias("source"))


def _below(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """rows of roots(repo, dir, ...) with rest, for each path below: a path meets a root at one of its own beginnings."""
    parts = F.split("path", "/")
    starts = F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k")
    rest = F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), "/")
    below = paths.select("repo", "path", starts).select("repo", F.array_join(F.slice(parts, F.lit(1), F.col("k")), "/").alias("dir"), rest.alias("rest"))
    return below.join(roots, ["repo", "dir"])


def frameworks(tree: DataFrame) -> DataFrame:
    """repo, framework: what a repository is made with."""
    m = manifests(tree)
    top = F.col("path") == F.col("name")
    said = lambda x: F.contains("text", F.lit(x))
    composer = _composer(tree, m)
    rules = [
        m.filter(top & (F.col("name") == "angular.json")).select("repo", F.lit("angular").alias("framework")),
        m.filter((top & (F.col("name") == "nx.json")) | ((F.col("name") == "project.json") & F.col("json").isNotNull())).select("repo", F.lit("nx").alias("framework")),
        m.filter((F.col("name") == "package.json") & said('"@angular/core"')).select("repo", F.lit("angular").alias("framework")),
        m.filter(F.col("name") == "package.json").select("repo", F.lit("node").alias("framework")),
        composer.select("repo", F.lit("php").alias("framework")),
        composer.filter("laravel").select("repo", F.lit("laravel").alias("framework")),
        composer.filter("symfony and not laravel").select("repo", F.lit("symfony").alias("framework")),
        _federated(m).select("repo", F.lit("module-federation").alias("framework")),
    ]
    return reduce(DataFrame.unionByName, rules).distinct()


def _composer(tree: DataFrame, m: DataFrame) -> DataFrame:
    """repo, dir, path, json, laravel, symfony of each PHP package."""
    c = m.filter(F.col("name") == "composer.json")
    tools = own_files(tree).filter(F.col("name") == "artisan").select("repo", "dir", F.lit(True).alias("tool"))
    c = c.join(tools, ["repo", "dir"], "left")
    said = lambda x: F.contains("text", F.lit(x))
    return c.select("repo", "dir", "path", "json", (said("laravel/framework") | F.coalesce("tool", F.lit(False))).alias("laravel"), said("symfony/framework-bundle").alias("symfony"))


def _federated(m: DataFrame) -> DataFrame:
    """repo, path, dir, role of each configuration of a federated front end."""
    f = m.filter(F.col("name").rlike(FEDERATION_FILE) & (F.col("text").rlike(FEDERATION_CONTENT) | F.contains("name", F.lit("federation"))))
    said = lambda x: F.contains("text", F.lit(x))
    return f.select("repo", "path", "dir", F.when(said("exposes"), "remote").when(said("remotes"), "host").otherwise("mfe").alias("role"))


def _candidates(tree: DataFrame, m: DataFrame) -> DataFrame:
    """A row for each unit that a manifest or a directory tells of, federated ones left out."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    project_kind = lambda j: F.when(_of(j, "$.projectType") == "library", "lib").otherwise("app")

    a = m.filter((F.col("path") == "angular.json")).select("repo", F.explode(_of(F.col("json"), "$.projects", "map<string,variant>")).alias("unit", "p"))
    root = F.coalesce(F.nullif(_of(F.col("p"), "$.root"), F.lit("")), _of(F.col("p"), "$.sourceRoot"), F.lit(""))
    workspace = _unit(a, WORKSPACE, F.col("unit"), F.col("unit"), project_kind(F.col("p")), F.regexp_replace(root, "/+$", ""), "angular")

    named = lambda by: F.coalesce(_of(F.col("json"), "$.name"), by)
    tags = F.coalesce(_of(F.col("json"), "$.tags", "array<string>"), F.array().cast("array<string>"))
    n = m.filter((F.col("name") == "project.json") & F.col("json").isNotNull())
    project = _unit(n, PROJECT, F.col("path"), named(F.when(F.col("dir") == "", F.col("repo")).otherwise(last(F.col("dir")))), project_kind(F.col("json")), F.col("dir"), "nx", tags)
    p = m.filter((F.col("name") == "package.json") & (F.col("dir") != ""))
    package = _unit(p, PACKAGE, F.col("path"), named(last(F.col("dir"))), "package", F.col("dir"), "node")

    c = _composer(tree, m)
    below = _below(tree, c.filter("laravel or symfony"))
    layers = []
    for sub, (base, source, pattern, when) in enumerate((("app", "laravel", r"^app/([^/]+)/", F.col("laravel")), ("app/Http", "laravel", r"^app/Http/([^/]+)/", F.col("laravel")), ("src", "symfony", r"^src/([^/]+)/", ~F.col("laravel")))):
        d = below.filter(when).withColumn("d", F.regexp_extract("rest", pattern, 1)).filter((F.col("d") != "") & ~((F.lit(base) == "app") & (F.col("d") == "Http")))
        unit = F.concat(F.lit(f"{base}/"), F.col("d"))
        d = d.select("repo", "path", unit.alias("u"), F.concat_ws("/", F.nullif(F.col("dir"), F.lit("")), unit).alias("r")).distinct()
        layers.append(_unit(d, LAYER, F.col("path"), F.col("u"), "layer", F.col("r"), source, sub=sub))
    service = _unit(c.filter("dir <> ''"), LAYER, F.col("path"), named(last(F.col("dir"))), "service", F.col("dir"), "php", sub=3)

    name = F.col("name")
    feature = (name.endswith(".module.ts") & ~name.endswith("-routing.module.ts") & (name != "app.module.ts")) | (name.endswith(".routes.ts") & (name != "app.routes.ts"))
    f = own_files(tree).filter(feature & ~F.lower("path").rlike(TEST) & (F.col("dir") != "")).select("repo", "dir").distinct()
    features = _unit(f, FEATURE, F.col("dir"), last(F.col("dir")), "feature", F.col("dir"), "angular")
    return reduce(DataFrame.unionByName, [workspace, project, package, *layers, service, features])


def detect_units(tree: DataFrame) -> DataFrame:
    """repo, root, unit, kind, tags, source for tree(repo, path, content): what resolve_units() takes as roots.

    Workspaces, projects, packages, layers of PHP frameworks and feature directories, each with the directory above its
    files. Of several with one root the first stays, in this order; a package gives way to what is no feature. A federated
    front end marks the unit that it lies in, or is one of its own. Names are unique in a repository: later ones of a name
    are called by their root. Manifests that are no JSON count as empty; null contents too. Only manifests are read.
    """
    m = stage(manifests(tree), "manifests")
    order = Window.partitionBy("repo", "root").orderBy((F.col("rank") == FEATURE).cast("int"), (F.col("source") == "node").cast("int"), "rank", "at", "sub", "unit")
    first = F.min(F.struct("rank", "at", "sub", "unit")).over(Window.partitionBy("repo", "root"))
    u = _candidates(tree.select("repo", "path", "content"), m).withColumn("place", first).withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    u = stage(u, "units")

    # The unit that a federated front end lies in: the longest of its directory's beginnings that is one.
    f = stage(_federated(m), "federated")
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    ups = f.select("repo", "path", "dir", "role", F.explode(above).alias("root"))
    longest = lambda d: d.groupBy("repo", "path").agg(F.max_by("root", F.length("root")).alias("owner"))
    owned = longest(ups.join(u.filter(F.col("rank") != FEATURE).select("repo", "root"), ["repo", "root"]))
    f = f.join(owned, ["repo", "path"], "left")
    free = f.filter("owner is null")
    # Of those without one, the first by path is a unit, and others below it lie in that.
    firsts = ups.select("repo", "path", "root").join(free.select("repo", F.col("dir").alias("root"), F.col("path").alias("by")), ["repo", "root"]).filter(F.col("by") < F.col("path")).select("repo", "path").distinct()
    new = free.join(firsts, ["repo", "path"], "left_anti")
    later = longest(ups.join(free.join(firsts, ["repo", "path"]).select("repo", "path"), ["repo", "path"]).join(new.select("repo", F.col("dir").alias("root"), F.col("path").alias("by")), ["repo", "root"]).filter(F.col("by") < F.col("path")))
    roles = f.filter("owner is not null").select("repo", F.col("owner").alias("root"), "path", "role").unionByName(later.join(f.drop("owner"), ["repo", "path"]).select("repo", F.col("owner").alias("root"), "path", "role"))
    made = _unit(new, FEDERATED, F.col("path"), F.when(F.col("dir") == "", F.col("repo")).otherwise(F.element_at(F.split("dir", "/"), -1)), "mfe", F.col("dir"), "module-federation", F.array("role"))
    made = made.join(u.select("repo", "root"), ["repo", "root"], "left_anti").withColumn("place", F.struct("rank", "at", "sub", "unit"))
    roles = roles.groupBy("repo", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "role"))), lambda x: x["role"]).alias("roles"))
    u = u.unionByName(made.select(*u.columns)).join(roles, ["repo", "root"], "left")
    marked = F.col("roles").isNotNull()
    u = u.withColumns({"kind": F.when(marked, "mfe").otherwise(F.col("kind")), "tags": F.array_distinct(F.concat("tags", F.coalesce("roles", F.array().cast("array<string>"))))})

    nth = F.row_number().over(Window.partitionBy("repo", "unit").orderBy("place"))
    u = u.withColumn("n", nth).withColumn("called", F.when(F.col("n") == 1, F.col("unit")).when(F.col("root") == "", F.concat("unit", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("root")))
    return u.select("repo", "root", F.col("called").alias("unit"), "kind", "tags", "source")


def tree_excludes(tree: DataFrame) -> DataFrame:
    """repo, glob of the .gitattributes files of a tree, what attribute_excludes() tells."""
    a = own_files(tree).filter(F.col("name") == ".gitattributes")
    return attribute_excludes(a.select("repo", "dir", F.decode("content", "utf-8").alias("text")))
