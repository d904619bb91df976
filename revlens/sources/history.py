"""The model from a parsed log and the newest tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import paths
from revlens.operators.architecture import detect_units, tree_excludes
from revlens.operators.cleaning import DEFAULT_EXCLUDES, without_excluded
from revlens.operators.identity import resolve
from revlens.operators.metrics import tree_metrics
from revlens.operators.resolution import group_entities, resolve_units
from revlens.plans.model import Model, Params, build
from revlens.plans.staging import stage
from revlens.sources.gitlog import follow_renames, log_changes


def people_of(log: DataFrame, aliases: DataFrame | None = None, teams: DataFrame | None = None) -> DataFrame:
    """name, email, person, display, bot, team of everyone who wrote or co-wrote a commit of read_log()."""
    who = log.select(F.explode(F.concat(F.array(F.struct(F.col("author_name").alias("name"), F.col("author_email").alias("email"))), F.col("coauthors"))).alias("w"))
    who = who.select(F.coalesce("w.name", F.lit("")).alias("name"), F.coalesce("w.email", F.lit("")).alias("email")).groupBy("name", "email").agg(F.count("*").alias("commits"))
    # Numbers that hold whichever task counts: hashes, without a sign.
    who = stage(who.withColumn("id", F.xxhash64("name", "email").bitwiseAND(F.lit((1 << 63) - 1))), "identities")
    return who.join(resolve(who, aliases, teams), "id").select("name", "email", "person", "display", "bot", "team")


def from_history(
    log: DataFrame,
    tree: DataFrame,
    params: Params = Params(),
    aliases: DataFrame | None = None,
    teams: DataFrame | None = None,
    excludes: DataFrame | None = None,
    globs: tuple[str, ...] = DEFAULT_EXCLUDES,
    units: tuple[DataFrame, DataFrame] | None = None,
    staged: bool = True,
    cache: str | None = None,
) -> Model:
    """The model of read_log() rows and tree(repo, path, content), for any number of repositories.

    Files are followed through renames and named by repository and first path; they are alive where the tree has their
    newest path. Excluded, generated, binary and oversize files are left out, by the tree's own attributes unless told
    otherwise. units has what resolve_units() takes, by default none by hand and those of the tree's manifests.
    Complexity is by indentation, since no source parser is at hand; components, their links and what health costs are read
    from the texts. With cache, the path of a table, only contents that it lacks are measured.
    """
    log = stage(log, "log")
    changes = stage(follow_renames(log_changes(log), log.select("repo", "sha", "seq")), "followed")
    file = F.concat_ws(":", "repo", "file_id")
    newest = changes.groupBy("repo", "file_id").agg(F.max_by("path", F.struct("seq", "pos")).alias("path"))
    excludes = tree_excludes(tree) if excludes is None else excludes
    f = without_excluded(newest.select("repo", "path", file.alias("file")), excludes, globs)
    about = stage(tree_metrics(tree, params.max_file_bytes, cache).drop("lang"), "tree-metrics")
    f = f.join(about, ["repo", "path"], "left").withColumn("alive", F.col("blob").isNotNull())
    f = f.filter(F.coalesce("state", F.lit("text")) == "text")
    none = lambda schema: log.sparkSession.createDataFrame([], schema)
    manual, roots = units or (none("repo string, place int, glob string, unit string, kind string"), stage(detect_units(tree), "unit-roots"))
    f = resolve_units(f.withColumns({"test": paths.is_test_path(F.col("path")), "lang": paths.language(F.col("path"))}), manual, roots)
    f = group_entities(f.withColumns({"about": F.col("component"), "component": F.col("component.kind"), "links": F.coalesce("links", F.array().cast("array<string>"))}))
    f = f.select(
        "file",
        F.concat_ws(":", "repo", "entity").alias("entity"),
        F.concat_ws(":", "repo", "entity_unit").alias("unit"),
        "repo",
        "alive",
        "test",
        "lang",
        paths.language_weight(F.col("lang")).alias("lang_weight"),
        F.coalesce("loc", F.lit(0)).cast("long").alias("loc"),
        F.coalesce("complexity", F.lit(1.0)).alias("complexity"),
        F.coalesce("health", F.lit(10.0)).alias("health"),
        "path",
        "blob",
        "entity_kind",
        "unit_kind",
        F.col("about.deps").alias("deps"),
        F.col("about.inputs").alias("inputs"),
        F.coalesce("health_reasons", F.array().cast("array<string>")).alias("health_reasons"),
    )
    people = stage(people_of(log, aliases, teams), "people")
    who = people.select("name", "email", F.col("person").alias("author"))
    commit = F.concat_ws(":", "repo", "sha")
    own = log.select("*", commit.alias("commit_id")).join(who, (F.col("author_name").eqNullSafe(F.col("name"))) & (F.col("author_email").eqNullSafe(F.col("email")))).drop("name", "email")
    co = own.select("commit_id", F.col("author").alias("main"), F.explode("coauthors").alias("w")).join(who, (F.coalesce("w.name", F.lit("")) == F.col("name")) & (F.coalesce("w.email", F.lit("")) == F.col("email")))
    co = co.filter(F.col("author") != F.col("main")).groupBy("commit_id").agg(F.sort_array(F.collect_list("author")).alias("co"))
    commits = own.join(co, "commit_id", "left").select("commit_id", "repo", "ts", "author", F.coalesce("co", F.array().cast("array<bigint>")).alias("coauthors"), "message")
    bots = people.filter("bot").select(F.col("person").alias("author")).distinct()
    authors = people.groupBy(F.col("person").alias("author")).agg(F.max("team").alias("team"), F.min("display").alias("name"))
    called = changes.select(commit.alias("commit_id"), "path", file.alias("file"))
    return build(commits, changes.select(commit.alias("commit_id"), file.alias("file"), "added", "deleted"), f, authors, bots, params, staged, called)
