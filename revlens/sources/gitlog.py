"""Version-control history as tables: log text is split and parsed by Spark, renames join the versions of paths."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.functions.text import unquoted
from revlens.operators.identity import components
from revlens.plans.staging import exists, stage

# The fields of a record, and the arguments that a log is made with.
LOG_FORMAT = "%x1e%H%x1f%aN%x1f%aE%x1f%at%x1f%B%x1f"
MESSAGE_CHARS = 4000


def dump_log(repo: str, out: str, revisions: str = "HEAD", since: str | None = None) -> str:
    """Write a repository's log, oldest first, to a text file that Spark can read."""
    command = ["git", "-C", repo, "-c", "core.quotePath=false", "log", "--no-merges", "--reverse", "-M", "--numstat", "--summary", f"--format={LOG_FORMAT}"]
    command += [f"--since={since}"] if since else []
    with Path(out).open("wb") as f:
        subprocess.run([*command, revisions], stdout=f, check=True)
    return out


def read_log(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """One row for each commit: repo, seq, sha, author_name, author_email, ts, message, coauthors, lines, created, removed.

    seq follows the order of the records in the log: where a record's part of the file begins, and its place in it.
    Records without a hash are skipped, a time that is no number is null. Of a log in several files each has its own
    order, so that a repository's log is one file.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    records = spark.read.option("lineSep", "\x1e").text(path).select("value", (F.col("_metadata.file_block_start") + place).alias("seq")).filter(F.length(F.trim("value")) > 0)
    fields = F.split("value", "\x1f", 6)
    p = [F.get(fields, k) for k in range(6)]  # what stands before the first record has no fields
    trailers = F.regexp_extract_all(p[4], F.lit(r"(?im)^\s*co-authored-by:\s*(.+?)\s*$"), F.lit(1))
    coauthors = F.transform(trailers, lambda t: F.struct(F.trim(F.regexp_extract(t, r"^(.*?)\s*<", 1)).alias("name"), F.regexp_extract(t, r"<([^>]*)>", 1).alias("email")))
    d = records.select(
        F.lit(repo).alias("repo"),
        "seq",
        p[0].alias("sha"),
        p[1].alias("author_name"),
        p[2].alias("author_email"),
        p[3].try_cast("long").alias("ts"),
        F.substring(F.regexp_replace(p[4], r"^\s+|\s+$", ""), 1, MESSAGE_CHARS).alias("message"),
        coauthors.alias("coauthors"),
        F.filter(F.split(p[5], "\n"), lambda x: F.trim(x) != "").alias("lines"),
        *[_mode_paths(p[5], kind).alias(name) for kind, name in (("create", "created"), ("delete", "removed"))],
    )
    return d.filter(F.length("sha") >= 7)


def _mode_paths(lines: Column, kind: str) -> Column:
    """The paths of lines like " create mode 100644 path"."""
    paths = F.regexp_extract_all(lines, F.lit(rf"(?md)^ {kind} mode \S+ (.*)$"), F.lit(1))
    return F.transform(F.coalesce(paths, F.array().cast("array<string>")), unquoted)


def new_path(path: Column) -> Column:
    """Where a rename like a/{b => c}/d or x => y leads."""
    braced = F.regexp_replace(F.regexp_replace(path, r"\{(.*?) => (.*?)\}", "$2"), "//", "/")
    return F.when(path.rlike(r"\{.* => .*\}"), braced).when(F.instr(path, " => ") > 0, F.regexp_extract(path, r"^.* => (.*)$", 1)).otherwise(path)


def old_path(path: Column) -> Column:
    braced = F.regexp_replace(F.regexp_replace(path, r"\{(.*?) => (.*?)\}", "$1"), "//", "/")
    return F.when(path.rlike(r"\{.* => .*\}"), braced).when(F.instr(path, " => ") > 0, F.regexp_extract(path, r"^(.*) => .*$", 1))


def log_changes(log: DataFrame) -> DataFrame:
    """repo, sha, ts, pos, path, old_path, added, deleted from the numstat lines; binary files changed no lines."""
    row = log.select("repo", "sha", "ts", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t"))
    fields = F.split("line", "\t", 3)
    p = [F.get(fields, k) for k in range(3)]  # a filter above may be asked before the one on the line
    n = lambda k: F.when(p[k].rlike(r"^\d+$"), p[k].cast("long")).otherwise(0)
    return row.select("repo", "sha", "ts", "pos", new_path(unquoted(p[2])).alias("path"), old_path(unquoted(p[2])).alias("old_path"), n(0).alias("added"), n(1).alias("deleted"))


def follow_renames(changes: DataFrame, order: DataFrame) -> DataFrame:
    """changes with file_id, the same for all rows of one file. order(repo, sha, seq) is the log's order.

    A rename takes the file along and frees its old path: what comes to that path later is another file. A path's rows are
    cut into versions where a file comes to it, or where it was freed before; a rename joins the version that ends with it
    to the one that begins. Versions that hang together are a file. Paths are dealt to tasks, so that no task holds a
    repository. A file is called by its first path, a later one of the same first path with its number.
    """
    d = changes.join(order, ["repo", "sha"])
    come, go, stay = 1, -1, 0
    moved = F.col("old_path").isNotNull()
    events = d.select("repo", "path", "seq", "pos", F.when(moved, come).otherwise(stay).alias("kind"))
    events = events.unionByName(d.filter(moved).select("repo", F.col("old_path").alias("path"), "seq", "pos", F.lit(go).alias("kind")))
    in_order = Window.partitionBy("repo", "path").orderBy("seq", "pos")
    before = F.lag("kind").over(in_order)
    events = events.withColumn("begins", (before.isNull() | (F.col("kind") == come) | (before == go)).cast("int"))
    events = stage(events.withColumn("version", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "path-versions")
    node = F.concat_ws("\x1f", "repo", "path", F.format_string("%09d", "version"))
    left, came = events.filter(F.col("kind") == go), events.filter(F.col("kind") == come)
    edges = stage(came.select("repo", "seq", "pos", node.alias("b"), F.col("path").alias("b_path"), F.col("version").alias("b_version")).join(left.select("repo", "seq", "pos", node.alias("a"), F.col("path").alias("a_path"), F.col("version").alias("a_version")), ["repo", "seq", "pos"]), "renames")
    labels = components(edges.select("a", "b"))
    # A file begins with the version that no rename leads to.
    ends = edges.select(F.col("a").alias("node"), "repo", F.col("a_path").alias("path"), F.col("a_version").alias("version")).unionByName(edges.select(F.col("b").alias("node"), "repo", F.col("b_path").alias("path"), F.col("b_version").alias("version"))).distinct()
    first = ends.join(edges.select(F.col("b").alias("node")), "node", "left_anti").join(labels, "node").select("label", F.col("repo").alias("r"), F.col("path").alias("first_path"), F.col("version").alias("first_version"))
    renamed = ends.join(labels, "node").join(first, "label").select("repo", "path", "version", "first_path", "first_version")
    versions = events.select("repo", "path", "version").distinct().join(renamed, ["repo", "path", "version"], "left")
    versions = versions.withColumns({"first_path": F.coalesce("first_path", "path"), "first_version": F.coalesce("first_version", "version")})
    again = F.dense_rank().over(Window.partitionBy("repo", "first_path").orderBy("first_version"))
    name = F.when(F.col("again") == 1, F.col("first_path")).otherwise(F.concat_ws("#", "first_path", F.col("again").cast("string")))
    versions = versions.withColumn("again", again).select("repo", "path", "version", name.alias("file_id"))
    rows = events.filter(F.col("kind") != go).join(versions, ["repo", "path", "version"]).select("repo", "path", "seq", "pos", "file_id")
    return d.join(rows, ["repo", "path", "seq", "pos"]).select(*d.columns, "file_id")


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at path has not yet, each key once; the table as it is then.

    The table is partitioned by repo. What is new is found by its keys, so that a job that died on the way can be
    repeated: rows that it wrote are there, others are appended.
    """
    rows = rows.dropDuplicates(keys)
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    rows.write.mode("append").partitionBy("repo").parquet(path)
    return spark.read.parquet(path)


def replace_repos(rows: DataFrame, path: str) -> None:
    """Write rows in place of what the table at path has of their repositories; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)
