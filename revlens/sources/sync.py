"""A store of histories that is brought up to date repository by repository, and read as it was when a repository was last handed over.

A store has the tables log and tree, partitioned by repository and version, a folder of contents, the table of their
metrics, and heads: which revision, version and batch of each repository counts. Heads are written anew as a whole, under
the next number, once the rows that they tell of are there. Readers take the highest number that is complete, so that they
see all of a hand-over or nothing of it; rows of a job that died before are not told of, and are written again.
"""

from __future__ import annotations

import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.model import Model, Params
from revlens.plans.staging import exists
from revlens.sources.gitlog import dump_log, read_log
from revlens.sources.history import from_history
from revlens.sources.tree import dump_contents, dump_tree, read_contents, read_listing, read_tree

HEADS = "repo string, head string, version long, batch long, last_seq long"
SKIPPED, APPENDED, REPLACED = "skip", "append", "replace"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _number(spark: SparkSession, store: str) -> int:
    """The highest number of complete heads, -1 without any."""
    fs, at = _fs(spark, f"{store}/heads")
    if not fs.exists(at):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n.removeprefix("n-")) for n in names if n.startswith("n-") and exists(spark, f"{store}/heads/{n}/_SUCCESS")]
    return max(done, default=-1)


def heads(spark: SparkSession, store: str) -> DataFrame:
    """repo, head, version, batch, last_seq: what counts of each repository."""
    n = _number(spark, store)
    return spark.createDataFrame([], HEADS) if n < 0 else spark.read.schema(HEADS).parquet(f"{store}/heads/n-{n}")


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout.strip()


def _is_ancestor(repo: str, old: str, new: str) -> bool:
    return subprocess.run(["git", "-C", repo, "merge-base", "--is-ancestor", old, new], capture_output=True, check=False).returncode == 0


def _shared(spark: SparkSession, local: str, store: str, name: str) -> str:
    """A file of the driver's in the store, where executors can read it."""
    to = f"{store}/incoming/{name}"
    fs, at = _fs(spark, to)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{Path(local).resolve()}"), at)
    return to


def sync(spark: SparkSession, store: str, name: str, repo: str, revision: str = "HEAD", contents: str | None = None) -> str:
    """Bring a repository, at a path of the driver's, up to date in the store; whether it was skipped, appended or replaced.

    Without new commits nothing is written. Where the last head is an ancestor of the new one, the commits in between are
    appended; after a rewritten history all of the repository is written under a new version. The tree is the newest one's.
    contents is the folder of contents, which the driver must be able to write: store/contents by default.
    """
    head = _git(repo, "rev-parse", revision)
    rows = {r["repo"]: r for r in heads(spark, store).collect()}  # a row for each repository
    old = rows.get(name)
    if old and old["head"] == head:
        return SKIPPED
    grows = bool(old) and _is_ancestor(repo, old["head"], head)
    version = old["version"] if grows else (old["version"] + 1 if old else 0)
    batch = old["batch"] + 1 if grows else 0
    offset = old["last_seq"] + 1 if grows else 0
    with tempfile.TemporaryDirectory() as folder:
        log = _shared(spark, dump_log(repo, f"{folder}/log", f"{old['head']}..{head}" if grows else head), store, f"log-{head}")
        tree = _shared(spark, dump_tree(repo, f"{folder}/tree", head), store, f"tree-{head}")
    new = read_log(spark, log, name).withColumns({"seq": F.col("seq") + offset, "version": F.lit(version).cast("long"), "batch": F.lit(batch).cast("long")})
    listing = read_listing(spark, tree, name)
    dump_contents(repo, (contents or f"{store}/contents").removeprefix("file://"), [r["blob"] for r in listing.select("blob").distinct().toLocalIterator()])
    # A batch's folder is written over, so that what a job left that died on the way counts once.
    where = f"repo={name}/version={version}/batch={batch}"
    new.drop("repo", "version", "batch").write.mode("overwrite").parquet(f"{store}/log/{where}")
    listing.drop("repo").write.mode("overwrite").parquet(f"{store}/tree/{where}")
    last = spark.read.parquet(f"{store}/log/{where}").agg(F.max("seq")).first()[0]
    rows[name] = {"repo": name, "head": head, "version": version, "batch": batch, "last_seq": offset if last is None else last}
    out = spark.createDataFrame([tuple(r[c.split()[0]] for c in HEADS.split(", ")) for r in rows.values()], HEADS).coalesce(1)
    out.write.parquet(f"{store}/heads/n-{_number(spark, store) + 1}")
    return APPENDED if grows else REPLACED


def _current(spark: SparkSession, store: str, table: str, all_batches: bool) -> DataFrame:
    h = heads(spark, store).select(F.col("repo").alias("_repo"), F.col("version").alias("_version"), F.col("batch").alias("_batch"))
    rows = spark.read.option("basePath", f"{store}/{table}").parquet(f"{store}/{table}").withColumn("repo", F.col("repo").cast("string"))
    within = F.col("batch") <= F.col("_batch") if all_batches else F.col("batch") == F.col("_batch")
    return rows.join(F.broadcast(h), (F.col("repo") == F.col("_repo")) & (F.col("version") == F.col("_version")) & within).drop("version", "batch", "_repo", "_version", "_batch")


def stored_log(spark: SparkSession, store: str) -> DataFrame:
    """The rows of read_log() of all repositories, as last handed over."""
    return _current(spark, store, "log", True)


def stored_tree(spark: SparkSession, store: str, contents: str | None = None) -> DataFrame:
    """The rows of read_tree() of all repositories, as last handed over."""
    return read_tree(_current(spark, store, "tree", False), read_contents(spark, contents or f"{store}/contents"))


def stored_model(spark: SparkSession, store: str, params: Params = Params(), contents: str | None = None, **about) -> Model:
    """from_history() of all that is stored; only contents that were not there before are measured."""
    return from_history(stored_log(spark, store), stored_tree(spark, store, contents), params, cache=f"{store}/metrics", **about)


def forget_old(spark: SparkSession, store: str) -> int:
    """Delete the versions and heads that no longer count; how many folders that were. Nobody may be reading them."""
    n, gone = _number(spark, store), 0
    keep = {(r["repo"], r["version"]) for r in heads(spark, store).collect()}
    fs, at = _fs(spark, f"{store}/heads")
    for s in fs.listStatus(at) if fs.exists(at) else []:
        if s.getPath().getName() != f"n-{n}":
            gone += bool(fs.delete(s.getPath(), True))
    for table in ("log", "tree"):
        fs, at = _fs(spark, f"{store}/{table}")
        for r in fs.listStatus(at) if fs.exists(at) else []:
            for v in fs.listStatus(r.getPath()):
                if (r.getPath().getName().removeprefix("repo="), int(v.getPath().getName().removeprefix("version="))) not in keep:
                    gone += bool(fs.delete(v.getPath(), True))
    return gone
