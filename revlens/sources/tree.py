"""The newest tree of a repository as a table: its listing, and its contents by hash."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Arguments that a listing is made with.
LISTING = ("ls-tree", "-r", "-l", "-z")
ENTRY = r"(?s)^(\d+) (\w+) ([0-9a-f]+) +(\S+)\t(.*)$"


def dump_tree(repo: str, out: str, revision: str = "HEAD") -> str:
    """Write a revision's listing, records ending with a zero byte, to a file. Executors must see it where Spark is to read it."""
    with Path(out).open("wb") as f:
        subprocess.run(["git", "-C", repo, *LISTING, revision], stdout=f, check=True)
    return out


def parse_listing(records: DataFrame) -> DataFrame:
    """repo, path, blob, size of records(repo, value): files only; submodules and what is no entry are left out."""
    field = lambda k: F.regexp_extract("value", ENTRY, k)
    return records.filter(field(2) == "blob").select("repo", field(5).alias("path"), field(3).alias("blob"), field(4).try_cast("long").alias("size"))


def read_listing(spark: SparkSession, path: str, repo: str) -> DataFrame:
    return parse_listing(spark.read.option("lineSep", "\0").text(path).select(F.lit(repo).alias("repo"), "value"))


def dump_contents(repo: str, folder: str, blobs: list[str]) -> int:
    """Write contents to folder/ab/cdef..., named by their hashes; how many were written. Those that are there stay as they are.

    One process hands the contents over one after the other, so that only one is held at a time.
    """
    missing = [b for b in blobs if not (Path(folder) / b[:2] / b[2:]).exists()]
    if not missing:
        return 0
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
        for blob in missing:
            git.stdin.write(f"{blob}\n".encode())
            git.stdin.flush()
            size = int(git.stdout.readline().split()[2])
            content = git.stdout.read(size)
            git.stdout.read(1)
            at = Path(folder) / blob[:2] / blob[2:]
            at.parent.mkdir(parents=True, exist_ok=True)
            part = at.with_name(f"_{at.name}")  # a name that readers pass over, until all of it is there
            part.write_bytes(content)
            part.rename(at)
        git.stdin.close()
    return len(missing)


def read_contents(spark: SparkSession, folder: str) -> DataFrame:
    """blob, content of a folder of contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace(F.regexp_extract("path", r"([0-9a-f]{2}/[0-9a-f]{38,})$", 1), "/", "").alias("blob"), "content").filter("blob <> ''")


def read_tree(listing: DataFrame, contents: DataFrame) -> DataFrame:
    """repo, path, blob, size, content: what from_history() takes. Entries without content stay, with null."""
    return listing.join(contents, "blob", "left").select("repo", "path", "blob", "size", "content")
