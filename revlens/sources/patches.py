"""Patches of a history, or between two revisions, as tables of changed files with their hunks."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.text import hunk, unquoted

#: What stands before each record of a dump; no text has it by chance.
SEPARATOR = "\x1e\x1f\x1e"
# Arguments that patches are made with.
PATCH = ("-p", "-U0", "--full-index", "-M", "--no-color", "--no-ext-diff")
HUNK = r"(?md)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"


def dump_patches(repo: str, out: str, revisions: str = "HEAD", since: str | None = None) -> str:
    """Write the patches of a repository's commits, oldest first, to a file. Executors must see it where Spark is to read it."""
    command = ["git", "-C", repo, "log", "--no-merges", "--reverse", *PATCH, f"--format={SEPARATOR}%H"] + ([f"--since={since}"] if since else [])
    with Path(out).open("wb") as f:
        subprocess.run([*command, revisions], stdout=f, check=True)
    return out


def dump_diff(repo: str, out: str, base: str, head: str) -> str:
    """Write what changed from one revision to another as one record, named by both."""
    with Path(out).open("wb") as f:
        f.write(f"{SEPARATOR}{base}..{head}\n".encode())
        f.flush()
        subprocess.run(["git", "-C", repo, "diff", *PATCH, base, head], stdout=f, check=True)
    return out


def parse_patches(records: DataFrame) -> DataFrame:
    """repo, sha, path, old_path, status, old_blob, new_blob, hunks, added, deleted of records(repo, value).

    A record's first line is its name, sha; the files' sections follow. Lines of content begin with a sign, so that the lines
    which begin a section, its head and its hunks are told by their first word. status is added, deleted, renamed or
    modified, old_path only a renamed file's; a blob is null on the side where there is no file. Binary files have no hunks.
    Records are cut into sections and hunks where they are read, without a shuffle. Records without a name have no rows.
    """
    sections = F.split("value", r"(?md)^diff --git ")
    r = records.select("repo", F.trim(F.element_at(F.split(sections[0], "\n"), 1)).alias("sha"), F.explode(F.slice(sections, F.lit(2), F.size(sections))).alias("section")).filter("sha <> ''")
    r = r.withColumn("head", F.regexp_extract("section", r"(?sd)^(.*?)(?=\n@@ |\z)", 1)).withColumn("names", F.element_at(F.split("head", "\n"), 1))
    line = lambda start: F.nullif(F.regexp_extract("head", rf"(?md)^{start} (.*)$", 1), F.lit(""))
    # A name that did not change stands there twice, in quotes if it is unusual.
    plain = F.nullif(F.regexp_extract("names", r"(?d)^a/(.*) b/\1$", 1), F.lit(""))
    quoted = F.regexp_replace(unquoted(F.concat(F.lit('"'), F.regexp_extract("names", r'(?d)^"a/(.*)" "b/\1"$', 1), F.lit('"'))), "^$", "")
    same = F.coalesce(plain, F.nullif(quoted, F.lit("")))
    to, source = unquoted(line("rename to")), unquoted(line("rename from"))
    has = lambda start: F.regexp_like("head", F.lit(rf"(?md)^{start} "))
    status = F.when(has("new file mode"), "added").when(has("deleted file mode"), "deleted").when(source.isNotNull(), "renamed").otherwise("modified")

    def blob(side: int) -> Column:
        h = F.regexp_extract("head", r"(?md)^index ([0-9a-f]+)\.\.([0-9a-f]+)", side)
        return F.when(~h.rlike("^0*$"), h)

    r = r.select(
        "repo", "sha", F.coalesce(to, same).alias("path"), source.alias("old_path"), status.alias("status"), blob(1).alias("old_blob"), blob(2).alias("new_blob"),
        F.transform(F.regexp_extract_all("section", F.lit(HUNK), F.lit(0)), hunk).alias("hunks"),
    )
    total = lambda side: F.aggregate("hunks", F.lit(0).cast("long"), lambda n, h: n + h[side])
    return r.filter(F.col("path").isNotNull()).withColumns({"added": total("new_count"), "deleted": total("old_count")})


def read_patches(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """parse_patches() of a dump."""
    return parse_patches(spark.read.option("lineSep", SEPARATOR).text(path).select(F.lit(repo).alias("repo"), "value"))
