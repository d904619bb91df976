"""Column functions over short texts: names in reports, quoted paths, hunk headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA_CHARS = 8


def truncated(text: Column, most: int) -> Column:
    """The text, or its beginning and an ellipsis, of so many characters at most."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 1)), F.lit("…")))


def listed(items: Column, most: int) -> Column:
    """"a, b, c", and how many more there are than so many."""
    some = F.array_join(F.slice(items, 1, most), ", ")
    more = F.concat(some, F.lit(" and "), (F.size(items) - most).cast("string"), F.lit(" more"))
    return F.when(F.size(items) <= most, some).otherwise(more)


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, SHA_CHARS)


def hunk(line: Column) -> Column:
    """old_start, old_count, new_start, new_count of a line like @@ -1,2 +3 @@, counts 1 where they are left out; null for other lines."""
    pattern = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))?"
    n = lambda k: F.regexp_extract(line, pattern, k)
    count = lambda k: F.when(n(k) == "", 1).otherwise(n(k).try_cast("int"))
    found = F.struct(n(1).try_cast("int").alias("old_start"), count(2).alias("old_count"), n(3).try_cast("int").alias("new_start"), count(4).alias("new_count"))
    return F.when(line.rlike(pattern), found)


def unquoted(path: Column) -> Column:
    """A path as it is, from one in double quotes with backslashes before special characters and octal bytes."""
    trimmed = F.rtrim(path)
    body = F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
    pieces = F.regexp_extract_all(body, F.lit(r"(?s)\\[0-7]{1,3}|\\.|[^\\]+"), F.lit(0))

    def as_hex(x: Column) -> Column:
        rest = F.substring(x, F.lit(2), F.length(x))
        octal = F.lpad(F.conv(rest, 8, 16), 2, "0")
        plain = F.hex(F.encode(x, "utf-8"))
        escaped = F.when(rest == "n", F.lit("0A")).when(rest == "t", F.lit("09")).otherwise(F.hex(F.encode(rest, "utf-8")))
        return F.when(x.rlike(r"^\\[0-7]"), octal).when(x.startswith("\\"), escaped).otherwise(plain)

    whole = F.decode(F.unhex(F.array_join(F.transform(pieces, as_hex), "")), "utf-8")
    return F.when(trimmed.startswith('"') & trimmed.endswith('"') & (F.length(trimmed) >= 2), whole).otherwise(trimmed)
