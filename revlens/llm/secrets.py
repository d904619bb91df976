"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base spans come from three fixed patterns. A broader pattern proposes further tokens. Every candidate's value is
hashed, and the hashes are counted by distinct repositories and distinct owners over the whole corpus. A value looks live
if one owner has it, in however many repositories, or if two owners have it in few repositories. What more owners have,
or two in many repositories, is a copied example. A proposed token becomes a span only when it looks live and touches no
base span; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import stage, table, text_of

# The base patterns and their order.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters with the prefix
HEX = r"[0-9a-f]{16,}"
#: What the ownership count may add: long runs that mix letters and digits.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "token")
#: A value that more owners than this share is a copied example, and so is one of several owners in more repositories than this.
MAX_OWNERS = 2
MAX_REPOS = 4
#: Matches are numbered in pieces of so many, so that a text's many matches don't take quadratic time.
PIECE = 256
SALTS = 8

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost, non-overlapping matches with code-point offsets. What lies between matches gives the offsets."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), lambda x: x["whole"].isNotNull())
    length = lambda x: x["gap"] + F.length(x["whole"])

    def running(items: Column, start: Column, kind: str, made, size) -> Column:
        """made(position, item) for each item, positions running on by its size; for few items, since the array grows."""
        step = lambda acc, x: F.struct((acc["pos"] + size(x)).alias("pos"), F.concat(acc["out"], F.array(made(acc["pos"], x))).alias("out"))
        return F.aggregate(items, F.struct(start.alias("pos"), F.array().cast(kind).alias("out")), step, lambda acc: acc["out"])

    def span(pos: Column, x: Column) -> Column:
        return F.struct((pos + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (pos + length(x)).alias("end"), x["value"].alias("value"))

    total = lambda piece: F.aggregate(piece, F.lit(0), lambda n, x: n + length(x))
    starts = lambda pieces: running(F.transform(pieces, total), F.lit(0), "array<int>", lambda pos, _: pos, lambda n: n)
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PIECE).cast("int")), lambda k: F.slice(a, k * PIECE + 1, F.lit(PIECE)))
    numbered = lambda pieces: F.flatten(F.zip_with(pieces, starts(pieces), lambda piece, at: running(piece, at, _SPAN, span, length)))
    found = _let(steps, lambda a: _let(cut(a), numbered))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(_SPAN))


def looks_live(x: Column, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> Column:
    """Whether the counts of a value, owners and repos, are those of a credential in use."""
    return (x["owners"] == 1) | ((x["owners"] <= max_owners) & (x["repos"] <= max_repos))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    part = lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, part), ",")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repo: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """One row per input row: id_col, base and added spans, each with start, kind, end, value_sha256, owners, repos.

    Null texts count as empty and give no spans. A null owner counts as one owner of its own; repo is the owner's and
    language's share of documents unless told otherwise, nulls again of their own. Repeated rows each get their own
    result; they add nothing to the distinct counts. A text's spans are gathered in one row. An empty table gives an
    empty result. Other columns of docs are ignored, whatever their names.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.to_json(F.struct(F.col("source").cast("string").alias("a"), F.col("lang").cast("string").alias("b"))) if repo is None else repo
    known = lambda c: F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-"))
    named = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), known(owner).alias("owner"), known(repo).alias("repo"))
    assign = F.filter(_matches(F.col("t"), ASSIGN, 0, 2), lambda x: F.length(x["value"]) >= ASSIGN_MIN)
    mixed = lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
    every = F.concat(assign, _matches(F.col("t"), ACCESS, 1), _matches(F.col("t"), HEX, 2), F.filter(_matches(F.col("t"), TOKEN, 3), mixed))
    hashed = F.transform(every, lambda x: F.struct(x["start"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("value_sha256")))
    spans = stage(named.select("id", "owner", "repo", hashed.alias("spans")).withColumn("row", F.xxhash64("spans")), "secret-spans")

    # A proposed token goes where a base span touches it: one that begins before it and ends in it, or begins in it.
    each = spans.select("id", "row", F.explode("spans").alias("s")).select("id", "row", "s.*").distinct()
    up_to = lambda order: Window.partitionBy("id", "row").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    base_end, base_start = F.when(F.col("kind") < 3, F.col("end")), F.when(F.col("kind") < 3, F.col("start"))
    before = F.max(base_end).over(up_to(F.col("start")))
    after = F.min(base_start).over(up_to(F.desc("start")))
    touched = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    each = stage(each.withColumn("touched", touched).filter((F.col("kind") < 3) | ~F.col("touched")).drop("touched"), "secret-values")

    # Distinct (value, repository, owner) first, with partial aggregation: a value copied into a third of all
    # rows reaches the reducers once per task and owner.
    where = spans.filter(F.size("spans") > 0).select("id", "row", "owner", "repo").distinct()
    values = each.select(F.col("id").alias("of"), F.col("row").alias("of_row"), "value_sha256").distinct()
    counts = (
        where.join(values, F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))).select("value_sha256", "owner", "repo").distinct()
        .groupBy("value_sha256", "owner").agg(F.count("*").alias("r"))
        .groupBy("value_sha256").agg(F.count("*").alias("owners"), F.sum("r").alias("repos"))
    )
    # The same value's rows are dealt to several parts.
    salt = F.pmod(F.xxhash64("id", "row"), F.lit(SALTS)).cast("int")
    counts = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rated = each.withColumn("salt", salt).join(counts, ["value_sha256", "salt"])
    rated = rated.filter((F.col("kind") < 3) | looks_live({"owners": F.col("owners"), "repos": F.col("repos")}, max_owners, max_repos))
    one = F.struct("start", "kind", "end", "value_sha256", "owners", "repos")
    rated = rated.groupBy("id", "row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    out = spans.select("id", "row").alias("a").join(rated.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.row") == F.col("b.row")), "left")
    found = F.coalesce("found", F.array().cast(rated.schema["found"].dataType))
    return out.select(F.col("a.id").alias(id_col), F.filter(found, lambda x: x["kind"] < 3).alias("base"), F.filter(found, lambda x: x["kind"] == 3).alias("added"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan_secrets(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "added"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return d.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(F.filter(every, lambda x: looks_live(x))).cast("long").alias("n_live"),
        F.size(F.filter(every, lambda x: ~looks_live(x))).cast("long").alias("n_copied"),
        F.coalesce(F.array_max(F.transform(every, lambda x: x["owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform(every, lambda x: x["repos"])), F.lit(0)).alias("most_repos"),
    )


def _sql_spans(name: str, pattern: str, kind: int, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""{name} AS (
      SELECT doc_id, owner, repo, {kind} AS kind, s + before AS start_, s + before + length(w) AS end_, v AS value FROM (
        SELECT doc_id, owner, repo, w, v, g, i,
               sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS s,
               coalesce(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_id, owner, repo, unnest(ws) AS w, unnest(vs) AS v, unnest(gs[1:len(ws)]) AS g, unnest(range(len(ws))) AS i
              FROM (SELECT doc_id, owner, repo, regexp_extract_all(t, '{p}') AS ws, regexp_extract_all(t, '{p}', {group}) AS vs,
                           regexp_split_to_array(t, '{p}') AS gs FROM d)))
      WHERE {keep})"""


ORACLE = {
    "op1_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('+' || source, '-') AS owner, row(source, lang) AS repo FROM documents),
{_sql_spans("a", ASSIGN, 0, 2, f"length(v) >= {ASSIGN_MIN}")},
{_sql_spans("b", ACCESS, 1, 0, "true")},
{_sql_spans("c", HEX, 2, 0, "true")},
{_sql_spans("t0", TOKEN, 3, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")},
base AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM t0 WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t0.doc_id AND b.start_ < t0.end_ AND t0.start_ < b.end_)),
f AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos, count(DISTINCT owner) = 1 OR count(DISTINCT owner) <= {MAX_OWNERS} AND count(DISTINCT repo) <= {MAX_REPOS} AS live FROM cand GROUP BY value),
s AS (SELECT cand.*, owners, repos, live, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start_::BIGINT || ':' || end_::BIGINT AS x
      FROM cand JOIN f USING (value) WHERE kind < 3 OR live),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             string_agg(x, ',' ORDER BY start_, kind) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY start_, kind) AS every,
             count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS copied, max(owners) AS most_owners, max(repos) AS most_repos
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(copied, 0)::BIGINT AS n_copied,
       coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos
FROM d LEFT JOIN g USING (doc_id)"""
}
QUERIES = {"op1_secret_scan": op1_secret_scan}
