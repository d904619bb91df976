"""Host-level quality rules (DataFrame functions only).

Each document gets rule counts from its whole text. Failures are summed per host, each host's failure rate is shrunk
with a beta prior fitted to all hosts by moments, and a host is rejected with all of its documents where nearly all of
its posterior lies above what the prior allows; host verdicts are joined back to the documents. Where documents have no
url, their source stands for the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import WORD, stage, table, text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host may fail as often as the prior's mean and so many of its deviations, but always at this rate, and never above that.
DEVIATIONS = 2.0
ALWAYS_RATE = 0.25
MAX_HOST_RATE = 0.5
#: It is rejected when its shrunk rate, less so many deviations of the posterior, is above.
TAIL = 2.0
SALTS = 8


def _repeated(words: Column) -> Column:
    """How many words lie in five-word windows that occur at least twice."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = lambda a, k: F.get(a, k)["h"]

    def twice(a: Column) -> Column:
        flags = F.transform(a, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(near(a, k - 1) == x["h"], F.lit(False)) | F.coalesce(near(a, k + 1) == x["h"], F.lit(False))).alias("f")))
        return F.sort_array(F.transform(F.filter(flags, lambda x: x["f"]), lambda x: x["i"]))

    step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
    total = F.aggregate(twice(F.col("placed")), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda acc: acc["n"])
    return placed, total


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """id_col, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed for every row; null texts have no words."""
    host = F.col("source") if host is None else host
    d = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), text_of(text_col).alias("t"))
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("windows"),
    )
    # Most texts repeat no window; only the others are sorted.
    d = d.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")))
    placed, total = _covered(F.col("windows"))
    d = d.withColumn("placed", placed).withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select(F.col("id").alias(id_col), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_rates(rules: DataFrame) -> DataFrame:
    """host, n, fails, rate, rejected: the failure rate under a beta prior whose mean and variance are those of all hosts' rates.

    With one host, or no spread between hosts, the prior has the weight of one document. Null hosts are one host. An
    empty table gives an empty result.
    """
    by_host = rules.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    raw = F.col("fails") / F.col("n")
    prior = by_host.agg((F.sum("fails") / F.sum("n")).alias("m"), F.avg(raw * raw).alias("sq"), F.avg(raw).alias("avg"))
    prior = prior.select("m", F.greatest(F.col("sq") - F.col("avg") * F.col("avg"), F.lit(0.0)).alias("v"))
    weight = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(1.0)
    limit = F.least(F.lit(MAX_HOST_RATE), F.greatest(F.lit(ALWAYS_RATE), F.col("m") + DEVIATIONS * F.sqrt("v")))
    prior = prior.select("m", weight.alias("w"), limit.alias("limit"))
    rates = by_host.join(F.broadcast(prior)).withColumn("rate", (F.col("fails") + F.col("m") * F.col("w")) / (F.col("n") + F.col("w")))  # one row
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("w") + 1))
    return rates.select("host", "n", "fails", "rate", (F.col("rate") - TAIL * deviation > F.col("limit")).alias("rejected"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """document_rules() with host_rate, host_rejected and kept: false where a base rule fails or the host is rejected.

    Rows without a host form one host of their own. Repeated rows count each. An empty table gives an empty result.
    Other columns of docs are ignored, whatever their names. A host that very many rows have is dealt to SALTS parts.
    """
    rules = stage(document_rules(docs, id_col, text_col, host), "quality-rules")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt")
    rates = host_rates(rules).select(F.col("host").alias("of_host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"), every)
    salt = F.pmod(F.xxhash64(id_col, "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    out = rules.withColumn("salt", salt).join(rates, F.col("host").eqNullSafe(F.col("of_host")) & (F.col("salt") == F.col("of_salt")), "left").drop("of_host", "of_salt", "salt")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents")).drop("host", "host_rate")


ORACLE = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM
        (SELECT doc_id, i, list_aggregate(ws[i : i + {WINDOW - 1}], 'string_agg', ' ') AS k
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range({WINDOW})) AS p FROM g WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS fails FROM f GROUP BY source),
p AS (SELECT sum(fails) / sum(n) AS m, greatest(avg((fails / n) * (fails / n)) - avg(fails / n) * avg(fails / n), 0) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE 1.0 END AS w, least({MAX_HOST_RATE}, greatest({ALWAYS_RATE}, m + {DEVIATIONS} * sqrt(v))) AS lim FROM p),
y AS (SELECT source, (fails + m * w) / (n + w) AS rate, n + w + 1 AS total, lim FROM h, q),
z AS (SELECT source, rate - {TAIL} * sqrt(rate * (1 - rate) / total) > lim AS rejected FROM y)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected AS host_rejected, NOT base_failed AND NOT rejected AS kept
FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source"""
}
QUERIES = {"op3_quality_rules": op3_quality_rules}
