"""URL rules indexed by their rarest literal token.

Every rule is a pattern over a url's host and path. A rule's tokens are the runs of letters and digits that stand
between two literal marks in it, so that a url which fits holds them as whole tokens. Each rule is filed under the one
token that is rarest over all urls; a url's tokens fetch candidate rules, and only those run regular expressions.
Rules without a token run on every url.

Up to HELD_RULES rules are held by each task. More of them, or a table of rules, are filed by a join: rules meet the
counts of their tokens, and urls meet the rules at the tokens that these are filed under.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import stage, table

# Rules by host and path, the longest that fits decides.
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Where no host rule fits: block what has one of these; * stands for any run of characters.
PATTERNS = (".casino-", ".poker-", ".adult-", "/ads/", "/banner/", "/click/*redirect/", ".track.", "-pills.")
#: So many rules at most are held by every task.
HELD_RULES = 100_000
#: Parts that the urls of one token are dealt to, where rules are joined.
SALTS = 8
RULES = "name string, verdict string, regex string, tokens array<string>, rank int"

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # the largest decides; 0 for patterns


def host_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    literal = f".{host}{slash}{path}"
    return Rule(text, verdict, r"[^/]*" + re.escape(literal), _bounded(literal, open_end=not slash or not path.endswith("/") and bool(path)), len(text))


def pattern_rule(text: str, verdict: str = "block") -> Rule:
    tokens: list[str] = []
    for piece in text.split("*"):
        tokens += _bounded(piece, open_end=True)
    return Rule(text, verdict, ".*" + ".*".join(map(re.escape, text.split("*"))), tuple(tokens), 0)


def _bounded(literal: str, open_end: bool) -> tuple[str, ...]:
    """Tokens of a literal that can't be part of a longer token in the url."""
    literal = literal.translate(_LOWER)
    return tuple(m[0] for m in _TOKEN.finditer(literal) if m.start() > 0 and (m.end() < len(literal) or not open_end))


def default_rules() -> list[Rule]:
    return [host_rule(v, t) for v, t in HOST_RULES] + [pattern_rule(p) for p in PATTERNS]


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z in lower case, and path; both empty without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


class RuleIndex:
    def __init__(self, rules: list[Rule], counts: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple[re.Pattern, Rule]]] = {}
        self.everywhere: list[tuple[re.Pattern, Rule]] = []
        for r in rules:
            filed = (re.compile(r.regex, re.S), r)
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(filed)
            else:
                self.everywhere.append(filed)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The host rule that decides, or None, and the verdict."""
        subject = f".{host}{path}"
        fits = [r for p, r in self.everywhere if p.match(subject)]
        for token in set(_TOKEN.findall(subject.translate(_LOWER))):
            fits += [r for p, r in self.by_token.get(token, ()) if p.match(subject)]
        best = max(fits, key=lambda r: (r.rank, r.verdict == "block", r.name), default=None)
        if best is None:
            return None, "allow"
        return (best.name if best.rank else None), best.verdict


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A table of rules from text files: a line has allow or block, and a host rule like example.org/dir/ or, after a *, a pattern.

    Empty lines and those that begin with # are skipped; lines of another form end the reading with an error.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for line in batch.column(0).to_pylist():
                m = re.fullmatch(r"(allow|block)\s+(\*?)(\S+)", line.strip())
                if not m and line.strip() and not line.startswith("#"):
                    raise ValueError(f"not a rule: {line!r}")
                if m:
                    made.append(pattern_rule(m[3], m[1]) if m[2] else host_rule(m[1], m[3]))
            columns = [[r.name for r in made], [r.verdict for r in made], [r.regex for r in made], [list(r.tokens) for r in made], [r.rank for r in made]]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "verdict", "regex", "tokens", "rank"])

    return spark.read.text(path).mapInArrow(rows, RULES)


def _tokens(subject: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(subject, string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0)))


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[k] for p in parts], pa.string()) for k in (0, 1))], ["id", "host", "path"])


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose subject, the first column, fits the pattern in the last."""
    compiled = lru_cache(10_000)(lambda p: re.compile(p, re.S))
    for batch in batches:
        fits = [bool(compiled(p).match(s)) for s, p in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        yield batch.filter(pa.array(fits, pa.bool_()))


def _judge_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """judge_urls() for (id, url) and a table of rules."""
    parted = stage(urls.mapInArrow(_split_rows, f"id {urls.schema['id'].dataType.simpleString()}, host string, path string"), "url-parts")
    # Each different host and path is judged once.
    subjects = parted.select("host", "path").distinct().select("host", "path", F.concat(F.lit("."), "host", "path").alias("subject"))
    subjects = stage(subjects.select("subject", "host", "path", _tokens("subject").alias("tokens")), "url-subjects")
    rules = stage(rules.select("name", "verdict", "regex", "tokens", "rank").distinct(), "url-rules")
    counts = subjects.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    own = rules.select("*", F.explode("tokens").alias("token"))
    # Rules whose token no url has fit none.
    filed = own.join(counts, "token", "left").groupBy("name", "verdict", "regex", "rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("at")).filter("at.n > 0")
    filed = filed.select(F.col("at.token").alias("token"), "name", "verdict", "rank", "regex", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = subjects.withColumn("salt", F.pmod(F.xxhash64("subject"), F.lit(SALTS)).cast("int"))
    met = salted.select("subject", "host", "path", "salt", F.explode("tokens").alias("token")).join(filed, ["token", "salt"])
    columns = ["subject", "host", "path", "name", "verdict", "rank", "regex"]
    # Those without a token meet every url: their number is what costs here.
    met, loose = met.select(columns), rules.filter(F.size("tokens") == 0).withColumn("of", F.pmod(F.xxhash64("regex"), F.lit(SALTS)).cast("int"))
    if loose.limit(1).count():
        each = subjects.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = met.unionByName(each.drop("tokens").join(loose.drop("tokens"), "of").select(columns))
    kinds = "subject string, host string, path string, name string, verdict string, rank int, regex string"
    best = F.max(F.struct("rank", (F.col("verdict") == "block").alias("block"), "name"))
    found = met.mapInArrow(_fitting, kinds).groupBy("host", "path").agg(best.alias("best"))
    out = parted.join(found, ["host", "path"], "left")
    rule = F.when(F.col("best.rank") > 0, F.col("best.name"))
    return out.select("id", "host", "path", rule.alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule and verdict for each row, by rules or by a table of them as read_rules() gives.

    Null urls and urls without :// have an empty host and path and fit no rule by host. Rows are judged each on their
    own: repeated rows get equal results, null ids stay null. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    rules = default_rules() if rules is None else rules
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    if isinstance(rules, list) and len(rules) > HELD_RULES:
        rules = pages.sparkSession.createDataFrame([(r.name, r.verdict, r.regex, list(r.tokens), r.rank) for r in rules], RULES)
    if isinstance(rules, DataFrame):
        return _judge_by_join(urls, rules).withColumnRenamed("id", id_col)
    wanted = sorted({t for r in rules for t in r.tokens})
    held = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    token = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("url", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))
    seen = urls.select(token.alias("token")).join(F.broadcast(held), "token", "left_semi").groupBy("token").count()  # tokens of HELD_RULES rules at most
    counts = {r["token"]: r["count"] for r in seen.collect()} if wanted else {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, counts)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [index.judge(h, p) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["id", "host", "path", "rule", "verdict"])

    out = urls.mapInArrow(rows, f"id {urls.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _fits(text: str) -> str:
    host, _, path = text.partition("/")
    return f"(('.' || host) LIKE '%.{host}' AND starts_with(path, '/{path}'))"


ORACLE = {
    "op7_url_filter": f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE {" ".join(f"WHEN {_fits(t)} THEN '{t}'" for _, t in sorted(HOST_RULES, key=lambda r: -len(r[1])))} END AS rule FROM c)
SELECT page_id, host, path, rule,
       CASE {" ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in HOST_RULES)}
            WHEN {" OR ".join(f"('.' || host || path) LIKE '%{p.replace('*', '%')}%'" for p in PATTERNS)} THEN 'block' ELSE 'allow' END AS verdict
FROM d"""
}
QUERIES = {"op7_url_filter": op7_url_filter}
