"""Registered queries of the analysis operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import paths
from revlens.functions.numeric import with_percentile
from revlens.operators import coupling as cp
from revlens.operators import diff as df
from revlens.operators import findings as fd
from revlens.operators import hotspots as hs
from revlens.operators import overview as ov
from revlens.operators import social as so
from revlens.operators import trends as tr
from revlens.plans.model import Scope, author_rollup
from revlens.sources.tables import model_of, part_files, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BASE = r"""
WITH nc AS (SELECT count(*) AS n FROM customer),
bots AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'),
fl AS (SELECT 'part-' || p_partkey AS file, p_type || '/' || p_name AS entity, p_type || '/' || p_brand AS unit, p_type AS repo, p_size % 10 <> 0 AS alive, p_partkey % 7 = 0 AS test,
              ['typescript', 'php', 'template', 'scss', 'data'][p_partkey % 5 + 1] AS lang, [1.0, 1.0, 0.8, 0.5, 0.3][p_partkey % 5 + 1]::DOUBLE AS lw,
              (p_size * 20)::BIGINT AS loc, (floor(p_retailprice)::BIGINT % 97)::DOUBLE AS complexity, (1 + p_size % 10)::DOUBLE AS health FROM part),
raw AS (SELECT l_orderkey || ':' || p_type AS commit_id, 'part-' || l_partkey AS file, l_orderkey, l_quantity::BIGINT AS added, l_linenumber::BIGINT AS deleted
        FROM lineitem JOIN part ON l_partkey = p_partkey),
cnt AS (SELECT commit_id, l_orderkey, count(*) AS n_changes FROM raw GROUP BY ALL),
c0 AS (SELECT commit_id, split_part(commit_id, ':', 2) AS repo, n_changes, o_custkey AS author, 'ORD-' || o_orderkey AS ticket, floor(epoch(o_orderdate))::BIGINT AS ts,
              CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % n END AS co,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'fix: urgent order' WHEN '2-HIGH' THEN 'bugfix for order' WHEN '5-LOW' THEN 'chore: release 1.2.3' ELSE 'feat: order' END AS subject
       FROM cnt JOIN orders ON l_orderkey = o_orderkey, nc WHERE o_custkey NOT IN (SELECT c_custkey FROM bots)),
c1 AS (SELECT * EXCLUDE (co), CASE WHEN co NOT IN (SELECT c_custkey FROM bots) THEN co END AS co, regexp_matches(subject, '\b(fix|bugfix)\b') AS defect, starts_with(subject, 'chore: release') AS format, n_changes > 4 AS mega FROM c0),
ctx AS (SELECT max(ts) AS now FROM c1),
c AS (SELECT *, CASE WHEN format THEN 0.0 WHEN mega THEN 0.25 ELSE 1.0 END::DOUBLE AS weight, NOT mega AND NOT format AS couples, CASE WHEN co IS NULL THEN [author] ELSE [author, co] END AS authors FROM c1, ctx),
ch AS (SELECT raw.commit_id, raw.added, raw.deleted, fl.*, c.ts, c.author, c.subject, c.ticket, c.defect, c.format, c.mega, c.weight, c.couples, c.authors, c.now
       FROM raw JOIN c USING (commit_id) JOIN fl USING (file)),
au AS (SELECT author, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT unnest(authors) AS author, ts FROM c) GROUP BY author),
ac AS (SELECT au.*, c_nationkey::VARCHAR AS team, now - last_ts <= 180 * 86400 AS active FROM au JOIN customer ON author = c_custkey, ctx),
nf AS (SELECT *, (CASE WHEN count(*) OVER (PARTITION BY lang) < 5 THEN least(complexity / 50, 1.0) WHEN count(*) OVER (PARTITION BY lang) = 1 THEN 1.0
                  ELSE (rank() OVER (PARTITION BY lang ORDER BY complexity) - 1 + (count(*) OVER (PARTITION BY lang, complexity) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY lang) - 1) END) * lw AS norm_cx FROM fl WHERE alive)"""


def hotspot_ctes(level: str, days: int | None = None, tag: str = "", where: str | None = None) -> str:
    """where: the files in scope, as SQL; files and entities with one such file keep the size of all their files."""
    when = (f"AND ts >= now - {days} * 86400 " if days else "") + (f"AND {where}" if where else "")
    sized = f"nf WHERE {level} IN (SELECT {level} FROM nf WHERE {where})" if where else "nf"
    norm = "CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (rank() OVER (ORDER BY wr) - 1 + (count(*) OVER (PARTITION BY wr) - 1) / 2.0::DOUBLE) / (count(*) OVER () - 1) END" if level in ("unit", "repo") else "max_norm"
    return f""",
hp{tag} AS (SELECT {level} AS name, commit_id, max(weight * exp(-(greatest((now - ts) / 86400.0::DOUBLE, 0.0) / 180.0::DOUBLE) * 0.6931471805599453::DOUBLE)) AS w, max(defect) AS defect, max(ts) AS ts, sum(added + deleted) AS churn
       FROM ch WHERE true {when} GROUP BY 1, 2),
hh{tag} AS (SELECT name, count(*) AS revisions, sum(w) AS rev_w, sum(defect::INT) AS defects, max(ts) AS last_ts, sum(churn) AS churn FROM hp{tag} GROUP BY 1),
hl{tag} AS (SELECT name, author, sum(l) AS lines FROM (SELECT {level} AS name, unnest(authors) AS author, (added + 1) / len(authors)::DOUBLE AS l FROM ch WHERE true {when}) GROUP BY 1, 2),
ha{tag} AS (SELECT name, count(*) AS authors, sum(active::INT) AS active_authors, arg_max(author, (round(lines, 6), -author)) AS main_dev, round(max(lines) / sum(lines), 4) AS main_share FROM hl{tag} LEFT JOIN ac USING (author) GROUP BY 1),
hz{tag} AS (SELECT {level} AS name, sum(loc) AS loc, sum(complexity) AS complexity, count(*) AS files, min(health) AS health, bool_and(test) AS test, bool_or(lw >= 0.5) AS code, max(norm_cx) AS max_norm, round(sum(complexity * lw), 6) AS wr
       FROM (SELECT *, bool_or(NOT test) OVER (PARTITION BY {level}) AS sm FROM {sized}) WHERE NOT sm OR NOT test GROUP BY 1),
hj{tag} AS (SELECT name, hz{tag}.* EXCLUDE (name), coalesce(revisions, 0) AS revisions, coalesce(rev_w, 0) AS rev_w, coalesce(defects, 0) AS defects, coalesce(churn, 0) AS churn, last_ts, coalesce(authors, 0) AS authors, coalesce(active_authors, 0) AS active_authors, main_dev, main_share,
              {norm} * CASE WHEN test THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS norm FROM hz{tag} LEFT JOIN hh{tag} USING (name) LEFT JOIN ha{tag} USING (name)),
ht{tag} AS (SELECT CASE WHEN coalesce(max(rev_w) FILTER (code AND NOT test), 0) > 0 THEN max(rev_w) FILTER (code AND NOT test) ELSE max(rev_w) END AS m FROM hj{tag}),
hk{tag} AS (SELECT *, CASE WHEN revisions = 0 THEN 0.0 ELSE round(CASE WHEN m > 0 THEN least(ln(1 + rev_w) / ln(1 + m), 1.0) ELSE 0.0 END * norm, 3) END AS score FROM hj{tag}, ht{tag}),
hot{tag} AS (SELECT row_number() OVER (ORDER BY score DESC, round(rev_w, 4) DESC, name) AS rank, name, score, round(norm, 4) AS norm, revisions::BIGINT AS revisions, round(rev_w, 4) AS rev_w, churn::BIGINT AS churn, defects::BIGINT AS defects,
        round(CASE WHEN revisions > 0 THEN defects / revisions::DOUBLE ELSE 0.0 END, 4) AS defect_density, floor((now - last_ts) / 86400.0)::BIGINT AS age_days, loc::BIGINT AS loc, complexity, health, files, test, code, authors::BIGINT AS authors, active_authors::BIGINT AS active_authors, main_dev, main_share FROM hk{tag}, ctx)"""


def ownership_ctes(level: str, tag: str = "") -> str:
    return f""",
kn{tag} AS (SELECT name, author, sum(l) AS lines FROM (SELECT {level} AS name, unnest(authors) AS author, (added + 1) / len(authors)::DOUBLE AS l FROM ch WHERE alive AND NOT format) GROUP BY 1, 2),
ks{tag} AS (SELECT kn{tag}.*, active, round(lines / sum(lines) OVER (PARTITION BY name), 9) AS share FROM kn{tag} JOIN ac USING (author)),
kb{tag} AS (SELECT *, round(coalesce(sum(share) OVER (PARTITION BY name ORDER BY share DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS before FROM ks{tag}),
ra{tag} AS (SELECT name, count(DISTINCT author) AS recent_authors FROM (SELECT {level} AS name, unnest(authors) AS author FROM ch WHERE alive AND ts >= now - 365 * 86400) GROUP BY 1),
own{tag} AS (SELECT name, arg_max(author, (share, -author)) AS main_dev, round(max(share), 3) AS main_share, round(1 - sum(share * share), 3) AS fragmentation, round(sum(CASE WHEN active THEN 0.0 ELSE share END), 3) AS knowledge_loss,
        count(*) FILTER (before <= 0.5) AS bus_factor, count(*) AS authors, coalesce(any_value(recent_authors), 0) AS recent_authors FROM kb{tag} LEFT JOIN ra{tag} USING (name) GROUP BY 1)"""


def coupling_ctes(level: str, by: str = "commit", tag: str = "", support: int = 5, conf: float = 0.05, lift: float = 1.5, every: bool = False) -> str:
    """every: also pairs with tests, of configuration, and of files of one entity."""
    small = level in ("file", "entity")
    hidden = "" if every else "AND NOT ka.test AND NOT kb.test AND NOT ka.config AND NOT kb.config AND NOT same_entity "
    stem = lambda k: rf"regexp_replace(regexp_replace(string_split({k}, '/')[-1], '(.)\.[^.]*$', '\1'), '{paths.TEST_SUFFIX}', '')"
    sets = (
        f"SELECT commit_id AS set_id, {level} AS key, max(ts) AS ts FROM ch WHERE couples GROUP BY 1, 2"
        if by == "commit"
        else f"SELECT set_id, {level} AS key, max(sts) AS ts FROM cs JOIN ch ON ch.commit_id = cs.id WHERE couples GROUP BY 1, 2"
        if by == "session"
        else f"SELECT ticket AS set_id, {level} AS key, max(sts) AS ts FROM (SELECT *, count(*) OVER (PARTITION BY ticket) AS n, max(ts) OVER (PARTITION BY ticket) AS sts FROM ch WHERE couples) WHERE n <= 8 GROUP BY 1, 2"
    )
    return f""",
st{tag} AS ({sets}),
mg{tag} AS (SELECT key, count(*) AS n FROM st{tag} GROUP BY 1),
pr{tag} AS (SELECT x.key AS a, y.key AS b, count(*) AS support, sum((x.ts >= now - 180 * 86400)::INT) AS recent FROM st{tag} x JOIN st{tag} y ON x.set_id = y.set_id AND x.key < y.key, ctx GROUP BY 1, 2),
pm{tag} AS (SELECT pr{tag}.*, ma.n AS n_a, mb.n AS n_b, support / ma.n::DOUBLE AS conf_ab, support / mb.n::DOUBLE AS conf_ba, support * (SELECT count(DISTINCT set_id) FROM st{tag}) / (ma.n * mb.n)::DOUBLE AS lift, support / (ma.n + mb.n - support)::DOUBLE AS jaccard
       FROM pr{tag} JOIN mg{tag} ma ON a = ma.key JOIN mg{tag} mb ON b = mb.key WHERE support >= {support}),
ky{tag} AS (SELECT {level} AS key, max(repo) AS repo, {"NULL" if level == "repo" else "arg_min(unit, (test, file))"} AS unit, min(entity) AS entity, bool_or(alive) AS alive, {"bool_and(test)" if small else "false"} AS test, {"bool_and(lang = 'data')" if small else "false"} AS config FROM fl GROUP BY 1),
cpl{tag} AS (SELECT a, b, support, recent::BIGINT AS recent, n_a, n_b, round(conf_ab, 3) AS conf_ab, round(conf_ba, 3) AS conf_ba, round(lift, 3) AS lift, round(jaccard, 3) AS jaccard,
        ka.repo <> kb.repo OR ka.unit IS DISTINCT FROM kb.unit AS cross_unit, ka.repo <> kb.repo AS cross_repo, {"ka.entity = kb.entity" if level == "file" else "false"} AS same_entity, ka.test <> kb.test AND {stem("a")} = {stem("b")} AS test_pair, ka.test OR kb.test AS involves_test, ka.config OR kb.config AS involves_config, round(greatest(conf_ab, conf_ba) * (1 - 1 / sqrt(support)), 6) AS strength
        FROM pm{tag} JOIN ky{tag} ka ON a = ka.key JOIN ky{tag} kb ON b = kb.key WHERE ka.alive AND kb.alive {hidden}AND greatest(conf_ab, conf_ba) >= {conf} AND lift >= {lift})"""


def expert_ctes(touched: str, authors: str = "SELECT NULL AS change, NULL AS author WHERE false") -> str:
    """ex: change, place, author, name, score, touches, last_ts for touched as SQL for (change, file), but for authors(change, author)."""
    return f""",
et AS ({touched}),
ep AS (SELECT change, commit_id, count(DISTINCT file) AS k, sum(added + 1) AS lines, max(ts) AS ts, any_value(authors) AS authors FROM ch JOIN et USING (file) GROUP BY 1, 2),
ev AS (SELECT change, unnest(authors) AS author, k * exp(-(greatest((now - ts) / 86400.0::DOUBLE, 0.0) / 360.0::DOUBLE) * 0.6931471805599453::DOUBLE) * ln(1 + lines) AS v, k, ts FROM ep, ctx),
eg AS (SELECT change, author, sum(v) AS v, sum(k)::BIGINT AS touches, max(ts) AS last_ts FROM ev WHERE author IN (SELECT author FROM ac WHERE active) GROUP BY 1, 2),
es AS (SELECT change, author, c_name AS name, round(v / sum(v) OVER (PARTITION BY change), 3) AS score, touches, last_ts FROM eg JOIN customer ON author = c_custkey),
ex AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY score DESC, name) AS place FROM es WHERE NOT EXISTS (SELECT 1 FROM ({authors}) o WHERE o.change = es.change AND o.author = es.author))"""


_BRAND_FILES = "SELECT 0 AS change, file FROM fl WHERE unit LIKE '%Brand#11'"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


for _level in ("file", "entity", "unit", "repo"):
    query(f"hotspots_{_level}", f"{BASE}{hotspot_ctes(_level)} SELECT * FROM hot")(lambda s, d, level=_level: hs.hotspots(model_of(s, d), level))
query("hotspots_scoped_days", f"{BASE}{hotspot_ctes('entity', 365)} SELECT * FROM hot")(lambda s, d: hs.hotspots(model_of(s, d), "entity", Scope(days=365)))
query("hotspot_concentration", f"{BASE}{hotspot_ctes('entity')} SELECT round(sum(rev_w) FILTER (k <= ceil(n * 0.05)) / sum(rev_w), 3) AS concentration, count(*) AS keys FROM (SELECT rev_w, row_number() OVER (ORDER BY rev_w DESC, name) AS k, count(*) OVER () AS n FROM hot)")(lambda s, d: hs.hotspot_concentration(model_of(s, d)))
query("commit_classification", f"{BASE} SELECT commit_id, subject, defect, format, mega, weight, couples, len(authors)::INT AS n_authors FROM c")(
    lambda s, d: model_of(s, d).commits.select("commit_id", "subject", "defect", "format", "mega", "weight", "couples", F.size("authors").alias("n_authors"))
)
query("ticket_extraction", f"{BASE} SELECT ticket, count(*) AS commits FROM c GROUP BY 1")(lambda s, d: model_of(s, d).commits.select(F.explode("tickets").alias("ticket")).groupBy("ticket").agg(F.count("*").alias("commits")))
query("author_rollup", f"{BASE} SELECT author, commits, first_ts, last_ts FROM au")(lambda s, d: author_rollup(model_of(s, d)))
query("active_authors", f"{BASE} SELECT author, team, active FROM ac")(lambda s, d: model_of(s, d).active().select("author", "team", "active"))
query("lang_percentile", f"{BASE} SELECT file, lang, norm_cx FROM nf")(lambda s, d: hs.normalized_files(model_of(s, d)).select("file", "lang", "norm_cx"))
for _by in ("commit", "ticket"):
    for _level in ("unit", "entity"):
        query(f"coupling_{_by}_{_level}", f"{BASE}{coupling_ctes(_level, _by)} SELECT * FROM cpl")(lambda s, d, level=_level, by=_by: cp.coupling(model_of(s, d), level, by))
query("coupling_cross_repo", f"{BASE}{coupling_ctes('unit', 'ticket')} SELECT * FROM cpl WHERE cross_repo")(lambda s, d: cp.coupling(model_of(s, d), "unit", "ticket", cross_repo=True))
query("coupling_focus", f"{BASE}{coupling_ctes('unit', 'ticket')} SELECT * FROM cpl WHERE contains(a, 'Brand#1') OR contains(b, 'Brand#1')")(lambda s, d: cp.coupling(model_of(s, d), "unit", "ticket", focus="Brand#1"))
query("sum_of_coupling", f"{BASE} SELECT key AS name, sum(o)::BIGINT AS soc FROM (SELECT entity AS key, count(*) OVER (PARTITION BY commit_id) - 1 AS o FROM (SELECT DISTINCT commit_id, entity FROM ch WHERE couples)) GROUP BY 1")(lambda s, d: cp.sum_of_coupling(model_of(s, d)))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.unix_timestamp("ts").alias("ts"), F.col("event_id").alias("id"), F.col("event_type").alias("repo"))


_SESSIONS = """
WITH RECURSIVE e AS (SELECT user_id AS author, floor(epoch(ts))::BIGINT AS ts, event_id AS id, event_type AS repo, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS k FROM events),
s AS (SELECT author, ts, id, repo, k, ts AS anchor FROM e WHERE k = 1 UNION ALL SELECT e.author, e.ts, e.id, e.repo, e.k, CASE WHEN e.ts - s.anchor > 14400 THEN e.ts ELSE s.anchor END FROM s JOIN e ON e.author = s.author AND e.k = s.k + 1)"""
query("anchored_sessions", f"{_SESSIONS} SELECT author, id, ts, anchor FROM s")(lambda s, d: cp.anchored_sessions(_events(s, d).drop("repo"), 14_400).select("author", "id", "ts", "anchor"))
query(
    "session_change_sets",
    f"{_SESSIONS}, g AS (SELECT *, count(*) OVER (PARTITION BY author, anchor) AS n FROM s), r AS (SELECT author, anchor, count(DISTINCT repo) AS repos FROM s GROUP BY 1, 2) SELECT DISTINCT CASE WHEN repos > 1 AND n <= 120 THEN author || ':' || anchor ELSE 'one:' || id END AS set_id, repo AS key FROM g JOIN r USING (author, anchor)",
)(lambda s, d: cp.session_sets(_events(s, d), 14_400, 120))
query(
    "unit_graph_edges",
    f"{BASE}{coupling_ctes('unit', 'commit', '1', 3, 0.05, 1.0)}{coupling_ctes('unit', 'ticket', '2', 3, 0.05, 1.0)}, e1 AS (SELECT a, b, support, conf_ab, conf_ba, lift, cross_repo, strength FROM cpl1 ORDER BY strength DESC, support DESC, a, b LIMIT 400), e2 AS (SELECT a, b, support, conf_ab, conf_ba, lift, cross_repo, strength FROM cpl2 WHERE cross_repo ORDER BY strength DESC, support DESC, a, b LIMIT 400) "
    "SELECT *, 'commit' AS kind FROM e1 UNION ALL SELECT *, 'ticket' FROM e2 WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.a = e2.a AND e1.b = e2.b)",
)(lambda s, d: cp.unit_graph(model_of(s, d)))


def _missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir)
    return cp.missed_changes(m, m.files.filter(F.col("unit").endswith("Brand#11")).select(F.col("unit").alias("key")).distinct(), "unit")


def missed_ctes(touched: str) -> str:
    """ms: change, source, target, confidence, support, kind of units, for touched as SQL for (change, key)."""
    return f"""{coupling_ctes("unit", "commit", "m1", lift=1.0)}{coupling_ctes("unit", "ticket", "m2", lift=1.0)},
mb AS (SELECT *, 'commit' AS how FROM cplm1 UNION ALL SELECT *, 'ticket' FROM cplm2),
md AS (SELECT a AS source, b AS target, conf_ab AS confidence, support, cross_repo, how FROM mb UNION ALL SELECT b, a, conf_ba, support, cross_repo, how FROM mb),
mt AS ({touched}),
mx AS (SELECT change, source, target, confidence, support, CASE WHEN cross_repo THEN 'cross-repo' ELSE 'coupled' END AS kind, row_number() OVER (PARTITION BY change, target ORDER BY confidence DESC, support DESC, source, how) AS k
       FROM md JOIN mt ON source = key WHERE confidence >= 0.05 AND support >= 5 AND NOT EXISTS (SELECT 1 FROM mt o WHERE o.change = mt.change AND o.key = target)),
ms AS (SELECT * EXCLUDE (k) FROM (SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY change ORDER BY confidence DESC, support DESC, target) AS k FROM mx WHERE k = 1) WHERE k <= 15)"""


_TOUCHED = "SELECT DISTINCT 0 AS change, unit AS key FROM fl WHERE unit LIKE '%Brand#11'"
query("missed_changes", f"{BASE}{missed_ctes(_TOUCHED)} SELECT source, target, confidence, support, kind FROM ms")(_missed)
query(
    "partners_of_unit",
    f"{BASE}{coupling_ctes('unit', 'commit', '1', lift=1.0)}{coupling_ctes('unit', 'ticket', '2', lift=1.0)}, bo AS (SELECT *, 'commit' AS how FROM cpl1 UNION ALL SELECT *, 'ticket' FROM cpl2 WHERE cross_repo), k0 AS (SELECT min(unit) AS k FROM fl), "
    "dr AS (SELECT b AS name, support, conf_ab AS confidence, lift, how AS \"by\", cross_repo, cross_unit, false AS expected FROM bo, k0 WHERE a = k UNION ALL SELECT a, support, conf_ba, lift, how, cross_repo, cross_unit, false FROM bo, k0 WHERE b = k) "
    "SELECT * FROM dr ORDER BY confidence DESC, support DESC, name, \"by\" LIMIT 25",
)(lambda s, d: cp.partners(model_of(s, d), level="unit"))
query("key_flags", f"{BASE} SELECT entity AS key, max(repo) AS repo, bool_or(alive) AS alive, bool_and(test) AS test, bool_and(lang = 'data') AS config FROM fl GROUP BY 1")(lambda s, d: cp.keys_of(model_of(s, d), "entity").select("key", "repo", "alive", "test", "config"))
for _level in ("entity", "unit"):
    query(f"ownership_{_level}", f"{BASE}{ownership_ctes(_level)} SELECT * FROM own")(lambda s, d, level=_level: so.ownership(model_of(s, d), level))
query("bus_factor", f"{BASE}{ownership_ctes('repo')} SELECT name, bus_factor, authors FROM own")(lambda s, d: so.ownership(model_of(s, d), "repo").select("name", "bus_factor", "authors"))
query("team_shares", f"{BASE}{ownership_ctes('unit')}, ts AS (SELECT name, c_nationkey::VARCHAR AS team, sum(lines) AS l FROM kn JOIN customer ON author = c_custkey GROUP BY 1, 2) SELECT name, team, round(l / sum(l) OVER (PARTITION BY name), 4) AS share FROM ts")(lambda s, d: so.team_shares(model_of(s, d)))
query(
    "experts",
    f"{BASE}{expert_ctes(_BRAND_FILES)} SELECT author, name, score, touches, last_ts FROM ex",
)(lambda s, d: (lambda m: so.experts(m, m.files.filter(F.col("unit").endswith("Brand#11"))))(model_of(s, d)))
query("recent_authors", f"{BASE}{ownership_ctes('entity')} SELECT name AS entity, recent_authors FROM ra")(lambda s, d: so.recent_authors(model_of(s, d), "entity"))
query("repo_defect_baseline", f"{BASE} SELECT repo, round(avg(defect::INT), 4) AS baseline, count(*) AS commits FROM c WHERE NOT format GROUP BY 1")(lambda s, d: so.defect_baseline(model_of(s, d)))


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    j = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = j.select(F.col("l_partkey").alias("file"), F.unix_timestamp("o_orderdate").alias("ts"), ((F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 1000 + F.floor(F.col("l_extendedprice") / 1000)).alias("seq"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("complexity"))
    return p, p.agg(F.max("ts").alias("now"))


_POINTS = "WITH p AS (SELECT l_partkey AS file, floor(epoch(o_orderdate))::BIGINT AS ts, (l_orderkey * 16 + l_linenumber) * 1000 + floor(l_extendedprice / 1000)::BIGINT AS seq, floor(l_extendedprice / 1000)::DOUBLE AS complexity FROM lineitem JOIN orders ON l_orderkey = o_orderkey), ctx AS (SELECT max(ts) AS now FROM p)"
query(
    "trend_classify",
    f"{_POINTS}, e AS (SELECT file, count(*) AS n, arg_max(complexity, (ts, seq)) AS last, coalesce(max((ts, seq)) FILTER (ts <= now - 365 * 86400), min((ts, seq))) AS at_ FROM p, ctx GROUP BY 1), "
    "b AS (SELECT p.*, lag(complexity) OVER w AS pc, lag(ts) OVER w AS pt FROM p WINDOW w AS (PARTITION BY file ORDER BY ts, seq)), "
    "g AS (SELECT b.file, max(complexity) FILTER ((ts, seq) = at_) AS base, max(last) AS last, bool_or(coalesce(pt >= at_[1] AND complexity < pc * 0.8::DOUBLE, false)) AS refactored, count(*) AS points FROM b JOIN e USING (file) WHERE n >= 3 AND ts >= at_[1] GROUP BY 1), "
    "h AS (SELECT *, last - base AS delta, (last - base) / greatest(base, 10.0) AS chg FROM g) "
    "SELECT file, CASE WHEN chg > 0.25 AND delta >= 5 THEN 'deteriorating' WHEN chg < -0.15 THEN 'improving' ELSE 'stable' END AS direction, round(chg, 3) AS change, refactored, points FROM h",
)(lambda s, d: tr.classify(*_series(s, d)))
query(
    "trend_sampling",
    f"{_POINTS}, a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY file) AS len FROM p), r AS (SELECT file, ts, seq, row_number() OVER (PARTITION BY file ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY file) AS len FROM a, ctx WHERE len >= 2 AND ts >= now - 365 * 86400) "
    "SELECT file, ts, seq FROM a WHERE len >= 2 AND (len <= 12 OR list_contains(list_transform(range(12), lambda k: (k * (len - 1)) // 11), i)) UNION SELECT file, ts, seq FROM r WHERE len <= 7 OR list_contains(list_transform(range(7), lambda k: (k * (len - 1)) // 6), i) "
    "UNION SELECT file, arg_max(ts, (ts, seq)), arg_max(seq, (ts, seq)) FROM a, ctx WHERE len >= 2 AND ts < now - 365 * 86400 GROUP BY file",
)(lambda s, d: tr.sample(_series(s, d)[0].select("file", "ts", "seq"), _series(s, d)[1]))


def _function_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of an entity stand for its files: a file's lines fall into ten functions by its size."""
    return model_of(spark, sf_dir).changes.select(F.col("unit").alias("file"), F.col("entity").alias("fn"), "commit_id", "ts", "now", "added", "deleted", "defect", "weight", "complexity", "authors", "n_changes")


_FN = f"{BASE}, fx AS (SELECT unit AS file, entity AS fn, * EXCLUDE (file, unit, entity) FROM ch)"
query(
    "xray_functions",
    f"{_FN}, pp AS (SELECT file, fn, commit_id, max(weight * exp(-(greatest((now - ts) / 86400.0::DOUBLE, 0.0) / 180.0::DOUBLE) * 0.6931471805599453::DOUBLE)) AS w, sum(added + deleted) AS churn, max(defect) AS defect, max(ts) AS ts FROM fx GROUP BY 1, 2, 3), pa AS (SELECT file, fn, count(DISTINCT author) AS authors FROM (SELECT file, fn, unnest(authors) AS author FROM fx) GROUP BY 1, 2), "
    "gg AS (SELECT file, fn, count(*) AS revisions, sum(w) AS rev_w, sum(churn)::BIGINT AS churn, sum(defect::INT)::BIGINT AS defects, max(ts) AS last_ts FROM pp GROUP BY 1, 2), ff AS (SELECT file, fn, max(complexity) % 30 AS cc FROM fx GROUP BY 1, 2), "
    "mm AS (SELECT *, max(rev_w) OVER (PARTITION BY file) AS m FROM gg JOIN ff USING (file, fn) JOIN pa USING (file, fn)) SELECT file, fn, revisions, round(rev_w, 4) AS rev_w, churn, defects, authors, last_ts, cc, round(CASE WHEN m > 0 THEN ln(1 + rev_w) / ln(1 + m) ELSE 0.0 END * (0.4::DOUBLE + 0.6::DOUBLE * least(cc / 15, 1.0)), 3) AS score FROM mm",
)(lambda s, d: (lambda c: tr.function_hotspots(c, c.groupBy("file", "fn").agg((F.max("complexity") % 30).alias("cc"))))(_function_changes(s, d)))
query(
    "function_coupling",
    f"{_FN}, ss AS (SELECT DISTINCT repo AS file, entity AS fn, ticket AS commit_id FROM ch), nn AS (SELECT file, fn, count(*) AS n FROM ss GROUP BY 1, 2), pq AS (SELECT x.file, x.fn AS a, y.fn AS b, count(*) AS support FROM ss x JOIN ss y ON x.file = y.file AND x.commit_id = y.commit_id AND x.fn < y.fn GROUP BY 1, 2, 3), "
    "rr AS (SELECT pq.*, round(support / least(p.n, q.n)::DOUBLE, 3) AS confidence FROM pq JOIN nn p ON pq.file = p.file AND a = p.fn JOIN nn q ON pq.file = q.file AND b = q.fn WHERE support >= 3), "
    "oo AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY support DESC, confidence DESC, a, b) AS k FROM rr WHERE confidence >= 0.02) SELECT file, a, b, support, confidence FROM oo WHERE k <= 20",
)(lambda s, d: tr.function_coupling(model_of(s, d).changes.select(F.col("repo").alias("file"), F.col("entity").alias("fn"), F.explode("tickets").alias("commit_id")), min_confidence=0.02))


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("line")).distinct()
    size = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("long").alias("size"))
    ranges = size.select("key", F.explode(F.array(F.struct(F.lit("outer").alias("fn"), F.lit(1).cast("long").alias("start"), F.col("size").alias("end")), F.struct(F.lit("inner").alias("fn"), F.floor(F.col("size") / 3).alias("start"), F.floor(F.col("size") / 2).alias("end")))).alias("r")).select("key", "r.*")
    return tr.innermost(lines, ranges)


query(
    "innermost_range_join",
    "WITH l AS (SELECT DISTINCT l_partkey AS key, l_quantity::BIGINT AS line FROM lineitem), r AS (SELECT p_partkey AS key, 'outer' AS fn, 1 AS s, p_size AS e FROM part UNION ALL SELECT p_partkey, 'inner', p_size // 3, p_size // 2 FROM part) "
    "SELECT l.key, line, coalesce(arg_min(fn, (e - s, fn)), '(top level)') AS fn FROM l LEFT JOIN r ON l.key = r.key AND line BETWEEN s AND e GROUP BY 1, 2",
)(_ranges)
query(
    "overview",
    f"{BASE}{ownership_ctes('repo')}{ownership_ctes('unit', 'u')}{hotspot_ctes('unit', tag='u')}{coupling_ctes('entity', 'commit', '1')}{coupling_ctes('entity', 'ticket', '2')} SELECT (SELECT count(*) FROM c) AS commits, (SELECT min(ts) FROM c) AS first_ts, (SELECT max(ts) FROM c) AS last_ts, (SELECT count(DISTINCT ticket) FROM c) AS tickets, (SELECT count(*) FROM ac) AS authors, (SELECT sum(active::INT)::BIGINT FROM ac) AS active_authors, "
    "(SELECT count(*) FROM fl WHERE alive) AS files, (SELECT count(DISTINCT entity) FROM fl WHERE alive) AS entities, (SELECT count(DISTINCT unit) FROM fl WHERE alive) AS units, (SELECT sum(loc)::BIGINT FROM fl WHERE alive) AS loc, (SELECT round(avg(knowledge_loss), 3) FROM own) AS knowledge_loss, "
    "(SELECT count(*) FROM ownu JOIN hzu USING (name) WHERE bus_factor = 1 AND loc >= 1000 AND recent_authors > 0) AS bus_factor_one_units, (SELECT count(*) FROM cpl1 WHERE cross_unit AND greatest(conf_ab, conf_ba) >= 0.05) AS cross_unit_pairs, "
    "(SELECT count(*) FROM cpl2 WHERE cross_repo AND greatest(conf_ab, conf_ba) >= 0.05) AS cross_repo_pairs",
)(lambda s, d: ov.overview(model_of(s, d)))
query("hotspot_tree_leaves", f"{BASE}{hotspot_ctes('entity')}, en AS (SELECT entity AS name, min(repo) AS repo, arg_min(unit, (test, file)) AS unit FROM fl WHERE alive GROUP BY 1) SELECT repo, unit, name AS entity, loc, score, health FROM hot JOIN en USING (name) WHERE loc > 0")(lambda s, d: ov.tree_leaves(model_of(s, d)))
query("size_rollup", f"{BASE}{hotspot_ctes('entity', tag='e')}{hotspot_ctes('unit', tag='u')}{hotspot_ctes('repo', tag='r')} SELECT 'entity' AS level, name, loc::BIGINT AS loc, files FROM hze UNION ALL SELECT 'unit', name, loc::BIGINT, files FROM hzu UNION ALL SELECT 'repo', name, loc::BIGINT, files FROM hzr")(lambda s, d: ov.size_rollup(model_of(s, d)))
query("ticket_diff_files", f"{BASE}, wd AS (SELECT ticket FROM ch GROUP BY 1 HAVING count(DISTINCT repo) > 3) SELECT ticket, file, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM ch JOIN wd USING (ticket) GROUP BY 1, 2")(lambda s, d: ov.ticket_files(model_of(s, d)))
query(
    "commit_timeline",
    f"{BASE} SELECT commit_id, max(ts) AS ts, max(author) AS author, max(subject) AS subject, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted FROM ch WHERE entity = (SELECT min(entity) FROM fl) GROUP BY 1 ORDER BY ts DESC, commit_id LIMIT 30",
)(lambda s, d: ov.commit_timeline(model_of(s, d), "entity"))
query(
    "ticket_rollup",
    f"{BASE}, pe AS (SELECT ticket, count(DISTINCT author) AS authors FROM (SELECT ticket, unnest(authors) AS author FROM ch) GROUP BY 1) SELECT ticket, count(DISTINCT commit_id) AS commits, count(DISTINCT file) AS files, count(DISTINCT repo) AS repos, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, max(ts) AS last_ts, any_value(authors_) AS authors "
    "FROM ch JOIN (SELECT ticket, authors AS authors_ FROM pe) USING (ticket) GROUP BY 1",
)(lambda s, d: ov.ticket_rollup(model_of(s, d)))
query("owners_by_loc", f"{BASE}{hotspot_ctes('entity')}{ownership_ctes('entity')} SELECT own.main_dev AS author, count(*) AS keys, sum(loc)::BIGINT AS loc FROM own JOIN hz USING (name) GROUP BY 1")(lambda s, d: ov.owners_by_loc(model_of(s, d)))
query(
    "reviewers",
    f"{BASE}{expert_ctes('SELECT DISTINCT ticket AS change, file FROM ch', 'SELECT DISTINCT ticket AS change, unnest(authors) AS author FROM c')} SELECT change, place, author AS reviewer, name, score FROM ex WHERE place <= 5",
)(lambda s, d: df.ticket_reviewers(model_of(s, d)))


def risk_ctes(touched: str, people: str, worse: str = "SELECT NULL AS change, 0 AS rise, false AS drops WHERE false") -> str:
    """rs: change, risk, missed for touched(change, file, n), people(change, author) and worse(change, rise, drops), each as SQL; units are missed."""
    return f"""{hotspot_ctes("file")}{ownership_ctes("file")},
tf AS (SELECT t.change, t.file, sum(n) AS n, any_value(unit) AS unit, bool_or(alive) AS alive FROM ({touched}) t LEFT JOIN fl USING (file) GROUP BY 1, 2){missed_ctes("SELECT DISTINCT change, unit AS key FROM tf WHERE unit IS NOT NULL")},
wa AS ({people}),
wo AS ({worse}),
kp AS (SELECT name, author, lines / sum(lines) OVER (PARTITION BY name) AS part FROM kn),
kc AS (SELECT change, round(max(p), 6) AS known FROM (SELECT tf.change, tf.file, sum(part) AS p FROM tf JOIN wa USING (change) JOIN kp ON kp.name = tf.file AND kp.author = wa.author WHERE alive GROUP BY 1, 2) GROUP BY 1),
rg AS (SELECT change, coalesce(max(score), 0) AS worst, count(*) FILTER (score >= 0.5) AS hot_, sum(n) AS n, max(coalesce(revisions, 0)) AS busiest FROM tf LEFT JOIN hot ON hot.name = tf.file GROUP BY 1),
mn AS (SELECT change, count(*) AS missed FROM ms GROUP BY 1),
rs AS (SELECT change, coalesce(missed, 0) AS missed, round(least(100.0, 40 * worst + least(5 * hot_, 15) + least(7 * coalesce(missed, 0), 20) + CASE WHEN n > 1500 THEN 15 WHEN n > 500 THEN 10 ELSE 0 END
         + CASE WHEN change IN (SELECT change FROM wa) AND coalesce(known, 0) < 0.1 AND busiest >= 5 THEN 10 ELSE 0 END
         + least(coalesce(rise, 0), 15) + CASE WHEN drops THEN 5 ELSE 0 END))::BIGINT AS risk FROM rg LEFT JOIN kc USING (change) LEFT JOIN mn USING (change) LEFT JOIN wo USING (change))"""


RISK = "SELECT change, risk, CASE WHEN risk < 30 THEN 'low' WHEN risk < 60 THEN 'medium' ELSE 'high' END AS level, missed FROM rs"


def risk_sql(changes: str) -> str:
    """For changes as SQL for (change, commit_id)."""
    return f"{BASE}, cg AS ({changes}), rw AS (SELECT change, ch.* FROM cg JOIN ch USING (commit_id)){risk_ctes('SELECT change, file, added + deleted AS n FROM rw', 'SELECT DISTINCT change, unnest(authors) AS author FROM rw')} {RISK}"


query("diff_risk", risk_sql("SELECT repo AS change, arg_max(commit_id, (ts, commit_id)) AS commit_id FROM c GROUP BY 1"))(lambda s, d: (lambda m: df.change_risk(m, ov.newest_commits(m), "unit"))(model_of(s, d)))
query("ticket_risk", risk_sql("SELECT DISTINCT ticket AS change, commit_id FROM c"))(lambda s, d: df.ticket_risk(model_of(s, d), "unit"))

_SEV = "round(greatest(1.0, least(100.0, {})))::BIGINT AS severity"
for _kind, _sql in {
    "hotspot": f"{BASE}{hotspot_ctes('entity')}, t AS (SELECT * FROM hot WHERE rank <= greatest(ceil((SELECT count(*) FROM hot) * 0.02), 5) AND NOT test AND code AND score >= 0.35 AND revisions >= 3 AND (health <= 7 OR norm >= 0.9) ORDER BY rank LIMIT 10) SELECT 'hotspot' AS kind, name AS subject, {_SEV.format('40 + 50 * score + 2 * (10 - health)')} FROM t",
    "knowledge_loss": f"{BASE}{hotspot_ctes('entity')}{ownership_ctes('entity')}, t AS (SELECT name, score, row_number() OVER (ORDER BY rank) AS k, count(*) OVER () AS n FROM hot WHERE NOT test) SELECT 'knowledge_loss' AS kind, name AS subject, {_SEV.format('35 + 35 * knowledge_loss + 20 * score')} FROM t JOIN own USING (name) WHERE k <= greatest(ceil(n * 0.1), 10) AND knowledge_loss >= 0.5 AND score >= 0.3",
    "coordination": f"{BASE}{hotspot_ctes('entity')}{ownership_ctes('entity')}, tt AS (SELECT name, team, sum(lines) AS l FROM kn JOIN ac USING (author) GROUP BY 1, 2), tn AS (SELECT name, count(*) AS teams FROM (SELECT name, round(l / sum(l) OVER (PARTITION BY name), 4) AS share FROM tt) WHERE share >= 0.1 GROUP BY 1), t AS (SELECT name, score, recent_authors, coalesce(teams, 0) AS teams FROM hot JOIN (SELECT name, recent_authors FROM own) USING (name) LEFT JOIN tn USING (name) WHERE NOT test AND (recent_authors >= 8 OR coalesce(teams, 0) >= 3) ORDER BY recent_authors + 3 * coalesce(teams, 0) DESC, name LIMIT 5) SELECT 'coordination' AS kind, name AS subject, {_SEV.format('25 + 1.5 * least(recent_authors, 20) + 5 * teams + 15 * score')} FROM t",
    "defect_magnet": f"{BASE}{hotspot_ctes('entity')}, bl AS (SELECT repo, round(avg(defect::INT), 4) AS baseline FROM c WHERE NOT format GROUP BY 1), er AS (SELECT entity AS name, min(repo) AS repo FROM fl GROUP BY 1), t AS (SELECT *, round((defects / revisions::DOUBLE) / greatest(baseline, 0.05), 4) AS ratio FROM hot JOIN er USING (name) JOIN bl USING (repo) WHERE NOT test AND revisions > 0 AND defects >= 5), u AS (SELECT * FROM t WHERE defect_density >= 0.3 AND ratio >= 0.9 ORDER BY ratio * defects DESC, name LIMIT 5) SELECT 'defect_magnet' AS kind, name AS subject, {_SEV.format('30 + 20 * least(ratio - 1, 1.5) + 0.5 * least(defects, 30) + 10 * score')} FROM u",
    "bus_factor": f"{BASE}{hotspot_ctes('unit')}{ownership_ctes('unit')}, t AS (SELECT own.main_dev, count(*) AS units, sum(loc) AS loc, avg(own.main_share) AS share FROM hot JOIN own USING (name) WHERE loc >= 1000 AND revisions >= 10 AND recent_authors > 0 GROUP BY 1 ORDER BY loc DESC, 1 LIMIT 5) SELECT 'bus_factor' AS kind, main_dev::VARCHAR AS subject, {_SEV.format('30 + 25 * share + 4 * log10(loc) + least(units, 5)')} FROM t",
    "shotgun_surgery": f"{BASE}{hotspot_ctes('entity')}, so AS (SELECT key AS name, sum(o)::BIGINT AS soc FROM (SELECT entity AS key, count(*) OVER (PARTITION BY commit_id) - 1 AS o FROM (SELECT DISTINCT commit_id, entity FROM ch WHERE couples)) GROUP BY 1), t AS (SELECT *, soc / revisions::DOUBLE AS av, row_number() OVER (ORDER BY soc DESC, name) AS k, count(*) OVER () AS n FROM hot JOIN so USING (name) WHERE revisions >= 10 AND NOT test AND code), u AS (SELECT * FROM t WHERE k <= greatest(ceil(n * 0.02), 3) AND av >= 0.5 ORDER BY soc DESC, name LIMIT 3) SELECT 'shotgun_surgery' AS kind, name AS subject, {_SEV.format('25 + 2 * least(av, 15.0) + 15 * score')} FROM u",
    "hidden_coupling": rf"""{BASE.replace("WITH", "WITH RECURSIVE", 1)}{hotspot_ctes("entity")}{coupling_ctes("entity", "commit", "1")}{coupling_ctes("entity", "ticket", "2")},
ok AS (SELECT name FROM hot WHERE code AND NOT test),
p1 AS (SELECT a, b, greatest(conf_ab, conf_ba) AS dg, support, cross_repo FROM cpl1 WHERE cross_unit AND a IN (FROM ok) AND b IN (FROM ok)),
p2 AS (SELECT a, b, greatest(conf_ab, conf_ba) AS dg, support, cross_repo FROM cpl2 WHERE cross_repo AND a IN (FROM ok) AND b IN (FROM ok)),
pp AS (SELECT * FROM p1 WHERE dg >= 0.05 UNION ALL SELECT * FROM p2 WHERE dg >= 0.05 AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.a = p2.a AND p1.b = p2.b AND p1.dg >= 0.05)),
ends AS (SELECT *, a AS node, b AS other FROM pp UNION ALL SELECT *, b, a FROM pp),
rc AS (SELECT node, node AS r FROM ends UNION SELECT ends.node, rc.r FROM rc JOIN ends ON ends.other = rc.node),
lb AS (SELECT node, min(r) AS comp FROM rc GROUP BY 1),
nd AS (SELECT node, comp, count(*) AS deg, arg_max(cross_repo, (dg, support, a, b)) AS crs, max(dg * support) AS w FROM ends JOIN lb USING (node) GROUP BY 1, 2),
hk2 AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY deg DESC, node) AS k FROM nd),
bs AS (SELECT comp, max((dg, support)) AS best FROM ends JOIN lb USING (node) GROUP BY 1),
cl AS (SELECT comp, max(node) FILTER (k = 1) AS hub, count(*) - 1 AS members, bool_or(crs) FILTER (k > 1) AS crs, max(w) AS w FROM hk2 GROUP BY 1),
t AS (SELECT hub, members, crs, w, best[1] AS dg, best[2] AS support FROM cl JOIN bs USING (comp) ORDER BY w DESC, hub LIMIT 10)
SELECT 'hidden_coupling' AS kind, hub AS subject, {_SEV.format("35 + 45 * dg * least(support / 15.0::DOUBLE, 1.0) + CASE WHEN crs THEN 8 ELSE 0 END + least(members - 1, 5)")} FROM t""",
}.items():
    query(f"finding_{_kind}", _sql)(lambda s, d, rule=fd.RULES[_kind]: rule(fd.Facts(model_of(s, d))).select("kind", "subject", "severity"))
_LABELS = (
    "WHEN 'hotspot' THEN 'Hotspot' WHEN 'deteriorating_hotspot' THEN 'Deteriorating hotspot' WHEN 'hidden_coupling' THEN 'Hidden coupling' WHEN 'shotgun_surgery' THEN 'Ripple effect' "
    "WHEN 'knowledge_loss' THEN 'Knowledge loss' WHEN 'bus_factor' THEN 'Bus factor' WHEN 'coordination' THEN 'Coordination bottleneck' WHEN 'defect_magnet' THEN 'Defect magnet'"
)
query(
    "findings_all",
    "SELECT printf('F%03d', row_number() OVER (ORDER BY severity DESC, kind, subject)) AS id, kind, CASE kind " + _LABELS + " END AS label, subject, severity FROM (" + " UNION ALL ".join(f"SELECT * FROM ({ORACLE[f'finding_{k}']})" for k in fd.RULES) + ")",
)(lambda s, d: fd.findings(model_of(s, d)).select("id", "kind", "label", "subject", "severity"))
query("text_loc", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS loc FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", paths.non_blank_lines(F.col("text")).alias("loc")))
query(
    "part_percentile",
    "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY p_brand) - 1) AS p FROM part",
)(lambda s, d: with_percentile(read(s, d, "part"), "p", "p_size", "p_brand").select("p_partkey", "p"))
query("file_inventory", f"{BASE} SELECT file, entity, unit, repo, alive, test, lang, loc, complexity, health FROM fl")(lambda s, d: part_files(s, d).drop("lang_weight"))
_GEN = ", ".join(f"'{x}'" for x in paths.GENERIC_STEMS)
query(
    "path_functions",
    rf"""WITH u AS (SELECT page_id, regexp_extract(url, '://[^/]*/?([^?#]*)', 1) AS p FROM pages), n AS (SELECT page_id, p, string_split(p, '/')[-1] AS f FROM u)
SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/?[^/]*$', '') || '/' ELSE '' END || regexp_replace(CASE WHEN length(f) > 1 THEN regexp_replace(f, '^(.+)\.[^.]*$', '\1') ELSE f END, '{paths.TEST_SUFFIX}', '') AS entity,
CASE WHEN lower(string_split(f, '.')[1]) IN ({_GEN}) AND contains(p, '/') THEN string_split(p, '/')[-2] || '/' || f ELSE f END AS short, regexp_matches(lower(p), '{paths.TEST_PATH}') AS test FROM n""",
)(lambda s, d: read(s, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/?([^?#]*)", 1).alias("p")).select("page_id", paths.entity_key(F.col("p")).alias("entity"), paths.short_name(F.col("p")).alias("short"), paths.is_test_path(F.col("p")).alias("test")))
