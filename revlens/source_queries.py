"""Queries over what sources give: texts, patches, trees, identities and sessions, derived from the tables by Spark; and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions.components import component_of
from revlens.functions.health import health
from revlens.operators import coupling as cp
from revlens.operators import diff as df
from revlens.operators import findings as fd
from revlens.operators import hotspots as hs
from revlens.operators import levels as lv
from revlens.operators import overview as ov
from revlens.operators import social as so
from revlens.operators import trends as tr
from revlens.operators.detail import architecture_units, detail
from revlens.operators.identity import resolve
from revlens.operators.resolution import find_file, group_entities, resolve_units
from revlens.plans.model import Model, Params, Scope
from revlens.queries import BASE, RISK, coupling_ctes, expert_ctes, hotspot_ctes, ownership_ctes, risk_ctes
from revlens.sources.patches import parse_patches
from revlens.sources.tables import model_of, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _times(n: Column, each: Callable[[Column], Column], between: str = "") -> Column:
    """each(1), each(2), ... up to each(n), put together."""
    return F.array_join(F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), each)).otherwise(F.array().cast("array<string>")), between)


def component_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, path, text: a script for each part, of one of six kinds, with as many parameters, inputs and styles as its columns tell."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda i: i.cast("string")
    head = F.when(k % 6 == 0, "export @Component({").when(k % 6 == 1, "@Directive({").when(k % 6 == 2, "  @Injectable({").when(k % 6 == 3, "@NgModule({").otherwise("const x = ({")
    head = F.when(k % 6 == 5, _text(" * @Component({ selector: 'no' })\n", head)).otherwise(head)
    urls = F.when((k % 6 == 0) & (k % 2 == 0), _text("  templateUrl: './c", s(k), ".html',\n")).otherwise("")
    styles = F.when(k % 3 == 0, _text("  styleUrls: [", _times(k % 4, lambda i: _text("'./s", s(i), ".scss'"), ", "), "],\n")).otherwise("")
    alone = F.when(k % 5 == 0, "  standalone: false,\n").otherwise("")
    inputs = _times(F.floor(k / 3) % 5, lambda i: _text("  in", s(i), " = input.required<Map<string, number>>();\n"))
    outputs = _times(k % 3, lambda i: _text("  @Output() out", s(i), " = new E();\n"))
    calls = _times(k % 4, lambda i: _text("  private i", s(i), " = inject(S", s(i), ");\n"))
    params = _times(size % 6, lambda i: _text("\n    @Inject(T, ',') private p", s(i), ": Map<string, number> = f(1, [2, 3]), /* a, b */"))
    body = _text("  constructor(x: string);\n  constructor(", params, ") { call('constructor(a, b)'); this.constructor(1, 2); }\n")
    last = F.when(k % 6 == 4, "export const guard: CanMatchFn = () => true;\n").otherwise("")
    name = F.when(k % 4 == 1, _text("x.guard.", s(k), ".ts")).when(k % 4 == 2, _text("x.resolver.", s(k), ".ts")).otherwise(_text("x", s(k), ".ts"))
    # Few bytes of parts make many of text: they are dealt out before, however few files or row groups they come in.
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(k.alias("part"), F.concat(F.lit("src/"), name).alias("path"), _text(head, "\n", urls, styles, alone, "})\nclass A {\n", inputs, outputs, calls, body, "}\n", last).alias("text"))


query(
    "component_metadata",
    """WITH p AS (SELECT p_partkey AS k, p_size, CASE p_partkey % 6 WHEN 0 THEN 'component' WHEN 1 THEN 'directive' WHEN 2 THEN CASE p_partkey % 4 WHEN 1 THEN 'guard' WHEN 2 THEN 'resolver' ELSE 'service' END WHEN 3 THEN 'module' WHEN 4 THEN 'guard' END AS kind FROM part)
SELECT k AS part, kind, (p_size % 6 + k % 4)::BIGINT AS deps, (k // 3 % 5)::BIGINT AS inputs, (k % 3)::BIGINT AS outputs, k % 5 <> 0 AND kind IN ('component', 'directive') AS standalone,
       CASE WHEN k % 6 = 0 THEN './c' || k || '.html' END AS template_url, CASE WHEN k % 3 = 0 THEN array_to_string(list_transform(range(1, k % 4 + 1), lambda i: './s' || i || '.scss'), ' ') ELSE '' END AS styles
FROM p WHERE kind IS NOT NULL""",
)(
    lambda s, d: component_sources(s, d)
    .select("part", component_of(F.col("path"), F.col("text")).alias("c"))
    .filter("c is not null")
    .select("part", "c.kind", "c.deps", "c.inputs", "c.outputs", "c.standalone", "c.template_url", F.array_join("c.style_urls", " ").alias("styles"))
)


def _healths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    fn = lambda name, cc, loc: F.struct(F.lit(name).alias("name"), cc.cast("int").alias("cc"), loc.cast("int").alias("loc"))
    langs = F.array(*map(F.lit, ("typescript", "php", "template", "scss", "data")))
    d = read(spark, sf_dir, "part").select(
        k.alias("part"), F.element_at(langs, (k % 5 + 1).cast("int")).alias("lang"), (k % 13 == 0).alias("generated"), F.array(fn("f", k % 40, size * 3), fn("g", k % 23, 40 + k % 60)).alias("functions"),
        (k % 9).cast("int").alias("max_nesting"), (size * 40).cast("long").alias("loc"), (k % 12).alias("deps"), (k % 15).alias("inputs"), (k % 80).cast("double").alias("complexity"), (k % 30).cast("int").alias("methods"),
    )
    return d.select("part", health().alias("h")).select("part", "h.health", F.array_join("h.reasons", "; ").alias("reasons"))


query(
    "health_reasons",
    """WITH p AS (SELECT p_partkey AS k, ['typescript', 'php', 'template', 'scss', 'data'][p_partkey % 5 + 1] AS lang, p_partkey % 13 = 0 AS gen, p_partkey % 40 AS fc, p_partkey % 23 AS gc, p_size * 3 AS fl, 40 + p_partkey % 60 AS gl,
                  p_partkey % 9 AS nest, p_size * 40 AS loc, p_partkey % 12 AS deps, p_partkey % 15 AS inputs, p_partkey % 80 AS cx, p_partkey % 30 AS methods FROM part),
q AS (SELECT *, lang IN ('typescript', 'php') AS code, (fc > 15)::INT + (gc > 15)::INT AS nb, (fl > 80)::INT + (gl > 80)::INT AS nl FROM p),
r AS (SELECT k, lang <> 'data' AND NOT gen AS on_, [
  CASE WHEN code AND nb > 0 THEN (least(CASE WHEN fc > 15 THEN least(1 + (fc - 15) / 10.0::DOUBLE, 3.0) ELSE 0 END + CASE WHEN gc > 15 THEN least(1 + (gc - 15) / 10.0::DOUBLE, 3.0) ELSE 0 END, 5.0), nb || ' complex function' || CASE nb WHEN 1 THEN '' ELSE 's' END || ' (cc > 15); worst `' || CASE WHEN gc > fc OR fc <= 15 THEN 'g' ELSE 'f' END || '` cc ' || greatest(fc, gc)) END,
  CASE WHEN code AND nl > 0 THEN (least(nl * 0.5::DOUBLE, 2.0), nl || ' long function' || CASE nl WHEN 1 THEN '' ELSE 's' END || ' (> 80 lines); longest `' || CASE WHEN gl > fl THEN 'g' ELSE 'f' END || '` ' || greatest(fl, gl) || ' lines') END,
  CASE WHEN nest > 4 THEN (CASE WHEN nest > 6 THEN 1.5 ELSE 1.0 END::DOUBLE, 'deep nesting (depth ' || nest || ')') END,
  CASE WHEN loc > 1500 THEN (2.0::DOUBLE, 'very large file (' || loc || ' lines)') WHEN loc > 600 AND code THEN (1.0::DOUBLE, 'large file (' || loc || ' lines)') END,
  CASE WHEN deps > 7 THEN (1.0::DOUBLE, deps || ' injected dependencies (> 7)') END, CASE WHEN inputs > 10 THEN (1.0::DOUBLE, inputs || ' inputs (> 10)') END,
  CASE WHEN lang = 'template' AND cx > 25 THEN (least((cx - 25) / 15.0::DOUBLE + 1, 3.0), 'complex template (complexity ' || cx || ')') END, CASE WHEN lang = 'php' AND methods > 20 THEN (1.0::DOUBLE, methods || ' methods in one file (> 20)') END] AS x FROM q),
s AS (SELECT k, CASE WHEN on_ THEN list_filter(x, lambda y: y IS NOT NULL) ELSE [] END AS x FROM r)
SELECT k AS part, round(greatest(10 - least(coalesce(list_sum(list_transform(x, lambda y: y[1])), 0.0), 9.0), 1.0), 1) AS health, array_to_string(list_transform(x, lambda y: y[2]), '; ') AS reasons FROM s""",
)(_healths)


def patch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, value: the patch of each order's lines of one part type, two hunks a line, with content that looks like headers."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    s = lambda c: c.cast("string")
    range_ = lambda first, count: _text(s(first), F.when(count == 1, "").otherwise(_text(",", s(count))))
    hunk = lambda a, b, c, d: _text("@@ -", range_(a, b), " +", range_(c, d), " @@ fn()\n", F.repeat(F.lit("--- a/old\n"), b.cast("int")), F.repeat(F.lit("+++ @@ -1 +1 @@\n"), d.cast("int")))
    blob = lambda k: F.lpad(F.lower(F.hex(k)), 40, "0")

    def section(line: Column) -> Column:
        part, n = line["l_partkey"], line["n"]
        path, new = _text("part-", s(part)), n == 7
        old = F.when(new, F.repeat(F.lit("0"), F.lit(40))).otherwise(blob(part * 2 + 2))
        return _text(
            "diff --git a/", path, " b/", path, "\n", F.when(new, "new file mode 100644\n").otherwise(""), "index ", old, "..", blob(part * 2 + 3), " 100644\n--- a/", path, "\n+++ b/", path, "\n",
            hunk(n * 4, n % 3, n * 4, line["quantity"] % 5), hunk(40 + n, F.lit(1), F.lit(45), 1 + line["l_suppkey"] % 3),
        )

    # A section's numbers are what travels; its text is made where its record is. A repository's records are dealt together.
    row = F.struct("l_partkey", F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("quantity"), "l_suppkey")
    lines = lines.select(s(F.col("l_orderkey")).alias("repo"), F.col("p_type").alias("sha"), row.alias("line")).repartition("repo")
    per = lines.groupBy("repo", "sha").agg(F.array_join(F.sort_array(F.transform(F.collect_list("line"), section)), "").alias("sections"))
    return per.select("repo", F.concat("sha", F.lit("\n\n"), "sections").alias("value"))


def part_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blob, fn, start, end, cc: three functions, the second within the first, in the old and the new content of each part."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("long")
    fn = lambda name, a, b, cc: F.struct(F.lit(name).alias("fn"), a.cast("long").alias("start"), b.cast("long").alias("end"), cc.cast("long").alias("cc"))
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    d = read(spark, sf_dir, "part").select(k, size.alias("size"), sides)
    fns = F.explode(F.array(fn("outer", F.lit(1), F.col("size"), F.col("size") % 20 + F.col("side")), fn("inner", F.floor(F.col("size") / 3), F.floor(F.col("size") / 2), k % 17), fn("tail", F.lit(44), F.lit(46), k % 5 + 3 * F.col("side")))).alias("f")
    d = d.select(F.lpad(F.lower(F.hex(k * 2 + 2 + F.col("side"))), 40, "0").alias("blob"), F.concat(F.lit("part-"), k.cast("string")).alias("file"), "side", fns)
    return d.select("blob", "file", "side", "f.*")


_FUNCTION_CHANGES = """,
fr AS (SELECT p_partkey AS k, u[1] AS fn, u[2] AS s, u[3] AS e FROM (SELECT p_partkey, unnest([('outer', 1, p_size), ('inner', p_size // 3, p_size // 2), ('tail', 44, 46)]) AS u FROM part)),
hk0 AS (SELECT l_orderkey::VARCHAR AS repo, p_type AS sha, l_partkey AS k, l_linenumber::BIGINT AS n, l_quantity::BIGINT % 5 AS q, 1 + l_suppkey % 3 AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
ln0 AS (SELECT repo, sha, k, 'new' AS side, unnest(range(n * 4, n * 4 + q)) AS line FROM hk0 UNION SELECT repo, sha, k, 'new', unnest(range(45, 45 + t)) FROM hk0
        UNION SELECT repo, sha, k, CASE WHEN n = 7 THEN 'none' ELSE 'old' END, unnest(range(n * 4, n * 4 + n % 3)) FROM hk0 UNION SELECT repo, sha, k, CASE WHEN n = 7 THEN 'none' ELSE 'old' END, 40 + n FROM hk0),
li AS (SELECT repo, sha, ln0.k, side, line, coalesce(arg_min(fn, (e - s, fn)), '(top level)') AS fn FROM ln0 LEFT JOIN fr ON ln0.k = fr.k AND line BETWEEN s AND e AND s <= e AND side <> 'none' GROUP BY ALL),
fc AS (SELECT repo, sha, 'part-' || k AS path, fn, count(*) FILTER (side = 'new') AS added, count(*) FILTER (side <> 'new') AS deleted FROM li GROUP BY ALL)"""


def _commit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.commit_functions(parse_patches(patch_records(spark, sf_dir)), part_functions(spark, sf_dir))


query("function_changes", f"WITH one AS (SELECT 1){_FUNCTION_CHANGES} SELECT * FROM fc")(lambda s, d: tr.function_changes(parse_patches(patch_records(s, d)), part_functions(s, d)))
query(
    "xray_from_patches",
    f"{BASE}{_FUNCTION_CHANGES}, fx AS (SELECT path AS file, fn, c.*, fc.added, fc.deleted FROM fc JOIN c ON c.commit_id = fc.repo || ':' || fc.sha), "
    "pp AS (SELECT file, fn, commit_id, max(weight * exp(-(greatest((now - ts) / 86400.0::DOUBLE, 0.0) / 180.0::DOUBLE) * 0.6931471805599453::DOUBLE)) AS w, sum(added + deleted) AS churn, max(defect) AS defect, max(ts) AS ts FROM fx GROUP BY 1, 2, 3), "
    "pa AS (SELECT file, fn, count(DISTINCT author) AS authors FROM (SELECT file, fn, unnest(authors) AS author FROM fx) GROUP BY 1, 2), "
    "gg AS (SELECT file, fn, count(*) AS revisions, sum(w) AS rev_w, sum(churn)::BIGINT AS churn, sum(defect::INT)::BIGINT AS defects, max(ts) AS last_ts FROM pp GROUP BY 1, 2), "
    "ff AS (SELECT 'part-' || p_partkey AS file, u[1] AS fn, u[2]::BIGINT AS cc FROM (SELECT p_partkey, unnest([('outer', p_size % 20 + 1), ('inner', p_partkey % 17), ('tail', p_partkey % 5 + 3)]) AS u FROM part)), "
    "mm AS (SELECT *, max(rev_w) OVER (PARTITION BY file) AS m FROM gg JOIN ff USING (file, fn) JOIN pa USING (file, fn)) "
    "SELECT file, fn, revisions, round(rev_w, 4) AS rev_w, churn, defects, authors, last_ts, cc, round(CASE WHEN m > 0 THEN ln(1 + rev_w) / ln(1 + m) ELSE 0.0 END * (0.4::DOUBLE + 0.6::DOUBLE * least(cc / 15, 1.0)), 3) AS score FROM mm",
)(lambda s, d: tr.function_hotspots(tr.function_history(model_of(s, d), _commit_functions(s, d)), part_functions(s, d).filter("side = 1").select("file", "fn", "cc")))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snapshot_diff() of two trees of the parts: some are new, gone, moved or changed."""
    k, name = F.col("p_partkey"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))
    p, moved = read(spark, sf_dir, "part"), (F.col("p_partkey") % 11 == 0)
    blob = lambda side: F.lpad(F.lower(F.hex(k * 2 + 2 + side)), 40, "0").alias("blob")
    to = F.concat(F.lit("moved/"), name)
    before = p.filter(k % 5 != 0).select(F.col("p_type").alias("repo"), name.alias("path"), blob(F.lit(0)))
    after = p.filter(k % 7 != 0).select(F.col("p_type").alias("repo"), F.when(moved, to).otherwise(name).alias("path"), blob((k % 3 == 0).cast("int")))
    return df.snapshot_diff(before, after, p.filter(moved).select(F.col("p_type").alias("repo"), name.alias("old_path"), to.alias("path")))


_SNAPSHOT = """,
sn0 AS (SELECT p_partkey AS k, p_type AS repo, p_size, p_partkey % 5 <> 0 AS b, p_partkey % 7 <> 0 AS a, p_partkey % 11 = 0 AS m, p_partkey % 3 = 0 AS changed FROM part),
sn AS (SELECT repo, k, p_size, CASE WHEN m AND a THEN 'moved/' ELSE '' END || 'part-' || k AS path, CASE WHEN b AND a AND m THEN 'part-' || k END AS old_path,
              CASE WHEN a AND NOT b THEN 'added' WHEN b AND NOT a THEN 'deleted' WHEN m THEN 'renamed' WHEN changed THEN 'modified' END AS status,
              CASE WHEN b THEN lpad(printf('%x', k * 2 + 2), 40, '0') END AS old_blob, CASE WHEN a THEN lpad(printf('%x', k * 2 + 2 + changed::INT), 40, '0') END AS new_blob, a, b, changed FROM sn0 WHERE (a OR b) AND NOT (a AND b AND NOT m AND NOT changed))"""
query("snapshot_diff", f"WITH one AS (SELECT 1){_SNAPSHOT} SELECT repo, path, old_path, status, old_blob, new_blob FROM sn")(snapshots)


def _snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select(
        F.lpad(F.lower(F.hex(k * 2 + 2 + F.col("side"))), 40, "0").alias("blob"), (k % 50 + 10 * F.col("side")).cast("double").alias("complexity"), (10 - (k % 4) * F.col("side")).cast("double").alias("health")
    )


def _snapshot_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth part of a repository is a change; its newest commit's people wrote it, in every third change strangers did."""
    m = model_of(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    files = snapshots(spark, sf_dir).withColumn("change", F.concat_ws(":", "repo", (number % 20).cast("string"))).withColumns({"added": number % 40, "deleted": number % 7})
    newest = m.commits.groupBy("repo").agg(F.max(F.struct("ts", "commit_id", "authors")).alias("p")).select("repo", F.explode("p.authors").alias("author"))
    people = files.select("repo", "change").distinct().join(newest, "repo").select("change", F.when(F.element_at(F.split("change", ":"), -1).cast("int") % 3 != 0, F.col("author")).alias("author"))
    return df.diff_risk(m, files, people, _snapshot_metrics(spark, sf_dir), part_functions(spark, sf_dir).select("blob", "fn", "start", "end", "cc"), "unit")


_WORSE = (
    "SELECT change, coalesce(rise, 0) AS rise, drops FROM (SELECT change, bool_or(a AND b AND changed AND k % 4 >= 1) AS drops FROM sc GROUP BY 1) LEFT JOIN (SELECT change, sum(greatest(after_ - before_, 0)) AS rise FROM ("
    "SELECT change, unnest([p_size % 20 + changed::INT, k % 17, k % 5 + 3 * changed::INT]) AS after_, unnest(CASE WHEN b THEN [p_size % 20, k % 17, k % 5] ELSE [0, 0, 0] END) AS before_ FROM sc WHERE a) GROUP BY 1) USING (change)"
)
query(
    "snapshot_risk",
    f"{BASE}{_SNAPSHOT}, sc AS (SELECT *, repo || ':' || k % 20 AS change, k % 40 + k % 7 AS n FROM sn), nc2 AS (SELECT repo, arg_max(authors, (ts, commit_id)) AS authors FROM c GROUP BY 1)"
    + risk_ctes(
        "SELECT change, CASE WHEN path LIKE 'moved/%' AND old_path IS NULL THEN path ELSE 'part-' || k END AS file, n FROM sc",
        "SELECT DISTINCT change, CASE WHEN split_part(change, ':', 2)::INT % 3 <> 0 THEN author END AS author FROM (SELECT DISTINCT sc.repo, change FROM sc) JOIN (SELECT repo, unnest(authors) AS author FROM nc2) USING (repo)",
        _WORSE,
    )
    + f" {RISK}",
)(_snapshot_risk)


def entity_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What group_entities() takes: in each four parts a component, its template, its style and its test, some of them dead."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    folder = _text("lib/d", s(F.floor(k / 4) % 25), "/")
    path = F.when(k % 4 == 0, _text(folder, "c", s(k), ".component.ts")).when(k % 4 == 1, _text(folder, "view/t", s(k), ".html")).when(k % 4 == 2, _text("lib/style", s(k), ".scss")).otherwise(_text(folder, "c", s(k), ".spec.ts"))
    links = F.when(k % 4 == 0, F.array(_text("./view/t", s(k + 1), ".html"), _text("../style", s(k + 2), ".scss"))).otherwise(F.array().cast("array<string>"))
    lang = F.when(k % 4 == 1, "template").when(k % 4 == 2, "scss").otherwise("typescript")
    return read(spark, sf_dir, "part").select(
        F.lit("r").alias("repo"), path.alias("path"), k.alias("file"), (F.col("p_size") % 10 != 0).alias("alive"), (k % 4 == 3).alias("test"), lang.alias("lang"), F.col("p_brand").alias("unit"),
        links.alias("links"), F.when((k % 4 == 0) & (k % 8 == 0), F.lit("component")).alias("component"),
    )


query(
    "entity_groups",
    """WITH p AS (SELECT p_partkey AS k, p_partkey - p_partkey % 4 AS k0, p_size % 10 <> 0 AS alive, p_brand, 'lib/d' || (p_partkey // 4 % 25) || '/' AS d FROM part),
q AS (SELECT p.*, CASE WHEN p.k % 4 IN (1, 2) AND b.alive THEN b.d || 'c' || b.k || '.component' WHEN p.k % 4 = 0 THEN p.d || 'c' || p.k || '.component' WHEN p.k % 4 = 1 THEN p.d || 'view/t' || p.k WHEN p.k % 4 = 2 THEN 'lib/style' || p.k ELSE p.d || 'c' || p.k END AS entity
      FROM p LEFT JOIN p b ON b.k = p.k0),
e AS (SELECT entity, CASE WHEN bool_or(k % 8 = 0) THEN 'component' WHEN bool_and(k % 4 = 1) THEN 'template' ELSE 'file' END AS kind, coalesce(arg_min(p_brand, k) FILTER (k % 4 <> 3), arg_min(p_brand, k)) AS unit FROM q GROUP BY 1)
SELECT k AS file, entity, kind AS entity_kind, unit AS entity_unit FROM q JOIN e USING (entity)""",
)(lambda s, d: group_entities(entity_files(s, d)).select("file", "entity", "entity_kind", "entity_unit"))

_PEOPLE = """WITH RECURSIVE i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 THEN 'renovate' WHEN c_custkey % 10 = 1 THEN 'Zoé Nr. ' || (c_custkey - 1) WHEN c_custkey % 10 = 0 THEN 'zoe nr ' || c_custkey WHEN c_custkey % 10 = 5 THEN 'Yu' ELSE c_name END AS name,
  CASE WHEN c_custkey % 10 IN (1, 2) THEN 'M' || (c_custkey // 10) || '@Mail.org' ELSE lower(replace(c_name, '#', '')) || '@work.org' END AS email, c_custkey % 17 AS commits FROM customer),
k AS (SELECT id, 'e:' || lower(email) AS key FROM i UNION ALL SELECT id, 'n:' || regexp_replace(strip_accents(lower(name)), '[^a-z0-9]', '', 'g') FROM i WHERE length(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]', '', 'g')) >= 3),
g AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y USING (key) WHERE x.key <> 'n:renovate' OR x.id = (SELECT min(id) FROM k WHERE key = 'n:renovate') OR y.id = (SELECT min(id) FROM k WHERE key = 'n:renovate')),
r AS (SELECT id, id AS m FROM i UNION SELECT r.id, g.b FROM r JOIN g ON r.m = g.a),
p AS (SELECT id, min(m) AS person FROM r GROUP BY 1)"""


def _identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, last = F.col("c_custkey"), F.col("c_custkey") % 10
    name = F.when(k % 97 == 0, F.lit("renovate")).when(last == 1, _text("Zoé Nr. ", (k - 1).cast("string"))).when(last == 0, _text("zoe nr ", k.cast("string"))).when(last == 5, F.lit("Yu")).otherwise(F.col("c_name"))
    email = F.when(last.isin(1, 2), _text("M", F.floor(k / 10).cast("string"), "@Mail.org")).otherwise(_text(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), "@work.org"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), name.alias("name"), email.alias("email"), (k % 17).alias("commits"))


query(
    "identity_people",
    f"{_PEOPLE}, d AS (SELECT person, arg_max(name, (commits, -id)) AS display, bool_or(name = 'renovate') AS bot, count(*) AS n FROM i JOIN p USING (id) GROUP BY 1) SELECT id, person, display, bot FROM p JOIN d USING (person)",
)(lambda s, d: resolve(_identities(s, d)).select("id", "person", "display", "bot"))

query("hotspots_scoped_path", f"{BASE}{hotspot_ctes('entity', where="starts_with(file, 'part-1')")} SELECT * FROM hot")(lambda s, d: hs.hotspots(model_of(s, d), "entity", Scope(path="./part-1")))
query(
    "ownership_report_unit",
    f"{BASE}{ownership_ctes('unit')}{hotspot_ctes('unit')}, to8 AS (SELECT name, string_agg(author || '=' || round(share, 3), ' ' ORDER BY k) AS top_authors FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY share DESC, author) AS k FROM ks) WHERE k <= 8 GROUP BY 1), "
    "tm AS (SELECT name, string_agg(team || '=' || s, ' ' ORDER BY s DESC, team) AS teams FROM (SELECT name, team, round(sum(share), 3) AS s FROM ks JOIN (SELECT author, team FROM ac) USING (author) GROUP BY 1, 2) GROUP BY 1), "
    "sc AS (SELECT name, score FROM hot) SELECT row_number() OVER (ORDER BY coalesce(score, 0.0) DESC, name) AS place, name, coalesce(score, 0.0) AS score, main_dev, main_share, fragmentation, knowledge_loss, bus_factor, recent_authors, top_authors, teams "
    "FROM own JOIN to8 USING (name) JOIN tm USING (name) LEFT JOIN sc USING (name)",
)(
    lambda s, d: so.ownership_report(model_of(s, d), "unit").select(
        "place", "name", "score", "main_dev", "main_share", "fragmentation", "knowledge_loss", "bus_factor", "recent_authors",
        F.array_join(F.transform("top_authors", lambda x: F.concat_ws("=", x["author"].cast("string"), x["share"].cast("string"))), " ").alias("top_authors"),
        F.array_join(F.transform("teams", lambda x: F.concat_ws("=", x["team"], x["share"].cast("string"))), " ").alias("teams"),
    )
)

_SESSION_SETS = """, cm AS (SELECT commit_id AS id, any_value(author) AS author, any_value(ts) AS ts, any_value(repo) AS repo, count(*) AS n FROM ch WHERE couples GROUP BY 1),
so0 AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts, id) AS k FROM cm),
so1 AS (SELECT id, author, ts, repo, n, k, ts AS anchor FROM so0 WHERE k = 1 UNION ALL SELECT b.id, b.author, b.ts, b.repo, b.n, b.k, CASE WHEN b.ts - a.anchor > 14400 THEN b.ts ELSE a.anchor END FROM so1 a JOIN so0 b ON b.author = a.author AND b.k = a.k + 1),
so2 AS (SELECT author, anchor, count(DISTINCT repo) AS repos, sum(n) AS n, max(ts) AS last FROM so1 GROUP BY 1, 2),
cs AS (SELECT id, CASE WHEN repos > 1 AND so2.n <= 8 THEN author || ':' || anchor ELSE 'one:' || id END AS set_id, CASE WHEN repos > 1 AND so2.n <= 8 THEN last ELSE ts END AS sts FROM so1 JOIN so2 USING (author, anchor))"""
query("coupling_session_unit", f"{BASE.replace('WITH', 'WITH RECURSIVE', 1)}{_SESSION_SETS}{coupling_ctes('unit', 'session')} SELECT * FROM cpl")(lambda s, d: cp.coupling(model_of(s, d), "unit", "session"))


def _loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model_of(spark, sf_dir)
    m = replace(m, params=replace(m.params, min_support=2, min_confidence=0.0, min_lift=0.0))
    return cp.coupling(m, "file", "ticket", include_tests=True, include_config=True, include_expected=True)


query("coupling_flags_file", f"{BASE}{coupling_ctes('file', 'ticket', support=2, conf=0.0, lift=0.0, every=True)} SELECT * FROM cpl")(_loose)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    per = read(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_type", "p_name").alias("name")).agg(F.max(k % 9).alias("deps"), F.max(k % 12).alias("inputs"), F.max(k % 27).alias("template_complexity"))
    return fd.bloated_findings(fd.Facts(model_of(spark, sf_dir)), per).select("kind", "subject", "severity")


query(
    "finding_bloated_component",
    f"{BASE}{hotspot_ctes('entity')}, ci AS (SELECT p_type || '/' || p_name AS name, (max(p_partkey % 9) > 7)::INT + (max(p_partkey % 12) > 10)::INT + (max(p_partkey % 27) > 25)::INT AS issues FROM part GROUP BY 1) "
    "SELECT 'bloated_component' AS kind, name AS subject, round(greatest(1.0, least(100.0, 30 + 10 * issues + 25 * score)))::BIGINT AS severity FROM hot JOIN ci USING (name) WHERE rank <= greatest(ceil((SELECT count(*) FROM hot) * 0.1), 10) AND issues > 0",
)(_issues)


def _hot_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fns = F.explode(F.array(*[F.struct(F.lit(n).alias("fn"), (k % m).alias("cc"), (k % 9 + i).alias("revisions"), F.round(F.lit(0.3) + (k % m) / 50, 3).alias("score")) for i, (n, m) in enumerate((("f", 31), ("g", 29), ("h", 37)))])).alias("f")
    functions = read(spark, sf_dir, "part").select(F.concat(F.lit("part-"), k.cast("string")).alias("file"), fns).select("file", "f.*")
    return fd.function_findings(fd.Facts(model_of(spark, sf_dir)), functions).select("kind", "subject", "severity")


query(
    "finding_xray_hotspot",
    f"{BASE}{hotspot_ctes('file')}, fu AS (SELECT 'part-' || p_partkey AS file, u[1] AS fn, u[2] AS cc, u[3] AS revisions, round(0.3::DOUBLE + u[2] / 50.0::DOUBLE, 3) AS fs FROM (SELECT p_partkey, unnest([('f', p_partkey % 31, p_partkey % 9), ('g', p_partkey % 29, p_partkey % 9 + 1), ('h', p_partkey % 37, p_partkey % 9 + 2)]) AS u FROM part)), "
    "fi AS (SELECT name AS file, rank, score FROM hot WHERE NOT test ORDER BY rank LIMIT 15), ta AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY fs DESC, fn) AS k FROM fu JOIN fi USING (file) WHERE cc > 15 AND revisions >= 3 AND fs >= 0.4), "
    "tb AS (SELECT *, count(*) OVER (ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM ta WHERE k <= 2) "
    "SELECT 'xray_hotspot' AS kind, file || ' ' || fn AS subject, round(greatest(1.0, least(100.0, 35 + 0.6::DOUBLE * least(cc, 40) + 0.6::DOUBLE * least(revisions, 40) + 15 * score)))::BIGINT AS severity FROM tb WHERE n < 8",
)(_hot_functions)


def _levels(f: Callable[[str], str], columns: str) -> str:
    """The same of each level, put together."""
    return " UNION ALL ".join(f"SELECT '{level}' AS level, {columns} FROM ({f(level)})" for level in ("file", "entity", "unit", "repo"))


query("hotspots_all_levels", _levels(lambda level: f"{BASE}{hotspot_ctes(level)} SELECT * FROM hot", "*"))(lambda s, d: lv.hotspots_of_levels(model_of(s, d)))
query("ownership_all_levels", _levels(lambda level: f"{BASE}{ownership_ctes(level)} SELECT * FROM own", "*"))(lambda s, d: lv.ownership_of_levels(model_of(s, d)))


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first unit by name; its lists as text."""
    m = model_of(spark, sf_dir)
    d = detail(m, "unit", m.files.agg(F.min("unit")).first()[0])
    text = lambda items, f: F.array_join(F.transform(items, f), " ")
    s = lambda *xs: F.concat_ws(":", *[x.cast("string") for x in xs])
    return d.select(
        "level", "name", "repo", "total_ranked", "hotspot.rank", "hotspot.score", "ownership.main_dev", "ownership.bus_factor",
        text("files", lambda f: s(f["file"], f["test"], f["revisions"])).alias("files"), text("experts", lambda e: s(e["author"], e["score"])).alias("experts"),
        text("partners", lambda p: s(p["name"], p["by"], p["support"], p["confidence"])).alias("partners"), text("commits", lambda c: s(c["commit_id"], c["added"], c["deleted"])).alias("commits"), F.array_join("tickets", " ").alias("tickets"),
    )


_FIRST = "(SELECT min(unit) FROM fl)"
query(
    "unit_detail",
    f"{BASE}{hotspot_ctes('unit', where=f'repo = (SELECT min(repo) FROM fl WHERE unit = {_FIRST})')}{ownership_ctes('unit')}{expert_ctes(f'SELECT 0 AS change, file FROM fl WHERE unit = {_FIRST}')}{coupling_ctes('unit', 'commit', '1', lift=1.0)}{coupling_ctes('unit', 'ticket', '2', lift=1.0)}, "
    f"k0 AS (SELECT {_FIRST} AS k), bo AS (SELECT *, 'commit' AS how FROM cpl1 UNION ALL SELECT *, 'ticket' FROM cpl2 WHERE cross_repo), "
    "dr AS (SELECT b AS name, support, conf_ab AS confidence, how FROM bo, k0 WHERE a = k UNION ALL SELECT a, support, conf_ba, how FROM bo, k0 WHERE b = k), d25 AS (SELECT * FROM dr ORDER BY confidence DESC, support DESC, name, how LIMIT 25), "
    "fr AS (SELECT fl.file, test, complexity, count(DISTINCT commit_id) AS n FROM fl LEFT JOIN (SELECT file, commit_id FROM ch) USING (file), k0 WHERE unit = k AND alive GROUP BY ALL), "
    "cm AS (SELECT commit_id, max(ts) AS ts, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, any_value(ticket) AS ticket FROM ch, k0 WHERE unit = k GROUP BY 1 ORDER BY ts DESC, commit_id LIMIT 30), "
    "tk AS (SELECT ticket, min(i) AS i FROM (SELECT ticket, row_number() OVER (ORDER BY ts DESC, commit_id) AS i FROM cm) GROUP BY 1 ORDER BY i LIMIT 15) "
    "SELECT 'unit' AS level, k AS name, (SELECT min(repo) FROM fl WHERE unit = k) AS repo, (SELECT count(*) FROM hot) AS total_ranked, hot.rank, hot.score, own.main_dev, own.bus_factor, "
    "(SELECT string_agg(file || ':' || test || ':' || n, ' ' ORDER BY test, complexity DESC, file) FROM fr) AS files, (SELECT string_agg(author || ':' || score, ' ' ORDER BY place) FROM ex WHERE place <= 5) AS experts, "
    "coalesce((SELECT string_agg(name || ':' || how || ':' || support || ':' || confidence, ' ' ORDER BY confidence DESC, support DESC, name, how) FROM d25), '') AS partners, "
    "(SELECT string_agg(commit_id || ':' || added || ':' || deleted, ' ' ORDER BY ts DESC, commit_id) FROM cm) AS commits, (SELECT string_agg(ticket, ' ' ORDER BY i) FROM tk) AS tickets FROM k0 LEFT JOIN hot ON hot.name = k LEFT JOIN own ON own.name = k",
)(_detail)
query(
    "architecture_units",
    f"{BASE}{hotspot_ctes('unit')}{ownership_ctes('unit')} SELECT rank, hot.name, (SELECT min(repo) FROM fl WHERE unit = hot.name) AS repo, NULL::VARCHAR AS kind, loc, files, score, revisions, health, bus_factor, knowledge_loss, own.main_dev FROM hot LEFT JOIN own ON own.name = hot.name",
)(lambda s, d: architecture_units(model_of(s, d)))


def _lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages, asked for whole, by their ends, and from the root of a repository, which is a host."""
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("repo"), F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path")).filter("path <> ''")
    files = p.groupBy("repo", "path").agg(F.min("page_id").alias("file")).withColumn("alive", F.col("file") % 3 != 0)
    asked = F.when(F.col("file") % 4 == 0, F.col("path")).when(F.col("file") % 4 == 1, F.element_at(F.split("path", "/"), -1)).when(F.col("file") % 4 == 2, F.concat(F.lit("/srv/"), "repo", F.lit("/"), "path")).otherwise(F.concat(F.lit("./"), "path"))
    roots = files.select("repo", F.concat(F.lit("/srv/"), "repo").alias("root")).distinct()
    return find_file(files, files.select(asked.alias("asked")).filter("asked <> ''"), roots)


query(
    "path_lookup",
    r"""WITH f AS (SELECT repo, path, min(page_id) AS file, min(page_id) % 3 <> 0 AS alive FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS repo, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages) WHERE path <> '' GROUP BY 1, 2),
w AS (SELECT DISTINCT asked, regexp_replace(asked, '^(\./)+', '') AS rel FROM (SELECT CASE file % 4 WHEN 0 THEN path WHEN 1 THEN string_split(path, '/')[-1] WHEN 2 THEN '/srv/' || repo || '/' || path ELSE './' || path END AS asked FROM f) WHERE asked <> ''),
a AS (SELECT asked, arg_min(file, (repo, file)) AS file FROM w JOIN f ON asked = '/srv/' || repo || '/' || path GROUP BY 1),
e AS (SELECT asked, arg_min(file, (repo, file)) AS file FROM w JOIN f ON path = rel WHERE asked NOT IN (SELECT asked FROM a) GROUP BY 1),
s AS (SELECT asked, min(file) AS file FROM w JOIN f ON alive AND ends_with(path, '/' || rel) WHERE asked NOT IN (SELECT asked FROM a UNION ALL SELECT asked FROM e) GROUP BY 1 HAVING count(*) = 1)
SELECT * FROM a UNION ALL SELECT * FROM e UNION ALL SELECT * FROM s""",
)(_lookups)


def _ticketless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the tickets is not named: those commits come together by their authors' sessions, the others by ticket."""
    m = model_of(spark, sf_dir)
    named = F.filter("tickets", lambda t: F.regexp_extract(t, r"(\d+)$", 1).cast("long") % 3 != 0)
    return cp.coupling(replace(m, changes=m.changes.withColumn("tickets", named)), "unit", "ticket")


_UNNAMED = "string_split(ticket, '-')[2]::BIGINT % 3 = 0"
_MIXED_SETS = f"""{_SESSION_SETS.replace("WHERE couples GROUP BY 1)", f"WHERE couples AND {_UNNAMED} GROUP BY 1)", 1)},
mx0 AS (SELECT commit_id AS id, ticket AS set_id, max(ts) OVER (PARTITION BY ticket) AS sts, count(*) OVER (PARTITION BY ticket) AS n FROM ch WHERE couples AND NOT ({_UNNAMED}))"""
_MIXED = _MIXED_SETS.replace("cs AS (", "cs0 AS (") + ", cs AS (SELECT DISTINCT id, set_id, sts FROM mx0 WHERE n <= 8 UNION ALL SELECT id, set_id, sts FROM cs0)"
query("coupling_without_tickets", f"{BASE.replace('WITH', 'WITH RECURSIVE', 1)}{_MIXED}{coupling_ctes('unit', 'session')} SELECT * FROM cpl")(_ticketless)


def _unit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    path = F.when(k % 4 == 0, _text("apps/a", s(k % 7), "/src/x", s(k), ".ts")).when(k % 4 == 1, _text("libs/l", s(k % 5), "/deep/y", s(k), ".ts")).when(k % 4 == 2, _text("src/app/t", s(k % 3), "/z", s(k), ".ts")).otherwise(_text("w", s(k), ".ts"))
    p = read(spark, sf_dir, "part")
    files = p.select(F.col("p_type").alias("repo"), path.alias("path"), k.alias("part"))
    repos = p.select(F.col("p_type").alias("repo")).distinct()
    roots = repos.select("repo", F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.lit(u).alias("unit"), F.lit("app").alias("kind")) for r, u in (("apps", "apps"), ("apps/a1", "one"), ("apps/a2", "two"), ("libs/l3/deep", "deep"), ("", "top"))])).alias("r")).select("repo", "r.*")
    manual = repos.select("repo", F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(g).alias("glob"), F.lit(u).alias("unit"), F.lit("hand").alias("kind")) for i, (g, u) in enumerate((("**/x*0.ts", "zeros"), ("apps/a1/**", "never"), ("w?.ts", "few")))])).alias("m")).select("repo", "m.*")
    return resolve_units(files, manual.filter("glob <> 'apps/a1/**' or repo = 'none'"), roots).select("part", "unit", "unit_kind")


query(
    "unit_resolution",
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m FROM part)
SELECT k AS part, CASE WHEN m = 0 AND k % 10 = 0 THEN 'zeros' WHEN m = 3 AND k < 10 THEN 'few' WHEN m = 0 THEN CASE k % 7 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'apps' END WHEN m = 1 THEN CASE WHEN k % 5 = 3 THEN 'deep' ELSE 'libs/l' || (k % 5) END
       WHEN m = 2 THEN 'src/app/t' || (k % 3) ELSE '(root)' END AS unit, CASE WHEN m = 0 AND k % 10 = 0 OR m = 3 AND k < 10 THEN 'hand' WHEN m = 0 OR m = 1 AND k % 5 = 3 THEN 'app' ELSE 'dir' END AS unit_kind FROM p""",
)(_unit_resolution)
query(
    "hotspot_tree",
    f"{BASE}{hotspot_ctes('entity')}, en AS (SELECT entity AS name, min(repo) AS repo, arg_min(unit, (test, file)) AS unit FROM fl WHERE alive GROUP BY 1), "
    "le AS (SELECT [repo, unit] || string_split(CASE WHEN starts_with(name, unit || '/') THEN name[length(unit) + 2:] ELSE name END, '/') AS parts, loc, score FROM hot JOIN en USING (name) WHERE loc > 0), "
    "no AS (SELECT parts[1:k] AS parts, sum(loc)::BIGINT AS loc, max(score) AS score FROM (SELECT parts, loc, score, unnest(range(1, len(parts) + 1)) AS k FROM le) GROUP BY 1), "
    "ki AS (SELECT parts[1:len(parts) - 1] AS parts, count(*) AS n FROM no WHERE len(parts) > 1 GROUP BY 1), "
    "ke AS (SELECT no.* FROM no LEFT JOIN ki USING (parts) WHERE coalesce(n, 0) <> 1 OR len(no.parts) <= 2), "
    "ab AS (SELECT parts, max_by(up, len(up)) AS above FROM (SELECT parts, unnest(list_transform(range(0, len(parts)), lambda k: parts[1:k])) AS up FROM ke) WHERE up IN (SELECT parts FROM ke) GROUP BY 1) "
    "SELECT array_to_string(ke.parts, '/') AS path, coalesce(array_to_string(above, '/'), '') AS parent, len(ke.parts)::BIGINT AS depth, loc, score FROM ke LEFT JOIN ab USING (parts)",
)(lambda s, d: ov.hotspot_tree(model_of(s, d)))


def owned_model(spark: SparkSession, sf_dir: str) -> Model:
    """The tables' model with each commit by the owner of its first brand, whose number also says whether it mends a defect; thresholds by default."""
    m = model_of(spark, sf_dir)
    owner = m.changes.groupBy("commit_id").agg(F.min(F.regexp_extract("unit", r"(\d+)$", 1).cast("long")).alias("owner"))
    by_owner = lambda d: d.join(owner, "commit_id").withColumns({"author": F.col("owner"), "authors": F.array("owner"), "defect": F.col("owner") % 10 == 1}).drop("owner")
    return replace(m, commits=by_owner(m.commits), changes=by_owner(m.changes), params=Params())


OWNED = (
    BASE.replace("AS file, l_orderkey, l_quantity", "AS file, l_orderkey, p_brand, l_quantity")
    .replace("count(*) AS n_changes FROM raw GROUP BY ALL", "count(*) AS n_changes, min(regexp_extract(p_brand, '(\\d+)$', 1)::BIGINT) AS owner FROM raw GROUP BY ALL")
    .replace("o_custkey AS author", "owner AS author")
    .replace("CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % n END AS co", "NULL::BIGINT AS co")
    .replace(r"regexp_matches(subject, '\b(fix|bugfix)\b') AS defect", "author % 10 = 1 AS defect")
)
_SEVERITY = "round(greatest(1.0, least(100.0, {})))::BIGINT AS severity"
for _kind, _sql in {
    "bus_factor": f"{OWNED}{hotspot_ctes('unit')}{ownership_ctes('unit')}, t AS (SELECT own.main_dev, count(*) AS units, sum(loc) AS loc, avg(own.main_share) AS share FROM hot JOIN own USING (name) WHERE loc >= 1000 AND revisions >= 10 AND recent_authors > 0 AND bus_factor <= 1 AND own.main_share >= 0.6 GROUP BY 1 ORDER BY loc DESC, 1 LIMIT 5) "
    f"SELECT 'bus_factor' AS kind, main_dev::VARCHAR AS subject, {_SEVERITY.format('30 + 25 * share + 4 * log10(loc) + least(units, 5)')} FROM t",
    "defect_magnet": f"{OWNED}{hotspot_ctes('entity')}, bl AS (SELECT repo, round(avg(defect::INT), 4) AS baseline FROM c WHERE NOT format GROUP BY 1), er AS (SELECT entity AS name, min(repo) AS repo FROM fl GROUP BY 1), "
    "t AS (SELECT *, round((defects / revisions::DOUBLE) / greatest(baseline, 0.05), 4) AS ratio FROM hot JOIN er USING (name) JOIN bl USING (repo) WHERE NOT test AND revisions > 0 AND defects >= 5), u AS (SELECT * FROM t WHERE defect_density >= 0.4 AND ratio >= 1.5 ORDER BY ratio * defects DESC, name LIMIT 5) "
    f"SELECT 'defect_magnet' AS kind, name AS subject, {_SEVERITY.format('30 + 20 * least(ratio - 1, 1.5) + 0.5 * least(defects, 30) + 10 * score')} FROM u",
}.items():
    query(f"finding_{_kind}_by_default", _sql)(lambda s, d, rule=fd.RULES[_kind]: rule(fd.Facts(owned_model(s, d))).select("kind", "subject", "severity"))
