import pytest
from pyspark.sql import functions as F

from revlens.functions.components import component_of, constructor_params, links_of
from revlens.operators import metrics as mt
from revlens.operators.findings import bloated_findings, components_of
from revlens.plans.model import Params
from revlens.sources.history import from_history

MILL = """import { Component } from '@angular/core';

@Component({
  selector: 'app-mill',
  templateUrl: './mill.component.html',
  styleUrls: ['./mill.component.scss', "../shared.css"],
})
export class MillComponent {
  grains = input<Grain[]>([]);
  @Input() wheel = 1;
  ground = output<void>();
  private store = inject(Store);
  constructor(a: string);
  constructor(private http: Map<string, number>, /* one, two */ private f: (a: X, b: Y) => void = (a, b) => {}, @Inject(TOKEN, 'a,b') public z?: number,) { super("constructor(a,b)"); this.constructor(1, 2) }
}
"""


def test_component_of(spark):
    rows = [
        ("a/mill.component.ts", MILL, ("component", 4, 2, 1, True, "./mill.component.html", ["./mill.component.scss", "../shared.css"])),
        ("x.guard.ts", "@Injectable()\nclass A { constructor() {} }", ("guard", 0, 0, 0, False, None, [])),
        ("x.resolver.ts", "@Injectable()\nclass A {}", ("resolver", 0, 0, 0, False, None, [])),
        ("x.ts", "@Injectable()\nclass A { constructor(\n  a: B,\n  c: D\n) {} }", ("service", 2, 0, 0, False, None, [])),
        ("y.ts", "export const g: CanMatchFn = () => inject(A);", ("guard", 1, 0, 0, False, None, [])),
        ("i.ts", "export const h: HttpInterceptorFn = f", ("interceptor", 0, 0, 0, False, None, [])),
        ("d.ts", "@Directive({standalone: false, styleUrl: './d.css'})\nclass Q { constructor(){} }\nclass R { constructor(x) { } }", ("directive", 1, 0, 0, False, None, ["./d.css"])),
        ("z.ts", "/**\n * @Component({})\n */\nconst x = 1", None), ("n.ts", None, None), ("e.ts", "", None),
    ]
    d = spark.createDataFrame([r[:2] for r in rows], "path string, text string")
    got = {r["path"]: r["c"] and tuple(r["c"]) for r in d.select("path", component_of(F.col("path"), F.col("text")).alias("c")).collect()}
    assert got == {path: want for path, _, want in rows}
    assert d.filter("path = 'a/mill.component.ts'").select(links_of(component_of(F.col("path"), F.col("text")))).first()[0] == ["./mill.component.html", "./mill.component.scss", "../shared.css"]


@pytest.mark.parametrize(
    ("text", "n"),
    [("constructor(a, b) {", 2), ("constructor(a, b);", 0), ("constructor() {}", 0), ("x.constructor(a) {}", 0), ("constructor(a = '), b', c = `${f(1, 2)}`) {}", 2), ("// constructor(a) {}\nconstructor(/* a, */) {}", 0),
     ("constructor({a, b}: {a: X, b: Y}, [c, d]: Z[], e: () => A<B, C>) {", 3), ("constructor(a", 0), ("myconstructor(a) {}", 0), ('constructor(a = "\\"," ) {}', 1)],
)
def test_constructor_params(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(constructor_params(F.col("t"))).first()[0] == n


def tree_of(spark, **files):
    rows = [("r", p.replace("__", "/"), c if c is None or isinstance(c, bytes) else c.encode()) for p, c in files.items()]
    return spark.createDataFrame(rows, "repo string, path string, content binary")


def test_contents_are_measured_once(spark, tmp_path):
    at = str(tmp_path / "metrics")
    one = tree_of(spark, **{"a.ts": "x = 1\n", "copy/a.ts": "x = 1\n", "same.php": "x = 1\n", "bin.ts": b"a\0b", "big.ts": "y\n" * 5000, "gen.ts": "// @generated\nx\n", "gone.ts": None})
    assert mt.add_metrics(one, at, 4000) == 5 and mt.add_metrics(one, at, 4000) == 0
    assert {(r["lang"], r["state"]) for r in mt.metrics_at(spark, at).collect()} == {("typescript", "text"), ("php", "text"), ("typescript", "binary"), ("typescript", "oversize"), ("typescript", "generated")}
    two = one.unionByName(tree_of(spark, **{"b.ts": MILL, "bin2.ts": b"a\0b"}))
    assert mt.add_metrics(two, at, 4000) == 1
    # A died job: what it wrote stands there twice, and is read once.
    spark.read.parquet(at).write.mode("append").parquet(at)
    got = {r["path"]: r for r in mt.tree_metrics(two, 4000, at).collect()}
    assert len(got) == 9 and got["a.ts"]["blob"] == got["copy/a.ts"]["blob"] and got["gone.ts"]["blob"] is None
    assert got["b.ts"]["component"]["deps"] == 4 and len(got["b.ts"]["links"]) == 3 and got["a.ts"]["health"] == 10 and got["bin2.ts"]["loc"] is None
    plain = {r["path"]: r for r in mt.tree_metrics(two, 4000).collect()}
    assert plain == got


def test_hash_is_that_of_version_control(spark):
    d = spark.createDataFrame([(b"hello\n",), (b"",)], "c binary").select(mt.blob_hash(F.col("c")))
    assert [r[0] for r in d.collect()] == ["ce013625030ba8dba906f756967f9e9ca394464a", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"]


def test_components_reach_the_model(spark, tmp_path):
    """A component's template and style are one entity with it; its dependencies and inputs cost health and are found."""
    busy = MILL.replace("  grains", "".join(f"  @Input() i{k} = 0;\n" for k in range(11)) + "  grains").replace("a: string", "b: string").replace("private http", ", ".join(f"p{k}: P" for k in range(6)) + ", private http")
    paths = ["ui/mill/mill.component.ts", "ui/mill/mill.component.html", "ui/mill/mill.component.scss", "ui/shared.css", "ui/other.ts"]
    log = spark.createDataFrame(
        [("r", k, f"{k:040x}", "Ida", "ida@mill.org", 1000 + k, f"step {k}", [], [f"1\t0\t{p}" for p in paths]) for k in range(3)],
        "repo string, seq long, sha string, author_name string, author_email string, ts long, message string, coauthors array<struct<name:string,email:string>>, lines array<string>",
    )
    tree = tree_of(spark, **dict(zip(paths, (busy, "<p>\n", ".a {}\n", ".b {}\n", "x\n"), strict=True)))
    cache = str(tmp_path / "cache")
    m = from_history(log, tree, Params(), cache=cache)
    f = {r["path"]: r for r in m.files.collect()}
    assert {f[p]["entity"] for p in paths[:4]} == {"r:ui/mill/mill.component"} and f[paths[4]]["entity"] == "r:ui/other"
    assert f[paths[0]]["entity_kind"] == "component" and (f[paths[0]]["deps"], f[paths[0]]["inputs"], f[paths[0]]["health"]) == (10, 13, 8.0)
    assert len(f[paths[0]]["health_reasons"]) == 2 and f[paths[4]]["health_reasons"] == []
    assert mt.add_metrics(tree, cache, Params().max_file_bytes) == 0
    assert [tuple(r) for r in components_of(m).collect()] == [("r:ui/mill/mill.component", 10, 13, None)]

    class Facts:
        entities = spark.createDataFrame([(1, "r:ui/mill/mill.component", 0.4)], "rank int, name string, score double")

    assert [(r["subject"], r["severity"]) for r in bloated_findings(Facts(), components_of(m)).collect()] == [("r:ui/mill/mill.component", 60)]
