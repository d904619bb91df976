import math

import pytest
from pyspark.sql import functions as F

from revlens.functions import health, paths, text
from revlens.functions.numeric import decay, duration_seconds, with_percentile, with_rank


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_decay(spark):
    ages = [7.5, 30.0, 91.0, -3.0]
    want = [2 ** -(max(a, 0) / 30) for a in ages]
    assert column(spark, [a * 86_400 for a in ages], lambda x: decay(x, 30.0), "double") == pytest.approx(want)
    assert column(spark, [1e9], lambda x: decay(x, 0.0), "double") == [1]


def test_percentiles_and_ranks_by_brute_force(spark):
    rows = [(f"g{i % 3}", (i * 37) % 11 if i % 13 else None, i) for i in range(200)] + [("alone", 4, 200)]
    d = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    key = lambda v: -math.inf if v is None else v
    for r in with_percentile(d, "p", "x", "g").collect():
        group = [key(x) for g, x, _ in rows if g == r["g"]]
        below, same = sum(x < key(r["x"]) for x in group), sum(x == key(r["x"]) for x in group)
        assert r["p"] == pytest.approx(1.0 if len(group) == 1 else (below + (same - 1) / 2) / (len(group) - 1))
    got = {r["i"]: r["k"] for r in with_rank(d, "k", F.desc("x"), F.asc("i")).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda r: r[1])] == [i for _, x, i in sorted(rows, key=lambda r: (-key(r[1]), r[2]))]
    assert with_rank(d.limit(0), "k", F.asc("x")).count() == 0 and with_percentile(d.limit(0), "p", "x").count() == 0


def test_durations():
    assert duration_seconds("3 weeks") == 21 * 86_400 and duration_seconds("0.5y") == 182.625 * 86_400 and duration_seconds("all") is None


def test_paths(spark):
    names = ["lib/oven/oven.service.spec.ts", ".babelrc", "a/helpers/index.js", "web/x.stories.tsx", "e2e/y.php"]
    assert column(spark, names, paths.entity_key) == ["lib/oven/oven.service", ".babelrc", "a/helpers/index", "web/x", "e2e/y"]
    assert column(spark, names, paths.is_test_path) == [True, False, False, True, True]
    assert column(spark, names, paths.short_name)[2] == "helpers/index.js"
    assert column(spark, ["x.ts", "libs/bread/rye/a.ts", "src/app/lib/js/ts/deep/b.ts"], paths.fallback_unit) == ["(root)", "libs/bread", "src/app/lib/js/ts"]
    assert column(spark, ["a.MTS", "b.blade.php", "c.neon", "Dockerfile"], paths.language) == ["typescript", "other", "data", "other"]


def test_text_metrics(spark):
    texts = ["for a\n    b\n        c\n", "", "a\n\t\tb\n\n"]
    assert column(spark, texts, paths.indent_complexity) == [3.0, 1.0, 1.0]
    assert column(spark, texts, paths.non_blank_lines) == [3, 0, 2]
    assert column(spark, ["/* DO NOT EDIT */\nx", "y" * 500, "plain"], paths.is_generated) == [True, True, False]


def test_texts_of_reports(spark):
    assert column(spark, ["bread", "breads", ""], lambda x: text.truncated(x, 5)) == ["bread", "brea…", ""]
    assert column(spark, [["a", "b"], ["a", "b", "c", "d"], []], lambda x: text.listed(x, 2), "array<string>") == ["a, b", "a, b and 2 more", ""]
    assert column(spark, ["0123456789abcdef"], text.short_sha) == ["01234567"]
    hunks = [r and tuple(r) for r in column(spark, ["@@ -7,3 +8,0 @@ f()", "@@ -1 +2 @@", "+ line"], text.hunk)]
    assert hunks == [(7, 3, 8, 0), (1, 1, 2, 1), None]
    quoted = ['"caf\\303\\251/a\\tb \\"q\\" \\\\.ts"', "plain.ts  ", '"', '"\\7x"']
    assert column(spark, quoted, text.unquoted) == ['café/a\tb "q" \\.ts', "plain.ts", '"', "\x07x"]


def test_health(spark):
    schema = "lang string, generated boolean, functions array<struct<name:string,cc:int,loc:int>>, max_nesting int, loc int, deps int, inputs int, complexity double, methods int"
    rows = [
        ("typescript", False, [("f", 25, 90), ("g", 3, 10)], 5, 700, 8, None, 50.0, None),  # 2 + 0.5 + 1 + 1 + 1
        ("typescript", True, [("f", 99, 900)], 9, 9000, 99, 99, 50.0, None),
        ("php", False, [("f", 60, 10), ("g", 60, 10)], 7, 1600, None, None, 9.0, 30),  # 5 + 1.5 + 2 + 1, at most 9
        ("template", False, [], 2, 10, None, None, 55.0, None),  # 3 at most
        ("data", False, [], 9, 9000, None, None, 1.0, None),
        ("scss", None, None, None, None, None, None, None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(health.health()).collect()]
    assert [r["health"] for r in got] == [4.5, 10.0, 1.0, 7.0, 10.0, 10.0]
    assert got[0]["reasons"] == ["1 complex function (cc > 15); worst `f` cc 25", "1 long function (> 80 lines); longest `f` 90 lines", "deep nesting (depth 5)", "large file (700 lines)", "8 injected dependencies (> 7)"]
    assert got[2]["reasons"][0].startswith("2 complex functions") and got[1]["reasons"] == []
