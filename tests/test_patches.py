import subprocess
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from revlens.operators.diff import diff_functions
from revlens.operators.trends import BINS, FEW, TOP_LEVEL, commit_functions, function_changes, function_coupling, function_history, function_hotspots, innermost
from revlens.plans.model import Model
from revlens.sources.gitlog import dump_log, read_log
from revlens.sources.history import from_history
from revlens.sources.patches import dump_diff, dump_patches, read_patches


@pytest.fixture
def repo(tmp_path):
    """A repository, and a function that writes files (None: gone) and commits them."""
    root = tmp_path / "r"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ida", "-c", "user.email=ida@mill.org", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q", "-b", "main")

    def commit(message, **files):
        for name, text in files.items():
            at = root / name.replace("__", "/")
            at.parent.mkdir(exist_ok=True)
            at.unlink() if text is None else at.write_bytes(text if isinstance(text, bytes) else text.encode())
        git("add", "-A")
        git("commit", "-q", "-m", message)
        return git("rev-parse", "HEAD").strip()

    return root, git, commit


def mill(turns, name="f"):
    """Twenty lines: a function of so many turns in lines 3 and on, another in the last three."""
    body = "".join(f"  turn({k});\n" for k in range(turns))
    return f"// mill\n\nfunction {name}() {{\n{body}}}\n" + "\n" * (13 - turns) + "function g() {\n  stop();\n}\n"


def functions_of(turns):
    return [("f", 3, 4 + turns), ("g", 18, 20)]


def test_patches_of_a_repository(spark, repo, tmp_path):
    root, git, commit = repo
    tricky = "--- a/no.ts\n+++ b/no.ts\n@@ -1 +1 @@ text\ndiff --git a/x b/x\nindex 00..11\r"
    s1 = commit("one", **{"a.ts": mill(2), "odd.txt": "x\n", "bin.dat": b"\0\1\2", "café b.ts": "y\n"})
    s2 = commit("two", **{"a.ts": mill(5), "odd.txt": f"x\n{tricky}\n", "café b.ts": "z\n"})
    git("mv", "a.ts", "b b.ts")
    s3 = commit("three", **{"b b.ts": mill(6), "odd.txt": None, "bin.dat": b"\0\2\2"})
    got = {(r["sha"], r["path"]): r for r in read_patches(spark, dump_patches(str(root), str(tmp_path / "p")), "r").collect()}
    assert {k: (r["status"], r["added"], r["deleted"], r["old_path"]) for k, r in got.items()} == {
        (s1, "a.ts"): ("added", 20, 0, None), (s1, "odd.txt"): ("added", 1, 0, None), (s1, "bin.dat"): ("added", 0, 0, None), (s1, "café b.ts"): ("added", 1, 0, None),
        (s2, "a.ts"): ("modified", 3, 3, None), (s2, "odd.txt"): ("modified", 5, 0, None), (s2, "café b.ts"): ("modified", 1, 1, None),
        (s3, "b b.ts"): ("renamed", 1, 1, "a.ts"), (s3, "odd.txt"): ("deleted", 0, 6, None), (s3, "bin.dat"): ("modified", 0, 0, None),
    }
    assert got[s2, "a.ts"]["new_blob"] == git("rev-parse", f"{s2}:a.ts").strip() == got[s3, "b b.ts"]["old_blob"] and got[s1, "a.ts"]["old_blob"] is None
    d = read_patches(spark, dump_diff(str(root), str(tmp_path / "d"), s1, s3), "r").collect()
    assert {(r["path"], r["status"]) for r in d} == {("b b.ts", "renamed"), ("odd.txt", "deleted"), ("bin.dat", "modified"), ("café b.ts", "modified")}
    assert {r["sha"] for r in d} == {f"{s1}..{s3}"}


def test_functions_of_a_history(spark, repo, tmp_path):
    """Fifteen revisions of f across a rename, each with its ticket; g is touched once, and once a line outside of both."""
    root, git, commit = repo
    rows, turns = [], [*range(1, 12), 9, 8, 7]
    for k, n in enumerate(turns):
        commit(f"MILL-{k} turn", **{"a.ts": mill(n), "b.ts": f"{k}\n"})
        rows += [(git("rev-parse", "HEAD:a.ts").strip(), *f) for f in functions_of(n)]
    git("mv", "a.ts", "c.ts")
    commit("MILL-90 move", **{"c.ts": mill(3)})
    rows += [(git("rev-parse", "HEAD:c.ts").strip(), *f) for f in functions_of(3)]
    last = mill(3).replace("stop", "halt").replace("// mill", "// the mill")
    commit("fix the end", **{"c.ts": last})
    rows += [(git("rev-parse", "HEAD:c.ts").strip(), *f) for f in functions_of(3)]
    functions = spark.createDataFrame(rows, "blob string, fn string, start int, end int").distinct()
    changes = function_changes(read_patches(spark, dump_patches(str(root), str(tmp_path / "p")), "r"), functions)
    final = git("rev-parse", "HEAD").strip()
    assert {(r["fn"], r["added"], r["deleted"]) for r in changes.filter((F.col("sha") == final) & (F.col("path") == "c.ts")).collect()} == {("g", 1, 1), (TOP_LEVEL, 1, 1)}
    tree = spark.createDataFrame([("r", "c.ts", bytearray(last.encode())), ("r", "b.ts", bytearray(b"13\n"))], "repo string, path string, content binary")
    model = from_history(read_log(spark, dump_log(str(root), str(tmp_path / "l")), "r"), tree)
    history = function_history(model, changes)
    cc = spark.createDataFrame([("r:a.ts", "f", 4), ("r:a.ts", "g", 1)], "file string, fn string, cc int")
    got = {r["fn"]: r for r in function_hotspots(history, cc).collect()}
    assert (got["f"]["revisions"], got["g"]["revisions"], got["g"]["defects"], got["f"]["authors"]) == (len(turns) + 1, 2, 1, 1)
    added = sum(max(b - a, 0) for a, b in pairwise([-2, *turns, 3]))
    assert got["f"]["churn"] >= added and got["f"]["score"] > got["g"]["score"]
    assert function_coupling(history.filter(F.col("fn") != TOP_LEVEL), min_support=1, min_confidence=0.1).count() == 1  # the first commit has both


def test_innermost_with_many_ranges_of_one_key(spark):
    """Fifty thousand ranges of one key, some around many others: a line meets those near it."""
    n = 50_000
    ranges = spark.range(n).select(F.lit("k").alias("key"), F.concat(F.lit("f"), "id").alias("fn"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + F.when(F.col("id") % 100 == 0, 995).when(F.col("id") % 10 == 0, 95).otherwise(7)).alias("end"))
    ranges = ranges.unionByName(spark.createDataFrame([("k", "all", 0, 10 * n), ("k", "none", 9, 3), ("other", "x", 0, 5)], "key string, fn string, start long, end long"))
    lines = spark.range(0, 10 * n, 7).select(F.lit("k").alias("key"), F.col("id").alias("line"), (F.col("id") % 2).alias("odd")).unionByName(spark.createDataFrame([("k", 10 * n + 1, 0), ("gone", 4, 0)], "key string, line long, odd long"))
    lines = lines.unionByName(lines.limit(50))
    got = innermost(lines, ranges, "odd")

    def expected(x):
        return f"f{x // 10}" if x % 10 <= 7 and x // 10 % 10 else f"f{x // 100 * 10}" if x % 100 <= 95 and x // 100 % 10 else f"f{x // 1000 * 100}" if x % 1000 <= 995 else "all"

    rows = got.collect()
    assert len(rows) == len(range(0, 10 * n, 7)) + 2
    for r in rows:
        assert r["fn"] == (TOP_LEVEL if r["key"] == "gone" or r["line"] > 10 * n else expected(r["line"])), r
    assert BINS[0] < 95 < BINS[1] and "fn" in got.columns


def test_ranges_are_not_broadcast(spark):
    """Exploded ranges look small to the planner: they are merged, and equal rows with the same line are answered once."""
    lines = spark.range(40).selectExpr("concat('k', id % 4) key", "id % 5 line", "id % 2 side")
    ranges = spark.range(4).selectExpr("concat('k', id) key", "explode(array(named_struct('fn', 'out', 'start', 0L, 'end', 3L), named_struct('fn', 'in', 'start', 1L, 'end', 2L))) r").selectExpr("key", "r.*")
    found = innermost(lines, ranges, "side")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["line"], r["fn"]) for r in found.collect()} == {(0, "out"), (1, "in"), (2, "in"), (3, "out"), (4, TOP_LEVEL)} and found.count() == 20
    cc = ranges.selectExpr("key blob", "fn", "start", "end", "1 cc")
    files = lines.selectExpr("'c' change", "'r' repo", "key path", "key old_blob", "key new_blob").distinct()
    assert "Broadcast" not in diff_functions(files, cc)._jdf.queryExecution().executedPlan().toString()


HUNKS = "repo string, sha string, path string, old_blob string, new_blob string, hunks array<struct<old_start:int,old_count:int,new_start:int,new_count:int>>"


def test_hunks_meet_functions_without_being_lines(spark):
    """Hunks that overlap, a file that stands twice in a patch, contents with few and with many functions, none, and no content: each line once."""
    few = [("out", 1, 60), ("in", 10, 20), ("deep", 12, 13), ("twin", 12, 13), ("late", 50, 70), ("wrong", 9, 3)]
    many = [(f"f{k}", 3 * k, 3 * k + k % 7) for k in range(FEW + 50)]
    functions = spark.createDataFrame([(b, *f) for b, fs in (("few", few), ("many", many)) for f in fs], "blob string, fn string, start int, end int")
    rows = [
        ("r", "s1", "a", "few", "many", [(5, 10, 2, 90), (12, 3, 80, 30), (0, 0, 500, 0)]), ("r", "s1", "a", "few", "many", [(1, 6, 100, 40), (55, 30, 900, 5)]),
        ("r", "s2", "a", "many", "few", [(1, 400, 1, 100)]), ("r", "s2", "b", None, "gone", [(3, 2, 1, 4)]), ("q", "s2", "b", "few", "few", [(71, 1, 12, 1)]), ("q", "s3", "b", "few", None, []),
    ]
    want, of = {}, {"few": few, "many": many}
    for repo, sha, path, key, new, line in {(r, s, p, b, n, x) for r, s, p, old, to, hs in rows for h in hs for b, n, start, count in ((old, False, *h[:2]), (to, True, *h[2:])) for x in range(start, start + count)}:
        fn = min(((e - b, f) for f, b, e in of.get(key, []) if b <= line <= e), default=(0, TOP_LEVEL))[1]
        want.setdefault((repo, sha, path, fn), [0, 0])[0 if new else 1] += 1
    got = function_changes(spark.createDataFrame(rows, HUNKS), functions)
    assert got.columns == ["repo", "sha", "path", "fn", "added", "deleted"]
    assert {tuple(r)[:4]: list(r)[4:] for r in got.collect()} == want


def test_a_hunk_of_two_billion_lines(spark):
    """It is a run of lines and never as many rows."""
    n = 2_147_483_000
    functions = spark.createDataFrame([("k", "f", 11, 20)], "blob string, fn string, start int, end int")
    got = function_changes(spark.createDataFrame([("r", "s", "a", None, "k", [(0, 0, 1, n)])], HUNKS), functions)
    assert {(r["fn"], r["added"], r["deleted"]) for r in got.collect()} == {("f", 10, 0), (TOP_LEVEL, n - 10, 0)}


def test_functions_of_a_commit_stay_where_it_is(spark):
    """Rows of functions are dealt by commit once, people are counted where a function's rows are: no shuffle for the join, for a commit's rows or for people."""
    files = spark.createDataFrame([("r", f"s{k % 9}", f"p{k}", "k", "k", [(1, 2, 1, 3)]) for k in range(30)], HUNKS)
    functions = spark.createDataFrame([("k", "f", 1, 2)], "blob string, fn string, start int, end int")
    commits = spark.range(9).selectExpr("concat('r:s', id) commit_id", "id * 86400 ts", "864000L now", "id % 2 = 0 defect", "1.0D weight", "array(id % 3, 7L) authors")
    model = Model(commits, None, None, None)
    got = function_hotspots(function_history(model, commit_functions(files, functions)), spark.range(30).selectExpr("concat('p', id) file", "'f' fn", "5 cc"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(commit_id") == 1 and "fn#" in plan and plan.count("Exchange hashpartitioning(author") == 0
    rows = {r["file"]: r for r in got.collect()}
    assert len(rows) == 30 and all((r["revisions"], r["churn"], r["authors"], r["defects"]) == (1, 4, 2, int(f[1:]) % 9 % 2 == 0) for f, r in rows.items())
