import random
import subprocess

from pyspark.sql import functions as F

from revlens.operators import cleaning, resolution
from revlens.plans.model import Params
from revlens.sources.gitlog import append_new, dump_log, follow_renames, log_changes, read_log, replace_repos
from revlens.sources.history import from_history, people_of

RECORD = "\x1e{}\x1f{}\x1f{}\x1f{}\x1f{}\x1f\n{}\n"


def record(n, who, ts, message, *lines):
    return RECORD.format(f"{n:040x}", who, f"{who.lower()}@mill.org", ts, message, "\n".join(lines))


def written(tmp_path, name, *records):
    (tmp_path / name).write_text("".join(records))
    return str(tmp_path / name)


def test_log_and_renames(spark, tmp_path):
    """Two commits of one second keep the log's order; a path comes back after its file moved away."""
    log = written(
        tmp_path, "log",
        record(1, "Ida", 50, "start\n\nCo-authored-by: Olaf Berg <olaf@mill.org>", "4\t0\tgrain/rye.ts", "-\t-\tsack.png"),
        record(2, "Olaf", 50, "move", "1\t1\tgrain/{ => whole}/rye.ts"),
        record(3, "Ida", 50, "new one", "9\t0\tgrain/rye.ts", '2\t0\t"caf\\303\\251.ts"'),
        record(4, "Ida", 60, "again", "3\t2\tgrain/whole/rye.ts", "5\t0\told.ts => flour/new.ts"),
    )
    got = read_log(spark, log, "mill")
    rows = got.orderBy("seq").collect()
    assert [int(r["sha"], 16) for r in rows] == [1, 2, 3, 4] and rows[0]["message"].startswith("start") and [tuple(c) for c in rows[0]["coauthors"]] == [("Olaf Berg", "olaf@mill.org")]
    followed = follow_renames(log_changes(got), got.select("repo", "sha", "seq"))
    assert sorted((r["seq"] - rows[0]["seq"], r["path"], r["file_id"], r["added"]) for r in followed.collect())[:2] == [(0, "grain/rye.ts", "grain/rye.ts", 4), (0, "sack.png", "sack.png", 0)]
    ids = {(int(r["sha"], 16), r["path"]): r["file_id"] for r in followed.collect()}
    assert ids[2, "grain/whole/rye.ts"] == ids[4, "grain/whole/rye.ts"] == "grain/rye.ts" and ids[4, "flour/new.ts"] == "old.ts" and (3, "café.ts") in ids


def folded(rows):
    """A number for each row's file, by a plain fold over (path, old_path)."""
    ids, out = {}, []
    for path, old in rows:
        if old is not None:
            ids[path] = ids.pop(old, len(out) * 2 + 1)
        out.append(ids.setdefault(path, len(out) * 2))
    return out


def test_renames_against_a_fold(spark):
    """Random histories of few paths, which files leave and come back to, also over others and from paths never seen."""
    rnd = random.Random(6)
    rows, want = [], {}
    for repo in range(12):
        history = []
        for k in range(60):
            path = rnd.choice("abcde")
            old = rnd.choice("abcdef") if rnd.random() < 0.4 else None
            history.append((path, old if old != path else None))
            rows.append((f"r{repo}", f"c{k // 3}", k % 3, *history[-1]))
        for k, f in enumerate(folded(history)):
            want.setdefault((f"r{repo}", f), set()).add((f"c{k // 3}", k % 3))
    changes = spark.createDataFrame(rows, "repo string, sha string, pos int, path string, old_path string")
    order = spark.createDataFrame([(f"r{r}", f"c{k}", k) for r in range(12) for k in range(20)], "repo string, sha string, seq long")
    got = {}
    for r in follow_renames(changes, order).collect():
        got.setdefault((r["repo"], r["file_id"]), set()).add((r["sha"], r["pos"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and {r for r, _ in got} == {r for r, _ in want}
    assert {f for _, f in got} >= {"a", "b", "a#2"} and follow_renames(changes.limit(0), order).count() == 0


def test_log_of_a_repository(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=Ida", "-c", "user.email=ida@mill.org", *a], check=True, capture_output=True)
    (tmp_path / "r").mkdir()
    git("init", "-q")
    for k in range(3):
        (tmp_path / "r" / "a.ts").write_text("x\n" * (k + 1))
        git("add", ".")
        git("commit", "-q", "-m", f"step {k}")
    rows = read_log(spark, dump_log(str(tmp_path / "r"), str(tmp_path / "out.log")), "r").orderBy("seq").collect()
    assert [r["message"] for r in rows] == ["step 0", "step 1", "step 2"] and rows[0]["author_name"] == "Ida"
    assert [(r["created"], r["removed"]) for r in rows] == [(["a.ts"], []), ([], []), ([], [])]
    git("rm", "-q", "a.ts")
    (tmp_path / "r" / "caf\u00e9 b.ts").write_text("x")
    git("add", ".")
    git("commit", "-q", "-m", "last")
    last = read_log(spark, dump_log(str(tmp_path / "r"), str(tmp_path / "out.log")), "r").orderBy(F.desc("seq")).first()
    assert (last["created"], last["removed"]) == (["caf\u00e9 b.ts"], ["a.ts"])


def test_append_and_replace(spark, tmp_path):
    at = str(tmp_path / "table")
    rows = lambda *xs: spark.createDataFrame(xs, "repo string, sha string, n int")
    assert append_new(spark, rows(("a", "1", 1), ("a", "2", 1), ("a", "2", 1), ("b", "1", 1)), at, ["repo", "sha"]).count() == 3
    assert append_new(spark, rows(("a", "2", 9), ("a", "3", 2)), at, ["repo", "sha"]).count() == 4
    replace_repos(rows(("a", "7", 7)), at)
    assert sorted((r["repo"], r["sha"]) for r in spark.read.parquet(at).collect()) == [("a", "7"), ("b", "1")]


def test_globs_and_attributes(spark):
    globs = {"**/*.map": ["a.map", "x/y.map"], "docs/*.md": ["docs/a.md"], "gen/**": ["gen/a", "gen/b/c"], "**/*.{png,jpg}": ["p.jpg"], "a?c.ts": ["abc.ts"], "x+y/(z).ts": ["x+y/(z).ts"]}
    names = sorted({n for ns in globs.values() for n in ns} | {"a.map.ts", "docs/b/a.md", "regen/a", "p.jpeg", "a/c.ts", "xxy/z.ts", "ppng"})
    d = spark.createDataFrame([(n,) for n in names], "path string").crossJoin(spark.createDataFrame([(g,) for g in globs], "glob string"))
    got = d.filter(F.regexp_like("path", cleaning.glob_regex(F.col("glob")))).collect()
    assert sorted((r["glob"], r["path"]) for r in got) == sorted((g, n) for g, ns in globs.items() for n in ns)
    attributes = "# note\n*.pb.ts linguist-generated\n/api/ linguist-vendored=true\nlib/old.js  linguist-vendored\n*.ts text\nx.ts linguist-generated=false\n\"q.ts\" linguist-generated\n"
    a = spark.createDataFrame([("r", "", attributes), ("r", "sub", "*.x linguist-generated"), ("s", None, None)], "repo string, dir string, text string")
    assert sorted(r["glob"] for r in cleaning.attribute_excludes(a).collect()) == ["**/*.pb.ts", "api/**", "lib/old.js", "sub/**/*.x"]
    f = spark.createDataFrame([(r, p) for r in ("r", "s") for p in ("a.pb.ts", "api/v.ts", "web/node_modules/m.js", "ok.ts")], "repo string, path string")
    left = cleaning.without_excluded(f, cleaning.attribute_excludes(a)).collect()
    assert sorted((r["repo"], r["path"]) for r in left) == [("r", "ok.ts"), ("s", "api/v.ts"), ("s", "ok.ts")]  # the second by the default globs alone


def test_unwanted_files(spark):
    rows = [("r", "a.ts", b"x = 1\n"), ("r", "b.ts", b"x\0y"), ("r", "c.ts", b"// @generated\nx"), ("r", "d.ts", b"y\n" * 600_000), ("r", "gone.ts", None), ("r", "e.ts", b"z" * 8001 + b"\n\0")]
    d = cleaning.clean_files(spark.createDataFrame(rows, "repo string, path string, content binary"))
    assert {r["path"]: r["text"] for r in d.collect()} == {"a.ts": "x = 1\n", "gone.ts": None}


def test_units_and_entities(spark):
    paths = ["apps/shop/src/a.ts", "apps/shop-x/b.ts", "tools/gen/c.ts", "src/app/cart/d.ts", "e.ts", "special/f.ts"]
    f = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    manual = spark.createDataFrame([("r", 1, "special/**", "by hand", "x"), ("r", 2, "**/f.ts", "later", "x"), ("s", 0, "**", "other", "x")], "repo string, place int, glob string, unit string, kind string")
    roots = spark.createDataFrame([("r", "apps/shop", "shop", "app"), ("r", "apps", "apps", "dir"), ("r", "", "top", "x")], "repo string, root string, unit string, kind string")
    got = {r["path"]: r["unit"] for r in resolution.resolve_units(f, manual, roots).collect()}
    assert got == {paths[0]: "shop", paths[1]: "apps", paths[2]: "tools", paths[3]: "src/app/cart", paths[4]: "(root)", paths[5]: "by hand"}
    assert {r["path"]: r["unit"] for r in resolution.resolve_units(f, manual.limit(0), roots.limit(0), 2).collect()}[paths[3]] == "src/app"
    schema = "repo string, path string, file int, alive boolean, test boolean, lang string, unit string, links array<string>, component string"
    rows = [("r", "ui/box/box.spec.ts", 1, True, True, "typescript", "t", [], None), ("r", "ui/box/box.ts", 2, True, False, "typescript", "u", ["./view/look.html", "../shared.scss"], "component")]
    rows += [("r", "ui/box/view/look.html", 3, True, False, "template", "v", [], None), ("r", "ui/shared.scss", 4, True, False, "scss", "w", [], None), ("r", "ui/lone.html", 5, True, False, "template", "w", [], None)]
    e = {r["file"]: (r["entity"], r["entity_kind"], r["entity_unit"]) for r in resolution.group_entities(spark.createDataFrame(rows, schema)).collect()}
    assert e == {**{k: ("ui/box/box", "component", "u") for k in (1, 2, 3, 4)}, 5: ("ui/lone", "template", "w")}


def test_paths_are_found(spark):
    f = spark.createDataFrame([("r", "a/x.ts", 1, False), ("r", "a/x.ts", 2, True), ("r", "b/y.ts", 3, True), ("r", "c/y.ts", 4, True), ("r", "d/z.ts", 5, True)], "repo string, path string, file int, alive boolean")
    assert {r["path"]: r["file"] for r in resolution.path_index(f).collect()}["a/x.ts"] == 2
    w = spark.createDataFrame([("./a/x.ts",), ("z.ts",), ("y.ts",), ("b/y.ts",), ("no.ts",)], "asked string")
    assert {r["asked"]: r["file"] for r in resolution.find_file(f, w).collect()} == {"./a/x.ts": 2, "z.ts": 5, "b/y.ts": 3}
    two = f.unionByName(spark.createDataFrame([("s", "b/y.ts", 7, True), ("s", "only.ts", 8, True)], f.schema))
    roots = spark.createDataFrame([("r", "/home/r/"), ("s", "/home/r/sub")], "repo string, root string")
    asked = [("/home/r/b/y.ts", None), ("/home/r/sub/b/y.ts", None), ("/home/r/sub/b/y.ts", "r"), ("b/y.ts", "s"), ("y.ts", "s"), ("b/y.ts", None), ("only.ts", "r"), ("/only.ts", None)]
    got = {(r["asked"], r["repo"]): r["file"] for r in resolution.find_file(two, spark.createDataFrame(asked, "asked string, repo string"), roots).collect()}
    assert got == {("/home/r/b/y.ts", None): 3, ("/home/r/sub/b/y.ts", None): 7, ("b/y.ts", "s"): 7, ("y.ts", "s"): 7, ("b/y.ts", None): 3}
    tree = spark.createDataFrame([("r", "d/z.ts", "h1"), ("r", "new.ts", "h2")], "repo string, path string, blob string")
    assert {(r["path"], r["alive"]) for r in resolution.alive_snapshot(f.drop("file").distinct(), tree).collect()} == {("a/x.ts", False), ("b/y.ts", False), ("c/y.ts", False), ("d/z.ts", True), ("new.ts", True)}
    j = spark.createDataFrame([("a/b", "../c/./d.ts"), ("", "x.ts"), ("a", "../../up.ts")], "dir string, rel string").select(resolution.joined_path(F.col("dir"), F.col("rel")))
    assert [r[0] for r in j.collect()] == ["a/c/d.ts", "x.ts", "up.ts"]
    assert [r[0] for r in spark.createDataFrame([("p/q/cart.service.spec.ts",)], "x string").select(resolution.stem(F.col("x"))).collect()] == ["cart.service"]


def test_history_becomes_a_model(spark, tmp_path):
    """From a log and a tree to commits, files and people: a file that moved is one file, the bot and the lock file are out."""
    log = written(
        tmp_path, "log",
        record(1, "Ida", 1000, "MILL-1 fix wheel\n\nCo-authored-by: Olaf <olaf@mill.org>", "4\t0\tsrc/wheel.ts", "900\t0\tyarn.lock"),
        record(2, "Olaf", 2000, "move", "1\t1\tsrc/{wheel.ts => axle.ts}"),
        record(3, "renovate", 3000, "update", "1\t1\tsrc/axle.ts"),
        record(4, "Ida", 4000, "lock", "1\t1\tyarn.lock"),
    )
    tree = spark.createDataFrame([("mill", "src/axle.ts", bytearray(b"a\n  b\n")), ("mill", "yarn.lock", bytearray(b"x"))], "repo string, path string, content binary")
    read = read_log(spark, log, "mill")
    m = from_history(read, tree, Params(), teams=spark.createDataFrame([("stone", "ida@mill.org")], "team string, member string"))
    assert [(r["file"], r["entity"], r["unit"], r["alive"], r["loc"]) for r in m.files.collect()] == [("mill:src/wheel.ts", "mill:src/axle", "mill:src", True, 2)]
    c = sorted((r["ts"], r["defect"], r["tickets"], len(r["authors"])) for r in m.commits.collect())
    assert c == [(1000, True, ["MILL-1"], 2), (2000, False, [], 1)]
    assert m.changes.count() == 2 and {r["team"] for r in m.active().collect()} == {"stone", None}
    assert people_of(read).filter("bot").count() == 1
