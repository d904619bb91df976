from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from revlens.operators import coupling as cp
from revlens.operators import findings as fd
from revlens.operators import diff as df
from revlens.operators import overview as ov
from revlens.operators import social as so
from revlens.operators.coupling import anchored_sessions, coupling
from revlens.operators.hotspots import history, hotspots, once_a_commit, scored
from revlens.operators.identity import resolve
from revlens.operators.levels import history_of_levels, ownership_of_levels, people_of_levels
from revlens.operators.social import ownership
from revlens.operators.trends import classify, function_hotspots, innermost
from revlens.plans.model import Params, Scope, build
from revlens.sources.tables import from_tables

NOW, DAY = 1_700_000_000, 86_400
FILES = "file string, entity string, unit string, repo string, alive boolean, test boolean, lang string, lang_weight double, loc long, complexity double, health double"
COMMITS = "commit_id string, repo string, ts long, author long, coauthors array<bigint>, message string"


def make(spark, commits, files, params, bots=(), staged=False):
    """commits: (id, repo, days ago, author, message, files); files: (file, repo, complexity, test, lang)."""
    rows = [(i, r, NOW - int(d * DAY), a, [], m) for i, r, d, a, m, _ in commits]
    changes = [(i, f, 6, 1) for i, _, _, _, _, fs in commits for f in fs]
    about = [(f, f.rsplit(".", 1)[0].removesuffix(".spec"), f"{r}/{f[:2]}", r, True, t, lang, 1.0, 50, float(x), 6.0) for f, r, x, t, lang in files]
    people = sorted({a for _, _, _, a, _, _ in commits})
    return build(
        spark.createDataFrame(rows, COMMITS), spark.createDataFrame(changes, "commit_id string, file string, added long, deleted long"), spark.createDataFrame(about, FILES),
        spark.createDataFrame([(a, f"team{a % 2}") for a in people], "author long, team string"), spark.createDataFrame([(b,) for b in bots], "author long"), params, staged,
    )


@pytest.fixture(scope="module")
def bakery(spark):
    """The oven's dough and yeast change together eight times, the till's receipt follows in six tickets, the cellar is an old hand's own."""
    commits = [(f"d{i}", "oven", 8 * i, 10, f"BAKE-{i} {'fix' if i % 2 else 'add'} rising", ["dough.ts", "yeast.ts"]) for i in range(1, 9)]
    commits += [(f"e{i}", "oven", 70 + i, 11, "knead longer", ["dough.ts"]) for i in range(2)]
    commits += [(f"r{i}", "till", 8 * i - 0.1, 20, f"BAKE-{i} print it", ["receipt.php"]) for i in range(1, 7)]
    commits += [(f"c{i}", "oven", 900 - i, 30, "shelves", ["cellar.ts"]) for i in range(5)]
    commits += [(f"t{i}", "oven", 8 * i + 0.5, 10, "check rising", ["dough.ts", "dough.spec.ts", "oven.json"]) for i in range(1, 7)]
    commits += [("big", "oven", 5, 11, "move all", [f"x{k}.ts" for k in range(11)]), ("rel", "oven", 4, 11, "chore: release 2.0", ["dough.ts"]), ("bot", "oven", 0, 99, "bump", ["dough.ts"])]
    files = [("dough.ts", "oven", 40, False, "typescript"), ("yeast.ts", "oven", 9, False, "typescript"), ("receipt.php", "till", 12, False, "php"), ("cellar.ts", "oven", 3, False, "typescript")]
    files += [("dough.spec.ts", "oven", 2, True, "typescript"), ("oven.json", "oven", 1, False, "data")] + [(f"x{k}.ts", "oven", 1, False, "typescript") for k in range(11)]
    return make(spark, commits, files, Params(max_commit_files=10, min_lift=1.0, shotgun_average=0.5), bots=[99], staged=True)


def test_commits_are_classified(bakery):
    c = {r["commit_id"]: r for r in bakery.commits.collect()}
    assert "bot" not in c and c["big"]["mega"] and not c["big"]["couples"] and c["rel"]["format"] and c["rel"]["weight"] == 0
    assert c["d1"]["defect"] and not c["d2"]["defect"] and c["d3"]["tickets"] == ["BAKE-3"] and {r["now"] for r in c.values()} == {NOW - 4 * DAY}


def test_changes_meet_their_commits_first(spark):
    """What files have is the widest and joins last, so that it is not shuffled by commit."""
    m = make(spark, [("a", "r", 1, 1, "fix", ["x.ts", "y.ts"]), ("b", "r", 2, 2, "add", ["y.ts"])], [("x.ts", "r", 1, False, "php"), ("y.ts", "r", 2, False, "php")], Params())
    joins = [line for line in m.changes._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (" in line]
    assert "(file#" in joins[0] and "(commit_id#" in joins[1]
    assert sorted((r["commit_id"], r["file"], r["authors"], r["now"]) for r in m.changes.collect()) == [("a", "x.ts", [1], NOW - DAY), ("a", "y.ts", [1], NOW - DAY), ("b", "y.ts", [2], NOW - DAY)]


def test_hotspots_and_owners(bakery):
    h = {r["name"]: r for r in hotspots(bakery, "entity").collect()}
    # Eight with yeast, two alone, six with the test, one release.
    assert h["dough"]["rank"] == 1 and h["dough"]["revisions"] == 17 and h["dough"]["defects"] == 4 and h["cellar"]["age_days"] == 892
    assert sorted(r["rank"] for r in h.values()) == list(range(1, len(h) + 1))
    assert {r["name"] for r in hotspots(bakery, "entity", Scope(repo="till")).collect()} == {"receipt"}
    assert {r["name"]: r["revisions"] for r in hotspots(bakery, "file", Scope(path="./yeast", days=20)).collect()} == {"yeast.ts": 3}  # before the newest commit, four days ago
    o = {r["name"]: r for r in ownership(bakery, "entity").collect()}
    assert (o["cellar"]["main_dev"], o["cellar"]["knowledge_loss"], o["cellar"]["bus_factor"]) == (30, 1, 1) and o["yeast"]["main_dev"] == 10


def test_people_are_those_of_the_commits(bakery):
    """A written model's people are not those of other commits."""
    by_one = replace(bakery, commits=bakery.commits.withColumns({"author": F.lit(77), "authors": F.array(F.lit(77).cast("long"))}))
    assert [(r["author"], r["commits"]) for r in by_one.active().collect()] == [(77, by_one.commits.count())]
    assert {r["author"] for r in bakery.active().collect()} == {10, 11, 20, 30}


def test_pairs_and_their_flags(bakery):
    pairs = lambda **k: {(r["a"], r["b"]): r for r in coupling(bakery, "file", **k).collect()}
    assert {k: r["support"] for k, r in pairs().items()} == {("dough.ts", "yeast.ts"): 8}
    every = pairs(include_tests=True, include_config=True, include_expected=True)
    spec = every["dough.spec.ts", "dough.ts"]
    assert spec["support"] == 6 and spec["test_pair"] and spec["same_entity"] and every["dough.ts", "oven.json"]["involves_config"]
    assert not every["dough.spec.ts", "oven.json"]["test_pair"]
    assert {k for k, r in pairs(by="ticket").items() if r["cross_repo"]} == {("dough.ts", "receipt.php"), ("receipt.php", "yeast.ts")}
    assert coupling(bakery, "file", scope=Scope(repo="till")).count() == 0 and coupling(bakery, "file", "ticket", scope=Scope(repo="till")).count() == 2


def test_partners_and_missed_changes(spark, bakery):
    assert [(r["name"], r["confidence"], r["by"]) for r in cp.partners(bakery, "yeast.ts", "file").collect()] == [("dough.ts", 1.0, "commit"), ("receipt.php", 0.75, "ticket")]
    touched = spark.createDataFrame([("dough.spec.ts",), ("yeast.ts",)], "key string")
    got = [(r["target"], r["source"], r["kind"]) for r in cp.missed_changes(bakery, touched).collect()]
    assert got == [("dough.ts", "yeast.ts", "coupled"), ("receipt.php", "yeast.ts", "cross-repo")]
    assert [(r["target"], r["kind"]) for r in cp.missed_changes(bakery, spark.createDataFrame([("dough.spec.ts",)], "key string")).collect()] == [("dough.ts", "test")]


def test_every_rule_finds_something(spark):
    """Twelve entities in a tangle that one person of a small unit keeps, with many people on one of them, and old ones that nobody knows."""
    commits = []
    for i in range(24):
        commits.append((f"a{i}", "r", 3 * i, 1, f"AB-{i} fix it" if i % 4 else f"AB-{i} more", ["hub.ts", "s1.ts", "s2.ts"]))
        commits.append((f"b{i}", "q", 3 * i + 0.1, 1, f"AB-{i} too", ["far.ts"]))
    commits += [(f"m{i}", "r", 2 + i, 100 + i, "tidy", ["crowd.ts"]) for i in range(9)]
    commits += [(f"o{i}", "r", 1500 + i, 50, "old", ["lost.ts"]) for i in range(30)] + [(f"p{i}", "r", 5 + i, 1, "fix again", ["buggy.ts"]) for i in range(6)] + [(f"z{i}", "r", 200 + i, 1, "calm", ["calm.ts"]) for i in range(40)]
    files = [("hub.ts", "r", 90, False, "typescript"), ("s1.ts", "r", 60, False, "typescript"), ("s2.ts", "r", 50, False, "typescript"), ("far.ts", "q", 40, False, "typescript")]
    files += [("crowd.ts", "r", 30, False, "typescript"), ("lost.ts", "r", 95, False, "typescript"), ("buggy.ts", "r", 20, False, "typescript"), ("calm.ts", "r", 10, False, "typescript")]
    m = make(spark, commits, files, Params(half_life_days=1000, min_lift=0.1, shotgun_average=2.0))
    m = m.__class__(m.commits, m.files.withColumn("loc", F.lit(1200)).withColumn("loc", F.col("loc").cast("long")), m.changes, m.authors, m.params)
    trends = spark.createDataFrame([("hub", "deteriorating")], "name string, direction string")
    functions = spark.createDataFrame([("hub.ts", "f", 22, 9, 0.8), ("hub.ts", "g", 30, 5, 0.5), ("hub.ts", "h", 31, 5, 0.45), ("s1.ts", "k", 15, 9, 0.9)], "file string, fn string, cc int, revisions int, score double")
    parts = spark.createDataFrame([("s1", 9, 11, 3), ("s2", 1, 1, 1)], "name string, deps int, inputs int, template_complexity int")
    got = [r.asDict() for r in fd.findings(m, trends, functions, parts).collect()]
    by = {}
    for r in got:
        by.setdefault(r["kind"], []).append(r["subject"])
    assert set(by) == set(fd.LABELS) and all(r["label"] for r in got)
    assert by["deteriorating_hotspot"] == ["hub"] and "hub" not in by["hotspot"] and sorted(by["xray_hotspot"]) == ["hub.ts f", "hub.ts g"]
    assert by["bloated_component"] == ["s1"] and by["knowledge_loss"] == ["lost"] and by["coordination"] == ["crowd"] and "buggy" in by["defect_magnet"]
    assert [r["id"] for r in sorted(got, key=lambda r: (-r["severity"], r["kind"], r["subject"]))] == [f"F{k:03d}" for k in range(1, len(got) + 1)]
    # Each of the four is in three pairs: the first by name is the hub. A pair by ticket is no surer than those by commit, in one repo.
    (c,) = fd.coupling_clusters(fd.Facts(m)).collect()
    assert (c["hub"], c["members"], c["degree"], c["support"], c["cross_repo"]) == ("far", 3, 1.0, 24, False)
    (f,) = [r for r in got if r["kind"] == "hidden_coupling"]
    assert f["severity"] == 35 + 45 + 2


def test_thresholds_by_default():
    p = Params()
    assert (p.hidden_degree, p.shotgun_average, p.graph_confidence, p.missed_confidence) == (0.5, 5.0, 0.1, 0.6)


def test_risk_of_tickets(bakery):
    """As of a change with the ticket's commits, without asking who wrote the files and without looking for the commits' changes."""
    for level in ("file", "unit"):
        of_tickets = df.ticket_risk(bakery, level)
        assert of_tickets.count() and sorted(of_tickets.collect()) == sorted(df.change_risk(bakery, ov.ticket_changes(bakery), level).collect())
    h = scored(bakery, "file", people=False)
    assert "authors" not in h.columns
    assert sorted(h.select("file", "score", "revisions").collect()) == sorted(scored(bakery, "file").select("file", "score", "revisions").collect())


def test_risk_of_a_change(spark, bakery):
    """A newcomer changes yeast alone: dough is missed, and so is the receipt; then the same with what a parser found."""
    c = spark.createDataFrame([("one", "d1"), ("two", "e0"), ("two", "e1")], "change string, commit_id string")
    h = {r["name"]: r["score"] for r in hotspots(bakery, "file").collect()}
    got = {r["change"]: r for r in df.change_risk(bakery, c).collect()}
    # One: dough and yeast, by their main author; receipt, by ticket, and the test of dough are missed.
    hot = sum(x >= 0.5 for x in (h["dough.ts"], h["yeast.ts"]))
    assert got["one"]["missed"] == 1 and got["one"]["risk"] == round(40 * max(h["dough.ts"], h["yeast.ts"]) + 5 * hot + 7)
    worse = spark.createDataFrame([("one", 8, True)], "change string, rise long, drops boolean")
    assert df.change_risk(bakery, c, worse=worse).filter("change = 'one'").first()["risk"] == min(100, got["one"]["risk"] + 8 + 5)
    # Dough is known by 10 and 11, the first of whom wrote change one.
    assert [(r["change"], r["place"], r["reviewer"]) for r in df.reviewers(bakery, c).orderBy("change").collect()] == [("one", 1, 11), ("two", 1, 10)]


def test_experts_of_many_changes(spark, bakery):
    """The same as one by one, with commits of several files and people who are named twice; what a change is sent does not grow with its files' commits."""
    m = replace(bakery, changes=bakery.changes.withColumn("authors", F.when(F.col("commit_id").isin("d1", "e0"), F.array("author", "author", F.lit(20).cast("long"))).otherwise(F.col("authors"))))
    touched = spark.createDataFrame([("a", "dough.ts"), ("a", "yeast.ts"), ("b", "dough.ts"), ("b", "dough.spec.ts"), ("b", "receipt.php"), ("c", "cellar.ts"), ("c", "x1.ts")], "change string, file string")
    without = spark.createDataFrame([("a", 11), ("b", 20)], "change string, author long")
    key = lambda d: sorted((r["change"], r["place"], r["author"], r["name"], r["score"], r["touches"], r["last_ts"]) for r in d.collect())
    got, want = so.experts_of_many(m, touched, without), so.experts_by(m, touched, without)
    assert key(got) == key(want) and {r["change"] for r in got.collect()} == {"a", "b", "c"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [change") == 1


def test_overview_and_tree(bakery):
    o = ov.overview(bakery).first()
    assert (o["tickets"], o["authors"], o["active_authors"], o["cross_unit_pairs"], o["cross_repo_pairs"]) == (8, 4, 3, 1, 2)
    t = {r["path"]: r for r in ov.hotspot_tree(bakery).collect()}
    assert t["oven"]["parent"] == "" and t["oven"]["depth"] == 1 and t["oven"]["loc"] == sum(r["loc"] for p, r in t.items() if r["parent"] == "oven")
    assert t["till"]["loc"] == 50 and all(r["parent"] in t for r in t.values() if r["depth"] > 1)
    assert {r["ticket"]: (r["commits"], r["repos"], r["authors"]) for r in ov.ticket_rollup(bakery).collect()}["BAKE-2"] == (2, 2, 2)


def test_sessions_hang_on_their_first_row(spark):
    e = spark.createDataFrame([(7, m * 60, m) for m in (0, 50, 61, 100, 121, 125)], "author long, ts long, id long")
    assert sorted((r["id"], r["anchor"] // 60) for r in anchored_sessions(e, 3600).collect()) == [(0, 0), (50, 0), (61, 61), (100, 61), (121, 61), (125, 125)]


def test_sessions_of_one_busy_author(spark):
    """Rows are streamed: one author's many rows, over several batches, do not become one array."""
    n, window = 60_000, 100
    e = spark.range(n).select(F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.col("id") % 7 + 2).otherwise(1).cast("long").alias("author"), (F.col("id") * 7919 % 1_000_003).alias("ts"), "id")
    rows = sorted(((r["author"] is not None, r["author"] or 0), r["ts"], r["id"]) for r in e.collect())
    want, who, anchor = {}, None, None
    for a, ts, i in rows:
        if a != who or ts - anchor > window:
            who, anchor = a, ts
        want[i] = anchor
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    got = anchored_sessions(e, window)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {r["id"]: r["anchor"] for r in got.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_commits_without_tickets_couple_by_session(spark):
    """Six mornings one baker changes the oven and an hour later the till; another changes each once, days apart."""
    commits = [(f"{r}{i}", r, 20 - i - hour / 24, 1, "tweak", [f]) for i in range(6) for hour, r, f in ((0, "oven", "heat.ts"), (1, "till", "Sum.php"))]
    commits += [(f"b{i}", r, 5 - i, 2, "OV-1 tweak" if i == 2 else "tweak", [f]) for i, (r, f) in enumerate((("oven", "heat.ts"), ("till", "Sum.php"), ("oven", "lamp.ts")))]
    m = make(spark, commits, [(f, r, 5, False, "php") for f, r in (("heat.ts", "oven"), ("Sum.php", "till"), ("lamp.ts", "oven"))], Params(min_lift=1.0))
    for by in ("ticket", "session"):
        (r,) = coupling(m, "file", by).collect()
        assert (r["a"], r["b"], r["support"], r["n_a"], r["n_b"], r["cross_repo"]) == ("Sum.php", "heat.ts", 6, 7, 7, True)
        assert r["lift"] == round(6 * 9 / 49, 3)  # 6 sessions, 2 single commits, and the ticket
    assert coupling(m, "file", "commit").count() == 0
    with pytest.raises(ValueError, match="by is one of"):
        coupling(m, "file", "week")


def test_identities(spark):
    rows = [(4, "Zoé Fournier", "zoe@home.org", 3), (7, "zoe fournier", "zf@work.org", 8), (8, "ZF", "ZF@work.org", 1), (9, "Yu", "yu@work.org", 2), (10, "Yu", "yu@play.org", 2), (11, "renovate", "r@x.org", 5), (12, "Marta K", "mk@work.org", 2)]
    aliases = spark.createDataFrame([("Marta Kowalska", "mk@work.org"), ("Marta Kowalska", "Zoe Fournier")], "canonical string, alias string")
    teams = spark.createDataFrame([("bread", "ZF@WORK.org"), ("cake", "yu@play.org")], "team string, member string")
    i = spark.createDataFrame(rows, "id long, name string, email string, commits int")
    got = {r["id"]: r for r in resolve(i).collect()}
    # Names of two letters join nobody.
    assert got[4]["person"] == got[7]["person"] == got[8]["person"] == 4 and got[9]["person"] == 9 and got[10]["person"] == 10
    assert got[8]["display"] == "zoe fournier" and got[11]["bot"] and not got[9]["bot"] and got[4]["team"] is None
    got = {r["id"]: r for r in resolve(i, aliases, teams).collect()}
    assert got[12]["person"] == got[4]["person"] == 4 and got[7]["display"] == "Marta Kowalska" and (got[12]["team"], got[10]["team"], got[9]["team"]) == ("bread", "cake", None)
    assert resolve(i.limit(0)).count() == 0


def test_trends(spark):
    series = {"up": [31, 33, 50], "flat": [7, 9, 8], "down": [60, 40, 41], "short": [1, 90], "small": [4, 5, 8]}
    rows = [(f, NOW - (len(v) - i) * 50 * DAY, i, float(x)) for f, v in series.items() for i, x in enumerate(v)]
    got = {r["file"]: r for r in classify(spark.createDataFrame(rows, "file string, ts long, seq long, complexity double"), spark.createDataFrame([(NOW,)], "now long")).collect()}
    assert {f: r["direction"] for f, r in got.items()} == {"up": "deteriorating", "flat": "stable", "down": "improving", "small": "stable"} and got["down"]["refactored"] and not got["up"]["refactored"]


def test_innermost(spark):
    lines = spark.createDataFrame([("f", 2), ("f", 7), ("f", 9), ("f", 99)], "key string, line long")
    ranges = spark.createDataFrame([("f", "whole", 1, 40), ("f", "part", 6, 9), ("f", "twin", 6, 9), ("f", "bit", 9, 9)], "key string, fn string, start long, end long")
    assert {r["line"]: r["fn"] for r in innermost(lines, ranges).collect()} == {2: "whole", 7: "part", 9: "bit", 99: "(top level)"}


def test_change_sets_are_one_row_each(spark, bakery):
    sets = cp.commit_sets(bakery, "file")
    assert sorted(sorted(r["keys"]) for r in sets.collect()) == sorted(
        [["dough.ts", "yeast.ts"]] * 8 + [["dough.ts"]] * 2 + [["receipt.php"]] * 6 + [["cellar.ts"]] * 5 + [["dough.spec.ts", "dough.ts", "oven.json"]] * 6
    )
    now = spark.range(1).select(F.lit(NOW).cast("long").alias("now"))
    for rare in ([], [["a", "b", "z"]]):
        rows = [["b", "a"], ["a", "c", "b"], ["c", None, "a"], ["a"], [None], []] + rare
        d = spark.createDataFrame([(r, NOW) for r in rows], "keys array<string>, ts long")
        got = {(r["a"], r["b"]): (r["support"], r["recent"], r["n_a"], r["n_b"], round(r["lift"], 6)) for r in cp.pair_counts(d, Params(min_support=2, min_lift=0.0, min_confidence=0.0), now).collect()}
        n, ab, a = len(rows), 2 + len(rare), 4 + len(rare)
        assert got == {("a", "b"): (ab, ab, a, ab, round(ab * n / (a * ab), 6)), ("a", "c"): (2, 2, a, 2, round(2 * n / (a * 2), 6))}


def test_a_commits_only_change_is_not_shuffled(spark):
    rows = spark.createDataFrame([("k", "c1", 1, 5), ("k", "c2", 2, 7), ("k", "c2", 2, 1), (None, "c3", 1, 2)], "key string, commit_id string, n_changes long, churn long")
    once = once_a_commit(rows, ("key",), F.sum("churn").alias("churn"))
    assert sorted((r["key"] or "", r["churn"]) for r in once.collect()) == [("", 2), ("k", 5), ("k", 8)]
    assert "Aggregate" not in once._jdf.queryExecution().optimizedPlan().children().head().toString()


def test_a_scored_key_is_written_once(bakery):
    """What is read again for the largest is a row for each key, not all changes."""
    assert not [f for f in scored(bakery, "unit").inputFiles() if "model-changes" in f]


def test_levels_are_made_after_rows_are_dealt(bakery):
    for made in (people_of_levels(bakery), ownership_of_levels(bakery)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        # Upper lines come later: the levels' explode() stands above the shuffle by author.
        assert "Expand" not in plan and plan.index("Generate explode(array(struct(level") < plan.index("RepartitionByExpression [author")
    own = {r["name"]: (r["main_dev"], r["recent_authors"]) for r in ownership(bakery, "unit").collect()}
    assert own == {r["name"]: (r["main_dev"], r["recent_authors"]) for r in ownership_of_levels(bakery).filter("level = 'unit'").collect()}


def test_functions_of_commits_with_one_change(bakery):
    c = bakery.changes.select(F.col("unit").alias("file"), F.col("entity").alias("fn"), "commit_id", "ts", "now", "added", "deleted", "defect", "weight", "authors", "n_changes")
    functions = c.groupBy("file", "fn").agg(F.lit(20).alias("cc"))
    known = function_hotspots(c, functions)
    assert sorted(known.collect()) == sorted(function_hotspots(c.drop("n_changes"), functions).collect())
    assert "(n_changes" in known._jdf.queryExecution().optimizedPlan().toString()


def test_a_staged_model_is_the_same_and_written_once(spark):
    """Commits are the first changes of what is written; orders that tell of several commits, bots among people and files that are not known count as they do without staging."""
    staged, plain = from_tables(spark, "/root/testdata/sf0.001", staged=True), from_tables(spark, "/root/testdata/sf0.001")
    assert staged.commits.inputFiles() == staged.changes.inputFiles() and all("model-changes" in f for f in staged.changes.inputFiles())
    for a, b in ((staged.commits, plain.commits), (staged.changes, plain.changes)):
        assert a.columns == b.columns and a.count() > 1000
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    commits = [("a", "r", 1, 1, "fix\n\nR-1", ["x.php", "gone.php", "y.php"]), ("b", "s", 2, 2, "add", ["gone.php"]), ("c", "s", 3, 3, "add", ["y.php"]), ("d", "s", 4, 9, "bot", ["y.php"])]
    one, two = (make(spark, commits, [("x.php", "r", 1, False, "php"), ("y.php", "r", 2, False, "php")], Params(), (9,), staged) for staged in (True, False))
    assert sorted(map(str, one.commits.collect())) == sorted(map(str, two.commits.collect())) and sorted(map(str, one.changes.collect())) == sorted(map(str, two.changes.collect()))
    assert {(r["commit_id"], r["repo"], r["n_changes"], r["message"]) for r in one.commits.collect()} == {("a", "r", 2, "fix\n\nR-1"), ("c", "s", 1, "add")}


def test_what_a_change_is_sent_of_people(spark):
    """Commits of one author and one time stay apart, people of one name are told once, places end where they shall; neither names nor commits travel to changes."""
    files = [(f"{x}.php", "r", 1, False, "php") for x in "xyz"]
    commits = [("w1", "r", 3, 1, "RX-1 add", ["x.php", "y.php"]), ("w2", "r", 3, 1, "RX-1 add", ["x.php", "y.php"]), ("w3", "r", 3, 1, "RX-2 add", ["y.php", "z.php"]), ("n1", "r", 5, 2, "RX-3 add", ["x.php"]), ("n2", "r", 6, 2, "RX-3 add", ["x.php"])]
    commits += [(f"p{k}", "r", 7, k, "RX-4 add", ["x.php"]) for k in range(3, 9)]
    m = make(spark, commits, files, Params())
    m = replace(m, authors=spark.createDataFrame([(k, "t", "Ida" if k in (3, 4, 6) else f"n{k}" if k != 5 else None) for k in range(1, 9)], "author long, team string, name string"))
    touched = spark.createDataFrame([("a", "x.php"), ("a", "y.php"), ("b", "y.php"), ("c", "z.php"), ("c", "x.php")], "change string, file string")
    without = spark.createDataFrame([("a", 2), ("c", 99)], "change string, author long")
    want = sorted(map(tuple, so.experts_by(m, touched, without).collect()), key=str)
    got = so.experts_of_many(m, touched, without)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) == 12
    assert sorted(map(tuple, so.experts_of_many(m, touched, without, 2).collect()), key=str) == [r for r in want if r[1] <= 2]
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (sent,) = [lines[k + 1] for k, line in enumerate(lines) if "RepartitionByExpression [change" in line]
    assert "lines#" in sent and "name#" not in sent and "commit#" not in sent and "entries#" not in sent
    of_tickets = sorted(map(tuple, df.ticket_reviewers(m).collect()), key=str)
    assert of_tickets and of_tickets == sorted(map(tuple, df.reviewers(m, ov.ticket_changes(m)).collect()), key=str)


def test_commits_are_dealt_before_levels(bakery):
    """A change travels to its commit's others once, not once for each level, and counts there as it does level by level."""
    h = history_of_levels(bakery)
    plan = h._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [k for k, line in enumerate(plan) if "Generate explode" in line][-1] < next(k for k, line in enumerate(plan) if "RepartitionByExpression [commit_id" in line)
    rows = {(r["level"], r["name"]): r for r in h.collect()}
    for level in ("file", "entity", "unit", "repo"):
        want = {r[level]: r for r in history(bakery, level).collect()}
        assert want.keys() == {n for x, n in rows if x == level}
        for name, r in want.items():
            got = rows[level, name]
            assert got["rev_w"] == pytest.approx(r["rev_w"], abs=1e-9) and all(got[c] == r[c] for c in ("revisions", "defects", "last_ts", "churn", "now"))
