"""Ranked findings: one filtered table for each rule, put together and numbered."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import with_rank
from revlens.operators.coupling import coupling, sum_of_coupling
from revlens.operators.hotspots import hotspots
from revlens.operators.identity import components
from revlens.operators.social import defect_baseline, ownership, team_shares
from revlens.plans.model import Model
from revlens.plans.staging import stage


class Facts:
    """What several rules ask of a model, computed once each."""

    def __init__(self, model: Model, trends: DataFrame | None = None) -> None:
        self.model, self.params, self.trends = model, model.params, trends

    @cached_property
    def entities(self) -> DataFrame:
        return stage(hotspots(self.model, "entity"), "entity-hotspots")

    @cached_property
    def units(self) -> DataFrame:
        return stage(hotspots(self.model, "unit"), "unit-hotspots")

    @cached_property
    def files(self) -> DataFrame:
        return stage(hotspots(self.model, "file"), "file-hotspots")

    @cached_property
    def owners(self) -> DataFrame:
        return stage(ownership(self.model, "entity"), "entity-owners")


def severity(x: Column) -> Column:
    return F.round(F.greatest(F.lit(1.0), F.least(F.lit(100.0), x))).cast("long")


def _top(df: DataFrame, share: float, least: int, *order: Column) -> DataFrame:
    """The first share of the rows, least at the fewest."""
    df = with_rank(df, "_k", *order)
    n = df.agg(F.count("*").alias("_n"))  # one row
    return df.join(F.broadcast(n)).filter(F.col("_k") <= F.greatest(F.ceil(F.col("_n") * share), F.lit(least))).drop("_k", "_n")


def _finding(df: DataFrame, kind: str | Column, subject: Column, sev: Column, *evidence: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(kind.alias("kind"), subject.alias("subject"), severity(sev).alias("severity"), F.to_json(F.struct(*evidence)).alias("evidence"))


def hotspot_findings(facts: Facts) -> DataFrame:
    """Complex code that keeps changing. With trends(name, direction), deteriorating ones are told apart and weigh more."""
    n = facts.entities.agg(F.greatest(F.ceil(F.count("*") * 0.02), F.lit(5)).alias("top"))  # one row
    h = facts.entities.join(F.broadcast(n)).filter("rank <= top and not test and code and score >= 0.35 and revisions >= 3 and (health <= 7 or norm >= 0.9)").orderBy("rank").limit(10)
    h = h.withColumn("direction", F.lit(None).cast("string")) if facts.trends is None else h.join(facts.trends.select("name", "direction"), "name", "left")
    worse = F.coalesce(F.col("direction") == "deteriorating", F.lit(False))
    kind = F.when(worse, "deteriorating_hotspot").otherwise("hotspot")
    return _finding(h, kind, F.col("name"), 40 + 50 * F.col("score") + 2 * (10 - F.col("health")) + F.when(worse, 10).otherwise(0), "score", "revisions", "health", "direction")


def function_findings(facts: Facts, functions: DataFrame) -> DataFrame:
    """Complex functions that keep changing, of functions(file, fn, cc, revisions, score): two at most of each of the first files, until there are eight."""
    files = facts.files.filter("not test").select(F.col("name").alias("file"), "rank", F.col("score").alias("file_score"))
    known = files.join(functions.select("file").distinct(), "file", "left_semi").orderBy("rank").limit(15)
    of_file = Window.partitionBy("file").orderBy(F.desc("score"), "fn")
    f = functions.filter("cc > 15 and revisions >= 3 and score >= 0.4").join(known, "file").withColumn("k", F.row_number().over(of_file)).filter("k <= 2")
    f = f.withColumn("n", F.count("*").over(Window.orderBy("rank").rangeBetween(Window.unboundedPreceding, -1))).filter("n < 8")  # thirty rows at most
    sev = 35 + 0.6 * F.least("cc", F.lit(40)) + 0.6 * F.least("revisions", F.lit(40)) + 15 * F.col("file_score")
    return _finding(f, "xray_hotspot", F.concat_ws(" ", "file", "fn"), sev, "cc", "revisions", "score")


def components_of(model: Model) -> DataFrame:
    """name, deps, inputs, template_complexity of the entities that are components: the most that any of their living files has.

    How complex a template is only a parser tells; without template_complexity among the model's files it is null.
    """
    f = model.files.filter((F.col("entity_kind") == "component") & F.col("alive"))
    template = F.col("template_complexity") if "template_complexity" in model.files.columns else F.lit(None).cast("double")
    return f.groupBy(F.col("entity").alias("name")).agg(F.max("deps").alias("deps"), F.max("inputs").alias("inputs"), F.max(template).alias("template_complexity"))


def bloated_findings(facts: Facts, components: DataFrame) -> DataFrame:
    """Components of components(name, deps, inputs, template_complexity) with too many dependencies or inputs or too complex a template."""
    h = _top(facts.entities, 0.1, 10, F.asc("rank")).select("name", "score").join(components, "name")
    issues = (F.col("deps") > 7).cast("int") + (F.col("inputs") > 10).cast("int") + (F.col("template_complexity") > 25).cast("int")
    h = h.fillna(0, ["deps", "inputs", "template_complexity"]).withColumn("issues", issues).filter("issues > 0")
    return _finding(h, "bloated_component", F.col("name"), 30 + 10 * F.col("issues") + 25 * F.col("score"), "deps", "inputs", "template_complexity")


def shotgun_findings(facts: Facts) -> DataFrame:
    h = facts.entities.filter("revisions >= 10 and not test and code").join(sum_of_coupling(facts.model, "entity"), "name")
    h = _top(h, 0.02, 3, F.desc("soc"), F.asc("name")).withColumn("avg", F.col("soc") / F.col("revisions"))
    h = h.filter(F.col("avg") >= facts.params.shotgun_average).orderBy(F.desc("soc"), "name").limit(3)
    return _finding(h, "shotgun_surgery", F.col("name"), 25 + 2 * F.least(F.col("avg"), F.lit(15.0)) + 15 * F.col("score"), "soc", "revisions")


def knowledge_loss_findings(facts: Facts) -> DataFrame:
    h = _top(facts.entities.filter("not test"), 0.1, 10, F.asc("rank")).select("name", "score").join(facts.owners.select("name", "knowledge_loss", "main_dev"), "name")
    h = h.filter("knowledge_loss >= 0.5 and score >= 0.3")
    return _finding(h, "knowledge_loss", F.col("name"), 35 + 35 * F.col("knowledge_loss") + 20 * F.col("score"), "knowledge_loss", "main_dev")


def bus_factor_findings(facts: Facts) -> DataFrame:
    """Units that one person carries, grouped by that person."""
    u = facts.units.select("name", "loc", "revisions").join(ownership(facts.model, "unit"), "name")
    few = (F.col("bus_factor") <= facts.params.bus_people) & (F.col("main_share") >= facts.params.bus_share)
    u = u.filter("loc >= 1000 and revisions >= 10 and recent_authors > 0").filter(few)
    g = u.groupBy("main_dev").agg(F.count("*").alias("units"), F.sum("loc").alias("loc"), F.avg("main_share").alias("share")).orderBy(F.desc("loc"), "main_dev").limit(5)
    return _finding(g, "bus_factor", F.col("main_dev").cast("string"), 30 + 25 * F.col("share") + 4 * F.log10("loc") + F.least("units", F.lit(5)), "units", "loc")


def coordination_findings(facts: Facts) -> DataFrame:
    teams = team_shares(facts.model, "entity").filter("share >= 0.1").groupBy("name").agg(F.count("*").alias("teams"))
    h = facts.entities.filter("not test").select("name", "score").join(facts.owners.select("name", "recent_authors"), "name").join(teams, "name", "left").fillna(0, ["teams"])
    h = h.filter("recent_authors >= 8 or teams >= 3").orderBy(F.desc(F.col("recent_authors") + 3 * F.col("teams")), "name").limit(5)
    return _finding(h, "coordination", F.col("name"), 25 + 1.5 * F.least("recent_authors", F.lit(20)) + 5 * F.col("teams") + 15 * F.col("score"), "recent_authors", "teams")


def defect_findings(facts: Facts) -> DataFrame:
    repo_of = facts.model.files.groupBy(F.col("entity").alias("name")).agg(F.min("repo").alias("repo"))
    h = facts.entities.filter("not test").join(repo_of, "name").join(defect_baseline(facts.model).select("repo", "baseline"), "repo")
    ratio = F.round((F.col("defects") / F.col("revisions")) / F.greatest("baseline", F.lit(0.05)), 4)
    h = h.filter("revisions > 0 and defects >= 5").withColumn("ratio", ratio).filter((F.col("defect_density") >= facts.params.defect_density) & (F.col("ratio") >= facts.params.defect_ratio))
    h = h.orderBy(F.desc(F.col("ratio") * F.col("defects")), "name").limit(5)
    return _finding(h, "defect_magnet", F.col("name"), 30 + 20 * F.least(F.col("ratio") - 1, F.lit(1.5)) + 0.5 * F.least("defects", F.lit(30)) + 10 * F.col("score"), "defects", "revisions", "ratio")


def coupling_clusters(facts: Facts) -> DataFrame:
    """hub, members, degree, support, cross_repo, weight: components of strongly coupled entities of code in different units, or of repos by ticket.

    The hub is the entity in most pairs, the first by name of those. degree and support are the surest pair's; a member
    counts as across repos by its surest pair.
    """
    code = facts.entities.filter("code and not test").select("name")
    c = coupling(facts.model, "entity", "commit", cross_only=True)
    t = coupling(facts.model, "entity", "ticket", cross_repo=True)
    strong = lambda d: d.withColumn("degree", F.greatest("conf_ab", "conf_ba")).filter((F.col("degree") >= facts.params.hidden_degree) & ~F.col("test_pair"))
    in_code = lambda d: d.join(code.withColumnRenamed("name", "a"), "a", "left_semi").join(code.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b", "degree", "support", "cross_repo")
    c, t = in_code(strong(c)), in_code(strong(t))
    pairs = stage(c.unionByName(t.join(c.select("a", "b"), ["a", "b"], "left_anti")), "hidden-pairs")
    ends = pairs.select("*", F.col("a").alias("node")).unionByName(pairs.select("*", F.col("b").alias("node")))
    surest = F.max_by(F.struct("degree", "support", "cross_repo"), F.struct("degree", "support", "a", "b"))
    nodes = ends.groupBy("node").agg(F.count("*").alias("pairs"), surest.alias("own"), F.max(F.col("degree") * F.col("support")).alias("weight")).join(components(pairs), "node")
    first = Window.partitionBy("label").orderBy(F.desc("pairs"), "node")
    nodes = nodes.withColumn("k", F.row_number().over(first))
    return nodes.groupBy("label").agg(
        F.max(F.when(F.col("k") == 1, F.col("node"))).alias("hub"),
        (F.count("*") - 1).alias("members"),
        F.max(F.struct("own.degree", "own.support")).alias("best"),
        F.max(F.when(F.col("k") > 1, F.col("own.cross_repo"))).alias("cross_repo"),
        F.max("weight").alias("weight"),
    ).select("hub", "members", "best.degree", "best.support", "cross_repo", "weight")


def hidden_coupling_findings(facts: Facts) -> DataFrame:
    g = coupling_clusters(facts).orderBy(F.desc("weight"), "hub").limit(10)
    sev = 35 + 45 * F.col("degree") * F.least(F.col("support") / 15, F.lit(1.0)) + F.when(F.col("cross_repo"), 8).otherwise(0) + F.least(F.col("members") - 1, F.lit(5))
    return _finding(g, "hidden_coupling", F.col("hub"), sev, "members", "degree", "support", "cross_repo")


RULES = {
    "hotspot": hotspot_findings,
    "hidden_coupling": hidden_coupling_findings,
    "shotgun_surgery": shotgun_findings,
    "knowledge_loss": knowledge_loss_findings,
    "bus_factor": bus_factor_findings,
    "coordination": coordination_findings,
    "defect_magnet": defect_findings,
}

# What kinds are called.
LABELS = {
    "hotspot": "Hotspot", "deteriorating_hotspot": "Deteriorating hotspot", "xray_hotspot": "Function hotspot", "hidden_coupling": "Hidden coupling", "shotgun_surgery": "Ripple effect",
    "knowledge_loss": "Knowledge loss", "bus_factor": "Bus factor", "coordination": "Coordination bottleneck", "defect_magnet": "Defect magnet", "bloated_component": "Bloated component",
}


def findings(model: Model, trends: DataFrame | None = None, functions: DataFrame | None = None, components: DataFrame | None = None) -> DataFrame:
    """All rules' findings, worst first, numbered F001 and on, with the label of their kind.

    The rules' limits bound the number of rows. What comes of a source parser is taken where it is given: trends of
    entities and functions, as the rules for them tell. components are the model's own where its files tell of them.
    """
    if components is None and {"entity_kind", "deps", "inputs"} <= set(model.files.columns):
        components = components_of(model)
    facts = Facts(model, trends)
    every = [rule(facts) for rule in RULES.values()]
    every += [function_findings(facts, functions)] if functions is not None else []
    every += [bloated_findings(facts, components)] if components is not None else []
    order = Window.orderBy(F.desc("severity"), "kind", "subject")  # few rows: each rule has a limit
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("kind")]
    return reduce(DataFrame.unionByName, every).withColumn("id", F.format_string("F%03d", F.row_number().over(order))).withColumn("label", label)
