"""All about one key in one row, and units with what connects them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.coupling import partners
from revlens.operators.hotspots import hotspots
from revlens.operators.overview import commit_timeline
from revlens.operators.social import experts_by, ownership
from revlens.plans.model import Model, Scope

EXPERTS = 5
TICKETS = 15


def detail(model: Model, level: str, key: str) -> DataFrame:
    """One row: level, name, repo, total_ranked, hotspot, ownership, files, experts, partners, commits, tickets; none for a key that is not there.

    hotspot and ownership are rows among the keys of the same repository, null where the key has none. files are living
    ones, code before tests, then the most complex first; experts the first five; partners as partners() has them; commits
    the newest thirty, newest first, and tickets the first fifteen that these name.
    """
    if level not in ("file", "entity", "unit"):
        raise ValueError(f"level is file, entity or unit, not {level!r}")
    own = model.files.filter(F.col(level) == key)
    found = own.agg(F.min("repo").alias("repo")).first()["repo"]  # one row
    scope = Scope(repo=found)
    whole = lambda d, *order: d.agg(F.array_sort(F.collect_list(F.struct(*order))).alias("a"))
    one = lambda d, name: d.filter(F.col("name") == key).agg(F.first(F.struct(*d.columns)).alias(name))

    ranked = hotspots(model, level, scope)
    extra = [c for c in ("path", "health_reasons", "deps", "inputs") if c in model.files.columns]
    revisions = model.changes.filter(F.col(level) == key).groupBy("file").agg(F.count_distinct("commit_id").alias("revisions"))
    files = own.filter("alive").join(revisions, "file", "left").fillna(0, ["revisions"])
    about = F.struct("file", "lang", "loc", "complexity", "health", "test", "revisions", *extra)
    files = whole(files.select("test", (-F.col("complexity")).alias("less"), "file", about.alias("f")), "test", "less", "file", "f")
    best = experts_by(model, own.select(F.lit(0).alias("change"), "file")).filter(F.col("place") <= EXPERTS)
    best = whole(best.select("place", F.struct("author", "name", "score", "touches", "last_ts").alias("e")), "place", "e")
    pairs = partners(model, key, level)
    pairs = whole(pairs.select((-F.col("confidence")).alias("less"), (-F.col("support")).alias("fewer"), "name", "by", F.struct(*pairs.columns).alias("p")), "less", "fewer", "name", "by", "p")
    line = commit_timeline(model, level, key).join(model.commits.select("commit_id", "repo", "tickets", "defect"), "commit_id")
    row = F.struct("commit_id", "repo", "ts", "author", "subject", "tickets", "defect", "added", "deleted")
    line = whole(line.select((-F.col("ts")).alias("less"), "commit_id", row.alias("c")), "less", "commit_id", "c")

    out = own.agg(F.lit(level).alias("level"), F.lit(key).alias("name"), F.min("repo").alias("repo")).filter("repo is not null")
    out = out.join(F.broadcast(ranked.agg(F.count("*").alias("total_ranked")))).join(F.broadcast(one(ranked, "hotspot"))).join(F.broadcast(one(ownership(model, level, scope), "ownership")))
    for name, table, field in (("files", files, "f"), ("experts", best, "e"), ("partners", pairs, "p"), ("commits", line, "c")):  # each has one row, of bounded lists and the key's files
        out = out.join(F.broadcast(table.select(F.col(f"a.{field}").alias(name))))
    return out.withColumn("tickets", F.slice(F.array_distinct(F.flatten("commits.tickets")), 1, TICKETS))


def architecture_units(model: Model) -> DataFrame:
    """rank, name, repo, kind, loc, files, score, revisions, health, bus_factor, knowledge_loss, main_dev of each unit; unit_graph() has the edges.

    kind is null where the model's files don't tell it. A unit without living code that anybody knows has no owner.
    """
    h = hotspots(model, "unit").select("rank", "name", "loc", "files", "score", "revisions", "health")
    o = ownership(model, "unit").select("name", "bus_factor", "knowledge_loss", F.col("main_dev"))
    kind = F.min("unit_kind") if "unit_kind" in model.files.columns else F.lit(None).cast("string")
    about = model.files.groupBy(F.col("unit").alias("name")).agg(F.min("repo").alias("repo"), kind.alias("kind"))
    return h.join(about, "name").join(o, "name", "left").select("rank", "name", "repo", "kind", "loc", "files", "score", "revisions", "health", "bus_factor", "knowledge_loss", "main_dev")
