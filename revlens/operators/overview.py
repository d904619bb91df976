"""One-row overview, the leaves of the hotspot tree, commit timelines, and what changes consist of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.coupling import coupling
from revlens.operators.hotspots import hotspots, sizes
from revlens.operators.social import ownership
from revlens.plans.model import Model


def overview(model: Model) -> DataFrame:
    c = model.commits.agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    tickets = model.commits.select(F.explode("tickets").alias("t")).agg(F.count_distinct("t").alias("tickets"))
    people = model.active().agg(F.count("*").alias("authors"), F.sum(F.col("active").cast("long")).alias("active_authors"))
    f = model.files.filter("alive").agg(F.count("*").alias("files"), F.count_distinct("entity").alias("entities"), F.count_distinct("unit").alias("units"), F.sum("loc").alias("loc"))
    loss = ownership(model, "repo").agg(F.round(F.avg("knowledge_loss"), 3).alias("knowledge_loss"))
    units = ownership(model, "unit").join(sizes(model, "unit").select(F.col("unit").alias("name"), "loc"), "name")
    alone = units.agg(F.count_if((F.col("bus_factor") == 1) & (F.col("loc") >= 1000) & (F.col("recent_authors") > 0)).alias("bus_factor_one_units"))
    strong = (F.greatest("conf_ab", "conf_ba") >= model.params.hidden_degree) & ~F.col("test_pair")
    across = coupling(model, "entity", "commit", cross_only=True).agg(F.count_if(strong).alias("cross_unit_pairs"))
    repos = coupling(model, "entity", "ticket", cross_repo=True).agg(F.count_if(strong).alias("cross_repo_pairs"))
    out = c
    for one in (tickets, people, f, loss, alone, across, repos):  # each has one row
        out = out.join(F.broadcast(one))
    return out


def tree_leaves(model: Model) -> DataFrame:
    """Repo, unit and entity of each entity with code, with its score."""
    e = model.files.filter("alive").groupBy("entity").agg(F.min("repo").alias("repo"), F.min_by("unit", F.struct("test", "file")).alias("unit"))
    h = hotspots(model, "entity").filter("loc > 0").select(F.col("name").alias("entity"), "loc", "score", "health")
    return h.join(e, "entity").select("repo", "unit", "entity", "loc", "score", "health")


def hotspot_tree(model: Model) -> DataFrame:
    """path, parent, depth, loc, score: the tree of repos, units, directories and entities with code, inner nodes with the sum of loc and the largest score.

    A directory with a single child is put together with it.
    """
    leaves = tree_leaves(model).withColumn("inside", F.when(F.col("entity").startswith(F.concat("unit", F.lit("/"))), F.expr("substring(entity, length(unit) + 2)")).otherwise(F.col("entity")))
    parts = F.concat(F.array("repo", "unit"), F.split("inside", "/"))
    up_to = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.slice(parts, 1, k))
    nodes = leaves.select(F.explode(up_to).alias("parts"), "loc", "score").groupBy("parts").agg(F.sum("loc").alias("loc"), F.max("score").alias("score"))
    parent = F.when(F.size("parts") > 1, F.expr("slice(parts, 1, size(parts) - 1)"))
    children = nodes.filter(F.size("parts") > 1).groupBy(parent.alias("of")).agg(F.count("*").alias("n"))
    nodes = nodes.withColumn("up", parent).join(children, F.col("parts") == F.col("of"), "left").fillna(0, ["n"])
    kept = nodes.filter((F.col("n") != 1) | (F.size("parts") <= 2))
    # What stands above a node and is kept: the longest of its beginnings.
    above = kept.select(F.col("parts").alias("node"), F.explode(F.expr("transform(sequence(0, size(parts) - 1), k -> slice(parts, 1, k))")).alias("start"))
    above = above.join(kept.select(F.col("parts").alias("start")), "start").groupBy("node").agg(F.max_by("start", F.size("start")).alias("above"))
    kept = kept.join(above, F.col("parts") == F.col("node"), "left")
    return kept.select(F.array_join("parts", "/").alias("path"), F.coalesce(F.array_join("above", "/"), F.lit("")).alias("parent"), F.size("parts").cast("long").alias("depth"), "loc", "score")


def commit_timeline(model: Model, level: str, key: str | None = None, limit: int = 30) -> DataFrame:
    """The newest commits of a key, of the first key by name unless told otherwise."""
    one = model.files.agg(F.min(level).alias("_key")) if key is None else model.files.limit(1).select(F.lit(key).alias("_key"))
    rows = model.changes.join(F.broadcast(one), F.col(level) == F.col("_key"))  # one row
    per = rows.groupBy("commit_id").agg(F.max("ts").alias("ts"), F.max("author").alias("author"), F.max("subject").alias("subject"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return per.orderBy(F.desc("ts"), "commit_id").limit(limit)


def ticket_files(model: Model) -> DataFrame:
    """What each ticket changed in each file, for the tickets that span several repos."""
    rows = model.changes.select(F.explode("tickets").alias("ticket"), "repo", "file", "added", "deleted")
    wide = rows.groupBy("ticket").agg(F.count_distinct("repo").alias("repos")).filter("repos > 3").select("ticket")
    return rows.join(wide, "ticket", "left_semi").groupBy("ticket", "file").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


def ticket_rollup(model: Model) -> DataFrame:
    """ticket, commits, files, repos, authors, added, deleted, last_ts: what was done for each ticket, and by how many."""
    rows = model.changes.select(F.explode("tickets").alias("ticket"), "commit_id", "repo", "file", "authors", "added", "deleted", "ts")
    people = rows.select("ticket", F.explode("authors").alias("author")).distinct().groupBy("ticket").agg(F.count("*").alias("authors"))
    rows = rows.groupBy("ticket").agg(
        F.count_distinct("commit_id").alias("commits"), F.count_distinct("file").alias("files"), F.count_distinct("repo").alias("repos"),
        F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("ts").alias("last_ts"),
    )
    return rows.join(people, "ticket")


def owners_by_loc(model: Model, level: str = "entity") -> DataFrame:
    """author, keys, loc: people by the lines of code of which they are the main developer."""
    loc = sizes(model, level).select(F.col(level).alias("name"), "loc")
    owned = ownership(model, level).select("name", F.col("main_dev").alias("author")).join(loc, "name")
    return owned.groupBy("author").agg(F.count("*").alias("keys"), F.sum("loc").alias("loc")).orderBy(F.desc("loc"), "author")


def newest_commits(model: Model) -> DataFrame:
    """(change, commit_id): each repo's newest commit as a change."""
    return model.commits.groupBy("repo").agg(F.max(F.struct("ts", "commit_id")).alias("p")).select(F.col("repo").alias("change"), F.col("p.commit_id").alias("commit_id"))


def ticket_changes(model: Model) -> DataFrame:
    """(change, commit_id): each ticket's commits as a change."""
    return model.commits.select(F.explode("tickets").alias("change"), "commit_id").distinct()


def size_rollup(model: Model) -> DataFrame:
    """Lines of code and files at every level in one table."""
    out = None
    for level in ("entity", "unit", "repo"):
        part = sizes(model, level).select(F.lit(level).alias("level"), F.col(level).alias("name"), "loc", "files")
        out = part if out is None else out.unionByName(part)
    return out
