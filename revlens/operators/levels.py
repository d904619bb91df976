"""Hotspots and ownership of files, entities, units and repositories at once: the changes are read and expanded in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions.numeric import DAY, decay, with_percentile, with_rank
from revlens.operators.hotspots import normalized_files
from revlens.plans.model import LEVELS, Model, Scope
from revlens.plans.staging import stage


def _of_each_level(df: DataFrame, *columns: str | Column) -> DataFrame:
    """level, name and columns: a row for each level's key. Rows stay where they are, so that they can be dealt out before."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in LEVELS])).alias("k")
    return df.select(each, *columns).select("k.level", "k.name", "*").drop("k")


def history_of_levels(model: Model, scope: Scope = Scope()) -> DataFrame:
    """level, name, revisions, rev_w, defects, last_ts, churn, now: a commit counts once for each key."""
    rows = model.changes.filter(scope.files() & scope.commits())
    rows = rows.withColumn("w", F.col("weight") * decay(F.col("now") - F.col("ts"), model.params.half_life_days)).withColumn("churn", F.col("added") + F.col("deleted"))
    # Changes that have others in their commit are dealt by it before they are made one for each level.
    one, many = rows.filter("n_changes = 1"), rows.filter("n_changes > 1").repartition("commit_id")
    per = _of_each_level(many, "commit_id", "w", "defect", "ts", "churn", "now").groupBy("level", "name", "commit_id")
    per = per.agg(F.max("w").alias("w"), F.max("defect").alias("defect"), F.max("ts").alias("ts"), F.sum("churn").alias("churn"), F.max("now").alias("now")).drop("commit_id")
    per = _of_each_level(one, "w", "defect", "ts", "churn", "now").unionByName(per)
    return per.groupBy("level", "name").agg(
        F.count("*").alias("revisions"), F.sum("w").alias("rev_w"), F.sum(F.col("defect").cast("long")).alias("defects"), F.max("ts").alias("last_ts"), F.sum("churn").alias("churn"), F.max("now").alias("now")
    )


def people_of_levels(model: Model, scope: Scope = Scope()) -> DataFrame:
    """level, name, authors, active_authors, main_dev, main_share: a change's lines are split among its authors."""
    rows = model.changes.filter(scope.files() & scope.commits())
    rows = rows.select(*LEVELS, F.explode("authors").alias("author"), ((F.col("added") + 1) / F.size("authors")).alias("part"))
    rows = _of_each_level(rows.repartition("author"), "author", "part")
    lines = rows.groupBy("level", "name", "author").agg(F.sum("part").alias("lines")).join(model.active().select("author", "active"), "author", "left")
    return lines.groupBy("level", "name").agg(
        F.count("*").alias("authors"),
        F.sum(F.col("active").cast("long")).alias("active_authors"),
        F.max_by("author", F.struct(F.round("lines", 6), -F.col("author"))).alias("main_dev"),
        F.round(F.max("lines") / F.sum("lines"), 4).alias("main_share"),
    )


def sizes_of_levels(model: Model, scope: Scope = Scope()) -> DataFrame:
    """level, name and size from alive files, tests only where there is nothing else; scoped as sizes() tells."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).alias("name")) for c in LEVELS])).alias("k")
    f = normalized_files(model).withColumn("inside", scope.files()).select(each, "inside", "test", "loc", "complexity", "health", "lang_weight", "norm_cx").select("k.level", "k.name", "inside", "test", "loc", "complexity", "health", "lang_weight", "norm_cx")
    key = Window.partitionBy("level", "name")
    whole = F.col("level").isin("file", "entity")
    f = f.filter(whole | F.col("inside")).withColumn("any", F.max(F.col("inside").cast("int")).over(key)).filter("any = 1")
    f = f.withColumn("some", F.max((~F.col("test")).cast("int")).over(key) == 1).filter(~F.col("some") | ~F.col("test"))
    return f.groupBy("level", "name").agg(
        F.sum("loc").alias("loc"), F.sum("complexity").alias("complexity"), F.count("*").alias("files"), F.min("health").alias("health"), F.min(F.col("test").cast("int")).cast("boolean").alias("test"),
        F.max((F.col("lang_weight") >= 0.5).cast("int")).cast("boolean").alias("code"), F.max("norm_cx").alias("max_norm"), F.round(F.sum(F.col("complexity") * F.col("lang_weight")), 6).alias("weighted"),
    )


def hotspots_of_levels(model: Model, scope: Scope = Scope()) -> DataFrame:
    """hotspots() of every level, with the level; each level is ranked by itself."""
    r = with_percentile(sizes_of_levels(model, scope), "among", "weighted", "level").withColumn("norm", F.when(F.col("level").isin("unit", "repo"), F.col("among")).otherwise(F.col("max_norm")))
    r = r.join(history_of_levels(model, scope), ["level", "name"], "left").join(people_of_levels(model, scope), ["level", "name"], "left")
    # A row for each key, written once: the largest of them would read all changes again.
    r = stage(r.fillna(0, ["revisions", "rev_w", "defects", "churn", "authors", "active_authors"]), "scored")
    r = r.withColumn("norm", F.when(F.col("test"), F.col("norm") * 0.5).otherwise(F.col("norm")))
    top = r.groupBy("level").agg(F.max(F.when(F.col("code") & ~F.col("test"), F.col("rev_w"))).alias("a"), F.max("rev_w").alias("b"))
    r = r.join(F.broadcast(top.select("level", F.when(F.coalesce("a", F.lit(0.0)) > 0, F.col("a")).otherwise(F.col("b")).alias("max_rw"))), "level")  # four rows
    freq = F.when(F.col("max_rw") > 0, F.least(F.log(1 + F.col("rev_w")) / F.log(1 + F.col("max_rw")), F.lit(1.0))).otherwise(0.0)
    r = r.withColumn("score", F.when(F.col("revisions") == 0, 0.0).otherwise(F.round(freq * F.col("norm"), 3))).withColumn("rev_w", F.round("rev_w", 4))
    r = with_rank(r, "place", F.asc("level"), F.desc("score"), F.desc("rev_w"), F.asc("name"))
    first = r.groupBy("level").agg(F.min("place").alias("first"))
    r = r.join(F.broadcast(first), "level").withColumn("rank", F.col("place") - F.col("first") + 1)  # four rows
    return r.select(
        "level", "rank", "name", "score", F.round("norm", 4).alias("norm"), "revisions", "rev_w", "churn", "defects",
        F.round(F.when(F.col("revisions") > 0, F.col("defects") / F.col("revisions")).otherwise(0.0), 4).alias("defect_density"), F.floor((F.col("now") - F.col("last_ts")) / DAY).cast("long").alias("age_days"),
        "loc", "complexity", "health", "files", "test", "code", "authors", "active_authors", "main_dev", "main_share",
    )


def ownership_of_levels(model: Model, scope: Scope = Scope()) -> DataFrame:
    """ownership() of every level, with the level."""
    alive = model.changes.filter("alive").select(*LEVELS, "added", "authors", "format", "ts", "now", (scope.files() & scope.commits()).alias("inside"))
    known = F.when(F.col("inside") & ~F.col("format"), (F.col("added") + 1) / F.size("authors"))
    recent = F.col("ts") >= F.col("now") - 365 * DAY
    rows = alive.select(*LEVELS, F.explode("authors").alias("author"), known.alias("part"), recent.alias("recent"))
    # One pass: an author's lines and whether they are recent, for each key of each level. Rows are dealt by author before they are made more.
    k = _of_each_level(rows.repartition("author"), "author", "part", "recent").groupBy("level", "name", "author").agg(F.sum("part").alias("lines"), F.max("recent").alias("recent"))
    k = k.join(model.active().select("author", "active"), "author")
    key = Window.partitionBy("level", "name")
    k = k.withColumn("recent_authors", F.count_if("recent").over(key)).filter("lines is not null")
    k = k.withColumn("share", F.round(F.col("lines") / F.sum("lines").over(key), 9))
    before = F.sum("share").over(key.orderBy(F.desc("share"), "author").rowsBetween(Window.unboundedPreceding, -1))
    k = k.withColumn("before", F.round(F.coalesce(before, F.lit(0.0)), 6))
    owned = k.groupBy("level", "name").agg(
        F.max_by("author", F.struct("share", -F.col("author"))).alias("main_dev"), F.round(F.max("share"), 3).alias("main_share"), F.round(1 - F.sum(F.col("share") * F.col("share")), 3).alias("fragmentation"),
        F.round(F.sum(F.when(~F.col("active"), F.col("share")).otherwise(0.0)), 3).alias("knowledge_loss"), F.sum((F.col("before") <= 0.5).cast("long")).alias("bus_factor"), F.count("*").alias("authors"),
        F.max("recent_authors").alias("recent_authors"),
    )
    return owned
