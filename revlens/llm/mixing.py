"""Mixing sources to target weights along a curriculum (DataFrame functions only).

A source's weight changes linearly over the training run, w(t) = 1 + slope * (2t - 1) for t in [0, 1]; its integral is
the source's demand for tokens up to t. Each document copy sits at a place in its source's token stream, and inverting
the cumulative demand there gives the copy's training position. Documents are then range-sorted by position.

Nothing gathers a source in one task: documents are placed by a hash, summed in blocks of about BLOCK rows, block sums
are added up per source, and running sums inside a block need that block only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import WORD, stage, table, text_of

# Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Slopes of the weight schedules, dealt to sources in order: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
BLOCK = 4096
#: Parts that a source's rows are dealt to where they meet its target.
SALTS = 8


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_docs, weight, slope, target for each source of sizes(source, size).

    Targets split share times all words by weight. A target stops at max_epochs times its source; the excess goes to
    the others by weight. One level, words per unit of weight, settles it: sources fill up in order of size to weight.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (F.col("rank") % len(xs) + 1).cast("int"))
    s = s.withColumn("rank", rank).withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES)).withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - filled) / open_).withColumn("k", F.row_number().over(order))
    # The first source, in this order, that its share doesn't fill sets the level for all after it.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("k", "level"))
    s = s.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "n_docs", "weight", "slope", target.alias("target"))


def _invert(share: Column, slope: Column) -> Column:
    """t with demand(t) = share, where demand(t) = (1 - slope) t + slope t^2 is the integral of the weight schedule."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with __mix_source, __mix_key, the same without nulls, __mix_size and __mix_place: a number below 2^52 by a hash of id and text."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text_of(text_col))
    return docs.withColumns(
        {
            "__mix_source": F.col(source_col).cast("string"),
            "__mix_key": _source_key(F.col(source_col)),
            "__mix_size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"),
            "__mix_place": F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long"),
        }
    )


def _source_key(source: Column) -> Column:
    """A key without nulls: rows that meet by it and a block stay where they are for a window over both, so that texts move once."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("-"))


def _block() -> Column:
    return F.floor(F.col("__mix_place") / F.lit(float(1 << 52)) * F.ceil(F.col("__mix_n_docs") / BLOCK))


def _copied(docs: DataFrame, marks: DataFrame, tie: Column) -> DataFrame:
    """docs of _marked() with __mix_source_size, __mix_target, __mix_slope, __mix_at and __mix_copies.

    marks is the same table, or what of it _marked() made. A source's documents stand in the order of their places:
    each block's beginning comes from sums by block, and a place in the block from a running sum there.
    """
    targets = source_targets(marks.select(F.col("__mix_source").alias("source"), F.col("__mix_size").alias("size")))
    targets = targets.select(_source_key(F.col("source")).alias("__mix_of"), *[F.col(c).alias(f"__mix_{c}") for c in ("source_size", "n_docs", "slope", "target")])
    # Written, so that Spark knows how few they are before it deals any text by source; should they be many, in parts.
    targets = stage(targets, "mix-targets").withColumn("__mix_of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = (F.col("__mix_key") == F.col("__mix_of")) & (F.pmod("__mix_place", F.lit(SALTS)) == F.col("__mix_of_salt"))
    with_targets = lambda d: d.join(targets, mine).drop("__mix_of", "__mix_of_salt").withColumn("__mix_block", _block())
    sums = with_targets(marks).groupBy("__mix_key", "__mix_block").agg(F.sum("__mix_size").alias("size"))
    earlier = Window.partitionBy("__mix_key").orderBy("__mix_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("__mix_key").alias("__mix_of"), F.col("__mix_block").alias("__mix_of_block"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("__mix_before"))
    d = with_targets(docs).join(sums, (F.col("__mix_key") == F.col("__mix_of")) & (F.col("__mix_block") == F.col("__mix_of_block"))).drop("__mix_of", "__mix_of_block")
    inside = Window.partitionBy("__mix_key", "__mix_block").orderBy("__mix_place", tie, "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    size, target, whole = F.col("__mix_size"), F.col("__mix_target"), F.col("__mix_source_size")
    d = d.withColumn("__mix_at", F.col("__mix_before") + F.coalesce(F.sum(size).over(inside), F.lit(0)) + size / 2)
    epochs = F.when(whole > 0, F.floor(target / whole)).otherwise(0)
    once_more = F.when((F.col("__mix_at") < target - epochs * whole) & (size > 0), 1).otherwise(0)
    return d.withColumn("__mix_copies", (epochs + once_more).cast("int"))


def _position(k: Column) -> Column:
    """Where in training copy number k of a document stands."""
    share = (F.col("__mix_at") + k * F.col("__mix_source_size")) / F.col("__mix_target")
    return F.when(F.col("__mix_copies") > 0, F.round(_invert(F.least(share, F.lit(1.0)), F.col("__mix_slope")), 9))


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies, taken, first_position, last_position.

    size is the number of words, 0 for null texts. Each source's documents stand in an order fixed by a hash of id and
    text, so reruns agree. All are taken floor(target / source_size) times, and once more those whose middle word lies
    before the rest of the target; no document is taken more than max_epochs times. positions are null where copies is
    0. Null sources form one source, last in order. Repeated rows stand next to each other and are counted each. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    sized = stage(_marked(named, "id", "text", "source").drop("text", "source"), "mix-sizes")
    d = _copied(sized, sized, F.col("id"))
    return d.select(
        F.col("id").alias(id_col),
        F.col("__mix_source").alias("source"),
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        F.col("__mix_copies").alias("copies"),
        (F.col("__mix_copies") * F.col("__mix_size")).cast("long").alias("taken"),
        _position(F.lit(0)).alias("first_position"),
        _position(F.col("__mix_copies") - 1).alias("last_position"),
    )


def in_training_order(mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Range-sorted by position, documents that are not taken last."""
    return mix.orderBy(F.col("first_position").asc_nulls_last(), id_col)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns, each row as often as curriculum_mix() takes it, range-sorted by training position.

    Rows without words, null texts among them, are taken as often as all of their source, never once more. Repeated rows are taken each as often as its own place
    says, copies of a row at the positions of their own. Null ids and sources, and an empty table, as told there. Other
    columns are handed on, whatever their names.
    """
    marked = _marked(docs, id_col, text_col, source_col)
    marks = stage(marked.select("__mix_source", "__mix_key", "__mix_size", "__mix_place"), "mix-sizes")
    d = _copied(marked, marks, F.col(id_col)).filter("__mix_copies > 0")
    d = d.withColumn("__mix_copy", F.explode(F.sequence(F.lit(0), F.col("__mix_copies") - 1)))
    return d.withColumn("__mix_position", _position(F.col("__mix_copy"))).orderBy("__mix_position", id_col, "__mix_copy").select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum_mix(table(spark, sf_dir, "documents"))
    return in_training_order(mix).select("doc_id", "size", "source_size", "target", "taken", "first_position")


ORACLE = {
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][rank % 3 + 1]::DOUBLE AS slope, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY cap / weight, rank) AS k FROM w),
m AS (SELECT *, arg_min(level, k) FILTER (level * weight <= cap) OVER () AS lvl FROM l),
t AS (SELECT source, source_size, slope, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, lvl * weight) END AS target FROM m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + d.size / 2.0::DOUBLE AS mid
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM p),
c AS (SELECT *, (epochs + CASE WHEN mid < target - epochs * source_size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS copies, least(mid / target, 1.0::DOUBLE) AS y FROM e)
SELECT doc_id, size, source_size, target, copies * size AS taken,
       CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END, 9) END AS first_position
FROM c"""
}
QUERIES = {"op5_mixing": op5_mixing}
