"""Numeric column functions: decay, tie-averaged percentiles, ratios."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.plans.staging import stage

LN2 = 0.6931471805599453
DAY = 86_400


def decay(age_seconds: Column, half_life_days: float) -> Column:
    """1 for no age, half of it after each half-life; always 1 without a half-life."""
    if half_life_days <= 0:
        return F.lit(1.0)
    return F.exp(-(F.greatest(age_seconds / F.lit(float(DAY)), F.lit(0.0)) / F.lit(float(half_life_days))) * F.lit(LN2))


def with_percentile(df: DataFrame, name: str, value: str, *partition: str) -> DataFrame:
    """df with name: the rank of value in its partition from 0 to 1, ties at the middle of their ranks, 1 for a single row.

    Rows are counted by value first, so that a window holds a row for each different value, not for each row.
    """
    counts = df.groupBy(*partition, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*partition).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(order), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*partition))
    rank = F.when(total == 1, F.lit(1.0)).otherwise((below + (F.col("_n") - 1) / 2) / (total - 1))
    keys = [*partition, value]
    counts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], rank.alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(counts, reduce(lambda x, y: x & y, same)).drop(*[f"_of_{k}" for k in keys])


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with name: each row's number, from 1, in this order. Rows are range-sorted, no task holds all.

    What is ranked is written to the shared folder before and after it is sorted: the first so that finding the ranges
    does not compute it twice, the second so that the numbers stay those of the rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(df, "to-rank").repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = stage(rows, "ranked").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("_before")
    return rows.join(F.broadcast(parts), "_part").withColumn(name, number.cast("long")).drop("_at", "_part", "_before")


def duration_seconds(text: str) -> float | None:
    """Seconds of "3 years", "2y", "90 days"; None for all of time."""
    m = re.fullmatch(r"\s*([\d.]+)\s*([a-z]+)\s*", text.lower())
    if not m:
        return None
    days = {"y": 365.25, "m": 30.44, "w": 7.0, "d": 1.0}.get(m[2][0])
    return None if days is None else float(m[1]) * days * DAY
