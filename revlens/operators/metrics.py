"""Metrics of file contents, each content measured once: a table keyed by content hash and language that grows by what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import paths
from revlens.functions.components import SCRIPTS, component_of, links_of
from revlens.functions.health import health
from revlens.operators.cleaning import is_binary
from revlens.plans.staging import exists, stage

KEY = ("blob", "lang")


def blob_hash(content: Column) -> Column:
    """The hash that version control gives a content: of its kind, its length and its bytes."""
    head = F.concat(F.lit("blob "), F.length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), content))


def measured(blobs: DataFrame, max_bytes: int) -> DataFrame:
    """blob, lang, size, state, loc, complexity, component, health, health_reasons for blobs(blob, lang, path, content).

    state is text, or why nothing else is measured: binary, oversize or generated. Complexity is by indentation. Functions,
    nesting and the complexity of templates are a parser's; without them they cost no health.
    """
    content = F.col("content")
    text = F.decode(content, "utf-8")
    state = F.when(is_binary(content), "binary").when(F.length(content) > max_bytes, "oversize").when(paths.is_generated(text), "generated").otherwise("text")
    m = blobs.select("blob", "lang", "path", F.length(content).cast("long").alias("size"), state.alias("state"), text.alias("text"))
    m = m.withColumn("text", F.when(F.col("state") == "text", F.col("text")))
    m = m.withColumns({
        "loc": paths.non_blank_lines(F.col("text")).cast("long"),
        "indent": paths.indent_complexity(F.col("text")),
        "component": F.when(F.col("lang").isin(*SCRIPTS), component_of(F.col("path"), F.col("text"))),
        "generated": F.col("state") != "text",
        "functions": F.array().cast("array<struct<name:string,cc:int,loc:int>>"),
        "max_nesting": F.lit(None).cast("int"),
        "methods": F.lit(None).cast("int"),
    }).withColumns({"deps": F.col("component.deps"), "inputs": F.col("component.inputs"), "complexity": F.lit(None).cast("double")})
    h = health()
    return m.select("blob", "lang", "size", "state", "loc", F.col("indent").alias("complexity"), "component", h["health"].alias("health"), h["reasons"].alias("health_reasons"))


def contents(tree: DataFrame) -> DataFrame:
    """blob, lang, path, content of tree(repo, path, content, and blob where known), each content once for each language."""
    hashed = F.coalesce("blob", blob_hash(F.col("content"))) if "blob" in tree.columns else blob_hash(F.col("content"))
    t = tree.filter(F.col("content").isNotNull()).select(hashed.alias("blob"), paths.language(F.col("path")).alias("lang"), "path", "content")
    return t.groupBy(*KEY).agg(F.min_by(F.struct("path", "content"), "path").alias("c")).select(*KEY, "c.*")


def add_metrics(tree: DataFrame, at: str, max_bytes: int) -> int:
    """Measure what the table at the path does not have yet of the tree's contents, and append it; how many that were.

    What is new is found by keys before contents move, and binary and oversize contents are remembered too, so that a
    second run measures nothing. A job that died on the way can be repeated; metrics_at() reads each key once.
    """
    spark = tree.sparkSession
    hashed = F.coalesce("blob", blob_hash(F.col("content"))) if "blob" in tree.columns else blob_hash(F.col("content"))
    t = tree.filter(F.col("content").isNotNull()).select("path", "content", hashed.alias("blob"), paths.language(F.col("path")).alias("lang"))
    if exists(spark, at):
        t = t.join(spark.read.parquet(at).select(*KEY).distinct(), list(KEY), "left_anti")
    new = stage(measured(contents(t), max_bytes), "new-metrics")
    n = new.count()
    if n:
        new.write.mode("append").parquet(at)
    return n


def metrics_at(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.parquet(at).dropDuplicates(list(KEY))


def tree_metrics(tree: DataFrame, max_bytes: int, cache: str | None = None) -> DataFrame:
    """repo, path, blob and the metrics of each file of the tree; with cache, a path, only new contents are measured."""
    own = tree.select(tree["repo"], tree["path"], (F.coalesce("blob", blob_hash(F.col("content"))) if "blob" in tree.columns else blob_hash(F.col("content"))).alias("blob"), paths.language(F.col("path")).alias("lang"))
    if cache is None:
        m = measured(contents(tree), max_bytes)
    else:
        add_metrics(tree, cache, max_bytes)
        if not exists(tree.sparkSession, cache):  # no content yet
            m = measured(contents(tree), max_bytes)
        else:
            m = metrics_at(tree.sparkSession, cache)
    return own.join(m, list(KEY), "left").withColumn("links", links_of(F.col("component")))
