"""The model from star-schema tables: orders are commits, parts are files, customers are authors.

A commit is what an order has of one part type; its lines are the changes. Types are repositories, a type's brands its
units and its part names its entities. Orders name their ticket in the message, so that tickets join repositories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.plans.model import Model, Params, build
from revlens.plans.staging import exists

#: The tables are small commits drawn at random: confidences are low, few commits are large, and nobody owns anything.
#: These thresholds let every rule find something in them.
TABLE_PARAMS = Params(
    max_commit_files=4, min_confidence=0.05, hidden_degree=0.05, shotgun_average=0.5, graph_confidence=0.05, missed_confidence=0.05,
    defect_density=0.3, defect_ratio=0.9, bus_people=1_000_000, bus_share=0.0,
)
LANGS = ("typescript", "php", "template", "scss", "data")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    lang = F.element_at(F.array(*map(F.lit, LANGS)), (k % len(LANGS) + 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in (1.0, 1.0, 0.8, 0.5, 0.3)]), (k % len(LANGS) + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), k.cast("string")).alias("file"),
        F.concat_ws("/", "p_type", "p_name").alias("entity"),
        F.concat_ws("/", "p_type", "p_brand").alias("unit"),
        F.col("p_type").alias("repo"),
        (size % 10 != 0).alias("alive"),
        (k % 7 == 0).alias("test"),
        lang.alias("lang"),
        weight.alias("lang_weight"),
        (size * 20).cast("long").alias("loc"),
        (F.floor("p_retailprice") % 97).cast("double").alias("complexity"),
        (1 + size % 10).cast("double").alias("health"),
    )


_STAGED: dict[tuple, Model] = {}
KEPT_MODELS = 8


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    """from_tables(), staged: cleaned once in a session for as long as its tables are the same files, and what was written is there.

    The first call of a session runs the cleaning; queries on the model run what they stage while they are built.
    """
    state = []
    for name in ("part", "customer", "orders", "lineitem"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        state += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    key = (spark.sparkContext.applicationId, *state)
    if key not in _STAGED or not all(exists(spark, f) for d in (_STAGED[key].commits, _STAGED[key].changes, _STAGED[key].files) for f in d.inputFiles()[:1]):
        while len(_STAGED) >= KEPT_MODELS:
            _STAGED.pop(next(iter(_STAGED)))
        _STAGED[key] = from_tables(spark, sf_dir, staged=True)
    return _STAGED[key]


def from_tables(spark: SparkSession, sf_dir: str, params: Params = TABLE_PARAMS, staged: bool = False) -> Model:
    customers = read(spark, sf_dir, "customer")
    file = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("file")
    lines = read(spark, sf_dir, "lineitem").select(file, F.col("l_orderkey").alias("of"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))
    # By file, as they meet the files again.
    files = part_files(spark, sf_dir)
    changes = lines.join(files.select("file", F.col("repo").alias("type")), "file").select(F.concat_ws(":", F.col("of").cast("string"), "type").alias("commit_id"), "of", "file", "added", "deleted")
    # The number of customers is one row.
    n = F.broadcast(customers.agg(F.count("*").alias("n")))
    orders = read(spark, sf_dir, "orders").join(n)
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", "fix: urgent order").when(F.col("o_orderpriority") == "2-HIGH", "bugfix for order").when(F.col("o_orderpriority") == "5-LOW", "chore: release 1.2.3").otherwise("feat: order")
    # An order tells of all its commits.
    commits = orders.select(
        F.col("o_orderkey").alias("of"),
        F.col("o_custkey").alias("author"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array((F.col("o_custkey") + 1) % F.col("n"))).otherwise(F.array().cast("array<bigint>")).alias("coauthors"),
        F.unix_timestamp("o_orderdate").alias("ts"),
        F.concat(subject, F.lit("\n\nORD-"), F.col("o_orderkey").cast("string")).alias("message"),
    )
    authors = customers.select(F.col("c_custkey").alias("author"), F.col("c_nationkey").cast("string").alias("team"), F.col("c_name").alias("name"))
    bots = customers.filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("author"))
    return build(commits, changes, files, authors, bots, params, staged)
