"""Near-duplicates by a chosen-path set-similarity join.

Documents with one shingle set form a class, and classes with one set are joined no further. Each class has TREES
independent trees of DEPTH minwise values. A tree branches classes by their first value; a node with few classes is
compared exhaustively, a larger one branches again by the next value, and so on. Pairs whose values agree well enough in a
small node, and all classes of a node that is still large at the last level, are put into one candidate group. So a
candidate group holds every similar pair that met in any tree. A pair at the threshold s misses all trees with a
probability of (1 - s^DEPTH)^TREES at most: 2e-8 for 0.85, 3e-6 for 0.8.

Within candidate groups full shingle sets are compared exactly, in two rounds. A group is cut into blocks of bounded
size, and each block is compared in one task with itself and with some of the group's classes as pivots. What is linked,
over classes of its task, to the pivot with the most links among pivots is in one component with it. Only the others, the
rest, are then compared with the whole group, block by block. A group of near copies so takes one round, each text moved
once. Components of the exact links are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import NO_ID, small_batches, stage, table, text_of
from revlens.operators.identity import components as connected_components

TREES = 24
DEPTH = 4
#: Nodes with more classes branch again.
NODE = 48
#: Shingles of a block of a candidate group; a pair of blocks is compared in one task.
BLOCK_SHINGLES = 1_000_000
BLOCK_CLASSES = 1024
#: Classes of a group of several blocks that all its blocks are compared with, about.
PIVOTS = 128
SALTS = 8
OWN, PIVOT, ALONE, REST, OTHER = range(5)
RANK = np.array([0, 1, 0, 1, 0])
#: Minwise values agree well enough in a small node from so many standard deviations under the threshold.
DEVIATIONS = 5.0

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; of all words as one if there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        out = _mix((out + h[k : k + n]) * _P)
    return np.unique(out)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the trees' hash functions."""
    out = np.empty(len(_MULTIPLY), np.uint64)
    for i, (a, b) in enumerate(zip(_MULTIPLY, _ADD, strict=True)):
        out[i] = (shingles * a + b).min()
    return _mix(out)


def _path_keys(values: np.ndarray) -> np.ndarray:
    """For each tree and level the hash of the values down to that level."""
    v = values.reshape(TREES, DEPTH)
    keys = np.empty((TREES, DEPTH), np.uint64)
    h = np.arange(1, TREES + 1, dtype=np.uint64) * _P
    for level in range(DEPTH):
        h = _mix((h ^ v[:, level]) * _P)
        keys[:, level] = h
    return keys


def _signatures(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, paths, sketches = [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), width)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                values = minwise(s) if len(s) else np.zeros(TREES * DEPTH, np.uint64)
                paths.append(_path_keys(values).astype("<u8").tobytes() if len(s) else None)
                sketches.append(values.astype(np.uint8).tobytes() if len(s) else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, paths, sketches))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n_shingles", "set_key", "paths", "sketch"])

    return rows


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_key, tree, keys by level) for each class and tree."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        keys = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), "<i8").reshape(n * TREES, DEPTH)
        owners = batch.column(0).take(pa.array(np.repeat(np.arange(n), TREES)))
        columns = [owners, *(pa.array(np.ascontiguousarray(keys[:, i])) for i in range(DEPTH))]
        yield pa.RecordBatch.from_arrays(columns, ["set_key", *(f"k{i}" for i in range(DEPTH))])


def _agreeing(percent: int):
    """Edges of a spanning forest of each small node's graph of well-agreeing classes."""
    share = percent / 100
    least = share - DEVIATIONS * (share * (1 - share) / (TREES * DEPTH)) ** 0.5

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                keys = [m["set_key"] for m in members]
                x = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(len(keys), -1)
                close = (x[:, None, :] == x[None, :, :]).mean(axis=2) >= least
                for i, root in enumerate(_components(close)):
                    if root != i:
                        a.append(keys[root])
                        b.append(keys[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows


def _components(close: np.ndarray) -> list[int]:
    """The first member of each member's component."""
    n = len(close)
    root = [-1] * n
    for i in range(n):
        if root[i] < 0:
            stack = [i]
            root[i] = i
            while stack:
                for k in np.flatnonzero(close[stack.pop()]):
                    if root[k] < 0:
                        root[k] = i
                        stack.append(int(k))
    return root


def _candidate_edges(classes: DataFrame, percent: int) -> DataFrame:
    """Edges whose components hold every similar pair that met in any tree."""
    level = stage(classes.select("set_key", "paths").mapInArrow(_exploded, "set_key binary, " + ", ".join(f"k{i} long" for i in range(DEPTH))), "paths")
    sketches = classes.select("set_key", "sketch")
    leaves, edges = None, None
    for i in range(DEPTH):
        key = f"k{i}"
        counts = level.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        met = stage(level.join(counts, key), f"nodes-{i}")
        small = met.filter(F.col("n") <= NODE).select("set_key", F.col(key).alias("node"))
        leaves = small if leaves is None else leaves.union(small)
        level = met.filter(F.col("n") > NODE).drop("n")
    # Still large at the last level: all of a node's classes go together, around its smallest.
    center = level.groupBy(key).agg(F.min("set_key").alias("a"))
    edges = level.join(center, key).filter(F.col("a") != F.col("set_key")).select("a", F.col("set_key").alias("b")).distinct()
    # NODE classes at most meet here.
    nodes = leaves.join(sketches, "set_key").groupBy("node").agg(F.collect_list(F.struct("set_key", "sketch")).alias("members"))
    return edges.union(nodes.select("members").mapInArrow(_agreeing(percent), "a binary, b binary").distinct())


def _exact_links(width: int, percent: int):
    """Of the classes of one task: spanning edges (a, b) of the exact links, and rows (a, null) of those in the rest.

    Roles are OWN, a class of a block of several; PIVOT; ALONE, a class of a group of one block; and in the second
    round REST and OTHER, of whose links only those with one of the rest are looked for.
    """

    def link(group: pa.Table) -> pa.Table:
        role = np.array(group.column("role").to_pylist())
        names = np.array(group.column("set_key").to_pylist(), dtype=object)
        # A class that comes in two roles counts in the one that matters.
        order = np.lexsort((-RANK[role], np.argsort(np.argsort(names, kind="stable"), kind="stable")))
        order = order[np.append(True, names[order][1:] != names[order][:-1])]
        group, role = group.take(pa.array(order)), role[order]
        keys = group.column("set_key").to_pylist()
        sets = [shingle_set(t.as_py(), width) for t in group.column("text")]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        by_shingle = np.argsort(ids, kind="stable")
        posted, count = owner[by_shingle], np.bincount(ids)
        first = np.cumsum(count) - count
        starts = np.cumsum(size) - size
        root = list(range(len(sets)))
        degree = np.zeros(len(sets), np.int64)
        second = bool((role >= REST).any())

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        a, b = [], []
        for i in np.flatnonzero(role == REST).tolist() if second else range(len(sets)):
            own = ids[starts[i] : starts[i] + size[i]]
            own = own[count[own] > 1]
            n = count[own]
            at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            stop = len(sets) if second else i
            both = np.bincount(posted[at], minlength=len(sets))[:stop]
            union = size[:stop] + size[i] - both
            for k in np.flatnonzero(100 * both >= percent * union).tolist():
                if k == i:
                    continue
                if role[i] == role[k] == PIVOT:
                    degree[i] += 1
                    degree[k] += 1
                x, y = top(k), top(i)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(keys[k])
                    b.append(keys[i])
        if (role <= PIVOT).any():  # the same pivots, and so the same one, in all tasks of the group
            pivots = np.flatnonzero(role == PIVOT)
            main = top(int(pivots[np.argmax(degree[pivots])])) if len(pivots) else -1
            rest = [keys[i] for i in range(len(keys)) if top(i) != main]
            a, b = a + rest, b + [None] * len(rest)
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return link


def _links(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (a, b) with the components of all exact links, for members(set_key, label, n, block, blocks, text)."""
    all_blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    pivot = F.pmod(F.xxhash64("set_key", F.lit("pivot")), F.col("n")) < PIVOTS
    own = members.select("label", F.col("block").alias("low"), F.lit(-1).alias("high"), "set_key", F.when(F.col("blocks") > 1, OWN).otherwise(ALONE).alias("role"), "text")
    pivots = members.filter((F.col("blocks") > 1) & pivot).select("label", F.explode(all_blocks).alias("low"), F.lit(-1).alias("high"), "set_key", F.lit(PIVOT).alias("role"), "text")
    found = stage(own.unionByName(pivots).groupBy("label", "low").applyInArrow(_exact_links(width, percent), "a binary, b binary"), "links")
    rest = members.filter("blocks > 1").join(found.filter("b is null").select(F.col("a").alias("set_key")).distinct(), "set_key", "left_semi")
    rest = stage(rest, "rest")
    # The rest's own blocks, as many as they need, each with all blocks of the group.
    many = rest.groupBy(F.col("label").alias("of")).agg(F.ceil(F.count("*") / BLOCK_CLASSES).cast("int").alias("rest_blocks"))
    part = F.pmod(F.xxhash64("set_key", F.lit("rest")), F.col("rest_blocks")).cast("int")
    # A group's label is that of very many rows: what is joined to it has one row for each group, dealt out with each block.
    many = many.join(members.filter("blocks > 1").select(F.col("label").alias("of"), "block", "blocks").distinct(), "of")
    on = lambda d: (F.col("label") == F.col("of")) & (d["block"] == many["block"])
    large = members.filter("blocks > 1")
    ones = rest.join(many, on(rest)).select("label", part.alias("low"), F.explode(F.sequence(F.lit(0), many["blocks"] - 1)).alias("high"), "set_key", F.lit(REST).alias("role"), "text")
    twos = large.join(many, on(large)).select("label", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("low"), large["block"].alias("high"), "set_key", F.lit(OTHER).alias("role"), "text")
    more = ones.unionByName(twos).groupBy("label", "low", "high").applyInArrow(_exact_links(width, percent), "a binary, b binary")
    return found.filter("b is not null").unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept, text_hash and keeper for each row, linking rows whose shingle sets are similar.

    A-Z are lower-cased; words are runs of anything but ASCII white space; sets are of width-word shingles; rows are
    linked where 100 * intersection >= percent * union. component_id is the smallest id reachable. Null and empty texts
    have no shingles and are linked with nothing. Null ids come last: they lend a component no id unless it has no
    other. Repeated rows with one id and text share a component, and all with the smallest id are kept; keeper marks the
    smallest row by id and text_hash alone. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    kinds = "id long, text_hash long, n_shingles long, set_key binary, paths binary, sketch binary"
    signed = stage(d.select("id", "text_hash", "text").mapInArrow(_signatures(width), kinds), "signatures")
    filled = signed.filter("n_shingles > 0")
    first = F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_hash"))
    classes = filled.groupBy("set_key").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    classes = stage(classes, "classes")

    groups = connected_components(_candidate_edges(classes, percent))
    sized = groups.join(classes.select(F.col("set_key").alias("node"), "first", "n_shingles"), "node")
    blocks = sized.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = blocks.select("label", "n", F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # A large group's label is on very many rows: its counts are dealt to several parts.
    blocks = blocks.select(F.col("label").alias("of"), "n", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = sized.join(blocks, (F.col("label") == F.col("of")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("salt")))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("node", "label", "n", "block", "blocks", F.col("first.id").alias("of_id"), F.col("first.text_hash").alias("of_hash"))
    # One row of each class brings its text.
    texts = d.select(F.coalesce("id", F.lit(NO_ID)).alias("of_id"), F.col("text_hash").alias("of_hash"), "text")
    members = placed.join(texts, ["of_id", "of_hash"]).dropDuplicates(["node"]).select(F.col("node").alias("set_key"), "label", "n", "block", "blocks", "text")
    parts = connected_components(_links(stage(members, "members"), width, percent))

    # The smallest row of each component; most classes are one alone.
    named = classes.select("set_key", "first").join(parts.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.withColumn("part", F.coalesce("label", "set_key"))
    lowest = named.groupBy("part").agg(F.min("first").alias("keeper"))
    named = named.join(lowest, "part").select("set_key", "keeper")
    out = signed.select("id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(named, "set_key", "left")
    component = F.when(F.col("keeper.id") != NO_ID, F.col("keeper.id")).otherwise(F.col("id"))
    own = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_hash")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "text_hash", F.coalesce(F.col("keeper") == own, F.lit(True)).alias("keeper"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each component of near_duplicates(): the smallest, by id and then by text hash.

    Of rows with equal id and text one stays, whatever their other columns. Null and empty texts are linked with nothing:
    one row stays of each id, and one without an id. Null ids come last. An empty table gives an empty result. Other
    columns are handed on, whatever their names.
    """
    # Keys without nulls: identical rows are then found in the join's own partitions, and texts move once.
    keys = {"__dedup_known": F.col(id_col).isNotNull(), "__dedup_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))}
    keepers = near_duplicates(docs, width, percent, id_col, text_col).filter("keeper").select(*[k.alias(n) for n, k in keys.items()], F.col("text_hash").alias("__dedup_hash"))
    d = docs.withColumns({**keys, "__dedup_hash": F.xxhash64(text_of(text_col))})
    return d.join(keepers, [*keys, "__dedup_hash"], "left_semi").dropDuplicates([*keys, "__dedup_hash"]).select(*docs.columns)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "keeper")


ORACLE: dict[str, str] = {}
QUERIES = {"op8_near_dup": op8_near_dup}
