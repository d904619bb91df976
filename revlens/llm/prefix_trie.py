"""Trie of conversation prefixes, screened by a count-min sketch of prefix digests.

1. Rows are dealt by ranges of blocks and sorted; a task streams them and keeps a digest for each prefix. Texts move once.
2. Every task counts its prefixes in a count-min sketch whose cells stop at two, since only "one" and "more" are asked for.
   The tasks' sketches are merged block by block; what is left is one bit a cell, of a fixed size.
3. The sketch never estimates too low, so that an estimate of one proves a prefix to be its conversation's alone, and all
   longer ones too: that tail is emitted where it is found. Only the first row of a tail asks for its parent.
4. Prefixes that may be shared are grouped exactly. Each node belongs to its smallest member, so that every node of a
   subtree is counted by one member: sums over subtrees are sums over members, aggregated before they move.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import small_batches, stage, table
from revlens.llm.repair import sql_crc32

DIGEST = 16
ROOT = bytes(DIGEST)
#: The sketch: so many rows of so many cells (a power of two), whatever the data's size. Past some ten million distinct
#: prefixes fewer singles are proved and more is grouped exactly; the result is the same.
ROWS = 2
CELLS = 1 << 24
BLOCK = 1 << 16
#: Ids of a node's conversations are hashed in pieces of about so many characters.
PIECE = 1 << 16
BASE = 100
HEADS = 6
EMPTY = hashlib.sha256(b"").hexdigest()
SHARED, FIRST_OF_TAIL, TAIL = range(3)


def conversation_paths(conversations: DataFrame, base: Column | None = None, heads: Column | None = None) -> DataFrame:
    """conv_id, path (digests of its prefixes of one turn, two turns, ...) and chars (code points of each turn's text).

    With base and heads, a conversation begins with the first so many turns of conversation base (all if it has fewer, none
    if there is no such conversation), in place of as many of its own. Rows are dealt by base.
    """
    kind = conversations.schema["conv_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"conv_id must be an integer, not {kind}: nodes are named by their smallest member")
    small_batches(conversations.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    conv = F.col("conv_id").cast("long")
    heads = F.lit(0) if heads is None else heads
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        (conv if base is None else base.cast("long")).alias("base"), conv.alias("conv_id"), heads.cast("int").alias("heads"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")
    )
    rows = rows.withColumn("later", F.col("conv_id") != F.col("base"))
    rows = rows.repartitionByRange("base").sortWithinPartitions("base", "later", "conv_id", F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("base", "later", "conv_id", "heads", "role", "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        base_now, head, head_chars = None, [], []  # of the base's turns, as many as any conversation may take
        now = None
        path, chars, skip = [], [], 0

        def batch_of() -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, ["conv_id", "path", "chars"])

        for batch in batches:
            for block, later, conv, n, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != base_now:
                    base_now, head, head_chars = block, [], []
                if conv != now:
                    if now is not None:
                        out.append((now, b"".join(path), chars))
                        if len(out) >= 500:
                            yield batch_of()
                    now, skip = conv, n if later else 0
                    path, chars = (head[:n], head_chars[:n]) if later else ([], [])
                if skip:
                    skip -= 1
                    continue
                name, said = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                hashed = hashlib.blake2b(path[-1] if path else ROOT, digest_size=DIGEST)
                hashed.update(len(name).to_bytes(8, "little") + name)
                hashed.update(said)
                path.append(hashed.digest())
                chars.append(len(text))
                if not later and len(head) < HEADS:
                    head.append(path[-1])
                    head_chars.append(chars[-1])
        if now is not None:
            out.append((now, b"".join(path), chars))
            yield batch_of()

    return rows.mapInArrow(digests, "conv_id long, path binary, chars array<bigint>")


def _cells(path: bytes, cells: int) -> np.ndarray:
    """A row of cells for each digest of a path."""
    return np.frombuffer(path, "<u4").reshape(-1, DIGEST // 4)[:, :ROWS] & np.uint32(cells - 1)


def prefix_sketch(paths: DataFrame, cells: int = CELLS) -> list[bytes]:
    """For each row of the sketch one bit a cell: whether more than one prefix met there."""
    size = min(BLOCK, cells)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            met = _cells(b"".join(batch.column(0).to_pylist()), cells)
            for r in range(ROWS):
                at, n = np.unique(met[:, r], return_counts=True)
                counts[r, at] = np.minimum(counts[r, at] + np.minimum(n, 2), 2)
        for r in range(ROWS):
            for b in np.flatnonzero(counts[r].reshape(-1, size).any(axis=1)):
                part = counts[r, b * size : (b + 1) * size]
                bits = zlib.compress(np.packbits(part >= 1).tobytes() + np.packbits(part >= 2).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([bits], pa.binary())], ["r", "block", "bits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, b, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, more = np.frombuffer(zlib.decompress(bits), np.uint8).reshape(2, -1)
                if (r, b) in held:
                    seen = held[r, b]
                    seen[1] |= more | (seen[0] & one)
                    seen[0] |= one
                else:
                    held[r, b] = np.stack([one, more])
        for (r, b), seen in held.items():
            if seen[1].any():
                bits = zlib.compress(seen[1].tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([bits], pa.binary())], ["r", "block", "bits"])

    kind = "r int, block int, bits binary"
    parts = paths.select("path").mapInArrow(counted, kind).repartition("r", "block").mapInArrow(merged, kind)
    sketch = np.zeros((ROWS, cells // 8), np.uint8)
    for r, b, bits in parts.collect():  # ROWS * cells bits at the most
        sketch[r, b * size // 8 : (b + 1) * size // 8] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return [row.tobytes() for row in sketch]


def screened(paths: DataFrame, cells: int = CELLS) -> DataFrame:
    """A row for each prefix of each conversation: kind, conv_id, depth, digest, parent, chars, last, tail.

    SHARED prefixes, the root among them, may be of several conversations. Others are of one: the FIRST_OF_TAIL and the
    TAIL behind it. last: the conversation ends there; tail: the next prefix is the first of a tail.
    """
    sketch = paths.sparkSession.sparkContext.broadcast(prefix_sketch(paths, cells))
    names = ["kind", "conv_id", "depth", "digest", "parent", "chars", "last", "tail"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(b, np.uint8) for b in sketch.value]
        out: list[tuple] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for conv, path, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                met = _cells(path, cells)
                more = np.ones(len(met), bool)
                for r in range(ROWS):
                    more &= (bits[r][met[:, r] >> 3] >> (7 - (met[:, r] & 7)) & 1).astype(bool)
                alone = len(met) if more.all() else int(more.argmin())  # prefixes before this one may be shared
                parent = None
                for d in range(len(met) + 1):
                    digest = ROOT if d == 0 else path[(d - 1) * DIGEST : d * DIGEST]
                    kind = SHARED if d <= alone else FIRST_OF_TAIL if d == alone + 1 else TAIL
                    out.append((kind, conv, d, digest, parent, chars[d - 1] if d else 0, d == len(met), d == alone < len(met)))
                    parent = digest
                if len(out) >= 4000:
                    yield batch_of()
                    out.clear()
        if out:
            yield batch_of()

    return paths.mapInArrow(rows, "kind int, conv_id long, depth long, digest binary, parent binary, chars long, last boolean, tail boolean")


def ends_digest(ends: DataFrame) -> DataFrame:
    """digest, ends_sha256 of ends(digest, conv_id): the ids ascending, as decimals joined by commas.

    A node's ids are sorted by range, so that a very common conversation's are spread, and joined to pieces; then one task
    hashes a node's pieces as they come, since SHA-256 goes from left to right.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, None, [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["digest", "first", "ids"])
        for batch in batches:
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (digest != now or size >= PIECE):
                    yield made()
                    held, size = [], 0
                if not held:
                    now, first = digest, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["digest", "ends_sha256"])
        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != now:
                    if sha is not None:
                        yield made()
                    now, sha = digest, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if sha is not None:
            yield made()

    joined = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(pieces, "digest binary, first long, ids string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base: Column | None = None, heads: Column | None = None, cells: int = CELLS) -> DataFrame:
    """A row for each distinct prefix of the conversations(conv_id, turn, role, text), as deep as its number of turns.

    conv_id: the smallest of its members, the conversations that begin with it; depth; parent_conv_id: its parent's conv_id
    (root: null); n_convs: members; n_children: children; n_leaves: childless nodes in its subtree, itself included;
    saved_tokens: code points of last texts times (members - 1), over its subtree; ends_sha256: hash of the ids that end there.

    Turns stand in order of turn, nulls first, ties in order of role and text; null roles and texts count as empty. Equal
    rows are turns of their own. Rows without a conv_id are left out; conv_id must be an integer. base and heads are as
    conversation_paths() has them, at most HEADS turns. An empty table gives an empty result, without a root; other columns
    are ignored, whatever their names. A conversation's digests, 16 bytes a turn, have to fit in a task's memory. Jobs run while
    the result is built, and the session hands rows to Python in small batches from then on.
    """
    paths = stage(conversation_paths(conversations, base, heads), "trie-paths")
    rows = stage(screened(paths, cells), "trie-prefixes")
    shared, first = rows.filter(F.col("kind") == SHARED), rows.filter(F.col("kind") == FIRST_OF_TAIL)
    nodes = shared.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars")
    )
    nodes = stage(nodes, "trie-nodes")
    children = nodes.select("parent").unionByName(first.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    children = children.select(F.col("parent").alias("digest"), "n_children")
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    # What a member adds to a node: of the nodes from there on that are its own, and the end of its tail.
    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    on = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    added = shared.select("conv_id", "depth", "digest", "tail").join(own, ["conv_id", "depth"], "left")
    added = added.select("digest", F.sum(zero("saved")).over(on).alias("saved"), F.sum(zero("leaf") + F.col("tail").cast("long")).over(on).alias("leaves"))
    below = added.groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = ends_digest(shared.filter("last").select("digest", "conv_id"))
    grouped = nodes.join(below, "digest").join(ends, "digest", "left")

    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = grouped.select(*names[:-1], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "parent")
    ended = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY)
    one = lambda n: F.lit(n).cast("long")
    alone = lambda d: d.select("conv_id", "depth", one(1).alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), one(1).alias("n_leaves"), one(0).alias("saved_tokens"), ended.alias("ends_sha256"), "parent")
    parents = stage(nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "trie-parents")
    asking = stage(grouped.unionByName(alone(first)), "trie-children")
    order = [*names[:2], "parent_conv_id", *names[2:]]
    found = asking.join(parents, "parent", "left").select(*order)
    return found.unionByName(alone(rows.filter(F.col("kind") == TAIL)).withColumn("parent_conv_id", F.col("conv_id")).select(*order))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("long")
    heads = F.crc32(conv.cast("string").cast("binary")) % 6
    return prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % BASE, heads)


ORACLE = {
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {BASE} AS base, {sql_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
-- Without its base a conversation begins at its turn h + 1: turns are numbered anew.
n AS (SELECT conv_id, row_number() OVER w AS d, text, sha256(role || chr(10) || sha256(text)) AS one FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
p0 AS (SELECT conv_id, d, text, array_to_string(list(one) OVER (PARTITION BY conv_id ORDER BY d), '/') AS path FROM n),
p AS (SELECT conv_id, d, length(text) AS chars, path, CASE WHEN d = 1 THEN '' ELSE path[1:length(path) - 65] END AS parent FROM p0 UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM p JOIN l USING (conv_id, d) GROUP BY path),
g AS (SELECT path, min(d) AS d, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY path),
k AS (SELECT parent AS path, count(*) AS n_children FROM g WHERE parent IS NOT NULL GROUP BY parent),
-- A node is counted for each of its owner's prefixes up to it.
s AS (SELECT p.path, sum((n_convs - 1) * g.chars) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
      FROM g LEFT JOIN k USING (path) JOIN p ON p.conv_id = g.conv_id AND p.d <= g.d GROUP BY p.path)
SELECT g.conv_id::BIGINT AS conv_id, g.d::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, g.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM g JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN g AS up ON up.path = g.parent"""
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
