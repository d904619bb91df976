"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive tokens that looks at some positions and ignores the others, so that a window hashes
alike when tokens at ignored positions were substituted. All windows of all benchmark items are hashed under fixed masks
into a table of seeds; every window of every document is hashed likewise and joined with it. Around each hit the two
texts are aligned on the hit's diagonal, and any stretch of it with MIN_OVERLAP equal tokens and a share of MIN_SIMILARITY
is a verified overlap; the one with the most equal tokens is told. Items under SPAN tokens have masks of their own length, which leave out what may be substituted in them.

Neither side passes the driver: it gathers a bit table of FILTER_BITS bits at most, made from the seeds by Spark. Tasks
test windows against it, so that only documents with likely hits are staged and joined. With more seeds than the table
is made for, more documents are joined in vain, none is missed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import small_batches, stage, table, text_of

# Fixed masks over 12 tokens: each looks at 7.
MASKS = ("111010100011", "110110001101", "100011011011", "101001010111", "110011110010")
SPAN = 12
#: A verified overlap has so many equal tokens and this share of equal ones, a fraction. Of a shorter item it has the whole.
MIN_OVERLAP = 12
MIN_SIMILARITY = (4, 5)
#: Bits of the table for each seed, tests for each window, and bits at most (16 MB).
BITS_PER_SEED = 32
PROBES = 5
FILTER_BITS = 1 << 27
SLICE_BITS = 1 << 19
#: Texts are hashed so many bytes at a time, or one text.
PIECE_BYTES = 1 << 20
#: Parts that a seed's documents, or an item's, are dealt to in joins.
SALTS = 8
#: Pairs of places of one seed in a document and an item that are looked at at a time.
PLACES = 1 << 22
#: Repeats of so many tokens at most are looked at once.
PERIODS = 8

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts one after the other, and how many each has: runs of letters and digits in lower case."""
    spaced = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
    lists = pc.split_pattern(spaced, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    known = words.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[words.indices.to_numpy()] if known else np.zeros(0, np.uint64)
    empty = pc.equal(spaced, "").to_numpy(zero_copy_only=False)
    counts = np.diff(offsets)
    if empty.any():  # a text without tokens is split into one empty word
        hashes = hashes[~np.repeat(empty, counts)]
        counts = np.where(empty, 0, counts)
    return hashes, counts


def short_masks(length: int) -> tuple[str, ...]:
    """Masks over a whole item: its tokens fall into groups, and each mask leaves out as many as may be substituted."""
    above, below = MIN_SIMILARITY
    loose = (below - above) * length // below
    if not loose:
        return ("1" * length,)
    groups = [i * (loose + 2) // length for i in range(length)]
    return tuple("".join("01"[g not in out] for g in groups) for out in itertools.combinations(range(loose + 2), loose))


def masks_for(length: int) -> tuple[str, ...]:
    return MASKS if length >= SPAN else short_masks(length)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of the mask's length."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, xxhash.xxh3_64_intdigest(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h ^= tokens[k : k + n]
            h *= _PRIME
            h ^= h >> np.uint64(29)
    return h


def _first_seen(doc: np.ndarray, length: int, places: np.ndarray) -> np.ndarray:
    """places without those around which the document repeats what it had up to PERIODS tokens before.

    An item of so many tokens, aligned there, agrees no better than before, and ties go to the first.
    """
    for q in range(1, PERIODS + 1):
        if len(places) < 2 * length or len(doc) <= q:
            break
        other = np.ones(len(doc) + 1, np.int64)
        other[q:-1] = doc[q:] != doc[:-q]
        other[-1] = 0
        before = np.concatenate([[0], np.cumsum(other)])
        low = places - length
        same = (low >= q) & (before[np.minimum(places + length, len(doc))] == before[np.maximum(low, 0)])
        places = places[~same]
    return places


def diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Where the item would begin in the document, for all windows that agree under a mask, in order."""
    seen = np.zeros(len(doc) + len(item) + 1, bool)
    for mask in masks_for(len(item)):
        own, wanted = seed_hashes(doc, mask), seed_hashes(item, mask)
        order = np.argsort(wanted, kind="stable")
        wanted = wanted[order]
        at = _first_seen(doc, len(item), np.flatnonzero(np.isin(own, wanted)))
        low, high = np.searchsorted(wanted, own[at], "left"), np.searchsorted(wanted, own[at], "right")
        ends = np.cumsum(high - low)
        for part in np.split(np.arange(len(at)), np.searchsorted(ends, np.arange(PLACES, int(ends[-1]) if len(ends) else 0, PLACES))):
            n = (high - low)[part]
            rows = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            seen[np.repeat(at[part], n) - order[rows] + len(item)] = True
    return np.flatnonzero(seen) - len(item)


def stretch(same: np.ndarray) -> tuple[int, int, int] | None:
    """(first, tokens, equal tokens) of the stretch with the most equal tokens among those that have MIN_OVERLAP of them and
    a share of MIN_SIMILARITY; of several the shortest, then the first.

    It begins and ends with equal tokens. From the i-th to the j-th of these, at p[i] and p[j], the share is reached where
    j + 1 - S * (p[j] + 1) >= i - S * p[i]; for each j the first such i is found by the least values up to each i.
    """
    p = np.flatnonzero(same)
    if len(p) < MIN_OVERLAP:
        return None
    above, below = MIN_SIMILARITY
    k = np.arange(len(p))
    begin = below * k - above * p
    first = np.searchsorted(-np.minimum.accumulate(begin), -(begin + below - above), "left")
    matched = k - first + 1
    n = p - p[first] + 1
    at = int(np.lexsort((p[first], n, -matched))[0])
    return (int(p[first[at]]), int(n[at]), int(matched[at])) if matched[at] >= MIN_OVERLAP else None


def overlap(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int] | None:
    """(first token, tokens, equal tokens) of the best verified overlap: most equal tokens, then fewest tokens, then first."""
    best = None
    above, below = MIN_SIMILARITY
    for d in diagonals(doc, item).tolist():
        start, stop = max(0, d), min(len(doc), d + len(item))
        same = doc[start:stop] == item[start - d : stop - d]
        if len(item) < SPAN:
            n, matched = stop - start, int(same.sum())
            found = (0, n, matched) if n == len(item) and below * matched >= above * n else None
        else:
            found = stretch(same)
        if found is not None and (best is None or (-found[2], found[1], start + found[0]) < (-best[2], best[1], best[0])):
            best = (start + found[0], *found[1:])
        if best is not None and best[2] == len(item):
            break
    return best


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PIECE_BYTES of text, or one text."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy())
    begin = 0
    while begin < len(batch):
        stop = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + PIECE_BYTES, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) to (id, mark, tokens, n)."""
    for batch in batches:
        for some in _pieces(batch, 2):
            flat, counts = tokens_of(some.column(2))
            parts = np.split(flat, np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(counts)], ["id", "mark", "tokens", "n"])


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, tokens) to (hash, id, mark) for each different seed of the item."""
    for batch in batches:
        for i, tokens in enumerate(batch.column(2)):
            item = np.frombuffer(tokens.as_buffer(), np.uint64)
            hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *(seed_hashes(item, m) for m in masks_for(len(item)) if len(item))]))
            of = pa.array(np.full(len(hashes), i))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)], ["hash", "item_id", "item_mark"])


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of each hash in a table of so many, a power of two."""
    for k in range(PROBES):
        yield ((hashes >> np.uint64(7 * k)) * _PRIME >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit table, as bytes, that has all bits of every seed. Its slices are made in tasks."""
    n = seeds.count()
    bits = min(FILTER_BITS, max(SLICE_BITS, 1 << max(1, (n * BITS_PER_SEED - 1).bit_length())))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate([*_probes(batch.column(0).to_numpy().view(np.uint64), bits)]))
            yield pa.RecordBatch.from_arrays([pa.array(at // SLICE_BITS), pa.array(at % SLICE_BITS)], ["part", "bit"])

    def one(group: pa.Table) -> pa.Table:
        on = np.zeros(SLICE_BITS, np.uint8)
        on[group.column("bit").to_numpy()] = 1
        return pa.table([pa.array(group.column("part").to_numpy()[:1]), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["part", "bytes"])

    slices = seeds.select("hash").distinct().mapInArrow(places, "part long, bit long").distinct().groupBy("part").applyInArrow(one, "part long, bytes binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in slices.toLocalIterator():
        at = r["part"] * SLICE_BITS // 8
        out[at : at + SLICE_BITS // 8] = np.frombuffer(r["bytes"], np.uint8)
    return out


def _likely(filter_: np.ndarray, masks: list[str]):
    """(id, mark, text) to (id, mark, tokens, hashes) of documents with windows in the filter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _pieces(batch, 2):
                flat, counts = tokens_of(some.column(2))
                begins = np.cumsum(counts) - counts
                owner = np.repeat(np.arange(len(counts)), counts)
                of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for mask in masks:
                    h = seed_hashes(flat, mask)
                    at = np.flatnonzero(owner[: len(h)] == owner[len(mask) - 1 :]) if len(h) else np.zeros(0, np.int64)
                    for probe in _probes(h, len(filter_) * 8):
                        bit = probe[at]
                        at = at[(filter_[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                    of.append(owner[at])
                    found.append(h[at])
                # The different hashes of each document, in the documents' order.
                order = np.lexsort((np.concatenate(found), np.concatenate(of)))
                doc, hashes = np.concatenate(of)[order], np.concatenate(found)[order].view(np.int64)
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                doc, hashes = doc[new], hashes[new]
                rows_ = np.unique(doc)
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc, rows_), len(doc)).astype(np.int32)), pa.array(hashes))
                tokens = pa.array([flat[begins[i] : begins[i] + counts[i]].tobytes() for i in rows_.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows_)), some.column(1).take(pa.array(rows_)), tokens, lists], ["id", "mark", "tokens", "hashes"])

    return rows


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one document stand together: those with its own tokens, one for each copy, then one for each item."""
    key, doc, copies = None, np.zeros(0, np.uint64), 0
    for batch in batches:
        out: list[tuple] = []
        columns = (batch.column(i).to_pylist() for i in (0, 1, 2, 3))
        for i, (id_, mark, kind, item_id) in enumerate(zip(*columns, strict=True)):
            tokens = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
            if kind == 0:
                copies = copies + 1 if (id_, mark) == key else 1
                key, doc = (id_, mark), tokens.copy()
            elif (best := overlap(doc, tokens)) is not None:
                out += [(id_, mark, item_id, *best)] * copies
        arrays = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)]
        yield pa.RecordBatch.from_arrays(arrays, ["id", "mark", "item_id", "start", "n_tokens", "n_matched"])


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, mark, item_id, start, n_tokens, n_matched) for docs(id, mark, text), a row for each copy of a document."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), text_of().alias("text")).select("id", F.xxhash64("text").alias("mark"), "text").distinct()
    items = stage(items.mapInArrow(_token_rows, "id long, mark long, tokens binary, n long").filter("n > 0"), "benchmark-items")
    seeds = stage(items.select("id", "mark", "tokens").mapInArrow(_seed_rows, "hash long, item_id long, item_mark long"), "benchmark-seeds")
    lengths = [r["n"] for r in items.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect()]  # SPAN rows at most
    likely = stage(docs.mapInArrow(_likely(seed_filter(seeds), [m for n in sorted(lengths) for m in masks_for(n)]), "id long, mark long, tokens binary, hashes array<bigint>"), "likely-leaks")
    # A seed, or an item, that very many documents have is dealt to SALTS parts.
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hits = likely.select("id", "mark", F.explode("hashes").alias("hash")).distinct().select("*", _salt("id", "mark"))
    pairs = hits.join(seeds.select("*", every), ["hash", "salt"]).select("id", "mark", "salt", "item_id", "item_mark").distinct()
    of = items.select(F.col("id").alias("of_id"), F.col("mark").alias("of_mark"), "tokens", every)
    pairs = pairs.join(of.withColumnRenamed("salt", "of_salt"), F.col("item_id").eqNullSafe(F.col("of_id")) & (F.col("item_mark") == F.col("of_mark")) & (F.col("salt") == F.col("of_salt")))
    rows = likely.select("id", "mark", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("item_id"), "tokens")
    rows = rows.unionByName(pairs.select("id", "mark", F.lit(1).alias("kind"), "item_id", "tokens"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "id", "mark").sortWithinPartitions("id", "mark", "kind")
    return rows.mapInArrow(_verified, "id long, mark long, item_id long, start long, n_tokens long, n_matched long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("mark"), "text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, item_id, start, n_tokens, n_matched and similarity for each document and item with a verified overlap.

    start and n_tokens count tokens of the document. Items of under SPAN tokens are looked for as a whole, from 5
    tokens on with substitutions, those of 1 to 4 tokens as they are. Null texts and items have no tokens. Repeated rows
    have a row each, null ids stay null, items with equal id and text count once. Without documents or items the result
    is empty. Other columns are ignored, whatever their names. One document's tokens are held by a task; stretches that
    a document repeats are looked at once if they are of PERIODS tokens at most, other repeats place by place.
    """
    found = _leaks(_keyed(docs, id_col, text_col), benchmark.select("item_id", "text"))
    return found.select(F.col("id").alias(id_col), "item_id", "start", "n_tokens", "n_matched", (F.col("n_matched") / F.col("n_tokens")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that find_leaks() tells of.

    Null and empty texts, and rows without an id, stay unless their text overlaps; all copies of a row go or stay
    together. An empty table, or an empty benchmark, changes nothing. Other columns are handed on, whatever their names.
    """
    found = _leaks(_keyed(docs, id_col, text_col), benchmark.select("item_id", "text"))
    leaky = stage(found.select(F.col("id").alias("__leak_id"), F.col("mark").alias("__leak_mark")).distinct(), "leaks")
    d = docs.withColumns({"__own_id": F.col(id_col).cast("long"), "__own_mark": F.xxhash64(text_of(text_col))})
    d = d.join(leaky, F.col("__own_id").eqNullSafe(F.col("__leak_id")) & (F.col("__own_mark") == F.col("__leak_mark")), "left_anti")
    return d.select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_decontaminate": op2_decontaminate}
