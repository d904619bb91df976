"""Substring deduplication with an FM-index for each shard.

Shards are by content. The three-word run with the smallest hash in a window of words sends the window to a shard, so that
equal windows always meet; neighbouring windows with one such run travel together as one passage. Runs that are frequent
by the counts of a bounded sample come after all others: where they begin a passage that very many documents share,
each document's own words before it do not travel along. Passages that share their run with no other document are
dropped there. The others are indexed: the Burrows-Wheeler transform of their word ids, sorted to the depth of a window,
and the documents of the suffixes in that order, each in a wavelet matrix of packed bits. No suffix array is kept.
Backward search over the passages gives their matching statistics: for each place the length of the longest stretch
that ends there and occurs elsewhere too. Lengths stop at a window, the threshold. Stretches that reach it have a suffix
interval, whose smallest document is a range minimum in the wavelet matrix of documents. Word ranges whose windows also
start in a smaller document are reported and removed.

Windows of frequent runs alone, such as the inside of a passage that a third of all documents hold, take another way:
tasks reduce each such passage to its smallest and largest document, so that a shard has it once, and the places
where it stands are joined with what the shard found.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import NO_ID, table, text_of

WINDOW = 13
RUN = 3
#: Bytes of input text for each shard, on average. A passage's words go to about three shards.
SHARD_BYTES = 4 << 20
#: Bytes of text that a task takes at a time.
BATCH_BYTES = 8 << 20
#: Windows searched at a time.
SEARCH = 1 << 17
#: Runs are frequent that occur more often than this in documents of so many bytes at most, drawn by a hash. They are
#: counted by the first bits of their hashes. Which run makes a window's key has no effect on what is found.
FREQUENT = 64
SAMPLE_BYTES = 64 << 20
RUN_BITS = 22
#: Parts that the places of one passage of frequent runs are dealt to.
SALTS = 8
_LAST = np.uint64(1 << 63)
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _P
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def run_hashes(hashes: np.ndarray) -> np.ndarray:
    m = np.full(max(0, len(hashes) - RUN + 1), RUN, np.uint64)
    for k in range(RUN):
        m = _mix(m + hashes[k : k + len(m)])
    return m


def passages(hashes: np.ndarray, lengths: np.ndarray, window: int = WINDOW, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, windows and key of each passage of the texts that hashes holds one after the other.

    Keys of windows that have runs in frequent alone are those from _LAST on.
    """
    runs = window - RUN + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = run_hashes(hashes)
    often = np.zeros(len(m), bool) if frequent is None else frequent[(m >> np.uint64(64 - RUN_BITS)).astype(np.int64)]
    m >>= np.uint64(1)
    m[often] |= _LAST
    key = m[:n].copy()
    for k in range(1, runs):
        np.minimum(key, m[k : k + n], out=key)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ok = owner[:n] == owner[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:n] != owner[: n - 1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    last = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True))
    return first, last - first + 1, key[first]


_CELL_TYPES = {"part": pa.int64(), "group": pa.int64(), "shard": pa.int64(), "cell": pa.binary(), "passage": pa.binary(), "text": pa.binary(), "id": pa.int64(), "mark": pa.int64(), "place": pa.int64()}
CELLS = "part long, group long, shard long, cell binary, passage binary, text binary, id long, mark long, place long"


def _cells(shards: int, frequent: np.ndarray, parts: list[int]):
    """For a batch of texts and each shard: the distinct passages and where they stand, packed and compressed.

    Passages of frequent runs are rows of their own, one for each place, with their text at the first place in the batch.
    """

    def cells(ids: list[int], marks: list[int], texts: list[bytes]) -> Iterator[tuple]:
        words: list[bytes] = []
        lengths = []
        for t in texts:
            own = t.split()
            lengths.append(len(own))
            words += own
        sizes = np.array(lengths, np.int64)
        first, count, key = passages(word_hashes(words), sizes, WINDOW, frequent)
        if not len(first):
            return
        starts = np.cumsum(sizes) - sizes
        doc = np.searchsorted(starts, first, "right") - 1
        while (short := sizes[doc] == 0).any():  # texts without words stand at the start of the next one
            doc[short] -= 1
        shard = (key % np.uint64(shards)).astype(np.int64)
        hot = key >= _LAST
        seen: set[bytes] = set()
        for i in np.flatnonzero(hot).tolist():
            text = b" ".join(words[first[i] : first[i] + count[i] + WINDOW - 1])
            digest = xxhash.xxh3_128_digest(text)
            yield parts[i % len(parts)], -1, int(shard[i]), None, digest, None if digest in seen else text, ids[doc[i]], marks[doc[i]], int(first[i] - starts[doc[i]])
            seen.add(digest)
        order = np.argsort(shard, kind="stable")
        order = order[~hot[order]]
        if not len(order):
            return
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        doc_ids, doc_marks = np.array(ids, np.int64)[doc], np.array(marks, np.int64)[doc]
        place = (first - starts[doc]).astype(np.uint32)
        packer = zstandard.ZstdCompressor(level=6)
        for part in np.split(order, cuts):
            known: dict[bytes, int] = {}
            which = np.fromiter((known.setdefault(b" ".join(words[a : a + c + WINDOW - 1]), len(known)) for a, c in zip(first[part].tolist(), count[part].tolist(), strict=True)), np.uint32, len(part))
            keys = np.zeros(len(known), np.uint32)
            keys[which] = (key[part] >> np.uint64(32)).astype(np.uint32)
            body = [struct.pack("<II", len(known), len(part)), keys.tobytes(), which.tobytes(), doc_ids[part].tobytes(), doc_marks[part].tobytes(), place[part].tobytes(), b"\n".join(known)]
            yield parts[shard[part[0]] % len(parts)], int(shard[part[0]]), None, packer.compress(b"".join(body)), None, None, None, None, None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, begin, size = batch.column(2), 0, 0
            for i in range(len(batch)):
                size += len(texts[i].as_buffer() or b"")
                if size >= BATCH_BYTES or i == len(batch) - 1:
                    some = batch.slice(begin, i + 1 - begin)
                    made = list(cells(some.column(0).to_pylist(), some.column(1).to_pylist(), [t.as_buffer().to_pybytes() for t in some.column(2)]))
                    columns = zip(*made, strict=True) if made else [[]] * len(_CELL_TYPES)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CELL_TYPES.values(), strict=True)], list(_CELL_TYPES))
                    begin, size = i + 1, 0

    return rows


class WaveletMatrix:
    """A sequence of symbols below size as packed bits and their running counts: 1.5 bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        x = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((x >> level) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.uint32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.bits) + sum(x.nbytes for x in self.counts)

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[k][word].astype(np.int64) + np.bitwise_count(self.bits[k][word] & below)

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the places before at of each symbol end on the last level, from where walk(symbol, 0) has them begin."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self._ones(k, at)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest symbol at the places from low to before high, of which there is one at least."""
        symbol = np.zeros(len(low), np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            a, b = self._ones(k, low), self._ones(k, high)
            small = high - b > low - a
            symbol += np.where(small, 0, 1 << level)
            low, high = np.where(small, low - a, self.zeros[k] + a), np.where(small, high - b, self.zeros[k] + b)
        return symbol


class FMIndex:
    """Backward search for patterns of up to depth symbols in a sequence of symbols from 1; 0 ends each of its passages.

    documents has a number from 0 for each place of the sequence. What is kept of a place is 1.5 bits for each bit of a
    symbol and of a document's number; of a symbol 8 bytes.
    """

    def __init__(self, sequence: np.ndarray, documents: np.ndarray, depth: int = WINDOW) -> None:
        rank, k = sequence.astype(np.int64), 1
        while k < depth:
            shifted = np.concatenate([rank[k:], np.zeros(min(k, len(rank)), np.int64)])
            _, rank = np.unique(rank * (rank.max() + 1) + shifted, return_inverse=True)
            k *= 2
        self.size, self.depth = len(sequence), depth
        order = np.argsort(rank, kind="stable")
        symbols = int(sequence.max()) + 1
        self.transform = WaveletMatrix(sequence[order - 1], symbols)
        self.documents = WaveletMatrix(documents[order], int(documents.max()) + 1)
        # A symbol's suffixes start so much further on than its places on the transform's last level.
        smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])[:-1]
        self.ahead = smaller - self.transform.walk(np.arange(symbols), np.zeros(symbols, np.int64))

    @property
    def nbytes(self) -> int:
        return self.transform.nbytes + self.documents.nbytes + self.ahead.nbytes

    def matching_statistics(self, sequence: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the places ends the length of the longest stretch before it that occurs twice or more, and its suffix interval.

        sequence is made of the index's symbols and holds passages that are indexed too, each after a 0. Lengths stop at
        depth. All places are searched side by side, so that each step is one pass over those that still match.
        """
        length, low, high, on = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64), np.arange(len(ends))
        for k in range(1, self.depth + 1):
            on = on[ends[on] >= k]
            symbol = sequence[ends[on] - k]
            both = self.transform.walk(np.concatenate([symbol, symbol]), np.concatenate([low[on], high[on]])).reshape(2, -1) + self.ahead[symbol]
            more = (both[1] - both[0] > 1) & (symbol > 0)
            on = on[more]
            low[on], high[on], length[on] = both[0][more], both[1][more], k
        return length, low, high


def smallest_documents(texts: list[bytes], least: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each passage the smallest document that holds it; and where each passage's windows begin.

    least has the smallest document of each passage.
    """
    words = [t.split(b" ") for t in texts]
    sizes = np.array([len(w) for w in words])
    _, ids = np.unique(word_hashes([x for w in words for x in w]), return_inverse=True)
    total = int(sizes.sum()) + len(sizes)
    sequence = np.zeros(total, np.int32)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    sequence[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = ids + 1
    ids_of, rank = np.unique(least, return_inverse=True)
    index = FMIndex(sequence, np.repeat(rank, sizes + 1), window)
    windows = sizes - window + 1
    at = np.cumsum(windows) - windows
    ends = np.repeat(begin - at, windows) + np.arange(int(windows.sum())) + window
    found = np.repeat(least, windows)
    for i in range(0, len(ends), SEARCH):
        length, low, high = index.matching_statistics(sequence, ends[i : i + SEARCH])
        on = np.flatnonzero(length == window)
        starts, first, back = np.unique(low[on], return_index=True, return_inverse=True)  # equal windows have one interval
        found[i + on] = ids_of[index.documents.least(starts, high[on][first])][back]
    return found, at


HOT = "shard long, passage binary, text binary, id long, mark long, place long"


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of passages of frequent runs."""
    for batch in batches:
        hot = batch.filter(pc.less(batch.column("group"), 0))
        yield pa.RecordBatch.from_arrays([hot.column(c) for c in ("shard", "passage", "text", "id", "mark", "place")], ["shard", "passage", "text", "id", "mark", "place"])


def _hot_repeats(group: pa.Table) -> pa.Table:
    """(passage, smallest) for (passage, text, least, most) of one shard: the smallest document of each window, where one is smaller than most."""
    texts = [t.as_py() for t in group.column("text")]
    smallest, at = smallest_documents(texts, group.column("least").to_numpy())
    parts = np.split(smallest, at[1:])
    some = [i for i, (p, most) in enumerate(zip(parts, group.column("most").to_pylist(), strict=True)) if (p < most).any()]
    return pa.table([group.column("passage").take(pa.array(some, pa.int64())), pa.array([parts[i] for i in some], pa.list_(pa.int64()))], ["passage", "smallest"])


def _hot_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, place, smallest) to (id, mark, start, windows)."""
    for batch in batches:
        lists = batch.column(3)
        n = np.diff(lists.offsets.to_numpy())
        owner = np.repeat(np.arange(len(n)), n)
        hit = lists.flatten().to_numpy() < batch.column(0).to_numpy()[owner]
        first, last = _runs(hit, owner)
        of = owner[first]
        place = batch.column(2).to_numpy()[of] + first - (np.cumsum(n) - n)[of]
        columns = [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(place), pa.array(last - first)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "start", "windows"])


def _runs(hit: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of hits of one owner."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    new = np.flatnonzero(np.diff(owner)) + 1  # a run of hits ends with its instance
    inner = new[hit[new] & hit[new - 1]]
    return np.union1d(np.flatnonzero(edge == 1), inner), np.union1d(np.flatnonzero(edge == -1), inner)


def _repeats(group: pa.Table) -> pa.Table:
    """(id, mark, start, windows) of every run of windows that a smaller document holds too, in one shard."""
    texts: list[bytes] = []
    keys, which, ids, marks, places = [], [], [], [], []
    unpacker = zstandard.ZstdDecompressor()
    names = ["id", "mark", "start", "windows"]
    if group.column("group")[0].as_py() < 0:  # places of passages of frequent runs, which take another way
        return pa.table([pa.array([], pa.int64())] * 4, names)
    for cell in group.column("cell"):
        data = unpacker.decompress(cell.as_buffer())
        n, m = struct.unpack_from("<II", data)
        at = 8
        keys.append(np.frombuffer(data, np.uint32, n, at))
        which.append(np.frombuffer(data, np.uint32, m, at := at + 4 * n).astype(np.int64) + len(texts))
        ids.append(np.frombuffer(data, np.int64, m, at := at + 4 * m))
        marks.append(np.frombuffer(data, np.int64, m, at := at + 8 * m))
        places.append(np.frombuffer(data, np.uint32, m, at := at + 8 * m))
        texts += data[at + 4 * m :].split(b"\n")
    key, which, doc, mark, place = (np.concatenate(x) for x in (keys, which, ids, marks, places))
    # Keys that one document alone has can't repeat.
    of, by = np.unique(key, return_inverse=True)
    low, high = np.full(len(of), NO_ID), np.full(len(of), -NO_ID)
    np.minimum.at(low, by[which], doc)
    np.maximum.at(high, by[which], doc)
    kept = np.flatnonzero((low < high)[by])
    distinct: dict[bytes, int] = {}
    number = np.full(len(texts), -1)
    number[kept] = np.fromiter((distinct.setdefault(texts[i], len(distinct)) for i in kept.tolist()), np.int64, len(kept))
    on = np.flatnonzero(number[which] >= 0)
    passage, doc, mark, place = number[which[on]], doc[on], mark[on], place[on].astype(np.int64)
    if not distinct:
        return pa.table([pa.array([], pa.int64())] * 4, names)
    least = np.full(len(distinct), NO_ID)
    np.minimum.at(least, passage, doc)
    smallest, at = smallest_documents(list(distinct), least)
    n = np.diff(np.append(at, len(smallest)))
    # Windows of all instances, in blocks: a passage that many documents share has many instances.
    out: list[list[np.ndarray]] = [[], [], [], []]
    ends = np.cumsum(n[passage])
    for block in np.split(np.arange(len(passage)), np.searchsorted(ends, np.arange(1 << 20, int(ends[-1]) + 1, 1 << 20))):
        if not len(block):
            continue
        many = n[passage[block]]
        before = np.cumsum(many) - many
        inside = np.arange(int(many.sum())) - np.repeat(before, many)
        owner = np.repeat(block, many)
        hit = smallest[np.repeat(at[passage[block]], many) + inside] < doc[owner]
        first, last = _runs(hit, owner)
        for column, x in zip(out, (doc[owner[first]], mark[owner[first]], place[owner[first]] + inside[first], last - first), strict=True):
            column.append(x)
    return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names)


def frequent_runs(docs: DataFrame, total: int) -> np.ndarray:
    """A flag for each value of a run hash's first RUN_BITS bits, from documents of about SAMPLE_BYTES; total is the bytes of all."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [run_hashes(word_hashes(t.as_buffer().to_pybytes().split())) >> np.uint64(64 - RUN_BITS) for t in batch.column(0)]
            bucket, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *runs]).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], ["bucket", "n"])

    share = min(1.0, SAMPLE_BYTES / max(1, total))
    drawn = docs.filter(F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    often = drawn.mapInArrow(counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).filter(F.col("n") > FREQUENT)
    flags = np.zeros(1 << RUN_BITS, bool)
    flags[[r["bucket"] for r in often.select("bucket").collect()]] = True  # a row for FREQUENT runs of the sample at most
    return flags


def even_parts(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that goes there when rows are dealt by a hash of it, so that shards are dealt evenly."""
    at = F.pmod(F.hash("id"), F.lit(n))
    return [r["id"] for r in spark.range(40 * n).groupBy(at.alias("at")).agg(F.min("id").alias("id")).orderBy("at").collect()]  # n rows


def repeated_ranges(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, mark, start, windows) for docs(id, mark, text): runs of windows that also start in a smaller document."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = docs.select("id", "mark", "text").mapInArrow(_cells(shards, frequent_runs(docs, total), even_parts(docs.sparkSession, n)), CELLS)
    # All that is made of a text in one pass moves in one exchange, which each of the uses below reads.
    cells = cells.repartition(n, "part")
    usual = cells.groupBy("part", "group").applyInArrow(_repeats, "id long, mark long, start long, windows long")
    hot = cells.mapInArrow(_hot_rows, HOT)
    known = hot.groupBy("shard", "passage").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first("text", ignorenulls=True).alias("text"))
    found = known.groupBy("shard").applyInArrow(_hot_repeats, "passage binary, smallest array<bigint>")
    found = found.select("passage", "smallest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    places = hot.select("passage", "id", "mark", "place", F.pmod(F.xxhash64("id", "mark", "place"), F.lit(SALTS)).cast("int").alias("salt"))
    places = places.join(found, ["passage", "salt"]).select("id", "mark", "place", "smallest")
    return usual.unionByName(places.mapInArrow(_hot_ranges, "id long, mark long, start long, windows long"))


def range_lists(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, mark, ranges): the different ranges of each row; equal rows find the same ones and share one list."""
    return repeated_ranges(docs, shard_bytes).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "windows")).alias("ranges"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with their last column compressed: texts move once more, to the ranges found in them."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([packer.compress(t.as_buffer() or b"") for t in batch.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], ["own", "id", "mark", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id_col, n_words, n_removed and kept_text: what is left of each text without the words of repeated windows.

    Words are runs of anything but ASCII white space, unchanged; kept words are joined by one space. A word goes if a
    window of WINDOW words that covers it also starts in a document with a smaller id, judged on the input. Null and
    empty texts have no words. Null ids count as larger than all others and not smaller than each other; rows with one
    id do not remove each other's words. An empty table gives an empty result. Other columns are ignored, whatever their
    names.
    """
    d = docs.select(F.col(id_col).cast("long").alias("own"), text_of(text_col).alias("text"))
    # Rows of one id, or of none, are told apart by their texts' whole hashes.
    d = d.select("own", F.coalesce("own", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    packed = d.mapInArrow(_packed, "own long, id long, mark long, text binary")
    joined = packed.join(range_lists(d, shard_bytes), ["id", "mark"], "left").select("own", "text", F.col("ranges.start").alias("start"), F.col("ranges.windows").alias("windows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            total, removed, texts = [], [], []
            for text, start, windows in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                words = unpacker.decompress(text.as_buffer()).split()
                total.append(len(words))
                if start.is_valid:
                    a = start.values.to_numpy()
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, a, 1)
                    np.add.at(change, a + windows.values.to_numpy() + WINDOW - 1, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(total[-1] - len(words))
                texts.append(b" ".join(words))
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["own", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(cut, "own long, n_words long, n_removed long, kept_text string").withColumnRenamed("own", id_col)



def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
