"""Token ids in fixed-width bit-packed files.

Documents are range-partitioned and sorted by id; each task encodes its range and packs the ids into blobs, which Spark
writes as rows of Parquet files (so a lost executor or a repeated task leaves no half file). A blob holds a header, the
document ids and lengths, the byte offset of each block, and the blocks: every id in as few bits as the vocabulary
needs, BLOCK_IDS ids to a block, each block on a byte boundary. Any id is found from its number alone.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import new_path, small_batches, table, text_of

MAGIC = b"FWB1"
HEADER = struct.Struct("<4sIQQQ")  # magic, bits an id, ids a block, documents, ids
BLOCK_IDS = 4096
#: A blob is closed at the first document end after so many ids.
BLOB_IDS = 1 << 20
END_ID = 0
BLOBS = "part int, seq int, n_docs long, n_ids long, data binary"
#: Pieces, and pre-tokens, that an encoder remembers; beyond that it starts afresh.
CACHE_WORDS = 500_000
#: Texts are encoded so many bytes at a time, or one text; a byte takes some twenty while it is encoded.
PIECE_BYTES = 1 << 20


def width_of(vocabulary: int) -> int:
    """The bits that the largest id needs, 1 at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids, each in width bits, the lowest bit first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return raw[:, : width // 8].tobytes()
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    if width % 8 == 0:
        out = np.zeros((n, 4), dtype=np.uint8)
        out[:, : width // 8] = raw[: n * width // 8].reshape(n, -1)
        return out.view("<u4").reshape(-1)
    bits = np.zeros((n, 32), dtype=np.uint8)
    bits[:, :width] = np.unpackbits(raw, bitorder="little")[: n * width].reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def make_blob(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    blocks = [pack_bits(ids[i : i + BLOCK_IDS], width) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return b"".join([HEADER.pack(MAGIC, width, BLOCK_IDS, len(doc_ids), len(ids)), known.tobytes(), keys.tobytes(), np.array(lengths, dtype="<u8").tobytes(), offsets.tobytes(), *blocks])


class Blob:
    """Random access to a blob: ids(start, stop) unpacks only the blocks that it needs."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.block, docs, self.n = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token blob")
        at = HEADER.size
        known = np.frombuffer(data, np.uint8, docs, at)
        keys = np.frombuffer(data, "<i8", docs, at := at + docs)
        self.doc_ids = [int(k) if x else None for k, x in zip(keys, known, strict=True)]
        self.lengths = np.frombuffer(data, "<u8", docs, at := at + 8 * docs).astype(np.int64)
        blocks = -(-self.n // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * docs).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (blocks + 1) :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        parts = [unpack_bits(self.body[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n - b * self.block), self.width) for b in range(first, last)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


#: A space between two characters that are not white space always starts a new pre-token, so the pieces between such
#: spaces can be encoded each on its own.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_ODD = f"{_WHITE} | {_WHITE}|^ | $"


#: How byte-level tokenizers write a byte: as itself where it can be seen, else as a character from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


def _shown(pieces: list[str]) -> list[str]:
    """Pieces as the tokenizer's model wants them; those without line ends are translated in one go."""
    joined = "\n".join([p for p in pieces if "\n" not in p])
    shown = iter(joined.encode().decode("latin-1").translate({**_BYTES, 10: 10}).split("\n"))
    return [p.encode().decode("latin-1").translate(_BYTES) if "\n" in p else next(shown) for p in pieces]


class _Numbers(dict):
    """Numbers keys as they are first looked up; new has those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Runs:
    """Runs of ids by number."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the runs at, and how many each has."""
        n = self.sizes[at]
        shift = self.starts[at] - (np.cumsum(n) - n)
        return self.flat[np.arange(int(n.sum())) + np.repeat(shift, n)], n


class WordEncoder:
    """Encodes whole texts as the tokenizer's encode(text, add_special_tokens=False) does.

    Byte-level BPE tokenizers work on pre-tokens, so that a text can be encoded piece by piece: the encoder remembers
    what each piece between spaces gave, and each pre-token in it. Special tokens' strings in a text become their ids,
    and what stands around them is encoded on its own. Other tokenizers encode each text as a whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        import regex
        from public_tokenizers import PATTERN

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        described = json.loads(self.tokenizer.to_str())
        split = described["pre_tokenizer"] or {}
        added = [t for t in described["added_tokens"] if t["content"]]
        simple = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        byte_level = (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        self.by_piece = byte_level and simple and described["normalizer"] is None and described["model"]["type"] == "BPE"
        self.model = self.tokenizer.model
        self.findall = regex.compile(PATTERN).findall
        self.specials = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if added else None
        self.clear()

    def clear(self) -> None:
        self.piece, self.pre = _Numbers(), _Numbers()
        self.pieces, self.pre_tokens = Runs(), Runs()

    def learn(self) -> None:
        """Encode the new pieces: the tokenizer's model takes each pre-token that is new."""
        findall, number = self.findall, self.pre.__getitem__
        found: list[int] = []
        counts: list[int] = []
        for p in self.piece.new:
            # Letters alone, after a space or not, are one pre-token; a special token is like one.
            if (p[1:] if p[:1] == " " else p).isalpha() or p in self.specials:
                found.append(number(p))
                counts.append(1)
            else:
                pre = findall(p)
                found += map(number, pre)
                counts.append(len(pre))
        tokenize = self.model.tokenize
        ids = [[self.specials[x]] if x in self.specials else [t.id for t in tokenize(y)] for x, y in zip(self.pre.new, _shown(self.pre.new), strict=True)]
        self.pre_tokens.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        flat, sizes = self.pre_tokens.take(np.array(found, np.int64))
        before = np.concatenate([[0], np.cumsum(sizes)])
        self.pieces.append(flat, np.diff(before[np.cumsum([0, *counts])]))
        self.piece.new, self.pre.new = [], []

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.piece.__getitem__, pieces.to_pylist()), np.int64, len(pieces))

    def _odd_pieces(self, text: str) -> list[int]:
        """The numbers of a text's pieces, where it holds more white space than single spaces, or special tokens."""
        out: list[int] = []
        for part in self.special.split(text) if self.special else [text]:
            if part in self.specials:
                out.append(self.piece[part])
            elif part:
                words = _SPLIT.split(part)
                out.append(self.piece[words[0]])
                out += [self.piece[" " + w] for w in words[1:]]
        return out

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with end_id after each text, and how many each text has with it."""
        if not self.by_piece:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter((len(x) + 1 for x in found), np.int64, len(found))
            return np.fromiter((i for x in found for i in (*x, end_id)), np.uint32, int(sizes.sum())), sizes
        if len(self.pieces) > CACHE_WORDS or len(self.pre) > CACHE_WORDS:
            self.clear()
        odd = pc.match_substring_regex(texts, _ODD)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else pa.array([], pa.string())
        begins = offsets[:-1] - (offsets[0] if len(offsets) else 0)
        # A text's first piece stands without a space, all others after one; each piece of the batch is looked up once.
        coded = words.dictionary_encode()
        later = np.ones(len(words), bool)
        later[begins] = False
        index = coded.indices.to_numpy().astype(np.int64)
        used = np.zeros(len(coded.dictionary), bool)
        used[index[later]] = True
        number = np.zeros(len(coded.dictionary), np.int64)
        number[used] = self._numbers(pc.binary_join_element_wise("", coded.dictionary.filter(pa.array(used)), " "))
        plain = number[index]
        plain[begins] = self._numbers(words.take(pa.array(begins)))
        rest = [self._odd_pieces(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        if self.piece.new:
            self.learn()
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(offsets)
        counts[odd] = [len(x) for x in rest]
        at = plain
        if rest:
            kind = np.repeat(odd, counts)
            at = np.empty(len(kind), np.int64)
            at[~kind] = plain
            at[kind] = np.fromiter(itertools.chain.from_iterable(rest), np.int64)
        ids, n = self.pieces.take(at)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        per_text = np.diff(np.concatenate([[0], ends]))
        # Each text's end id comes right after its last piece.
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[ends + np.arange(len(texts))] = False
        out[keep] = ids
        return out, per_text + 1


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _pieces_of(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or one text."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
    begin = 0
    while begin < len(batch):
        stop = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs in ascending order of id_col, pack the ids, write them to path, and return what was written.

    Ids are those of the tokenizer's encode(text, add_special_tokens=False): the strings of special tokens in a text
    become their ids. An id takes as many bits as the larger of the vocabulary and end_id needs.
    Null texts count as empty: they have the end id alone. Null ids come first. Rows with one id stand in order of a
    hash of their text. An empty table writes no blob. Other columns are ignored, whatever their names. tokenizer is
    the name of a file of the public tokenizers, looked up on each executor.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encoder = _encoder(public_tokenizers.path(tokenizer))
        width = width_of(max(encoder.vocabulary, end_id + 1))
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            every = np.concatenate(ids)
            columns = [[part], [seq], [len(doc_ids)], [len(every)], [make_blob(doc_ids, lengths, every, width)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_ids", "data"])

        for batch in batches:
            for some in _pieces_of(batch, PIECE_BYTES):
                found, n = encoder.encode(some.column(1), end_id)
                doc_ids += some.column(0).to_pylist()
                lengths += n.tolist()
                ids.append(found)
                if sum(map(len, ids)) >= BLOB_IDS:
                    yield row()
                    seq += 1
                    doc_ids, lengths, ids = [], [], []
        if doc_ids:
            yield row()
        # The worker lives on: what its Arrow memory has kept would stay beside the next task's.
        pa.default_memory_pool().release_unused()

    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    d.mapInArrow(pack, BLOBS).write.parquet(path)
    return spark.read.schema(BLOBS).parquet(path)


def read_token_files(blobs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens and ids_crc32 of each document, unpacked from the blobs; start counts all ids before it.

    One row for each document that was written, repeated and null ids too; no rows for no blobs. Columns besides those
    of BLOBS are ignored.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = Blob(data.as_py())
                ids = blob.ids().astype("<u4")
                ends = np.cumsum(blob.lengths)
                starts = ends - blob.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                columns = [[part] * n, [seq] * n, blob.doc_ids, starts, blob.lengths, crc]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "seq", "id", "at", "n_tokens", "ids_crc32"])

    # Running sums in two steps, parts first, so that no task holds a row for each blob of the corpus.
    parts = blobs.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = blobs.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    starts = starts.join(parts, F.col("part") == F.col("of")).select("part", "seq", (F.col("before") + F.col("before_part")).alias("before"))
    docs = blobs.select("part", "seq", "data").mapInArrow(unpack, "part int, seq int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, **options: object) -> DataFrame:
    """write_token_files() to a fresh folder of the shared one, then read_token_files(); nulls and the like as told there."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "token-files"), **options))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_token_output": op10_token_output}
