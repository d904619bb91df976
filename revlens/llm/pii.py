"""Personal data by fixed patterns, and by a skip-chain conditional random field for what the patterns lose.

Variables are the words that hold a digit or an @, and those that begin with the name of a found address; all others are
taken for plain words. Words next to each other share a chain potential. Distant words that repeat the same digits or
the same name share a skip potential, similar ones (the same last seven digits) another. What the patterns found is
evidence: loopy message passing carries it along chains and skips to mentions that no pattern matches, such as a telephone
number without its country code, an address spelt with (at), or two card numbers side by side.

The field is trained here, by pseudo-likelihood, on a bounded sample of the documents. Labels of the words are what the
patterns find; each sampled text also gets mentions of its own finds in other spellings, labelled like these, and numbers
that are nobody's, labelled plain. Whether a pattern matched is no feature.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import small_batches, table, text_of

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Training takes so many documents with a digit or an @ at most, those of the least text hashes, none above so many characters.
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 20_000
#: Each sampled text is seen so often, with other mentions.
VARIANTS = 2
#: A mention is added where the field is this sure.
MIN_BELIEF = 0.8
MAX_ROUNDS = 40
#: The least digits, or characters of a name, by which distant words are linked.
LEAST_DIGITS = 6
LAST_DIGITS = 7
LEAST_NAME = 5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_SPACE = " \t\n\x0b\x0c\r"
# Each digit run is entered at its start alone, and nothing is given back, so that long runs take linear time.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_HIT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_AT_SIGN = re.compile(r"@|[(\[]at[)\]]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and non-overlapping for each kind, by start and kind."""
    found: list[Span] = []
    after = searched = 0
    for m in _DOMAIN.finditer(text):
        # The name is the run of its characters before the @, back to the last address.
        before = text[max(after, searched) : m.start()]
        name = len(before) - len(before.rstrip(_LOCAL))
        searched = m.start() + 1
        if name:
            found.append((m.start() - name, EMAIL, m.end()))
            after = m.end()
    found += [(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    found += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found)


@dataclass
class Graph:
    """A text's variables: cores of words with their features, and edges (a, b, type)."""

    places: list[tuple[int, int]]
    features: list[list[int]]
    edges: list[tuple[int, int, int]]


CHAIN, SAME, SIMILAR = range(3)
_NUMBER_SIZES = (0, 1, 3, 6, 7, 9, 10, 13, 19)
_BIAS, _AT, _AT_SPELT, _PLUS, _ROUND, _DOTS, _HYPHEN, _LETTERS, _LUHN, _QUAD, _ALONE, _HANDLE, _SIZES = range(13)
N_FEATURES = _SIZES + len(_NUMBER_SIZES) + 1


def _name(core: str) -> str:
    """What stands before an @, also before a spelt one."""
    return _AT_SIGN.split(core.lower(), maxsplit=1)[0]


def _features(core: str, digits: str, alone: bool) -> list[int]:
    out = [_BIAS]
    tests = (
        (_AT, "@" in core),
        (_AT_SPELT, "(at)" in core or "[at]" in core),
        (_PLUS, core.startswith("+")),
        (_ROUND, core.startswith("(") and core.endswith(")")),
        (_DOTS, core.count(".") == 2),
        (_HYPHEN, "-" in core),
        (_LETTERS, any(c.isalpha() for c in core)),
        (_LUHN, 14 <= len(digits) <= 19 and luhn(digits)),
        (_QUAD, core.count(".") == 3 and len(digits) == len(core) - 3 and all(p and _small(p) for p in core.split("."))),
        (_ALONE, alone),
        (_HANDLE, core.startswith("@")),
    )
    out += [k for k, true in tests if true]
    size = next((k for k, most in enumerate(_NUMBER_SIZES) if len(digits) <= most), len(_NUMBER_SIZES))
    return [*out, _SIZES + size]


def _places(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Start and end of the words that are variables, without punctuation around them."""
    names = {text[s : text.index("@", s)].lower() for s, k, _ in base if k == EMAIL}
    names = {n for n in names if len(n) >= LEAST_NAME and not _DIGITS.search(n)}
    out = []
    if names:
        words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    else:
        words, last = [], 0
        while hit := _HIT.search(text, last):
            start = max(text.rfind(c, last, hit.start()) for c in _SPACE) + 1 or last
            gap = _GAP.search(text, hit.start())
            end = gap.start() if gap else len(text)
            words.append((start, end))
            last = end
    for start, end in words:
        word = text[start:end]
        bare = word.lstrip("\"'<[{,;:.!?*#$%&|>=")
        core = bare.rstrip("\"'>]},;:.!?*#$%&|<=")
        if core and (_HIT.search(core) or _name(core) in names):
            at = start + len(word) - len(bare)
            out.append((at, at + len(core)))
    return out


def graph_of(text: str, base: list[Span]) -> Graph:
    places = _places(text, base)
    features, edges = [], []
    last: dict[tuple, int] = {}
    touching = [k > 0 and not text[places[k - 1][1] : places[k][0]].strip("\"'<>[]{},;:.!?*#$%&|=" + _SPACE) for k in range(len(places))]
    for k, (start, end) in enumerate(places):
        core = text[start:end]
        digits = "".join(_DIGITS.findall(core))
        features.append(_features(core, digits, not touching[k] and not (k + 1 < len(places) and touching[k + 1])))
        if touching[k]:
            edges.append((k - 1, k, CHAIN))
        # Each word is linked to the one before it that has the same key, so that edges are no more than keys.
        name = _name(core)
        keys = [(SAME, digits)] if len(digits) >= LEAST_DIGITS and len(digits) * 2 >= len(core) else []
        keys += [(SAME, "n", name)] if len(name) >= LEAST_NAME and any(c.isalpha() for c in name) else []
        keys += [(SIMILAR, digits[-LAST_DIGITS:])] if keys and keys[0] == (SAME, digits) and len(digits) >= LAST_DIGITS else []
        for key in keys:
            if key in last and (last[key], k, SAME) not in edges[-3:]:
                edges.append((last[key], k, key[0]))
            last[key] = k
    return Graph(places, features, edges)


def clamped(graph: Graph, base: list[Span]) -> list[int]:
    """For each variable 1 + the kind of the base span that it touches, else 0; of several the first."""
    out, at = [], 0
    reach: list[Span] = []
    for start, end in graph.places:
        while at < len(base) and base[at][0] < end:
            reach.append(base[at])
            at += 1
        reach = [s for s in reach if s[2] > start]
        out.append(1 + reach[0][1] if reach else 0)
    return out


@dataclass
class Field:
    """Log potentials: of features and labels, of chains (label before, label after), and of equal labels over a skip."""

    nodes: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    similar: np.ndarray

    def pair(self, kind: int) -> np.ndarray:
        return self.chain if kind == CHAIN else np.diag(self.same if kind == SAME else self.similar)


LABELS = 1 + len(KINDS)  # plain, and each kind
_NEVER = -1e6


def unaries(field: Field, features: list[list[int]]) -> np.ndarray:
    sizes = [len(f) for f in features]
    flat = np.fromiter((x for f in features for x in f), np.int64, sum(sizes))
    out = np.zeros((len(features), LABELS))
    np.add.at(out, np.repeat(np.arange(len(features)), sizes), field.nodes[flat])
    return out


def beliefs(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray, rounds: int = MAX_ROUNDS) -> np.ndarray:
    """Marginals by sum-product message passing over edges (a, b), of pair potentials pairs[edge][label a][label b]; exact on trees."""
    n = len(edges)
    into = np.concatenate([edges[:, 1], edges[:, 0]]) if n else np.zeros(0, np.int64)
    out_of = np.concatenate([edges[:, 0], edges[:, 1]]) if n else into
    both = np.concatenate([pairs, pairs.transpose(0, 2, 1)]) if n else np.zeros((0, LABELS, LABELS))
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    messages = np.zeros((2 * n, unary.shape[1]))
    total = unary.copy()
    for _ in range(rounds if n else 0):
        from_a = (total[out_of] - messages[back])[:, :, None] + both
        top = from_a.max(axis=1)
        new = top + np.log(np.exp(from_a - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        new = 0.5 * (new + messages)
        change = np.abs(new - messages).max()
        messages = new
        total = unary.copy()
        np.add.at(total, into, messages)
        if change < 1e-3:
            break
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _spelt(kind: int, value: str, rnd: random.Random) -> str:
    """Another spelling of what a pattern found."""
    digits = "".join(_DIGITS.findall(value))
    if kind == EMAIL:
        name, _, domain = value.partition("@")
        return rnd.choice([f"{name}(at){domain}", f"{name}[at]{domain}", name if len(name) >= LEAST_NAME else f"{name}(at){domain}"])
    if kind == IP:
        return value.replace(".", rnd.choice(["-", "[.]", ","]))
    if kind == CARD:
        parts = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return rnd.choice([".".join(parts), "/".join(parts), f"{digits} {digits}"])
    last = digits[-10:]
    return rnd.choice([f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", ".".join([last[:3], last[3:6], last[6:]]), f"{last[-7:-4]}-{last[-4:]}"])


def _nobodys(rnd: random.Random) -> str:
    """A number, or a word with digits, that is no personal data."""
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    return rnd.choice([
        number(rnd.randrange(1, 20)), f"{number(3)}-{number(4)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}:{number(2)}", f"{number(2)}.{number(2)}", f"v{number(1)}.{number(2)}.{number(1)}",
        f"{number(1)}.{number(1)}.{number(2)}", f"({number(3)})", f"{number(2)}%", f"{rnd.getrandbits(64):x}", f"x{number(5)}", f"@{rnd.choice('abc')}{number(2)}", f"@{rnd.choice(['me', 'bob', 'a_team'])}", f"{number(3)},{number(3)}", f"{number(3)} {number(4)}",
    ])


def _example(text: str, variant: int) -> tuple[Graph, list[int]]:
    """The graph of a text with more mentions of its finds, and of nobody's numbers, and the labels of its words."""
    rnd = random.Random(hashlib.sha256(f"{variant}:{text}".encode("utf-8", "surrogatepass")).digest())
    base = base_spans(text)
    inside = lambda k: any(s <= k <= e for s, _, e in base[:50])
    gaps = [k for k in (m.start() for m in _GAP.finditer(text)) if not inside(k)]
    said = [(1 + s[1], _spelt(s[1], text[s[0] : s[2]], rnd)) for s in rnd.sample(base, min(3, len(base)))] + [(0, x) for x in (_nobodys(rnd) for _ in range(4)) for _ in range(rnd.randrange(1, 3))]
    where = sorted(rnd.sample(gaps, min(len(gaps), len(said))))
    rnd.shuffle(said)
    parts, marks, last, size = [], [], 0, 0
    for k, (label, x) in zip(where, said, strict=False):
        parts += [text[last:k], " ", x]
        size += k - last + 1
        marks.append((size, size + len(x), label))
        size += len(x)
        last = k
    text = "".join([*parts, text[last:]])
    base = base_spans(text)
    graph = graph_of(text, base)
    labels = clamped(graph, base)
    at = 0
    for k, (start, end) in enumerate(graph.places):
        while at < len(marks) and marks[at][1] <= start:
            at += 1
        if at < len(marks) and marks[at][0] < end and not labels[k]:
            labels[k] = marks[at][2]
    return graph, labels


def train(texts: list[str], steps: int = 300) -> Field:
    """The field of the largest pseudo-likelihood. Kinds that no text has are never given."""
    features: list[list[int]] = []
    edges: list[tuple[int, int, int]] = []
    labels: list[int] = []
    for text, variant in itertools.product(texts, range(VARIANTS)):
        graph, own = _example(text, variant)
        edges += [(a + len(labels), b + len(labels), kind) for a, b, kind in graph.edges]
        features += graph.features
        labels += own
    y = np.array(labels, np.int64)
    hot = np.eye(LABELS)[y] if len(y) else np.zeros((0, LABELS))
    x = np.zeros((len(y), N_FEATURES))
    for k, f in enumerate(features):
        x[k, f] = 1
    before, after, same, similar = (np.zeros((len(y), LABELS)) for _ in range(4))
    e = np.array(edges, np.int64).reshape(-1, 3)
    for kind, to_b, to_a in ((CHAIN, before, after), (SAME, same, same), (SIMILAR, similar, similar)):
        own = e[e[:, 2] == kind]
        np.add.at(to_b, own[:, 1], hot[own[:, 0]])
        np.add.at(to_a, own[:, 0], hot[own[:, 1]])
    w = [np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS), np.zeros(LABELS)]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, steps + 1 if len(y) else 1):
        scores = x @ w[0] + before @ w[1] + after @ w[1].T + same * w[2] + similar * w[3]
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        off = (p / p.sum(axis=1, keepdims=True) - hot) / len(y)
        slopes = [x.T @ off, before.T @ off + off.T @ after, (same * off).sum(axis=0), (similar * off).sum(axis=0)]
        for k, slope in enumerate(slopes):
            slope = slope + 1e-4 * w[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            w[k] = w[k] - 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    seen = {0, *labels}
    w[0][_BIAS, [k for k in range(LABELS) if k not in seen]] = _NEVER
    return Field(*w)


def _added(text: str, graph: Graph, labels: np.ndarray, sure: np.ndarray, held: list[int]) -> list[Span]:
    """Spans of the free words with a kind; a number's words in a row are one span for as long as it can be one number."""
    out: list[Span] = []
    count, last = 0, -2
    for k, (start, end) in enumerate(graph.places):
        if held[k] or labels[k] == 0 or sure[k] < MIN_BELIEF:
            continue
        kind, n = int(labels[k]) - 1, len(_DIGITS.findall(text[start:end]))
        most = {CARD: 19, PHONE: 15}.get(kind, 0)
        if last == k - 1 and out and out[-1][1] == kind and count + n <= most and text[start] != "+" and not text[out[-1][2] : start].strip(" "):
            out[-1] = (out[-1][0], kind, end)
            count += n
        else:
            out.append((start, kind, end))
            count = n
        last = k
    return out


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field adds to each text, one message passing for all of them. No added span touches a base span."""
    out: list[list[Span]] = [[] for _ in texts]
    graphs = []
    nodes = 0
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        g = graph_of(text, base)
        held = clamped(g, base)
        if not all(held):
            graphs.append((k, g, held, nodes))
            nodes += len(held)
    if not graphs:
        return out
    unary = unaries(field, [f for _, g, _, _ in graphs for f in g.features])
    held = np.array([h for _, _, hs, _ in graphs for h in hs])
    fixed = np.flatnonzero(held)
    unary[fixed] = _NEVER
    unary[fixed, held[fixed]] = 0
    # An edge between two fixed words says nothing.
    e = np.array([(a + at, b + at, kind) for _, g, hs, at in graphs for a, b, kind in g.edges if not (hs[a] and hs[b])], np.int64).reshape(-1, 3)
    pairs = np.stack([field.pair(kind) for kind in (CHAIN, SAME, SIMILAR)])[e[:, 2]]
    p = beliefs(unary, e[:, :2], pairs)
    labels, sure = p.argmax(axis=1), p.max(axis=1)
    for k, g, hs, at in graphs:
        out[k] = _added(texts[k], g, labels[at : at + len(hs)], sure[at : at + len(hs)], hs)
    return out


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field of a bounded sample: hashes are ranked first, so that no text is moved but the sample's."""
    t = docs.select(text_of(text_col).alias("text")).filter(F.regexp_like("text", F.lit("[0-9@]")) & (F.length("text") <= SAMPLE_CHARS))
    chosen = t.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample_docs)
    sample = t.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"))
    return train([r["text"] for r in sample.orderBy("h", "text").collect()])


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: id_col, base and added, arrays of (start, kind, end) in code points, by start and kind.

    Null texts count as empty and give no spans. Ids of any type are handed on, nulls too; repeated rows each get their own
    result, the same for the same text. A text's spans are gathered in one row, and a text is held whole by one task; time
    is linear in its length. An empty table gives an empty result, and a field that adds nothing. Other columns of docs
    are ignored, whatever their names. field: the trained potentials; by default those of a sample of docs, for which jobs run.
    The session hands rows to Python in small batches from then on.
    """
    small_batches(docs.sparkSession)
    field = fit(docs, text_col) if field is None else field
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    structs = lambda spans: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in one] for one in spans], kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), structs(base), structs(added_spans(texts, base, field))], ["id", "base", "added"])

    found = rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, base {_SPANS}, added {_SPANS}")
    return found.withColumnRenamed("id", id_col)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


#: Loopy message passing can't be expressed in SQL; the query is tested against brute force.
ORACLE: dict[str, str] = {}
QUERIES = {"op12_personal_data": op12_personal_data}
