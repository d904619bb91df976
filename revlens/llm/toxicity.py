"""Toxicity by a subsequence string kernel and a support vector machine with Nystroem landmarks.

The kernel compares windows of up to WINDOW words by their common subsequences of three characters. The space between
words is a character like others, a gap. A subsequence weighs DECAY to the power of the characters it spans, so that
windows still agree when characters or spaces were inserted or left out. A kernel machine is trained over the kernel's
values at some landmark windows (Nystroem's approximation). Its decision function is linear in the landmarks'
subsequences, so that it folds into one weight for each subsequence: scoring a window adds up the weights of its own, as
differences of sums that run over the text. A text is described by its worst windows and by how many are bad, and a
logistic curve turns that into a probability.

It is trained on labelled sentences. A sentence is as bad as its worst window, the one that the machine sees of it.
Labels are per document, so that all sentences of a clean text are clean, while those of a toxic text have labels to be
found, in rounds: at first the sentences with a window that many toxic texts have and hardly any others are toxic, then
those that the machine of the round before calls so, each by its worst window. The curve is fitted on texts that the
machine whose features it sees was not trained on.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import release_memory, small_batches, table, text_of

DECAY = 0.7
#: A subsequence spans so many characters at most.
SPAN = 9
#: a to z, GAP, and shares of all other letters.
LETTERS = 48
FEATURES = LETTERS**3
LANDMARKS = 400
#: The training sample: so many labelled documents of either label, each of so many bytes at most.
SAMPLE_DOCS = 2000
SAMPLE_BYTES = 20_000
#: Words in a window at most.
WINDOW = 3
#: Longer words are cut into overlapping pieces.
MOST_LETTERS = 40
CACHE_WORDS = 200_000
#: Windows are judged so many at a time in training, and the gaps of texts in scoring.
CHUNK = 512
BLOCK = 1 << 15
#: Texts are cut into words so many characters at a time, or one text.
PIECE_CHARS = 1 << 18
#: Least log-likelihood ratio of a window that stands for the label. Where none has it, FALLBACK best ones are taken.
LEAST_RATIO = 15.0
FALLBACK = 50
#: Windows of toxic texts are counted in so many parts, one after another.
WINDOW_PARTS = 8
#: Rounds of labelling sentences and training, and a round's positive and further negative windows at most.
ROUNDS = 3
MOST_WINDOWS = 1000
HARDEST = 500
#: A sentence of a toxic text is toxic if the machine's decision on its worst window is above this.
SURE = 0.5
FOLDS = 2
#: The code of word ends and of the space between words.
GAP = 26
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]

_DIGITS = str.maketrans("013457@", "oieasta")
_SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .*_\-]+){2,}[^\W\d_](?![^\W\d_])")
_JUNK = re.compile(r"[\W\d_]+")
#: Bits of a word's number in a window's.
_BITS = 21


def unit_of(word: str) -> str:
    """A word as the kernel sees it: lower case, letters only without accents, digits in words read as the letters they look like."""
    w = word.lower()
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(c))
    if not w.isalpha():
        if any(c.isdigit() or c == "@" for c in w) and any(c.isalpha() for c in w):
            w = w.translate(_DIGITS)
        w = _JUNK.sub("", w)
    return w


def words_of(text: str) -> list[str]:
    """The words of a text, with letters that are spelled out one by one put together."""
    words = text.split()
    return words + [_JUNK.sub("", m[0]) for m in _SPELLED.finditer(text)]


def _codes(unit: str) -> list[int]:
    return [ord(c) - 97 if "a" <= c <= "z" else GAP if c == " " else 27 + ord(c) % (LETTERS - 27) for c in unit]


#: A character for each code.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz " + "".join(chr(0x4E00 + (k - 0x4E00) % (LETTERS - 27)) for k in range(LETTERS - 27))


def _chunks(unit: str) -> list[str]:
    step = MOST_LETTERS - SPAN
    return [unit[i : i + MOST_LETTERS] for i in range(0, max(1, len(unit) - SPAN), step)] if len(unit) > MOST_LETTERS else [unit]


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, feature, value) of all subsequences, values scaled so that lengths compare; units get word ends."""
    coded = [[GAP, *_codes(u), GAP] for u in units]
    size = np.array([len(c) for c in coded])
    flat = np.fromiter((x for c in coded for x in c), np.int64, int(size.sum()))
    owner = np.repeat(np.arange(len(units)), size)
    rows, features, values = [], [], []
    norm = np.zeros(len(units))
    for a, b in _OFFSETS:
        n = len(flat) - b
        if n <= 0:
            continue
        ok = np.flatnonzero(owner[:n] == owner[b:])
        weight = DECAY ** (b + 1)
        rows.append(owner[ok])
        features.append((flat[ok] * LETTERS + flat[ok + a]) * LETTERS + flat[ok + b])
        values.append(np.full(len(ok), weight))
        norm += np.maximum(size - b, 0) * weight**2
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, v = np.concatenate(rows), np.concatenate(values)
    return r, np.concatenate(features), v / np.sqrt(norm[r])


@dataclass
class Model:
    weights: np.ndarray  # one for each subsequence
    bias: float
    curve: np.ndarray  # of the logistic curve, one for each of a text's features, the last for none

    def decide(self, units: list[str]) -> np.ndarray:
        """The machine's decision for each unit, a window of words."""
        parts = [self._decide(units[i : i + CHUNK]) for i in range(0, len(units), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _decide(self, units: list[str]) -> np.ndarray:
        r, f, v = subsequences(units)
        return np.bincount(r, self.weights[f] * v, minlength=len(units)) + self.bias

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.curve[:-1] + self.curve[-1], -30, 30)))


class Scorer:
    """Scores texts; the codes of words seen before are looked up."""

    def __init__(self, model: Model, known: dict[str, bytes] | None = None) -> None:
        self.model, self.known = model, {} if known is None else known
        # Whole numbers, so that running sums give the same differences wherever they begin.
        self.tables = {b: np.round(model.weights * (2**20 * DECAY ** (b + 1))).astype(np.int32) for b in range(2, SPAN)}

    def features(self, texts: list[str]) -> np.ndarray:
        """Of each text: the three worst windows' decisions, and the logarithms of its bad windows and of all its words."""
        out, begin, size = [np.zeros((0, 5))], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= PIECE_CHARS or i == len(texts) - 1:
                out.append(self._features(texts[begin : i + 1]))
                begin, size = i + 1, 0
        return np.concatenate(out)

    def _stream(self, text: str) -> tuple[bytes, int]:
        """The codes of a text's words with gaps around each, and the number of its words."""
        words, known = words_of(text), self.known
        for w in {w for w in words if w not in known}:
            known[w] = bytes([GAP]).join(bytes(_codes(c)) for c in _chunks(unit_of(w)))
        body = bytes([GAP]).join(filter(None, map(known.__getitem__, words)))
        return bytes([GAP]) + body + bytes([GAP]) if body else b"", len(words)

    def _sums(self, flat: np.ndarray) -> list[np.ndarray]:
        """For each span b, running sums over the positions of the weights of subsequences from there to b further on."""
        out = []
        for b in range(2, SPAN):
            n = max(0, len(flat) - b)
            ends = flat[:n] * (LETTERS * LETTERS) + flat[b : b + n]
            got = np.zeros(n, np.int64)
            for a in range(1, b):
                got += self.tables[b][ends + flat[a : a + n] * LETTERS]
            out.append(np.concatenate([[0], np.cumsum(got)]))
        return out

    def _windows(self, flat: np.ndarray, gaps: np.ndarray, which: np.ndarray, best: np.ndarray, reach: np.ndarray) -> None:
        """Set best to the worst decision of a window that begins at each gap, reach to the window's words."""
        sums = self._sums(flat[gaps[0] : gaps[-1] + 1])
        gaps = gaps - gaps[0]
        for k in range(1, WINDOW + 1):
            at = np.flatnonzero(which[k:] == which[:-k])
            at = at[at < len(best)]
            begin, end = gaps[at], gaps[at + k]
            total, norm = np.zeros(len(at), np.int64), np.zeros(len(at))
            for b, running in zip(range(2, SPAN), sums, strict=True):
                ok = end - begin >= b
                total += running[np.where(ok, end - b + 1, 0)] - running[np.where(ok, begin, 0)]
                norm += np.maximum(end - begin + 1 - b, 0) * ((b - 1) * DECAY ** (2 * b + 2))
            found = total / 2**20 / np.sqrt(np.maximum(norm, 1e-12)) + self.model.bias
            better = found > best[at]
            best[at[better]], reach[at[better]] = found[better], k

    def _judged(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """The texts' codes, the gaps in them, the first gap of each text and one more, each text's words, and best and reach of _windows()."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        streams = [self._stream(t) for t in texts]
        flat = np.frombuffer(b"".join(x for x, _ in streams), np.uint8).astype(np.int32)
        edges = np.cumsum([0] + [len(x) for x, _ in streams])
        gaps = np.flatnonzero(flat == GAP)
        which = np.searchsorted(edges, gaps, "right") - 1
        best = np.full(len(gaps), -np.inf)
        reach = np.ones(len(gaps), np.int64)
        for low in range(0, len(gaps), BLOCK):
            self._windows(flat, gaps[low : low + BLOCK + WINDOW], which[low : low + BLOCK + WINDOW], best[low : low + BLOCK], reach[low : low + BLOCK])
        return flat, gaps, np.searchsorted(which, np.arange(len(texts) + 1)), np.array([n for _, n in streams]), best, reach

    def _features(self, texts: list[str]) -> np.ndarray:
        flat, _, first, n_words, best, reach = self._judged(texts)
        out = np.zeros((len(texts), 5))
        out[:, :3] = -1.5
        out[:, 4] = np.log1p(n_words)
        for row, a, z in zip(out, first[:-1], first[1:], strict=True):
            if z - a < 2:
                continue
            score, width = best[a : z - 1].copy(), reach[a : z - 1]
            row[3] = np.log1p((score > 0.5).sum())
            for k in range(3):  # windows apart from each other
                i = int(score.argmax())
                if score[i] == -np.inf:
                    break
                row[k] = np.clip(score[i], -1.5, 1.5)
                low = max(0, i - WINDOW + 1)
                near = np.arange(low, i + width[i])
                score[near[near + width[near] > i]] = -np.inf
        return out

    def worst(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        """Each text's worst window and the decision on it; nothing and minus infinity for texts without words."""
        scores, windows = [np.zeros(0)], []
        for i in range(0, len(texts), CHUNK):
            flat, gaps, first, _, best, reach = self._judged(texts[i : i + CHUNK])
            some = []
            for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                k = a + int(best[a : z - 1].argmax()) if z - a >= 2 else -1
                some.append(float(best[k]) if k >= 0 else -np.inf)
                windows.append("".join(map(_ALPHABET.__getitem__, flat[gaps[k] + 1 : gaps[k + reach[k]]].tolist())) if k >= 0 else "")
            scores.append(np.array(some))
        return np.concatenate(scores), windows


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps whose sums are taken CHUNK rows at a time; the last weight is the bias."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty * weight.sum())
    ridge[-1] = 1e-6
    for _ in range(30):
        grad, curvature = ridge * w, np.diag(ridge)
        for i in range(0, len(x), CHUNK):
            rows, label = np.hstack([x[i : i + CHUNK], np.ones((len(x[i : i + CHUNK]), 1))]), y[i : i + CHUNK]
            slack = 1 - label * (rows @ w)
            on = slack > 0
            rows, scaled = rows[on], rows[on] * weight[i : i + CHUNK][on, None]
            grad -= scaled.T @ (label[on] * slack[on])
            curvature += scaled.T @ rows
        step = np.linalg.solve(curvature, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A logistic curve's weights, the last for the constant, with a little shrinkage."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.array([0.1] * x.shape[1] + [1e-6])
    loss = lambda w: np.logaddexp(0, (1 - 2 * y) * (z @ w)).sum() + (ridge * w * w).sum() / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        # Half the step until the loss falls: whole ones swing past it where the labels are well apart.
        was, part = loss(w), 1.0
        while part > 1e-6 and loss(w - part * step) > was:
            part /= 2
        w = w - part * step
        if np.abs(step).max() < 1e-9 or part <= 1e-6:
            break
    return w


def _spread(texts: list[str]) -> list[int]:
    """Indices of texts that share no sampled run of eight words with an earlier one, so that copies count once."""
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        w = t.split()
        marks = sorted({zlib.crc32(" ".join(w[k : k + 8]).encode()) for k in range(max(1, len(w) - 7))})[:4]
        if seen.isdisjoint(marks):
            out.append(i)
        seen.update(marks)
    return out


_unit_again = lru_cache(50_000)(unit_of)  # for training, which sees its few words often


def tokens_of(text: str) -> list[str]:
    """The words of a text as the kernel sees them, long ones in pieces."""
    return [c for w in words_of(text) for c in _chunks(_unit_again(w)) if c]


def _windows(d: np.ndarray) -> np.ndarray:
    """The different windows of one to WINDOW words of a text, each as one number; words are numbers from 1."""
    runs = [d]
    for _ in range(1, WINDOW):
        runs.append((runs[-1][:-1] << _BITS) | d[len(runs) :])
    return np.unique(np.concatenate(runs))


_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n")


def sentences_of(text: str) -> list[str]:
    """What stands between line ends, and between full stops and the like that end words."""
    return [x for x in _SENTENCE.split(text) if x.strip()]


def _ratio(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """How much likelier counts are if what is counted depends on the label."""
    return 2 * (a * np.log(a / ((a + b) * share)) + b * np.log(np.maximum(b, 1) / ((a + b) * max(1e-9, 1 - share))))


def _own_windows(bad: list[np.ndarray], good: list[np.ndarray], text_of_key) -> dict[str, float]:
    """Windows that are the toxic texts' own, of which none holds another: in several of them, far more often than in others, and not by chance."""
    share = len(bad) / max(1, len(bad) + len(good))
    best: list[tuple[float, int]] = []  # negative strengths and windows
    for part in range(WINDOW_PARTS):
        keys, in_bad = np.unique(np.concatenate([np.zeros(0, np.int64), *(w[w % WINDOW_PARTS == part] for w in bad)]), return_counts=True)
        in_good = np.zeros(len(keys), np.int64)
        for w in good:
            w = w[w % WINDOW_PARTS == part]
            at = np.searchsorted(keys, w)
            at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == w)] if len(keys) else at[:0]
            in_good[at] += 1
        own = np.flatnonzero(in_bad > 8 * in_good * share / max(1e-9, 1 - share))
        strength = _ratio(in_bad[own], in_good[own], share) if share else np.zeros(0)
        # Those that are strong enough, and FALLBACK in any case.
        order = np.argsort(-strength, kind="stable")
        order = order[: max(FALLBACK, int((strength > LEAST_RATIO).sum()))]
        best += zip((-strength[order]).tolist(), keys[own[order]].tolist(), strict=True)
    enough = [x for x in best if -x[0] > LEAST_RATIO] or sorted(best)[:FALLBACK]
    odd: dict[str, float] = {}
    for k, x in sorted(((text_of_key(key), -lost) for lost, key in enough), key=lambda r: (r[0].count(" "), r[0])):
        parts = k.split(" ")
        if len(k) > 2 and not any(" ".join(parts[i:j]) in odd for i in range(len(parts)) for j in range(i + 1, len(parts) + 1) if j - i < len(parts)):
            odd[k] = x
    return odd


def _nystroem(landmarks: list[str]):
    """The kernel's values at the landmarks as features, and how weights of these become weights of subsequences."""
    # The kernel with a landmark needs the subsequences that landmarks have, no others.
    used = np.unique(subsequences(landmarks)[1])

    def dense(units: list[str]) -> np.ndarray:
        r, f, v = subsequences(units)
        at = np.minimum(np.searchsorted(used, f), len(used) - 1)
        ok = used[at] == f
        out = np.zeros((len(units), len(used)), np.float32)
        np.add.at(out, (r[ok], at[ok]), v[ok])
        return out

    held = dense(landmarks)
    values, vectors = np.linalg.eigh((held @ held.T).astype(np.float64) + 1e-6 * np.eye(len(landmarks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-9))

    def mapped(units: list[str]) -> np.ndarray:
        out = np.empty((len(units), len(landmarks)))
        for i in range(0, len(units), CHUNK):
            out[i : i + CHUNK] = dense(units[i : i + CHUNK]) @ held.T @ root
        return out

    def folded(w: np.ndarray) -> np.ndarray:
        weights = np.zeros(FEATURES)
        weights[used] = held.T @ (root @ w)
        return weights

    return mapped, folded


def _marks(bad: list[list[str]], good: list[list[str]], rng: np.random.Generator) -> tuple[dict[str, float], list[str], list[str]]:
    """Windows that are the toxic texts' own, with their strength; the strongest of them; and windows drawn from clean texts. Texts are lists of sentences."""
    names: dict[str, int] = {}
    numbered = lambda t: np.array([names.setdefault(u, len(names) + 1) for u in tokens_of(t)], np.int64)
    windows_of = lambda d: np.unique(np.concatenate([np.zeros(0, np.int64), *(_windows(numbered(x)) for x in d)]))
    bad_windows, good_windows = [windows_of(d) for d in bad], [windows_of(d) for d in good]
    word = list(names)
    text_of_key = lambda k: " ".join(word[i - 1] for i in (k >> 2 * _BITS, (k >> _BITS) % 2**_BITS, k % 2**_BITS) if i)
    odd = _own_windows(bad_windows, good_windows, text_of_key)
    marks = sorted(odd, key=lambda u: (-odd[u], u))[:LANDMARKS]
    # Windows of clean sentences: words, and some of several words, drawn from all and from those with a word of a mark.
    held_words = np.array(sorted({names[p] for u in marks for p in u.split(" ")}), np.int64)
    drawn = [np.zeros(0, np.int64)]
    for w in good_windows:
        many = w[w >= 2**_BITS]
        near = np.isin(many % 2**_BITS, held_words) | np.isin((many >> _BITS) % 2**_BITS, held_words) | np.isin(many >> 2 * _BITS, held_words)
        drawn += [w[w < 2**_BITS], rng.permutation(many[near])[:20], rng.permutation(many)[:20]]
    return odd, marks, sorted({text_of_key(int(k)) for k in np.unique(np.concatenate(drawn))} - set(odd))


def fit(toxic: list[str], clean: list[str], seed: int = 7) -> Model | None:
    """A machine without a curve, from sentences of toxic and of clean texts. None where no window tells them apart."""
    rng = np.random.default_rng(seed)
    bad, good = ([[x for x in sentences_of(texts[i])] for i in _spread(texts)] for texts in (toxic, clean))
    odd, marks, others = _marks(bad, good, rng)
    if not marks:
        return None
    pick = lambda xs, n: [xs[i] for i in sorted(rng.choice(len(xs), min(n, len(xs)), replace=False))]
    negatives = pick(others, 3000)
    mapped, folded = _nystroem((marks[: LANDMARKS // 2] + pick(others, LANDMARKS))[:LANDMARKS])
    bad_sentences, good_sentences = ([x for d in part for x in d] for part in (bad, good))

    # At first a toxic sentence is one that holds a mark, which stands for it.
    rank = {names_key: k for k, names_key in enumerate(sorted(odd, key=lambda u: (-odd[u], u)))}
    found: Counter[str] = Counter()
    for x in bad_sentences:
        units = tokens_of(x)
        held = [u for k in range(1, WINDOW + 1) for u in (" ".join(units[i : i + k]) for i in range(len(units) - k + 1)) if u in rank]
        if held:
            found[min(held, key=rank.__getitem__)] += 1
    clean_windows = set(others)
    known: dict[str, bytes] = {}
    for _ in range(ROUNDS):
        release_memory()
        positives = [u for u, _ in sorted(found.items(), key=lambda r: (-r[1], r[0]))[:MOST_WINDOWS]]
        # Each also with a letter put in somewhere, twice, and words with a space, at a lower weight.
        inserted = [u[:k] + chr(97 + c) + u[k:] for u in positives for k, c in zip(rng.integers(1, max(2, len(u)), 2), rng.integers(0, 26, 2), strict=True)]
        inserted += [u[:k] + " " + u[k:] for u in positives if " " not in u and len(u) > 3 for k in rng.integers(2, len(u) - 1, 2)]
        inserted = [u for u in inserted if u not in clean_windows]
        units = positives + inserted + negatives
        y = np.array([1.0] * (len(positives) + len(inserted)) + [-1.0] * len(negatives))
        heavy = np.sqrt([found[u] for u in positives] + [1.0] * len(inserted))
        weight = np.concatenate([heavy / heavy.sum(), np.full(len(negatives), 1.0 / max(1, len(negatives)))]) * len(units)
        w = _svm(mapped(units), y, weight)
        model = Model(folded(w[:-1]), float(w[-1]), np.zeros(6))
        # The sentences' labels and worst windows as this machine has them. Clean ones that score worst join the next round.
        scorer = Scorer(model, known)
        scores, windows = scorer.worst(good_sentences)
        hard = [windows[i] for i in np.argsort(-scores, kind="stable")[:HARDEST] if windows[i]]
        hard += [others[i] for i in np.argsort(-model.decide(others), kind="stable")[:HARDEST]]
        clean_windows.update(windows)
        negatives = sorted((set(negatives) | set(hard)) - set(odd))
        scores, windows = scorer.worst(bad_sentences)
        again = Counter(u for u, x in zip(windows, scores, strict=True) if x > SURE and (u in odd or u not in clean_windows))
        found = again or found
    return model


def _broken(text: str, model: Model) -> str:
    """The text with a space put into its bad words."""
    words = text.split()
    scores = model.decide([unit_of(w)[:MOST_LETTERS] for w in words]) if words else []
    return " ".join(f"{w[: len(w) // 2]} {w[len(w) // 2 :]}" if len(w) > 3 and x > SURE else w for w, x in zip(words, scores, strict=True))


def train(toxic: list[str], clean: list[str], base: float | None = None, seed: int = 7) -> Model:
    """A model from sampled texts of either label. With too few toxic texts it gives base, their share, as every score."""
    base = (len(toxic) + 0.5) / (len(toxic) + len(clean) + 1) if base is None else base
    model = fit(toxic, clean, seed)
    if model is None:
        return Model(np.zeros(FEATURES), -1.0, np.array([0.0] * 5 + [np.log(base / (1 - base))]))
    x, y = [np.zeros((0, 5))], []
    for k in range(FOLDS):  # texts by a hash, so that copies of one stay together
        out = lambda t, k=k: zlib.crc32(t[:200].encode("utf-8", "replace")) % FOLDS == k
        machine = fit([t for t in toxic if not out(t)], [t for t in clean if not out(t)], seed)
        if machine is None:  # too few texts to leave some out
            machine, out = model, lambda t, k=k: k == 0
        bad, good = [t for t in toxic if out(t)], [t for t in clean if out(t)]
        # Toxic texts count again with their words broken, so that the curve knows how those score.
        broken = [b for b, t in ((_broken(t, machine), t) for t in bad) if len(b.split()) > len(t.split())]
        scorer = Scorer(machine)
        x += [scorer.features(texts) for texts in (bad, broken, good) if texts]
        y += [1.0] * (len(bad) + len(broken)) + [0.0] * len(good)
    model.curve = _logistic(np.concatenate(x), np.array(y))
    return model


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[str], float]:
    """Texts of at most SAMPLE_DOCS labelled rows of either label, outside the held-out fold, drawn by a hash of the id, and the toxic share of all such rows.

    Rows without an id, label or text, and texts over SAMPLE_BYTES, are not drawn; of an id's labels the largest counts.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    known = known.filter(fold_of(F.col("id")) != 0)
    drawn: list[list] = []
    for value in (1, 0):
        order = known.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
        drawn.append([r["id"] for r in order.collect()])
    wanted = docs.sparkSession.createDataFrame([(i, y) for y, ids in zip((1, 0), drawn, strict=True) for i in ids], "id long, label int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # wanted has 2 * SAMPLE_DOCS rows at most
    rows = sorted(set(map(tuple, rows.join(F.broadcast(wanted), "id").select("label", "id", "text").collect())))
    share = known.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    return [t for y, _, t in rows if y == 1], [t for y, _, t in rows if y == 0], 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The toxicity of each text, 0 to 1, as a column."""
    scorers: list[Scorer] = []

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not scorers:
            scorers.append(Scorer(model))
        for texts in batches:
            yield pa.array(scorers[0].model.probability(scorers[0].features(texts.to_pylist())))
            pa.default_memory_pool().release_unused()

    return score(text_of(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score_col (0 to 1) and predicted_col (1 from 0.5), trained on labels(id_col, toxic).

    Null and empty texts score as a text whose words are all harmless. Repeated rows score alike. Without labelled
    rows every score is the same. An empty table gives an empty result. A document's columns of these two names are
    refused, so that none is lost; name them otherwise then. All others are handed on.
    """
    if taken := {c.lower() for c in docs.columns} & {score_col.lower(), predicted_col.lower()}:
        raise ValueError(f"the documents have {', '.join(sorted(taken))} already: give score_col and predicted_col")
    small_batches(docs.sparkSession)
    model = train(*training_sample(docs, labels, id_col, text_col))
    # The driver goes on for long after: what training took is given back.
    _unit_again.cache_clear()
    release_memory()
    return docs.withColumn(score_col, score_texts(docs, model, text_col)).withColumn(predicted_col, (F.col(score_col) >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id")) == 0
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", held_out.alias("held_out"), "score", "predicted")


ORACLE: dict[str, str] = {}
QUERIES = {"op9_toxicity": op9_toxicity}
