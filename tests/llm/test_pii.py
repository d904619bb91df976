"""Personal data: patterns against plain ones, message passing against enumeration, whole results on planted texts."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from revlens.llm import pii, registry

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    """The four patterns as they are told, with their checks."""
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2:
                twice = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(x // 10 + x % 10 for x in twice) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rnd = random.Random(4)
    pieces = ["a", "b.c", "@", "x@y.zz", ".", "..", "1", "255", "256", "007", "1.2.3.4", "4465758382889437", " ", " ", "-", "+1", "(", ")", "555-3824", "é", "ü@x.y", "\n", "%", "a@b@c.d", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    """Runs that a pattern would enter at every place: ten times the length takes no more than some thirty times the time."""
    spent = []
    for n in (20_000, 200_000):
        began = time.process_time()
        for unit in ("a", "1", "1.", "@", "a@", "+1", "+", "(", "1-", " 1"):
            pii.added_spans([unit * n], [pii.base_spans(unit * n)], FIELD)
        spent.append(time.process_time() - began)
    assert spent[1] < 30 * spent[0] + 1


def some_texts(n, seed=1):
    rnd = random.Random(seed)
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))

    def card():
        body = "4" + number(14)
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    makers = [lambda: f"+1 ({number(3)}) 555-{number(4)}", card, lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), lambda: f"user{number(3)}@mail{number(1)}.example.com", lambda: rnd.choice(["ann.lee", "bob_ray"]) + "@example.org"]
    return [" ".join("".join(rnd.choice("aeinorst") for _ in range(rnd.randrange(2, 8))) if rnd.random() < 0.9 else rnd.choice(makers)() for _ in range(60)) for _ in range(n)]


FIELD = pii.train(some_texts(150))


def found(text):
    base = pii.base_spans(text)
    return {(pii.KINDS[k], text[s:e]) for s, k, e in pii.added_spans([text], [base], FIELD)[0]}


FAR = " words " * 200


def test_distant_mentions_are_consistent():
    assert found(f"Call +1 (743) 555-3824.{FAR}or 743-555-3824, or 555-3824 then.") >= {("phone", "743-555-3824"), ("phone", "555-3824")}
    assert found(f"4465758382889437 4465758382889437 {FAR} and 4465.7583.8288.9437") >= {("card", "4465758382889437")}
    assert found(f"To ann.lee@example.org{FAR}from Ann.Lee(at)example.org") == {("email", "Ann.Lee(at)example.org")}


def test_the_skip_decides():
    """The same words without the distant mention, or with another number there, stay plain."""
    assert found(f"Call us.{FAR}or 555-3824 then.") == set()
    assert found(f"Call +1 (743) 555-1111.{FAR}or 555-3824 then.") == set()
    assert found(f"Ann.lee wrote.{FAR}Version 1.2.3, 2024-01-31, 12:30, (743), 99887766, token 1eb9c654e721b4f812088970e66a6345cee33dd6, @bob, 1234567812345678") == set()


def test_no_added_span_touches_a_base_span():
    for text in some_texts(40, 9):
        base = pii.base_spans(text)
        for s, _, e in pii.added_spans([text], [base], FIELD)[0]:
            assert all(e <= bs or be <= s for bs, _, be in base)


def enumerated(unary, edges, pairs):
    n = len(unary)
    out = np.zeros_like(unary)
    for labels in itertools.product(range(unary.shape[1]), repeat=n):
        score = sum(unary[i, x] for i, x in enumerate(labels)) + sum(p[labels[a], labels[b]] for (a, b), p in zip(edges, pairs, strict=True))
        for i, x in enumerate(labels):
            out[i, x] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_message_passing_against_enumeration():
    rng = np.random.default_rng(2)
    for edges, close in ((np.array([[0, 1], [1, 2], [1, 3], [3, 4]]), 0.01), (np.array([[0, 1], [1, 2], [2, 3], [3, 4], [0, 4], [1, 3]]), 0.08)):
        unary = rng.normal(size=(5, pii.LABELS))
        pairs = rng.normal(size=(len(edges), pii.LABELS, pii.LABELS)) * 0.7
        assert np.abs(pii.beliefs(unary, edges, pairs) - enumerated(unary, edges, pairs)).max() < close


def test_kinds_without_examples_are_never_given():
    field = pii.train([t for t in some_texts(60) if True])
    only = pii.train(["mail me at someone1@example.com " * 3])
    assert (only.nodes[0, [1 + pii.IP, 1 + pii.CARD, 1 + pii.PHONE]] < -1e5).all() and (field.nodes[0] > -1e5).all()
    text = "a 555-3824 b"
    assert pii.added_spans([text], [[]], pii.train([]))[0] == []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, base string, added string, start int, kind string"


@pytest.fixture(scope="module")
def rows():
    texts = [*some_texts(80), None, "", " \n", "x" * 300_000, "9" * 300_000, f"Call +1 (743) 555-3824.{FAR}or 743-555-3824 then.", f"Call +1 (743) 555-3824.{FAR}or 743-555-3824 then.", "é ü +49 (30) 901820-11 ok"]
    return [(None if k == 5 else k // 2, t, None, None, None, k, "b", "a", 1, "k") for k, t in enumerate(texts)]


def test_whole_query_on_awkward_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    field = pii.fit(docs)
    got = sorted(map(str, ((r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["added"]]) for r in pii.find_personal_data(docs).collect())))
    base = [plain(r[1] or "") if len(r[1] or "") < 1000 or not (r[1] or "").startswith(("x", "9")) else [] for r in rows]
    want = []
    for r, b in zip(rows, base, strict=True):  # one text at a time, the enumeration's order
        want.append(str((r[0], b, pii.added_spans([r[1] or ""], [b], field)[0])))
    assert got == sorted(want)
    assert any("743-555-3824" in r[1] and pii.added_spans([r[1]], [plain(r[1])], field)[0] for r in rows if r[1])
    assert pii.find_personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    named = docs.select(docs["doc_id"].cast("string").alias("key"), docs["text"].alias("body"))
    assert dict(pii.find_personal_data(named, "key", "body", field).dtypes)["key"] == "string"


def test_query_columns(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "documents.parquet").write_bytes(next((tmp_path / "p").glob("part-*")).read_bytes())
    got = registry.QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(plain(r[1] or "") if len(r[1] or "") < 100_000 else [])
    for r in got:
        ways = [",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b) for b in texts[r["doc_id"]]]
        assert r["base_sha256"] in {hashlib.sha256(w.encode()).hexdigest() for w in ways}
        spans = [x for x in r["spans"].split(",") if x]
        assert len(spans) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]
        assert [int(x.split(":")[1]) for x in spans] == sorted(int(x.split(":")[1]) for x in spans)
