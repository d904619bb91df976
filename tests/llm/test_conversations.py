"""Conversation repair and the prefix trie, against brute force and SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from revlens.llm import prefix_trie, registry, repair

SCHEMA = "conv_id long, turn long, role string, text string, source string, path binary, kind int, depth long, digest string, parent long, copies int"


def table(spark, rows, schema=SCHEMA):
    extra = len(schema.split(",")) - 4
    return spark.createDataFrame([(*r, *([None] * extra)) for r in rows], schema)


def messy(n, seed=5, most=9):
    """Conversations with nulls, ties, repeats, odd roles and texts, some hot, some without their base."""
    rnd, out = random.Random(seed), []
    texts = ["Hi.", "Hi", "Why? ", "Yes!\n", "", " \t", None, "no.. end", "é ü.", "long " * 50 + "."]
    for c in range(n):
        if c % 100 == 0 and c % 300 == 100:
            continue
        if c % 3 == 0:
            out += [(c, 0, "user", "Hi."), (c, 1, "assistant", "Yes!\n"), (c, 2, "user", "Why? ")][: c % 4]
        for t in range(rnd.randrange(1, most)):
            turn = None if rnd.random() < 0.1 else t if rnd.random() < 0.8 else rnd.randrange(4)
            out.append((c, turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "a"]), rnd.choice(texts)))
            if rnd.random() < 0.1:
                out.append(out[-1])
    rnd.shuffle(out)
    return out


def ordered(rows, nulls=""):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, nulls if role is None else role, nulls if text is None else text))
    return {c: [((t if known else None), r, x) for known, t, r, x in sorted(v)] for c, v in by.items()}


def exhaustive(rows, found):
    """The least (cost, audit, output) over all edits with up to len(rows) + 2 insertions."""
    best, n = None, len(rows)
    stack = [(0, "", (), "", 0)]
    while stack:
        cost, audit, made, initials, i = stack.pop()
        if best and cost > best[0]:
            continue
        if i == n and (initials.replace("s", "", 1) if initials[:1] == "s" else initials) == "ua" * (len(initials) // 2) and initials != "s":
            best = min(best, (cost, audit, made)) if best else (cost, audit, made)
        legal = lambda new: len(new) < 2 or new[-2:] in ("su", "ua", "au")
        if audit.count("I") < n + 2:
            for name in ("user", "assistant"):
                if legal(initials + name[0]):
                    stack.append((cost + 2, audit + "I", (*made, f"{name}:"), initials + name[0], i))
        if i < n:
            role, text = rows[i]
            stack.append((cost + 3, audit + "D", made, initials, i + 1))
            if found[i] in (0, 3):
                more = found[i] == 3
                if role[:1] in ("s", "u", "a") and role and legal(initials + role[0]):
                    stack.append((cost + more, audit + "K", (*made, f"{role}:{text}"), initials + role[0], i + 1))
                for name in ("user", "assistant"):
                    if legal(initials + name[0]):
                        stack.append((cost + 2 + more, audit + "R", (*made, f"{name}:{text}"), initials + name[0], i + 1))
    return best


def test_lightest_against_all_edits():
    rnd = random.Random(3)
    for _ in range(250):
        rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["a.", "b", "", "c!"])) for _ in range(rnd.randrange(0, 5))]
        found = repair.faults(rows)
        cost, audit, made = exhaustive(rows, found)
        assert repair.lightest([r for r, _ in rows], found) == (cost, audit)
        assert tuple(f"{r}:{t}" for r, t in repair.repaired(rows, audit)) == made


def test_long_conversation_keeps_audits_shared():
    rnd = random.Random(8)
    rows = [(rnd.choice(["user", "assistant", "system"]), f"t{k}.") for k in range(6000)]
    cost, audit = repair.lightest([r for r, _ in rows], repair.faults(rows))
    # A plain dynamic program over rows and roles, with whole audits.
    best = {"": (0, "")}
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    closed = lambda b: {q: min((c + 2 * k, a + "I" * k) for p, (c, a) in b.items() for k in range(3) if (p, nxt[p], nxt[nxt[p]])[k] == q) for q in {x for p in b for x in (p, nxt[p], nxt[nxt[p]])}}
    for role, _ in rows:
        step = {}
        for q, (c, a) in closed(best).items():
            for to, more, letter in [(q, 3, "D"), (nxt[q], 2, "R"), *([(role[0], 0, "K")] if role[0] == nxt[q] or (q == "" and role[0] == "s") else [])]:
                step[to] = min(step.get(to, (1 << 60, "")), (c + more, a + letter))
        best = step
    best = closed(best)
    assert (cost, audit) == min(best[q] for q in ("", "a") if q in best)


def test_repair_of_damaged_rows(spark):
    rows = [*messy(150), (None, 0, "user", "No id."), (None, 1, "assistant", "Still one conversation.")]
    got = {r["conv_id"]: r for r in repair.repair_conversations(repair.damaged(table(spark, rows)), repair.F.col("copies")).collect()}
    after, every = {}, {r[0] for r in rows}
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        after.setdefault(c, []).extend([(c, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    assert set(got) == every
    for c in every:
        in_order = ordered(after[c]).get(c, [])
        pairs = [(r, x) for _, r, x in in_order]
        turns = {t for t, _, _ in in_order if t is not None}
        found = repair.faults(pairs)
        r = got[c]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"]) == (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in (1, 2, 3)))
        assert r["illegal"] == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:], strict=False))
        assert (r["cost"], r["audit"]) == repair.lightest([p[0] for p in pairs], found)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in repair.repaired(pairs, r["audit"])).encode()).hexdigest()
    assert repair.repair_conversations(table(spark, [])).count() == 0
    gone = repair.repair_conversations(table(spark, [(1, 0, "user", "x.")]), repair.F.lit(0)).first()
    assert (gone["cost"], gone["audit"], gone["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def brute_trie(rows, head_of):
    turns = {c: [(r, x) for _, r, x in v] for c, v in ordered([r for r in rows if r[0] is not None]).items()}
    rebuilt = {c: turns.get(c - c % 100, [])[: head_of(c)] + own[head_of(c) :] for c, own in turns.items()}
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    out = set()
    for p, who in members.items():
        under = [q for q in members if q[: len(p)] == p]
        children = {q for q in under if len(q) == len(p) + 1}
        leaves = [q for q in under if not any(len(x) == len(q) + 1 and x[:-1] == q for x in under)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)
        ends = ",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(p))
        out.add((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("cells", [64, prefix_trie.CELLS])
def test_trie_against_brute_force(spark, cells):
    """With a full sketch, which proves nothing, and with one that screens: the same rows."""
    rows = [*messy(330, most=6), (None, 0, "user", "no id")]
    conv = prefix_trie.F.col("conv_id")
    got = prefix_trie.prefix_trie(table(spark, rows), conv - conv % 100, prefix_trie.F.crc32(conv.cast("string").cast("binary")) % 6, cells)
    assert as_rows(got) == brute_trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6)


def test_trie_of_little_and_of_copies(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0
    assert as_rows(prefix_trie.prefix_trie(table(spark, [(7, None, None, None)]))) == brute_trie([(7, None, None, None)], lambda c: 0)
    copies = [(c, t, "user", "x" * t) for c in range(400) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(400, 440)]
    assert as_rows(prefix_trie.prefix_trie(table(spark, copies))) == brute_trie(copies, lambda c: 0)
    with pytest.raises(TypeError, match="integer"):
        prefix_trie.prefix_trie(spark.createDataFrame([("a", 0, "user", "x")], "conv_id string, turn long, role string, text string"))


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    ids = spark.range(1000).selectExpr("cast('a' as binary) AS digest", "id AS conv_id").repartition(7)
    assert prefix_trie.ends_digest(ids).first()["ends_sha256"] == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()


def test_screening_proves_tails(spark):
    paths = prefix_trie.conversation_paths(table(spark, [(c, t, "user", f"{c * (t > 0)}-{t}") for c in range(50) for t in range(8)]))
    kinds = dict(prefix_trie.screened(paths).groupBy("kind").count().collect())
    assert kinds == {prefix_trie.SHARED: 100, prefix_trie.FIRST_OF_TAIL: 50, prefix_trie.TAIL: 300}


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op13_prefix_trie"])
def test_queries_agree_with_sql(spark, tmp_path, name):
    table(spark, messy(230), "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "conversations.parquet").write_bytes(next((tmp_path / "p").glob("part-*")).read_bytes())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert set(columns) == set(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
