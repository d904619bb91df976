"""Repair of conversation structure by Knuth's generalisation of Dijkstra's algorithm.

The edits of a conversation's rows are axioms of a weighted hypergraph, a prefix item says that so many rows are edited and
which role the output ends with, and each deduction joins a prefix item with an edit. An item's value is its cost and its
audit, the edits' initials. Values add costs and append initials, and are compared by cost, then by audit in ASCII order.
That is superior (no deduction is better than what it is made of) and monotone (of two derivations of an item neither audit
can begin with the other at the same cost, since what an audit costs hangs on its letters and the rows alone). So the agenda
pops every item with its lightest derivation, and stops when the goal is popped.

The rows are dealt by conversation and sorted; a task streams them and holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import small_batches, table

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: What the output ends with: nothing, a system, a user or an assistant turn; and the role that must come next.
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
_INITIAL = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
_NEXT = {_EMPTY: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"
OUT_ROWS = 500


class Derivation:
    """The lightest known way to an item: the last edit, and the derivation of the prefix before it.

    jump leads far back, so that two audits are compared in logarithmic time without being written out.
    """

    __slots__ = ("cost", "depth", "jump", "letter", "up")

    def __init__(self, up: Derivation | None, cost: int, letter: str) -> None:
        self.cost, self.letter = cost, letter
        if up is None:
            self.up = self.jump = self
            self.depth = 0
            return
        self.up, self.depth = up, up.depth + 1
        far = up.jump
        self.jump = far.jump if up.depth - far.depth == far.depth - far.jump.depth else up

    def __lt__(self, other: Derivation) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        x, y = self._raised(other.depth), other._raised(self.depth)
        if x is y:  # one audit begins with the other
            return self.depth < other.depth
        while x.up is not y.up:
            x, y = (x.jump, y.jump) if x.jump is not y.jump else (x.up, y.up)
        return x.letter < y.letter

    def _raised(self, depth: int) -> Derivation:
        x = self
        while x.depth > depth:
            x = x.jump if x.jump.depth >= depth else x.up
        return x

    def audit(self) -> str:
        letters, x = [], self
        while x.depth:
            letters.append(x.letter)
            x = x.up
        return "".join(reversed(letters))


def faults(rows: list[tuple[str, str]]) -> list[int]:
    """The first fault of each (role, text)."""
    seen: set[tuple[str, str]] = set()
    out = []
    for row in rows:
        bare = row[1].strip(_SPACE)
        out.append(BLANK if not bare else DUPLICATE if row in seen else TRUNCATED if bare[-1] not in ".!?" else SOUND)
        seen.add(row)
    return out


def lightest(roles: list[str], found: list[int]) -> tuple[int, str]:
    """Cost and audit of the lightest repair to role initials (s?(ua)+)? for rows with these roles and faults."""
    n = len(roles)
    states = [_INITIAL.get(r[:1]) for r in roles]
    best: dict[int, Derivation] = {0: Derivation(None, 0, "")}
    done: set[int] = set()
    agenda = [(best[0], 0)]
    while True:
        d, item = heapq.heappop(agenda)
        if item in done:
            continue
        i, q = item >> 2, item & 3
        if i == n and q in (_EMPTY, _ASSISTANT):  # the goal
            return d.cost, d.audit()
        done.add(item)
        after = _NEXT[q]
        deduced = [(i << 2 | after, INSERT_COST, INSERT)]
        if i < n:
            deduced.append((i + 1 << 2 | q, DELETE_COST, DELETE))
            if found[i] in (SOUND, TRUNCATED):
                more = TRUNCATED_COST * (found[i] == TRUNCATED)
                if states[i] == after or (q == _EMPTY and states[i] == _SYSTEM):
                    deduced.append((i + 1 << 2 | states[i], more, KEEP))
                deduced.append((i + 1 << 2 | after, REROLE_COST + more, REROLE))
        for to, cost, letter in deduced:
            if to not in done:
                made = Derivation(d, d.cost + cost, letter)
                if to not in best or made < best[to]:
                    best[to] = made
                    heapq.heappush(agenda, (made, to))


def repaired(rows: list[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The (role, text) that the audit's edits leave: the letters and the rows tell all roles."""
    q, left = _EMPTY, iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == INSERT else next(left)
        if letter == DELETE:
            continue
        if letter == KEEP:
            q = _INITIAL[role[:1]]
        else:
            q = _NEXT[q]
            role = _NAMES[q]
        yield role, text


def _summary(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    found = faults(rows)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = lightest([r for r, _ in rows], found)
    digest, between = hashlib.sha256(), ""
    for role, text in repaired(rows, audit):
        digest.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
        between = "\n"
    return gaps, found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), illegal, cost, audit, digest.hexdigest()


_FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_KINDS = [pa.int64()] * 6 + [pa.string()] * 2


def repair_conversations(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, fault counts, cost, audit and repaired_sha256 of each conversation of rows(conv_id, turn, role, text).

    Turns stand in order of turn, nulls first, ties in order of role and text. Null roles and texts count as one space,
    which is no legal role and a blank text. A role counts by its first character; an empty one is illegal. Equal rows
    are turns of their own, all but the first of them duplicates. Rows with a null conv_id are one conversation. copies
    tells how often a row counts (once by default); conversations whose rows all count 0 times are returned as empty.
    An empty table gives an empty result; other columns are ignored, whatever their names. A conversation is one output
    text, so that its texts have to fit in a task's memory. The session hands rows to Python in small batches from then on.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = rows.schema["conv_id"].dataType.simpleString()
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role"), one("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    in_order = plain.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        out: list[tuple] = []
        turns: list[int | None] = []
        held: list[tuple[str, str]] = []
        now, any_row, id_type = None, False, None

        def batch_of() -> pa.RecordBatch:
            made = [pa.array(ids, id_type), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True))]
            ids.clear()
            out.clear()
            return pa.RecordBatch.from_arrays(made, ["conv_id", *(f.split()[0] for f in _FIELDS.split(", "))])

        def close() -> None:
            ids.append(now)
            out.append(_summary(turns, held))
            turns.clear()
            held.clear()

        for batch in batches:
            id_type = batch.column(0).type
            for conv, turn, role, text, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if any_row and conv != now:
                    close()
                    if len(out) >= OUT_ROWS:
                        yield batch_of()
                now, any_row = conv, True
                turns.extend([turn] * count)
                held.extend([(role, text)] * count)
        if any_row:
            close()
            yield batch_of()

    return in_order.mapInArrow(summaries, f"conv_id {kind}, {_FIELDS}")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with role, text and copies as the damage leaves them; nulls are one space, also in what is hashed."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), F.col("copies"))


def sql_crc32(text: str) -> str:
    """The CRC-32 of an ASCII string, in SQL: eight shifts for each character."""
    step = "list_reduce([xor(crc, ascii(ch)::UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    chars = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {chars}), lambda crc, ch: {step.replace('ascii(ch)::UBIGINT', 'ch')}), 4294967295::UBIGINT)"


_BARE = r"regexp_extract(text, '^(?s)(.*[^\x20\x09-\x0D])', 1)"
ORACLE = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {sql_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
dm AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
              CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
       FROM k, (VALUES (0), (1)) AS two(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
nr AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS r FROM dm WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n)),
fl AS (SELECT *, CASE WHEN {_BARE} = '' THEN 1
                      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                      WHEN right({_BARE}, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
              lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS odd FROM nr),
c AS (SELECT conv_id, coalesce(max(i), 0) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
             count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (odd) AS illegal
      FROM (SELECT DISTINCT conv_id FROM k) LEFT JOIN fl USING (conv_id) GROUP BY conv_id),
nx(q, p, name) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
ins(q, p, cost, audit, made) AS (SELECT q, q, 0, '', [] FROM nx UNION ALL SELECT q, p, 2, 'I', [name || ':'] FROM nx
        UNION ALL SELECT a.q, b.p, 4, 'II', [a.name || ':', b.name || ':'] FROM nx a JOIN nx b ON a.p = b.q),
ed AS (SELECT conv_id, i, q, CASE WHEN op = 'D' THEN q WHEN op = 'R' THEN p ELSE r END AS p, op,
              CASE op WHEN 'D' THEN 3 WHEN 'R' THEN 2 + (fault = 3)::INT ELSE (fault = 3)::INT END AS cost,
              CASE op WHEN 'D' THEN [] WHEN 'R' THEN [name || ':' || text] ELSE [role || ':' || text] END AS made
       FROM fl, nx, (VALUES ('K'), ('R'), ('D')) AS ops(op) WHERE op = 'D' OR fault IN (0, 3) AND (op = 'R' OR r = p OR q = '' AND r = 's')),
dp AS (SELECT conv_id, 0 AS i, '' AS q, row(0, '') AS v, []::VARCHAR[] AS made FROM c
       UNION ALL
       SELECT dp.conv_id, dp.i + 1, ed.p, min(row(v[1] + ins.cost + ed.cost, v[2] || ins.audit || ed.op)),
              arg_min(dp.made || ins.made || ed.made, row(v[1] + ins.cost + ed.cost, v[2] || ins.audit || ed.op))
       FROM dp JOIN ins ON ins.q = dp.q JOIN ed ON ed.conv_id IS NOT DISTINCT FROM dp.conv_id AND ed.i = dp.i + 1 AND ed.q = ins.p
       GROUP BY dp.conv_id, dp.i, ed.p),
best AS (SELECT conv_id, i, min(row(v[1] + ins.cost, v[2] || ins.audit)) AS v, arg_min(dp.made || ins.made, row(v[1] + ins.cost, v[2] || ins.audit)) AS made
         FROM dp JOIN ins USING (q) WHERE p IN ('', 'a') GROUP BY conv_id, i)
SELECT c.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal,
       v[1]::BIGINT AS cost, v[2] AS audit, sha256(array_to_string(made, chr(10))) AS repaired_sha256
FROM c JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id AND c.n = best.i"""
}
QUERIES = {"op11_conversation_repair": op11_conversation_repair}
