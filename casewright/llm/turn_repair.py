"""Repair of conversation structure by a dynamic programme over the retained turns.

A conversation's turns are read in order.  Each is kept, given another role or deleted, and empty turns may be inserted,
so that the initials of the roles read ``(s?(ua)+)?`` at the least cost.  The programme runs over retained turns: what
a turn costs as the next one retained is the best price among earlier ones of each role, plus the deletions between,
which are a difference of two prefix sums, plus the insertions that the pair of roles needs.  For every role only the
running minimum of price minus prefix sum is carried (``_Plan.best``), so a turn takes constant time.

Of equally cheap repairs the one whose audit (the initials of its edits) is least in ASCII wins.  Audits of two roles
after the same turns are never prefixes of each other, since none ends in an insertion; so their order is settled once
and is carried as a rank, without the strings.  Four bytes of back pointers a turn are all that a conversation holds.

Conversations are streams, as in ``chat_format``: sorted within partitions and read one after another, so that a
conversation of any length takes one task but bounded memory.  Its order is a chain (so is a digest over it), which
no split could shorten; faults, on which no order depends, are found beforehand by Spark on all tasks.  A first
stream plans from initials and faults alone, without texts; a second one applies the audits to the texts.

Edge cases: null roles and texts are one space, which is no role and a blank text; null turns come first; turns with
equal numbers are ordered by role, then text, and repeated rows are all read; a null conversation id is one
conversation; conversations without turns left keep their row, with an empty audit; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewright.llm._common import table

_SPACE = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
_START, _S, _U, _A = range(4)
#: Roles that stand between two retained ones: what has to be inserted.
_BETWEEN = {(_START, _S): "", (_START, _U): "", (_START, _A): "u", (_S, _U): "", (_S, _A): "u", (_U, _U): "a", (_U, _A): "", (_A, _U): "", (_A, _A): "u"}
_AFTER = {_START: "", _S: "ua", _U: "a", _A: ""}
_OF = {"s": _S, "u": _U, "a": _A}
_NAMES = {"u": "user", "a": "assistant"}
_LEGAL = frozenset(("su", "ua", "au"))
_NEVER = 1 << 60

PLAN_SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class _Plan:
    """The programme over one conversation."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.counts = conv_id, [0, 0, 0, 0]
        self.illegal, self.last, self.turns, self.low, self.high, self.seen = 0, None, 0, None, None, False
        self.deleted = 0  # prefix sum of the deletions
        self.best, self.rank = [0, _NEVER, _NEVER, _NEVER], [0, 1, 2, 3]
        self.back = bytearray()

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.counts[fault] += 1
        self.illegal += self.seen and self.last + initial not in _LEGAL
        self.seen, self.last = True, initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        now, self.deleted = self.deleted, self.deleted + DELETE
        if fault in (BLANK, DUPLICATE):
            self.back += b"\0\0\0\0"
            return
        best, rank, own = self.best, self.rank, _OF.get(initial)
        found = [(v, rank[q], "D", 0) for q, v in enumerate(best)]
        for (q, role), between in _BETWEEN.items():
            if best[q] >= _NEVER or role == _S != own:
                continue
            kept = role == own
            price = best[q] + now + INSERT * len(between) + (0 if kept else REROLE) + (CUT_SHORT if fault == TRUNCATED else 0) - self.deleted
            found[role] = min(found[role], (price, rank[q], "I" * len(between) + ("K" if kept else "R"), 1 + q * 2 + (not kept)))
        self.best = [x[0] for x in found]
        for place, q in enumerate(sorted(range(4), key=lambda q: found[q][1:3])):
            self.rank[q] = place
        self.back += bytes(x[3] for x in found)

    def finish(self) -> tuple:
        state = min((q for q in range(4)), key=lambda q: (self.best[q] + INSERT * len(_AFTER[q]), self.rank[q]))
        cost = self.best[state] + self.deleted + INSERT * len(_AFTER[state])
        parts = ["I" * len(_AFTER[state])]
        for at in range(len(self.back) - 4, -1, -4):
            if code := self.back[at + state]:
                before, rerolled = divmod(code - 1, 2)
                parts.append("R" if rerolled else "K")
                parts.append("I" * len(_BETWEEN[before, state]))
                state = before
            else:
                parts.append("D")
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts[1:], self.illegal, cost, "".join(reversed(parts))


def damage(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with one fault in five rows or so, by the crc32 of ``conv_id:turn`` modulo 20.

    A dropped row stays as one with ``alive`` false, which only keeps its conversation's id.
    """
    filled = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = filled.withColumn("kind_", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind_") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("kind_") != 0, F.when(F.col("kind_") == 3, 2).otherwise(1)))
    return kind.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("alive"))


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text[, alive])`` with ``initial`` and the first ``fault`` of each, and ``again``,
    which puts the first of equal rows first."""
    if "alive" not in turns.columns:
        turns = turns.withColumn("alive", F.lit(True))
    filled = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), "alive")
    again = F.row_number().over(Window.partitionBy("conv_id", "alive", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    end = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    fault = F.when(end == "", BLANK).when(F.col("again"), DUPLICATE).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return filled.withColumn("again", again).withColumns({"fault": fault, "initial": F.substring("role", 1, 1)})


_ORDER = ("turn", "role", "text", "again")


def plan_repairs(turns: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, cost and audit of the cheapest repair."""

    def run(batches):
        plan, rows = None, []
        for batch in batches:
            for conv, turn, initial, fault, alive in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault", "alive"))):
                if plan is None or plan.conv_id != conv:
                    if plan:
                        rows.append(plan.finish())
                    plan = _Plan(conv)
                if alive:
                    plan.add(turn, initial, fault)
            if len(rows) >= 1000:
                yield _plans(rows)
                rows = []
        if plan:
            rows.append(plan.finish())
        if rows:
            yield _plans(rows)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return dealt.select("conv_id", "turn", "initial", "fault", "alive").mapInArrow(run, PLAN_SCHEMA)


def _plans(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PLAN_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for n, c in zip(names, zip(*rows))], names)


class _Applied:
    """Follows an audit along the turns of one conversation."""

    def __init__(self, conv_id, audit: str) -> None:
        self.conv_id, self.audit, self.at, self.place, self.last = conv_id, audit, 0, 0, ""

    def _row(self, role: str, text: str):
        self.place, self.last = self.place + 1, role[:1]
        return self.conv_id, self.place - 1, role, text

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._row(_NAMES["a" if self.last == "u" else "u"], "")

    def turn(self, role: str, text: str):
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            yield self._row(role, text)
        elif edit == "R":
            yield self._row(_NAMES["a" if self.last == "u" else "u"], text)

    def rest(self):
        yield from self._inserted()


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations, ``conv_id, place, role, text``, in order within a partition."""

    def run(batches):
        applied, rows, size = None, [], 0
        for batch in batches:
            for conv, audit, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                if audit is not None:
                    rows += applied.rest() if applied else ()
                    applied = _Applied(conv, audit)
                else:
                    rows += applied.turn(role, text)
                    size += len(text)
                if len(rows) >= 1000 or size > 1 << 22:
                    yield _turns(rows)
                    rows, size = [], 0
        rows += applied.rest() if applied else ()
        if rows:
            yield _turns(rows)

    audits = plans.select("conv_id", "audit")
    both = turns.where("alive").select("conv_id", *_ORDER).unionByName(audits, allowMissingColumns=True)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").desc_nulls_last(), *_ORDER)
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(run, "conv_id bigint, place bigint, role string, text string")


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "place", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines; the rows must come in order within a partition."""

    def run(batches):
        state, rows = None, []
        for batch in batches:
            for conv, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    rows += [(state[0], state[1].hexdigest())] if state else []
                    state = conv, hashlib.sha256()
                state[1].update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if len(rows) >= 1000:
                yield _digests(rows)
                rows = []
        rows += [(state[0], state[1].hexdigest())] if state else []
        if rows:
            yield _digests(rows)

    return repaired.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string()))], ["conv_id", "repaired_sha256"])


def summary(turns: DataFrame) -> DataFrame:
    """The plan of every conversation with the digest of its repaired turns."""
    judged = with_faults(turns)
    plans = plan_repairs(judged)
    done = digests(repaired_turns(judged, plans)).withColumnRenamed("conv_id", "conv_")
    joined = plans.join(done, plans.conv_id.eqNullSafe(done.conv_), "left").drop("conv_")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def query(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return summary(damage(turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")))


def _oracle() -> str:
    """The same programme in SQL: one state of each role per conversation, a recursive step per turn."""
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    state = "struct_pack(v := {v}, a := {a}, t := {t})".format
    stay = lambda q: state(v=f"p.{q}.v + 3", a=f"p.{q}.a || 'D'", t=f"p.{q}.t")

    def step(q: str, role: str, between: str) -> str:
        own = f"CASE WHEN r.i = '{role}' THEN {{}} ELSE {{}} END"
        inserted = f" || chr(10) || '{_NAMES[between]}:'" if between else ""
        name = own.format("r.role", f"'{_NAMES.get(role, '')}'")
        return state(
            v=f"p.{q}.v + {2 * len(between)} + r.tr + " + own.format("0", "2"),
            a=f"p.{q}.a || '{'I' * len(between)}' || " + own.format("'K'", "'R'"),
            t=f"p.{q}.t{inserted} || chr(10) || {name} || ':' || r.text",
        )

    first = "CASE WHEN r.i = 's' THEN " + step("o", "s", "") + " ELSE " + stay("s") + " END"
    moves = {
        "o": [stay("o")],
        "s": [stay("s"), first],
        "u": [stay("u"), step("o", "u", ""), step("s", "u", ""), step("a", "u", ""), step("u", "u", "a")],
        "a": [stay("a"), step("o", "a", "u"), step("s", "a", "u"), step("u", "a", ""), step("a", "a", "u")],
    }
    new = ",\n    ".join(f"CASE WHEN r.fault IN (1, 2) THEN {stay(q)} ELSE list_min([{', '.join(m)}]) END AS {q}" for q, m in moves.items())
    start = lambda v: state(v=v, a="''", t="''")
    end = ", ".join(state(v=f"{q}.v + {2 * len(x)}", a=f"{q}.a || '{'I' * len(x)}'", t=f"{q}.t" + "".join(f" || chr(10) || '{_NAMES[c]}:'" for c in x)) for q, x in (("o", ""), ("s", "ua"), ("u", "a"), ("a", "")))
    return f"""
WITH RECURSIVE f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, length(k)), lambda i: CAST(ascii(k[i]) AS BIGINT))),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind FROM f),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, generate_series(1, 2) g(n) WHERE n <= CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
e AS (
  SELECT *, right(rtrim(text, {ws}), 1) AS z, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM d),
g AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS i, CASE WHEN z = '' THEN 1 WHEN nth > 1 THEN 2 WHEN z NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN z NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS tr,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS n FROM e),
p AS (
  SELECT conv_id, 0::BIGINT AS n, {start("0")} AS o, {start("1000000000")} AS s, {start("1000000000")} AS u, {start("1000000000")} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT p.conv_id, r.n,
    {new}
  FROM p JOIN g r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1),
b AS (
  SELECT conv_id, n, list_min([{end}]) AS x FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
h AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS prev FROM g),
k AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (prev || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM h GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(x.v AS BIGINT) AS cost, x.a AS audit, sha256(substr(x.t, 2)) AS repaired_sha256
FROM b LEFT JOIN k ON b.conv_id IS NOT DISTINCT FROM k.conv_id
"""


ORACLE = _oracle()
