"""Repair of conversations: the cheapest edits that give roles system? (user assistant)+.

A conversation becomes a string of symbols, one a row: the initial of its role and what is wrong
with it. Edits are edges of a DAG whose nodes are a place in that string and what came before it
(nothing, system, user, assistant): keep, give another role, delete, insert. A path's weight is one
integer: its cost in the high digits, below them one digit of fixed place for each letter of its
audit, and zeros where the audit has ended. The least integer is then the cheapest path, and of
equally cheap ones that with the least audit; plain min() decides everything. The DP runs from the
last row to the first: what is known of a node is the best audit from there on, and an edge puts its
letter before it, which moves all digits by one place. (From first to last, two audits of
different lengths at a node could not be told apart for good: K before KI, but KR after KIR.)

Texts don't go through the DP. The first pass shuffles only marks of rows by conversation, the
second one texts, with the audit of each conversation ahead of its rows. Both read their rows as
a sorted stream: of a conversation of any length, a task holds a byte a row and the integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Costs of edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of the audit and their digits, in the order of the letters.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
_BITS = 3
#: What came before: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_WANTED = ["u", "u", "a", "u"]
_ROLES = {"u": "user", "a": "assistant"}
_ENDS = (START, ASSISTANT)
#: A row's symbol is 3 * (place of its initial here; 3 for others) + its fault.
_INITIALS = "sua"
FINE, CUT, GONE = range(3)
SPACES = " \t\n\x0b\x0c\r"


def _edges() -> list[list[list[tuple[int, int, int]]]]:
    """By symbol and state: (state after, cost, digit) of the edits of a row."""
    table = []
    for symbol in range(12):
        kind, fault = divmod(symbol, 3)
        initial, more = (_INITIALS + "-")[kind], TRUNCATED if fault == CUT else 0
        states = []
        for q in range(4):
            edits = [(q, DELETE, DIGITS["D"])]
            if fault != GONE:
                edits.append((_NEXT[q, _WANTED[q]], REROLE + more, DIGITS["R"]))
                if (q, initial) in _NEXT:
                    edits.append((_NEXT[q, initial], KEEP + more, DIGITS["K"]))
            states.append(edits)
        table.append(states)
    return table


_EDGES = _edges()
_INSERTS = [_NEXT[q, _WANTED[q]] for q in range(4)]


def cheapest_edits(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of one conversation."""
    return _short(symbols) if len(symbols) <= 64 else _solve(symbols)


@lru_cache(maxsize=4096)
def _short(symbols: bytes) -> tuple[int, str]:
    return _solve(symbols)


def _solve(symbols: bytes) -> tuple[int, str]:
    # all deletions and a pair of insertions cost 4 n + 6 at most, so no best path has more insertions than a third of that
    width = _BITS * (len(symbols) + (4 * len(symbols) + 6) // INSERT + 2)
    low, top = (1 << width) - 1, width - _BITS
    never = 1 << (width + 64)

    def before(cost: int, digit: int, weight: int) -> int:
        """The weight of a path with one more edge ahead of it."""
        return ((weight >> width) + cost << width) + (digit << top) + ((weight & low) >> _BITS)

    def with_inserts(plain: list[int]) -> list[int]:
        best = plain
        for _ in range(2):  # a third one would come back to where the first one led
            best = [min(plain[q], before(INSERT, DIGITS["I"], best[_INSERTS[q]])) for q in range(4)]
        return best

    best = with_inserts([0 if q in _ENDS else never for q in range(4)])
    for symbol in reversed(symbols):
        best = with_inserts([min(before(cost, digit, best[after]) for after, cost, digit in edits) for edits in _EDGES[symbol]])
    weight = best[START]
    digits, letters = weight & low, {d: c for c, d in DIGITS.items()}
    octal = f"{digits:o}".zfill(width // _BITS) if digits else ""
    return weight >> width, "".join(letters[int(d)] for d in octal.rstrip("0"))


# --- streams of sorted rows


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def _marks(turns: DataFrame) -> DataFrame:
    """What the first pass needs of a row: nulls of role and text count as one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    last = F.substring(_trimmed(text), -1, 1)
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), text.alias("text"),
    )


#: Ascending, so nulls come first.
_ORDER = ["conv_id", "kind", "turn", "role", "digest"]
_PLAN = pa.schema([(c, pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
_PLAN_TYPE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is counted while the rows of one conversation pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols = conv_id, bytearray()
        self.turns, self.least, self.most, self.blank, self.duplicate, self.cut, self.illegal = 0, None, None, 0, 0, 0, 0
        self.before: tuple | None = None

    def add(self, turn: int | None, role: str, digest: bytes, blank: bool, again: bool, cut: bool) -> None:
        row = (turn, role, digest)
        if turn is not None and (self.before is None or self.before[0] != turn):
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        again = again or row == self.before
        if self.before is not None and self.before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = row
        fault = FINE
        if blank:
            self.blank, fault = self.blank + 1, GONE
        elif again:
            self.duplicate, fault = self.duplicate + 1, GONE
        elif cut:
            self.cut, fault = self.cut + 1, CUT
        self.symbols.append(3 * (_INITIALS.find(role[0]) % 4 if role else 3) + fault)

    def plan(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, self.blank, self.duplicate, self.cut, self.illegal, *cheapest_edits(bytes(self.symbols)))


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    done: list[tuple] = []
    size = 0
    for batch in batches:
        for conv_id, kind, turn, role, digest, blank, again, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.plan())
                    size += len(done[-1][-1])
                now = _Conversation(conv_id)
            if kind:
                now.add(turn, role, digest, blank, again, cut)
            if len(done) >= 10_000 or size >= 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _PLAN.types, strict=True)], schema=_PLAN)
                done, size = [], 0
    if now is not None:
        done.append(now.plan())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _PLAN.types, strict=True)], schema=_PLAN)


def repair_plans(turns: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    turns: conv_id, turn, role, text; a null conv_id is a conversation. Rows go by turn, nulls first;
    ties by role, then by the text's digest. Rows alike in turn, role and text repeat one another.
    A null role or text counts as one space; an empty role has no initial and isn't kept. others: conversations (conv_id) that are reported even
    if turns has no rows of them: with zeros and an empty audit. Other columns are ignored.
    """
    rows = _marks(turns).drop("text").withColumn("kind", F.lit(1))
    if others is not None:
        empty = others.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(0).alias("kind")).distinct()
        rows = rows.unionByName(empty, allowMissingColumns=True)
    # one shuffle: the rows of a text within a conversation are together where the conversation is
    first = F.min(F.coalesce("turn", F.lit(-(1 << 63)))).over(Window.partitionBy("conv_id", "kind", "role", "digest"))
    rows = rows.repartition("conv_id").withColumn("again", F.coalesce("turn", F.lit(-(1 << 63))) > first)
    rows = rows.sortWithinPartitions(*_ORDER).select("conv_id", "kind", "turn", "role", "digest", "blank", "again", "cut")
    return rows.mapInArrow(_plans, _PLAN_TYPE)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(plan, None) for each conversation, then (plan, (role, text)) for each row of its repaired form."""
    plan: tuple | None = None
    at, state = 0, START

    def insertions() -> Iterator[tuple]:
        nonlocal at, state
        while plan is not None and plan[-1][at : at + 1] == "I":
            role = _WANTED[state]
            at, state = at + 1, _NEXT[state, role]
            yield plan, (_ROLES[role], "")

    for batch in batches:
        for conv_id, kind, role, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                yield from insertions()  # those at the end of the conversation before
                plan, at, state = (conv_id, *rest), 0, START
                yield plan, None
                continue
            yield from insertions()
            letter = plan[-1][at]
            at += 1
            if letter != "D":
                initial = _WANTED[state] if letter == "R" else role[:1]
                state = _NEXT[state, initial]
                yield plan, (_ROLES[initial] if letter == "R" else role, text)
    yield from insertions()


def _with_texts(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of turns in order, each conversation behind its plan."""
    head = plans.select("conv_id", F.lit(0).alias("kind"), *[c for c in plans.columns if c != "conv_id"])
    rows = _marks(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    both = head.unionByName(rows, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*_ORDER)
    return both.select("conv_id", "kind", "role", "text", *[c for c in plans.columns if c != "conv_id"])


_ROWS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, out, size = 0, [], 0
    for plan, row in _edited(batches):
        if row is None:
            place = 0
            continue
        out.append((plan[0], place, *row))
        place, size = place + 1, size + len(row[1])
        if len(out) >= 10_000 or size >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROWS.types, strict=True)], schema=_ROWS)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ROWS.types, strict=True)], schema=_ROWS)


def repaired_turns(turns: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text. Conversations of which nothing is left have no rows."""
    return _with_texts(turns, repair_plans(turns) if plans is None else plans).mapInArrow(_rows, "conv_id long, place long, role string, text string")


_DIGESTED = _PLAN.append(pa.field("repaired_sha256", pa.string()))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, now, sha, empty, size = [], None, None, True, 0
    for plan, row in _edited(batches):
        if row is None:
            if now is not None:
                done.append((*now, sha.hexdigest()))
                size += len(now[-1])
            now, sha, empty = plan, hashlib.sha256(), True
        else:
            sha.update(("" if empty else "\n").encode() + f"{row[0]}:{row[1]}".encode())
            empty = False
        if len(done) >= 10_000 or size >= 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _DIGESTED.types, strict=True)], schema=_DIGESTED)
            done, size = [], 0
    if now is not None:
        done.append((*now, sha.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _DIGESTED.types, strict=True)], schema=_DIGESTED)


def repair_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """plans with repaired_sha256, of each conversation's repaired `role:text` joined by newlines (of nothing: of the empty string)."""
    return _with_texts(turns, plans).mapInArrow(_digests, _PLAN_TYPE + ", repaired_sha256 string")


def damaged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(damaged rows, conv_ids of dropped rows): faults by crc32(`conv_id:turn`) modulo 20; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    kept = rows.filter("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault")
    kept = kept.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return kept.select("conv_id", "turn", "role", "text"), rows.filter("fault = 0").select("conv_id")
