"""Conversation structure repair by a run-length dynamic program.

A conversation should read `(s?(ua)+)?` in the initials of its roles: perhaps a
system turn, then user and assistant in turn.  Each row has a symbol, its role
class and its fault; equal consecutive symbols are collapsed to runs.  A run of
n rows advances the costs-to-go by the n-th min-plus power of the symbol's
transition (cached binary powers); from the costs at the ends of blocks the
choices are then unrolled in order for the audit.

Plan, with texts shuffled once only:
1. Rows become symbols in DataFrame functions (initial, fault, two 64-bit
   hashes of role and text, number of copies); identical rows of one turn are
   summed before any shuffle.  Texts seen earlier in their conversation are
   found by partial minima of turns over (conversation, hashes).
2. Symbols are range-partitioned by conversation and turn, so a conversation of
   a third of all rows is dealt over many tasks; each task packs its rows to
   runs with their counts.  No text is in these rows.
3. The runs of a conversation meet in one task, as the one audit string must;
   they are a few bytes a row, and streamed conversation by conversation.
4. Audits and texts meet in one sorted stream that holds one batch of rows and
   one audit at a time.  SHA-256 of a conversation can only be computed in
   order, so one task streams a conversation's texts, however many they are.

Edits: K(eep) 0, R(erole to user or assistant) 1, D(elete) 2, needed for blank
and duplicate rows, I(nsert an empty user or assistant row) 5; a truncated row
that stays costs 5 more.  Of the cheapest audits the ASCII-least one is taken.

Cases: null role or text reads as one space (so such a text is blank); a null
conv_id is a conversation of its own, a null turn comes first; rows of one turn
are taken by role, then by hash of role and text; repeated rows are duplicates
of the first of them; no rows at all give zeros and an empty audit; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from privtab.llm import common as C

BLANKS = " \t\n\x0b\x0c\r"
OTHER, SYSTEM, USER, ASSISTANT = range(4)
SOUND, TRUNCATED, GOES = range(3)
#: Pairs of role classes that may stand side by side.
LEGAL = np.zeros((4, 4), bool)
LEGAL[SYSTEM, USER] = LEGAL[USER, ASSISTANT] = LEGAL[ASSISTANT, USER] = True

# ---- the dynamic program -------------------------------------------------------------------------
# States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
FAR = 1 << 60
#: State after a user or assistant turn is put out; None where the pattern forbids it.
AFTER_USER, AFTER_ASSISTANT = (2, 2, None, 2), (None, None, 3, None)
NEXT = (2, 2, 3, 2)  # the only role that can be inserted or given: user but after a user turn
#: Least cost to end well: a user and an assistant turn, an assistant turn, or nothing.
END = (0, 10, 5, 0)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: Rows of a run that are unrolled at a time.
BLOCK = 4096


def kept_state(state: int, role: int) -> int | None:
    if role == SYSTEM:
        return 1 if state == 0 else None
    return {USER: AFTER_USER, ASSISTANT: AFTER_ASSISTANT}.get(role, (None,) * 4)[state]


@lru_cache(maxsize=None)
def choices(symbol: int, state: int) -> tuple:
    """(letter, cost, next state, row consumed) of every edit, letters ascending."""
    role, fault = symbol & 3, symbol >> 2
    out = [("D", DELETE, state, True), ("I", INSERT, NEXT[state], False)]
    if fault != GOES:
        more = CUT_OFF if fault == TRUNCATED else 0
        if kept_state(state, role) is not None:
            out.append(("K", KEEP + more, kept_state(state, role), True))
        out.append(("R", REROLE + more, NEXT[state], True))
    return tuple(out)


def product(a, b):
    """Min-plus product of two 4 x 4 matrices."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def power(symbol: int, k: int):
    """Least costs of 2^k rows of one symbol from state to state, inserts included."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    consume = [[FAR] * 4 for _ in range(4)]
    insert = [[0 if i == j else FAR for j in range(4)] for i in range(4)]
    for state in range(4):
        for _, cost, after, row in choices(symbol, state):
            target = consume if row else insert
            target[state][after] = min(target[state][after], cost)
    closure = product(product(insert, insert), insert)
    return product(closure, consume)


@lru_cache(maxsize=1 << 16)
def _back(symbol: int, k: int, ahead: tuple) -> tuple[tuple, int]:
    costs = [min(row[j] + ahead[j] for j in range(4)) for row in power(symbol, k)]
    least = min(costs)
    return tuple(c - least for c in costs), least


def advance(symbol: int, length: int, ahead: tuple, base: int) -> tuple[tuple, int]:
    """Costs-to-go before a run, from those after it: relative ones and their base."""
    k = 0
    while length:
        if length & 1:
            ahead, more = _back(symbol, k, ahead)
            base += more
        length >>= 1
        k += 1
    return ahead, base


@lru_cache(maxsize=1 << 16)
def _step(symbol: int, state: int, ahead: tuple) -> tuple[str, int]:
    """The least letters over one row from ``state``, with costs-to-go ``ahead`` after it."""
    costs, base = _back(symbol, 0, ahead)
    letters = ""
    while True:
        for letter, cost, after, row in choices(symbol, state):
            if cost + (ahead[after] if row else costs[after] + base) == costs[state] + base:
                letters, state = letters + letter, after
                break
        if row:
            return letters, state


def audit(symbols: list[int], lengths: list[int]) -> tuple[int, str]:
    """(least cost, ASCII-least audit of that cost) of a conversation in runs."""
    ahead, base = END, 0
    after = []  # costs after each run; the tuples are shared, so a run takes a reference
    for symbol, length in zip(reversed(symbols), reversed(lengths)):
        after.append(ahead)
        ahead, base = advance(symbol, length, ahead, base)
    cost, state, letters = base + ahead[0], 0, []
    for symbol, length, end in zip(symbols, lengths, reversed(after)):
        while length:
            block = min(BLOCK, length)
            length -= block
            ahead, _ = advance(symbol, length, end, 0)
            row_ends = [ahead]
            for _ in range(block - 1):
                row_ends.append(_back(symbol, 0, row_ends[-1])[0])
            for ahead in reversed(row_ends):
                more, state = _step(symbol, state, ahead)
                letters.append(more)
    while state not in (0, 3):
        letters.append("I")
        state = NEXT[state]
    return cost, "".join(letters)


# ---- rows to symbols -----------------------------------------------------------------------------


def plain_rows(conversations: DataFrame, kind: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, copies), nulls of role and text as one space;
    with ``kind``, a column over ``conversations``, also that."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                                F.lit(1).cast("long").alias("copies"), *[] if kind is None else [kind.alias("kind")])


def damaged(conversations: DataFrame, kind: Column) -> DataFrame:
    """Faults put in for an audit: ``kind`` 0 drops a row (no copies), 1 empties
    its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes it a user's."""
    rows = plain_rows(conversations, kind)
    text = (F.when(F.col("kind").isin(0, 1), F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    role = F.when(F.col("kind") == 0, F.lit("")).when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")
    turn = F.when(F.col("kind") != 0, F.col("turn"))
    return rows.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


ORDER = ["conv_id", "turn", "role", "h1", "h2"]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def symbols_of(rows: DataFrame) -> DataFrame:
    """One row for each distinct (conv_id, turn, role, text): role, hashes,
    copies, role class, whether blank, truncated, seen earlier in its conversation."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    seen = _hashed(rows).select(*ORDER, "copies", role.cast("int").alias("class"), (bare == "").alias("blank"),
                                (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    each = seen.groupBy(*ORDER, "class", "blank", "cut").agg(F.sum("copies").alias("copies"))
    # nulls first: a struct with its flag ahead orders as the turns do
    again = (each.filter("NOT blank AND copies > 0").groupBy("conv_id", "h1", "h2")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"),
                  F.count(F.lit(1)).alias("turns")).filter("turns > 1")
             .select(F.col("conv_id").alias("c"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))
    earlier = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return each.join(again, same, "left").select(*ORDER, "copies", "class", "blank", "cut",
                                                 (~F.col("blank") & earlier).alias("earlier"))


# ---- symbols to runs, a task packs what it has of a conversation ------------------------------------

_STATS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
_PACKED = f"part int, piece int, first int, last int, {_STATS}, symbols binary, lengths binary"
#: Runs of one piece.
PIECE = 1 << 16


class _Piece:
    """What a task has of one conversation so far."""

    def __init__(self, conv):
        self.conv, self.symbols, self.lengths = conv, [], []
        self.first = self.last = -1
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn, copies, role, blank, cut, earlier):
        if not copies:
            return
        if self.first < 0:
            self.first = role
        else:
            self.illegal += not LEGAL[self.last, role]
        self.illegal += copies - 1  # no role may follow itself
        self.last = role
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if blank:
            self.blank += copies
            self.put(GOES << 2 | role, copies)
        elif earlier:
            self.duplicate += copies
            self.put(GOES << 2 | role, copies)
        else:
            self.truncated += cut
            self.put((TRUNCATED if cut else SOUND) << 2 | role, 1)
            if copies > 1:
                self.duplicate += copies - 1
                self.put(GOES << 2 | role, copies - 1)

    def put(self, symbol, length):
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += length
        else:
            self.symbols.append(symbol)
            self.lengths.append(length)

    def row(self, part, piece):
        return (self.conv, part, piece, self.first, self.last, self.blank, self.duplicate, self.truncated, self.illegal,
                self.turns, self.low, self.high, bytes(self.symbols), np.asarray(self.lengths, np.int64).tobytes())


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _pack(schema: pa.Schema):
    def run(batches):
        part = TaskContext.get().partitionId()
        piece, number, out = None, 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist()
                       for c in ("conv_id", "turn", "copies", "class", "blank", "cut", "earlier")]
            for conv, *rest in zip(*columns):
                if piece is None or piece.conv != conv or len(piece.symbols) >= PIECE:
                    if piece is not None:
                        out.append(piece.row(part, number))
                        number += 1
                    piece = _Piece(conv)
                piece.add(*rest)
                if len(out) >= 4096 or len(out) and len(piece.symbols) == PIECE:
                    yield _batch(out, schema)
                    out = []
        if piece is not None:
            out.append(piece.row(part, number))
        if out:
            yield _batch(out, schema)

    return run


_REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _judge(schema: pa.Schema):
    """Pieces in order, a conversation after another, to its counts and audit."""

    def closed(conv, pieces):
        blank, duplicate, truncated, illegal = (sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated",
                                                                                      "illegal"))
        held = [p for p in pieces if p["first"] >= 0]
        illegal += sum(not LEGAL[a["last"], b["first"]] for a, b in zip(held, held[1:]))
        timed = [p for p in held if p["turns"]]
        turns = sum(p["turns"] for p in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
        symbols = b"".join(p["symbols"] for p in pieces)
        lengths = np.concatenate([np.frombuffer(p["lengths"], np.int64) for p in pieces]).tolist()
        return (conv, gaps, blank, duplicate, truncated, illegal, *audit(list(symbols), lengths))

    def run(batches):
        pieces, out, size = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if pieces and pieces[0]["conv_id"] != row["conv_id"]:
                    out.append(closed(pieces[0]["conv_id"], pieces))
                    size += 64 + len(out[-1][-1])
                    pieces = []
                    if size > 4 << 20:
                        yield _batch(out, schema)
                        out, size = [], 0
                pieces.append(row)
        if pieces:
            out.append(closed(pieces[0]["conv_id"], pieces))
        if out:
            yield _batch(out, schema)

    return run


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): gaps,
    blank, duplicate, truncated, illegal, cost, audit."""
    conv = C.row_type(rows, "conv_id")
    packed = StructType(conv.fields + StructType.fromDDL(_PACKED).fields)
    report = StructType(conv.fields + StructType.fromDDL(_REPORT).fields)
    ordered = symbols_of(rows).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    pieces = ordered.mapInArrow(_pack(to_arrow_schema(packed)), packed)
    met = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return met.mapInArrow(_judge(to_arrow_schema(report)), report)


# ---- audits and texts ----------------------------------------------------------------------------


def _edits(letters: str, rows):
    """(edit, role, text) of every line of the repaired conversation and of what was deleted."""
    at, last = 0, ""

    def given():
        return "assistant" if last == "u" else "user"

    for role, text in rows:
        while letters[at] == "I":
            new = given()
            yield "I", new, ""
            last, at = new[0], at + 1
        edit, at = letters[at], at + 1
        if edit == "R":
            role = given()
        yield edit, role, text
        if edit != "D":
            last = role[:1]
    for _ in range(at, len(letters)):
        new = given()
        yield "I", new, ""
        last = new[0]


def _follow(schema: pa.Schema, finish):
    """One sorted stream: the audit of a conversation, then its rows.  ``finish``
    turns a conversation's report and lazy edits into output rows."""
    names = [f.name for f in schema]

    def conversations(batches):
        """(report, iterator over rows); the iterator must be used up before the next."""
        def flat():
            for batch in batches:
                for piece in C.sliced([batch], 1000):
                    yield from piece.to_pylist()

        stream = flat()
        head = next(stream, None)
        while head is not None:
            report, after = head, [None]

            def rows():
                for row in stream:
                    if row["kind"] == 0:
                        after[0] = row
                        return
                    for _ in range(row["copies"]):
                        yield row["role"], row["text"]

            yield report, rows()
            head = after[0]

    def run(batches):
        out, size = [], 0
        for report, rows in conversations(batches):
            for row in finish(report, _edits(report["audit"], rows)):
                out.append([row[n] for n in names])
                size += 64 + sum(len(v) for v in out[-1] if isinstance(v, str))
                if size > 4 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return run


def _digest(report, edits):
    digest, started = hashlib.sha256(), False
    for edit, role, text in edits:
        if edit != "D":
            digest.update(f"\n{role}:{text}".encode() if started else f"{role}:{text}".encode())
            started = True
    yield report | {"repaired_sha256": digest.hexdigest()}


def _lines(report, edits):
    for place, (edit, role, text) in enumerate(edits):
        yield {"conv_id": report["conv_id"], "place": place, "edit": edit, "role": role, "text": text}


def _met(rows: DataFrame) -> DataFrame:
    reports = audits(rows).withColumn("kind", F.lit(0))
    texts = _hashed(rows.filter("copies > 0")).withColumn("kind", F.lit(1))
    both = reports.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256 of its repaired `role:text` lines.
    ``rows`` are those of :func:`plain_rows` or :func:`damaged`."""
    kind = StructType(C.row_type(rows, "conv_id").fields
                      + StructType.fromDDL(_REPORT + ", repaired_sha256 string").fields)
    return _met(rows).mapInArrow(_follow(to_arrow_schema(kind), _digest), kind)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place, edit, role, text;
    deleted rows are among them with edit D."""
    kind = StructType(C.row_type(rows, "conv_id").fields
                      + StructType.fromDDL("place long, edit string, role string, text string").fields)
    return _met(rows).mapInArrow(_follow(to_arrow_schema(kind), _lines), kind)
