"""Repair of conversation structure: the cheapest edits to a legal order of roles.

Every row of a conversation is one symbol of its role and fault.  Sequences of
symbols repeat a lot, so a task compresses those of its conversations by
Re-Pair, which names every pair that occurs twice.  A symbol is a min-plus
matrix of transfers between the states of the legal order, each entry a cost
and a rope of edits; a name's matrix is the product of its pair's, evaluated
once, from the bottom up, for all conversations.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from tidelog.llm.common import staged

BLANK = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = (".", "!", "?")
ROLES = ("user", "assistant")
# Edits and their costs.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
DAMAGES = 20

# Symbols compressed together, and rows a task gives on together.
SYMBOLS_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 4096
# Ropes shorter than this are plain text.
LEAF = 256

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# ---- ropes ------------------------------------------------------------------

Rope = str | tuple  # plain text, or (size, left, right)


def size_of(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def joined(left: Rope, right: Rope) -> Rope:
    size = size_of(left) + size_of(right)
    if isinstance(left, str) and isinstance(right, str) and size <= LEAF:
        return left + right
    return left if not right else right if not left else (size, left, right)


def pieces(rope: Rope) -> Iterator[str]:
    rest = [rope]
    while rest:
        part = rest.pop()
        if isinstance(part, str):
            yield part
        else:
            rest += (part[2], part[1])


def precedes(a: Rope, b: Rope) -> bool:
    """Whether the text of ``a`` comes before that of ``b``.

    Parts that both share at the same place are passed over.
    """
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, tuple) and (not isinstance(y, tuple) or x[0] >= y[0]):
            left += (x[2], x[1])
            right.append(y)
        elif isinstance(y, tuple):
            right += (y[2], y[1])
            left.append(x)
        else:
            both = min(len(x), len(y))
            if x[:both] != y[:both]:
                return x < y
            if len(x) > both:
                left.append(x[both:])
            if len(y) > both:
                right.append(y[both:])
    return not left and any(size_of(rest) for rest in right)


# ---- transfers between the states of the legal order ------------------------

# Before anything, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
LEGAL_END = (START, ASSISTANT)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}

# Role initials, in capitals for truncated rows; OTHER for any other initial,
# GONE for rows that must be deleted.
OTHER, GONE = "o", "x"
SYMBOLS = ("s", "u", "a", OTHER, "S", "U", "A", "O", GONE)

Matrix = list[dict[int, tuple[int, Rope]]]  # per state, the states reached


def _add(row: dict[int, tuple[int, Rope]], to: int, cost: int, edits: Rope) -> None:
    """Keep the cheaper way, among equals the one whose edits come first.

    Ways over the same rows at the same cost are never beginnings of each
    other, since an edit more would cost more; so what follows or precedes them
    both does not change which comes first.
    """
    old = row.get(to)
    if old is None or cost < old[0] or (cost == old[0] and precedes(edits, old[1])):
        row[to] = (cost, edits)


def product(first: Matrix, second: Matrix) -> Matrix:
    made: Matrix = []
    for ways in first:
        row: dict[int, tuple[int, Rope]] = {}
        for middle, (cost, edits) in ways.items():
            for to, (more, further) in second[middle].items():
                old = row.get(to)
                if old is None or cost + more <= old[0]:
                    _add(row, to, cost + more, joined(edits, further))
        made.append(row)
    return made


def insertions() -> Matrix:
    """Rows put in between: none, one, or a pair of them."""
    made: Matrix = []
    for state in STATES:
        row: dict[int, tuple[int, Rope]] = {state: (0, "")}
        at, cost, edits = state, 0, ""
        for _ in ROLES:
            at = ASSISTANT if at == USER else USER
            cost, edits = cost + INSERT_COST, edits + INSERT
            _add(row, at, cost, edits)
        made.append(row)
    return made


def row_step(symbol: str) -> Matrix:
    """The edits of one row, after any insertions before it."""
    extra = TRUNCATED_COST if symbol.isupper() else 0
    made: Matrix = []
    for state in STATES:
        row: dict[int, tuple[int, Rope]] = {state: (DELETE_COST, DELETE)}
        if symbol != GONE:
            kept = _AFTER.get(symbol.lower(), {}).get(state)
            if kept is not None:
                _add(row, kept, extra, KEEP)
            _add(row, ASSISTANT if state == USER else USER, REROLE_COST + extra, REROLE)
        made.append(row)
    return product(insertions(), made)


# ---- the grammar ------------------------------------------------------------


class Grammar:
    """Names for pairs of symbols, and the transfers of every symbol and name."""

    def __init__(self) -> None:
        self.names: dict[tuple[int, int], int] = {}
        self.transfers = [row_step(symbol) for symbol in SYMBOLS]
        self._end = insertions()

    def name(self, pair: tuple[int, int]) -> int:
        found = self.names.get(pair)
        if found is None:
            found = self.names[pair] = len(self.transfers)
            self.transfers.append(product(*(self.transfers[part] for part in pair)))
        return found

    def compressed(self, sequences: Sequence[Sequence[int]]) -> list[list[int]]:
        """Re-Pair: the most frequent pair gets a name until no pair repeats."""
        symbols = list(chain.from_iterable(sequences))
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        starts, at = [], 0
        for sequence in sequences:
            starts.append(at)
            if sequence:
                before[at], after[at + len(sequence) - 1] = -1, -1
            at += len(sequence)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, j in enumerate(after):
            if j >= 0:
                places[symbols[i], symbols[j]].add(i)
        queue = [(-len(found), pair) for pair, found in places.items() if len(found) > 1]
        heapq.heapify(queue)
        while queue:
            count, pair = heapq.heappop(queue)
            found = places[pair]
            if len(found) != -count:
                if len(found) > 1:
                    heapq.heappush(queue, (-len(found), pair))
                continue
            named, touched = self.name(pair), set()
            for i in sorted(found):
                # An earlier replacement may have taken one of the two.
                j = after[i] if i in found else -1
                if j < 0:
                    continue
                left, right = before[i], after[j]
                found.discard(i)
                if left >= 0:
                    places[symbols[left], symbols[i]].discard(left)
                if right >= 0:
                    places[symbols[j], symbols[right]].discard(j)
                    before[right] = i
                symbols[i], after[i], after[j] = named, right, -1
                if left >= 0:
                    touched.add((symbols[left], named))
                    places[symbols[left], named].add(left)
                if right >= 0:
                    touched.add((named, symbols[right]))
                    places[named, symbols[right]].add(i)
            for new in touched:
                if len(places[new]) > 1:
                    heapq.heappush(queue, (-len(places[new]), new))
        made = []
        for start, sequence in zip(starts, sequences, strict=True):
            short, at = [], start if sequence else -1
            while at >= 0:
                short.append(symbols[at])
                at = after[at]
            made.append(short)
        return made

    def repairs(self, sequences: Sequence[str]) -> list[tuple[int, str]]:
        """The least cost and the first of the cheapest edits of each sequence."""
        cut = [
            [sequence[i : i + SYMBOLS_AT_ONCE] for i in range(0, len(sequence), SYMBOLS_AT_ONCE)]
            for sequence in sequences
        ]
        distinct = list(dict.fromkeys(chain.from_iterable(cut)))
        numbers = {symbol: i for i, symbol in enumerate(SYMBOLS)}
        short = dict(
            zip(distinct, self.compressed([[numbers[s] for s in part] for part in distinct]), strict=True)
        )
        return [self._cheapest(chain.from_iterable(short[part] for part in parts)) for parts in cut]

    def _cheapest(self, names: Iterator[int]) -> tuple[int, str]:
        ways: Matrix = [{START: (0, "")}]
        for name in names:
            ways = product(ways, self.transfers[name])
        best: dict[int, tuple[int, Rope]] = {}
        for state, (cost, edits) in product(ways, self._end)[0].items():
            if state in LEGAL_END:
                _add(best, 0, cost, edits)
        cost, edits = best[0]
        return cost, "".join(pieces(edits))


# ---- rows -------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped`` with faults put in by a hash of the row's place.

    Null roles and texts become one blank, as do nulls in the hashed place.
    Dropped rows stay, marked, so that no conversation is forgotten.
    """
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat_ws(":", *place).cast("binary")) % DAMAGES
    role = F.coalesce(F.col("role"), F.lit(" "))
    text = F.coalesce(F.col("text"), F.lit(" "))
    without_ends = F.translate(text, "".join(SENTENCE_ENDS), "")
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, F.lit(ROLES[0])).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, without_ends).otherwise(text).alias("text"),
        (fault == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the form of :func:`damaged`."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    return conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.lit(False).alias("dropped")
    )


def _ordered(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a conversation together: by turn (null first), role and text's digest."""
    return rows.repartition("conv_id").sortWithinPartitions(*columns)


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows without their texts, but with what the faults depend on.

    Where a role and a text were seen first is found by counting, so that only
    repeated ones are joined.
    """
    text = F.rtrim(F.col("text"), F.lit(BLANK))
    last = F.substring(text, -1, 1)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("number"))
    light = rows.select(
        "conv_id",
        "turn",
        "role",
        "dropped",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        (text == "").alias("blank"),
        (~last.isin(*SENTENCE_ENDS)).alias("truncated"),
    )
    repeated = (
        light.where(~F.col("dropped") & ~F.col("blank"))
        .groupBy("conv_id", "role", "digest")
        .agg(F.count("*").alias("times"), F.min(turn).alias("first"))
        .where("times > 1")
        .select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], "first")
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv_id"))
        & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest"))
    )
    later = F.coalesce(F.col("first") < turn, F.lit(False))
    return light.join(repeated, same, "left").select(
        "conv_id", "turn", "role", "digest", "dropped", "blank", "truncated", later.alias("seen")
    )


class _Open:
    """A conversation while its rows are read: one character a row."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = self.before = None
        self.turns = 0
        self.initial = ""

    def read(self, turn, role: str, digest: str, blank: bool, truncated: bool, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1] if role[:1] in _AFTER else OTHER
        if self.initial and f"{self.initial}{initial}" not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        place = (turn, role, digest)
        if blank:
            self.blank += 1
            symbol = GONE
        elif seen or place == self.before:
            self.duplicate += 1
            symbol = GONE
        else:
            self.truncated += truncated
            symbol = initial.upper() if truncated else initial
        self.before = place
        self.symbols.append(symbol)

    @property
    def gaps(self) -> int:
        return self.last - self.first + 1 - self.turns if self.turns else 0


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the least cost of repair and the edits of it.

    ``rows`` are as :func:`damaged` gives them.  A conversation is read as a
    sorted stream; a task holds one character a row of it, which the edits need
    as well, and of no row the text.  Rows that share a turn follow each other
    by role and digest of the text.  A conversation without rows gives zeros.
    """
    key = rows.schema["conv_id"]
    fields = [
        key,
        *[StructField(name, LongType()) for name in COUNTS],
        StructField("audit", StringType()),
    ]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def repaired(open_ones: list[_Open], grammar: Grammar) -> pa.RecordBatch:
        found = grammar.repairs(["".join(one.symbols) for one in open_ones])
        made = [
            (c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, *repair)
            for c, repair in zip(open_ones, found, strict=True)
        ]
        columns = zip(*made, strict=True)
        return pa.record_batch(
            [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar()
        complete: list[_Open] = []
        held = 0
        current: _Open | None = None
        for batch in batches:
            for conv_id, dropped, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        complete.append(current)
                        held += 1 + len(current.symbols)
                    if held > SYMBOLS_AT_ONCE:
                        yield repaired(complete, grammar)
                        complete, held = [], 0
                        if len(grammar.names) > SYMBOLS_AT_ONCE:
                            grammar = Grammar()
                    current = _Open(conv_id)
                if not dropped:
                    current.read(*row)
        if current is not None:
            yield repaired([*complete, current], grammar)

    light = _ordered(_faulty(rows), "conv_id", "turn", "role", "digest").select(
        "conv_id", "dropped", "turn", "role", "digest", "blank", "truncated", "seen"
    )
    return light.mapInArrow(work, StructType(fields))


class _Row(NamedTuple):
    role: str
    text: bytes
    edit: str


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place, role, text, edit``.

    The edits come before the rows they belong to in one sorted stream; the
    rows of a conversation are given in order and are counted by ``place``.
    Texts are binary and pass through one at a time.
    """
    key = rows.schema["conv_id"]
    fields = [
        key,
        StructField("place", LongType()),
        StructField("role", StringType()),
        StructField("text", BinaryType()),
        StructField("edit", StringType()),
    ]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    text = F.col("text").cast("binary")
    told = audited.select(
        "conv_id",
        F.lit(0).alias("kind"),
        F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"),
        F.col("audit").cast("binary").alias("text"),
        F.lit("").alias("digest"),
    )
    stream = told.unionByName(
        rows.where(~F.col("dropped")).select(
            "conv_id", F.lit(1).alias("kind"), "turn", "role", text.alias("text"), F.sha2(text, 256).alias("digest")
        )
    )

    def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
        edits, at, user_next, place, conv_id = "", 0, True, 0, None
        for found_id, kind, role, text in chain(rows, [(None, 0, "", b"")]):
            while at < len(edits) and (kind == 0 or edits[at] == INSERT):
                # What is left when the next conversation begins are insertions.
                yield conv_id, place, ROLES[not user_next], b"", INSERT
                place, at, user_next = place + 1, at + 1, not user_next
            if kind == 0:
                edits, at, user_next, place, conv_id = text.decode(), 0, True, 0, found_id
                continue
            edit = edits[at]
            at += 1
            if edit == DELETE:
                continue
            if edit == REROLE:
                role = ROLES[not user_next]
            yield conv_id, place, role, text, edit
            place += 1
            # Only a system row, which comes first, is not answered.
            user_next = role[:1] != "u"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(
            zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in batches
        )
        made, size = [], 0
        for row in edited(rows):
            made.append(row)
            size += len(row[3])
            if len(made) == ROWS_AT_ONCE or size > 1 << 24:
                yield _batch(made, arrow)
                made, size = [], 0
        if made:
            yield _batch(made, arrow)

    return (
        _ordered(stream, "conv_id", "kind", "turn", "role", "digest")
        .select("conv_id", "kind", "role", "text")
        .mapInArrow(work, StructType(fields))
    )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its ``role:text`` lines, of rows in order.

    The rows must come as :func:`repaired` gives them, not shuffled since; the
    hash of a conversation is one chain, so one task reads all of it.
    """
    fields = [rows.schema["conv_id"], StructField("repaired_sha256", StringType())]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        current, state = None, None
        for batch in batches:
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if state is not None:
                        made.append((current, state.hexdigest()))
                    current, state = conv_id, sha256()
                else:
                    state.update(b"\n")
                state.update(role.encode() + b":" + text)
            if len(made) > ROWS_AT_ONCE:
                yield _batch(made, arrow)
                made = []
        if state is not None:
            made.append((current, state.hexdigest()))
        if made:
            yield _batch(made, arrow)

    return rows.select("conv_id", "place", "role", "text").mapInArrow(work, StructType(fields))


def repair_report(rows: DataFrame) -> DataFrame:
    """Faults, edits and the digest of every conversation of :func:`damaged` rows.

    Every ``conv_id`` has one row, null included; ids are compared as they are.
    Repeated rows are duplicates, no rows give no rows, columns beyond the four
    read are left out.
    """
    audited = staged(audits(rows), "conversation-audits")
    hashed = digests(repaired(rows, audited)).withColumnRenamed("conv_id", "_conv_id")
    nothing = sha256().hexdigest()
    return audited.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").select(
        *audited.columns, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
