"""Spelling variants: words one edit apart, by composing acceptors with an edit.

A vocabulary is a minimal acceptor; composed with a transducer of exactly one
edit and with itself again, it accepts the pairs of near words.  The states in
which such a composition may begin are dealt out: words that agree in half of
their code points are one part, as two near words agree in the first or in the
last half of the shorter one.  A part that is too large is dealt out again by
half of what is left of its words, so that a popular beginning or ending never
meets in one task; every pair is accepted in exactly one part.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain, groupby
from operator import itemgetter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import LOWER, staged

MIN_LENGTH = 6
MIN_COUNT = 5
# A form occurs at least so many times as often as its variant.
FORM_RATIO = 5
# One run in so many loses a code point.
DAMAGED = 199
# Words of a part, and code points of them that may still differ, before the
# part is dealt out again.  Words that differ in one place of two are fewer.
PART_WORDS = 16_384
PART_LENGTH = 64
# What a task holds before it hands partial results on.
HELD_WORDS = 200_000
HELD_STATES = 100_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema(
    [("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("form", pa.string())]
)


# ---- the vocabulary ---------------------------------------------------------


def damaged(doc_id: str, run: str) -> str:
    """A lower-cased run, without one code point where its hash says so."""
    h = crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGED:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n``: words of all texts that are long and frequent enough.

    Null texts have no words, a null id counts as empty text; bytes that are
    not UTF-8 end a run.  Every task counts before anything is shuffled.
    """
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.col("text").cast("binary").alias("text"),
    ).where("text is not null")
    long_enough = re.compile(_RUN.pattern.replace("+", f"{{{max(1, min_length)},}}"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = Counter(long_enough.findall(text.translate(LOWER).decode(errors="replace")))
                for run, n in runs.items():
                    total[damaged(doc_id, run)] += n
                if len(total) > HELD_WORDS:
                    yield _counted(total)
                    total.clear()
        if total:
            yield _counted(total)

    return (
        texts.mapInArrow(count, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where((F.length("word") >= min_length) & (F.col("n") >= min_count))
    )


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.record_batch([list(total), list(total.values())], schema=_COUNTED)


# ---- parts ------------------------------------------------------------------


def _halved(parts: DataFrame) -> DataFrame:
    """Every row twice: in the part of its first half, and of its last half.

    ``rest`` is the length of the shorter words of a part without the ``head``
    and ``tail`` code points that all its words share; longer words have one
    more.  A pair belongs to the part only if its words first differ before
    ``below``.
    """
    half = F.call_function("div", F.col("rest"), F.lit(2)).cast("int")
    length = F.length("word")
    first = F.substring("word", F.col("head") + 1, half)
    last = F.substring("word", length - F.col("tail") - half + 1, half)
    rest = (F.col("rest") - half).alias("rest")

    def side(mark: str, shared: Column, head: Column, tail: Column, below: Column) -> Column:
        key = F.xxhash64("key", "rest", F.lit(mark), shared).alias("key")
        return F.struct(key, rest, head.alias("head"), tail.alias("tail"), below.alias("below"))

    head, tail, below = F.col("head"), F.col("tail"), F.col("below")
    sides = F.array(
        side("first", first, head + half, tail, below),
        side("last", last, head, tail + half, F.least(below, head + half)),
    )
    return parts.select("word", "n", F.explode(sides).alias("side")).select("word", "n", "side.*")


def _parts(words: DataFrame, min_length: int, part_words: int) -> DataFrame:
    """All words in the parts where their near words are, each of a bounded size."""
    length = F.length("word")
    zero = F.lit(0)
    shorter = F.filter(F.array(length, length - 1), lambda n: n >= max(2, min_length))
    whole = words.select("word", "n", F.explode(shorter).alias("rest")).select(
        "word",
        "n",
        F.lit(0).cast("bigint").alias("key"),
        "rest",
        zero.alias("head"),
        zero.alias("tail"),
        (F.col("rest") + 1).alias("below"),
    )
    parts = _halved(whole)
    done = []
    while True:
        parts = staged(parts, "variant-parts")
        sizes = parts.groupBy("key").agg(F.count("*").alias("size"), F.max("rest").alias("left"))
        again = (F.col("left") > 1) & (
            (F.col("size") > part_words) | ((F.col("left") > PART_LENGTH) & (F.col("size") > 1))
        )
        large = sizes.where(again).select("key")
        if large.isEmpty():
            return parts if not done else _union([*done, parts])
        done.append(parts.join(large, "key", "left_anti"))
        parts = _halved(parts.join(large, "key", "left_semi"))


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.unionByName(more)
    return whole


# ---- machines ---------------------------------------------------------------


class Machines:
    """Minimal acceptors of equally long words that share their states.

    A state is a number; words that it accepts are numbered in order, so that a
    pair of accepted words is a pair of numbers.  State 0 is final.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.sizes = [1]
        self._known: dict[tuple, int] = {}
        self._equal: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._replaced: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._inserted: dict[tuple[int, int, int], list[tuple[int, int]]] = {}

    def acceptor(self, words: list[str]) -> int:
        """The first state of the minimal acceptor of sorted, distinct words."""
        depth = len(words[0])
        if not depth:
            return 0
        unfinished: list[list[tuple[str, int]]] = [[] for _ in range(depth)]
        before = words[0]
        for word in words[1:]:
            shared = 0
            while word[shared] == before[shared]:
                shared += 1
            self._finish(unfinished, before, shared)
            before = word
        self._finish(unfinished, before, 0)
        return self._state(unfinished[0])

    def _finish(self, unfinished: list[list], word: str, shared: int) -> None:
        """Give up the states of a word behind what the next one shares with it."""
        state = 0
        for place in range(len(word) - 1, shared, -1):
            unfinished[place].append((word[place], state))
            state = self._state(unfinished[place])
            unfinished[place] = []
        unfinished[shared].append((word[shared], state))

    def _state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        state = self._known.get(key)
        if state is None:
            state = self._known[key] = len(self.arcs)
            numbered, size = {}, 0
            for label, to in arcs:
                numbered[label] = (to, size)
                size += self.sizes[to]
            self.arcs.append(numbered)
            self.sizes.append(size)
        return state

    def equal(self, p: int, q: int) -> list[tuple[int, int]]:
        """Words that both states accept: their numbers in each."""
        if p == q:
            return [(i, i) for i in range(self.sizes[p])]
        found = self._equal.get((p, q))
        if found is None:
            ps, qs = self.arcs[p], self.arcs[q]
            found = self._equal[p, q] = [
                (ps[label][1] + i, qs[label][1] + j)
                for label in ps.keys() & qs.keys()
                for i, j in self.equal(ps[label][0], qs[label][0])
            ]
        return found

    def replaced(self, p: int, reach: int) -> list[tuple[int, int]]:
        """Pairs with one code point replaced, among the first ``reach`` ones."""
        if reach <= 0 or not p:
            return []
        found = self._replaced.get((p, reach))
        if found is None:
            found = []
            arcs = list(self.arcs[p].values())
            for at, (to, first) in enumerate(arcs):
                for other, second in arcs[at + 1 :]:
                    found += [(first + i, second + j) for i, j in self.equal(to, other)]
                found += [(first + i, first + j) for i, j in self.replaced(to, reach - 1)]
            self._replaced[p, reach] = found
        return found

    def inserted(self, p: int, q: int, reach: int) -> list[tuple[int, int]]:
        """Pairs of a word of ``p`` and one of ``q`` with one code point more.

        The words first differ among the first ``reach`` code points.
        """
        if reach <= 0:
            return []
        found = self._inserted.get((p, q, reach))
        if found is None:
            found = []
            ps = self.arcs[p]
            for label, (to, second) in self.arcs[q].items():
                if not p:
                    found += [(0, second + j) for _, j in self.equal(0, to)]
                    continue
                after = self.arcs[to]
                for next_label in ps.keys() & after.keys():
                    if next_label != label:
                        left, i0 = ps[next_label]
                        right, j0 = after[next_label]
                        found += [(i0 + i, second + j0 + j) for i, j in self.equal(left, right)]
                if label in ps:
                    left, i0 = ps[label]
                    found += [(i0 + i, second + j) for i, j in self.inserted(left, to, reach - 1)]
            self._inserted[p, q, reach] = found
        return found


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of every part: how many near words it has there, and the first of them."""
    machines = Machines()
    made: list[tuple] = []
    rows = chain.from_iterable(
        zip(*(column.to_pylist() for column in batch.columns), strict=True) for batch in batches
    )
    for _, part in groupby(rows, itemgetter(0)):
        same = defaultdict(lambda: ([], []))
        for _, rest, head, tail, below, word, n in part:
            end = len(word) - tail
            # Parts are hashed: only words that do share both ends are composed.
            shared = (rest, below, word[:head], word[end:])
            same[shared][end - head - rest].append((word[head:end], n))
        for (_, below, head, tail), (short, long) in same.items():
            if len(short) + len(long) < 2 or not short:
                continue
            made += _composed(machines, short, long, below - len(head), head, tail)
        if len(machines.arcs) > HELD_STATES:
            machines = Machines()
        if len(made) > HELD_WORDS:
            yield _near(made)
            made = []
    if made:
        yield _near(made)


def _composed(machines: Machines, short: list, long: list, reach: int, head: str, tail: str) -> list:
    short.sort()
    long.sort()
    start = machines.acceptor([rest for rest, _ in short])
    pairs = list(machines.replaced(start, reach))
    if long:
        other = machines.acceptor([rest for rest, _ in long])
        at = len(short)
        pairs += [(i, at + j) for i, j in machines.inserted(start, other, reach)]
    both = short + long
    words = [head + rest + tail for rest, _ in both]
    near, first = Counter(), {}
    for pair in pairs:
        for i, j in (pair, pair[::-1]):
            near[i] += 1
            candidate = (-both[j][1], words[j])
            if i not in first or candidate < first[i]:
                first[i] = candidate
    return [(words[i], n, *first[i]) for i, n in near.items()]


def _near(made: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([list(c) for c in zip(*made, strict=True)], schema=_NEAR)


# ---- forms and roots --------------------------------------------------------


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, part_words: int = PART_WORDS) -> DataFrame:
    """``word``, ``n_near`` and the near word of largest ``n`` (``form``, ``form_n``).

    Only words with a near word have a row; of near words with equal ``n`` the
    first in code-point order is taken.  Words are distinct.
    """
    parts = _parts(words, min_length, part_words).select(
        "key", "rest", "head", "tail", "below", "word", "n"
    )
    found = (
        parts.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_near_words, "word string, n_near bigint, less bigint, form string")
    )
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("first"))
        .select("word", "n_near", F.col("first.form").alias("form"), (-F.col("first.less")).alias("form_n"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: where the forms lead.

    Every round doubles the way, and a way grows by ``FORM_RATIO`` in each
    step, so a few rounds end it.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(roots.join(onward, "root", "left"), "variant-roots")
        roots = further.select("word", F.coalesce("next", "root").alias("root"))
        if further.where("next is not null").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = FORM_RATIO,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """Words of all texts with their forms: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word of largest ``n`` (the first in code-point
    order among equals) if that is at least ``ratio`` times the word's, else
    null; ``root`` is where forms lead.  Repeated rows and ids count again.  No
    texts, no rows.  Other columns than ``doc_id`` and ``text`` are not read.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant")
    words = staged(vocabulary(docs, min_length, min_count), "vocabulary")
    near = near_words(words, min_length, part_words)
    usual = F.col("form_n") >= ratio * F.col("n")
    joined = staged(
        words.join(near, "word", "left").select(
            "word",
            F.when(usual, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(usual, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = _roots(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
