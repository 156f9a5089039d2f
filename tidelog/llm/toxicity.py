"""Toxicity by a weighted finite-state grammar of clauses.

A lexicon reads words as classes: insults (learned from labelled texts, whole
words and stems), verbs of violence, targets, negations and reports.  Small
transducers then mark denied, reported and addressed insults and threats, and
a last one scores a single marked place.  They are composed into one machine;
the severity of a clause is the weight of its tropical shortest path.  A
logistic curve, fitted to the labels, turns the worst clause, the sum of all and
their density into the score of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from tidelog.llm.common import annotated, fields

# Labelled texts of each class to learn from, about, and code points of each.
SAMPLE_TEXTS = 2000
SAMPLE_LENGTH = 16_384
FOLDS = 5

# Words of the grammar.
TARGETS = (
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton vous votre "
    "tú ti usted ustedes vosotros"
)
NEGATIONS = (
    "not never no neither nor isn't aren't wasn't weren't don't doesn't didn't nicht nie kein keine "
    "ne pas jamais nunca ni"
)
REPORTS = (
    "said says saying claimed claims wrote writes quoted quotes told tells called calls according "
    "sagte sagt schrieb behauptete dit disait écrit dijo dice escribió"
)
INTENTIONS = "will shall gonna going must i'll we'll werde werden vais allons voy vamos"
VIOLENCE = (
    "kill hurt murder stab shoot beat destroy töten umbringen schlagen tuer frapper détruire "
    "matar golpear destruir"
)

# Classes of words, and marks that the grammar puts in their place.
OTHER, INSULT, VIOLENT, INTENDED, TARGET, NEGATION, REPORT = ".IVMYNR"
ADDRESSED, DENIED, REPORTED, THREAT = "ADQH"
CLASSES = (OTHER, INSULT, VIOLENT, INTENDED, TARGET, NEGATION, REPORT)
# Words over which a negation, a target or an intention reaches.
SCOPE = 3
# What is thought of a text whose worst place has this mark, before any label
# is seen: the share of toxic ones, worth so many texts.
BELIEFS = {INSULT: 0.8, ADDRESSED: 0.9, DENIED: 0.3, REPORTED: 0.3, THREAT: 0.8}
BELIEF_TEXTS = 4
MARKS = {INSULT: "insult", ADDRESSED: "addressed", DENIED: "denied", REPORTED: "reported", THREAT: "threat"}

# The lexicon: lengths of stems, support (in texts, and of the toxic ones) and odds of an entry.
STEMS = range(3, 13)
MIN_SUPPORT = 4.0
MIN_SHARE = 0.01
# An entry's odds must be so high even if they are estimated too high by so many
# standard errors.
MIN_ODDS = math.log(3)
ERRORS = 1.64
MOST_ENTRIES = 500
# Entries that nearly reach the best one count as equal, and the longest is taken.
NEARLY = 0.98
# Hashes by which near copies among the toxic texts are found.
COPY_HASHES = 8
RIDGE = 0.5

SCORED = fields(score=DoubleType(), mark=StringType(), clause=StringType(), n_marked=LongType())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
_ENDS = frozenset(".!?;\n")
_CACHED = 200_000


# ---- transducers ------------------------------------------------------------


@dataclass
class Transducer:
    """Arcs ``state -> [(read, written, cost, next)]``; reads one symbol a step."""

    arcs: dict = field(default_factory=lambda: defaultdict(list))
    finals: dict = field(default_factory=dict)
    start: object = 0

    def add(self, state, read: str, written: str, to, cost: float = 0.0) -> None:
        self.arcs[state].append((read, written, cost, to))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that hands what ``first`` writes to ``second``."""
    made = Transducer(start=(first.start, second.start))
    todo, seen = [made.start], {made.start}
    while todo:
        a, b = state = todo.pop()
        if a in first.finals and b in second.finals:
            made.finals[state] = first.finals[a] + second.finals[b]
        for read, between, cost, next_a in first.arcs[a]:
            for taken, written, more, next_b in second.arcs[b]:
                if taken == between:
                    to = (next_a, next_b)
                    made.add(state, read, written, to, cost + more)
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
    return made


def within_scope(opening: str, changes: dict[str, str], symbols: Iterable[str], reach: float) -> Transducer:
    """Changes marks that stand at most ``reach`` words after an opening one."""
    made = Transducer()
    states = range(SCOPE + 1) if reach == SCOPE else (0, 1)
    for state in states:
        made.finals[state] = 0.0
        for symbol in symbols:
            to = max(0, state - 1) if reach == SCOPE else state
            written = changes.get(symbol, symbol) if state else symbol
            made.add(state, symbol, written, max(states) if symbol == opening else to)
    return made


def near_target(symbols: Iterable[str]) -> Transducer:
    """Insults may be read as addressed if a target is near, before or behind.

    A state counts the words for which a target before still reaches, and
    those within which a promised one must come.
    """
    made = Transducer(start=(0, 0))
    for before in range(SCOPE + 1):
        for promised in range(SCOPE + 1):
            state = (before, promised)
            if not promised:
                made.finals[state] = 0.0
            for symbol in symbols:
                if symbol == TARGET:
                    made.add(state, symbol, symbol, (SCOPE, 0))
                    continue
                rest = max(0, before - 1)
                if promised != 1:
                    made.add(state, symbol, symbol, (rest, max(0, promised - 1)))
                if symbol == INSULT:
                    if before and promised != 1:
                        made.add(state, symbol, ADDRESSED, (rest, max(0, promised - 1)))
                    if not promised:
                        made.add(state, symbol, ADDRESSED, (rest, SCOPE))
    return made


def threats(symbols: Iterable[str]) -> Transducer:
    """Violence between an intention and a target is a threat, else nothing."""
    made = Transducer(start=(0, 0))
    for intended in range(SCOPE + 1):
        for promised in range(SCOPE + 1):
            state = (intended, promised)
            if not promised:
                made.finals[state] = 0.0
            for symbol in symbols:
                rest = SCOPE if symbol == INTENDED else max(0, intended - 1)
                written = OTHER if symbol == VIOLENT else symbol
                if symbol == TARGET:
                    made.add(state, symbol, written, (rest, 0))
                elif promised != 1:
                    made.add(state, symbol, written, (rest, max(0, promised - 1)))
                if symbol == VIOLENT and intended and not promised:
                    made.add(state, symbol, THREAT, (rest, SCOPE))
    return made


def one_mark(costs: dict[str, float], symbols: Iterable[str]) -> Transducer:
    """Accepts one mark at most, at its cost; the lexicon may read other insults as plain words."""
    made = Transducer(finals={0: 0.0, 1: 0.0})
    for symbol in symbols:
        if symbol in costs:
            made.add(0, symbol, symbol, 1, costs[symbol])
            continue
        for state in (0, 1):
            made.add(state, symbol, OTHER, state)
    return made


def grammar(costs: dict[str, float]) -> Transducer:
    """All parts composed: reads classes of words, costs are those of marks."""
    marked = [*CLASSES, DENIED, REPORTED]
    parts = [
        within_scope(NEGATION, {INSULT: DENIED, VIOLENT: OTHER}, CLASSES, SCOPE),
        within_scope(REPORT, {INSULT: REPORTED, VIOLENT: OTHER}, [*CLASSES, DENIED], math.inf),
        near_target(marked),
        threats([*marked, ADDRESSED]),
        one_mark(costs, [*marked, ADDRESSED, THREAT]),
    ]
    made = parts[0]
    for part in parts[1:]:
        made = compose(made, part)
    return made


# ---- the lexicon ------------------------------------------------------------


@dataclass(frozen=True)
class Entry:
    """An insult: a whole word, or the beginning of words; severity in log odds."""

    text: str
    stem: bool
    severity: float


class Lexicon(dict):
    """Readings of words: pairs of a class and its cost, looked up once each.

    An acceptor of the entries' code points; of several that accept a word the
    most severe counts.  An insult may also be read as any other word.
    """

    def __init__(self, entries: Sequence[Entry]) -> None:
        super().__init__()
        self._arcs: list[dict[str, int]] = [{}]
        self._stems: dict[int, float] = {}
        self._words: dict[int, float] = {}
        self._fixed: dict[str, str] = {}
        for names, symbol in (
            (VIOLENCE, VIOLENT),
            (INTENTIONS, INTENDED),
            (NEGATIONS, NEGATION),
            (REPORTS, REPORT),
            (TARGETS, TARGET),
        ):
            self._fixed.update(dict.fromkeys(names.split(), symbol))
        for entry in entries:
            state = 0
            for c in entry.text:
                if c not in self._arcs[state]:
                    self._arcs[state][c] = len(self._arcs)
                    self._arcs.append({})
                state = self._arcs[state][c]
            ends = self._stems if entry.stem else self._words
            ends[state] = max(entry.severity, ends.get(state, 0.0))

    def _severity(self, word: str) -> float:
        state, found = 0, 0.0
        for c in word:
            state = self._arcs[state].get(c, -1)
            if state < 0:
                return found
            found = max(found, self._stems.get(state, 0.0))
        return max(found, self._words.get(state, 0.0))

    def __missing__(self, word: str) -> tuple[tuple[str, float], ...]:
        if len(self) > _CACHED:
            self.clear()
        severity = self._severity(word)
        plain = self._fixed.get(word.replace("’", "'"), OTHER)
        readings = ((plain, 0.0),)
        if severity:
            readings = ((OTHER, 0.0), (INSULT, -severity))
        self[word] = readings
        return readings


_PLAIN = ((OTHER, 0.0),)


@dataclass(frozen=True)
class Model:
    """Learned insults, costs of marks, and the curve over the measures of a text."""

    entries: tuple[Entry, ...]
    costs: dict[str, float]
    bias: float
    slopes: tuple[float, ...] = (1.0, 0.0, 0.0)

    def score(self, found: Found) -> float:
        odds = self.bias + sum(w * x for w, x in zip(self.slopes, found.measures(), strict=True))
        return 1 / (1 + math.exp(min(700.0, -odds)))


class Found(NamedTuple):
    """The worst clause of a text, and all marked clauses together."""

    severity: float
    mark: str | None
    clause: str | None
    marked: int
    total: float
    words: int

    def measures(self) -> tuple[float, float, float]:
        return self.severity, math.log1p(self.total), math.log1p(100 * self.total / max(1, self.words))


class Reader:
    """Finds the severe clauses of a text."""

    def __init__(self, model: Model) -> None:
        self.words = Lexicon(model.entries)
        machine = grammar(model.costs)
        self._start, self._finals = machine.start, machine.finals
        self._arcs = {
            state: _by_symbol(arcs) for state, arcs in machine.arcs.items()
        }
        self._known: dict[tuple, tuple[float, str | None]] = {}

    def severity(self, clause: Sequence[tuple]) -> tuple[float, str | None]:
        """Severity and mark of the shortest path over the words' readings."""
        key = tuple(clause)
        found = self._known.get(key)
        if found is not None:
            return found
        ways: dict = {self._start: (0.0, "")}
        for readings in clause:
            reached: dict = {}
            for state, (cost, mark) in ways.items():
                arcs = self._arcs.get(state, {})
                for symbol, weight in readings:
                    for written, more, to in arcs.get(symbol, ()):
                        new = (cost + weight + more, written if written != OTHER else mark)
                        if to not in reached or new < reached[to]:
                            reached[to] = new
            ways = reached
        cost, mark = min((way for state, way in ways.items() if state in self._finals), default=(0.0, ""))
        found = (-cost, mark or None) if cost < 0 else (0.0, None)
        if len(self._known) > _CACHED:
            self._known.clear()
        self._known[key] = found
        return found

    def read(self, text: str) -> Found:
        tokens = _TOKEN.findall(text.lower())
        words = self.words
        readings = [words[token] for token in tokens]
        places = [
            i for i, reading in enumerate(readings) if len(reading) > 1 or reading[0][0] == VIOLENT
        ]
        worst, n, total, end = (0.0, None, None), 0, 0.0, -1
        for place in places:
            if place < end:
                continue
            start = place
            while start and tokens[start - 1] not in _ENDS:
                start -= 1
            end = place
            while end < len(tokens) and tokens[end] not in _ENDS:
                end += 1
            severity, mark = self.severity(_shortened(readings[start:end]))
            n += mark is not None
            total += severity
            if severity > worst[0]:
                worst = (severity, mark, " ".join(tokens[start:end]))
        return Found(*worst, n, total, len(tokens))


def _by_symbol(arcs: list[tuple]) -> dict[str, list[tuple]]:
    made = defaultdict(list)
    for read, written, cost, to in arcs:
        made[read].append((written, cost, to))
    return dict(made)


def _shortened(clause: list[tuple]) -> list[tuple]:
    """The clause with runs of other words cut to what a scope can reach."""
    made: list[tuple] = []
    run = 0
    for reading in clause:
        run = run + 1 if reading == _PLAIN else 0
        if run <= SCOPE + 1:
            made.append(reading)
    return made


# ---- learning ---------------------------------------------------------------


def _words(text: str) -> list[str]:
    return [w for w in _TOKEN.findall(text.lower()) if w not in _ENDS]


def _features(words: Iterable[str]) -> set[str]:
    """Stems of words, and whole words, which have a blank behind them."""
    distinct = set(words)
    made = {word + " " for word in distinct}
    made.update(word[:k] for word in distinct for k in STEMS if k <= len(word))
    return made


def _odds(toxic: float, clean: float, share: float = 0.5, texts: float = 1.0) -> float:
    return math.log((toxic + share * texts) / (clean + (1 - share) * texts))


def learn(texts: Sequence[str], toxic: Sequence[bool], shift: float = 0.0) -> Model:
    """Insults and costs from labelled texts; ``shift`` corrects the classes' shares.

    Entries are taken one after another, by their odds and the toxic texts they are found in;
    a text counts half with every entry it already has, and near copies count
    as one text, so that words which only accompany insults are not taken.
    """
    bad = [text for text, label in zip(texts, toxic, strict=True) if label]
    good = [text for text, label in zip(texts, toxic, strict=True) if not label]
    seen = Counter(f for text in bad for f in _features(_words(text)))
    least = max(MIN_SUPPORT, MIN_SHARE * len(bad))
    support = {f: n for f, n in seen.items() if n >= least}
    del seen
    against = Counter(f for text in good for f in _features(_words(text)) if f in support)
    shares = math.log(max(1, len(bad)) / max(1, len(good)))

    def odds(name: str) -> float:
        return _odds(support[name], against[name]) - shares

    def sure(name: str) -> float:
        return odds(name) - ERRORS * math.sqrt(1 / support[name] + 1 / (against[name] + 0.5))

    names = sorted(name for name in support if sure(name) >= MIN_ODDS)
    taken = _cover(names, [sure(name) for name in names], bad, _shares(bad), least)
    entries = tuple(Entry(f.rstrip(), not f.endswith(" "), odds(f)) for f in taken)
    return _calibrated(entries, texts, toxic, shares, shift)


def _shares(texts: list[str]) -> list[float]:
    """One over the number of near copies of each text: texts that share a minimum hash."""
    draw = np.random.default_rng(3)
    factors = draw.integers(1, 1 << 32, COPY_HASHES, dtype=np.uint64) | np.uint64(1)
    group = list(range(len(texts)))

    def first(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, text in enumerate(texts):
        words = _words(text)
        shingles = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
        hashes = np.array([crc32(s.encode()) for s in shingles], np.uint64)
        least = (hashes[:, None] * factors % np.uint64((1 << 61) - 1)).min(axis=0)
        for place in enumerate(least.tolist()):
            a, b = first(i), first(seen.setdefault(place, i))
            group[max(a, b)] = min(a, b)
    sizes = Counter(first(i) for i in range(len(texts)))
    return [1 / sizes[first(i)] for i in range(len(texts))]


def _cover(
    names: list[str], odds: list[float], texts: list[str], weights: list[float], least: float
) -> list[str]:
    number = {name: i for i, name in enumerate(names)}
    held = [[number[f] for f in _features(_words(text)) if f in number] for text in texts]
    rows = np.repeat(np.arange(len(texts)), [len(one) for one in held])
    columns = np.fromiter((i for one in held for i in one), np.int64, len(rows))
    order = np.argsort(columns, kind="stable")
    ends = np.searchsorted(columns[order], np.arange(len(names) + 1))
    weight = np.array(weights)
    open_ones = np.ones(len(names), bool)
    taken: list[str] = []
    while names and len(taken) < MOST_ENTRIES:
        reached = np.bincount(columns, weight[rows], len(names))
        gain = reached * odds * (open_ones & (reached >= least))
        if not gain.any():
            break
        equal = np.flatnonzero(gain >= NEARLY * gain.max())
        pick = min(equal, key=lambda i: (-len(names[i]), names[i]))
        name = names[pick]
        taken.append(name)
        # Neither what the entry already accepts nor what is too short for it.
        open_ones &= ~np.array([name.startswith(other) or other.startswith(name) for other in names])
        weight[rows[order[ends[pick] : ends[pick + 1]]]] /= 2
    return taken


def _calibrated(
    entries: tuple[Entry, ...], texts: Sequence[str], toxic: Sequence[bool], shares: float, shift: float
) -> Model:
    """Costs of the marks from the worst mark of each labelled text, then the curve."""
    prior = {mark: -_odds(0, 0, share, BELIEF_TEXTS) for mark, share in BELIEFS.items()}
    reader = Reader(Model(tuple(Entry(e.text, e.stem, 2.0) for e in entries), prior, 0.0))
    seen: dict[str | None, list[int]] = defaultdict(lambda: [0, 0])
    for text, label in zip(texts, toxic, strict=True):
        seen[reader.read(text).mark][not label] += 1

    def odds(mark: str) -> float:
        return _odds(*seen[mark], BELIEFS[mark], BELIEF_TEXTS) - shares

    costs = {mark: odds(INSULT) - odds(mark) for mark in BELIEFS}
    # A threat has no entry whose severity it could change.
    costs[THREAT] = -odds(THREAT)
    reader = Reader(Model(entries, costs, 0.0))
    measures = np.array([reader.read(text).measures() for text in texts]).reshape(-1, 3)
    bias, slopes = _curve(measures, np.array(toxic, bool))
    return Model(entries, costs, bias + shift, slopes)


def _curve(measures: np.ndarray, toxic: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """Logistic regression with a small ridge; no measure may speak for a clean text."""
    bad = int(toxic.sum())
    used = [i for i in range(measures.shape[1]) if bad and measures[:, i].any()]
    while used and bad < len(toxic):
        x = measures[:, used]
        spread = x.std(axis=0)
        x = np.column_stack([np.ones(len(x)), x / spread])
        ridge = np.diag([1e-6, *[RIDGE] * len(used)])
        weight = np.zeros(x.shape[1])
        weight[0] = _odds(bad, len(toxic) - bad)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
            slope = x.T @ (p - toxic) + ridge @ weight
            step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, slope)
            weight -= step / max(1.0, np.abs(step).max())
        worst = int(weight[1:].argmin())
        if weight[1 + worst] >= 0:
            slopes = np.zeros(measures.shape[1])
            slopes[used] = weight[1:] / spread
            return float(weight[0]), tuple(slopes.tolist())
        del used[worst]
    return _odds(bad, len(toxic) - bad, 0.1), (0.0,) * measures.shape[1]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document must not be learned from; false for a null id."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(rest == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_texts: int = SAMPLE_TEXTS,
) -> Model:
    """Learn from a sample of the labelled documents that are not held out.

    About ``sample_texts`` documents of each class are drawn by a hash of their
    ids, and those longer than ``SAMPLE_LENGTH`` code points left out.  Null
    ids, labels and texts are no part of it; an id with several labels has the
    largest, one with several texts the smallest.  Without labels nothing is an
    insult and all texts are clean.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.max(label_col) >= 1).alias("label"))
    )
    counts = {r.label: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return learn([], [])
    fine = 1 << 30
    drawn = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(fine))
    bounds = {label: int(fine * min(1.0, sample_texts / n)) for label, n in counts.items()}
    chosen = known.where(
        F.when(F.col("label"), drawn < bounds.get(True, 0)).otherwise(drawn < bounds.get(False, 0))
    )
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.length("text") <= SAMPLE_LENGTH)
        .join(F.broadcast(chosen), "id")
        .groupBy("id", "label")
        .agg(F.min(F.col("text").cast("binary")).alias("text"))
        .toArrow()
        .sort_by("id")
    )
    texts = [text.decode(errors="replace") for text in rows["text"].to_pylist()]
    toxic = rows["label"].to_pylist()
    drawn_toxic = sum(toxic)
    shift = 0.0
    if 0 < drawn_toxic < len(toxic):
        shift = _odds(counts[True], counts[False]) - _odds(drawn_toxic, len(toxic) - drawn_toxic)
    return learn(texts, toxic, shift)


def scored(docs: DataFrame, model: Model, keep: Sequence[str | Column], text_col: str = "text") -> DataFrame:
    """``row``, the score, and mark and words of the most severe clause of every whole text."""

    def work() -> Callable:
        reader = Reader(model)

        def score(texts: list[bytes | None]) -> list[list]:
            made = [reader.read((text or b"").decode(errors="replace")) for text in texts]
            return [
                [model.score(found) for found in made],
                [MARKS.get(found.mark) for found in made],
                [found.clause for found in made],
                [found.marked for found in made],
            ]

        return score

    return annotated(docs, text_col, keep, SCORED, work)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Score and prediction of every document, with its worst clause; one row for each.

    ``mark`` and ``clause`` are null where no clause counts, as in null and
    empty texts, whose score is that of texts without insults.  Bytes that are
    not UTF-8 are no letters.  Repeated rows are scored alike; other columns
    are ignored, whatever their names; no documents give no rows.
    """
    found = scored(
        docs,
        fit(docs, labels, id_col, text_col, **options),
        [F.col(id_col).alias("id"), held_out(id_col).alias("held_out")],
        text_col,
    )
    return found.select(
        F.col("row.id").alias(id_col),
        F.col("row.held_out").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "mark",
        "n_marked",
        "clause",
    )
