"""Quality rules: per-text statistics and decision lists learned from labels.

Sequential covering grows conjunctions of thresholds that single out labelled
bad documents, prunes them on documents kept aside, and emits the ordered list
as one Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidelog.llm.common import annotated, fields

# The symbols that count, and the base limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_NO_SPACE = bytes(b"\t\n\x0b\x0c\r ")
_UPPER = bytes(range(65, 91))
# Labelled documents a list is learned from, at most.
SAMPLE_ROWS = 20_000

STATISTICS = fields(
    n_words=LongType(),
    word_chars=LongType(),
    n_symbols=LongType(),
    n_dup_lines=LongType(),
    n_repeat_words=LongType(),
    n_lines=LongType(),
    n_upper=LongType(),
    n_marks=LongType(),
)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    windows = ids[:n]
    for i in range(1, width):  # renumbered at each step, so that products stay small
        _, windows = np.unique(windows, return_inverse=True)
        windows = windows * len(number) + ids[i : n + i]
    _, where, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(times[where] > 1)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + width, -1)
    return int((np.cumsum(inside[:-1]) > 0).sum())


def _statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()
    solid = text.translate(None, _NO_SPACE)
    chars = int((np.frombuffer(solid, np.int8) >= -64).sum())  # not a following byte
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    return (
        len(words),
        chars,
        len(solid) - len(solid.translate(None, SYMBOLS)),
        duplicates,
        repeated_words(words),
        lines,
        len(solid) - len(solid.translate(None, _UPPER)),
        solid.count(b"!"),
    )


def _work():
    return lambda texts: list(zip(*[_statistics(t or b"") for t in texts], strict=True))


def statistics(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """``row`` (the kept columns) and the statistics of every whole text.

    A null text counts as empty: no words, all zero.
    """
    return annotated(docs, text_col, keep, STATISTICS, _work)


def base_failed() -> Column:
    """Too short, or more than half of its words repeated."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


# What conditions may test: statistics per word, per character or per line.
MEASURES = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def measure(name: str) -> Column:
    top, bottom = MEASURES[name]
    return F.col(top).cast("double") / F.greatest(F.col(bottom), F.lit(1)).cast("double")


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    limit: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.measure]
        return values > self.limit if self.above else values <= self.limit

    def column(self) -> Column:
        value = measure(self.measure)
        return value > self.limit if self.above else value <= self.limit


Rule = tuple[Condition, ...]


def covered(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    inside = np.ones(len(next(iter(table.values()))), dtype=bool)
    for condition in rule:
        inside &= condition.holds(table)
    return inside


def _best_condition(table, bad, inside):
    """The threshold with the largest information gain on the covered rows."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    before = np.log2(p0 / (p0 + n0))
    best = (1e-9, None)
    for name, column in table.items():
        values = column[inside]
        order = np.argsort(values, kind="stable")
        values, hits = values[order], bad[inside][order]
        p = np.cumsum(hits)
        n = np.arange(1, len(hits) + 1) - p
        cut = np.flatnonzero(values[1:] > values[:-1])
        if not len(cut):
            continue
        limits = (values[cut] + values[cut + 1]) / 2
        for above, pc, nc in ((False, p[cut], n[cut]), (True, p0 - p[cut], n0 - n[cut])):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - before), 0)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), Condition(name, above, float(limits[i])))
    return best[1]


def learn_rules(
    table: dict[str, np.ndarray],
    bad: np.ndarray,
    aside: np.ndarray,
    max_rules: int = 12,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    min_covered: int = 5,
) -> list[Rule]:
    """Sequential covering: rules that single out bad rows, in order.

    Rules grow on the rows that are not ``aside`` and lose their last
    conditions as long as that helps on those that are.  A rule counts only if
    it is right often enough on both, so that clean documents stay.
    """
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < max_rules:
        grow = left & ~aside
        if (grow & bad).sum() < min_covered or not (grow & ~bad).any():
            break
        inside, rule = grow.copy(), ()
        while len(rule) < max_conditions and (inside & ~bad).any():
            condition = _best_condition(table, bad, inside)
            if condition is None:
                break
            rule = (*rule, condition)
            inside &= condition.holds(table)
        if not rule:
            break

        def worth(cut: Rule) -> float:
            rows = covered(cut, table) & left & aside  # noqa: B023
            p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        rows = covered(rule, table) & left
        p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
        if p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left &= ~covered(rule, table)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false at the first rule that holds."""
    if not rules:
        return F.lit(True)
    expression = None
    for rule in rules:
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        expression = (
            F.when(test, F.lit(False))
            if expression is None
            else expression.when(test, F.lit(False))
        )
    return expression.otherwise(F.lit(True))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> list[Rule]:
    """Learn the list from at most ``sample_rows`` labelled documents.

    The sample is the labels of smallest hash, so it does not depend on the
    order of the rows.  Null ids and labels are left out; without labels the
    list is empty.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(known), "id"
    )
    rows = statistics(drawn, ["id", "label"], "text").select(
        (F.col("row.label") < 1).alias("bad"),
        (F.pmod(F.xxhash64("row.id", F.lit("aside")), F.lit(3)) == 0).alias("aside"),
        *[measure(name).alias(name) for name in MEASURES],
    )
    rows = rows.orderBy(*MEASURES, "bad", "aside").limit(2 * sample_rows).toPandas()
    if not len(rows):
        return []
    table = {name: rows[name].to_numpy(np.float64) for name in MEASURES}
    return learn_rules(table, rows["bad"].to_numpy(bool), rows["aside"].to_numpy(bool))


def judged(
    docs: DataFrame,
    rules: list[Rule],
    keep: Sequence[str],
    text_col: str = "text",
) -> DataFrame:
    """``row``, the statistics, ``base_failed`` and ``kept`` for every document."""
    found = statistics(docs, keep, text_col)
    return found.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Statistics and verdict of every document: one row for each, repeats too.

    A null or empty text has no words and fails the base limit.  Other columns
    are ignored, whatever their names; empty tables give empty results.
    """
    rules = fit(docs, labels, id_col, text_col, **options)
    found = judged(docs, rules, [F.col(id_col).alias("id")], text_col)
    return found.select(
        F.col("row.id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )
