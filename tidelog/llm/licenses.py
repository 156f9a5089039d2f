"""License scans: exact phrases, and short notices with a bounded number of errors.

A notice that may differ in ``k`` places is cut into ``k + 1`` pieces, one of
which must stand in the text unchanged (pigeonhole).  The pieces are searched
all at once; around each hit the ``regex`` module decides whether the notice
is there within ``k`` edits, and where.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
)

from tidelog.llm.common import LETTERS, annotated, fields

# Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


@dataclass(frozen=True)
class Notice:
    """Words to find with up to ``errors`` edits, around one word that must be exact.

    ``exact`` (with the blank before it) tells notices apart, as ``mit`` or the
    number of a version does; the edits may fall in ``words`` and ``tail``.
    """

    label: str
    words: str
    errors: int
    exact: str = ""
    tail: str = ""

    @property
    def exact_end(self) -> str:
        """What follows the words in an unchanged notice."""
        return self.exact + self.tail

    @property
    def whole(self) -> str:
        return self.words + self.exact_end

    @property
    def editable(self) -> int:
        """Characters in which edits may fall."""
        return len(self.words) + len(self.tail)


NOTICES = (
    Notice("mit", "released under the", 2, " mit", " license"),
    Notice("mit", "under the", 2, " mit", " license"),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("apache-2", "licensed under the apache license version", 4, " 2"),
    Notice("apache-2", "apache license version", 3, " 2"),
    Notice("gpl-3", "licensed under the gnu general public license version", 5, " 3"),
    Notice("gpl-2", "licensed under the gnu general public license version", 5, " 2"),
    Notice("mpl-2", "subject to the terms of the mozilla public license", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by-nc", "licensed under cc by", 2, " nc"),
    Notice("cc-by-nc", "cc by", 1, " nc"),
)

# Lengths of a notice that are searched at once for the best match.
BLOCK_NOTICES = 64
_BLANK = re.compile(" ")

HIT = fields(
    label=StringType(),
    first_word=LongType(),
    last_word=LongType(),
    errors=IntegerType(),
    score=DoubleType(),
)
FOUND: StructType = fields(
    n_words=LongType(),
    n_base=LongType(),
    first_word=LongType(),
    last_word=LongType(),
    base_labels=StringType(),
    labels=StringType(),
    score=DoubleType(),
    notices=ArrayType(HIT),
)


def pieces(words: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` disjoint pieces of near equal length, with their offsets."""
    count = errors + 1
    cuts = [len(words) * i // count for i in range(count + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Scanner:
    """Seeds and patterns of a list of notices, compiled once per task."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for number, notice in enumerate(notices):
            for at, piece in pieces(notice.whole, notice.errors):
                by_piece.setdefault(piece, []).append((number, at))
        for piece, origins in by_piece.items():
            self.seeds.add_word(piece, (len(piece), origins))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(
                rf"(?b)(?<![^ ])(?:{regex.escape(n.words)}){{e<={n.errors}}}"
                rf"{regex.escape(n.exact)}(?![^ ])"
                + (rf"(?:{regex.escape(n.tail)}){{e<={n.errors}}}(?![^ ])" if n.tail else "")
            )
            for n in notices
        ]

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Per notice, the merged stretches around its seeds: (notice, start, end)."""
        found: dict[int, list[list[int]]] = {}
        for end, (length, origins) in self.seeds.iter(text):
            for number, at in origins:
                notice = self.notices[number]
                start = end + 1 - length - at - notice.errors - 1
                stop = start + len(notice.whole) + 3 * notice.errors + 2
                stretches = found.setdefault(number, [])
                if stretches and start <= stretches[-1][1]:
                    stretches[-1][0] = min(stretches[-1][0], start)
                    stretches[-1][1] = max(stretches[-1][1], stop)
                else:
                    stretches.append([start, stop])
        for number, stretches in found.items():
            for start, stop in stretches:
                yield number, max(0, start), min(len(text), stop)

    def matches(self, number: int, text: str, start: int, stop: int) -> Iterator:
        """The matches of a stretch: the best one, and those of the parts before and after it.

        A long stretch is searched block by block.  What ends in the last
        notice's length of a block is left to the next one, so that each block
        costs the same, however many notices follow each other.
        """
        notice = self.notices[number]
        longest = len(notice.whole) + 3 * notice.errors + 2
        while start < stop:
            end = min(stop, start + BLOCK_NOTICES * longest)
            sure = end if end == stop else end - longest
            last = start
            for match in self._best_first(number, text, start, end):
                if match.end() <= sure:
                    last = max(last, match.end())
                    yield match
            # What is left to the next block begins at most a length before.
            start = stop if end == stop else max(last, sure - longest)

    def _best_first(self, number: int, text: str, start: int, stop: int) -> Iterator:
        open_ = [(start, stop)]
        while open_:
            start, stop = open_.pop()
            match = self.patterns[number].search(text, start, stop)
            if match and match.end() > match.start():
                yield match
                open_ += [(start, match.start()), (match.end(), stop)]

    def search(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """Notices in a text of words joined by single blanks: label, words, errors, score."""
        hits = set()
        blanks: list[int] | None = None
        for number, start, stop in self.windows(text):
            notice = self.notices[number]
            for match in self.matches(number, text, start, stop):
                first, last = match.span()
                first += len(match[0]) - len(match[0].lstrip(" "))
                last -= len(match[0]) - len(match[0].rstrip(" "))
                errors = sum(match.fuzzy_counts)
                if errors > notice.errors:  # the bound of words and tail together
                    continue
                if blanks is None:
                    blanks = [found.start() for found in _BLANK.finditer(text)]
                words = bisect_left(blanks, first), bisect_left(blanks, last)
                score = 1.0 - errors / notice.editable
                hits.add((notice.label, *words, errors, score))
        return sorted(hits)


def _base(padded: bytes, phrases) -> tuple[list[int], set[str]]:
    """Word numbers at which phrases start, and their labels."""
    starts, labels = [], set()
    for phrase, label in phrases:
        at = padded.find(phrase)
        word = counted = 0
        while at >= 0:
            word, counted = word + padded.count(b" ", counted, at), at
            starts.append(word)
            labels.add(label)
            at = padded.find(phrase, at + 1)
    return starts, labels


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[Notice] = NOTICES,
) -> DataFrame:
    """Scan every whole text; one row per document, repeated rows too.

    ``n_base`` counts the places of ``phrases``, ``first_word`` and
    ``last_word`` are their smallest and largest start (null without one).
    ``notices`` lists what the method found: label, first and last word, edits
    and score.  ``labels`` joins the labels of both, ``score`` is 1 with a base
    phrase, else that of the best notice, else 0.  A null or empty text has no
    words; other columns are ignored; an empty table gives no rows.
    """
    bounded = [(f" {phrase} ".encode(), label) for phrase, label in phrases]

    def work():
        scanner = Scanner(notices)

        def one(raw: bytes | None):
            words = (raw or b"").translate(LETTERS).split()
            joined = b" ".join(words)
            starts, base = _base(b" " + joined + b" ", bounded)
            hits = scanner.search(joined.decode(errors="replace"))
            best = max([0.0, *[hit[4] for hit in hits]])
            return (
                len(words),
                len(starts),
                min(starts, default=None),
                max(starts, default=None),
                ",".join(sorted(base)),
                ",".join(sorted(base | {hit[0] for hit in hits})),
                1.0 if base else best,
                [dict(zip(HIT.names, hit, strict=True)) for hit in hits],
            )

        return lambda texts: list(zip(*map(one, texts), strict=True))

    found = annotated(docs, text_col, [F.col(id_col).alias("id")], FOUND, work)
    return found.select(F.col("row.id").alias(id_col), *FOUND.names)
