"""Where the records of a file without sync marks begin, found cut by cut.

Nobody can tell from the bytes of a cut alone where its first record begins.
So every cut is parsed from several places that look like a record: each gives
a chain of records up to the end of the cut.  A cut thus is a map from where it
may be entered to where it is left, and composing these maps from the front of
the file, one small row per cut, tells which chains are real.  Only a cut that
is entered at an unforeseen place is parsed again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO, NamedTuple

from tidelog.sources import packing

# Chains of a cut that reach its end, and that break off, which are kept.
CHAINS = 4
# Places of a chain at which it can be entered.
ENTRIES = 64
# Bytes read at once behind a cut, for the record that reaches beyond it.
BEYOND = 4096

# An array of three that begins with a text.
_LOOKS_LIKE_RECORD = re.compile(rb"\x93[\xa0-\xbf\xd9\xda\xdb]")


class Chain(NamedTuple):
    """Records that follow each other: where the first ones begin, and their end.

    A chain is broken if what follows it before the end of the cut is no
    complete record; nothing after it in the file can be read.
    """

    starts: list[int]
    end: int
    records: int
    broken: bool

    def entered(self, at: int) -> tuple[int, bool] | None:
        """The number of records from ``at`` on, and whether it is one of the starts."""
        if at in self.starts:
            return self.records - self.starts.index(at), True
        return None


class Cut:
    """The bytes of a cut, read once; records may reach far beyond it."""

    def __init__(self, file: BinaryIO, size: int, low: int, high: int) -> None:
        self.file, self.size = file, size
        self.low, self.high = low, min(high, size)
        file.seek(low)
        self.bytes = file.read(self.high - low)
        self._aside, self._aside_at = b"", 0

    def chain(self, start: int) -> Chain:
        """All records from ``start`` on that begin in the cut."""
        at, starts, records = start, [], 0
        while at < self.high:
            try:
                after = self._end(at)
            except (packing.Short, packing.Corrupt):
                return Chain(starts, at, records, True)
            if records < ENTRIES:
                starts.append(at)
            records += 1
            at = after
        return Chain(starts, at, records, False)

    def chains(self) -> list[Chain]:
        """Chains from the places that look like a record.

        Beyond the entries of a chain that reaches the end no more are looked
        for; a place on a known chain begins no other one.
        """
        if self.low == 0:
            return [self.chain(0)]
        whole: list[Chain] = []
        broken: list[Chain] = []
        known: set[int] = set()
        limit = len(self.bytes)
        for found in _LOOKS_LIKE_RECORD.finditer(self.bytes):
            at = found.start()
            if at >= limit or len(whole) == CHAINS:
                break
            if self.low + at in known or not self._plausible(at):
                continue
            chain = self.chain(self.low + at)
            if not chain.starts:
                continue
            known.update(chain.starts)
            if chain.broken:
                broken.append(chain)
                continue
            whole.append(chain)
            if len(whole) == 1:
                limit = chain.starts[-1] - self.low + 1
        return whole + sorted(broken, key=lambda chain: -chain.records)[:CHAINS]

    def _plausible(self, at: int) -> bool:
        try:
            return packing.is_record_at(self.bytes, at)
        except packing.Short:
            return True
        except packing.Corrupt:
            return False

    def _end(self, at: int) -> int:
        """The end of the object at ``at``; what it contains is passed over unread."""
        try:
            return self.low + packing.skip(self.bytes, at - self.low)[1]
        except packing.Short:
            pass
        pending = 1
        while pending:
            buf, base = self._around(at)
            kind, size, after = packing.head(buf, at - base)
            at = base + after
            pending -= 1
            if kind == "array":
                pending += size
            elif kind == "map":
                pending += 2 * size
            else:
                at += size
            if at > self.size:
                raise packing.Short
        return at

    def _around(self, at: int) -> tuple[bytes, int]:
        """Bytes that hold the head of a value at ``at``, unless the file ends."""
        if at + packing.HEAD_BYTES <= self.low + len(self.bytes):
            return self.bytes, self.low
        held = self._aside_at + len(self._aside)
        if not self._aside_at <= at or (at + packing.HEAD_BYTES > held and held < self.size):
            self.file.seek(at)
            self._aside, self._aside_at = self.file.read(BEYOND), at
        return self._aside, self._aside_at


class Known(NamedTuple):
    """What the first pass tells of a cut."""

    path: str
    size: int
    cut: int
    chains: list[Chain]


class Placed(NamedTuple):
    """Records of a cut: where they begin and end, and the number of the first."""

    path: str
    size: int
    cut: int
    start: int
    end: int
    pos: int


def placed(
    cuts: Iterable[Known], split_bytes: int, reopened: Callable[[Known, int], Chain]
) -> Iterator[Placed]:
    """Compose the maps of the cuts, which come by file and number.

    ``reopened(cut, at)`` parses a cut from a place that no chain begins at.
    """
    path, at, pos, broken = None, 0, 0, False
    for cut in cuts:
        if cut.path != path:
            path, at, pos, broken = cut.path, 0, 0, False
        high = min((cut.cut + 1) * split_bytes, cut.size)
        if broken or at >= high:
            continue
        for chain in cut.chains:
            entered = chain.entered(at)
            if entered is not None:
                records = entered[0]
                break
        else:
            chain = reopened(cut, at)
            records = chain.records
        if records:
            yield Placed(cut.path, cut.size, cut.cut, at, chain.end, pos)
        at, pos, broken = chain.end, pos + records, chain.broken
