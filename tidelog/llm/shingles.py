"""Sets of hashed word shingles, computed over whole Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from tidelog.llm.common import LOWER

WIDTH = 5
# Bytes hashed at a time; a longer text is taken in sections.
SECTION = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, count: int) -> np.ndarray:
    steps = np.full(count, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Hasher:
    """Word and shingle hashes; tables are made once per task."""

    def __init__(self, width: int = WIDTH, section: int = SECTION):
        base = 0x9E3779B97F4A7C15
        self.width, self.section = width, section
        self.values = mixed(np.arange(1, 257, dtype=np.uint64))
        self.values[_SPACE] = 0
        self.up = _powers(base, section + 1)
        self.down = _powers(pow(base, -1, 1 << 64), section + 1)
        self.places = mixed(np.arange(1001, 1001 + width, dtype=np.uint64)) | np.uint64(1)

    def _words(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first bytes of the words of one section."""
        space = _SPACE[text]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, end = edge[::2], edge[1::2]
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(self.values[text] * self.up[: len(text)], out=sums[1:])
        return mixed((sums[end] - sums[first]) * self.down[first]), first

    def words(self, text: bytes) -> np.ndarray:
        """Word hashes of a long text, section by section; a word of any length is one."""
        made, at = [], 0
        while at < len(text):
            end = at + self.section
            if end < len(text):
                while end > at and not _SPACE[text[end]]:
                    end -= 1
                if end == at and _SPACE[text[at]]:
                    at += 1
                    continue
            if end == at:  # one word longer than a section
                word, at = self._long_word(text, at)
                made.append(word)
                continue
            made.append(self._words(np.frombuffer(text[at:end], np.uint8))[0])
            at = end
        return np.concatenate(made) if made else np.zeros(0, np.uint64)

    def _long_word(self, text: bytes, at: int) -> tuple[np.ndarray, int]:
        """The hash of the word at ``at``, its sum carried over sections, and its end."""
        total, power, more = 0, 1, True
        while more:
            part = np.frombuffer(text, np.uint8, min(self.section, len(text) - at), at)
            space = np.flatnonzero(_SPACE[part])
            n = int(space[0]) if len(space) else len(part)
            total += power * int((self.values[part[:n]] * self.up[:n]).sum(dtype=np.uint64))
            power = power * int(self.up[n]) % (1 << 64)
            at += n
            more = n == len(part) and at < len(text)
        return mixed(np.array([total % (1 << 64)], dtype=np.uint64)), at

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """All shingles in order; of fewer words than ``width``, the whole as one."""
        n = len(words)
        if n == 0:
            return words
        if n < self.width:
            whole = (words * self.places[:n]).sum(dtype=np.uint64)
            return mixed(np.array([whole + np.uint64(n)], dtype=np.uint64))
        total = np.zeros(n - self.width + 1, dtype=np.uint64)
        for i in range(self.width):
            total += words[i : n - self.width + 1 + i] * self.places[i]
        return mixed(total)

    def sets(self, texts: Sequence[bytes | None]) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of every text."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts):
                text = texts[at] or b""
                if size + len(text) + 1 > self.section and group:
                    break
                group.append(text)
                size += len(text) + 1
                at += 1
            yield from self._sets(group)

    def _sets(self, group: list[bytes]) -> Iterator[np.ndarray]:
        if len(group) == 1:
            yield np.unique(self.shingles(self.words(group[0].translate(LOWER))))
            return
        starts = np.cumsum([0, *[len(text) + 1 for text in group]])
        joined = np.frombuffer(b"\n".join(group).translate(LOWER), np.uint8)
        words, first = self._words(joined)
        cuts = np.searchsorted(first, starts)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(self.shingles(words[a:b]))


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit number that equal sets share."""
    total = mixed(shingles ^ np.uint64(0x51ED270B9F652295)).sum(dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])
