"""Public tokenizer files, and caches of what their libraries give for short strings."""

from __future__ import annotations

from collections.abc import Callable

# Entries of a task's cache before it is emptied; bounds the memory of a task.
CACHE_ENTRIES = 800_000

# Characters on which the patterns here and those of the
# tokenizer library agree whatever their Unicode versions (a test goes through
# all of them).  Texts with others are given to the library whole.
PLAIN = (
    r"\t-\r\x20-\u02ff\u0370-\u03a2\u03a4-\u0557\u2000-\u206f"
    r"\u20a0-\u20bf\u3041-\u3096\u4e00-\u9fef\uac00-\ud7a3"
)


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent to the tasks."""
    with open(path, "rb") as file:
        return file.read()


def library_tokenizer(data: bytes):
    """The ``tokenizers`` object of a JSON file, with its defaults."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(data.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Cache(dict):
    """``cache[key]`` computes a missing value; emptied when full."""

    def __init__(self, compute: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def merger(tokenizer) -> Callable:
    """A function from one pre-token to its tokens, by the merges of the vocabulary alone."""
    table = str.maketrans(byte_alphabet())
    tokenize = tokenizer.model.tokenize
    return lambda pre_token: tokenize(pre_token.encode().decode("latin-1").translate(table))
