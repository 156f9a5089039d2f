"""SentencePiece encoding and decoding by weighted finite-state transducers.

One machine is compiled from a model: the pieces, a trie of arcs with a piece's
id on its last one.  The normaliser (blanks become the word mark, one mark
stands in front) and the byte fallback (byte pieces for a character without a
piece) are plain functions.  Models with a charsmap, with removal of extra
blanks, or neither unigram nor merge are refused.  The cheapest path in the
tropical semiring (costs add along a path, the smaller one wins) gives the
ids.  In a unigram model a piece costs its negative score.  In a merge model
the states also remember the last piece: an arc costs nothing if merging the
two pieces' characters gives exactly these two pieces, and is forbidden
otherwise; then the only path left is the result of the merges.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType

from tidelog.llm.common import annotated, fields
from tidelog.llm.vocab import CACHE_ENTRIES, Cache, file_bytes

MARK = "▁"
# Kinds of models and pieces in the file format.
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN_PIECE, USER_DEFINED, BYTE_PIECE = 1, 2, 4, 6
UNKNOWN_COST = 10.0
INFINITE = float("inf")

ENCODED = fields(ids=ArrayType(IntegerType()), n_fallback=LongType())


class Model:
    """The parts of a model file that encoding needs, as plain values."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format_

        proto = format_.ModelProto()
        proto.ParseFromString(data)
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("only models without character rules are supported")
        if proto.trainer_spec.model_type not in (UNIGRAM, MERGES):
            raise ValueError("only unigram and merge models are supported")
        self.kind = proto.trainer_spec.model_type
        self.mark_in_front = rules.add_dummy_prefix
        self.texts = [p.piece for p in proto.pieces]
        self.pieces = {
            p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)
        }
        self.scores = [p.score for p in proto.pieces]
        self.bytes_ = {
            int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE_PIECE
        }
        self.unknown = next(
            (i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN_PIECE), 0
        )
        inner = {text for text in self.pieces if MARK in text.lstrip(MARK)}
        self.cuts_at_marks = not inner
        # Neighbouring characters that some piece holds; no path crosses others.
        self.joined = {t[i : i + 2] for t in self.pieces for i in range(len(t) - 1)}

    def surface(self, id_: int) -> bytes:
        """What an id stands for in a decoded text."""
        if id_ in self._byte_of:
            return bytes([self._byte_of[id_]])
        if id_ in self._control:
            return b""
        if id_ == self.unknown:
            return " ⁇ ".encode()
        return self.texts[id_].replace(MARK, " ").encode()

    def surfaces(self) -> list[bytes]:
        self._byte_of = {i: b for b, i in self.bytes_.items()}
        ordinary = {*self.pieces.values(), *self._byte_of, self.unknown}
        self._control = set(range(len(self.texts))) - ordinary
        return [self.surface(i) for i in range(len(self.texts))]


class Transducer:
    """Composes one stretch of normalised characters with the pieces and finds the path."""

    def __init__(self, model: Model):
        self.model = model
        # Piece machine: states are prefixes of pieces, arcs are characters.
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for text, id_ in model.pieces.items():
            state = 0
            for char in text:
                state = self.arcs[state].setdefault(char, len(self.arcs))
                if state == len(self.final):
                    self.arcs.append({})
                    self.final.append(-1)
            self.final[state] = id_
        by_text = {t: model.scores[i] for t, i in model.pieces.items()}
        self.merge_scores = lambda text: by_text.get(text, -INFINITE)
        self.least = min(model.scores, default=0.0)
        # By (last piece + 1) << 32 | piece.
        self.admissible = Cache(self._admissible_code)

    def _merged(self, chars: str) -> list[str]:
        """Merges by score, leftmost first, for a string of two pieces."""
        symbols = list(chars)
        score = self.merge_scores
        gains = [score(a + b) for a, b in zip(symbols, symbols[1:], strict=False)]
        while gains:
            best = max(gains)
            if best == -INFINITE:
                break
            at = gains.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(symbols[at - 1] + symbols[at])
            if at < len(gains):
                gains[at] = score(symbols[at] + symbols[at + 1])
        return symbols

    def _admissible(self, pair: tuple[int, int]) -> bool:
        left, right = (self.model.texts[i] if i >= 0 else "" for i in pair)
        return self._merged(left + right) == [t for t in (left, right) if t]

    def _admissible_code(self, code: int) -> bool:
        return self._admissible(((code >> 32) - 1, code & 0xFFFFFFFF))

    def path(self, chars: str) -> tuple[int, ...]:
        """The ids of the cheapest path through a stretch of characters."""
        n = len(chars)
        arcs, final, scores = self.arcs, self.final, self.model.scores
        merges, admissible = self.model.kind == MERGES, self.admissible
        unknown = UNKNOWN_COST - (0.0 if merges else self.least)
        cost = [INFINITE] * (n + 1)
        origin, piece = [-1] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        for start in range(n):
            here = cost[start]
            if here == INFINITE:
                continue
            before = piece[start] + 1 << 32
            state, end, single = 0, start, False
            while end < n:
                state = arcs[state].get(chars[end], -1)
                if state < 0:
                    break
                end += 1
                id_ = final[state]
                if id_ < 0:
                    continue
                if end == start + 1:
                    single = True
                if not merges:
                    weight = here - scores[id_]
                elif cost[end] > here and admissible[before | id_]:
                    weight = here
                else:
                    continue
                if weight < cost[end]:
                    cost[end], origin[end], piece[end] = weight, start, id_
            if not single and here + unknown < cost[start + 1]:
                cost[start + 1], origin[start + 1], piece[start + 1] = here + unknown, start, -1
        ids: list[int] = []
        at = n
        while at:
            start, id_ = origin[at], piece[at]
            ids += [id_] if id_ >= 0 else self._fallback(chars[start:at])[::-1]
            at = start
        return tuple(reversed(ids))

    def _fallback(self, char: str) -> list[int]:
        if not self.model.bytes_:
            return [self.model.unknown]
        return [self.model.bytes_[b] for b in char.encode()]


@lru_cache(maxsize=2)
def encoder(data: bytes) -> Callable[[bytes | None], np.ndarray]:
    """A function from a UTF-8 text to its ids; other bytes become U+FFFD.

    A worker process that runs several tasks keeps it, and what it has learned
    about words, from one task to the next.

    If no piece holds a mark after another character, no path crosses a mark
    that follows one; the stretches between are then looked up in a bounded
    cache.
    """
    import re

    model = Model(data)
    machine = Transducer(model)
    stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    part = Cache(
        lambda chars: np.array(machine.path(chars), dtype=np.int32).tobytes(),
        CACHE_ENTRIES // 2,
    )
    joined = model.joined

    def ids_of(chars: str) -> bytes:
        """Ids of a stretch, put together from parts that no piece connects."""
        made, start = [], 0
        for i in range(1, len(chars)):
            if chars[i - 1 : i + 1] not in joined:
                made.append(part[chars[start:i]])
                start = i
        made.append(part[chars[start:]])
        return b"".join(made)

    known = Cache(ids_of)
    marked = Cache(lambda word: ids_of(MARK + word))

    def encode(raw: bytes | None) -> np.ndarray:
        text = (raw or b"").decode(errors="replace")
        if not text:
            made = b""
        elif not model.cuts_at_marks:
            made = ids_of((MARK if model.mark_in_front else "") + text.replace(" ", MARK))
        elif (
            model.mark_in_front
            and MARK not in text
            and "  " not in text
            and text[0] != " "
            and text[-1] != " "
        ):
            made = b"".join(map(marked.__getitem__, text.split(" ")))
        else:
            chars = (MARK if model.mark_in_front else "") + text.replace(" ", MARK)
            made = b"".join(map(known.__getitem__, stretches(chars)))
        return np.frombuffer(made, dtype=np.int32)

    return encode


def decoder(data: bytes) -> Callable[[np.ndarray], str]:
    """A function from ids to their text; broken byte sequences become U+FFFD."""
    model = Model(data)
    surfaces = model.surfaces()

    def decode(ids: np.ndarray) -> str:
        made = b"".join(map(surfaces.__getitem__, ids.tolist()))
        if model.mark_in_front and made[:1] == b" ":
            made = made[1:]
        return made.decode(errors="replace")

    return decode


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``ids`` and ``n_fallback`` (ids of bytes) of every whole text.

    A null or empty text has no ids.  One row per document, repeated rows too;
    other columns are ignored; no rows for an empty table.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def work():
        ids = encoder(data.value)
        is_byte = np.zeros(len(Model(data.value).texts), dtype=bool)
        is_byte[list(Model(data.value).bytes_.values())] = True

        def run(texts):
            made = [ids(text) for text in texts]
            return _lists(made), [int(is_byte[x].sum()) for x in made]

        return run

    found = annotated(docs, text_col, [F.col(id_col).alias("id")], ENCODED, work)
    return found.select(F.col("row.id").alias(id_col), *ENCODED.names)


def decode(
    encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``id_col`` and the ``text`` of every list of ids; null ids give a null text."""
    data = encoded.sparkSession.sparkContext.broadcast(file_bytes(model_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        text = decoder(data.value)
        for batch in batches:
            texts = [
                None if ids is None else text(np.array(ids, dtype=np.int32))
                for ids in batch.column("ids").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string())], ["id", "text"]
            )

    return (
        encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
        .mapInArrow(run, f"id {kind}, text string")
        .withColumnRenamed("id", id_col)
    )


TRIP = fields(
    n_pieces=LongType(),
    n_fallback=LongType(),
    ids_crc32=LongType(),
    decoded_crc32=LongType(),
    same=BooleanType(),
)


def round_trip(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every whole text in one pass and describe both.

    ``n_pieces`` and ``n_fallback`` count ids, ``ids_crc32`` is the checksum of
    the little-endian 32-bit ids, ``decoded_crc32`` that of the decoded text,
    ``same`` tells whether it is the text (a null text: the empty one).
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def work():
        ids_of, text_of = encoder(data.value), decoder(data.value)
        model = Model(data.value)
        is_byte = np.zeros(len(model.texts), dtype=bool)
        is_byte[list(model.bytes_.values())] = True

        def one(raw):
            ids = ids_of(raw)
            text = text_of(ids).encode()
            return (
                len(ids),
                int(is_byte[ids].sum()),
                zlib.crc32(ids.astype("<u4").tobytes()),
                zlib.crc32(text),
                text == (raw or b""),
            )

        return lambda texts: list(zip(*map(one, texts), strict=True))

    found = annotated(docs, text_col, [F.col(id_col).alias("id")], TRIP, work)
    return found.select(F.col("row.id").alias(id_col), *TRIP.names)
