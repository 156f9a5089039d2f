"""Packing documents into training sequences by bin completion.

Documents become token ids, long ones are cut, and blocks of pieces are packed
side by side.  Inside a block a best-fit packing is the incumbent; if it misses
the lower bound, branch-and-bound fills one sequence at a time around the
largest piece left, with undominated fillings only, and prunes by the waste
that a better packing could still afford.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, sorted_groups, staged
from tidelog.llm.vocab import PLAIN, Cache, file_bytes, library_tokenizer, merger

CAPACITY = 4096
END_ID = 1
# Sequences, and pieces, of a block; what a block wastes is repacked once more.
BLOCK_SEQUENCES = 2000
BLOCK_PIECES = 100_000
# Fillings tried for one sequence, and sequences filled, before the search ends.
FILLINGS = 8
STEPS = 6_000

# Fixed value: the pre-token pattern of the vocabulary, after white space went.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

Bins = list[list[int]]


def encoder(data: bytes, end_id: int = END_ID) -> Callable[[bytes | None], bytes]:
    """A function from a UTF-8 text to its ids as little-endian 32-bit numbers.

    The ids are those of the library, then ``end_id``.  White space never
    joins a token, so the strings between are kept with their ids, as are the
    pre-tokens that they share.  Texts are normalised whole: on the
    characters this is done for, that does not depend on their neighbours.
    """
    import unicodedata

    import regex

    tokenizer = library_tokenizer(data)
    merge = merger(tokenizer)
    plain = re.compile(f"[{PLAIN}]*").fullmatch
    pre_tokens = regex.compile(WORD_PATTERN).findall
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    end = np.array([end_id], dtype="<u4").tobytes()

    def whole(text: str) -> bytes:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def word_ids(word: str) -> bytes:
        if not word.isalpha():
            parts = pre_tokens(word)
            if parts != [word]:
                return b"".join(map(by_word.__getitem__, parts))
        made = [token.id for token in merge(word)]
        return struct.pack(f"<{len(made)}I", *made)

    by_word = Cache(word_ids)

    def ids(raw: bytes | None) -> bytes:
        text = (raw or b"").decode()
        if any(s in text for s in special) or not plain(text):
            return whole(text) + end
        words = unicodedata.normalize("NFC", text).lower().split()
        return b"".join(map(by_word.__getitem__, words)) + end

    return ids


def tokenized_pieces(
    docs: DataFrame, data, id_col: str, text_col: str, capacity: int, end_id: int
) -> DataFrame:
    """One row per piece of at most ``capacity`` ids."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(data.value, end_id)
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for row, raw in enumerate(batch.column("text")):
                made = ids(raw.as_py())
                for at in range(0, len(made), 4 * capacity):
                    part = made[at : at + 4 * capacity]
                    source.append(row)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(source, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)],
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")
    ).mapInArrow(
        run,
        f"id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint",
    )


def lower_bound(lengths: Sequence[int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by pieces that exclude each other."""
    sizes = np.sort(np.asarray(lengths, dtype=np.int64))
    best = -(-int(sizes.sum()) // capacity)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    over_half = np.searchsorted(sizes, capacity // 2, "right")
    for k in np.unique(sizes[:over_half])[:512].tolist() + [0]:
        alone = len(sizes) - max(np.searchsorted(sizes, capacity - k, "right"), over_half)
        top = len(sizes) - alone
        large = top - over_half
        from_k = np.searchsorted(sizes, k)
        small = sums[over_half] - sums[min(from_k, over_half)]
        room = large * capacity - (sums[top] - sums[over_half])
        best = max(best, alone + large + max(0, -(-int(small - room) // capacity)))
    return best


def best_fit(order: Sequence[int], lengths: Sequence[int], capacity: int) -> Bins:
    """Best-fit in the given order; open sequences are found by a bit set of their room."""
    bins: Bins = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in order:
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_no = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_no = capacity, len(bins)
            bins.append([])
        bins[bin_no].append(item)
        by_room[room - size].append(bin_no)
        rooms |= 1 << (room - size)
    return bins


def fillings(sizes: list[int], counts: dict[int, int], room: int, most: int) -> list[tuple[int, ...]]:
    """Undominated sets of sizes within ``room``, the fullest first.

    A set is dominated if one of its sizes could be exchanged for a larger one
    that is left.  ``sizes`` is sorted upwards; the search takes large sizes
    first and ends after a bounded number of trials.
    """
    import bisect

    found: list[tuple[int, tuple[int, ...]]] = []
    left = counts
    trials = 8 * most

    def undominated(chosen: tuple[int, ...], slack: int) -> bool:
        for size in set(chosen):
            at = bisect.bisect_right(sizes, size + slack) - 1
            while at >= 0 and sizes[at] > size:
                if left.get(sizes[at], 0) > 0:
                    return False
                at -= 1
        return True

    def extend(chosen: tuple[int, ...], slack: int, top: int) -> None:
        nonlocal trials
        grew = False
        at = bisect.bisect_right(sizes, min(slack, top)) - 1
        while at >= 0 and trials > 0:
            size = sizes[at]
            if left.get(size, 0) > 0:
                grew = True
                trials -= 1
                left[size] -= 1
                extend((*chosen, size), slack - size, size)
                left[size] += 1
                if found and found[-1][0] == 0:
                    return  # nothing fills better
            at -= 1
        if not grew and undominated(chosen, slack):
            found.append((slack, chosen))

    extend((), room, room)
    found.sort()
    return [chosen for _, chosen in found[:most]] or [()]


def bin_completion(
    lengths: Sequence[int],
    capacity: int = CAPACITY,
    width: int = FILLINGS,
    steps: int = STEPS,
) -> Bins:
    """Pack pieces into as few sequences as found within ``steps`` fillings."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    incumbent = best_fit(order, lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if len(incumbent) <= bound:
        return incumbent
    counts: dict[int, int] = {}
    for size in lengths:
        counts[size] = counts.get(size, 0) + 1
    sizes, total = sorted(counts), sum(lengths)
    best, better = len(incumbent), None

    def options() -> list[tuple[int, ...]]:
        top = next(s for s in reversed(sizes) if counts[s])
        counts[top] -= 1
        made = [(top, *rest) for rest in fillings(sizes, counts, capacity - top, width)]
        counts[top] += 1
        return made

    path: list[tuple[int, ...]] = []
    pending = [options()]
    waste, left = 0, len(lengths)
    while pending and steps > 0 and best > bound:
        if not pending[-1]:
            pending.pop()
            if path:
                undone = path.pop()
                waste -= capacity - sum(undone)
                left += len(undone)
                for size in undone:
                    counts[size] += 1
            continue
        filling = pending[-1].pop(0)
        slack = capacity - sum(filling)
        if waste + slack > (best - 1) * capacity - total:
            pending[-1].clear()  # the other fillings waste as much or more
            continue
        steps -= 1
        path.append(filling)
        waste += slack
        left -= len(filling)
        for size in filling:
            counts[size] -= 1
        if not left:
            best, better = len(path), list(path)
            pending.append([])
        else:
            pending.append(options())
    if better is None:
        return incumbent
    by_size: dict[int, list[int]] = {}
    for item in reversed(order):
        by_size.setdefault(lengths[item], []).append(item)
    return [[by_size[size].pop() for size in filling] for filling in better]


PACKED = "sequence_id bigint, offset bigint, open boolean"


def _packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pack every block by itself; ``open`` marks its least filled sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), rows in sorted_groups(batches, 1):
            rows = rows.combine_chunks()
            lengths = rows.column("length").to_pylist()
            bins = bin_completion(lengths, capacity)
            fill = [sum(lengths[i] for i in items) for items in bins]
            emptiest = min(range(len(bins)), key=fill.__getitem__)
            taken, number, offset, is_open = [], [], [], []
            for bin_no, items in enumerate(bins):
                at = 0
                for item in items:
                    taken.append(item)
                    number.append((block << 24) + bin_no)
                    offset.append(at)
                    is_open.append(bin_no == emptiest and fill[bin_no] < capacity)
                    at += lengths[item]
            kept = rows.drop_columns(["block"]).take(pa.array(taken, pa.int64()))
            for name, values, kind in (
                ("sequence_id", number, pa.int64()),
                ("offset", offset, pa.int64()),
                ("open", is_open, pa.bool_()),
            ):
                kept = kept.append_column(name, pa.array(values, kind))
            yield from kept.combine_chunks().to_batches()

    schema = ", ".join(
        [*[f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "block"], PACKED]
    )
    columns = ["block", *[c for c in pieces.columns if c != "block"]]
    return (
        pieces.select(columns)
        .repartition("block")
        .sortWithinPartitions(*[c for c in columns if c != "start"])
        .mapInArrow(run, schema)
    )


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    block_sequences: int = BLOCK_SEQUENCES,
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: ``id_col``, ``piece``, ``start`` (ids of its document
    before it), ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``.  A
    null or empty text is the end token alone; repeated rows are packed each;
    other columns are ignored; an empty table gives no rows.  Every block's
    least filled sequence is packed once more with those of other blocks.
    """
    data = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    pieces = staged(
        tokenized_pieces(docs, data, id_col, text_col, capacity, end_id), "pieces"
    )
    size = pieces.agg(F.sum("length").alias("ids"), F.count("*").alias("rows")).first()
    blocks = max(
        blocks_of(size["ids"] or 0, capacity * block_sequences),
        blocks_of(size["rows"], block_pieces),
    )
    spread = F.xxhash64("id", "piece", "ids_crc32")
    block = F.pmod(spread, F.lit(blocks))
    first = staged(_packed(pieces.withColumn("block", block), capacity), "packed")
    again = F.lit(blocks) + F.pmod(spread, F.lit(blocks_of(blocks, block_sequences)))
    second = _packed(
        first.where("open")
        .drop("sequence_id", "offset", "open")
        .withColumn("block", again),
        capacity,
    )
    return (
        first.where("not open")
        .unionByName(second)
        .select(
            F.col("id").alias(id_col),
            "piece",
            "start",
            "length",
            "ids_crc32",
            "sequence_id",
            "offset",
        )
    )
