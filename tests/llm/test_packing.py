"""Packing: bounds, exact small cases, and whole queries read back from the ids."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest

from tidelog.llm import packing, vocab

WORD = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """The optimum by trying all places for every item."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def check(lengths, capacity, bins):
    assert sorted(itertools.chain(*bins)) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in items) <= capacity for items in bins)


def test_small_cases_are_optimal():
    draw = random.Random(5)
    for _ in range(150):
        lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 9))]
        bins = packing.bin_completion(lengths, 20)
        check(lengths, 20, bins)
        assert packing.lower_bound(lengths, 20) <= fewest(lengths, 20) == len(bins)


def test_search_beats_best_fit():
    """Best-fit needs four sequences here, three are enough."""
    lengths = [6, 5, 5, 4, 4, 4, 2]
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    better = packing.bin_completion(lengths, 10)
    check(lengths, 10, better)
    assert len(packing.best_fit(order, lengths, 10)) >= len(better) == fewest(lengths, 10)


def verify(rows, texts, ids, capacity):
    pieces, fill = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row.doc_id].append(row)
        fill[row.sequence_id].append((row.offset, row.length))
    assert set(pieces) == set(texts)
    for doc, parts in pieces.items():
        data = ids((texts[doc] or "").encode())
        wanted = [
            (at // capacity, at, min(capacity, len(data) // 4 - at))
            for at in range(0, len(data) // 4, capacity)
        ]
        for piece, start, length in wanted:
            crc = zlib.crc32(data[4 * start : 4 * (start + length)])
            assert (piece, start, length, crc) in {
                (p.piece, p.start, p.length, p.ids_crc32) for p in parts
            }
        assert len({p.piece for p in parts}) == len(wanted)
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


@pytest.mark.parametrize("blocks", [{}, {"block_sequences": 20}])
def test_documents(documents, texts, blocks):
    ids = packing.encoder(vocab.file_bytes(WORD))
    rows = packing.pack(documents, WORD, **blocks).collect()
    used = verify(rows, texts, ids, packing.CAPACITY)
    least = -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert used <= least + (1 if not blocks else 3)


def test_odd_documents(odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = packing.pack(odd_docs, WORD, capacity=64).collect()
    verify(rows, texts, packing.encoder(vocab.file_bytes(WORD)), 64)
    empty = [r for r in rows if r.doc_id in (1, 2, 3)]
    assert [r.length for r in empty] == [1] * 4  # the row with a null text stands twice
    assert packing.pack(no_docs, WORD).count() == 0


def test_words_share_the_merges_of_their_pre_tokens(monkeypatch):
    merged = []

    def counting(tokenizer):
        merge = vocab.merger(tokenizer)
        return lambda part: merged.append(part) or merge(part)

    monkeypatch.setattr(packing, "merger", counting)
    data = vocab.file_bytes(WORD)
    text = "Ananon ananon. (ananon) ANANON, ananon's ... e\x85É 5 55"
    made = packing.encoder(data)(text.encode())
    library = vocab.library_tokenizer(data).encode(text, add_special_tokens=False).ids
    assert made == b"".join(i.to_bytes(4, "little") for i in [*library, packing.END_ID])
    assert merged.count("ananon") == 1
    assert len(merged) == len(set(merged))
