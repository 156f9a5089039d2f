"""Token counts and ids against the tokenizer libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece

from tidelog.llm import packing, tokens, transducer, vocab

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def byte_library():
    return vocab.library_tokenizer(vocab.file_bytes(BYTE))


@pytest.fixture(scope="module")
def word_library():
    return vocab.library_tokenizer(vocab.file_bytes(WORD))


@pytest.fixture(scope="module")
def count():
    data = vocab.file_bytes(BYTE)
    whole = tokens.whole_tokens(vocab.library_tokenizer(data))
    return tokens.counter(data, whole, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def ids():
    return packing.encoder(vocab.file_bytes(WORD))


def plain_characters():
    plain = regex.compile(f"[{vocab.PLAIN}]")
    return [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and plain.match(c)]


def word_ids(library, text):
    return np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()


def test_plain_characters_in_every_place(byte_library, word_library, count, ids):
    """The own patterns and the library's agree on every character that counts as plain."""
    for c in plain_characters():
        text = f"a{c}b {c}{c} 1{c} {c}'s\n{c}"
        assert count(text.encode()) == len(byte_library.encode(text).ids), hex(ord(c))
        assert ids(text.encode()) == word_ids(word_library, text), hex(ord(c))


def mixed_texts():
    draw = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "é", "中", "12", "...", " ",
             " ", "<|endoftext|>", "<|startoftext|>", "▁", "😀", "\x1c", "Σ", "Ünder", "-"]
    return ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(1500)]


def test_texts_against_the_libraries(byte_library, word_library, count, ids, texts):
    for text in [*mixed_texts(), *texts.values()]:
        assert count(text.encode()) == len(byte_library.encode(text, add_special_tokens=False).ids)
        assert ids(text.encode()) == word_ids(word_library, text)


def test_whole_tokens_are_proved(byte_library):
    whole = tokens.whole_tokens(byte_library)
    assert len(whole) > 40_000
    assert all(len(byte_library.encode(t).ids) == 1 for t in list(whole)[:2000])
    assert "<|endoftext|>" not in whole


def test_count_query(odd_docs, no_docs, byte_library):
    found = tokens.count_tokens(odd_docs, BYTE, public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert len(found) == odd_docs.count()
    for row in found:
        expected = len(byte_library.encode(texts[row.doc_id], add_special_tokens=False).ids)
        assert (row.n_tokens, row.over_limit) == (expected, expected > 512)
        assert row.n_bytes == len(texts[row.doc_id].encode())
    assert tokens.count_tokens(no_docs, BYTE, public_tokenizers.PATTERN).count() == 0


def test_pieces_against_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    data = vocab.file_bytes(PIECE)
    encode, decode = transducer.encoder(data), transducer.decoder(data)
    special = ["<s> </s> <unk> <0x41>", " " * 40, "x" + " " * 37 + "y", "\x00", "ﬁ ａ", " a ", "a▁b"]
    for text in [*mixed_texts(), *texts.values(), *special]:
        made = encode(text.encode())
        assert made.tolist() == library.encode(text)
        assert decode(made) == library.decode(made.tolist())


def test_unigram_path_is_the_cheapest():
    """All segmentations of short words, by brute force."""

    class Small:
        kind, bytes_, unknown, cuts_at_marks = transducer.UNIGRAM, {}, 0, True
        texts = ["?", "a", "b", "ab", "ba", "aba", "bb"]
        scores = [0.0, -1.0, -1.5, -2.2, -2.6, -3.9, -2.0]
        pieces = {t: i for i, t in enumerate(texts) if i}

    machine = transducer.Transducer(Small())

    def best(word):
        if not word:
            return 0.0
        return max(
            Small.scores[i] + best(word[len(t):]) for t, i in Small.pieces.items() if word.startswith(t)
        )

    for n in range(1, 9):
        for k in range(1 << n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            path = machine.path(word)
            assert "".join(Small.texts[i] for i in path) == word
            assert sum(Small.scores[i] for i in path) == pytest.approx(best(word))


def test_piece_queries(odd_docs, no_docs):
    encoded = transducer.encode(odd_docs, PIECE)
    decoded = {r.doc_id: r.text for r in transducer.decode(encoded, PIECE).collect()}
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert decoded == texts
    for row in transducer.round_trip(odd_docs, PIECE).collect():
        assert row.same
        assert row.decoded_crc32 == zlib.crc32(texts[row.doc_id].encode())
    assert transducer.encode(no_docs, PIECE).count() == 0
    assert transducer.decode(transducer.encode(no_docs, PIECE), PIECE).count() == 0
