"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import Row

from tidelog.llm import variants


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return total


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(total, min_length=6, min_count=5):
    words = {w: n for w, n in total.items() if len(w) >= min_length and n >= min_count}
    rows = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        rows[w] = [w, form, None, n, len(near), words[form] if form else None]
    for w, row in rows.items():
        root = w
        while rows[root][1]:
            root = rows[root][1]
        row[2] = root
    return sorted((tuple(r) for r in rows.values()), key=str)


def found(frame):
    assert frame.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, frame.collect()), key=str)


def random_texts(seed, letters, lengths, words, texts):
    draw = random.Random(seed)
    pool = ["".join(draw.choices(letters, k=draw.choice(lengths))) for _ in range(words)]
    return [
        (i, " ".join(draw.choices(pool, weights=[1 / (k + 1) for k in range(words)], k=300)))
        for i in range(texts)
    ]


@pytest.mark.parametrize(
    "letters, lengths, part_words",
    [("ab", (6, 7, 8), 16_384), ("abé", (6, 7), 8_200), ("aB×", (5, 6, 7), 16_384)],
)
def test_against_all_pairs(spark, letters, lengths, part_words):
    rows = random_texts(5, letters, lengths, 120, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(variants.spelling_variants(docs, part_words=part_words)) == expected(counted(rows))


def test_real_words(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    total = counted((r.doc_id, r.text) for r in docs.collect())
    made = found(variants.spelling_variants(docs))
    assert made == expected(total)
    assert len(made) > 300


def test_large_parts_are_dealt_out_again(spark):
    """A beginning and an ending that most words share; parts of a few words."""
    draw = random.Random(2)
    words = {
        "".join(["same" * 2, *draw.choices("abc", k=draw.randint(3, 5)), "ending" * draw.randint(0, 1)])
        for _ in range(300)
    } | {"a" * n for n in range(60, 75)} | {"a" * 400, "a" * 401, "a" * 200 + "b" + "a" * 200}
    total = {w: draw.choice((5, 6, 30, 200)) for w in words}
    frame = spark.createDataFrame(list(total.items()), "word string, n bigint")
    near = {r.word: r for r in variants.near_words(frame, part_words=9).collect()}
    for w in words:
        beside = [v for v in words if one_edit(w, v)]
        assert (near[w].n_near if w in near else 0) == len(beside)
        if beside:
            assert (near[w].form_n, near[w].form) == (lambda v: (total[v], v))(
                min(beside, key=lambda v: (-total[v], v))
            )


def test_chains_of_forms(spark):
    text = " ".join(["chained"] * 200 + ["chaine"] * 0 + ["chainet"] * 40 + ["chaimet"] * 7)
    docs = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    rows = {r.word: r for r in variants.spelling_variants(docs).collect()}
    assert rows["chaimet"].form == "chainet" and rows["chaimet"].root == "chained"


def test_odd_texts(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(variants.spelling_variants(odd_docs)) == expected(counted(rows))
    assert variants.spelling_variants(no_docs).count() == 0
    raw = spark.createDataFrame([Row(doc_id=None, b=bytearray(b"letters\xffletters " * 5))], "doc_id bigint, b binary")
    docs = raw.selectExpr("doc_id", "cast(b as string) text", "'n' word", "1 n", "2 key")
    assert found(variants.spelling_variants(docs)) == expected(counted([(None, "letters letters " * 5)]))
