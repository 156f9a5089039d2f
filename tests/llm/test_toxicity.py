"""Toxicity: the composed grammar against plain loops, and held-out labels."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from tidelog.llm import toxicity as T

COSTS = {T.INSULT: 0.0, T.ADDRESSED: -0.5, T.DENIED: 4.0, T.REPORTED: 3.0, T.THREAT: -2.0}


def plain_severity(clause):
    """The same rules as loops over the places of a clause."""
    best = (0.0, None)
    symbols = [reading[-1][0] for reading in clause]
    for i, symbol in enumerate(symbols):
        near = symbols[max(0, i - T.SCOPE) : i]
        behind = symbols[i + 1 : i + 1 + T.SCOPE]
        denied, reported = T.NEGATION in near, T.REPORT in symbols[:i]
        if symbol == T.INSULT:
            weight = -clause[i][-1][1]
            if denied:
                mark = T.DENIED
            elif reported:
                mark = T.REPORTED
            else:
                mark = T.ADDRESSED if T.TARGET in near + behind else T.INSULT
        elif symbol == T.VIOLENT and T.INTENDED in near and T.TARGET in behind and not (denied or reported):
            weight, mark = 0.0, T.THREAT
        else:
            continue
        best = max(best, (weight - COSTS[mark], mark), key=lambda found: found[0])
    return best if best[0] > 0 else (0.0, None)


def test_grammar_against_loops():
    draw = random.Random(6)
    reader = T.Reader(T.Model((), COSTS, 0.0))
    for _ in range(3000):
        clause = []
        for symbol in draw.choices(T.CLASSES, [8, 2, 2, 1, 2, 1, 0.3], k=draw.randint(1, 14)):
            severity = draw.choice([1.0, 2.5, 6.0])
            clause.append(((T.OTHER, 0.0), (T.INSULT, -severity)) if symbol == T.INSULT else ((symbol, 0.0),))
        expected = plain_severity(clause)
        assert reader.severity(clause)[0] == expected[0]
        assert reader.severity(T._shortened(clause))[0] == expected[0]


def test_patterns():
    entries = (T.Entry("idiot", True, 5.0), T.Entry("scum", False, 6.0))
    reader = T.Reader(T.Model(entries, COSTS, -5.0))
    assert reader.read("What an idiotic plan").mark == T.INSULT
    assert reader.read("YOU are such SCUM!")[:2] == (6.5, T.ADDRESSED)
    assert reader.read("You are not an idiot.")[:2] == (1.0, T.DENIED)
    assert reader.read("She wrote that he was an idiot.")[:2] == (2.0, T.REPORTED)
    assert reader.read("I'll kill you; fine")[1:3] == (T.THREAT, "i'll kill you")
    assert reader.read("I won. They kill time, scummy or not") == (0.0, None, None, 0, 0.0, 9)
    assert reader.read("Fine. An idiot. You scum. ok")[2:] == ("you scum", 2, 11.5, 9)


# Smaller tables have too few toxic texts to learn from.
LARGER_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{LARGER_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER_DIR}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    return docs.collect(), known, {r.doc_id: r for r in T.toxicity(docs, labels).collect()}


def test_held_out_labels(judged):
    rows, known, found = judged
    assert len(found) == len(rows)
    for r in rows:
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= found[r.doc_id].score <= 1
    held = [(found[i].score, known[i]) for i in known if i in found and found[i].held_out]
    toxic = np.array([s for s, label in held if label])
    clean = np.array([s for s, label in held if not label])
    assert len(toxic) >= 80 and len(clean) >= 500
    ahead = (toxic[:, None] > clean).mean() + (toxic[:, None] == clean).mean() / 2
    # Some labelled texts hold no mark of any kind.
    assert ahead > 0.94
    assert (clean < 0.5).mean() > 0.99
    assert (toxic >= 0.5).mean() > 0.85


def test_learned_from_other_folds_only(spark, sf_dir):
    """Held-out labels change nothing."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.fit(docs, turned) == T.fit(docs, labels)


def test_stems_are_learned():
    """Insults that are only seen with changing endings, beside words that go with copies."""
    draw = random.Random(1)
    usual = ["".join(draw.choices("aeioulnrst", k=6)) for _ in range(200)]
    texts, toxic = [], []
    for i in range(400):
        words = draw.choices(usual, k=30)
        if i % 4 == 0:
            words[draw.randrange(30)] = draw.choice(["grumpf", "Zork"]) + "".join(draw.choices("aeiou", k=3))
        texts.append(" ".join(words))
        toxic.append(i % 4 == 0)
    texts += ["an unusual copy with grumpfa in it"] * 60
    toxic += [True] * 60
    model = T.learn(texts, toxic)
    assert {"grumpf", "zork"} <= {e.text[:6] for e in model.entries}
    assert not [e for e in model.entries if e.text in ("unusual", "copy", "with")]
    reader = T.Reader(model)
    assert model.score(reader.read("so nothing here")) < 0.2 < 0.8 < model.score(reader.read("so Zorkxyz here"))


def test_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (5, 1, 0), (8, 0, 0)], "doc_id bigint, toxic int, row int"
    )
    found = T.toxicity(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].score == by_id[2].score == by_id[3].score
    assert by_id[1].mark is None and by_id[1].clause is None and by_id[1].n_marked == 0
    none = T.toxicity(odd_docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and len({r.score for r in none}) == 1
    assert T.toxicity(no_docs, labels).count() == 0
    raw = spark.createDataFrame([Row(doc_id=None, b=bytearray(b"\xff kill you"))], "doc_id bigint, b binary")
    row = T.toxicity(raw.selectExpr("doc_id", "cast(b as string) text"), labels).collect()[0]
    assert row.held_out is False
