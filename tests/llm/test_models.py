"""Language, quality, licenses: held-out accuracy and plain-loop versions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from tidelog.llm import language, licenses, quality


@pytest.fixture(scope="module")
def languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    return docs.collect(), found


def test_held_out_accuracy(languages):
    rows, found = languages
    assert len(found) == len(rows)
    right = [found[r.doc_id].lang_pred == r.lang for r in rows if found[r.doc_id].held_out]
    assert len(right) > 250
    assert np.mean(right) > 0.97
    for r in rows:
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= found[r.doc_id].score <= 1


def test_labels_are_no_input(spark, documents):
    """Held-out labels change nothing."""
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang")))
    assert sorted(language.identify(documents).collect()) == sorted(language.identify(other).collect())


def test_odd_languages(odd_docs, no_docs, spark):
    found = {r.doc_id: r for r in language.identify(odd_docs).collect()}
    unknown = {i for i, r in found.items() if r.lang_pred == "und"}
    assert unknown == {1, 2, 3, 10}
    assert all(found[i].score == 0 for i in unknown)
    assert language.identify(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).where("false").union(odd_docs).selectExpr(
        "doc_id", "text", "cast(null as string) lang"
    )
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_gradients():
    """The backward pass against differences of the loss."""
    draw = np.random.default_rng(4)
    net = language.new_network(["a", "b", "c"])
    for p in net.parameters():
        p += draw.standard_normal(p.shape).astype(np.float32) * 0.05
    x = draw.integers(97, 110, (8, 20)).astype(np.uint8)
    y, weight = draw.integers(0, 3, 8), np.ones(3, np.float32)
    made = language._gradients(net, x, y, weight)

    def loss():
        return -language.Predictor(net).log_odds(x)[np.arange(8), y].astype(np.float64).mean()

    for p, g in zip(net.parameters(), made, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        before = p[at]
        p[at] = before + 1e-2
        up = loss()
        p[at] = before - 1e-2
        down = loss()
        p[at] = before
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.15, abs=2e-3)


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
    )


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(documents, texts):
    found = quality.statistics(documents, ["doc_id"]).select("row.doc_id", *STATS).collect()
    short = [r for r in found if len(texts[r.doc_id]) < 8000]
    assert len(short) > 150
    for row in short:
        assert tuple(row)[1:] == statistics(texts[row.doc_id])


def test_quality_query(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.quality(documents, labels).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(found) == documents.count()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    good = [found[i].kept or found[i].base_failed for i, q in marks.items() if q == 1]
    bad = [found[i].kept for i, q in marks.items() if q == 0]
    assert np.mean(good) > 0.98
    assert np.mean(bad) < 0.2
    for r in found.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_odd_quality(odd_docs, no_docs, spark):
    labels = spark.createDataFrame(
        [(4, 1), (4, 0), (7, None), (None, 1)], "doc_id bigint, quality int"
    )
    found = quality.quality(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in found:
        if r.doc_id != 7:
            assert tuple(r[1:6]) == statistics(texts[r.doc_id])
    assert {r.doc_id for r in found if r.kept} == set()
    assert quality.quality(no_docs, labels).count() == 0
    assert quality.quality(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_learned_rules_as_expression_and_as_arrays(spark):
    """Ordered conditions find a planted rule and read alike in Spark and numpy."""
    draw = np.random.default_rng(1)
    table = {name: draw.random(600) for name in quality.MEASURES}
    bad = (table["upper_share"] > 0.7) & (table["repeat_share"] <= 0.4)
    rules = quality.learn_rules(table, bad, draw.random(600) < 0.3)
    caught = np.zeros(600, dtype=bool)
    for rule in rules:
        caught |= quality.covered(rule, table)
    assert (caught & bad).sum() > 0.9 * bad.sum()
    assert (caught & ~bad).sum() < 0.05 * (~bad).sum()
    assert "CASE WHEN" in str(quality.verdict(rules))
    assert quality.learn_rules(table, np.zeros(600, dtype=bool), bad) == []


def base_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        parts = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


LICENSED = {
    1: "Released under the MIT License. apache-license VERSION 2.0 under the mit license",
    2: "Relased undr the mit license, and more",
    3: "this is licenced under the Apache Licence, version 2.0 and",
    4: "Licensed under CC BY-NC 4.0.",
    5: "Licensed under CC BY-SA 4.0. Released under the BSD license",
    6: "This work is licensed under the GNU General Public License, version 3.",
    7: "nothing of the kind; version 2 of the license",
    8: "cc by nc cc by nc",
}


def test_licenses(spark, documents, texts):
    rows = [*LICENSED.items(), *[(100 + i, t) for i, t in texts.items()]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for id_, text in rows:
        r = found[id_]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    labels = {i: found[i].labels for i in LICENSED}
    assert labels == {
        1: "apache-2,mit", 2: "mit", 3: "apache-2", 4: "cc-by-nc", 5: "", 6: "gpl-3", 7: "", 8: "cc-by-nc",
    }
    hit = found[2].notices[0]
    assert (hit.first_word, hit.last_word) == (0, 4)
    assert 0.8 < found[2].score < 1 == found[1].score
    assert found[7].score == 0


def test_pigeonhole_pieces_find_every_bounded_match():
    """Every notice with up to its number of random edits is found."""
    import random

    draw, scanner = random.Random(9), licenses.Scanner(licenses.NOTICES)
    for notice in licenses.NOTICES:
        for _ in range(60):
            chars = list(notice.words)
            for _ in range(draw.randint(0, notice.errors)):
                i = draw.randrange(1, len(chars) - 1)
                draw.choice([
                    lambda: chars.__setitem__(i, "q"), lambda: chars.insert(i, "q"), lambda: chars.pop(i)
                ])()
            if "  " in "".join(chars):
                continue  # joining words again would be one edit more
            text = f"some words before {''.join(chars)}{notice.exact_end} and after"
            assert notice.label in {hit[0] for hit in scanner.search(" ".join(text.split()))}, text


def test_edits_anywhere_but_in_the_exact_word():
    """Every base phrase is a notice too; edits fall in its lead-in and in what follows."""
    import random

    draw, scanner = random.Random(10), licenses.Scanner(licenses.NOTICES)
    labels = lambda text: {hit[0] for hit in scanner.search(" ".join(text.split()))}
    for text, label in {
        "released under the mit licence": "mit",
        "undr the mit license": "mit",
        "distributed under teh mit license": "mit",
        "the apache licence version 2": "apache-2",
        "cc b nc": "cc-by-nc",
    }.items():
        assert labels(text) == {label}, text
    for text in ("under the bit license", "apache license version 3", "under the mit lxcxnxe", "udr te mit lcense"):
        assert labels(text) == set(), text
    for phrase, label in licenses.PHRASES:
        assert label in labels(phrase)
    for notice in licenses.NOTICES:
        kept = range(len(notice.words), len(notice.words) + len(notice.exact) + 1)
        for _ in range(60):
            spots = [i for i in range(1, len(notice.whole) - 1) if i not in kept and notice.whole[i] != " "]
            chars = list(notice.whole)
            for i in draw.sample(spots, draw.randint(0, notice.errors)):
                chars[i] = draw.choice(["q", "", chars[i] + "q"])
            text = f"some words before {''.join(chars)} and after"
            if "  " not in text:  # joining words again would be one edit more
                assert notice.label in labels(text), text


def test_weaker_notices_beside_a_better_one_are_reported():
    scanner = licenses.Scanner(licenses.NOTICES[3:4])
    weak, exact = "licnsed under teh apache license version 2", "licensed under the apache license version 2"
    for text, spans in (
        (f"{weak} {exact}", [(0, 6), (7, 13)]),
        (f"{exact} {weak}", [(0, 6), (7, 13)]),
        (f"{weak} {exact} {weak} {weak}", [(0, 6), (7, 13), (14, 20), (21, 27)]),
    ):
        assert [hit[1:3] for hit in scanner.search(text)] == spans


def test_odd_licenses(odd_docs, no_docs):
    found = licenses.scan(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(found) == odd_docs.count()
    for r in found:
        if r.doc_id != 7:
            assert tuple(r[1:6]) == base_scan(texts[r.doc_id])
    assert licenses.scan(no_docs).count() == 0


def test_long_texts_of_notices():
    """Megabytes of notices: each is found where it stands, and base phrases too."""
    scanner = licenses.Scanner(licenses.NOTICES)
    unit = "licnsed undr the apache license version 2 cc by nc é under the mit license "
    one = scanner.search(unit.strip())
    words = len(unit.split())
    n = 3000
    found = scanner.search((unit * n).strip())
    exact = {(label, first % words) for label, first, *_ in one}
    for label, place in exact:
        at = {hit[1] for hit in found if hit[0] == label and hit[1] % words == place}
        assert at == {place + words * k for k in range(n)}
    phrases = [(f" {phrase} ".encode(), label) for phrase, label in licenses.PHRASES]
    starts, labels = licenses._base((" " + unit * n).encode(), phrases)
    single, _ = licenses._base((" " + unit).encode(), phrases)
    assert sorted(starts) == sorted(s + words * k for s in single for k in range(n))
    assert labels == {"apache-2", "cc-by-nc", "mit"}
