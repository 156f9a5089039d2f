"""Shards, nearest neighbours, archives and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import neighbours, sharding, warc
from tidelog.llm.queries import ORACLES, QUERIES


def check_shards(rows, texts, shards):
    slots, sizes, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 8
        assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))
        assert r.law == "bytes" and r.grown_shard is None
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        groups[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    return sizes


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sizes = check_shards(sharding.shard(docs, slot_rows=10).collect(), texts, 24)
    assert len(sizes) == 24
    assert max(sizes.values()) < 1.02 * min(sizes.values())


def test_parcels_of_small_groups(spark):
    rows = [(i, "x" * (i % 7)) if i % 3 else (i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = check_shards(sharding.shard(docs, 4, grain=10, parcels=20).collect(), dict(rows), 4)
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_odd_shards(odd_docs, no_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    check_shards(sharding.shard(odd_docs).collect(), texts, 24)
    assert sharding.shard(no_docs).count() == 0


def test_best_fit_takes_the_tightest_bin():
    draw = random.Random(3)
    for _ in range(100):
        sizes = sorted((draw.randint(1, 60) for _ in range(80)), reverse=True)
        rooms, expected = [], []
        for size in sizes:
            fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
            if fitting:
                i = min(fitting)[1]
            else:
                i = len(rooms)
                rooms.append(100)
            rooms[i] -= size
            expected.append(i)
        assert sharding.best_fit_decreasing(sizes, 100) == expected


def test_a_group_above_an_even_share_stands_alone():
    bins = sharding.even_bins([1000, *[10] * 70], 8)
    fill = Counter()
    for size, b in zip([1000, *[10] * 70], bins, strict=True):
        fill[b] += size
    assert sorted(fill.values()) == [100] * 7 + [1000]


@pytest.fixture(scope="module")
def vectors(spark, small_dir):
    return spark.read.parquet(f"{small_dir}/embeddings.parquet")


def exact(rows, every, k):
    """Brute force over (id, vector)."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    made = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        made[int(ids[q])] = [(int(ids[i]), score[i]) for i in order]
    return made


def recall(found, wanted):
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in best}) for q, best in wanted.items())
    for best in got.values():
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))
    return hits / max(1, sum(map(len, wanted.values())))


def test_recall(vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found = neighbours.search(vectors).collect()
    wanted = exact(rows, 20, 20)
    assert len(found) == 20 * len(wanted)
    assert recall(found, wanted) >= 0.9
    scores = {q: dict(exact(rows, 20, len(rows))[q]) for q in list(wanted)[:3]}
    for r in found:
        if r.query_id in scores:
            assert r.score == pytest.approx(scores[r.query_id][r.vec_id], abs=1e-12)


def test_split_buckets_lose_nothing(vectors):
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    found = neighbours.search(vectors, part_rows=5, bucket_rows=100).collect()
    assert recall(found, exact(rows, 20, 20)) >= 0.9


def test_lengths_ties_and_unusable_vectors(spark):
    draw = np.random.default_rng(8)
    rows = [(i, (draw.standard_normal(6) * draw.choice([0.5, 1, 3])).tolist()) for i in range(400)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 460)]
    bad = [(500, None), (520, [0.0] * 6), (540, [float("nan")] * 6), (560, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
           (580, [float("inf")] * 6), (600, [1.0, 2.0]), (None, [1.0] * 6)]
    table = spark.createDataFrame(
        [(*r, 1, 0.5) for r in [*rows, *bad, rows[0], rows[420]]], "vec_id bigint, embedding array<float>, rank int, score double"
    )
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    found = neighbours.search(table).collect()
    wanted = exact(rows, 20, 20)
    assert {r.query_id for r in found} == set(wanted)
    assert recall(found, wanted) >= 0.9
    tied = [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == 440]
    best = [v for v, s in wanted[440] if s == 1.0]
    assert [v for v in tied if v >= 400] == [v for v in best if v >= 400]
    assert neighbours.search(table.limit(0)).count() == 0


def test_few_vectors_give_all(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in neighbours.search(table).orderBy("rank").collect()] == [
        (1, 1), (2, 2), (3, 3), (4, 4)
    ]


def test_isolated_queries_beside_clusters(spark):
    """Queries far from all others find their neighbours too, and all have their rows."""
    draw = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit(draw.standard_normal((30, 64)))[draw.integers(0, 30, 6000)]
    x = unit(near + 0.02 * draw.standard_normal((6000, 64)))
    alone = draw.random(6000) < 0.03
    x[alone] = unit(draw.standard_normal((int(alone.sum()), 64)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    wanted = exact(rows, 20, 20)
    apart = {q: best for q, best in wanted.items() if alone[q]}
    assert apart and len(found) == 20 * len(wanted)
    assert recall(found, wanted) >= 0.9
    assert recall([r for r in found if r.query_id in apart], apart) >= 0.9


def test_probes_come_in_order_of_expected_distance():
    template = neighbours.probing_template(4, 81)
    assert len(template) == 81  # every cell within one step, once
    assert len({tuple(t) for t in template.tolist()}) == 81
    assert not (template[:, :4] & template[:, :3:-1]).any()


LONG_PAGE = "<p>\r\n\r\nWARC/1.1\r\n" + "é" * 800
PAGES = [
    (5, "http://www.b.example.org/x?q=1", LONG_PAGE),
    (9, "http://a.example.org/", LONG_PAGE),
    (7, "http://a.example.org/", LONG_PAGE),
    (3, "HTTP://A.example.org", "short"),
    (4, "http://a.example.org/", "short"),
    (6, None, None),
    (8, "not a url\r\nX: y", ""),
    (-2, "http://[broken", "x" * 1000),
    (9, "http://a.example.org/", LONG_PAGE),
]


def test_archive(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id bigint, url string, html string, file int")
    rows = warc.archive(pages, F.col("page_id") * 1000, str(tmp_path / "archive")).collect()
    assert all(r.intact for r in rows)
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    expected = []
    for id_, _, html in PAGES:
        data = (html or "").encode()
        again = html == LONG_PAGE and id_ != 9
        expected.append(
            (id_, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None)
        )
    assert found == sorted(expected, key=lambda r: r[:3])
    keys = [(r.url_key or "", r.captured_at, r.page_id) for r in sorted(rows, key=lambda r: (r.range_no, r.place))]
    assert keys == sorted(keys)
    assert {r.url_key for r in rows if r.page_id == 5} == {"org,example,b)/x?q=1"}
    stored = spark.read.option("wholetext", True).text(str(tmp_path / "archive")).collect()
    assert sum(r.value.count("é" * 800) for r in stored) == 2


def test_ranges_in_order(spark, small_dir, tmp_path):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").repartition(5)
    warc.write_archive(pages, str(tmp_path / "archive"), F.lit(None))
    rows = warc.capture_index(spark, str(tmp_path / "archive"), range_rows=40).collect()
    assert len(rows) == pages.count() and all(r.intact for r in rows)
    ordered = sorted(rows, key=lambda r: (r.range_no, r.place))
    keys = [(r.url_key, r.captured_at, r.page_id) for r in ordered]
    assert keys == sorted(keys)
    assert len({r.range_no for r in rows}) > 1


def test_empty_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive(pages, F.lit(0), str(tmp_path / "a")).count() == 0


def foreign_record(kind, url, block, **headers):
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI:{url}", "warc-date: 2020-01-02T03:04:05Z"]
    lines += ["WARC-Record-ID: <urn:uuid:92283950-ef2f-4d72-b224-f54c6ec90bb0>"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """A gzip member for every record, other records between, digests in base 32 or none."""
    import base64
    import gzip

    payloads = [b"first" * 30_000, b"", "dritte é".encode()]
    sha = base64.b32encode(hashlib.sha1(payloads[0]).digest()).decode()
    records = [
        foreign_record("warcinfo", "x", b"software: other\r\n"),
        foreign_record("request", "http://a.org/1", b"GET /1 HTTP/1.1\r\n\r\n"),
        foreign_record("response", "http://a.org/1", b"HTTP/1.1 200 OK\r\n\r\n" + payloads[0], WARC_Payload_Digest=f"sha1:{sha}"),
        foreign_record("response", "http://a.org/2", b"HTTP/1.1 204 None\r\nContent-Length: 0"),
        foreign_record("response", "http://a.org/3", b"HTTP/1.1 200 OK\r\ncontent-length: 9\r\n\r\n" + payloads[2]),
        foreign_record("response", "http://a.org/4", b"HTTP/1.1 200 OK\r\n\r\nx", WARC_Payload_Digest=f"sha1:{sha}"),
    ]
    data = b"".join(map(gzip.compress, records))
    (tmp_path / "one.warc.gz").write_bytes(data + bytes(10))
    (tmp_path / "plain.warc").write_bytes(b"".join(records[2:4]))
    rows = warc.capture_index(spark, str(tmp_path), files="*.warc*").collect()
    found = sorted((r.url, r.payload_bytes, r.payload_digest, r.intact, r.page_id) for r in rows if "one" in r.file)
    digests = [hashlib.sha1(p).hexdigest() for p in (*payloads, b"x")]
    assert found == [
        ("http://a.org/1", 150_000, digests[0], True, None),
        ("http://a.org/2", 0, digests[1], True, None),
        ("http://a.org/3", 9, digests[2], True, None),
        ("http://a.org/4", 1, digests[0], False, None),
    ]
    assert sum("plain" in r.file for r in rows) == 2
    for r in rows:
        raw = (tmp_path / r.file.rsplit("/", 1)[1]).read_bytes()[r.offset :]
        content = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        assert f"WARC-Target-URI:{r.url}\r\n".encode() in content[r.inside : r.inside + 200]
    for broken in (data[:-5], data + b"junk", records[2][:-100], b"no archive"):
        with pytest.raises(ValueError):
            list(warc.parsed(broken, "f"))


def test_loser_tree_merges_runs():
    draw = random.Random(6)
    runs = [sorted((draw.choice("abc"), str(draw.randint(0, 9)), i) for i in range(n)) for n in (0, 5, 1, 40, 7)]
    merged = list(warc.LoserTree(runs))
    assert merged == sorted(sum(runs, []))
    assert list(warc.LoserTree([])) == []
    assert len(warc.sorted_runs([*runs[3], *runs[1]])) <= 2


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf_dir, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    sql_columns, expected = sql_rows(connect(sf_dir), ORACLES[name])
    assert (columns, rows) == (sql_columns, expected)


def test_pipeline_stages(spark, documents, small_dir):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.staged(stage(spark, docs, small_dir), "stage")
        if name != "best-fit packing":
            assert made.columns == documents.columns
            assert made.exceptAll(docs).count() == 0
        if name == "n-gram Jaccard join":
            copies = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
            assert made.join(copies, "doc_id", "left_anti").count() == 0
        if name == "best-fit packing":
            assert made.select("doc_id").distinct().count() == docs.count()
        docs = made
    run = corpus_pipeline.run(spark, small_dir)
    assert run.drop("sequence_id", "offset").exceptAll(docs.drop("sequence_id", "offset")).count() == 0


def test_pipeline_without_rows(spark, small_dir, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), small_dir).count() == 0
