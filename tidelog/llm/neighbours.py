"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors fall into buckets of several tables by rounded random projections.  A
query visits its own bucket and perturbed ones in the order of their estimated
success; the exact scores of all vectors found decide.  How many buckets a
query visits is measured: the smallest number that finds the wanted share of
the true neighbours of some queries, which are searched exactly.

Every query then has a stop rule of its own: it needs all its rows, and its
probes must cover enough of what may lie as near as the rows found.  Queries
that fail it go on through tables fitted to them, and at last against all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import blocks_of, staged
from tidelog.llm.shingles import mixed

NEIGHBOURS = 20
# Of all vectors, those whose id is divisible by this are queries.
EVERY = 20
# Share of the true neighbours that the measured queries must find.
TARGET = 0.95
# Queries that are searched exactly to measure that share.
MEASURED = 64
# Share of its neighbours that each query must be expected to have found.
LEAST = 0.9
# Ranks at which the expected share is computed, evenly spaced.
RANKS = 4
# Open queries that are compared with all vectors rather than through new tables.
OPEN = 4096
# Tables; rows that a bucket holds on average; rows that one task holds.
TABLES = 3
BUCKET_ROWS = 128
PART_ROWS = 20_000
# Bucket width as a multiple of the distance of a usual last neighbour.
WIDTH = 1.75
# Buckets a query visits in a table, at most; if too few, buckets get coarser.
MOST_PROBES = 3000
# Scores held before only the best of each query are kept.
HELD = 1 << 19
# Queries whose products with a bucket are held at once; exact scores at once.
QUERY_ROWS = 512
SCORED = 1 << 14


@dataclass(frozen=True)
class Tables:
    """Projections of all tables, and the order in which perturbations are tried."""

    scale: float
    vectors: np.ndarray  # (tables, dimensions + 1, functions)
    offsets: np.ndarray  # (tables, functions)
    width: float
    template: np.ndarray  # (probes, 2 * functions): ranks of boundaries to cross

    @property
    def functions(self) -> int:
        return self.vectors.shape[2]

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Real-valued cells, (tables, rows, functions).

        Scaled vectors get one more coordinate that makes all lengths 1, so
        that the largest inner product is the smallest distance.
        """
        lengths = np.sqrt((x * x).sum(axis=1, keepdims=True))
        if query:
            unit = np.hstack([x / lengths, np.zeros_like(lengths)])
        else:
            rest = np.sqrt(np.maximum(0.0, 1.0 - (lengths / self.scale) ** 2))
            unit = np.hstack([x / self.scale, rest])
        return np.einsum("nd,tdf->tnf", unit, self.vectors) / self.width + self.offsets[:, None]

    def keys(self, table: int, cells: np.ndarray) -> np.ndarray:
        """One number for every row of cell numbers (the last axis)."""
        weights = mixed(np.arange(1, self.functions + 1, dtype=np.uint64) + np.uint64(977 * (table + 1)))
        total = (cells.astype(np.int64).view(np.uint64) * weights).sum(axis=-1, dtype=np.uint64)
        return mixed(total + np.uint64(table)).view(np.int64)

    def probes(self, places: np.ndarray) -> np.ndarray:
        """The cells one query visits in one table, the likeliest first."""
        f = self.functions
        own = np.floor(places).astype(np.int64)
        inside = places - own
        # Crossing down costs the distance to the lower boundary, up to the upper.
        order = np.argsort(np.concatenate([inside, 1.0 - inside]), kind="stable")
        moves = np.zeros((2 * f, f), dtype=np.int64)
        moves[np.arange(2 * f), order % f] = np.where(order < f, -1, 1)
        return own + self.template @ moves

    def covered(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """The chance that one query's probes find a vector, per cosine to it.

        ``places`` are the query's (tables, functions).  A vector at an angle
        lies at the cosine times the query's projection, and besides in a random
        direction: its cell is that of a normal distribution in each function.
        """
        if not np.isfinite(self.width):
            return np.ones(len(cosines))
        cosines = np.clip(cosines, -1.0, 1.0)
        spread = np.maximum(np.sqrt(1.0 - cosines**2) / self.width, 1e-9)
        missed = np.ones(len(cosines))
        for t in range(len(places)):
            own = np.floor(places[t])
            mean = self.offsets[t] + cosines[:, None] * (places[t] - self.offsets[t])
            edges = own + np.arange(-1, 3)[:, None, None]
            below = _normal((edges - mean) / spread[:, None])
            down, stay, up = np.maximum(np.diff(below, axis=0), 1e-30)
            inside = places[t] - own
            order = np.argsort(np.concatenate([inside, 1.0 - inside]), kind="stable")
            gain = (np.log(np.hstack([down, up])) - np.log(np.hstack([stay, stay])))[:, order]
            chance = np.exp(self.template @ gain.T + np.log(stay).sum(axis=1)).sum(axis=0)
            missed *= 1.0 - np.minimum(chance, 1.0)
        return 1.0 - missed


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1.0 / (1.0 + 0.2316419 * np.abs(x))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-0.5 * x * x) / np.sqrt(2 * np.pi) * series
    return np.where(x > 0, 1.0 - tail, tail)


def everywhere(dimensions: int, scale: float) -> Tables:
    """One table of one bucket, which every query visits."""
    return Tables(
        scale,
        np.zeros((1, dimensions + 1, 1)),
        np.full((1, 1), 0.5),
        float("inf"),
        np.zeros((1, 2), dtype=np.int64),
    )


def probing_template(functions: int, most: int) -> np.ndarray:
    """Sets of boundaries to cross, by the expected sum of squared distances.

    Boundaries are ranked by distance; rank ``j`` and its mirror are the two
    sides of one cell, so a set never holds both.  From a set follow the one
    with its largest rank moved up and the one with the next rank added, which
    yields all sets in order.
    """
    f = functions
    rank = np.arange(1, 2 * f + 1)
    near = rank * (rank + 1) / (4 * (f + 1) * (f + 2))
    mirror = 2 * f + 1 - rank
    far = 1 - mirror / (f + 1) + mirror * (mirror + 1) / (4 * (f + 1) * (f + 2))
    cost = np.where(rank <= f, near, far)
    sets = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(sets) < most:
        total, chosen = heapq.heappop(heap)
        if all(2 * f - 1 - j not in chosen for j in chosen):
            sets.append(chosen)
        top = chosen[-1]
        if top + 1 < 2 * f:
            moved = total - cost[top] + cost[top + 1]
            heapq.heappush(heap, (float(moved), (*chosen[:-1], top + 1)))
            heapq.heappush(heap, (float(total + cost[top + 1]), (*chosen, top + 1)))
    template = np.zeros((len(sets), 2 * f), dtype=np.int64)
    for i, chosen in enumerate(sets):
        template[i, list(chosen)] = 1
    return template


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimensions)


def usable(vector: str) -> Column:
    """Vectors that take part: no null or non-finite component, and not all zero."""
    v = F.col(vector)
    return (
        v.isNotNull()
        & F.forall(
            v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        )
        & F.exists(v, lambda x: x != 0)
    )


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int):
    """The rows of the ``k`` best of each query; ties go to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    if not len(query):
        return query, vec, score
    same = np.zeros(len(query), dtype=bool)
    same[1:] = (query[1:] == query[:-1]) & (vec[1:] == vec[:-1])
    query, vec, score = query[~same], vec[~same], score[~same]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff([*first, len(query)]))
    return query[rank < k], vec[rank < k], score[rank < k]


def _scored(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed alike wherever a row stands."""
    return (queries * vectors).sum(axis=1)


FOUND = "query_id bigint, vec_id bigint, score double"
FOUND_NAMES = ["query_id", "vec_id", "score"]


def _batch(query, vec, score) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
        ["query_id", "vec_id", "score"],
    )


class Collector:
    """The best scores of a block of queries, pruned whenever many are held."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.floor = np.full(len(ids), -np.inf)
        self.held: list[tuple] = []
        self.count = 0

    def compare(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Score ``vectors`` against the queries at ``rows``."""
        for at in range(0, len(rows), QUERY_ROWS):
            part = rows[at : at + QUERY_ROWS]
            scores = self.vectors[part] @ vectors.T
            # Own id aside, a query needs the best k of these rows at most.
            least = self.floor[part]
            if scores.shape[1] > self.k + 1:
                best = -np.partition(-scores, self.k, axis=1)[:, self.k]
                least = np.maximum(least, best)
            # A margin for the product's rounding; kept scores are computed anew.
            q, v = np.nonzero(scores >= least[:, None] - 1e-9)
            q = part[q]
            other = self.ids[q] != ids[v]
            q, v = q[other], v[other]
            for some in range(0, len(q), SCORED):
                qs, vs = q[some : some + SCORED], v[some : some + SCORED]
                self.held.append((qs, ids[vs], _scored(self.vectors[qs], vectors[vs])))
                self.count += len(qs)
                if self.count > HELD:
                    self.prune()

    def prune(self) -> None:
        q, v, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        q, v, s = _best(q, v, s, self.k)
        times = np.bincount(q, minlength=len(self.ids))
        last = np.cumsum(times) - 1
        full = times >= self.k
        self.floor[full] = s[last[full]]
        self.held, self.count = [(q, v, s)], len(q)

    def result(self) -> pa.RecordBatch:
        if not self.held:
            return _batch([], [], [])
        self.prune()
        q, v, s = self.held[0]
        return _batch(self.ids[q], v, s)


def _exact(vectors: DataFrame, queries, dimensions: int, k: int) -> DataFrame:
    """True neighbours of a few queries that are sent to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Collector(*queries.value, k)
        everyone = np.arange(len(queries.value[0]))
        for batch in batches:
            ids = batch.column("id").to_numpy()
            rows = _matrix(batch.column("vector"), dimensions)
            for at in range(0, len(ids), 4096):
                found.compare(everyone, ids[at : at + 4096], rows[at : at + 4096])
        yield found.result()

    return _ranked(vectors.mapInArrow(run, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def _measured_probes(tables: Tables, queries, neighbours, target: float) -> int | None:
    """The fewest probes that find ``target`` of the true neighbours, None if all don't."""
    ranks = []
    ids, vectors = queries
    at_query = tables.places(vectors, True)
    for i, id_ in enumerate(ids.tolist()):
        near = neighbours.get(id_)
        if near is None:
            continue
        cells = np.floor(tables.places(near, False)).astype(np.int64)
        best = np.full(len(near), np.iinfo(np.int64).max)
        for t in range(len(cells)):
            keys = tables.keys(t, tables.probes(at_query[t, i]))
            place = {key: n for n, key in reversed(list(enumerate(keys.tolist())))}
            here = [place.get(key, 1 << 40) for key in tables.keys(t, cells[t]).tolist()]
            best = np.minimum(best, here)
        ranks.append(best)
    if not ranks:
        return 1
    ranks = np.sort(np.concatenate(ranks))
    wanted = ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]
    return int(wanted) + 1 if wanted < len(tables.template) else None


def search(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = EVERY,
    k: int = NEIGHBOURS,
    target: float = TARGET,
    tables: int = TABLES,
    bucket_rows: int = BUCKET_ROWS,
    part_rows: int = PART_ROWS,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest vectors found for each query: largest inner product first.

    Queries are the rows whose id is divisible by ``every``, candidates all
    rows of another id.  Returns ``query_id``, ``rank`` from 1, ``vec_id`` and
    ``score``; ties go to the smaller id.  Null ids, and vectors that are null,
    zero, hold null or non-finite components or are not of the most common
    length, take no part.  Repeated rows count once; other columns are
    ignored; an empty table gives no rows.

    Of equal vectors only the ``k + 1`` smallest ids can be among the nearest,
    so the others leave first.  Buckets above ``part_rows`` are split over tasks.
    A query that lacks rows, or may expect less than ``LEAST`` of its neighbours,
    goes on, at last against all candidates: only where fewer than ``k`` exist
    are there fewer rows.
    """
    spark = vectors.sparkSession
    valid = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")
    ).where(F.col("id").isNotNull() & usable("vector"))
    common = (
        valid.groupBy(F.size("vector").alias("length"))
        .count()
        .orderBy(F.desc("count"), "length")
        .first()
    )
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dimensions = common["length"]
    equal = Window.partitionBy("vector").orderBy("id")
    kept = staged(
        valid.where(F.size("vector") == dimensions)
        .distinct()
        .withColumn("place", F.row_number().over(equal))
        .where((F.col("place") <= k + 1) | (F.col("id") % every == 0))
        .withColumn("candidate", F.col("place") <= k + 1)
        .drop("place"),
        "vectors",
    )
    candidates = kept.where("candidate").select("id", "vector")
    queries = kept.where(F.col("id") % every == 0).select("id", "vector")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = candidates.agg(F.count("*").alias("rows"), F.max(length).alias("scale")).first()
    if queries.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    scale = float(size["scale"]) * (1 + 1e-12)

    def visited(asking: DataFrame, hashed: Tables) -> DataFrame:
        found = _visited(candidates, asking, hashed, dimensions, k, part_rows, size["rows"])
        return staged(_ranked(found, k).select(*FOUND_NAMES), "neighbours")

    open_, count, found = queries, None, None
    while True:
        hashed = _fitted(
            candidates, open_, dimensions, k, target, tables, bucket_rows, seed, scale, size["rows"]
        )
        more = visited(open_, hashed)
        found = more if found is None else found.union(more)
        before, open_ = count, staged(_open(open_, found, hashed, dimensions, k), "open")
        count = open_.count()
        if not count:
            break
        # Few are left, or new tables hardly helped: compare with all.
        if count <= OPEN or (before is not None and 2 * count > before):
            found = found.union(visited(open_, everywhere(dimensions, scale)))
            break
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")


def _open(
    queries: DataFrame, found: DataFrame, tables: Tables, dimensions: int, k: int
) -> DataFrame:
    """The queries that have fewer than ``k`` rows, or too small an expected share.

    The j-th row found is no nearer than the true j-th neighbour, so the mean
    chance to find vectors as far as the rows is at most the expected share.
    """
    shared = queries.sparkSession.sparkContext.broadcast(tables)
    scores = (
        _ranked(found, k)
        .groupBy(F.col("query_id").alias("id"))
        .agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    )
    steps = -(-k * np.arange(1, RANKS + 1) // RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dimensions)
            places = shared.value.places(x, True)
            lengths = np.sqrt((x * x).sum(axis=1)) * shared.value.scale
            going = []
            for i, best in enumerate(batch.column("scores").to_pylist()):
                if best is None or len(best) < k:
                    going.append(True)
                    continue
                cosines = np.array(best)[steps - 1] / lengths[i]
                share = (shared.value.covered(places[:, i], cosines) * np.diff([0, *steps])).sum() / k
                going.append(bool(share < LEAST))
            yield batch.filter(pa.array(going, pa.bool_())).select(["id", "vector"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.join(scores, "id", "left").select("id", "vector", "scores").mapInArrow(
        run, f"id bigint, vector {kind}"
    )


def _fitted(
    candidates: DataFrame,
    queries: DataFrame,
    dimensions: int,
    k: int,
    target: float,
    tables: int,
    bucket_rows: int,
    seed: int,
    scale: float,
    count: int,
) -> Tables:
    """Tables whose width and probes suit some of the queries, which are searched exactly."""
    spark = candidates.sparkSession
    rows = queries.orderBy(F.xxhash64("id"), "id").limit(MEASURED).toArrow().combine_chunks()
    some = (rows.column("id").to_numpy(), _matrix(rows.column("vector").combine_chunks(), dimensions))
    shared = spark.sparkContext.broadcast(some)
    true = _exact(candidates, shared, dimensions, k)
    # At most MEASURED * k rows.
    near = (
        true.join(candidates.withColumnRenamed("id", "vec_id"), "vec_id")
        .select("query_id", "rank", "score", "vector")
        .toArrow()
        .combine_chunks()
    )
    of = near.column("query_id").to_numpy()
    points = _matrix(near.column("vector").combine_chunks(), dimensions) if len(of) else None
    neighbours = {id_: points[of == id_] for id_ in np.unique(of).tolist()}
    cosine = near.column("score").to_numpy() / scale
    cosine = cosine / np.array([np.linalg.norm(some[1][some[0] == i][0]) for i in of] or [1.0])
    distance = float(np.sqrt(2 - 2 * np.median(cosine))) if len(of) else 1.0
    width = WIDTH * max(distance, 0.05)
    bits = max(0.5, np.log2(4.13 / width))  # of one projection of unit vectors
    functions = int(np.clip(np.ceil(np.log2(max(2, count / bucket_rows)) / bits), 2, 24))
    draw = np.random.default_rng(seed)
    probes = None
    while probes is None:
        hashed = Tables(
            scale,
            draw.standard_normal((tables, dimensions + 1, functions)),
            draw.random((tables, functions)),
            width,
            probing_template(functions, MOST_PROBES),
        )
        probes = _measured_probes(hashed, some, neighbours, target)
        # Too few found with all probes: coarser buckets, at last one for all.
        functions -= 1
        width = width if functions else float("inf")
        functions = max(functions, 1)
    return Tables(
        hashed.scale, hashed.vectors, hashed.offsets, hashed.width, hashed.template[:probes]
    )


def _visited(
    candidates: DataFrame,
    queries: DataFrame,
    tables: Tables,
    dimensions: int,
    k: int,
    part_rows: int,
    rows: int,
) -> DataFrame:
    """Scores of all vectors in the buckets that each query visits.

    Buckets are dealt to parts of about ``part_rows`` vectors.  A part's task
    holds its vectors and streams the queries that visit it.
    """
    spark = candidates.sparkSession
    shared = spark.sparkContext.broadcast(tables)
    count = len(tables.vectors)
    parts = blocks_of(rows * count, part_rows)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = shared.value.places(_matrix(batch.column("vector"), dimensions), False)
            for t in range(count):
                keys = shared.value.keys(t, np.floor(places[t]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), batch.column("id"), batch.column("vector")],
                    ["key", "id", "vector"],
                )

    kind = candidates.schema["vector"].dataType.simpleString()
    indexed = candidates.mapInArrow(index, f"key bigint, id bigint, vector {kind}")
    # A large bucket is spread over as many parts as it fills.  There are at
    # most rows * tables / part_rows of them.
    large = staged(
        indexed.groupBy("key").count().where(F.col("count") > part_rows).select(
            "key", F.ceil(F.col("count") / part_rows).cast("bigint").alias("pieces")
        ),
        "large",
    )
    pieces = {row["key"]: row["pieces"] for row in large.collect()}
    sent = spark.sparkContext.broadcast(pieces)

    def part_of(keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
        spread = mixed(keys.view(np.uint64) + piece.astype(np.uint64) * np.uint64(0x9E3779B9))
        return (spread % np.uint64(parts)).astype(np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            ids = batch.column("id").to_numpy()
            times = np.array([sent.value.get(key, 1) for key in keys.tolist()], dtype=np.uint64)
            piece = mixed(ids.view(np.uint64)) % np.maximum(times, np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part_of(keys, piece), pa.int64()),
                    pa.array(np.zeros(len(keys), np.int64)),
                    batch.column("id"),
                    batch.column("vector"),
                    pa.array([[key] for key in keys.tolist()], pa.list_(pa.int64())),
                ],
                ["part", "asks", "id", "vector", "keys"],
            )

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = shared.value.places(_matrix(batch.column("vector"), dimensions), True)
            rows, part, visits = [], [], []
            for i in range(batch.num_rows):
                keys = np.concatenate(
                    [shared.value.keys(t, shared.value.probes(places[t, i])) for t in range(count)]
                )
                homes = part_of(keys, np.zeros(len(keys)))
                more = [key for key in keys.tolist() if key in sent.value] if sent.value else []
                for key in more:
                    others = np.arange(1, sent.value[key])
                    same = np.full(len(others), key, dtype=np.int64)
                    keys = np.concatenate([keys, same])
                    homes = np.concatenate([homes, part_of(same, others)])
                order = np.argsort(homes, kind="stable")
                cuts = np.flatnonzero(np.diff(homes[order])) + 1
                for group in np.split(order, cuts):
                    rows.append(i)
                    part.append(int(homes[group[0]]))
                    visits.append(keys[group])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int64()),
                    pa.array(np.ones(len(rows), np.int64)),
                    batch.column("id").take(pa.array(rows, pa.int64())),
                    batch.column("vector").take(pa.array(rows, pa.int64())),
                    pa.array(visits, pa.list_(pa.int64())),
                ],
                ["part", "asks", "id", "vector", "keys"],
            )

    schema = f"part bigint, asks bigint, id bigint, vector {kind}, keys array<bigint>"

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for (here, asks), group in _pieces(batches):
            if not asks:
                if here != part:
                    part, held = here, []
                held.append(group)
                continue
            if here != part:
                continue
            if isinstance(held, list):
                held = _Part(pa.Table.from_batches(held).combine_chunks(), dimensions)
            yield held.answer(group, k)

    both = indexed.mapInArrow(dealt, schema).union(queries.mapInArrow(asking, schema))
    return (
        both.repartition("part").sortWithinPartitions("part", "asks").mapInArrow(answer, FOUND)
    )


def _pieces(batches: Iterator[pa.RecordBatch]):
    """The stretches of each batch with the same first two columns."""
    for batch in batches:
        if batch.num_rows:
            part, asks = (batch.column(i).to_numpy() for i in range(2))
            cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(asks) != 0)) + 1
            for rows in np.split(np.arange(batch.num_rows), cuts):
                start = int(rows[0])
                yield (int(part[start]), int(asks[start])), batch.slice(start, len(rows))


class _Part:
    """The vectors of one part, by bucket."""

    def __init__(self, rows: pa.Table, dimensions: int):
        keys = rows.column("keys").combine_chunks().flatten().to_numpy()
        order = np.argsort(keys, kind="stable")
        self.dimensions = dimensions
        self.ids = rows.column("id").to_numpy()[order]
        self.vectors = _matrix(rows.column("vector").combine_chunks(), dimensions)[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.last = np.append(self.first[1:], len(keys))

    def answer(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        visits = batch.column("keys")
        lengths = np.diff(visits.offsets.to_numpy())
        who = np.repeat(np.arange(batch.num_rows), lengths)
        wanted = visits.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        here = self.keys[at] == wanted
        who, at = who[here], at[here]
        order = np.argsort(at, kind="stable")
        who, at = who[order], at[order]
        found = Collector(
            batch.column("id").to_numpy(), _matrix(batch.column("vector"), self.dimensions), k
        )
        cuts = np.flatnonzero(np.diff(at)) + 1
        for rows in np.split(np.arange(len(at)), cuts):
            if len(rows):
                bucket = at[rows[0]]
                a, b = self.first[bucket], self.last[bucket]
                found.compare(np.unique(who[rows]), self.ids[a:b], self.vectors[a:b])
        return found.result()
