"""Language identification with a small convolutional network over bytes.

Filters of several widths slide over byte embeddings, the largest response of
each filter in a fixed-length window feeds a softmax.  The network is trained
in numpy on labelled texts and applied to every window of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tidelog.llm.common import LOWER, annotated, fields

# Labelled texts, and windows of each, a network is trained on, at most.
SAMPLE_TEXTS = 3000
SAMPLE_WINDOWS = 6
WINDOW = 64
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDED = 8
UNKNOWN = "und"

PREDICTED = fields(lang_pred=StringType(), score=DoubleType())
# Windows computed at once; bounds what a task holds.
CHUNK = 4096

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def windows_of(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of ``size`` bytes, the last one filled up with zeros."""
    padded = text.translate(LOWER) + bytes(-len(text) % size)
    return np.frombuffer(padded, np.uint8).reshape(-1, size)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


@dataclass
class Network:
    """Weights; ``kernels[w]`` has the shape (w, embedded, filters)."""

    classes: list[str]
    embedding: np.ndarray
    kernels: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        widths = sorted(self.kernels)
        return [
            self.embedding,
            *[self.kernels[w] for w in widths],
            *[self.biases[w] for w in widths],
            self.out,
            self.out_bias,
        ]


def new_network(classes: list[str], seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    return Network(
        classes,
        normal(256, EMBEDDED, scale=0.5),
        {w: normal(w, EMBEDDED, FILTERS, scale=1 / np.sqrt(w * EMBEDDED)) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        normal(len(WIDTHS) * FILTERS, len(classes), scale=0.2),
        np.zeros(len(classes), np.float32),
    )


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Loss gradients of one batch, in the order of ``parameters()``."""
    embedded = net.embedding[x]
    rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)
    pooled, best = [], {}
    for w in WIDTHS:
        span = x.shape[1] - w + 1
        response = sum(embedded[:, j : j + span] @ net.kernels[w][j] for j in range(w))
        best[w] = response.argmax(axis=1)
        pooled.append(response[rows, best[w], filters] + net.biases[w])
    hidden = np.concatenate(pooled, axis=1)
    active = np.maximum(hidden, 0)
    error = softmax(active @ net.out + net.out_bias)
    error[np.arange(len(y)), y] -= 1
    error *= weight[y][:, None] / len(y)
    back = (error @ net.out.T) * (hidden > 0)
    d_embedding = np.zeros_like(net.embedding)
    d_kernels, d_biases = [], []
    for i, w in enumerate(WIDTHS):
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        d_kernel = np.zeros_like(net.kernels[w])
        for j in range(w):
            bytes_at = x[rows, best[w] + j]
            d_kernel[j] = np.einsum("nf,nfe->ef", part, net.embedding[bytes_at])
            flow = part[:, :, None] * net.kernels[w][j].T[None]
            np.add.at(d_embedding, bytes_at.ravel(), flow.reshape(-1, EMBEDDED))
        d_kernels.append(d_kernel)
        d_biases.append(part.sum(axis=0))
    return [d_embedding, *d_kernels, *d_biases, active.T @ error, error.sum(axis=0)]


def train(
    x: np.ndarray,
    labels: list[str],
    epochs: int = 6,
    batch: int = 128,
    rate: float = 0.01,
    seed: int = 7,
) -> Network:
    """Adam on cross-entropy, with classes weighted to count alike."""
    classes = sorted(set(labels))
    number = {c: i for i, c in enumerate(classes)}
    y = np.array([number[c] for c in labels])
    weight = len(y) / (len(classes) * np.bincount(y, minlength=len(classes)))
    weight = weight.astype(np.float32)
    net, draw = new_network(classes, seed), np.random.default_rng(seed)
    parameters = net.parameters()
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), batch):
            step += 1
            rows = order[at : at + batch]
            for i, g in enumerate(_gradients(net, x[rows], y[rows], weight)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                size = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                parameters[i] -= (size * first[i] / (np.sqrt(second[i]) + 1e-8)).astype(np.float32)
    return net


class Predictor:
    """The network folded into tables over bytes and byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        by_byte = {
            w: [(net.embedding @ net.kernels[w][j]).astype(np.float32) for j in range(w)]
            for w in WIDTHS
        }

        def pairs(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(1 << 16, FILTERS)

        self.head = np.concatenate([pairs(*by_byte[w][:2]) for w in WIDTHS], axis=1)
        self.third = by_byte[3][2]
        self.last = pairs(*by_byte[4][2:])
        self.bias = np.concatenate([net.biases[w] for w in WIDTHS])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes for rows of window bytes."""
        columns = np.ascontiguousarray(x.T).astype(np.int32)
        pairs = columns[:-1] * 256 + columns[1:]
        f, size = FILTERS, len(columns)
        best = np.full((len(x), 3 * f), -np.inf, dtype=np.float32)
        for t in range(size - 1):
            response = self.head.take(pairs[t], axis=0)
            if t < size - 2:
                response[:, f : 2 * f] += self.third.take(columns[t + 2], axis=0)
            if t < size - 3:
                response[:, 2 * f :] += self.last.take(pairs[t + 2], axis=0)
            wide = 3 * f if t < size - 3 else 2 * f if t < size - 2 else f
            np.maximum(best[:, :wide], response[:, :wide], out=best[:, :wide])
        odds = np.maximum(best + self.bias, 0) @ self.net.out + self.net.out_bias
        odds -= odds.max(axis=1, keepdims=True)
        return odds - np.log(np.exp(odds).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Class and score of every text: the mean over all its windows."""
        names = [UNKNOWN] * len(texts)
        scores = [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        at = 0
        while at < len(known):
            group, count = [], 0
            while at < len(known) and count < CHUNK:
                group.append(known[at])
                count += -(-len(texts[known[at]]) // WINDOW)
                at += 1
            rows = np.concatenate([windows_of(texts[i]) for i in group])
            odds = np.concatenate(
                [self.log_odds(rows[k : k + CHUNK]) for k in range(0, len(rows), CHUNK)]
            )
            cuts = np.cumsum([0, *[-(-len(texts[i]) // WINDOW) for i in group]])
            means = np.add.reduceat(odds, cuts[:-1], axis=0) / np.diff(cuts)[:, None]
            sure = np.add.reduceat(np.exp(odds), cuts[:-1], axis=0) / np.diff(cuts)[:, None]
            for i, best, shares in zip(group, means.argmax(axis=1).tolist(), sure, strict=True):
                names[i] = self.net.classes[best]
                scores[i] = float(min(1.0, max(0.0, shares[best])))
        return names, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document must not be learned from; false for a null id."""
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
    return F.coalesce(rest == 1, F.lit(False))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_texts: int = SAMPLE_TEXTS,
    sample_windows: int = SAMPLE_WINDOWS,
) -> Network | None:
    """Train on at most ``sample_texts`` labelled texts that are not held out.

    The sample is those of smallest hash; of each, ``sample_windows`` windows
    spread evenly over the whole text are used.  None without labelled texts.
    """
    drawn = (
        docs.where(
            F.col(id_col).isNotNull()
            & ~held_out(id_col)
            & F.col(lang_col).isNotNull()
            & (F.octet_length(text_col) > 0)
        )
        .select(
            F.xxhash64(id_col).alias("place"),
            F.col(id_col).alias("id"),
            F.col(lang_col).alias("lang"),
            F.col(text_col).cast("binary").alias("text"),
        )
    )
    chosen = drawn.select("place", "id", "lang").orderBy("place", "id", "lang").limit(sample_texts)
    last = chosen.agg(F.max("place")).first()[0]
    if last is None:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, lang, part, window = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                rows = windows_of(text.as_py())
                for k in np.unique(np.linspace(0, len(rows) - 1, sample_windows).astype(int)):
                    place.append(i)
                    part.append(int(k))
                    window.append(rows[k].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("place").take(pa.array(place, pa.int64())),
                    batch.column("lang").take(pa.array(place, pa.int64())),
                    pa.array(part, pa.int64()),
                    pa.array(window, pa.binary()),
                ],
                ["place", "lang", "part", "window"],
            )

    windows = (
        drawn.where(F.col("place") <= last)
        .select("place", "lang", "text")
        .mapInArrow(cut, "place bigint, lang string, part bigint, window binary")
        .orderBy("place", "part", "lang", "window")
        .limit(sample_texts * sample_windows)
        .toArrow()
    )
    x = np.frombuffer(b"".join(windows.column("window").to_pylist()), np.uint8)
    return train(x.reshape(-1, WINDOW), windows.column("lang").to_pylist())


def predicted(docs: DataFrame, net: Network | None, keep, text_col: str = "text") -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work():
        if shared.value is None:
            return lambda texts: ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return Predictor(shared.value).predict

    return annotated(docs, text_col, keep, PREDICTED, work)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The language of every whole text: ``held_out``, ``lang_pred`` and ``score``.

    ``score`` is the mean probability over the text's windows.  A null text or
    one without a letter is ``und`` with score 0, and so is every text if
    nothing is labelled.  One row per document, repeated rows too; other
    columns are ignored.
    """
    net = fit(docs, id_col, text_col, lang_col)
    keep = [F.col(id_col).alias("id"), held_out(id_col).alias("held_out")]
    return predicted(docs, net, keep, text_col).select(
        F.col("row.id").alias(id_col), F.col("row.held_out").alias("held_out"), "lang_pred", "score"
    )
