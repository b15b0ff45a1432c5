"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded from its words, as the mean of embeddings that
are learned by hashed word, and from surface statistics. Gated attention learned from the document labels weighs the passages,
and the weighted representation is scored. The model is fitted in numpy on at most ``SAMPLE`` labelled documents, taken by a
hash of the id, and scores all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, remainder
from .textblocks import Block, block, pieces

PASSAGE = 64
#: The most labelled documents that the model is fitted on.
SAMPLE = 8000
HIDDEN, GATE = 24, 16
#: Words share embeddings by their hash; a word that was not learned from adds next to nothing.
BUCKETS, EMBEDDING = 1 << 13, 8
#: The share of documents that a step of the training sees without their words, so that statistics alone score unknown words.
WORDLESS = 0.25
EPOCHS, BATCH, RATE, DECAY = 30, 256, 0.01, 1e-4
THRESHOLD = 0.7


def _is(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_UPPER, _LOWER, _DIGIT = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("abcdefghijklmnopqrstuvwxyz"), _is("0123456789")
_OTHER = np.arange(256) >= 128
_CLASSES = [_UPPER, _LOWER, _DIGIT, _OTHER, _is("!"), _is("?"), _is(".,;:"), _is("#*$%&"), _is("|<>"), _is("-_=+/\\~^@"), _is("()[]{}\"'`"), _is("\n")]
FEATURES = len(_CLASSES) + 7


@dataclass
class Bags:
    """Passages of some texts: their statistics, how many words each has, these words' buckets, and where each text's begin."""

    x: np.ndarray
    words: np.ndarray
    buckets: np.ndarray
    offsets: np.ndarray

    @classmethod
    def joined(cls, bags: list[Bags]) -> Bags:
        sizes = np.concatenate([np.diff(b.offsets) for b in bags])
        return cls(*(np.concatenate([getattr(b, k) for b in bags]) for k in ("x", "words", "buckets")), np.concatenate([[0], np.cumsum(sizes)]))

    def wordless(self) -> Bags:
        return Bags(self.x, np.zeros_like(self.words), self.buckets[:0], self.offsets)


def passages(b: Block) -> Bags:
    """All passages of a block; a text without words has one empty passage."""
    x, words, offsets = _statistics(b)
    return Bags(x, words, (b.hashes % np.uint64(BUCKETS)).astype(np.int16), offsets)


def _statistics(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(b.offsets)
    count = np.maximum(-(-n // PASSAGE), 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    j = np.arange(offsets[-1]) - offsets[row]
    lo = b.offsets[row] + j * PASSAGE
    hi = np.minimum(lo + PASSAGE, b.offsets[row + 1])
    words = hi - lo
    some = np.flatnonzero(words)
    out = np.zeros((len(row), FEATURES))
    if not len(some):
        return out, words, offsets
    # Bytes of a passage: from its first word to the next passage or the end of the text.
    start = b.starts[lo[some]]
    end = np.where(hi[some] < b.offsets[row[some] + 1], b.starts[np.minimum(hi[some], len(b.starts) - 1)], b.rows[row[some] + 1])
    size = np.maximum(end - start, 1)
    for k, kind in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(kind[b.data])])
        out[some, k] = (total[end] - total[start]) / size
    w = words[some]
    length = b.ends - b.starts
    ends, cover = np.concatenate([[0], np.cumsum(length)]), np.concatenate([[0], np.cumsum(length == 1)])
    same = np.zeros(len(b.hashes), np.int64)
    same[1:] = b.hashes[1:] == b.hashes[:-1]
    again = np.concatenate([[0], np.cumsum(same)])
    k = len(_CLASSES)
    out[some, k] = (ends[hi[some]] - ends[lo[some]]) / w / 10
    out[some, k + 1] = (cover[hi[some]] - cover[lo[some]]) / w
    out[some, k + 2] = (again[hi[some]] - again[np.minimum(lo[some] + 1, hi[some])]) / w
    slot = np.repeat(some, w)
    order = np.lexsort((b.hashes, slot))
    new = np.ones(len(order), bool)
    new[1:] = (b.hashes[order][1:] != b.hashes[order][:-1]) | (slot[order][1:] != slot[order][:-1])
    out[:, k + 3] = np.bincount(slot[order][new], minlength=len(row)) / np.maximum(words, 1)
    last = b.data[b.ends - 1]
    closed = np.concatenate([[0], np.cumsum(~(_LOWER | _UPPER | _OTHER)[last])])
    out[some, k + 4] = (closed[hi[some]] - closed[lo[some]]) / w
    out[some, k + 5] = w / PASSAGE
    out[:, k + 6] = np.log1p(n[row]) / 10
    return out, words, offsets


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            bags = passages(block(part.column("text")))
            starts = np.concatenate([[0], np.cumsum(bags.words)])[bags.offsets]
            lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))
            columns = lists(bags.offsets * FEATURES, bags.x.reshape(-1).astype(np.float32)), lists(bags.offsets, bags.words.astype(np.int32)), lists(starts, bags.buckets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), *columns], names=["doc_id", "quality", "x", "words", "buckets"])


def _encoded(m: dict, bags: Bags) -> np.ndarray:
    """Statistics of passages beside the means of their words' embeddings."""
    mean, some = np.zeros((len(bags.words), EMBEDDING)), bags.words > 0
    if some.any():
        first = np.cumsum(bags.words) - bags.words
        mean[some] = np.add.reduceat(m["E"][bags.buckets], first[some], axis=0) / bags.words[some, None]
    return np.concatenate([(bags.x - m["mean"]) / m["std"], mean], axis=1)


def _forward(m: dict, x: np.ndarray, offsets: np.ndarray) -> tuple:
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"] + m["v"]), 1 / (1 + np.exp(-(h @ m["U"] + m["u"])))
    a = (t * s) @ m["w"]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    e = np.exp(a - np.maximum.reduceat(a, offsets[:-1])[row])
    weight = e / np.add.reduceat(e, offsets[:-1])[row]
    z = np.add.reduceat(weight[:, None] * h, offsets[:-1], axis=0)
    return 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30))), (h, t, s, weight, row, z)


def fit(bags: list[Bags], labels: np.ndarray, seed: int = 1) -> dict:
    """Model of single texts' bags; without both labels it scores the share of label 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    base = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    every = np.concatenate([b.x for b in bags]) if bags else np.zeros((1, FEATURES))
    still = {"mean": every.mean(axis=0), "std": every.std(axis=0) + 1e-3}
    m = {
        "E": np.zeros((BUCKETS, EMBEDDING)), "W": rng.normal(0, FEATURES**-0.5, (FEATURES + EMBEDDING, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "v": np.zeros(GATE),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "u": np.zeros(GATE), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.array(np.log(base / (1 - base))),
    }
    if len(np.unique(labels)) > 1:
        first, second = ({k: np.zeros_like(p) for k, p in m.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for lo in range(0, len(order), BATCH):
                part = order[lo : lo + BATCH]
                left_out = rng.random(len(part)) < WORDLESS
                seen = [bags[i].wordless() if out else bags[i] for i, out in zip(part, left_out, strict=True)]
                g = _gradient(m | still, Bags.joined(seen), labels[part])
                step += 1
                for k in m:
                    g[k] = g[k] + DECAY * m[k]
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    m[k] = m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | still


def _gradient(m: dict, bags: Bags, y: np.ndarray) -> dict:
    x, offsets = _encoded(m, bags), bags.offsets
    p, (h, t, s, weight, row, z) = _forward(m, x, offsets)
    dl = (p - y) / len(y)
    g = {"c": z.T @ dl, "d": dl.sum()}
    dz = dl[:, None] * m["c"]
    dh = weight[:, None] * dz[row]
    dw = (h * dz[row]).sum(axis=1)
    da = weight * (dw - np.add.reduceat(weight * dw, offsets[:-1])[row])
    g["w"] = (t * s).T @ da
    dts = da[:, None] * m["w"]
    dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
    g |= {"V": h.T @ dt, "v": dt.sum(axis=0), "U": h.T @ ds, "u": ds.sum(axis=0)}
    dh = (dh + dt @ m["V"].T + ds @ m["U"].T) * (1 - h**2)
    dx = np.repeat(dh @ m["W"][FEATURES:].T / np.maximum(bags.words, 1)[:, None], bags.words, axis=0)
    g["E"] = np.stack([np.bincount(bags.buckets, weights=dx[:, k], minlength=BUCKETS) for k in range(EMBEDDING)], axis=1)
    return g | {"W": x.T @ dh, "b": dh.sum(axis=0)}


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on at most ``sample`` labelled documents, with their whole texts.

    A document with several labels counts with the least, an id with several texts with that of the least hash.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most ``sample`` rows of two numbers.
    got = rows.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))), "doc_id")
    once = got.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")).select("doc_id", "quality", F.col("first.text").alias("text"))
    found = once.mapInArrow(_features, "doc_id long, quality int, x array<float>, words array<int>, buckets array<short>").toArrow().sort_by("doc_id").combine_chunks()
    x, n, t = (_rows(found.column(c)) for c in ("x", "words", "buckets"))
    bags = [Bags(a.astype(np.float64).reshape(-1, FEATURES), b.astype(np.int64), c, np.array([0, len(b)])) for a, b, c in zip(x, n, t, strict=True)]
    return fit(bags, found.column("quality").to_numpy().astype(np.float64))


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as parts of one array."""
    return [x for part in column.chunks for x in np.split(part.flatten().to_numpy(zero_copy_only=False), (part.offsets.to_numpy() - part.offsets[0].as_py())[1:-1])] if len(column) else []


def probabilities(m: dict, texts: pa.Array) -> np.ndarray:
    """The model's scores of texts; null counts as empty."""
    bags = passages(block(texts))
    return _forward(m, _encoded(m, bags), bags.offsets)[0]


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch):
                p = probabilities(m, part.column("text"))
                columns = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*(c for c in part.schema.names if c != "text"), "score", "predicted"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts are scored as one empty passage. Repeated rows get equal scores, extra columns are ignored, no rows
    give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int")


def _keep(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch):
                p = probabilities(m, part.column("text"))
                yield part.filter(pa.array(p >= THRESHOLD))

    return run


def kept(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` whose text the model predicts as label 1, in one pass and without a shuffle."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 4) != 2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, training_labels(spark, sf_dir)))
