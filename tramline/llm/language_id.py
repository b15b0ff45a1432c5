"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3, with word ends) of a language or a document by rank. A document
gets the language whose profile has the least out-of-place distance: the sum, over the document's profile, of how far each
n-gram's rank is from its rank in the language, an absent one counting as PROFILE places.

Profiles come from counts over all training documents; PROFILE rows for each language reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, remainder
from .textblocks import pieces

#: n-grams of a profile.
PROFILE = 300
#: How sharply distances turn into a score.
SHARPNESS = 25.0
EDGE = 1  # stands for a word's end; characters below it aren't letters
_BITS = 21
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def _grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its n-gram codes and their counts, codes ascending. Null counts as empty."""
    texts = [x or "" for x in pc.utf8_lower(column).to_pylist()]
    points = np.frombuffer(("\n".join(["", *texts, ""])).encode("utf-32-le"), np.uint32)
    x = np.where(_is_letter()[points], points, EDGE).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != EDGE) | (x[:-1] != EDGE)
    keep[starts] = True
    rows = (np.cumsum(keep) - keep)[starts]
    x = x[keep]
    # Characters as small numbers in the same order, so that a block's n-grams sort as 32-bit values.
    alphabet = np.unique(np.append(x, EDGE))
    bits = max(1, int(len(alphabet)).bit_length())
    kind = np.int32 if 3 * bits < 31 else np.int64
    small = np.searchsorted(alphabet, x).astype(kind) + kind(1)
    alphabet = np.append(0, alphabet)
    pair = (small[:-1] << bits) | small[1:]
    triple = (pair[:-1] << bits) | small[2:]
    edge = small == np.searchsorted(alphabet[1:], EDGE) + 1
    mask = (1 << bits) - 1
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        inner = slice(a + 1, b)
        codes = np.concatenate([small[inner][~edge[inner]], pair[a:b][~(edge[a:b] & edge[a + 1 : b + 1])], triple[a : b - 1][~edge[a + 1 : b]]])
        codes.sort()
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        found = codes[new].astype(np.int64)
        full = (alphabet[found >> (2 * bits)] << (2 * _BITS)) | (alphabet[(found >> bits) & mask] << _BITS) | alphabet[found & mask]
        yield full, np.diff(np.append(new, len(codes)))


def _top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


_COUNTS = "lang string, gram long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language of all of a task's documents, one row each."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for part in pieces(batch):
            by: dict[str, list] = {}
            for lang, got in zip(part.column("lang").to_pylist(), _grams(part.column("text")), strict=True):
                by.setdefault(lang, []).append(got)
            for lang, got in by.items():
                got += [total[lang]] if lang in total else []
                codes, n = (np.concatenate([g[j] for g in got]) for j in (0, 1))
                codes, inverse = np.unique(codes, return_inverse=True)
                total[lang] = codes, np.bincount(inverse, weights=n, minlength=len(codes)).astype(np.int64)
    for lang, (codes, n) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])


def learn(training: DataFrame) -> dict[str, np.ndarray]:
    """Profiles of the languages of (text, lang); rows without a text or language teach nothing."""
    rows = training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(f"rank <= {PROFILE}").orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def distances(column: pa.Array, profiles: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distances (texts by languages) as shares of the largest possible, and whether a text has a letter."""
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
    ranks = np.full((len(known) + 1, len(profiles)), PROFILE)
    for j, p in enumerate(profiles.values()):
        ranks[np.searchsorted(known, p), j] = np.arange(len(p))
    tops = [_top(*g) for g in _grams(column)]
    n = np.array([len(t) for t in tops])
    flat = np.concatenate([*tops, np.zeros(0, np.int64)])
    at = np.searchsorted(known, flat)
    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != flat)] = len(known)
    own = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    off = np.where(at[:, None] < len(known), np.abs(ranks[at] - own[:, None]), PROFILE)
    off[ranks[at] == PROFILE] = PROFILE
    total = np.zeros((len(tops), len(profiles)))
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(off, (np.cumsum(n) - n)[some], axis=0)
    return total / np.maximum(n, 1)[:, None] / PROFILE, some


def _predict(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        names = [*profiles, "und"]
        for batch in batches:
            for part in pieces(batch):
                pred, score = np.full(part.num_rows, len(profiles)), np.zeros(part.num_rows)
                if profiles:
                    d, some = distances(part.column("text"), profiles)
                    weight = np.exp(-SHARPNESS * (d - d.min(axis=1, keepdims=True)))
                    pred[some] = d.argmin(axis=1)[some]
                    score[some] = (1 / weight.sum(axis=1))[some]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([names[j] for j in pred], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    Null texts and texts without a letter get ``und`` and score 0, as do all texts if nothing was learned. Equal distances
    go to the language that is first by name. Repeated rows get equal results, extra columns are ignored, no rows give none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(profiles)), "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs.where(remainder(F.col("doc_id"), 5) != 0)))
