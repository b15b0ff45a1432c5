"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND.

Every passage of every training text is a query; case and punctuation don't count. Impacts are BM25 term weights divided by the item's score for its own
text, so one threshold serves all items: a passage retrieves an item if it reaches ``SHARE`` of that score. For all passages at
once, numpy adds up what their uncommon terms give each item and bounds the common ones by all that they can give it; the
passages that may reach the threshold go through WAND with block maxima. What that retrieves is verified on word runs of
the item's question and of its answer.

The index covers items in blocks of at most ``BLOCK_WORDS`` words of similar length, so that what is sent to the
executors has a fixed size whatever the benchmark; each pack of blocks is one pass over the texts. Document frequencies,
the number of items and their mean length are those of the whole benchmark, so scores don't depend on the blocks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, stored
from .textblocks import Block, U, block, mix, pieces

K1, B = 1.2, 0.75
SHARE = 0.5
#: Least share of the question's and of the answer's word runs that a text must have.
QUESTION, ANSWER = 0.7, 0.7
RUN = 5
POSTING_BLOCK = 32
BLOCK_WORDS = 400_000
#: What separates words for block() with ``loose``.
LOOSE_RUN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of more than this share of a block's items are bounded together, by what they give each item at most.
COMMON, COMMON_MOST = 0.02, 0.6 * SHARE


def split_item(text: str | None, question: str | None = None, answer: str | None = None) -> tuple[str, str]:
    """Question and answer of an item. Of a plain text the last line is the answer, of a single line the second half."""
    if question is not None and answer is not None:
        return question, answer
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if len(lines) > 1:
        return "\n".join(lines[:-1]), lines[-1]
    words = (lines[0] if lines else "").split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


def _runs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words; of all words if there are fewer."""
    k = min(RUN, len(hashes))
    if not k:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - k + 1, U)
    for j in range(k):
        out = mix(out * U(3) + hashes[j : len(hashes) - k + 1 + j] + U(j + 1))
    return np.unique(out)


@dataclass
class Index:
    """Postings of one block of items, by term; ``keys`` are sorted term hashes."""

    item_ids: list
    keys: np.ndarray
    bound: np.ndarray  # largest impact of each term
    docs: list[np.ndarray]
    impacts: list[np.ndarray]
    maxima: list[np.ndarray]  # of each POSTING_BLOCK postings
    parts: list[tuple[np.ndarray, np.ndarray, int, int]]  # run hashes of question and answer, and their run lengths
    passage: int  # words of a passage; the next one starts at half
    common: np.ndarray  # terms that many items have
    common_own: np.ndarray  # what such terms give each item together
    ends: np.ndarray  # postings before each term
    all_docs: np.ndarray  # postings of all terms, one after the other
    all_impacts: np.ndarray


@dataclass
class Statistics:
    """Of the whole benchmark, with the document frequencies of the terms at hand."""

    items: int
    mean: float
    df: dict[int, int]


def statistics(items: list[tuple]) -> Statistics:
    """Of items (id, question, answer) that are all there are."""
    b = block(pa.array([f"{q}\n{a}" for _, q, a in items], pa.string()), loose=True)
    df = Counter(t for i in range(len(items)) for t in set(b.hashes[b.offsets[i] : b.offsets[i + 1]].tolist()))
    return Statistics(len(items), float(np.diff(b.offsets).mean()) if items else 1.0, df)


def build(items: list[tuple], passage: int, known: Statistics | None = None) -> Index:
    """``items``: (id, question, answer); without ``known`` they are the whole benchmark."""
    known = known or statistics(items)
    b = block(pa.array([f"{q}\n{a}" for _, q, a in items]), loose=True)
    lengths = np.diff(b.offsets)
    mean, df = max(1.0, known.mean), known.df
    posting: dict[int, list[tuple[int, float]]] = {}
    counts = [Counter(b.hashes[b.offsets[i] : b.offsets[i + 1]].tolist()) for i in range(len(items))]
    for i, c in enumerate(counts):
        weight = {t: np.log(1 + (known.items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[i] / mean)) for t, n in c.items()}
        own = sum(weight.values())
        for t, x in weight.items():
            posting.setdefault(t, []).append((i, x / own))
    keys = np.array(sorted(posting), U)
    docs = [np.array([i for i, _ in posting[int(t)]]) for t in keys]
    impacts = [np.array([x for _, x in posting[int(t)]]) for t in keys]
    maxima = [np.maximum.reduceat(x, np.arange(0, len(x), POSTING_BLOCK)) for x in impacts]
    parts = []
    q, a = (block(pa.array([x[j] or "" for x in items]), loose=True) for j in (1, 2))
    for i in range(len(items)):
        hq, ha = (x.hashes[x.offsets[i] : x.offsets[i + 1]] for x in (q, a))
        parts.append((_runs(hq), _runs(ha), min(RUN, len(hq)), min(RUN, len(ha))))
    common, own = np.zeros(len(keys), bool), np.zeros(len(items))
    for t in sorted(range(len(keys)), key=lambda t: -len(docs[t])):
        if len(docs[t]) > max(2, COMMON * len(items)) and (own[docs[t]] + impacts[t]).max() <= COMMON_MOST:
            common[t] = True
            own[docs[t]] += impacts[t]
    return Index([x[0] for x in items], keys, np.array([x.max() for x in impacts]), docs, impacts, maxima, parts, passage, common, own, np.concatenate([[0], np.cumsum([len(x) for x in docs])]).astype(np.int64), np.concatenate([*docs, np.zeros(0, np.int64)]), np.concatenate([*impacts, np.zeros(0)]))


def wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose impacts over the terms sum up to the threshold, by block-max WAND."""
    slack = threshold - 1e-9
    lists = [[int(index.docs[t][0]), t, 0] for t in terms]
    out = []
    while lists:
        lists.sort()
        total, pivot = 0.0, -1
        for j, (_, t, _) in enumerate(lists):
            total += index.bound[t]
            if total >= slack:
                pivot = j
                break
        if pivot < 0:
            break
        doc = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == doc:
            pivot += 1
        # Maxima of the blocks that would hold the pivot, and where the first of these blocks ends.
        total, end = 0.0, None
        for at in lists[: pivot + 1]:
            docs = index.docs[at[1]]
            k = int(np.searchsorted(docs, doc))
            if k < len(docs):
                kb = k // POSTING_BLOCK
                total += index.maxima[at[1]][kb]
                last = int(docs[min(len(docs), (kb + 1) * POSTING_BLOCK) - 1])
                end = last if end is None else min(end, last)
        if total < slack:
            to = (end if end is not None else doc) + 1
            if pivot + 1 < len(lists):
                to = min(to, lists[pivot + 1][0])
            to = max(to, doc + 1)
        else:
            score = 0.0
            for at in lists[: pivot + 1]:
                docs = index.docs[at[1]]
                k = int(np.searchsorted(docs, doc))
                if k < len(docs) and docs[k] == doc:
                    score += index.impacts[at[1]][k]
            if score >= slack:
                out.append((doc, score))
            to = doc + 1
        for at in lists[: pivot + 1]:
            docs = index.docs[at[1]]
            at[2] = max(at[2], int(np.searchsorted(docs, to)))
            at[0] = int(docs[at[2]]) if at[2] < len(docs) else -1
        lists = [x for x in lists if x[0] >= 0]
    return out


def _candidates(b: Block, index: Index) -> list[tuple[int, int, int, list[int]]]:
    """(row, first word, end, terms) of the passages whose upper bound reaches the threshold."""
    if not len(b.hashes) or not len(index.keys):
        return []
    term = np.searchsorted(index.keys, b.hashes)
    known = np.flatnonzero(index.keys[np.minimum(term, len(index.keys) - 1)] == b.hashes)
    term, row = term[known], b.row_of[known]
    half = index.passage // 2
    # A word lies in the passages that start at its half and at the half before.
    first = np.zeros(len(b.rows), np.int64)
    halves = -(-np.diff(b.offsets) // half)
    np.cumsum(np.maximum(halves, 1), out=first[1:])
    slot = first[row] + (known - b.offsets[row]) // half
    head = (known - b.offsets[row]) >= half
    slots, terms = np.concatenate([slot, slot[head] - 1]), np.concatenate([term, term[head]])
    pair = np.unique(slots * len(index.keys) + terms)
    slots, terms = pair // len(index.keys), pair % len(index.keys)
    # What the other terms give each item, with all that common terms can give it, bounds the item's score.
    rare = ~index.common[terms]
    n = np.diff(index.ends)[terms[rare]]
    posting = np.repeat(index.ends[terms[rare]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item = index.all_docs[posting]
    pairs, inverse = np.unique(np.repeat(slots[rare], n) * len(index.item_ids) + item, return_inverse=True)
    most = np.bincount(inverse, weights=index.all_impacts[posting], minlength=len(pairs)) + index.common_own[pairs % len(index.item_ids)]
    reach = np.unique(pairs[most >= SHARE - 1e-9] // len(index.item_ids))
    out = []
    for s in reach:
        lo, hi = np.searchsorted(slots, [s, s + 1])
        r = int(np.searchsorted(first, s, "right")) - 1
        start = int(b.offsets[r] + (s - first[r]) * half)
        out.append((r, start, int(min(start + index.passage, b.offsets[r + 1])), terms[lo:hi].tolist()))
    return out


def leaks(b: Block, index: Index) -> list[tuple[int, int, int, float, float, float]]:
    """(row, item, first word, score, question overlap, answer overlap) of what is retrieved and verified, best passage only."""
    best: dict[tuple[int, int], tuple] = {}
    for row, start, end, terms in _candidates(b, index):
        found = wand(index, terms, SHARE)
        if not found:
            continue
        hashes = b.hashes[start:end]
        runs: dict[int, np.ndarray] = {}
        for i, score in found:
            q, a, kq, ka = index.parts[i]
            share = []
            for want, k in ((q, kq), (a, ka)):
                if k not in runs:
                    runs[k] = _runs_of(hashes, k)
                share.append(float(np.isin(want, runs[k]).mean()) if len(want) else 1.0)
            if share[0] >= QUESTION and share[1] >= ANSWER and (len(q) or len(a)):
                key, value = (row, i), (score, -(start - int(b.offsets[row])), *share)
                if key not in best or value > best[key]:
                    best[key] = value
    return [(r, i, -v[1], v[0], v[2], v[3]) for (r, i), v in sorted(best.items())]


def _runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    if not k or len(hashes) < k:
        return np.zeros(0, U)
    out = np.zeros(len(hashes) - k + 1, U)
    for j in range(k):
        out = mix(out * U(3) + hashes[j : len(hashes) - k + 1 + j] + U(j + 1))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each item."""
    for batch in batches:
        for part in pieces(batch):
            parts = [split_item(*x) for x in zip(*(part.column(c).to_pylist() for c in ("text", "question", "answer")), strict=True)]
            b = block(pa.array([f"{q}\n{a}" for q, a in parts], pa.string()), loose=True)
            terms = [np.unique(b.hashes[b.offsets[i] : b.offsets[i + 1]]).view(np.int64) for i in range(len(parts))]
            yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(np.diff(b.offsets).astype(np.int64)), pa.array(terms, pa.list_(pa.int64()))], names=["uid", "size", "terms"])


def _items(benchmark: DataFrame, words: int) -> DataFrame:
    """Distinct items with words, their terms' document frequencies, length of a step, and block."""
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = [F.col(c).cast("string").alias(c) if c in benchmark.columns else F.lit(None).cast("string").alias(c) for c in ("question", "answer")]
    # Words as block() cuts them with ``loose``, of what split_item() takes: passages must be long enough for all of these.
    taken = F.when(extra[0].isNotNull() & extra[1].isNotNull(), F.concat_ws("\n", *extra)).otherwise(text)
    n = F.size(F.filter(F.split(taken, LOOSE_RUN), lambda w: w != ""))
    length = F.greatest(F.lit(32), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int"))
    uid = F.xxhash64(F.col("item_id"), text, *[F.struct(e) for e in extra]).alias("uid")
    rows = benchmark.select(uid, "item_id", text.alias("text"), *extra, n.alias("n"), length.alias("length")).where("n > 0").dropDuplicates(["uid"])
    rows = stored(rows, "benchmark-items")
    each = stored(rows.mapInArrow(_terms, "uid long, size long, terms array<long>"), "benchmark-terms")
    single = each.select("uid", F.explode("terms").alias("term"))
    df = single.groupBy("term").agg(F.count("*").alias("df"))
    told = single.join(df, "term").groupBy("uid").agg(F.collect_list(F.struct("term", "df")).alias("dfs"))
    # Which block: by the hash of the item, with as many blocks as the words of the class need.
    total = rows.groupBy("length").agg(F.ceil(F.sum("n") / F.lit(words * 0.7)).cast("long").alias("blocks"))
    out = rows.join(told, "uid").join(each.select("uid", "size"), "uid").join(total, "length")
    return stored(out.withColumn("block", F.pmod("uid", F.col("blocks"))), "benchmark-blocks")


def packs(benchmark: DataFrame, words: int = BLOCK_WORDS) -> Iterator[list[Index]]:
    """Indexes of blocks of items; a pack has at most about ``words`` words and is searched in one pass over the texts."""
    pack, held = [], 0
    items = _items(benchmark, words)
    count, mean = items.agg(F.count("*"), F.avg("size")).first()
    for length, part in sorted(tuple(r) for r in items.select("length", "block").distinct().collect()):
        rows = items.where((F.col("length") == length) & (F.col("block") == part)).select("item_id", "text", "question", "answer", "dfs").orderBy("item_id", "text", "uid").collect()
        df = {t % 2**64: n for r in rows for t, n in r["dfs"]}
        index = build([(r[0], *split_item(r[1], r[2], r[3])) for r in rows], 2 * length, Statistics(count, float(mean), df))
        size = len(index.all_docs)
        if pack and held + size > words:
            yield pack
            pack, held = [], 0
        pack.append(index)
        held += size
    if pack:
        yield pack


_FOUND = "doc_id long, item_id long, start long, score double, question_overlap double, answer_overlap double"


def _search(pack) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                b = block(part.column("text"), loose=True)
                ids = part.column("doc_id").to_pylist()
                found = [(ids[r], index.item_ids[i], *rest) for index in pack.value for r, i, *rest in leaks(b, index)]
                columns = list(zip(*found, strict=True)) or [[]] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each text and item that it leaks, with the best passage.

    Null and empty texts and items match nothing; an item of a few words is verified as a whole. Extra columns are
    ignored, repeated documents are reported once each, repeated items count once, empty tables give no rows. ``words``
    bounds the index that is sent out at a time; results don't depend on it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], _FOUND)
    for pack in packs(benchmark, words):
        out = out.union(docs.mapInArrow(_search(spark.sparkContext.broadcast(pack)), _FOUND))
    return out


def _drop(pack) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                b = block(part.column("text"), loose=True)
                clean = np.ones(part.num_rows, bool)
                clean[[r for index in pack.value for r, *_ in leaks(b, index)]] = False
                yield part.filter(pa.array(clean))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item: one pass for each pack of the index, without a shuffle."""
    for pack in packs(benchmark):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(pack)), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
