"""Repeated long passages, by a compacted De Bruijn graph of token k-mers.

An edge of the graph is a run of ``WINDOW`` words, between the runs of one word less at its two ends.

1. Anchors. Every window has a minimizer, the least hash of its runs of ``ANCHOR`` words. A window that two different
   texts share has its minimizer in both, so only texts and windows under a shared anchor can matter. Anchors are about
   a twentieth of the words; equal texts count once.
2. Edges. The windows under shared anchors are grouped by a 64-bit hash: least document and position, and the edges
   before and after where these are always the same.
3. Compaction. Two edges that are each other's only neighbours are one path: a join of the edges with themselves finds
   these links, and pointer doubling, a self-join each time, gives every edge the head of its path. Ends of documents
   count as branches, so whoever enters a path walks all of it, and the head's source has the whole path.
4. Verification. The words of each path are read at the coordinates in its source, and their 128-bit digest is compared
   with that of the words of each document that has the head, before these are removed. Where it differs, edges with
   different words share a hash: all edges of such paths are judged one by one, by the digests of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import documents, looked_up, release, stored
from .textblocks import Block, U, block, mix, pieces, prefix_sums, span_hashes

WINDOW = 50
ANCHOR = 10
_OTHER = 0x2545F4914F6CDD1D  # base of the hashes of anchors
#: Bits of an edge's hash.
EDGE_BITS = 64
#: Doublings of the pointers between two stored tables.
DOUBLINGS = 2


def minimizers(b: Block, bits: int = EDGE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a block: its minimizer, the word it starts at, its hash (never 0)."""
    whole, at = b.windows(WINDOW)
    whole = np.maximum(whole >> U(64 - bits), U(1))
    if not len(at):
        return np.zeros(0, U), at, whole
    n, span = len(b.hashes), WINDOW - ANCHOR + 1
    j = np.arange(n - ANCHOR + 1)
    values = mix(span_hashes(prefix_sums(b.hashes, _OTHER), j, j + ANCHOR, _OTHER))
    size = -(-len(values) // span) * span
    padded = np.full(size, 2**64 - 1, U)
    padded[: len(values)] = values
    grid = padded.reshape(-1, span)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[at], left[at + span - 1]), at, whole


def _key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _words(b: Block, first: int, n: int) -> bytes:
    """Words ``first`` to ``first + n`` of a block, joined by one space."""
    return b" ".join(b.data[b.starts[first] : b.ends[first + n - 1]].tobytes().split())


def _digest(b: Block, first: int, n: int) -> bytes:
    return hashlib.blake2b(_words(b, first, n), digest_size=16).digest()


_ROWS = "doc_id long, raw long, text_key binary, n_words long, full_sha256 string, anchors array<long>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch):
            b = block(part.column("text"))
            least, at, _ = minimizers(b)
            row = b.row_of[at] if len(at) else at
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            texts = [b.text(r).split() for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    part.column("raw"),
                    pa.array([_key(t) for t in texts], pa.binary()),
                    pa.array(np.diff(b.offsets).astype(np.int64)),
                    pa.array([hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]),
                    pa.array([np.unique(least[cuts[r] : cuts[r + 1]]).view(np.int64) for r in range(part.num_rows)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "raw", "text_key", "n_words", "full_sha256", "anchors"],
            )


_EDGES = "edge long, doc_id long, turn int, at int, before long, after long"


def _edges(bits: int) -> Callable:
    """Windows under a shared anchor, with the windows before and after (0: none); in a document the same three count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                b = block(part.column("text"))
                least, at, whole = minimizers(b, bits)
                row = b.row_of[at] if len(at) else at
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                same = np.zeros(len(row) + 1, bool)
                same[1:-1] = row[1:] == row[:-1]
                before = np.where(same[:-1], np.concatenate([[U(0)], whole[:-1]]), U(0))
                after = np.where(same[1:], np.concatenate([whole[1:], [U(0)]]), U(0))
                ids, turns = part.column("doc_id").to_pylist(), part.column("turn").to_pylist()
                for r, anchors in enumerate(part.column("anchors")):
                    s = slice(cuts[r], cuts[r + 1])
                    hit = np.flatnonzero(np.isin(least[s], np.asarray(anchors.values).view(U))) + cuts[r]
                    if not len(hit):
                        continue
                    once = np.unique(np.stack([whole[hit], before[hit], after[hit]]), axis=1, return_index=True)[1] if len(hit) > 1 else np.zeros(1, int)
                    once.sort()
                    hit = hit[once]
                    n = len(hit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(whole[hit].view(np.int64)), pa.array(np.full(n, ids[r], np.int64)), pa.array(np.full(n, turns[r], np.int32)), pa.array((at[hit] - b.offsets[r]).astype(np.int32)), pa.array(before[hit].view(np.int64)), pa.array(after[hit].view(np.int64))],
                        names=[x.split()[0] for x in _EDGES.split(", ")],
                    )

    return run


def compacted(graph: DataFrame) -> DataFrame:
    """(edge, head, steps) of all edges that come after another one on their path; ``graph``: (edge, before, after), null at a branch.

    A path can't be a circle: the text that has it ends, and its last edge has no edge after it there.
    """
    left = graph.where("after is not null and after <> edge").select(F.col("after").alias("edge"), F.col("edge").alias("head"))
    right = graph.where("before is not null").select("edge", F.col("before").alias("head"))
    now = stored(left.join(right, ["edge", "head"]).withColumn("steps", F.lit(1)).withColumn("open", F.lit(True)), "links")
    while not now.where("open").isEmpty():
        for _ in range(DOUBLINGS):
            on = now.select(F.col("edge").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more"))
            now = now.join(on, "head", "left").select("edge", F.coalesce("further", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("open"))
        now = stored(now, "pointers")
    return now


_PATHS = "head long, source long, turn int, start int, length int, digest binary"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of paths at their coordinates in the source."""
    for batch in batches:
        for part in pieces(batch):
            b = block(part.column("text"))
            for r in range(part.num_rows):
                paths = part.column("paths")[r].values
                start, length, head = (np.asarray(paths.field(f)) for f in ("start", "length", "head"))
                digests = [_digest(b, int(b.offsets[r]) + int(x), int(n) + WINDOW - 1) for x, n in zip(start, length, strict=True)]
                source, turn = (np.full(len(head), part.column(c)[r].as_py()) for c in ("source", "turn"))
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(source, pa.int64()), pa.array(turn, pa.int32()), pa.array(start), pa.array(length), pa.array(digests, pa.binary())], names=[x.split()[0] for x in _PATHS.split(", ")])


_SPANS = "array<struct<start:int,end:int>>"
_CUT = "class_key binary, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, failed array<long>"


def _cut(bits: int) -> Callable:
    """Remove the words of verified paths and of the windows in ``single``; ``failed`` has heads whose paths have other words here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                b = block(part.column("text"))
                _, at, whole = minimizers(b, bits)
                row = b.row_of[at] if len(at) else at
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                removed, shas, spans, failed = [], [], [], []
                for r in range(part.num_rows):
                    n, first = int(b.offsets[r + 1] - b.offsets[r]), int(b.offsets[r])
                    paths = {p["head"] % 2**64: (p["length"], p["digest"]) for p in part.column("paths")[r].as_py() or []}
                    heads = np.array(sorted(paths), U)
                    mine, start = whole[cuts[r] : cuts[r + 1]], at[cuts[r] : cuts[r + 1]]
                    hit = np.flatnonzero(np.isin(mine, heads)) if len(heads) else []
                    depth, wrong = np.zeros(n + 1, np.int64), set()
                    for k in hit:
                        length, digest = paths[int(mine[k])]
                        a, size = int(start[k]), length + WINDOW - 1
                        if a + size <= first + n and _digest(b, a, size) == digest:
                            depth[a - first] += 1
                            depth[a + size - first] -= 1
                        else:
                            wrong.add(int(mine[k].view(np.int64)))
                    for a in part.column("single")[r].as_py() or []:
                        depth[a] += 1
                        depth[a + WINDOW] -= 1
                    gone = np.cumsum(depth)[:n] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    words = b.text(r).split()
                    removed.append(int(gone.sum()))
                    shas.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                    failed.append(sorted(wrong))
                yield pa.RecordBatch.from_arrays(
                    [part.column("class_key"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(failed, pa.list_(pa.int64()))],
                    names=["class_key", "n_removed", "kept_sha256", "spans", "failed"],
                )

    return run


def _windows(bits: int) -> Callable:
    """The windows with one of the given hashes, by the digest of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                b = block(part.column("text"))
                _, at, whole = minimizers(b, bits)
                row = b.row_of[at] if len(at) else at
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                for r, wanted in enumerate(part.column("wanted")):
                    hit = np.flatnonzero(np.isin(whole[cuts[r] : cuts[r + 1]], np.asarray(wanted.values).view(U))) + cuts[r]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part.column("class_key")[r].as_py()] * len(hit), pa.binary()), pa.array(np.full(len(hit), part.column("doc_id")[r].as_py())), pa.array((at[hit] - b.offsets[r]).astype(np.int32)), pa.array([_digest(b, int(at[k]), WINDOW) for k in hit], pa.binary())],
                            names=["class_key", "doc_id", "at", "digest"],
                        )

    return run


def _one_by_one(texts: DataFrame, edges: DataFrame, pointers: DataFrame, heads: DataFrame, bits: int) -> DataFrame:
    """(class_key, single): windows on the paths of ``heads`` whose words also start in a document with a smaller id."""
    wanted = heads.select(F.col("head").alias("edge")).union(pointers.join(heads, "head").select("edge")).distinct()
    held = edges.join(wanted, "edge").groupBy("doc_id").agg(F.collect_set("edge").alias("wanted"))
    found = stored(texts.select("class_key", "doc_id", "text").join(held, "doc_id").mapInArrow(_windows(bits), "class_key binary, doc_id long, at int, digest binary"), "single-windows")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("least"))
    return stored(found.join(first, "digest").where("least < doc_id").groupBy("class_key").agg(F.collect_set("at").alias("single")), "late-windows")


def repeated_passages(docs: DataFrame, bits: int = EDGE_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans of every row.

    A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller id; windows are
    judged on the input. Null and empty texts have no words and keep none. Rows with a null id are left alone and are no
    source. Rows that repeat id and text get equal results; rows with one id and different texts are judged apart, and
    neither is a source for the other. Extra columns are ignored; no rows give no rows. Fewer ``bits`` of the edges'
    hashes make more edges share one, which costs time and changes no result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("raw"))
    rows = stored(docs.mapInArrow(_scan, _ROWS), "texts-scanned")
    long = rows.where(f"n_words >= {WINDOW} and doc_id is not null")
    classes = stored(long.groupBy("text_key").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.count("*").alias("n")).select("text_key", "first.doc_id", "first.raw", "n"), "classes")
    # Anchors carry 64 bits of the text's key; equal texts give equal rows, which the set below takes as one.
    short = F.xxhash64("text_key").alias("short_key")
    marks = long.select(F.explode("anchors").alias("anchor"), short)
    shared = stored(marks.groupBy("anchor").agg(F.min("short_key").alias("lo"), F.max("short_key").alias("hi")).where("lo <> hi").select("anchor"), "shared-anchors")
    by_text = stored(marks.join(shared, "anchor").groupBy("short_key").agg(F.collect_set("anchor").alias("anchors")), "anchors-of-texts")
    release(spark)
    held = by_text.join(classes.select(F.col("text_key").alias("class_key"), "doc_id", "raw", short), "short_key").drop("short_key")
    # An id may have several texts; coordinates tell them apart by their turn.
    turn = (F.row_number().over(W.partitionBy("doc_id").orderBy("class_key")) - 1).cast("int")
    texts = stored(docs.join(held, ["doc_id", "raw"]).drop("raw").dropDuplicates(["doc_id", "class_key"]).withColumn("turn", turn), "anchored-texts")
    release(spark)
    edges = stored(texts.mapInArrow(_edges(bits), _EDGES), "edges")
    one = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c)).alias(c)
    grouped = edges.groupBy("edge").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by(F.struct("turn", "at"), F.struct("doc_id", "turn", "at")).alias("where"), one("before"), one("after"))
    graph = stored(grouped.where("source < last").select("edge", "source", "where.turn", F.col("where.at").alias("start"), "before", "after"), "graph")
    release(spark)
    pointers = compacted(graph)
    length = pointers.groupBy("head").agg((F.count("*") + 1).cast("int").alias("length"))
    heads = graph.join(pointers.select("edge"), "edge", "left_anti").select(F.col("edge").alias("head"), "source", "turn", "start")
    paths = heads.join(length, "head", "left").withColumn("length", F.coalesce("length", F.lit(1)))
    listed = paths.groupBy("source", "turn").agg(F.collect_list(F.struct("start", "length", "head")).alias("paths"))
    measured = listed.join(texts.select(F.col("doc_id").alias("source"), "turn", "text"), ["source", "turn"])
    heads = stored(measured.mapInArrow(_measure, _PATHS), "paths")
    release(spark)
    visits = edges.select(F.col("edge").alias("head"), "doc_id").join(heads, "head").where("source < doc_id")
    cut = stored(visits.groupBy("doc_id").agg(F.collect_set(F.struct("head", "length", "digest")).alias("paths")), "visits")
    whole = texts.select("class_key", "doc_id", "text")
    removed = stored(whole.join(cut, "doc_id").withColumn("single", F.array().cast("array<int>")).mapInArrow(_cut(bits), _CUT), "removed")
    failed = removed.select(F.explode("failed").alias("head")).distinct()
    if not failed.isEmpty():
        late = _one_by_one(texts, edges, pointers, failed, bits)
        again = whole.join(late, "class_key").join(cut, "doc_id", "left").mapInArrow(_cut(bits), _CUT)
        removed = stored(removed.join(late, "class_key", "left_anti").union(again), "removed")
    found = classes.select(F.col("text_key").alias("class_key"), F.col("doc_id").alias("rep"), "n").join(removed.drop("failed"), "class_key", "left").withColumnRenamed("class_key", "text_key")
    out = looked_up(long.drop("anchors", "raw"), found, "text_key")
    copy = F.col("doc_id") > F.col("rep")
    out = out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))).otherwise(F.coalesce("spans", F.array().cast(_SPANS))).alias("spans"),
    )
    rest = rows.where(f"n_words < {WINDOW} or doc_id is null")
    return out.unionByName(rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("full_sha256").alias("kept_sha256"), F.array().cast(_SPANS).alias("spans")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).drop("spans")


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
first AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
starts AS (SELECT doc_id, list(i) AS s FROM g JOIN first USING (h) WHERE least < doc_id GROUP BY doc_id),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, unnest(s) AS i FROM starts)) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT w.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p, ps FROM w LEFT JOIN gone USING (doc_id))
  WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
