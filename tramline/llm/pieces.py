"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts become segments at the places no piece can cross. Equal segments of a block are encoded once, and segments of equal
length advance together: at each end position the hashes of all substrings probe the sorted keys of the pieces, and
vectorised maxima store the backpointers. Characters without a piece become byte pieces, so decoding gives the text back.

The vocabulary comes from a model file, whose path is a parameter; nothing is trained. Scores of a unigram model are used
as they are. A merge model only ranks its pieces: rank r then counts as a probability in proportion to 1 / (r + 10).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents
from .textblocks import U, bytes_of, mix, pieces, prefix_sums, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 3 << 20
SPACE = 0x2581
#: Stands for a SPACE that the text itself has: no piece matches it.
TRUE_SPACE = 0x110001
_BASE = 0x9E3779B97F4A7C15
_ZIPF = 10
#: Merge models give pieces that no merge makes this score or less; they rank last.
LEAST_SCORE = -1e8
#: A byte piece costs so much more than the least likely piece.
BYTE_COST = 10.0


def _code(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U) * U(0x9E3779B97F4A7C15) + U(0x7F4A7C15))


@dataclass
class Vocabulary:
    """Pieces by id, and their sorted keys. Its size is that of the model file."""

    keys: np.ndarray
    ids: np.ndarray  # of the sorted keys
    scores: np.ndarray  # of the sorted keys
    longest: int
    byte_ids: np.ndarray  # of bytes 0 to 255
    byte_score: float
    size: int
    buffer: np.ndarray  # decoded bytes of all pieces
    ends: np.ndarray
    seen: np.ndarray  # whether any key has these upper bits
    alphabet: np.ndarray  # sorted characters that pieces of two or more characters have


def vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    return from_pieces([(m.id_to_piece(i), m.get_score(i), m.is_byte(i), m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(m.get_piece_size())])


def from_pieces(rows: list[tuple[str, float, bool, bool]]) -> Vocabulary:
    """``rows``: (piece, score, is a byte, isn't text) by id."""
    normal = [i for i, (_, _, byte, no_text) in enumerate(rows) if not byte and not no_text]
    scores = np.array([rows[i][1] for i in normal])
    ranked = scores > LEAST_SCORE
    if ranked.sum() > 1 and (scores[ranked] <= 0).all() and (scores == np.round(scores)).all() and len(np.unique(scores[ranked])) == ranked.sum():
        rank = np.where(ranked, -scores, -scores[ranked].min())
        scores = -np.log(rank + _ZIPF) - np.log((1 / (rank + _ZIPF)).sum())
    points = [np.array([ord(c) for c in rows[i][0]], np.int64) for i in normal]
    size = np.array([len(p) for p in points])
    ends = np.cumsum(size)
    prefix = prefix_sums(_code(np.concatenate(points)), _BASE)
    keys = mix(span_hashes(prefix, ends - size, ends, _BASE) + size.astype(U))
    order = np.argsort(keys)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces have the same key")
    byte_ids = np.full(256, -1)
    text = []
    for i, (piece, _, byte, no_text) in enumerate(rows):
        if byte:
            byte_ids[int(piece[1:-1], 16)] = i
        text.append(bytes([int(piece[1:-1], 16)]) if byte else b"" if no_text else piece.replace(chr(SPACE), " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    seen = np.zeros(1 << 20, bool)
    seen[keys >> U(44)] = True
    return Vocabulary(
        keys[order], np.array(normal)[order], scores[order], int(size.max()), byte_ids, float(scores.min() - BYTE_COST), len(rows),
        np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in text])]), seen, np.unique(np.concatenate([p for p in points if len(p) > 1])),
    )


def _utf8_size(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _utf8_byte(points: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte j of the UTF-8 form of each character."""
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    shift = 6 * (size - 1 - j)
    return np.where(j == 0, lead | (points >> shift), 0x80 | ((points >> shift) & 0x3F))


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... n - 1 for each n of counts."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _viterbi(points: np.ndarray, prefix: np.ndarray, starts: np.ndarray, length: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of the best pieces of segments of one length; an id over v.size - 1 is v.size plus a character."""
    n = len(starts)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    back = np.zeros((length + 1, n), np.int64)
    piece = np.zeros((length + 1, n), np.int64)
    for e in range(1, length + 1):
        most = min(v.longest, e)
        ends = starts + e
        score, which = np.empty((most, n)), np.zeros((most, n), np.int64)
        for size in range(1, most + 1):
            key = mix(span_hashes(prefix, ends - size, ends, _BASE) + U(size))
            # Most substrings are no piece, and most of these the key's upper bits rule out.
            may = np.flatnonzero(v.seen[key >> U(44)])
            at = np.minimum(np.searchsorted(v.keys, key[may]), len(v.keys) - 1)
            true = v.keys[at] == key[may]
            may, at = may[true], at[true]
            score[size - 1] = -np.inf
            score[size - 1, may] = best[e - size, may] + v.scores[at]
            which[size - 1, may] = v.ids[at]
            if size == 1 and len(may) < n:
                hit = np.zeros(n, bool)
                hit[may] = True
                lone = points[ends - 1]
                score[0] = np.where(hit, score[0], best[e - 1] + v.byte_score * _utf8_size(np.where(lone == TRUE_SPACE, SPACE, lone)))
                which[0] = np.where(hit, which[0], v.size + lone)
        back[e] = score.argmax(axis=0)
        every = np.arange(n)
        best[e] = score[back[e], every]
        piece[e] = which[back[e], every]
    # Walk back all segments at once.
    at, out, counts = np.full(n, length), [], np.zeros(n, np.int64)
    every = np.arange(n)
    while (live := at > 0).any():
        out.append(np.where(live, piece[at, every], -1))
        counts += live
        at = np.where(live, at - back[at, every] - 1, 0)
    grid = np.array(out).T[:, ::-1]
    return grid[grid >= 0], counts


def encode(column: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and the texts' offsets in it. Null counts as empty."""
    texts = [x or "" for x in column.to_pylist()]
    joined = "".join([" " + x for x in texts if x])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    rows = np.concatenate([[0], np.cumsum(sizes)])
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    points = np.where(points == SPACE, TRUE_SPACE, points)
    points[points == 0x20] = SPACE
    space = points == SPACE
    low = np.zeros(0x110002, bool)
    low[v.alphabet] = True
    alone = ~low[points]
    cut = np.zeros(len(points) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[:-1] |= alone
    cut[1:] |= alone
    cut[rows] = True
    starts = np.flatnonzero(cut[:-1])
    length = np.diff(np.append(starts, len(points)))
    prefix = prefix_sums(_code(points), _BASE)
    key = mix(span_hashes(prefix, starts, starts + length, _BASE) + length.astype(U))
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    size = length[first]
    order = np.argsort(size, kind="stable")
    bounds = np.flatnonzero(np.diff(size[order])) + 1
    ids, counts = [], []
    for group in np.split(order, bounds):
        # Few long segments at a time, so that the tables of backpointers stay small.
        step = max(1, 2_000_000 // int(size[group[0]] + 1))
        for lo in range(0, len(group), step):
            part = group[lo : lo + step]
            got, n = _viterbi(points, prefix, starts[first[part]], int(size[part[0]]), v)
            ids.append(got)
            counts.append(n)
    ids, n = np.concatenate(ids), np.concatenate(counts)
    # Byte pieces for characters without a piece.
    lone = ids >= v.size
    if lone.any():
        char = np.where(lone, ids - v.size, 0)
        char[char == TRUE_SPACE] = SPACE
        width = np.where(lone, _utf8_size(char), 1)
        j, wide = _ragged(width), np.repeat(width, width)
        byte = v.byte_ids[np.where(np.repeat(lone, width), _utf8_byte(np.repeat(char, width), j, wide), 0)]
        owner = np.repeat(np.arange(len(n)), n)
        n = np.bincount(owner, weights=width, minlength=len(n)).astype(np.int64)
        ids = np.where(np.repeat(lone, width), byte, np.repeat(ids, width))
    at = np.empty(len(n), np.int64)
    count = np.empty(len(n), np.int64)
    at[order], count[order] = np.cumsum(n) - n, n
    each = count[inverse]
    flat = ids[np.repeat(at[inverse], each) + _ragged(each)].astype(np.int32)
    total = np.concatenate([[0], np.cumsum(each)])
    return flat, total[np.searchsorted(starts, rows)]


def decode(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the texts' offsets in them."""
    size = np.diff(v.ends)[ids]
    data = v.buffer[np.repeat(v.ends[ids], size) + _ragged(size)]
    ends = np.concatenate([[0], np.cumsum(size)])[offsets]
    full = ends[1:] > ends[:-1]
    drop = np.zeros(len(data), bool)
    drop[ends[:-1][full]] = True  # the space that stands before every text
    return data[~drop], ends - np.concatenate([[0], np.cumsum(full)])


_OUT = "doc_id long, ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean"


def _run(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        is_byte = np.zeros(v.size, bool)
        is_byte[v.byte_ids] = True
        for batch in batches:
            for part in pieces(batch, most=BLOCK_BYTES):
                ids, offsets = encode(part.column("text"), v)
                data, ends = decode(ids, offsets, v)
                true, rows = bytes_of(part.column("text"))
                whole = len(data) == len(true) and (ends == rows).all() and (data == true).all()
                same = np.ones(part.num_rows, bool) if whole else np.array([data[ends[r] : ends[r + 1]].tobytes() == true[rows[r] : rows[r + 1]].tobytes() for r in range(part.num_rows)])
                n_bytes = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(np.diff(offsets)), pa.array(n_bytes), pa.array(same)],
                    names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"],
                )

    return run


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Piece ids of every row, checked by decoding them.

    Null and empty texts give an empty list. Rows are encoded one by one, so repeated rows give equal ids; extra columns
    are ignored, and an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(docs.sparkSession.sparkContext.broadcast(vocabulary(model))), _OUT)


def _back(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            offsets = np.asarray(lists.offsets).astype(np.int64)
            data, ends = decode(np.asarray(lists.values)[offsets[0] : offsets[-1]], offsets - offsets[0], shared.value)
            text = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], names=["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids)."""
    return tokens.select("doc_id", "ids").mapInArrow(_back(tokens.sparkSession.sparkContext.broadcast(vocabulary(model))), "doc_id long, text string")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))
