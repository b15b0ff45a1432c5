"""Near-duplicates: many universal hash minima in bands, links verified on signatures and full sets, components.

1. One pass over the texts makes shingle sets, ``ROWS * BANDS`` minima, a hash of each band and one byte of each
   minimum (the signature). Texts with equal words are one class, held by one of its rows; only classes go on.
2. In each bucket of a band every class is linked to the least one; the candidate with most bands in common is
   verified first. Then a few rounds link what is outside of the component of a bucket's pivot to the nearest pivot.
   Components of these links leave few buckets that hold more than one component.
3. In those buckets the pairs *between* components are compared, so that no link is lost and no pair within a
   component is ever made. One bit of each of 384 minima makes a sketch; what the sketches of a component have in
   common bounds the distance of all its members from another component, and only components that can be near
   enough meet. Jaccard distance obeys the triangle inequality, so two texts whose exact distances from their common
   first candidate differ by more than a link allows aren't compared. Nor are texts that have too many shingles to
   themselves: of two texts' shingles only those that some other text has too can be in both. Components are then taken
   over all links.

A pair of similarity s shares no band with probability (1 - s ** ROWS) ** BANDS: 1.9e-6 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import documents, looked_up, release, stored
from .textblocks import Block, U, block, mix, pieces

ROWS, BANDS = 7, 56
#: Words of a shingle where op1's SQL sets it.
SHINGLE = 4
#: Links have 100 * intersection >= LEAST * union.
LEAST = 80
#: Candidates whose signatures agree on a lower share are not verified: five standard errors below LEAST.
SIGNATURE_SHARE = 0.70
#: Sketches of a link differ in a tenth of their 384 bits; this is four and a half standard errors more.
SKETCH_LONGS, SKETCH_FAR = 6, 65
#: Rounds with pivots before all remaining pairs of components are compared.
ROUNDS = 1

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(0, 2**31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, ROWS * BANDS, dtype=np.uint32)


def shingle_sets(b: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows in one array, and the rows' offsets in it."""
    hashes, at = b.windows(size)
    row = b.row_of[at]
    n = np.diff(b.offsets)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        whole = np.zeros(len(short), U)
        for j in range(size - 1):
            has = n[short] > j
            whole[has] = mix(whole[has] * U(3) + b.hashes[b.offsets[short[has]] + j] + U(j + 11))
        hashes, row = np.concatenate([hashes, whole]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(n) + 1))


def minima(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ROWS * BANDS minima for each set that isn't empty."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), len(_A)), np.uint32)
    if len(full):
        x = (sets >> U(32)).astype(np.uint32)
        at = offsets[full]
        room = np.empty_like(x)
        for j in range(len(_A)):
            np.multiply(x, _A[j], out=room)
            room += _B[j]
            out[:, j] = np.minimum.reduceat(room, at)
    return out


_SKETCH = [f"s{j}" for j in range(SKETCH_LONGS)]
_SIGNED = "doc_id long, raw long, row long, n_shingles long, text_key binary, bands array<long>, signature binary, " + ", ".join(f"s{j} long" for j in range(SKETCH_LONGS))


def _sign(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                b = block(part.column("text"), lower=True)
                sets, offsets = shingle_sets(b, size)
                n = np.diff(offsets)
                m = minima(sets, offsets)
                hashes = np.zeros((len(m), BANDS), U)
                for j in range(ROWS):
                    hashes = mix(hashes * U(31) + m[:, j::ROWS].astype(U) + U(j + 1))
                hashes = mix(hashes + np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15))
                ends = np.zeros(part.num_rows + 1, np.int32)
                np.cumsum(np.where(n > 0, BANDS, 0), out=ends[1:])
                full = np.cumsum(n > 0) - 1
                small = (m & np.uint32(255)).astype(np.uint8)
                # The low bit of a minimum is that of one value; a higher bit of its product with an odd number is as good as random.
                bits = ((m[:, : 64 * SKETCH_LONGS] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
                sketch = np.zeros((part.num_rows, SKETCH_LONGS), np.int64)
                sketch[n > 0] = np.packbits(bits, axis=1).view(np.int64)
                keys = [hashlib.blake2b(b" ".join(b.text(r).split()), digest_size=16).digest() for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("raw"),
                        part.column("row"),
                        pa.array(n.astype(np.int64)),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.reshape(-1).view(np.int64))),
                        pa.array([small[full[r]].tobytes() if n[r] else b"" for r in range(part.num_rows)], pa.binary()),
                        *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH_LONGS)],
                    ],
                    names=["doc_id", "raw", "row", "n_shingles", "text_key", "bands", "signature", *_SKETCH],
                )

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the candidate pairs whose signatures agree well enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = pa.array(share >= SIGNATURE_SHARE)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])


def _measure(size: int) -> Callable:
    """Jaccard distance of the full shingle sets of each pair, and whether it is a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "ta"):
                (sa, oa), (sb, ob) = (shingle_sets(block(part.column(c), lower=True), size) for c in ("ta", "tb"))
                far, linked = np.ones(part.num_rows), np.zeros(part.num_rows, bool)
                for r in range(part.num_rows):
                    x, y = sa[oa[r] : oa[r + 1]], sb[ob[r] : ob[r + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    every = len(x) + len(y) - both
                    if both:
                        far[r], linked[r] = 1 - both / every, 100 * both >= LEAST * every
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), pa.array(linked), pa.array(far)], names=["u", "v", "linked", "far"])

    return run


def _measured(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(u, v, linked, far) of pairs, from their whole texts."""
    full = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("ta")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tb")), "v")
    return stored(full.mapInArrow(_measure(size), "u long, v long, linked boolean, far double"), "measured-pairs")


def _confirmed(pairs: DataFrame, signed: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Candidate pairs (u, v) that hold on signatures and on full sets."""
    sig = signed.select("rep", "signature")
    near = pairs.join(sig.select(F.col("rep").alias("u"), F.col("signature").alias("sa")), "u").join(sig.select(F.col("rep").alias("v"), F.col("signature").alias("sb")), "v")
    return _measured(near.mapInArrow(_alike, "u long, v long"), texts, size).where("linked").select("u", "v")


def _apart(*sides: tuple[str, str]) -> Column:
    """Bits in which the sketches are sure to differ. Each side: prefixes of the bits that all have, and that any has."""
    (all_a, any_a), (all_b, any_b) = sides
    differ = [F.bit_count(F.col(f"{all_a}{j}").bitwiseAND(F.bitwise_not(f"{any_b}{j}"))) + F.bit_count(F.col(f"{all_b}{j}").bitwiseAND(F.bitwise_not(f"{any_a}{j}"))) for j in range(SKETCH_LONGS)]
    return reduce(lambda x, y: x + y, differ)


def _mixed(members: DataFrame, part: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with component, size and sketch."""
    placed = members.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return stored(placed.join(mixed, "band").join(reps.select("rep", "n_shingles", "pivot", "far", "signature", *_SKETCH), "rep"), "mixed-buckets")


def _to_pivots(placed: DataFrame, turn: int) -> DataFrame:
    """One pair for every text outside its buckets' pivots' components: with the pivot whose sketch is nearest.

    The pivot of a bucket is one of its members by a hash, so large components tend to have it.
    """
    lot = F.xxhash64("rep", F.lit(turn))
    least = placed.groupBy("band").agg(F.min(lot).alias("lot"))
    sketch = [F.col(c).alias(f"p{j}") for j, c in enumerate(_SKETCH)]
    pivots = placed.select("band", F.col("rep").alias("v"), F.col("component").alias("cv"), lot.alias("lot"), *sketch).join(least, ["band", "lot"]).drop("lot")
    pivots = stored(pivots.dropDuplicates(["band"]), "pivots")
    far = _apart(("s", "s"), ("p", "p"))
    pairs = placed.join(pivots, "band").where("component <> cv").select("rep", "v", far.alias("far")).where(F.col("far") <= SKETCH_FAR)
    return pairs.groupBy(F.col("rep").alias("u")).agg(F.min_by("v", F.struct("far", "v")).alias("v"))


def _shingles(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets, offsets = shingle_sets(block(part.column("text"), lower=True), size)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column("doc_id")), np.diff(offsets))), pa.array(sets.view(np.int64))], names=["rep", "shingle"])

    return run


def _with_common(placed: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``placed`` with the number of shingles of each text that another of these texts has too."""
    ids = placed.select(F.col("rep").alias("doc_id")).distinct()
    each = texts.join(ids, "doc_id", "left_semi").mapInArrow(_shingles(size), "rep long, shingle long")
    lone = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    lone = stored(lone, "lone-shingles")
    return stored(placed.join(lone, "rep", "left").withColumn("common", F.col("n_shingles") - F.coalesce("own", F.lit(0))).drop("own"), "mixed-buckets")


def _across(placed: DataFrame) -> DataFrame:
    """Pairs of texts of different components that share a bucket, and that may be near enough."""
    both = lambda x: [f(c).alias(f"{n}{x}{j}") for j, c in enumerate(_SKETCH) for n, f in (("all", F.bit_and), ("any", F.bit_or))]
    side = lambda x: placed.groupBy("band", F.col("component").alias(f"c{x}")).agg(F.min("n_shingles").alias(f"lo{x}"), F.max("n_shingles").alias(f"hi{x}"), F.max("common").alias(f"k{x}"), F.count("*").alias(f"n{x}"), *both(x))
    sized = lambda lo, hi: F.col(lo) * LEAST <= F.col(hi) * 100
    # At most so many shingles are in both, so at least so many are in either.
    enough = lambda ka, kb, na, nb: 100 * F.least(ka, kb) >= LEAST * (F.col(na) + F.col(nb) - F.least(ka, kb))
    near = (F.col("ca") < F.col("cb")) & enough("ka", "kb", "loa", "lob") & sized("loa", "hib") & sized("lob", "hia") & (_apart(("alla", "anya"), ("allb", "anyb")) <= SKETCH_FAR)
    a, b = side("a"), side("b")
    # Two components meet once, however many buckets they share.
    meet = a.join(b.withColumnRenamed("band", "band_b"), (F.col("band") == F.col("band_b")) & near).select("ca", "cb").distinct()
    members = placed.drop("band").dropDuplicates(["rep"])
    size = members.groupBy("component").agg(F.count("*").alias("n"))
    meet = meet.join(size.toDF("ca", "na"), "ca").join(size.toDF("cb", "nb"), "cb")
    # The members of the smaller one meet those of the larger one, so that a large one isn't written out for each other.
    small = F.col("na") <= F.col("nb")
    meet = stored(meet.select(F.when(small, F.col("ca")).otherwise(F.col("cb")).alias("ca"), F.when(small, F.col("cb")).otherwise(F.col("ca")).alias("cb")), "meeting-components")
    own = lambda x: [F.col(k).alias(f"{x}{j}") for j, k in enumerate(_SKETCH)] + [F.col("signature").alias(f"s_{x}"), F.col("common").alias(f"{x}_common"), F.col("pivot").alias(f"{x}_pivot"), F.col("far").alias(f"{x}_far")]
    one = lambda c, n, u, x: members.select(F.col("component").alias(c), F.col("rep").alias(u), F.col("n_shingles").alias(n), *own(x))
    left = meet.join(one("ca", "nu", "u", "x"), "ca")
    right = one("cb", "nv", "v", "y").withColumnRenamed("cb", "cb_b")
    beyond = (F.col("x_pivot") == F.col("y_pivot")) & (F.abs(F.col("x_far") - F.col("y_far")) > 1 - LEAST / 100 + 1e-9)
    close = sized("nu", "nv") & sized("nv", "nu") & enough("x_common", "y_common", "nu", "nv") & (_apart(("x", "x"), ("y", "y")) <= SKETCH_FAR) & ~F.coalesce(beyond, F.lit(False))
    # Each pair comes once: its components meet once, and each text is in one of them.
    pairs = left.join(right, (F.col("cb") == F.col("cb_b")) & close).select("u", "v", F.col("s_x").alias("sa"), F.col("s_y").alias("sb"))
    return pairs.mapInArrow(_alike, "u long, v long")


#: Ids below this in size number their texts themselves.
_OWN = 1 << 62


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` with a number of each text: its least id, or one above all ids where there is none or another text has it.

    In buckets the least number is the first hub, and of a group of copies the least id is often what the others come from.
    """
    classes = stored(classes, "unnumbered-texts")
    ids = F.col("first.doc_id")
    low, high = classes.agg(F.min(ids), F.max(ids)).first()
    if low is None or low < -_OWN or high >= _OWN:
        return classes.withColumn("rep", F.col("row"))
    holder = classes.where(ids.isNotNull()).groupBy(ids.alias("_id")).agg(F.min("row").alias("_row"))
    own = classes.join(holder, (ids == F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    return own.withColumn("rep", F.coalesce("_id", F.lit(_OWN) + F.col("row"))).drop("_id", "_row")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, raw, n_shingles, component_id, kept and chosen for every row; shingles have ``size`` words.

    Null and empty texts, and texts of spaces, have no shingles and are linked with nothing. Rows are judged by their
    texts, so rows with one id and different texts may be in different components, and rows with a null id are in
    components too: the component has its least id that isn't null, if any. ``kept`` tells whether a row has that id (or
    null, where there is none), so all rows that repeat it are kept. ``chosen`` marks one id and text of each component,
    where ``raw`` is a hash of the text: repeated rows are alike in it. Extra columns are ignored; an empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("raw"))
    # A row's number is drawn once, as the table is written.
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sign(size), _SIGNED), "signed")
    some = rows.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("raw"))).alias("first")
    classes = stored(_numbered(some.groupBy("text_key").agg(F.min("row").alias("row"), F.count("*").alias("n"), first)), "texts")
    reps = some.join(classes.select("row", "rep"), "row")
    reps = stored(reps.select("rep", "doc_id", "raw", "n_shingles", "signature", "bands", *_SKETCH), "classes")
    members = reps.select("rep", F.explode("bands").alias("band"))
    buckets = stored(members.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    members = stored(members.join(buckets, "band"), "members")
    candidates = members.where("rep <> least").groupBy(F.col("rep").alias("u"), F.col("least").alias("v")).agg(F.count("*").alias("n"))
    first = stored(candidates.groupBy("u").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v")), "first-pairs")
    held = reps.select("rep", F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).join(members.select("rep").distinct(), "rep")
    whole = docs.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")))
    texts = stored(whole.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "candidate-texts")
    release(docs.sparkSession)
    measured = _measured(first, texts, size)
    links = measured.where("linked").select("u", "v")
    known = measured.select(F.col("u").alias("rep"), F.col("v").alias("pivot"), "far")
    heads = measured.select(F.col("v").alias("rep")).distinct().join(known.select("rep"), "rep", "left_anti")
    reps = stored(reps.drop("bands", "doc_id", "raw").join(known.union(heads.select("rep", F.col("rep").alias("pivot"), F.lit(0.0).alias("far"))), "rep", "left"), "classes")
    part = components(links)
    for turn in range(ROUNDS):
        placed = _mixed(members, part, reps)
        links = links.union(_confirmed(stored(_to_pivots(placed, turn), "pivot-pairs"), reps, texts, size))
        part = components(links)
        release(docs.sparkSession)
    placed = _with_common(_mixed(members, part, reps), texts, size)
    more = _measured(stored(_across(placed), "cross-pairs"), texts, size).where("linked").select("u", "v")
    part = part.select(F.col("node").alias("rep"), "component")
    # Links among components: their representatives stand for them.
    label = part.select(F.col("rep"), "component")
    named = more.join(label.select(F.col("rep").alias("u"), F.col("component").alias("cu")), "u", "left").join(label.select(F.col("rep").alias("v"), F.col("component").alias("cv")), "v", "left")
    joined = components(named.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("final"))
    final = classes.join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep")).join(joined, "component", "left")
    final = stored(final.select("text_key", "n", "first", F.coalesce("final", "component").alias("component")), "placed-classes")
    release(docs.sparkSession)
    whole = stored(final.groupBy("component").agg(F.min("first").alias("best"), F.count("*").alias("n")), "components")
    named = looked_up(final.withColumnRenamed("n", "rows_of"), whole, "component").select("text_key", "best", F.col("rows_of").alias("n"))
    out = looked_up(some.select("doc_id", "raw", "n_shingles", "text_key"), stored(named, "named-classes"), "text_key")
    chosen = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("raw") == F.col("best.raw"))
    out = out.select("doc_id", "raw", "n_shingles", F.col("best.doc_id").alias("component_id"), chosen.alias("chosen"))
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "raw", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


_WORD = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + {SHINGLE - 1}) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {LEAST} * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(v) AS component_id, d.doc_id = min(v) AS kept
FROM documents d JOIN reach ON u = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, n
"""
