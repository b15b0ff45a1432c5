"""Secret scan by corpus-wide ownership frequency, in DataFrame and SQL functions only.

Candidates are found by pattern with their code-point offsets. Each candidate value is hashed, and the hashes are
aggregated over the corpus by distinct repositories and owners: a value that many owners have is a copied example, a
value that one owner has looks live. Long mixed runs that only one owner has are added as spans of kind ``live``; with
``strict``, as in the pipeline, only those of high entropy, and of fewer owners than an example has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bind, documents, looked_up, stored

_KEY = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEY})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short can have no other match in it, so the least length may stand in these patterns.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
GENERIC = "[A-Za-z0-9+/_-]{20,}"
BASE_KINDS = ("assign", "access", "hex")
#: From so many distinct owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 5
_SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"


_UUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
#: Least length, bits a character, and changes between letters and digits of what looks random.
RANDOM_LENGTH, RANDOM_BITS, RANDOM_CHANGES = 16, 3.0, 4


def running(values: Column, least: Column, join) -> Column:
    """Running results of ``join`` over an array of longs, from the ``least`` value on.

    A fold that appends copies its array each time, so blocks of the root of the size are folded, then their last values.
    """

    def fold(a: Column) -> Column:
        start = F.struct(least.alias("last"), F.array().cast("array<bigint>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = join(acc["last"], x)
            return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(a, start, step, lambda acc: acc["out"])

    def blocks(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda k: fold(F.slice(a, k * size + 1, size)))
        done = lambda b: bind(fold(F.transform(b, lambda x: F.element_at(x, -1))), lambda last: F.transform(b, lambda x, k: F.transform(x, lambda y: join(y, F.coalesce(F.get(last, k - 1), least)))))
        return F.flatten(bind(cut, done))

    return bind(values, lambda a: F.when(F.size(a) <= 16, fold(a)).otherwise(blocks(a)))


def _found(text: Column, pattern: str, kind: str, value, keep) -> Column:
    """Spans of the leftmost non-overlapping matches. ``value`` gives the secret of a match, ``keep`` says which stay."""

    def walk(parts: Column) -> Column:
        def spans(m: Column) -> Column:
            ends = running(F.zip_with(F.slice(parts, 1, F.size(parts) - 1), m, lambda p, x: (F.length(p) + F.length(x)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
            every = F.zip_with(m, ends, lambda x, e: F.struct((e - F.length(x)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), x.alias("value")))
            kept = F.filter(every, lambda s: keep(s["value"]))
            return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), value(s["value"]).alias("value"))).cast(_SPAN)

        return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)

    return bind(F.split(text, pattern, -1), lambda parts: F.when(F.size(parts) <= 1, F.array().cast(_SPAN)).otherwise(walk(parts)))


def apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that touch none of ``base``.

    In one order of base spans by start and the others by end, the largest end of the base spans so far tells.
    """
    item = lambda s, key, base_end: F.struct(key.alias("key"), base_end.alias("base_end"), s.alias("span"))
    none = F.lit(-1).cast("bigint")
    both = F.concat(F.transform(base, lambda s: item(s, s["start"], s["end"])), F.transform(more, lambda s: item(s, s["end"], none)))

    def judged(ordered: Column) -> Column:
        so_far = running(F.transform(ordered, lambda x: x["base_end"]), none, F.greatest)
        clear = F.filter(F.zip_with(ordered, so_far, lambda x, e: F.struct(x["span"].alias("span"), ((x["base_end"] < 0) & (e <= x["span"]["start"])).alias("clear"))), lambda x: x["clear"])
        return F.transform(clear, lambda x: x["span"])

    # A base span that starts where another one ends doesn't touch it: -1 sorts first.
    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(bind(F.sort_array(both), judged))


def _order(span: Column) -> Column:
    rank = F.when(span["kind"] == "assign", 0).when(span["kind"] == "access", 1).when(span["kind"] == "hex", 2).otherwise(3)
    return F.struct(span["start"].alias("start"), rank.alias("rank"), span["end"].alias("end"), span["kind"].alias("kind"), span["value"].alias("value"))


def _joined(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    return F.array_join(F.transform(F.sort_array(F.transform(spans, _order)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def looks_random(value: Column) -> Column:
    """Whether a run of the generic pattern may be a credential rather than a path, slug, date or UUID.

    UUIDs and the parts between slashes, hyphens and underscores that are plain words or numbers don't count. What is left
    must be long, of high entropy, and change often between letters and digits.
    """
    parts = F.split(F.regexp_replace(value, _UUID, "-"), "[/_-]")
    core = F.array_join(F.filter(parts, lambda p: ~p.rlike("^([A-Za-z]?[a-z]*|[A-Z]*|[0-9]*)$")), "-")

    def judged(core: Column) -> Column:
        bare = F.translate(core, "-", "")
        n = F.length(bare).cast("double")

        def add(acc: Column, c: Column) -> Column:
            k = (F.length(bare) - F.length(F.replace(bare, c, F.lit("")))).cast("double")
            return acc + k * F.log2(k)

        bits = F.log2(n) - F.aggregate(F.array_distinct(F.split(bare, "")), F.lit(0.0), add) / n
        changes = F.size(F.regexp_extract_all(core, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), F.lit(0)))
        return F.when(n < RANDOM_LENGTH, False).otherwise((changes >= RANDOM_CHANGES) & (bits >= RANDOM_BITS))

    return bind(core, judged)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, owner, repository, base spans and further high-entropy candidates of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    always = lambda m: F.lit(True)
    whole = lambda m: m
    digits = lambda m: F.length(m) - F.length(F.translate(m, "0123456789", ""))
    letters = lambda m: F.length(m) - F.length(F.regexp_replace(m, "[A-Za-z]", ""))
    # One pass of an alternation tells most rows that nothing is there at all.
    any_of = text.rlike(f"{ASSIGN}|{GENERIC}")
    none = F.array().cast(_SPAN)
    base = F.when(
        any_of,
        F.concat(
            _found(text, ASSIGN, "assign", secret, lambda m: F.length(secret(m)) >= 6),
            _found(text, ACCESS, "access", whole, always),
            _found(text, HEX, "hex", whole, always),
        ),
    ).otherwise(none)
    more = F.when(any_of, _found(text, GENERIC, "live", whole, lambda m: (digits(m) >= 3) & (letters(m) >= 3))).otherwise(none)
    repository = F.coalesce(F.col("source"), F.lit(""))
    out = docs.select("doc_id", F.sha1(text).alias("text_key"), repository.alias("repository"), F.split(repository, "/")[0].alias("owner"), base.alias("base"), more.alias("more"))
    return out.withColumn("more", apart(F.col("more"), F.col("base")))


def ownership(found: DataFrame) -> DataFrame:
    """For every candidate hash the distinct owners and repositories that have it.

    Distinct triples come first, pre-aggregated where the rows are, so that a value in a third of all rows is one row a task.
    """
    each = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select(F.sha2("s.value", 256).alias("hash"), "owner", "repository").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def _by_text(found: DataFrame) -> DataFrame:
    """``found`` with one owner for all copies of a text, the least, so that copying a document makes no examples."""
    first = found.groupBy("text_key").agg(F.min(F.struct("owner", "repository")).alias("first"))
    has = found.where(F.size("base") + F.size("more") > 0).drop("owner", "repository").dropDuplicates(["text_key"])
    return has.join(first, "text_key").select("*", "first.owner", "first.repository")


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, strict: bool = False) -> DataFrame:
    """Secrets of every row; ``text_key`` is the SHA-1 of its text.

    ``strict`` adds only what looks random, adds whatever has fewer owners than an example, and counts copies of a text
    once; without it the results are those of ``SQL``, which adds every run that one owner has.

    Null and empty texts have none. A null source is one owner without a name. Rows that share id and text get equal
    results, rows that share only the id are judged apart, and extra columns are ignored. An empty table gives no rows.
    """
    found = candidates(docs)
    if strict:
        found = found.withColumn("more", F.filter("more", lambda s: looks_random(s["value"])))
    found = stored(found, "secret-candidates")
    owners = ownership(_by_text(found) if strict else found)
    live = F.col("n_owners") < example_owners if strict else F.col("n_owners") == 1
    each = found.select("doc_id", "text_key", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "text_key", "s", F.sha2("s.value", 256).alias("hash")).distinct()
    # A value in a third of all rows is no hot key: its owners are looked up by broadcast.
    owners = stored(each.groupBy("hash").agg(F.count("*").alias("n")).join(owners, "hash"), "owners")
    judged = looked_up(each, owners, "hash").groupBy("doc_id", "text_key").agg(
        F.count_if((F.col("s.kind") != "live") & (F.col("n_owners") == 1)).alias("n_owned"),
        F.count_if((F.col("s.kind") != "live") & (F.col("n_owners") >= example_owners)).alias("n_example"),
        F.collect_list(F.when((F.col("s.kind") == "live") & live, F.col("s"))).alias("added"),
    )
    judged = judged.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_owned", "n_example", "added")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    added = F.coalesce(F.col("added"), F.array().cast(_SPAN))
    out = found.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select(
        "doc_id", "text_key", *[n(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", added)).alias("spans"),
        F.size(added).cast("long").alias("n_live"), F.coalesce("n_owned", F.lit(0)).cast("long").alias("n_owned"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("text_key")


def _sql_found(kind: str, pattern: str, keep: str, value: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, owner, repository, '{kind}' AS kind, s AS start, s + length(m) AS "end", {value} AS value FROM (
      SELECT doc_id, owner, repository, ms[i] AS m, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, owner, repository, regexp_split_to_array(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS ms FROM d))) WHERE {keep}"""


_A = ASSIGN.replace("'", "''")
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repository, split_part(coalesce(source, ''), '/', 1) AS owner FROM documents),
base AS (
  {_sql_found("assign", ASSIGN, f"length(regexp_extract(m, '{_A}', 2)) >= 6", f"regexp_extract(m, '{_A}', 2)")}
  UNION ALL {_sql_found("access", ACCESS, "true", "m")}
  UNION ALL {_sql_found("hex", HEX, "true", "m")}),
generic AS (
  {_sql_found("live", GENERIC, "length(regexp_replace(m, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= 3", "m")}),
apart AS (
  SELECT * FROM generic g WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = g.doc_id AND b.start < g."end" AND g.start < b."end")),
every AS (SELECT * FROM base UNION ALL SELECT * FROM apart),
owners AS (SELECT value, count(DISTINCT owner) AS n_owners FROM every GROUP BY value),
judged AS (SELECT * FROM every JOIN owners USING (value)),
spans AS (
  SELECT doc_id, concat_ws(':', kind, start, "end") AS span, start, "end", kind, list_position(['assign', 'access', 'hex', 'live'], kind) AS r, n_owners FROM judged
  WHERE kind <> 'live' OR n_owners = 1),
agg AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    count(*) FILTER (kind = 'live') AS n_live, count(*) FILTER (kind <> 'live' AND n_owners = 1) AS n_owned, count(*) FILTER (kind <> 'live' AND n_owners >= {EXAMPLE_OWNERS}) AS n_example,
    coalesce(string_agg(span, ',' ORDER BY start, r, "end") FILTER (kind <> 'live'), '') AS base, string_agg(span, ',' ORDER BY start, r, "end") AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_owned, 0) AS n_owned, coalesce(n_example, 0) AS n_example
FROM documents LEFT JOIN agg USING (doc_id)
"""
