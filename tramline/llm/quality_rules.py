"""Quality rules: one threshold table compiled into one Spark projection of length, symbol, stop-word and line ratios.

No user function runs: every metric is an expression of the text, and every rule a comparison of integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, bind, documents, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served.
STOP_WORDS = ("the of and to in is that for it as was with be by on this from or an are und der die das den dem in zu mit von für auf nicht ist ein eine sich als im et le la les de des du un une en que est dans pour au par sur avec pas el los las y se con una su para no por lo").split()
#: (metric, comparison, metric it is a share of or None, bound, slack): a text passes if (metric + slack) * 1000 <op> bound * other.
RULES = (
    ("n_words", ">=", None, 10, 0),
    ("word_chars", ">=", "n_words", 2000, 0),  # mean word length
    ("word_chars", "<=", "n_words", 14000, 0),
    ("n_symbols", "<=", "n_words", 150, 0),
    ("n_upper", "<=", "word_chars", 300, 0),
    ("n_bangs", "<=", "n_words", 200, 0),
    ("n_dup_lines", "<=", "n_lines", 400, 0),
    ("n_stop_words", ">=", "n_words", 30, 2),
    ("n_repeat_words", "<=", "n_words", 200, 0),
)
REPEAT = 5


def _removed(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeat_words(tokens: Column, k: int = REPEAT) -> Column:
    """Words covered by runs of k words that occur twice or more in the text."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["g"] == x["g"])) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))
        at = bind(ordered, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return bind(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k)))), F.lit(0), lambda a, b: a + b))

    def counted(h: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        some = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
        return F.when(F.size(h) <= k, F.lit(0)).otherwise(some)

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), counted).cast("long")


def _metrics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    shape = bind(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    line_shape = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "shape": shape,
        "line_shape": line_shape,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": _removed(text, SYMBOLS).cast("long"),
        "n_upper": _removed(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛŸÑÁÍÓÚ").cast("long"),
        "n_bangs": _removed(text, "!").cast("long"),
    }


def score_rules(docs: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Metrics, failed rules and verdict of every row.

    Null and empty texts have no words and fail; other columns of ``docs`` are ignored, so clashing names do no harm.
    Rows are judged one by one: repeated rows get equal results and an empty table gives an empty result.
    """
    m = _metrics(F.col(text_column))
    base = docs.select(F.col(id_column).alias("doc_id"), *[c.alias(k) for k, c in m.items()])
    base = base.select("doc_id", "shape.*", "line_shape.*", "word_chars", "n_symbols", "n_upper", "n_bangs")

    def holds(metric: str, op: str, other: str | None, bound: int, slack: int) -> Column:
        left = F.col(metric) + slack if other is None else (F.col(metric) + slack) * 1000
        right = F.lit(bound) if other is None else F.col(other) * bound
        return left >= right if op == ">=" else left <= right

    passed = [holds(*r) for r in rules]
    failed = F.array_compact(F.array(*[F.when(~p, F.lit(f"{r[0]}{r[1]}{r[3]}")) for r, p in zip(rules, passed, strict=True)]))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return base.withColumn("base_failed", base_failed).withColumn("failed_rules", F.array_join(failed, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_bangs", "n_stop_words", "failed_rules")


def _sql_rule(metric: str, op: str, other: str | None, bound: int, slack: int) -> str:
    left, right = (f"({metric} + {slack})", str(bound)) if other is None else (f"({metric} + {slack}) * 1000", f"{other} * {bound}")
    return f"CASE WHEN NOT ({left} {op} {right}) THEN '{metric}{op}{bound}' END"


_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]"
SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
g AS (
  SELECT doc_id, i, list_slice(ws, i, i + {REPEAT - 1}) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {REPEAT - 2})) AS i FROM w)),
twice AS (
  SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range({REPEAT})) AS k FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM w),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[A-ZÄÖÜÀÂÇÈÉÊËÎÏÔÙÛŸÑÁÍÓÚ]', '', 'g')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_bangs,
    len(list_filter(ws, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    concat_ws(',', {', '.join(_sql_rule(*r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND failed_rules = '') AS kept, n_lines::BIGINT AS n_lines, n_upper, n_bangs, n_stop_words::BIGINT AS n_stop_words, failed_rules FROM j
"""
