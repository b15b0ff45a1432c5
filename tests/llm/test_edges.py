"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator."""

import pytest

from tests.llm.conftest import prose
from tramline.llm import decontaminate, language_id, minhash_dedup, personal_data, pieces, pitman_yor, quality_classifier, quality_rules, secret_scan, substring_dedup

LONG = " ".join(prose(1, 40_000))
ROWS = [(0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, LONG), (5, LONG), (6, "Token = 'abcdef123456'"), (6, "Token = 'abcdef123456'"), (None, "a text without an id"), (8, "x" * 30_000), (9, "été 日本語 \U0001d518 ▁ a")]


def _benchmark(spark, rows=((1, "what is asked here now\nthe answer is that"), (2, None), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "minhash": lambda spark, d: minhash_dedup.near_duplicates(d),
    "rules": lambda spark, d: quality_rules.score_rules(d),
    "language": lambda spark, d: language_id.identify(d, language_id.learn(d)),
    "personal": lambda spark, d: personal_data.personal_data(d, personal_data.Tagger()),
    "pieces": lambda spark, d: pieces.encoded(d),
    "substring": lambda spark, d: substring_dedup.repeated_passages(d),
    "secrets": lambda spark, d: secret_scan.scan(d),
    "classifier": lambda spark, d: quality_classifier.score(d, quality_classifier.learn(d, _labels(spark))),
    "pitman_yor": lambda spark, d: pitman_yor.scores(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    out = [r.asDict() for r in OPERATORS[name](spark, docs(ROWS)).collect()]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in ROWS)
    twice = [r for r in out if r["doc_id"] == 6]
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, docs, name):
    assert OPERATORS[name](spark, docs([])).count() == 0


def test_odd_rows_of_a_benchmark(spark, docs):
    assert decontaminate.contamination(docs(ROWS), _benchmark(spark)).count() == 0
    assert decontaminate.contamination(docs([]), _benchmark(spark)).count() == 0
    assert decontaminate.contamination(docs(ROWS), _benchmark(spark, [])).count() == 0
    assert decontaminate.clean(docs(ROWS), _benchmark(spark, [])).count() == len(ROWS)


def test_defined_results(spark, docs):
    d = docs(ROWS)
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(d).select("doc_id", "n_shingles", "component_id", "kept").collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True)} <= near and {(4, True), (5, False)} <= {(a, k) for a, _, _, k in near}
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(d, language_id.learn(d)).collect()}[0] == "und"
    assert all(r["round_trip"] for r in pieces.encoded(d).collect())
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.repeated_passages(d).collect()}
    assert cut[4] == (40_000, 0) and cut[5] == (40_000, 40_000) and cut[0] == (0, 0)
    tokens = {r["doc_id"]: r["n_tokens"] for r in pitman_yor.scores(d).collect()}
    assert tokens[0] == tokens[1] == tokens[2] == 1 and tokens[3] == 3
    assert {r["doc_id"]: r["kept"] for r in quality_rules.score_rules(d).collect()}[0] is False
