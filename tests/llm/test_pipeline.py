"""The pipeline's stages, one by one, against plain versions."""

import random

import pytest

import corpus_pipeline
from tests.llm.conftest import prose
from tramline.llm import minhash_dedup, pieces


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    r = random.Random(11)
    items = [(i, " ".join(prose(300 + i, 20)) + "\n" + " ".join(prose(400 + i, 10))) for i in range(20)]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(prose(i, 120))
        if i % 10 == 1:
            text = rows[-1][1].replace("ba", "BA") if i % 20 == 1 else rows[-1][1] + " one more word"
        elif i % 10 == 3:
            text = text[:100] + " " + items[i % 20][1] + " " + text[100:]
        elif i % 10 == 5:
            text += f" password = secret{i:04d}"
        elif i % 10 == 6:
            text += " token=example0123"
        elif i % 10 == 8:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"owner{r.randrange(9)}/repo", len(text)))
        labels.append((i, int(i % 10 != 8), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(texts)
    gone = {
        "quality_classifier": lambda i: i % 10 == 8,
        "minhash_dedup": lambda i: i % 10 == 1,
        "decontamination": lambda i: i % 10 == 3,
        "secret_scan": lambda i: i % 10 == 5,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        kept = {i for i in kept if not gone[name](i)}
        assert set(rows) == kept, name
        assert all(rows[i] == texts[i] for i in rows)
        docs = spark.createDataFrame(out.collect(), out.schema)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(tokens).collect()} == {i: texts[i] for i in kept}


def test_near_duplicate_stage_compares_five_words(spark):
    """One inner word of 45 replaced: 38 of 46 shingles of four words are shared, but only 36 of 46 of five."""
    a = [f"w{k}" for k in range(45)]
    far, near = [*a[:22], "other", *a[23:]], [*a[:44], "end"]
    rows = [(1, a), (2, far), (3, near)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 2}
    assert {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1}


def test_secret_stage_keeps_links(spark):
    links = ["example.com/2023/05/14/story-title-of-the-day", "550e8400-e29b-41d4-a716-446655440000", "id_550e8400-e29b-41d4-a716-446655440000", "doi.org/10.1038/s41586-020-2649-2/figures", "top-100-reasons-to-visit-in-2023", "backup_2023-05-14T120000Z_daily", "getUserById2023HandlerImpl"]
    tokens = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "eyJ1c2VyIjoxMjM0NTY3ODkwLCJhIjp0cnVlfQ", "k4Xq9Lz2/mP8wRt5Yv/Hb3Nc7Jd1"]
    texts = {i: f"clean {x} text" for i, x in enumerate(links)} | {100 + i: f"see {x} here" for i, x in enumerate(tokens)}
    rows = [(i, t, f"owner{i}/repo") for i, t in texts.items()]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.secrets(spark, docs, "").collect()} == set(range(len(links)))


def test_secret_stage_drops_shared_tokens(spark):
    """A token that three owners have is live; in seven copies of one text it is no example; with six owners of other texts it is."""
    rows = [(200 + i, f"text {i} has q7Wn3Zt8Ks5Vb2Mx9Rf4", f"owner{i}/r") for i in range(3)]
    rows += [(300 + i, "all alike p5Gd8Hj2Lm7Qw4Zx9Cv1", f"owner{i}/r") for i in range(7)]
    rows += [(400 + i, f"text {i} with t6Yb1Nc9Kf3Rv8Sx4Jw7", f"owner{i}/r") for i in range(6)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.secrets(spark, docs, "").collect()}
    assert kept == set(range(400, 406))


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {i for i in range(240) if i % 10 in (0, 2, 4, 6, 7, 9)}


def test_odd_rows(spark, folder, tmp_path):
    rows = [(0, None), (1, ""), (2, "one two three"), (2, "one two three"), (None, "no id here"), (4, " ".join(prose(4, 20_000))), (5, None)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, dropped string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if k:  # what the classifier makes of such texts depends on what it has learned
            docs = stage(spark, docs, folder)
            docs.collect()
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 2, None, 4, 5}
    # Null ids and one id with several texts: each row by its own text.
    a, b = " ".join(prose(41, 100)), " ".join(prose(42, 100))
    rows = [(None, a + " password = hunter22"), (None, b), (None, b + " x"), (7, "token = abcdef99"), (7, "clean words here"), (8, a), (9, "nothing " + a), (9, "other words"), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    order = lambda x: sorted(((r["doc_id"] or 0, r["text"]) for r in x.collect()))
    clean = corpus_pipeline.secrets(spark, docs, folder)
    assert order(clean) == sorted((i or 0, t) for k, (i, t) in enumerate(rows) if k not in (0, 3))
    kept = corpus_pipeline.near_duplicates(spark, clean, folder)
    assert [x for x in order(kept) if x[1] not in (b, b + " x")] == sorted([(7, "clean words here"), (8, a), (9, "other words")])
    assert len(order(kept)) == 4
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
