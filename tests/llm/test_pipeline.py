import random

import pytest

import corpus_pipeline
from tallyspark.llm import registry


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "on", "er", "an", "re"]) for _ in range(3)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    top = tmp_path_factory.mktemp("sf")
    rows = [(i, words(rng, 60), "en", "s", 0) for i in range(30)]
    rows += [(40, rows[3][1], "en", "s", 0), (41, rows[4][1] + " more", "en", "s", 0), (42, None, "en", "s", 0), (43, "123 456", "en", "s", 0), (44, "kurz " + rows[7][1][:20], None, "s", 0)]
    item = words(rng, 20)
    rows.append((45, words(rng, 30) + " " + item + " " + words(rng, 30), "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_keep_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        left[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
    everything = set(range(30)) | {40, 41, 42, 43, 44, 45}
    assert left["language_id"] == everything - {42, 43}
    assert left["line_dedup"] == everything - {40}
    assert left["jaccard_join"] == everything - {40, 41}
    assert left["decontaminate"] == everything - {45}


def test_stages_take_nulls_clashing_names_and_empty_tables(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, cls long, __x string, fingerprint string"
    rows = [(None, None, None, None, None, None, None, None, None), (None, "", None, None, 0, 1, 1, "x", "f"), (None, "some words here", "en", None, 15, 1, 1, "x", "f"), (7, None, "en", "s", None, 1, 1, "x", "f")]
    rows += [(7, "the onthere anonon reerer " * 12, "en", "s", 0, 1, 1, "x", "f")] * 2 + [(k, "anthere onon " * 20 + "erthe " * k, "en", "s", 0, 1, 1, "x", "f") for k in range(10, 14)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, docs, folder).count() <= len(rows)
        assert stage(spark, docs.limit(0), folder).count() == 0
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()}
    assert {(None, None), (None, ""), (7, None)} <= left
    assert corpus_pipeline.tokens(spark, docs, folder).count() == len(rows) and corpus_pipeline.tokens(spark, docs.limit(0), folder).count() == 0


def test_run_applies_all(spark, folder):
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(range(30)) | {44}
    assert all(r["n_tokens"] > 0 for r in got.values())


def test_names_and_sql():
    names = set(registry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(registry.oracle_sql()) <= names
