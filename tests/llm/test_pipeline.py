"""The pipeline's stages, each against brute force on its own input."""

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from rankloom.llm.common import stored

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER))
        out[name] = (before.toPandas(), docs.toPandas(), docs.columns)
    return out


def test_columns(steps):
    assert all(c == COLUMNS for name, (_, _, c) in steps.items() if name != "tokens")


def test_language_keeps_clean_documents(steps):
    before, after, _ = steps["language"]
    assert len(after) >= 0.99 * len(before) and after.text.notna().all()


def test_one_of_each_group(steps):
    from tests.llm.test_operators import brute_components
    before, after, _ = steps["near_duplicates"]
    groups, _ = brute_components(zip(before.doc_id, before.text))
    assert set(after.doc_id) == {c for _, c in groups.values()} and len(after) < len(before)


def test_decontamination(steps):
    before, after, _ = steps["decontamination"]
    items = pq.read_table(f"{FOLDER}/benchmark.parquet").to_pandas().text
    bad = {i for i, t in zip(before.doc_id, before.text) if any(x in t for x in items)}
    assert bad and not bad & set(after.doc_id) and len(after) >= len(before) - len(bad) - 1


def test_personal_data(steps):
    from tests.llm.test_operators import private
    before, after, _ = steps["personal_data"]
    assert len(after) == len(before) and any(private(t) for t in before.text) and not any(private(t) for t in after.text)
    same = before.merge(after, on="doc_id")
    clean = [not private(t) for t in same.text_x]
    assert (same.text_x[clean] == same.text_y[clean]).mean() > 0.99 and (after.n_chars == after.text.str.len()).all()


def test_tokens(steps):
    from rankloom.llm import bpe
    import public_tokenizers
    before, after, _ = steps["tokens"]
    coder = bpe.coder(public_tokenizers.path(bpe.VOCABULARY))
    texts = dict(zip(before.doc_id, before.text))
    assert set(after.doc_id) == set(texts)
    assert all(coder.decode(list(ids)).decode() == texts[i] and n == len(ids) for i, ids, n in zip(after.doc_id, after.ids, after.n_tokens))


def test_run_and_empty_tables(spark, steps, tmp_path):
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == dict(zip(steps["tokens"][1].doc_id, steps["tokens"][1].n_tokens))
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "", 0), (None, "the and of the " * 30, "en", "s", 1), (3, "the and of the " * 30, "en", "s", 1),
            (3, "the and of the " * 30, "en", "s", 1), (4, "the and of mail a@b.co the " * 5, "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 3, 3, 4]
