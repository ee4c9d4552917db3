"""The pipeline's stages against brute force, each on its own input."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute_force import brute_components, brute_removed
from specimen_spark.llm import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_return_documents(stages):
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(stages):
    mask = quality.mask("v1")
    want = {i for i, t in texts(stages[0]).items() if not quality.fail_bits(*quality.measure(t)) & mask}
    assert set(texts(stages[1])) == want


def test_language_stage_keeps_clean_documents(stages):
    assert set(texts(stages[2])) == set(texts(stages[1]))


def test_near_duplicate_stage(stages):
    want = {i for i, (_, _, kept) in brute_components(texts(stages[2]), 5, 80, 100).items() if kept}
    assert set(texts(stages[3])) == want


def test_repeat_stage(stages):
    want = {i: kept.decode(errors="ignore") for i, _, _, _, kept in brute_removed(list(texts(stages[3]).items()))}
    assert texts(stages[4]) == want
    assert stages[4].where(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_stage(stages):
    rows = stages[5].collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024 and {r.doc_id for r in rows} == set(texts(stages[4]))
    assert len(ends) <= np.ceil(sum(ends.values()) / 1024) * 1.02 + 1


def test_odd_documents_go_through(spark):
    rows = [(None, "some words without an id " * 20, "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0),
            (3, "words of a text that is here twice " * 3 + "and more so " * 4, "en", "s", 9)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("block", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.where("false"), SF).count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clean_words(lang, seed, n=60):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = [t for t, known in zip(table["text"], table["lang"]) if known == lang and t]
    words = " ".join(texts).split()
    return " ".join(words[seed * n:(seed + 1) * n])


def test_copies_are_decided_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, a), (None, b), (None, b), (None, b + " more"), (2, a + " more"), (2, c), (None, d), (9, d), (5, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_first_of_copies(spark, docs, SF).collect()]
    kept_b = [t for _, t in got if t and t.startswith("b")]
    assert len(kept_b) == 1
    assert sorted(map(str, [x for x in got if x[1] not in kept_b])) == sorted(map(str, [(1, a), (2, c), (9, d), (5, None), (5, None)]))


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(i, clean_words("en", i), None, "s", 1) for i in range(3)], DOCS)
    assert corpus_pipeline.keep_one_language(spark, docs, SF).count() == 3


def test_language_stage_judges_spans(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    langs = sorted(r.lang for r in table.where("lang IS NOT NULL").select("lang").distinct().collect())[:3]
    mixed = " ".join(clean_words(lang, 1) for lang in langs)
    odd = [(-1, mixed, None), (-2, "\u6f22\u5b57\u6587\u7ae0 " * 60, None), (-3, "zqxjvk wqzzxj kvxqjz jqzwxv " * 40, None)]
    docs = table.union(spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in odd], DOCS))
    assert {r.doc_id for r in corpus_pipeline.keep_one_language(spark, docs, SF).where("doc_id < 0").collect()} == {-1}
