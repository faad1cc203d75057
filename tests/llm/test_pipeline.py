import re

import corpus_pipeline
import pytest
from llm_texts import ODD_COLUMNS, prose

from glebe.llm import chunks, registered


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(240):
        text = prose(i // 2, 50 + i % 40 if i % 2 == 0 else 50 + (i - 1) % 40)
        if i % 10 == 4:
            text = " ".join(w + "###" for w in text.split())
        if i % 12 == 0:
            text += f" write to some{i}@mail.example now"
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
        labels.append((i, int(i % 10 not in (4, 5) or i % 10 == 5), int(i % 9 == 0)))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (5, rows[5][1], "en", "hot", 7), (302, prose(900, 20_000), "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, folder)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name == "quality_rules":
            assert docs.filter("text like '%###%' or text is null or text = ''").count() == 0
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids)) and all(i % 2 == 0 or i % 12 == 1 or i % 10 == 5 for i in ids)
        if name == "personal_data":
            assert not any(re.search("@mail", r.text) for r in docs.collect())
            assert docs.filter("n_chars <> length(text)").count() == 0 and docs.filter("text like '%[email]%'").count() > 5
    assert counts[0] > counts[1] > counts[2] == counts[3] != counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_is_the_stages_in_order(spark, folder):
    whole = corpus_pipeline.run(spark, folder)
    assert whole.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    sums = {r.sequence_id: r["sum(length)"] for r in whole.groupBy("sequence_id").sum("length").collect()}
    assert max(sums.values()) <= 2048 and len(corpus_pipeline.STAGES) == 5


def test_stages_with_odd_and_no_documents(spark, odd_docs, no_docs, folder):
    for docs in (odd_docs, no_docs):
        for _, function in corpus_pipeline.STAGES[:-1]:
            out = function(spark, docs, folder)
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= docs.count()
    assert len(ODD_COLUMNS.split(",")) == len(odd_docs.columns) - 5


def test_stages_chain_without_being_written(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    chained = corpus_pipeline.near_duplicates(spark, good, folder)
    other = corpus_pipeline.quality_rules(spark, docs, folder)
    assert chained.count() < good.count() == other.count()


def test_every_operator_is_registered():
    names = set(registered.QUERIES)
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert set(registered.ORACLES) <= names and chunks.LEAST_WORDS < 50
