"""Nulls in every column, and extra columns whose names clash with those that operators add."""

import pytest
from pyspark.sql import functions as F

from folioscope.llm import addresses, byte_bpe, languages, names, packing, page_noise, personal, subjects
from test_texts import PAGE, SENTENCES


def with_nulls(frame):
    """The frame's rows, and each again with one column null; a column of every name that operators use inside."""
    out = frame
    for c in frame.columns:
        out = out.unionByName(frame.withColumn(c, F.lit(None).cast(dict(frame.dtypes)[c])))
    for extra in ("n", "key", "word", "node", "root", "place", "result", "kind"):
        if extra not in frame.columns:
            out = out.withColumn(extra, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def profiles():
    import pandas as pd

    return languages.fit_rows(pd.DataFrame({"text": list(SENTENCES.values()) * 3, "label": list(SENTENCES) * 3}))


def test_languages(spark, profiles):
    rows = with_nulls(spark.createDataFrame([("documents", 1, 0, 0, "fr", SENTENCES["de"])], "tbl STRING, doc_id BIGINT, page_number INT, detection_order INT, label STRING, text STRING"))
    assert {r.lang for r in languages.wrong_labels(languages.label_texts(rows, profiles)).collect()} == {"de"}
    languages.segment_texts(rows, profiles).collect()


def test_pages(spark):
    rows = with_nulls(spark.createDataFrame([(1, 2, PAGE, PAGE, PAGE, "report")], "doc_id BIGINT, page_number INT, text STRING, raw_text STRING, normalized_text STRING, document_type STRING"))
    assert page_noise.noisy_lines(rows).count() > 0 and page_noise.paragraphs(rows).count() > 0
    personal.find(rows).collect()
    assert personal.redact(rows).where("raw_text IS NULL").count() == 1


def test_entities(spark):
    fields = with_nulls(spark.createDataFrame([(1, "IDCardExtractor", "name", "Patricia Legopuvan"), (2, "CVExtractor", "name", "Legopuvan, Pat")], "doc_id BIGINT, extractor STRING, field_name STRING, value STRING"))
    people = {r.doc_id: r.person for r in names.persons(fields).collect()}
    assert people[1] == people[2]
    cards = with_nulls(spark.createDataFrame([(1, "64 Pagufe Street, Zedugiford, 10105"), (2, "65 Pagufe Street, Zedugiford, 10105")], "doc_id BIGINT, value STRING"))
    found = {r.doc_id: r.building for r in addresses.buildings(cards.select("doc_id", "value")).collect()}
    assert found[1] != found[2]


def test_documents(spark):
    rows = with_nulls(spark.createDataFrame([(1, "hello world")], "doc_id BIGINT, text STRING"))
    assert sorted(len(r.ids) for r in byte_bpe.encode_corpus(rows).collect()) == [0, 2, 2]
    kinds = spark.createDataFrame([("s", 8), (None, 8), ("x", None)], "container_kind STRING, capacity INT")
    assert packing.pack(byte_bpe.count_tokens(rows), kinds).where("container_kind = 's'").agg(F.sum("tokens")).first()[0] == 4
    examples = spark.createDataFrame([("the verdict", "law", "en"), (None, "law", "en"), ("the broth", None, "en"), ("the choir", "music", None)], "text STRING, subject STRING, lang STRING")
    assert subjects.assign(rows, subjects.mine(rows, examples)).count() == 0
