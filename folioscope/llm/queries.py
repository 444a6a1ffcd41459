"""Queries of the text and entity problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import addresses, byte_bpe, languages, names, packing, page_noise, personal, strings, subjects
from folioscope.plans.materialize import spread
from folioscope.sources.tables import table


PROSE = ("report", "letter", "contract")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the three tables with its label, read and found."""
    documents = table(spark, d, "documents", "doc_id", "text", "lang")
    pages = table(spark, d, "doc_text", "doc_id", "page_number", "raw_text", "language", "document_type").where(F.col("document_type").isin(*PROSE))
    blocks = table(spark, d, "blocks", "doc_id", "page_number", "detection_order", "raw_text", "language")
    none = F.lit(0)
    profiles = languages.fit_profiles(
        table(spark, d, "subject_examples", "text", "lang").withColumnRenamed("lang", "label"),
        pages.select(F.col("raw_text").alias("text"), F.col("language").alias("label")),
        documents.select("text", F.col("lang").alias("label")),
    )
    rows = (
        documents.select(F.lit("documents").alias("tbl"), "doc_id", none.alias("page_number"), none.alias("detection_order"), F.col("lang").alias("label"), "text")
        .unionByName(pages.select(F.lit("doc_text").alias("tbl"), "doc_id", "page_number", none.alias("detection_order"), F.col("language").alias("label"), F.col("raw_text").alias("text")))
        .unionByName(blocks.select(F.lit("blocks").alias("tbl"), "doc_id", "page_number", "detection_order", F.col("language").alias("label"), F.col("raw_text").alias("text")))
    )
    return languages.label_texts(rows.where(F.length("text") >= languages.LEAST_LETTERS), profiles)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = languages.wrong_labels(_labelled(spark, d)).select("tbl", "doc_id", "page_number", "detection_order", "lang").distinct()
    prose = table(spark, d, "doc_text", "doc_id", "page_number", "document_type").where(F.col("document_type").isin(*PROSE)).select("doc_id", "page_number").distinct()
    held = prose.withColumn("_prose", F.lit(True))
    return wrong.join(held, ["doc_id", "page_number"], "left").where("tbl <> 'blocks' OR _prose").select(wrong.columns)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "doc_text", "doc_id", "page_number", "document_type", *personal.FIELDS))


def _extracted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fields", "doc_id", "page_number", "extractor", "field_name", "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(_texts(spark, d), _extracted(spark, d)).select("doc_id", "page_number", "field", "pii_type", "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts of pages with typed placeholders."""
    return personal.redact(_texts(spark, d), _extracted(spark, d))


def _every_text(spark: SparkSession, d: str) -> tuple[DataFrame, languages.Profiles]:
    """Every text of documents, doc_text and blocks, of any kind and length, and the profiles."""
    documents = table(spark, d, "documents", "doc_id", "text", "lang").withColumnRenamed("lang", "label")
    pages = table(spark, d, "doc_text", "doc_id", "page_number", "raw_text", "language", "document_type").withColumnsRenamed({"raw_text": "text", "language": "label"})
    blocks = table(spark, d, "blocks", "doc_id", "page_number", "detection_order", "raw_text", "language").withColumnsRenamed({"raw_text": "text", "language": "label"})
    examples = table(spark, d, "subject_examples", "text", "lang").withColumnRenamed("lang", "label")
    profiles = languages.fit_profiles(examples, pages.where(F.col("document_type").isin(*PROSE)).select("text", "label"), documents.select("text", "label"))
    none, rest = F.lit(0), ("label", "text")
    rows = documents.select(F.lit("documents").alias("tbl"), "doc_id", none.alias("page_number"), none.alias("detection_order"), *rest)
    rows = rows.unionByName(pages.select(F.lit("doc_text").alias("tbl"), "doc_id", "page_number", none.alias("detection_order"), *rest))
    return rows.unionByName(blocks.select(F.lit("blocks").alias("tbl"), "doc_id", "page_number", "detection_order", *rest)), profiles


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    """Language, script and confidence of every text of the three tables."""
    rows, profiles = _every_text(spark, d)
    return languages.label_texts(rows, profiles, script=True).select("tbl", "doc_id", "page_number", "detection_order", "lang", "script", "confidence").distinct()


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language, script and confidence of every sentence of the three tables."""
    rows, profiles = _every_text(spark, d)
    return languages.segment_texts(rows, profiles, "tbl STRING, doc_id BIGINT, page_number INT, detection_order INT").distinct()


def _buildings(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "fields", "doc_id", "extractor", "field_name", "value").where("extractor = 'IDCardExtractor' AND field_name = 'address'")
    return addresses.buildings(cards.select("doc_id", "value"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return strings.pairs(_buildings(spark, d), "building")


def p3_buildings(spark: SparkSession, d: str) -> DataFrame:
    """Every card with its building and the number of the building's other cards; an unreadable address is null and has none."""
    cards = _buildings(spark, d)
    sizes = cards.where("building IS NOT NULL").groupBy("building").agg(F.countDistinct("doc_id").alias("cards"))
    return cards.join(sizes, "building", "left").select("doc_id", "building", F.coalesce(F.col("cards") - 1, F.lit(0)).alias("links"))


def _prose(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "doc_text", "doc_id", "page_number", "document_type", "raw_text")
    return pages.where(F.col("document_type").isin(*PROSE)).select("doc_id", "page_number", "raw_text").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return page_noise.noisy_lines(_prose(spark, d))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Pages of reports, letters and contracts as continuous readable paragraphs."""
    return page_noise.paragraphs(_prose(spark, d))


def _persons(spark: SparkSession, d: str) -> DataFrame:
    return names.persons(table(spark, d, "fields", "doc_id", "extractor", "field_name", "value"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return strings.pairs(_persons(spark, d), "person")


def p7_persons(spark: SparkSession, d: str) -> DataFrame:
    """Every upload with a name, its person and the number of the person's other uploads; an unreadable name is null and has none."""
    persons = _persons(spark, d)
    sizes = persons.where("person IS NOT NULL").groupBy("person").agg(F.countDistinct("doc_id").alias("uploads"))
    return persons.join(sizes, "person", "left").select("doc_id", "person", F.coalesce(F.col("uploads") - 1, F.lit(0)).alias("links"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.encode_corpus(spread(table(spark, d, "documents", "doc_id", "text")))


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.count_tokens(spread(table(spark, d, "documents", "doc_id", "text")))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(p8_lengths(spark, d), table(spark, d, "containers", "container_kind", "capacity"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p9_filling(spark: SparkSession, d: str) -> DataFrame:
    return packing.filling(_packed(spark, d), table(spark, d, "containers", "container_kind", "capacity"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents", "doc_id", "text"))
    return subjects.assign(documents, subjects.mine(documents, table(spark, d, "subject_examples", "text", "subject", "lang")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Texts and sentences of the corpus by subject."""
    return _subjects(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("n_sentences").alias("sentences"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
