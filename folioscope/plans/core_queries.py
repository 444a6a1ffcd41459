"""Queries of the core problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import nested, timestamps
from folioscope.plans import reference_queries
from folioscope.sources.tables import table


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.paper_dates(
        table(spark, d, "fields", "doc_id", "extractor", "field_name", "value"),
        table(spark, d, "uploads", "doc_id", "station_id"),
        table(spark, d, "stations", "station_id", "zone", "date_order"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("doc_id", "field", "norm").distinct()


def p4_readings(spark: SparkSession, d: str) -> DataFrame:
    """Every resolved value with its format, posterior and mark of ambiguity."""
    return _papers(spark, d).distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.response_nodes(table(spark, d, "responses", "response_id", "payload"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("response_id", "path").distinct()


def p5_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Every structural variant of the tables with its columns and number of objects."""
    return nested.variants(_nodes(spark, d))


def queries() -> dict:
    found = {"p4_found": p4_found, "p4_readings": p4_readings, "p5_found": p5_found, "p5_shapes": p5_shapes}
    for name in nested.SUBTYPES:
        found[f"p5_{name}"] = lambda spark, d, name=name: nested.subtype(_nodes(spark, d), name)
    return reference_queries.QUERIES | found


def oracle_sql() -> dict[str, str]:
    return dict(reference_queries.SQL)
