"""Accuracy of recognised texts and fields against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import words_of

#: Tokens become code points from the second plane on, where there is room for a million and no surrogate.
_BASE = 0xFFFF


def token_text(tokens: Column, vocabulary: Column, symbols: Column) -> Column:
    """Tokens as a text of one character each, so that the built-in edit distance counts tokens.

    ``vocabulary`` and ``symbols`` must be columns that stand already: what a lambda holds is computed for every token.
    """
    return F.array_join(F.transform(tokens, lambda t: F.element_at(symbols, F.array_position(vocabulary, t).cast("int"))), "")


def _symbols(vocabulary: Column) -> Column:
    """A character for each place of the vocabulary."""
    return F.transform(vocabulary, lambda _, i: F.decode(F.unhex(F.lpad(F.hex(i + F.lit(_BASE + 1)), 8, "0")), "UTF-32"))


#: Edits within which the band of the edit distance is tried first; a wider one takes a share of 1 / WIDE of the text.
BANDS, WIDE = (16, 64), 8


def _with_distance(rows: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """Adds the exact edit distance of two texts that are not null.

    A band of k edits either gives the distance or tells that it is larger, in time k times the length in place of the
    square; only texts that differ by more than every band are compared in full.
    """
    found, shorter = F.col(name), F.least(F.length(a), F.length(b))
    out = rows.withColumn(name, F.when(F.col(a) == F.col(b), 0).otherwise(F.levenshtein(a, b, BANDS[0])))
    for k in BANDS[1:]:
        out = out.withColumn(name, F.when(found >= 0, found).otherwise(F.levenshtein(a, b, k)))
    wide = F.call_function("levenshtein", F.col(a), F.col(b), F.floor(shorter / WIDE).cast("int"))
    out = out.withColumn(name, F.when((found >= 0) | (shorter <= WIDE * BANDS[-1]), found).otherwise(wide))
    return out.withColumn(name, F.when(found >= 0, found).otherwise(F.levenshtein(a, b)))


def text_metrics(rows: DataFrame, expected: str = "expected_text", actual: str = "actual_text") -> DataFrame:
    """Adds character_errors, word_errors, expected_characters, expected_words, cer, wer, exact_match; null counts as empty."""
    e, a = (F.coalesce(F.col(c), F.lit("")) for c in (expected, actual))
    out = rows.withColumns({"_e": e, "_a": a}).withColumns({"_ew": words_of(F.col("_e")), "_aw": words_of(F.col("_a"))})
    out = out.withColumn("_known", F.when(F.col("_ew") != F.col("_aw"), F.array_distinct(F.concat("_ew", "_aw"))))
    out = out.withColumn("_symbols", _symbols(F.col("_known")))
    # pages of the same words have no vocabulary and no word errors
    out = out.withColumns({f"{c}t": F.coalesce(token_text(F.when(F.col("_known").isNotNull(), F.col(c)), F.col("_known"), F.col("_symbols")), F.lit("")) for c in ("_ew", "_aw")})
    out = _with_distance(_with_distance(out, "character_errors", "_e", "_a"), "word_errors", "_ewt", "_awt")
    out = out.withColumns({"expected_characters": F.length("_e"), "expected_words": F.size("_ew"), "exact_match": F.col("_e") == F.col("_a")}).drop("_e", "_a", "_ew", "_aw", "_known", "_symbols", "_ewt", "_awt")
    return out.withColumns({c: F.col(f"{n}_errors") / F.greatest(F.col(f"expected_{n}s"), F.lit(1)) for c, n in (("cer", "character"), ("wer", "word"))})


def aggregate_text_metrics(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averages over rows of ``text_metrics``; no rows give 0 samples and nulls."""
    rate = lambda n, d: F.sum(n) / F.greatest(F.sum(d), F.lit(1))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("samples"), rate("character_errors", "expected_characters").alias("cer"), rate("word_errors", "expected_words").alias("wer"), F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate")
    )


def field_metrics(expected: DataFrame, actual: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """correct, total and accuracy of fields (keys, field_name, value): missing and extra fields count as wrong."""
    on = [*keys, "field_name"]
    e, a = expected.select(*on, F.col("value").alias("_e"), F.lit(True).alias("_in_e")), actual.select(*on, F.col("value").alias("_a"), F.lit(True).alias("_in_a"))
    right = F.coalesce(F.col("_in_e") & F.col("_in_a") & F.col("_e").eqNullSafe(F.col("_a")), F.lit(False))
    scored = e.join(a, on, "full").groupBy(*keys).agg(F.count_if(right).alias("correct"), F.count("*").alias("total"))
    return scored.withColumn("accuracy", F.col("correct") / F.col("total"))


def evaluate(manifest: DataFrame) -> DataFrame:
    """Per record and, with a null id, over all of a manifest (id, expected_text, actual_text, expected_fields, actual_fields)."""
    scored = text_metrics(manifest)
    keys = F.array_union(F.map_keys(F.coalesce("expected_fields", F.create_map().cast("map<string,string>"))), F.map_keys(F.coalesce("actual_fields", F.create_map().cast("map<string,string>"))))
    right = F.filter(keys, lambda k: F.map_contains_key("expected_fields", k) & F.map_contains_key("actual_fields", k) & F.try_element_at("expected_fields", k).eqNullSafe(F.try_element_at("actual_fields", k)))
    scored = scored.withColumns({"fields": F.size(keys), "fields_correct": F.size(right)})
    total = scored.rollup("id").agg(
        F.count("*").alias("samples"), (F.sum("character_errors") / F.greatest(F.sum("expected_characters"), F.lit(1))).alias("cer"), (F.sum("word_errors") / F.greatest(F.sum("expected_words"), F.lit(1))).alias("wer"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_match_rate"), (F.sum("fields_correct") / F.nullif(F.sum("fields"), F.lit(0))).alias("field_accuracy"),
    )
    return total
