"""Classification of documents by weighted signals."""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import constants as C
from folioscope.functions.text import any_of, filled, lines_of, stripped, words_of


@dataclass(frozen=True)
class Weights:
    """What each signal adds, and the bounds of confidence."""

    mrz: float = 5.5
    national_id: float = 3.5
    iban: float = 2.5
    invoice_number: float = 2.2
    keyword: float = 1.4
    anchors: float = 3.0
    cv: float = 2.5
    traffic: float = 2.5
    delimiters: float = 3.0
    tall: float = 1.8
    card: float = 1.2
    tables: tuple[tuple[str, float], ...] = (("table", 2.0), ("invoice", 1.0), ("receipt", 0.8), ("bank_document", 1.2))


def keyword_hit(lower: Column, word: str) -> Column:
    """Whether a keyword stands in a lower-case text; ASCII words need boundaries, found only after a plain search."""
    found = lower.contains(word)
    if word.isalnum() and word.isascii():
        return found & lower.rlike(rf"(?<![{C.WORD}]){word}(?![{C.WORD}])")
    return found


def signals(text: Column, lower: Column, width: Column, height: Column, tables: Column, weights: Weights = Weights()) -> list[tuple[str, str | Column, float | Column, Column]]:
    """(category, signal, weight, condition) of every signal; ``lower`` is a column that holds the text in lower case."""
    out: list[tuple[str, str | Column, float | Column, Column]] = []
    for category, each in weights.tables:
        out.append((category, F.concat(F.lit("tables_detected_"), tables.cast("int").cast("string")), each * tables, tables > 0))
    sized = (width > 0) & (height > 0)
    tall = sized & (height / width >= 1.8)
    out.append(("receipt", "tall_aspect_ratio_receipt", weights.tall, tall))
    card = sized & ~tall & (width / height >= 1.35) & (F.size(words_of(text)) <= 50)
    out += [(c, "landscape_card_aspect_ratio", weights.card, card) for c in ("id_card", "driver_license")]
    out.append(("passport", "mrz_passport_pattern", weights.mrz, lower.rlike("p<[a-z]{3}|p<[a-z0-9<]{10}")))
    digits = F.translate(F.translate(text, " ", ""), "٠١٢٣٤٥٦٧٨٩", "0123456789")
    out.append(("id_card", "egyptian_14_digit_national_id", weights.national_id, digits.rlike(rf"(?<![{C.WORD}])[23]\p{{Nd}}{{13}}(?![{C.WORD}])")))
    out.append(("bank_document", "iban_detected", weights.iban, lower.rlike(rf"(?<![{C.WORD}])[a-z]{{2}}\p{{Nd}}{{2}}[a-z0-9]{{11,30}}(?![{C.WORD}])")))
    out.append(("invoice", "invoice_number_pattern", weights.invoice_number, lower.rlike(r"(?:inv[-#:\s\p{Z}]|فاتورة رقم|invoice[\s\p{Z}]*#)[\s\p{Z}]*[a-z0-9-]+")))
    for category, words in C.KEYWORDS.items():
        out += [(category, f"kw_{category}:{w}", weights.keyword, keyword_hit(lower, w)) for w in words]
    anchors = sum((lower.contains(a).cast("int") for a in C.ID_ANCHORS), F.lit(0))
    out.append(("id_card", F.concat(F.lit("egyptian_id_field_labels_"), anchors.cast("string")), weights.anchors, anchors >= 3))
    out.append(("cv", "cv_contact_plus_sections", weights.cv, any_of(lower, C.CV_HOSTS) & any_of(lower, C.CV_SECTIONS)))
    out.append(("driver_license", "traffic_dept_license", weights.traffic, lower.contains("مرور") & any_of(lower, ["رخصة", "قيادة"])))
    piped = F.size(F.filter(lines_of(text), lambda x: x.rlike(r"[|\t]")))
    out.append(("table", "delimiters_pipe_or_tab", weights.delimiters, piped >= 3))
    return out


#: Columns that classification gives; columns of these names in the input give way.
OUTPUTS = ("category", "confidence", "score", "signals", "scores")


def classify(pages: DataFrame, text: str = "text", width: str | None = "width", height: str | None = "height", tables: str | None = None, weights: Weights = Weights()) -> DataFrame:
    """Adds ``category, confidence, score, signals, scores`` to pages; no shuffle, one projection per step.

    Null and blank texts are ``unknown`` with confidence 0; four words or fewer without a telling one are
    ``image_with_text``. Equal scores go to the category that comes first in CATEGORIES.
    """
    none = F.lit(None).cast("double")
    size = [F.col(c).cast("double") if c else none for c in (width, height)]
    table_count = F.coalesce(F.col(tables).cast("double"), F.lit(0.0)) if tables else F.lit(0.0)
    base = pages.withColumn("_clean", stripped(F.coalesce(F.col(text), F.lit(""))))
    # every signal reads the lower-case text: it is a column of its own, made once
    base = base.withColumns({"_words": F.size(words_of(F.col("_clean"))), "_lower": F.lower("_clean")})
    found = signals(F.col("_clean"), F.col("_lower"), *size, table_count, weights)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    hits = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(c).alias("category"), lit(s).alias("signal"), lit(w).cast("double").alias("weight"))) for c, s, w, cond in found)))
    base = base.withColumn("_hits", hits)

    def score(category: str) -> Column:
        return F.aggregate(F.filter("_hits", lambda h: h["category"] == category), F.lit(0.0), lambda a, h: a + h["weight"])

    base = base.withColumn("_scores", F.array(*(F.struct(score(c).alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("category")) for i, c in enumerate(C.CATEGORIES))))
    base = base.withColumn("_best", F.array_max("_scores"))
    best = F.col("_best.score")
    sparse = (F.col("_words") <= 4) & ~any_of(F.col("_lower"), C.SPARSE_EXCEPTIONS)
    empty = ~filled(F.col(text))
    category = (
        F.when(empty, "unknown").when(sparse, "image_with_text").when(best >= 1.2, F.col("_best.category")).when(F.col("_words") <= 4, "image_with_text").otherwise("generic_document")
    )
    confidence = (
        F.when(empty, 0.0).when(sparse, 0.70).when(best >= 2.0, F.least(F.lit(0.98), 0.60 + best * 0.05)).when(best >= 1.2, 0.55).when(F.col("_words") <= 4, 0.60).otherwise(0.50)
    )
    scored = ~(empty | sparse)
    named = F.when(empty, F.array(F.lit("empty_input"))).when(sparse, F.array(F.lit("sparse_text_word_count_le_4"))).otherwise(F.array_distinct(F.transform("_hits", lambda h: h["signal"])))
    positive = F.map_from_entries(F.transform(F.filter("_scores", lambda s: s["score"] > 0), lambda s: F.struct(s["category"], F.round(s["score"], 2))))
    return base.select(
        *(c for c in pages.columns if c not in OUTPUTS), category.alias("category"), confidence.alias("confidence"), F.when(scored, best).otherwise(0.0).alias("score"), named.alias("signals"),
        F.when(scored, positive).otherwise(F.create_map().cast("map<string,double>")).alias("scores"),
    )

