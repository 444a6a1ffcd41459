"""Queries of the document operators over the tables, each with the SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import constants as C
from folioscope.functions import text as T
from folioscope.functions import validation as V
from folioscope.operators import classification, evaluation, extraction, images, layout, recognition
from folioscope.plans.materialize import spread
from folioscope.sources import uploads as U
from folioscope.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- SQL in parts -------------------------------------------------------------------------------------------------
def n_(col: str, cls: str) -> str:
    return f"length(regexp_replace(coalesce({col}, ''), '[^{cls}]', '', 'g'))"


def any_(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in dict.fromkeys(words)) + ")"


AR, LA, DI = C.ARABIC_LETTERS, C.LATIN, C.DIGITS
BL = C.BLANKS.replace("\\t", "\t")
FILLED = "regexp_matches(coalesce({0}, ''), '[^\\n\\r\\x{{000B}}\\x{{000C}}\\x{{001C}}-\\x{{001E}}\\x{{0085}}\\x{{2028}}\\x{{2029}}" + C.BLANKS.replace("{", "{{").replace("}", "}}") + "]')"


def strip_(col: str) -> str:
    return f"regexp_replace({col}, '^[\\n\\r{C.BLANKS}]+|[\\n\\r{C.BLANKS}]+$', '', 'g')"


def digits_(col: str) -> str:
    return f"translate({col}, '{T.OTHER_DIGITS}', '{T.PLAIN_DIGITS}')"


def normal_(col: str) -> str:
    plain = f"translate(regexp_replace(coalesce({col}, ''), '[{C.BIDI}]', '', 'g'), chr(160) || chr(8239) || chr(8203), '  ')"
    lines = f"regexp_replace(regexp_replace({plain}, '{C.LINE_ENDS}', chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    return strip_(f"regexp_replace({lines}, '(?m)^[{C.BLANKS}]+|[{C.BLANKS}]+$', '', 'g')")


def words_(col: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({col}, ''), '[\\n\\r\\x{{000B}}\\x{{000C}}\\x{{001C}}-\\x{{001E}}\\x{{0085}}\\x{{2028}}\\x{{2029}}{C.BLANKS}]+'), lambda x: x <> '')"


def lang_(col: str) -> str:
    a, b, d = n_(col, AR), n_(col, LA), n_(col, DI)
    return f"CASE WHEN {a} + {b} + {d} = 0 THEN 'unknown' WHEN {a} > 0 AND {b} > 0 THEN 'ar-en' WHEN {a} > 0 THEN 'ar' WHEN {b} > 0 THEN 'en' ELSE 'numeric' END"


def direction_(col: str) -> str:
    a, b = n_(col, AR), n_(col, LA + DI)
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN 'auto' WHEN {a} > 0 THEN 'rtl' ELSE 'ltr' END"


def header_(text: str, height: str, median: str) -> str:
    low, n = f"lower({strip_(text)})", f"len({words_(text)})"
    starts = " OR ".join(f"starts_with({low}, '{w}')" for w in C.SECTION_WORDS)
    return f"(({height} > {median} * 1.30 AND {n} <= 8) OR (({starts}) AND {n} BETWEEN 1 AND 10))"


def mean_(col: str) -> str:
    return f"(sum({col}::DECIMAL(18,9))::DOUBLE / nullif(count({col}), 0))"


BLOCKS = "SELECT DISTINCT doc_id, page_number, detection_order, points, text, raw_text, confidence, line_number FROM blocks"
BOXES = f"""SELECT *, (l + r) / 2 AS cx, (t + b) / 2 AS cy, b - t AS h, r - l AS w FROM (
  SELECT *, list_min(list_transform(points, lambda p: p.x)) AS l, list_min(list_transform(points, lambda p: p.y)) AS t,
    list_max(list_transform(points, lambda p: p.x)) AS r, list_max(list_transform(points, lambda p: p.y)) AS b FROM ({BLOCKS}))"""
LINES = f"""SELECT doc_id, page_number, line_number, string_agg(coalesce(text, ''), ' ' ORDER BY detection_order) AS text, {mean_('confidence')} AS confidence,
  min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, max(b) - min(t) AS h, count(*) AS n FROM ({BOXES}) GROUP BY ALL"""
MEDIANS = f"SELECT *, median(h) OVER (PARTITION BY doc_id, page_number) AS med FROM ({LINES})"
MARKED = f"SELECT *, {header_('text', 'h', 'med')} AS head FROM ({MEDIANS})"
PARAGRAPHS = f"""SELECT *, sum(CASE WHEN first OR head OR phead OR gap > med * 1.7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_number ORDER BY line_number) AS block_id FROM (
  SELECT *, lag(line_number) OVER w IS NULL AS first, coalesce(lag(head) OVER w, false) AS phead, greatest(0.0, t - lag(b) OVER w) AS gap
  FROM ({MARKED}) WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_number))"""
PAGES = "SELECT doc_id, page_number, coalesce(max(width), 1000)::DOUBLE AS pw, coalesce(max(height), 1000)::DOUBLE AS ph FROM doc_text GROUP BY ALL"


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "doc_text", "doc_id", "page_number", *columns)


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks", "doc_id", "page_number", "detection_order", "points", "text", "raw_text", "confidence", "line_number").distinct()


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return recognition.boxed(_blocks(spark, d))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines as the table numbers them, blocks in the order of detection."""
    return layout.lines(_boxes(spark, d).withColumn("reading_order", F.col("detection_order")))


# ---- text and language (T1-T12, R7) -------------------------------------------------------------------------------
_A, _L, _D = n_("raw_text", AR), n_("raw_text", LA), n_("raw_text", DI)
_TOT = f"nullif({_A} + {_L} + {_D}, 0)"


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, {lang_('raw_text')} AS lang, round(CASE WHEN {_TOT} IS NULL THEN 0.0 WHEN {_A} > 0 AND {_L} > 0 THEN ({_A} + {_L})::DOUBLE / {_TOT}
  WHEN {_A} > 0 THEN greatest(0.6, {_A}::DOUBLE / {_TOT}) WHEN {_L} > 0 THEN greatest(0.6, {_L}::DOUBLE / {_TOT}) ELSE {_D}::DOUBLE / {_TOT} END, 6) AS confidence,
  round(coalesce({_A}::DOUBLE / {_TOT}, 0.0), 6) AS arabic, round(coalesce({_L}::DOUBLE / {_TOT}, 0.0), 6) AS latin, round(coalesce({_D}::DOUBLE / {_TOT}, 0.0), 6) AS digits FROM doc_text""")
def q_language(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and distribution of every page."""
    found = _texts(spark, d, "raw_text").select("doc_id", *big("page_number"), T.language(F.col("raw_text")).alias("f"))
    return found.select("doc_id", "page_number", "f.lang", *(r6(f"f.{c}").alias(c) for c in ("confidence", "arabic", "latin", "digits")))


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, detection_order::BIGINT AS detection_order, {direction_('text')} AS direction,
  CASE WHEN {n_('text', AR)} > 0 AND {n_('text', LA)} > 0 THEN 'mixed' WHEN {n_('text', AR)} > 0 THEN 'arabic' WHEN {n_('text', LA)} > 0 THEN 'latin' WHEN {n_('text', DI)} > 0 THEN 'numeric' ELSE 'unknown' END AS script,
  CASE WHEN coalesce(text, '') = '' THEN 'unknown' WHEN {n_('text', C.ARABIC_BLOCK)} > 0 AND {n_('text', LA)} > 0 THEN 'mixed' WHEN {n_('text', C.ARABIC_BLOCK)} > 0 THEN 'ar'
    WHEN {n_('text', LA)} > 0 THEN 'latin' WHEN {n_('text', C.DIGITS_ARABIC_INDIC)} > 0 THEN 'numeric' ELSE 'symbol' END AS engine_script FROM blocks""")
def q_direction_script(spark: SparkSession, d: str) -> DataFrame:
    """Direction and script of every block."""
    t = F.col("text")
    return table(spark, d, "blocks", "doc_id", "page_number", "detection_order", "text").select(
        "doc_id", *big("page_number", "detection_order"), T.direction(t).alias("direction"), T.script(t).alias("script"), T.engine_script(t).alias("engine_script")
    )


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, {normal_('raw_text')} AS normalized, NOT regexp_matches(coalesce(raw_text, ''), '[{C.BIDI}]') AS bidi_safe FROM doc_text""")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    """T4, T5: logical text of every page, and whether its raw text forces a direction."""
    t = F.col("raw_text")
    return _texts(spark, d, "raw_text").select("doc_id", *big("page_number"), T.normalized(t).alias("normalized"), T.bidi_safe(t).alias("bidi_safe"))


_FOLD = f"lower(translate(regexp_replace(value, '[{C.TASHKEEL}]', '', 'g'), 'أإآٱةى', 'ااااهي'))"
_ADDR = f"(regexp_matches({_FOLD}, '(?:^|[\\s\\p{{Z}}]|\\p{{Nd}})ش(?:[\\s\\p{{Z}}]|\\.|/|$)') OR {any_(_FOLD, [T._fold(w) for w in [*C.ADDRESS_WORDS, *C.GOVERNORATES.values()]])})"


@query(f"""SELECT doc_id, field_name, value, regexp_replace(value, '[{C.TASHKEEL}]', '', 'g') AS without_marks, {digits_('value')} AS plain_digits, {_FOLD} AS folded, coalesce({_ADDR}, false) AS address_line FROM fields""")
def q_folding(spark: SparkSession, d: str) -> DataFrame:
    """Marks, digits and Arabic letters folded, address lines told, for every extracted value."""
    v = F.col("value")
    return table(spark, d, "fields", "doc_id", "field_name", "value").select(
        "doc_id", "field_name", "value", T.without_tashkeel(v).alias("without_marks"), T.plain_digits(v).alias("plain_digits"), T.folded_arabic(v).alias("folded"), T.address_line(v).alias("address_line")
    )


def _replaced(col: str, wrong: str, right: str) -> str:
    """A word replaced between boundaries; twice, as neighbours share one."""
    one = lambda c: f"regexp_replace({c}, '(^|[^\\p{{L}}\\p{{N}}_]){wrong}($|[^\\p{{L}}\\p{{N}}_])', '\\1{right}\\{2 + wrong.count('(')}', 'g')"
    return one(one(col))


_PLAIN = f"regexp_replace({strip_('text')}, '[{C.TASHKEEL}]', '', 'g')"
_BOUND = {"(?<![\\p{L}\\p{N}_])": "(?:^|[^\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])": "(?:$|[^\\p{L}\\p{N}_])"}


def _like_any(col: str, patterns: list[str]) -> str:
    for look, plain in _BOUND.items():
        patterns = [p.replace(look, plain) for p in patterns]
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in patterns) + ")"


_STEPS = [("عبا\\s+(" + "|".join(C.ABD_NAMES) + ")", "عبد \\2"), *(C.NAME_REPAIRS | C.PLACE_REPAIRS).items()]
_WITH = ", ".join(["f0 AS MATERIALIZED (SELECT DISTINCT text, " + strip_("text") + " AS x FROM blocks WHERE text IS NOT NULL)", *(f"f{i} AS (SELECT text, {_replaced('x', w, r)} AS x FROM f{i - 1})" for i, (w, r) in enumerate(_STEPS, 1))])


@query(f"""WITH {_WITH} SELECT text AS line, CASE WHEN text = '' THEN '' WHEN {_like_any(_PLAIN, C.HEADER_PATTERNS)} AND NOT {any_(strip_('text'), C.CARD_WORDS)} THEN '{C.HEADER}' WHEN {_like_any(_PLAIN, C.CARD_PATTERNS)} THEN '{C.CARD_TITLE}'
  ELSE {strip_("regexp_replace(regexp_replace(x, '[؛«»^~|_]+', ' ', 'g'), '[" + chr(92) + "s" + chr(92) + "p{Z}]{2,}', ' ', 'g')")} END AS corrected, {_like_any(_PLAIN, C.CARD_PATTERNS)} AS card_title FROM f{len(_STEPS)}""")
def q_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections and card titles of all recognised lines."""
    rows = table(spark, d, "blocks", "text").where("text IS NOT NULL").distinct()
    return rows.select(F.col("text").alias("line"), T.corrected_line(F.col("text")).alias("corrected"), T.is_card_title(F.col("text")).alias("card_title"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'جمهورية مصر العربية|بطاقة تحقيق الشخصية|محمد علي'), (2::BIGINT, 'تحقيق|محمود|القاهرة')) AS v(id, corrected)")
def q_corrected_cards(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a card corrected with a look at the two lines after each."""
    rows = spark.createDataFrame([(1, ["جمهور صا", "بطاقه تحقيق الشخصيه", "محمل علي"]), (2, ["تحقيق ا", "محمول", "القاهره"])], "id BIGINT, lines ARRAY<STRING>")
    return rows.select("id", F.array_join(T.corrected_lines(F.col("lines")), "|").alias("corrected"))


# ---- recognition (R2-R17) -----------------------------------------------------------------------------------------
_STRUCT = "(?:^|[^\\p{L}\\p{N}_])(?:\\p{Nd}{4}[-/]\\p{Nd}{1,2}[-/]\\p{Nd}{1,2}|\\p{Nd}{6,}|20\\p{Nd}{8,10}|[A-Za-z0-9_-]+@[A-Za-z0-9.-]+)(?:$|[^\\p{L}\\p{N}_])"
_QUALITY = f"""SELECT doc_id, page_number, {mean_('confidence')} AS a, count(*) AS n, string_agg(coalesce(text, ''), ' ' ORDER BY detection_order) AS x FROM ({BLOCKS}) GROUP BY ALL"""
_SCORED = f"""SELECT *, regexp_matches(x, '{_STRUCT}') AS s, length(replace(x, ' ', '')) AS p, {n_('x', C.ARABIC_BLOCK + 'a-zA-Z' + C.DIGITS)} AS m FROM ({_QUALITY})"""


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, round(a, 6) AS avg_confidence, n::BIGINT AS block_count, p::BIGINT AS char_count, s AS structured, round(m::DOUBLE / greatest(p, 1), 6) AS coherence,
  round(CASE WHEN p = 0 THEN 0 ELSE least(1.0, greatest(0.0, 0.35::DOUBLE * a + 0.35::DOUBLE * (m::DOUBLE / greatest(p, 1)) + 0.15::DOUBLE * least(1.0, p / 60.0::DOUBLE) + CASE WHEN s THEN 0.1::DOUBLE ELSE 0 END)) END, 6) AS composite FROM ({_SCORED})""")
def q_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the recognition of every page."""
    return recognition.page_quality(_blocks(spark, d)).select("doc_id", *big("page_number"), r6("avg_confidence").alias("avg_confidence"), *big("block_count", "char_count"), "structured", r6("coherence").alias("coherence"), r6("composite").alias("composite"))


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, detection_order::BIGINT AS detection_order, round(l, 6) AS "left", round(t, 6) AS top, round(r, 6) AS "right", round(b, 6) AS bottom, round(w, 6) AS width, round(h, 6) AS height,
  round(w * h, 6) AS area FROM ({BOXES}) WHERE {FILLED.format('text')} AND confidence BETWEEN 0 AND 1 AND len(points) = 4""")
def q_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Clean blocks with their boxes."""
    boxes = recognition.boxed(recognition.sanitized(_blocks(spark, d)))
    return boxes.select("doc_id", *big("page_number", "detection_order"), *(r6(c).alias(c) for c in ("left", "top", "right", "bottom", "width", "height", "area")))


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, detection_order::BIGINT AS detection_order, round(points[1].x / greatest(pw, 1), 6) AS nx, round(points[3].y / greatest(ph, 1), 6) AS ny, round(points[1].x * 2, 6) AS sx,
  round(points[3].y * 0.5, 6) AS sy FROM ({BLOCKS}) JOIN ({PAGES}) USING (doc_id, page_number)""")
def q_rescale(spark: SparkSession, d: str) -> DataFrame:
    """Corners as shares of the page, and rescaled."""
    pages = _texts(spark, d, "width", "height").groupBy("doc_id", "page_number").agg(F.coalesce(F.max("width"), F.lit(1000)).alias("pw"), F.coalesce(F.max("height"), F.lit(1000)).alias("ph"))
    rows = _blocks(spark, d).join(pages, ["doc_id", "page_number"]).withColumns({"n": recognition.normalised_points(F.col("points"), F.col("pw"), F.col("ph")), "s": recognition.rescaled(F.col("points"), F.lit(2.0), F.lit(0.5), F.lit(False))})
    return rows.select("doc_id", *big("page_number", "detection_order"), r6(F.col("n")[0]["x"]).alias("nx"), r6(F.col("n")[2]["y"]).alias("ny"), r6(F.col("s")[0]["x"]).alias("sx"), r6(F.col("s")[2]["y"]).alias("sy"))


_OV = "greatest(0, least(p.r, q.r) - greatest(p.l, q.l)) * greatest(0, least(p.b, q.b) - greatest(p.t, q.t))"


@query(f"""WITH x AS ({BOXES}) SELECT p.doc_id, p.page_number::BIGINT AS page_number, p.detection_order::BIGINT AS detection_order, round({_OV} / (greatest(1, p.w * p.h) + greatest(1, q.w * q.h) - {_OV}), 6) AS iou
  FROM x p JOIN x q ON p.doc_id = q.doc_id AND p.page_number = q.page_number AND q.line_number = p.line_number AND q.detection_order > p.detection_order""")
def q_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the blocks of one line."""
    boxes = _boxes(spark, d).select("doc_id", "page_number", "line_number", "detection_order", "left", "top", "right", "bottom")
    p, q = boxes.alias("p"), boxes.alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("doc_id", "page_number", "line_number")]
    return p.join(q, [*on, F.col("q.detection_order") > F.col("p.detection_order")]).select(
        "p.doc_id", F.col("p.page_number").cast("bigint").alias("page_number"), F.col("p.detection_order").cast("bigint").alias("detection_order"), r6(recognition.overlap("p", "q")).alias("iou")
    )


@query(f"""WITH l AS (SELECT doc_id, page_number, line_number, {mean_('confidence')} AS m, min(confidence) AS c FROM ({BLOCKS}) GROUP BY ALL),
  f AS (SELECT doc_id, page_number, coalesce(bool_or(c < 0.5), false) AS low, string_agg(CASE WHEN m < 0.5 THEN line_number END::VARCHAR, ',' ORDER BY line_number) AS u FROM l GROUP BY ALL)
  SELECT p.doc_id, p.page_number::BIGINT AS page_number, coalesce(low, true) AS needs_review, coalesce(u, '') AS uncertain_lines FROM (SELECT DISTINCT doc_id, page_number FROM doc_text) p LEFT JOIN f USING (doc_id, page_number)""")
def q_review_flags(spark: SparkSession, d: str) -> DataFrame:
    """Pages to be reviewed, and their uncertain lines."""
    return recognition.review_flags(_blocks(spark, d), _texts(spark, d)).select("doc_id", *big("page_number"), "needs_review", F.array_join("uncertain_lines", ",").alias("uncertain_lines"))


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, CASE WHEN coalesce(a, 0) < 0.30 OR (n >= 3 AND v >= 0.60) THEN 'rotate' WHEN a < 0.60 OR wf >= 0.30 OR c < 0.50 THEN 'original' ELSE 'keep' END AS route FROM (
  SELECT s.doc_id, s.page_number, a, n, v, wf, CASE WHEN p = 0 THEN 0 ELSE least(1.0, greatest(0.0, 0.35::DOUBLE * a + 0.35::DOUBLE * (m::DOUBLE / greatest(p, 1)) + 0.15::DOUBLE * least(1.0, p / 60.0::DOUBLE) + CASE WHEN s THEN 0.1::DOUBLE ELSE 0 END)) END AS c
  FROM ({_SCORED}) s JOIN (SELECT doc_id, page_number, avg((h > greatest(w, 1) * 1.5)::INT) AS v, avg((confidence < 0.5)::INT) AS wf FROM ({BOXES}) GROUP BY ALL) USING (doc_id, page_number))""")
def q_routing(spark: SparkSession, d: str) -> DataFrame:
    """How every page would be read again."""
    return recognition.routing(_blocks(spark, d)).select("doc_id", *big("page_number"), "route")


@query("""SELECT doc_id, page_number::BIGINT AS page_number, CASE WHEN m <= 1200 THEN 1.5 WHEN m <= 1800 THEN 1.25 ELSE 1.0 END::DOUBLE AS magnification,
  round(CASE WHEN m > 3200 THEN 3200 / m WHEN m <= 1200 THEN least(1.5, 3200 / m) ELSE 1.0 END, 6)::DOUBLE AS retry_scale FROM (SELECT doc_id, page_number, greatest(coalesce(width, 1000), coalesce(height, 1000))::DOUBLE AS m FROM doc_text)""")
def q_scales(spark: SparkSession, d: str) -> DataFrame:
    """Magnification of pages and scale of retries."""
    m = F.greatest(F.coalesce("width", F.lit(1000)), F.coalesce("height", F.lit(1000))).cast("double")
    return _texts(spark, d, "width", "height").select("doc_id", *big("page_number"), recognition.magnification(m).cast("double").alias("magnification"), r6(recognition.retry_scale(m)).alias("retry_scale"))


_IOU = "(greatest(0, least(q.r, o.r) - greatest(q.l, o.l)) * greatest(0, least(q.b, o.b) - greatest(q.t, o.t)))"
_SHIFT = "(CASE WHEN detection_order % 2 = 0 THEN h ELSE 2 END)"


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, page_number, list({{'c': coalesce(confidence, 0), 'l': l, 't': t, 'r': r, 'b': b}} ORDER BY detection_order) AS base,
    list({{'c': coalesce(confidence, 0), 'l': l + 3, 't': t + {_SHIFT}, 'r': r + 3, 'b': b + {_SHIFT}}} ORDER BY detection_order) AS other FROM ({BOXES}) GROUP BY ALL),
  f AS (SELECT doc_id, page_number, 0 AS k, base AS kept, other, len(base) AS n FROM p UNION ALL
    SELECT doc_id, page_number, k + 1, CASE WHEN o.c < 0.60 OR len(list_filter(kept, lambda q: {_IOU} / (greatest(1, (q.r - q.l) * (q.b - q.t)) + greatest(1, (o.r - o.l) * (o.b - o.t)) - {_IOU}) > 0.18)) > 0 THEN kept ELSE list_append(kept, o) END, other, n
    FROM (SELECT *, other[k + 1] AS o FROM f WHERE k < len(other)))
  SELECT doc_id, page_number::BIGINT AS page_number, CASE WHEN len(kept) > n THEN 'merged' ELSE 'primary' END AS label, len(kept)::BIGINT AS block_count, round(list_sum(list_transform(kept, lambda q: q.c::DECIMAL(18,9)))::DOUBLE / len(kept), 6) AS average_confidence FROM f WHERE k = len(other)""")
def q_pass_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two recognitions of every page merged: all its blocks, and all again with those of even order a line lower."""
    first = _boxes(spark, d).select("doc_id", "page_number", "detection_order", "points", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "height")
    down = F.when(F.col("detection_order") % 2 == 0, F.col("height")).otherwise(2.0)
    second = first.withColumn("points", F.transform("points", lambda p: F.struct((p["x"] + 3.0).alias("x"), (p["y"] + down).alias("y"))))
    return recognition.merged_passes(first.drop("height"), second.drop("height")).select("doc_id", *big("page_number"), "label", *big("block_count"), r6("average_confidence").alias("average_confidence"))


_TRIES = f"""SELECT doc_id, page_number, k AS attempt_no, k * 90 AS rotation, least(1.0, coalesce(a, 0) * (0.7::DOUBLE + 0.2::DOUBLE * k)) AS average, least(1.0, p / 200.0::DOUBLE * (0.7::DOUBLE + 0.2::DOUBLE * k)) AS composite, greatest(n - 4 * k, 0) AS blocks
  FROM (SELECT doc_id, page_number, a, n, least(p, 200) AS p FROM ({_SCORED})), range(0, 4) AS r(k)"""


@query(f"""WITH t AS (SELECT *, coalesce(sum((rotation <> 0 AND average >= 0.80 AND composite >= 0.70)::INT) OVER (PARTITION BY doc_id, page_number ORDER BY attempt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_TRIES}))
  SELECT doc_id, page_number::BIGINT AS page_number, first(attempt_no ORDER BY composite DESC, attempt_no)::BIGINT AS attempt_no, count(*)::BIGINT AS attempts FROM t WHERE before = 0 AND (attempt_no = 0 OR blocks > 0) GROUP BY ALL""")
def q_best_attempt(spark: SparkSession, d: str) -> DataFrame:
    """The attempt that is kept of every page: as it is and turned three times, each reading surer and of fewer blocks."""
    page = recognition.page_quality(_blocks(spark, d)).withColumn("attempt_no", F.explode(F.sequence(F.lit(0), F.lit(3))))
    better = 0.7 + 0.2 * F.col("attempt_no").cast("double")
    attempts = page.select(
        "doc_id", "page_number", "attempt_no", (F.col("attempt_no") * 90).alias("rotation"), F.least(F.lit(1.0), F.coalesce("avg_confidence", F.lit(0.0)) * better).alias("average"),
        F.least(F.lit(1.0), F.least("char_count", F.lit(200)) / 200.0 * better).alias("composite"), F.greatest(F.col("block_count") - 4 * F.col("attempt_no"), F.lit(0)).alias("block_count"),
    )
    return recognition.best_attempt(attempts).select("doc_id", *big("page_number", "attempt_no", "attempts"))


@query("""SELECT doc_id, count(*)::BIGINT AS page_count, coalesce(bool_or(needs_review), false) AS needs_review, string_agg(coalesce(text, ''), chr(10) || chr(12) || chr(10) ORDER BY page_number) AS text
  FROM (SELECT DISTINCT doc_id, page_number, text, needs_review FROM doc_text) GROUP BY ALL""")
def q_document_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents from their pages."""
    return recognition.document_rollup(_texts(spark, d, "text", "needs_review").distinct()).select("doc_id", *big("page_count"), "needs_review", "text")


@query(f"""SELECT doc_id, round(sum(c::DECIMAL(18,9))::DOUBLE / greatest(count(*), 1), 6) AS mean_confidence, count(*)::BIGINT AS pages FROM (SELECT doc_id, page_number, coalesce({mean_('confidence')}, 0) AS c FROM (SELECT DISTINCT * FROM blocks) GROUP BY ALL) GROUP BY ALL""")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean page confidence of documents."""
    rows = table(spark, d, "blocks").distinct().groupBy("doc_id", "page_number").agg(F.coalesce(recognition.mean("confidence"), F.lit(0.0)).alias("c"))
    return rows.groupBy("doc_id").agg(r6(recognition.mean("c")).alias("mean_confidence"), F.count("*").alias("pages"))


# ---- layout (L1-L21, R6) ------------------------------------------------------------------------------------------
_HEIGHTS = f"SELECT *, greatest(h, 5.0) AS hh, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY t, detection_order) AS k FROM ({BOXES})"
_FOLD_CTE = f"""WITH RECURSIVE x AS MATERIALIZED ({_HEIGHTS}), m AS (SELECT doc_id, page_number, 0.65 * list_sort(list(hh))[(len(list(hh)) // 2) + 1] AS tol FROM x GROUP BY ALL),
  y AS MATERIALIZED (SELECT x.*, tol FROM x JOIN m USING (doc_id, page_number)),
  f AS (SELECT doc_id, page_number, k, 1 AS line, cy AS total, 1 AS n FROM y WHERE k = 1 UNION ALL
    SELECT y.doc_id, y.page_number, y.k, CASE WHEN abs(y.cy - f.total / f.n) <= y.tol THEN f.line ELSE f.line + 1 END, CASE WHEN abs(y.cy - f.total / f.n) <= y.tol THEN f.total + y.cy ELSE y.cy END,
      CASE WHEN abs(y.cy - f.total / f.n) <= y.tol THEN f.n + 1 ELSE 1 END FROM f JOIN y ON y.doc_id = f.doc_id AND y.page_number = f.page_number AND y.k = f.k + 1),
  g AS (SELECT y.*, f.line, {n_('text', C.ARABIC_BLOCK)} AS ar, {n_('text', LA)} AS la FROM y JOIN f USING (doc_id, page_number, k)),
  a AS (SELECT *, CASE WHEN ar > la THEN 'rtl' ELSE 'ltr' END AS bd, avg(cy) OVER l AS my, sum(ar) OVER l AS sar, sum(la) OVER l AS sla, first_value(ar) OVER (PARTITION BY doc_id, page_number, line ORDER BY cx DESC, k) AS lastar
    FROM g WINDOW l AS (PARTITION BY doc_id, page_number, line)),
  b AS (SELECT *, CASE WHEN sar > sla THEN 'rtl' WHEN sla > sar THEN 'ltr' WHEN sar > 0 AND lastar > 0 THEN 'rtl' ELSE 'ltr' END AS ld,
    CASE WHEN lag(bd) OVER (PARTITION BY doc_id, page_number, line ORDER BY l, k) = bd THEN 0 ELSE 1 END AS turn FROM a),
  c AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, page_number, line ORDER BY l, k) AS run FROM b),
  e AS (SELECT *, avg(cx) OVER (PARTITION BY doc_id, page_number, line, run) AS rm, dense_rank() OVER (PARTITION BY doc_id, page_number ORDER BY my, line) AS ln FROM c)"""


@query(f"""{_FOLD_CTE} SELECT doc_id, page_number::BIGINT AS page_number, detection_order::BIGINT AS detection_order, ln::BIGINT AS line_number, ld AS line_direction, run::BIGINT AS run,
  row_number() OVER (PARTITION BY doc_id, page_number ORDER BY ln, CASE WHEN ld = 'rtl' THEN -rm ELSE rm END, run, CASE WHEN bd = 'rtl' THEN -cx ELSE cx END, l, k)::BIGINT AS reading_order FROM e""")
def q_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines, runs and reading order of every page's blocks."""
    ordered = layout.reading_order(_boxes(spark, d).drop("line_number"))
    return ordered.select("doc_id", *big("page_number", "detection_order", "line_number"), "line_direction", *big("run", "reading_order"))


_CENTRES = f"SELECT *, list_sum(list_transform(points, lambda p: p.y)) / 4 AS my, list_sum(list_transform(points, lambda p: p.x)) / 4 AS mx FROM ({BOXES})"


@query(f"""WITH RECURSIVE x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY my, detection_order) AS k FROM ({_CENTRES})),
  f AS (SELECT doc_id, page_number, k, 1 AS line, my AS first FROM x WHERE k = 1 UNION ALL
    SELECT x.doc_id, x.page_number, x.k, CASE WHEN abs(x.my - f.first) < x.h * 0.5 THEN f.line ELSE f.line + 1 END, CASE WHEN abs(x.my - f.first) < x.h * 0.5 THEN f.first ELSE x.my END
    FROM f JOIN x ON x.doc_id = f.doc_id AND x.page_number = f.page_number AND x.k = f.k + 1)
  SELECT doc_id, page_number::BIGINT AS page_number, detection_order::BIGINT AS detection_order, line::BIGINT AS line_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line, mx DESC, k)::BIGINT AS reading_order
  FROM x JOIN f USING (doc_id, page_number, k)""")
def q_engine_order(spark: SparkSession, d: str) -> DataFrame:
    """The recognizer's own order of blocks."""
    return layout.engine_order(_boxes(spark, d).drop("line_number")).select("doc_id", *big("page_number", "detection_order", "line_number", "reading_order"))


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, line_number::BIGINT AS line_number, text, round(confidence, 6) AS confidence, round(l, 6) AS "left", round(t, 6) AS top, round(r, 6) AS "right", round(b, 6) AS bottom,
  n::BIGINT AS blocks, {lang_('text')} AS language, {direction_('text')} AS direction, {normal_('text')} AS normalized_text FROM ({LINES})""")
def q_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages."""
    return _lines(spark, d).select("doc_id", *big("page_number", "line_number"), "text", *(r6(c).alias(c) for c in ("confidence", "left", "top", "right", "bottom")), *big("blocks"), "language", "direction", "normalized_text")


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, block_id::BIGINT AS block_id, string_agg(text, chr(10) ORDER BY line_number) AS text, round({mean_('confidence')}, 6) AS confidence, count(*)::BIGINT AS lines,
  CASE WHEN arg_min(head, line_number) THEN 'header' ELSE 'paragraph' END AS type FROM ({PARAGRAPHS}) GROUP BY doc_id, page_number, block_id""")
def q_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pages."""
    return layout.paragraphs(_lines(spark, d)).select("doc_id", *big("page_number", "block_id"), "text", r6("confidence").alias("confidence"), *big("lines"), "type")


_INFO = f"""SELECT x.*, pw, ph, t <= greatest(ph * 0.30, 200) AS intop, b <= greatest(ph * 0.08, 60) AS inhead, t >= least(ph * 0.90, ph - 60) OR contains(lower(text), 'page') OR contains(text, 'صفحة') AS infoot
  FROM ({LINES}) x LEFT JOIN ({PAGES}) USING (doc_id, page_number)"""
_TITLE = f"""SELECT doc_id, page_number, CASE WHEN len({words_('best')}) <= 10 AND NOT {any_('lower(best)', C.TITLE_STOPS)} THEN {strip_('best')} END AS title, {strip_('hd')} AS hd, {strip_('ft')} AS ft, sig FROM (
  SELECT doc_id, page_number, first(text ORDER BY h DESC, length(text), line_number) FILTER (intop) AS best, first(text ORDER BY line_number) FILTER (inhead) AS hd, last(text ORDER BY line_number) FILTER (infoot) AS ft,
    bool_or({any_('lower(text)', C.SIGNATURE_WORDS)}) AS sig FROM ({_INFO}) GROUP BY ALL)"""


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, title, CASE WHEN title IS NULL OR hd <> title THEN hd END AS header, ft AS footer, sig AS has_signatures FROM ({_TITLE})""")
def q_page_info(spark: SparkSession, d: str) -> DataFrame:
    """Title, header, footer and signature mark of pages."""
    return layout.page_info(_lines(spark, d), _texts(spark, d, "width", "height")).select("doc_id", *big("page_number"), "title", "header", "footer", "has_signatures")


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, CASE WHEN count(*) >= 4 AND count(*) FILTER (r <= pw * 0.48) >= 2 AND count(*) FILTER (l >= pw * 0.52) >= 2 THEN 2 ELSE 1 END::BIGINT AS columns
  FROM (SELECT x.*, coalesce(pw, 1000) AS pw FROM ({BOXES}) x LEFT JOIN ({PAGES}) USING (doc_id, page_number)) GROUP BY doc_id, page_number""")
def q_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of pages."""
    return layout.columns(_boxes(spark, d), _texts(spark, d, "width", "height")).select("doc_id", *big("page_number", "columns"))


@query(f"""WITH h AS (SELECT *, head AND coalesce(lag(block_id) OVER (PARTITION BY doc_id, page_number ORDER BY line_number), 0) <> block_id AS hd FROM ({PARAGRAPHS})),
  s AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id, page_number ORDER BY line_number) AS sec FROM h)
  SELECT s.doc_id, s.page_number::BIGINT AS page_number, s.sec::BIGINT AS section_id, s.ttl AS title, {strip_("coalesce(s.body, '')")} AS content FROM (
    SELECT doc_id, page_number, sec, max({strip_('text')}) FILTER (hd) AS ttl, string_agg(text, chr(10) ORDER BY line_number) FILTER (NOT hd) AS body FROM s WHERE sec > 0 GROUP BY ALL) s
  LEFT JOIN ({_TITLE}) q USING (doc_id, page_number) WHERE q.title IS NULL OR s.ttl <> q.title""")
def q_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of pages."""
    lines = _lines(spark, d)
    titles = layout.page_info(lines, _texts(spark, d, "width", "height"))
    return layout.sections(lines, titles).select("doc_id", *big("page_number", "section_id"), "title", "content")


_PARTS = f"list_filter(list_transform(string_split(text, '  '), lambda x: {strip_('x')}), lambda x: x <> '')"


@query(f"""WITH p AS (SELECT doc_id, page_number, line_number, text, {_PARTS} AS parts FROM ({LINES})), q AS (SELECT * FROM p WHERE len(parts) >= 3 OR (len(parts) = 2 AND regexp_matches(text, '\\p{{Nd}}'))),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_number) - 1 AS row, count(*) OVER (PARTITION BY doc_id, page_number) AS rows, max(len(parts)) OVER (PARTITION BY doc_id, page_number) AS cols FROM q)
  SELECT doc_id, page_number::BIGINT AS page_number, rows::BIGINT AS rows, cols::BIGINT AS cols, row::BIGINT AS row, (i - 1)::BIGINT AS col, parts[i] AS text, {direction_('parts[i]')} AS direction
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM r WHERE rows >= 2)""")
def q_tables(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the tables of pages."""
    return layout.tables(_lines(spark, d)).select("doc_id", *big("page_number", "rows", "cols", "row", "col"), "text", "direction")


# ---- classification (C1-C16) --------------------------------------------------------------------------------------
_BND = "(?:^|[^\\p{{L}}\\p{{N}}_]){0}(?:$|[^\\p{{L}}\\p{{N}}_])"


def _signals_sql() -> list[tuple[str, str, str, str]]:
    """(category, signal, weight, condition) in SQL over x, low, n, w, h, dg, tb."""
    out = [(c, "'tables_detected_' || tb", f"{v}::DOUBLE * tb", "tb > 0") for c, v in classification.Weights().tables]
    for c, words in C.KEYWORDS.items():
        for w in words:
            q = w.replace("'", "''")
            out.append((c, f"'kw_{c}:{q}'", "1.4::DOUBLE", f"contains(low, '{q}')" + (f" AND regexp_matches(low, '{_BND.format(q)}')" if w.isalnum() and w.isascii() else "")))
    card, anchors = "w > 0 AND h > 0 AND h / w < 1.8 AND w / h >= 1.35 AND n <= 50", " + ".join(f"contains(low, '{a}')::INT" for a in C.ID_ANCHORS)
    return out + [
        ("receipt", "'tall_aspect_ratio_receipt'", "1.8::DOUBLE", "w > 0 AND h > 0 AND h / w >= 1.8"), ("id_card", "'landscape_card_aspect_ratio'", "1.2::DOUBLE", card), ("driver_license", "'landscape_card_aspect_ratio'", "1.2::DOUBLE", card),
        ("passport", "'mrz_passport_pattern'", "5.5::DOUBLE", "regexp_matches(low, 'p<[a-z]{3}|p<[a-z0-9<]{10}')"), ("id_card", "'egyptian_14_digit_national_id'", "3.5::DOUBLE", f"regexp_matches(dg, '{_BND.format('[23][0-9]{13}')}')"),
        ("bank_document", "'iban_detected'", "2.5::DOUBLE", f"regexp_matches(low, '{_BND.format('[a-z]{2}[0-9]{2}[a-z0-9]{11,30}')}')"),
        ("invoice", "'invoice_number_pattern'", "2.2::DOUBLE", "regexp_matches(low, '(?:inv[-#:\\s\\p{Z}]|فاتورة رقم|invoice[\\s\\p{Z}]*#)[\\s\\p{Z}]*[a-z0-9-]+')"),
        ("id_card", f"'egyptian_id_field_labels_' || ({anchors})", "3.0::DOUBLE", f"({anchors}) >= 3"), ("cv", "'cv_contact_plus_sections'", "2.5::DOUBLE", f"{any_('low', C.CV_HOSTS)} AND {any_('low', C.CV_SECTIONS)}"),
        ("driver_license", "'traffic_dept_license'", "2.5::DOUBLE", "contains(low, 'مرور') AND (contains(low, 'رخصة') OR contains(low, 'قيادة'))"),
        ("table", "'delimiters_pipe_or_tab'", "3.0::DOUBLE", "len(list_filter(string_split(low, chr(10)), lambda x: contains(x, '|') OR contains(x, chr(9)))) >= 3"),
    ]


def _score_sql(category: str) -> str:
    return " + ".join(f"({cond})::INT * {weight}" for c, _, weight, cond in _signals_sql() if c == category) or "0.0::DOUBLE"


_ROWS2 = f"SELECT doc_id, page_number, line_number FROM (SELECT *, {_PARTS} AS parts FROM ({LINES})) WHERE len(parts) >= 3 OR (len(parts) = 2 AND regexp_matches(text, '\\p{{Nd}}'))"
_TABLES = f"SELECT doc_id, page_number, 1 AS tb FROM ({_ROWS2}) GROUP BY ALL HAVING count(*) >= 2"
_CLASS = f"""SELECT *, list_max([{', '.join('s' + str(i) for i in range(len(C.CATEGORIES)))}]) AS best, [{', '.join('s' + str(i) for i in range(len(C.CATEGORIES)))}] AS all_s FROM (SELECT *, {', '.join(f'{_score_sql(c)} AS s{i}' for i, c in enumerate(C.CATEGORIES))} FROM (
  SELECT doc_id, page_number, x, lower(x) AS low, len({words_('x')}) AS n, w, h, tb, translate(replace(x, ' ', ''), '٠١٢٣٤٥٦٧٨٩', '0123456789') AS dg FROM (SELECT doc_id, page_number, {strip_("coalesce(raw_text, '')")} AS x, coalesce(width, 0)::DOUBLE AS w, coalesce(height, 0)::DOUBLE AS h, coalesce(tb, 0) AS tb FROM doc_text LEFT JOIN ({_TABLES}) USING (doc_id, page_number))))"""
_SPARSE = f"n <= 4 AND NOT {any_('low', C.SPARSE_EXCEPTIONS)}"


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, CASE WHEN x = '' THEN 'unknown' WHEN {_SPARSE} THEN 'image_with_text' WHEN round(best, 6) >= 1.2 THEN [{', '.join(f"'{c}'" for c in C.CATEGORIES)}][list_position(list_transform(all_s, lambda s: round(s, 6)), round(best, 6))]
  WHEN n <= 4 THEN 'image_with_text' ELSE 'generic_document' END AS category,
  round(CASE WHEN x = '' THEN 0 WHEN {_SPARSE} THEN 0.70 WHEN best >= 2.0 THEN least(0.98, 0.60 + best * 0.05) WHEN round(best, 6) >= 1.2 THEN 0.55 WHEN n <= 4 THEN 0.60 ELSE 0.50 END, 6)::DOUBLE AS confidence,
  round(CASE WHEN x = '' OR ({_SPARSE}) THEN 0 ELSE best END, 6) AS score FROM ({_CLASS})""")
def q_classify(spark: SparkSession, d: str) -> DataFrame:
    """Category, confidence and score of every page, with the tables of its layout."""
    return classification.classify(_tabled(spark, d), tables="tables").select("doc_id", *big("page_number"), "category", r6("confidence").alias("confidence"), r6("score").alias("score"))


def _tabled(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the number of their tables."""
    tables = layout.tables(_lines(spark, d)).select("doc_id", "page_number", F.lit(1).alias("tables")).distinct()
    return spread(_texts(spark, d, "raw_text", "width", "height").withColumnRenamed("raw_text", "text")).join(tables, ["doc_id", "page_number"], "left")


@query("SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, unnest(CASE WHEN x = '' THEN ['empty_input'] WHEN " + _SPARSE + " THEN ['sparse_text_word_count_le_4'] ELSE list_filter(["
  + ", ".join(f"CASE WHEN {cond} THEN {signal} END" for _, signal, _, cond in _signals_sql()) + f"], lambda z: z IS NOT NULL) END) AS signal FROM ({_CLASS})")
def q_classify_signals(spark: SparkSession, d: str) -> DataFrame:
    """The signals of every page's class."""
    return classification.classify(_tabled(spark, d), tables="tables").select("doc_id", *big("page_number"), F.explode("signals").alias("signal")).distinct()


# ---- validation (V1-V8) -------------------------------------------------------------------------------------------
_VALUE = f"regexp_replace({digits_('value')}, '[\\s\\p{{Z}}]', '', 'g')"
_FORMATS = [
    ("^(\\d{4})-(1[0-2]|0[1-9]|[1-9])-(3[01]|[12]\\d|0[1-9]|[1-9])$", (1, 2, 3)), ("^(3[01]|[12]\\d|0[1-9]|[1-9])-(1[0-2]|0[1-9]|[1-9])-(\\d{4})$", (3, 2, 1)), ("^(3[01]|[12]\\d|0[1-9]|[1-9])/(1[0-2]|0[1-9]|[1-9])/(\\d{4})$", (3, 2, 1)),
    ("^(\\d{4})/(1[0-2]|0[1-9]|[1-9])/(3[01]|[12]\\d|0[1-9]|[1-9])$", (1, 2, 3)), ("^(1[0-2]|0[1-9]|[1-9])/(3[01]|[12]\\d|0[1-9]|[1-9])/(\\d{4})$", (3, 1, 2)), ("^(3[01]|[12]\\d|0[1-9]|[1-9])\\.(1[0-2]|0[1-9]|[1-9])\\.(\\d{4})$", (3, 2, 1)),
    ("^(\\d{4})\\.(1[0-2]|0[1-9]|[1-9])\\.(3[01]|[12]\\d|0[1-9]|[1-9])$", (1, 2, 3)), ("^(\\d{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12]\\d|0[1-9]|[1-9])$", (1, 2, 3)),
]


def _date_sql(v: str) -> str:
    parts = []
    for p, (y, m, dd) in _FORMATS:
        made = f"try_strptime(regexp_extract({v}, '{p}', {y}) || '-' || lpad(regexp_extract({v}, '{p}', {m}), 2, '0') || '-' || lpad(regexp_extract({v}, '{p}', {dd}), 2, '0'), '%Y-%m-%d')"
        parts.append(f"CASE WHEN regexp_matches({v}, '{p}') AND year({made}) BETWEEN 1900 AND 2100 THEN {made}::DATE END")
    return f"coalesce({', '.join(parts)})"


@query(f"""SELECT doc_id, field_name, value, {_date_sql(_VALUE)}::VARCHAR AS parsed, coalesce({_date_sql(_VALUE)} <= DATE '2026-01-01', false) AS valid_past, {_date_sql(_VALUE)} IS NOT NULL AS valid FROM fields
  WHERE field_name IN ('invoice_date', 'expiry_date', 'date', 'birth_date')""")
def q_dates_valid(spark: SparkSession, d: str) -> DataFrame:
    """V1: dates in the first of eight formats, against the day of reference."""
    rows = table(spark, d, "fields", "doc_id", "field_name", "value").where(F.col("field_name").isin("invoice_date", "expiry_date", "date", "birth_date"))
    as_of = F.lit(extraction.AS_OF).cast("date")
    past = V.date_check(F.col("value"), as_of, past=True)["valid"]
    return rows.select("doc_id", "field_name", "value", V.parse_date(F.col("value")).cast("string").alias("parsed"), past.alias("valid_past"), V.date_check(F.col("value"), as_of)["valid"].alias("valid"))


_NID = f"regexp_replace({digits_('value')}, '[^0-9]', '', 'g')"
_GOV = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in C.GOVERNORATES.items()) + "}"
_BORN = "CASE WHEN n[1] = '2' THEN '19' ELSE '20' END || n[2:3] || '-' || n[4:5] || '-' || n[6:7]"


@query(f"""SELECT doc_id, value, ok AS valid, CASE WHEN ok THEN born::DATE::VARCHAR END AS birth_date, CASE WHEN ok THEN n[8:9] END AS governorate_code, CASE WHEN ok THEN g END AS governorate,
  CASE WHEN ok THEN CASE WHEN n[13]::INT % 2 <> 0 THEN 'Male' ELSE 'Female' END END AS gender FROM (SELECT *, coalesce(length(n) = 14 AND n[1] IN ('2', '3') AND born IS NOT NULL AND born <= DATE '2026-01-01' AND g IS NOT NULL, false) AS ok FROM (
  SELECT doc_id, value, n, try_strptime({_BORN}, '%Y-%m-%d') AS born, {_GOV}[n[8:9]] AS g FROM (SELECT doc_id, value, {_NID} AS n FROM fields WHERE field_name = 'national_id')))""")
def q_national_id(spark: SparkSession, d: str) -> DataFrame:
    """V2, V8: identity numbers and what they hold."""
    rows = table(spark, d, "fields", "doc_id", "field_name", "value").where("field_name = 'national_id'")
    return rows.select("doc_id", "value", V.national_id(F.col("value"), F.lit(extraction.AS_OF).cast("date")).alias("f")).select("doc_id", "value", "f.valid", "f.birth_date", "f.governorate_code", "f.governorate", "f.gender")


@query("""SELECT o_orderkey, o_totalprice IS NULL OR s IS NULL OR abs(s + t - dd - o_totalprice) <= 0.05 AS consistent FROM (SELECT o_orderkey, o_totalprice, sum(round(l_extendedprice, 2)) AS s, sum(round(l_extendedprice * l_tax, 2)) AS t,
  sum(round(l_extendedprice * l_discount, 2)) AS dd FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def q_invoice_math(spark: SparkSession, d: str) -> DataFrame:
    """V3: whether the parts of every order make its total."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_tax", "l_discount").groupBy("l_orderkey").agg(
        F.sum(F.round("l_extendedprice", 2)).alias("s"), F.sum(F.round(F.col("l_extendedprice") * F.col("l_tax"), 2)).alias("t"), F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount"), 2)).alias("dd")
    )
    orders = table(spark, d, "orders", "o_orderkey", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", V.invoice_math(F.col("s"), F.col("t"), F.col("dd"), F.col("o_totalprice")).alias("consistent"))


_CHAR = "CASE WHEN value[i] BETWEEN '0' AND '9' THEN ascii(value[i]) - 48 WHEN value[i] BETWEEN 'A' AND 'Z' THEN ascii(value[i]) - 55 ELSE 0 END"


@query(f"""SELECT doc_id, value, regexp_matches(upper({strip_('value')}), '^[A-Z0-9]{{7,10}}$') AS valid, (coalesce(list_sum(list_transform(range(1, length(value) + 1), lambda i: ({_CHAR}) * [7, 3, 1][((i - 1) % 3) + 1])), 0) % 10)::BIGINT AS check_digit
  FROM fields WHERE field_name = 'passport_number' AND value IS NOT NULL""")
def q_passport_number(spark: SparkSession, d: str) -> DataFrame:
    """V4, V5: passport numbers and their check digits."""
    rows = table(spark, d, "fields", "doc_id", "field_name", "value").where("field_name = 'passport_number' AND value IS NOT NULL")
    return rows.select("doc_id", "value", V.passport_number(F.col("value")).alias("valid"), V.mrz_check_digit(F.col("value")).cast("bigint").alias("check_digit"))


@query(f"""SELECT doc_id, field_name, value, coalesce(regexp_matches({strip_('value')}, '{C.VALID_EMAIL}'), false) AS valid_email, coalesce(length(regexp_replace(value, '[\\s\\p{{Z}}\\-().]', '', 'g')) BETWEEN 7 AND 15, false) AS valid_phone
  FROM fields WHERE field_name IN ('email', 'emails', 'phone', 'phones')""")
def q_contacts_valid(spark: SparkSession, d: str) -> DataFrame:
    """V6, V7: mail addresses and telephone numbers."""
    rows = table(spark, d, "fields", "doc_id", "field_name", "value").where(F.col("field_name").isin("email", "emails", "phone", "phones"))
    return rows.select("doc_id", "field_name", "value", V.email(F.col("value")).alias("valid_email"), V.phone(F.col("value")).alias("valid_phone"))


# ---- extraction (X1-X10, G1-G6, E1-E50) ---------------------------------------------------------------------------
def _pages(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    pages = _texts(spark, d, "raw_text", "document_type").withColumnRenamed("raw_text", "text")
    return spread((pages.where(F.col("document_type") == kind) if kind else pages).distinct())


def _values(fields: DataFrame, *names: str) -> DataFrame:
    return fields.where(F.col("field_name").isin(list(names))).select("doc_id", *big("page_number"), "field_name", "value").distinct()


_DISTINCT = "SELECT DISTINCT doc_id, page_number, raw_text, document_type FROM doc_text WHERE raw_text IS NOT NULL"
_SQL_DATE = "(?:[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})"


def _all(name: str, text: str, pattern: str, strip: bool = False) -> str:
    value = "unnest(regexp_extract_all({0}, '{1}'))".format(text, pattern.replace("'", "''"))
    return f"SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, '{name}' AS field_name, {strip_('v') if strip else 'v'} AS value FROM (SELECT doc_id, page_number, {value} AS v FROM ({_DISTINCT}))"


@query(_all("emails", "raw_text", "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,7}\\b"))
def q_emails(spark: SparkSession, d: str) -> DataFrame:
    """G1: mail addresses of pages."""
    return _values(extraction.generic(_pages(spark, d)), "emails")


_SITES = """SELECT doc_id, page_number, string_agg('see www.' || lower(split_part(value, '@', 2)) || ', or (https://' || lower(split_part(value, '@', 2)) || '/id?n=' || doc_id || ') now', chr(10) ORDER BY value) AS text
  FROM (SELECT DISTINCT doc_id, page_number, value FROM fields WHERE field_name = 'emails' AND contains(value, '@')) GROUP BY ALL"""


@query(_all("urls", "text", "(?i)\\b(?:https?://|www\\.)[A-Za-z0-9.-]+\\.[A-Za-z]{2,}(?:/[^\\s]*)?").replace(_DISTINCT, _SITES))
def q_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of pages of the web, in lines on the sites of mail addresses, as no table holds any."""
    mails = table(spark, d, "fields", "doc_id", "page_number", "field_name", "value").where("field_name = 'emails' AND contains(value, '@')").distinct()
    site = F.lower(F.split_part("value", F.lit("@"), F.lit(2)))
    line = F.concat(F.lit("see www."), site, F.lit(", or (https://"), site, F.lit("/id?n="), F.col("doc_id").cast("string"), F.lit(") now"))
    pages = mails.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("value", line.alias("line")))), lambda v: v["line"]), "\n").alias("text"))
    return _values(extraction.generic(pages), "urls")


@query(_all("phones", "raw_text", "(?:\\+?20\\s?|0020\\s?|0)?(?:10|11|12|15)[0-9]{8}\\b|\\+?[1-9][0-9]{1,3}[-.\\s]?\\(?[0-9]{2,4}\\)?[-.\\s]?[0-9]{3,4}[-.\\s]?[0-9]{3,4}", strip=True))
def q_phones(spark: SparkSession, d: str) -> DataFrame:
    """Telephone numbers of pages."""
    return _values(extraction.generic(_pages(spark, d)), "phones")


_WORD = "\\p{L}\\p{N}_"
#: Every character that is in no word comes twice, so that neighbours each find one at their edge.
_TWICE = f"regexp_replace({digits_('raw_text')}, '([^{_WORD}])', '\\1\\1', 'g')"
_DAY2 = "(?:[0-9]{4}(?:--|//)[0-9]{1,2}(?:--|//)[0-9]{1,2}|[0-9]{1,2}(?:--|//)[0-9]{1,2}(?:--|//)[0-9]{2,4})"


@query(f"""SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, 'dates' AS field_name, replace(replace(v, '--', '-'), '//', '/') AS value
  FROM (SELECT doc_id, page_number, unnest(regexp_extract_all({_TWICE}, '(?:^|[^{_WORD}])({_DAY2})(?:$|[^{_WORD}])', 1)) AS v FROM ({_DISTINCT}))""")
def q_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of pages."""
    return _values(extraction.generic(_pages(spark, d)), "dates")


_CUR = C.CURRENCY.replace("\\.", "[.]") if "\\." in C.CURRENCY else C.CURRENCY
_NUM = "[0-9,]+(?:\\.[0-9]{1,2})?"


@query(f"""SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, 'amounts' AS field_name, {strip_('v')} AS value FROM (SELECT doc_id, page_number,
  unnest(regexp_extract_all({digits_('raw_text')}, '(?i)({_CUR}[\\s\\p{{Z}}]*[:=]?[\\s\\p{{Z}}]*{_NUM}|{_NUM}[\\s\\p{{Z}}]*{_CUR})(?:$|[^{_WORD}])', 1)) AS v FROM ({_DISTINCT}))""")
def q_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of money on pages."""
    return _values(extraction.generic(_pages(spark, d)), "amounts")


_KV_LINES = f"SELECT doc_id, page_number, unnest(list_zip(range(1, 100000)[1:len(s)], s)) AS e FROM (SELECT doc_id, page_number, regexp_split_to_array(raw_text, '{C.LINE_ENDS}') AS s FROM ({_DISTINCT}))"
_KV_MARK = "CASE WHEN contains(x, ':') AND NOT starts_with(x, 'http') THEN ':' WHEN contains(x, '=') THEN '=' END"


@query(f"""SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, 'key_values' AS field_name, k || '=' || last(v ORDER BY i) AS value FROM (SELECT doc_id, page_number, i, {strip_("x[:strpos(x, m) - 1]")} AS k, {strip_("x[strpos(x, m) + 1:]")} AS v FROM (
  SELECT doc_id, page_number, i, x, {_KV_MARK} AS m FROM (SELECT doc_id, page_number, e[1] AS i, {strip_('e[2]')} AS x FROM ({_KV_LINES})))
  WHERE m IS NOT NULL) WHERE len({words_('k')}) BETWEEN 1 AND 4 AND v <> '' AND length(k) < 35 GROUP BY doc_id, page_number, k""")
def q_key_values(spark: SparkSession, d: str) -> DataFrame:
    """Keys and values of pages."""
    return _values(extraction.generic(_pages(spark, d)), "key_values")


def _first(name: str, text: str, pattern: str, kind: str, clean: str = "{0}") -> str:
    p = pattern.replace("'", "''")
    value = clean.format(f"nullif(regexp_extract({text}, '(?i){p}', 1), '')")
    return f"SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, '{name}' AS field_name, {value} AS value FROM ({_DISTINCT}) WHERE document_type = '{kind}' AND {value} IS NOT NULL"


_E = "[\\s\\p{Z}]*[:=]?[\\s\\p{Z}]*"
_Z = "[\\s\\p{Z}]"
_M = "([\\p{Nd},]+(?:\\.\\p{Nd}{1,2})?)"


@query(" UNION ALL ".join([
    _first("invoice_number", "raw_text", f"(?:invoice{_Z}*(?:no|number|#)|inv{_Z}*#|فاتورة{_Z}*رقم|رقم{_Z}*الفاتورة|(?:invoice|فاتورة)[^\\n]*?(?:رقم|no|number|#)){_E}([A-Za-z0-9-_/]+)", "invoice"),
    _first("invoice_date", "raw_text", f"(?:invoice{_Z}*date|date|تاريخ{_Z}*الفاتورة|التاريخ){_E}((?:\\p{{Nd}}{{4}}[-/]\\p{{Nd}}{{1,2}}[-/]\\p{{Nd}}{{1,2}}|\\p{{Nd}}{{1,2}}[-/]\\p{{Nd}}{{1,2}}[-/]\\p{{Nd}}{{2,4}}))", "invoice"),
    _first("subtotal", "raw_text", f"(?:subtotal|net{_Z}*amount|المجموع{_Z}*الفرعي|الإجمالي{_Z}*قبل{_Z}*الضريبة){_E}{_M}", "invoice", "replace({0}, ',', '')"),
    _first("tax", "raw_text", f"(?:tax|vat|sales{_Z}*tax|ضريبة{_Z}*القيمة{_Z}*المضافة|الضريبة){_E}{_M}", "invoice", "replace({0}, ',', '')"),
    _first("total", "raw_text", f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:total{_Z}*amount|grand{_Z}*total|total|إجمالي|المجموع|صافي)(?:[^\\n\\p{{Nd}}:]*?)[:=]?{_Z}*{_M}", "invoice", "replace({0}, ',', '')"),
]))
def q_extract_invoice(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, dates and totals of invoices."""
    fields = extraction.eav(_pages(spark, d, "invoice"), extraction.registered()["invoice"], "specialised", "invoice")
    return _values(fields, "invoice_number", "invoice_date", "subtotal", "tax", "total")


_W = "\\p{L}\\p{N}_"
_WHO = "([A-Za-z\\x{0600}-\\x{06FF}0-9\\s\\p{Z}.&''\"-]+)"
_DAY = "(?:\\p{Nd}{4}[-/]\\p{Nd}{1,2}[-/]\\p{Nd}{1,2}|\\p{Nd}{1,2}[-/]\\p{Nd}{1,2}[-/]\\p{Nd}{2,4})"


def found_(pattern: str, text: str = "raw_text") -> str:
    return f"nullif(regexp_extract({text}, '(?i){pattern}', 1), '')"


def first_line_(value: str) -> str:
    line = strip_(f"regexp_split_to_array({value}, '{C.LINE_ENDS}')[1]")
    return f"CASE WHEN length({line}) >= 2 THEN {line} END"


def lines_(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '{C.LINE_ENDS}'), lambda v: {strip_('v')}), lambda v: v <> '')"


def _laid_out(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Pages of one kind with what their layout tells."""
    lines = _lines(spark, d)
    return extraction.with_layout(_pages(spark, d, kind), lines, layout.tables(lines))


_SURE = f"(SELECT arg_min(l.confidence, l.line_number) FROM ({LINES}) l WHERE l.doc_id = p.doc_id AND l.page_number = p.page_number AND contains(lower(l.text), lower({strip_('p.value')})))"
_PARTIES = " UNION ALL ".join([
    f"SELECT doc_id, page_number, 'seller' AS field_name, v AS value, 0.92::DOUBLE AS usual FROM (SELECT *, {first_line_(found_('(?:seller|vendor|from|المورد|البائع|شركة)' + _E + _WHO))} AS v FROM ({_DISTINCT})) WHERE document_type = 'invoice' AND v IS NOT NULL AND NOT {any_('lower(v)', ['invoice', 'date', 'bill to', 'tax'])}",
    f"SELECT doc_id, page_number, 'buyer', v, 0.92::DOUBLE FROM (SELECT *, {first_line_(found_(f'(?:bill{_Z}*to|buyer|customer|client|العميل|المشتري|إلى|السيد)' + _E + _WHO))} AS v FROM ({_DISTINCT})) WHERE document_type = 'invoice' AND v IS NOT NULL AND NOT {any_('lower(v)', ['subtotal', 'vat', 'tax', 'total'])}",
    f"SELECT doc_id, page_number, 'currency', v, 0.98::DOUBLE FROM (SELECT *, upper({found_(f'(?:^|[^{_W}])(EGP|USD|EUR|GBP|SAR|AED|ج[.]م|جنيه|دولار|ريال)(?:$|[^{_W}])')}) AS v FROM ({_DISTINCT})) WHERE document_type = 'invoice' AND v IS NOT NULL",
])


@query(f"""SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, field_name, value, round(CASE WHEN c > 0 THEN c ELSE usual END, 6) AS confidence FROM (SELECT p.*, {_SURE} AS c FROM ({_PARTIES}) p)""")
def q_invoice_parties(spark: SparkSession, d: str) -> DataFrame:
    """Seller, buyer and currency of invoices with the confidence of the first line that holds them."""
    fields = extraction.eav(_laid_out(spark, d, "invoice"), extraction.registered()["invoice"], "specialised", "invoice").where("field_name IN ('seller', 'buyer', 'currency')")
    return fields.select("doc_id", *big("page_number"), "field_name", "value", r6("confidence").alias("confidence")).distinct()


def _at_(kind: str) -> str:
    earlier = [any_("lower(h)", C.ITEM_HEADERS[k]) for k in C.ITEM_HEADERS if list(C.ITEM_HEADERS).index(k) < list(C.ITEM_HEADERS).index(kind)]
    own = " AND ".join([any_("lower(h)", C.ITEM_HEADERS[kind]), *(f"NOT {e}" for e in earlier)])
    return f"(SELECT max(i) FROM (SELECT unnest(tab[1]) AS h, unnest(range(1, len(tab[1]) + 1)) AS i) WHERE {own})"


def _cell_(kind: str) -> str:
    return f"CASE WHEN at_{kind} <= len(r) THEN r[at_{kind}] END"


_TAB = f"SELECT doc_id, page_number, list(parts ORDER BY line_number) AS tab FROM (SELECT *, {_PARTS} AS parts FROM ({LINES})) WHERE len(parts) >= 3 OR (len(parts) = 2 AND regexp_matches(text, '\\p{{Nd}}')) GROUP BY ALL HAVING count(*) >= 2"
_CELLS = f"""SELECT *, unnest(rs) AS r, unnest(range(0, len(rs))) AS seq FROM (SELECT *, list_filter(tab[2:], lambda z: len(z) >= 2) AS rs, {', '.join(f'{_at_(k)} AS at_{k}' for k in C.ITEM_HEADERS)}
  FROM (SELECT DISTINCT doc_id, page_number, document_type FROM ({_DISTINCT})) JOIN ({_TAB}) USING (doc_id, page_number) WHERE document_type IN ('invoice', 'receipt'))"""
_NUMBER = {k: f"try_cast(regexp_replace({_cell_(k)}, '[^\\p{{Nd}}.]', '', 'g') AS DOUBLE)" for k in ("quantity", "unit_price")}


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, document_type, seq::BIGINT AS seq, CASE document_type WHEN 'receipt' THEN r[1] ELSE coalesce({_cell_('description')}, r[1]) END AS description,
  CASE document_type WHEN 'invoice' THEN {_NUMBER['quantity']} END AS quantity, CASE document_type WHEN 'invoice' THEN {_NUMBER['unit_price']} END AS unit_price, CASE document_type WHEN 'receipt' THEN r[-1] ELSE coalesce({_cell_('amount')}, r[-1]) END AS amount FROM ({_CELLS})""")
def q_table_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of invoices and receipts from the tables of their layout."""
    out = None
    for kind in ("invoice", "receipt"):
        pages = _laid_out(spark, d, kind).dropDuplicates(["doc_id", "page_number"])
        rows = extraction.table_items(pages).withColumn("document_type", F.lit(kind))
        if kind == "receipt":
            none = F.lit(None).cast("double")
            rows = rows.withColumns({"description": F.col("cells")[0], "quantity": none, "unit_price": none, "amount": F.element_at("cells", -1)})
        out = rows if out is None else out.unionByName(rows)
    return out.select("doc_id", *big("page_number"), "document_type", *big("seq"), "description", "quantity", "unit_price", "amount")


_PAY = "(?:^|[^\\p{{L}}\\p{{N}}_])(?:{0})(?:$|[^\\p{{L}}\\p{{N}}_])"


@query(" UNION ALL ".join([
    _first("receipt_number", "raw_text", f"(?:receipt{_Z}*#|ticket{_Z}*#|order{_Z}*#|طلب{_Z}*رقم|إيصال{_Z}*رقم){_E}([A-Za-z0-9-_]+)", "receipt"),
    _first("total", "raw_text", f"(?:^|[^\\p{{L}}\\p{{N}}_])(?:total{_Z}*amount|grand{_Z}*total|total|amount{_Z}*due|المجموع{_Z}*الكلي|الإجمالي|المبلغ|الحساب){_E}{_M}", "receipt", "replace({0}, ',', '')"),
    f"""SELECT DISTINCT doc_id, page_number::BIGINT, 'payment_method', v FROM (SELECT *, CASE WHEN regexp_matches(raw_text, '(?i){_PAY.format('cash|نقد|كاش|نقدى')}') THEN 'Cash'
      WHEN regexp_matches(raw_text, '(?i){_PAY.format('visa|mastercard|mada|card|بطاقة|فيزا|ماستركارد|credit|debit')}') THEN 'Card' WHEN regexp_matches(raw_text, '(?i){_PAY.format('apple *pay|samsung *pay|mada *pay|محفظة')}') THEN 'Mobile Pay' END AS v
      FROM ({_DISTINCT}) WHERE document_type = 'receipt') WHERE v IS NOT NULL""",
]))
def q_extract_receipt(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, totals and ways of payment of receipts."""
    return _values(extraction.eav(_pages(spark, d, "receipt"), extraction.registered()["receipt"], "specialised", "receipt"), "receipt_number", "total", "payment_method")


_RECEIPT = {
    "merchant": f"list_filter({lines_('raw_text')}[1:3], lambda v: len({words_('v')}) <= 6 AND NOT {any_('lower(v)', ['receipt', 'invoice', 'فاتورة', 'إيصال', 'order', 'date', 'cashier', 'كاشير'])})[1]",
    "date": found_(f"(?:^|[^{_W}])({_DAY})(?:$|[^{_W}])"), "time": strip_(found_(f"(?:^|[^{_W}])((?:[01]?\\p{{Nd}}|2[0-3]):[0-5]\\p{{Nd}}(?::[0-5]\\p{{Nd}})?{_Z}*(?:AM|PM|ص|م)?)(?:$|[^{_W}])")),
    "subtotal": f"replace({found_(f'(?:subtotal|المجموع{_Z}*الفرعي)' + _E + _M)}, ',', '')", "tax": f"replace({found_('(?:tax|vat|الضريبة)' + _E + _M)}, ',', '')",
    "currency": f"upper({found_(f'(?:^|[^{_W}])(EGP|USD|EUR|SAR|AED|ج[.]م|جنيه|ريال|درهم)(?:$|[^{_W}])')})",
}


def _columns_sql(columns: dict[str, str], kind: str) -> str:
    """(doc_id, page_number, field_name, value) of expressions over the pages of one kind."""
    return " UNION ALL ".join(f"SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, '{n}' AS field_name, {v} AS value FROM ({_DISTINCT}) WHERE document_type = '{kind}' AND {v} IS NOT NULL AND {v} <> ''" for n, v in columns.items())


@query(_columns_sql(_RECEIPT, "receipt"))
def q_extract_receipt_all(spark: SparkSession, d: str) -> DataFrame:
    """Merchants, dates, times and sums of receipts."""
    return _values(extraction.eav(_pages(spark, d, "receipt"), extraction.registered()["receipt"], "specialised", "receipt"), *_RECEIPT)


_ZONE = f"list_filter({lines_('raw_text')}, lambda v: contains(v, 'P<') OR (contains(v, '<') AND length(v) >= 28))"
_MRZ = f"""SELECT doc_id, page_number, raw_text, l1, CASE WHEN length(l2) >= 28 THEN l2 END AS l2, l1[6:] AS nm, strpos(l1[6:], '<<') AS cutat FROM (SELECT *, CASE WHEN contains(z[-2], '<') THEN z[-2] END AS l1, CASE WHEN contains(z[-2], '<') THEN z[-1] END AS l2
  FROM (SELECT *, CASE WHEN len(zs) >= 2 THEN list_transform(zs, lambda v: replace(v, ' ', '')) ELSE [] END AS z FROM (SELECT *, {_ZONE} AS zs FROM ({_DISTINCT}) WHERE document_type = 'passport')))"""
_NAMES = "([A-Za-z\\x{0600}-\\x{06FF}\\s\\p{Z}]+)"
_some_ = lambda v: f"nullif({strip_(f"replace({v}, '<', ' ')")}, '')"
_six_ = lambda i, century: f"CASE WHEN regexp_matches(l2[{i}:{i + 5}], '^[0-9]{{6}}$') THEN {century} || l2[{i}:{i + 1}] || '-' || l2[{i + 2}:{i + 3}] || '-' || l2[{i + 4}:{i + 5}] END"
_seen_ = lambda label: first_line_(found_(f"(?:{label}){_E}{_NAMES}"))
_PASSPORT = {
    "issuing_country": f"coalesce(nullif(replace(l1[3:5], '<', ''), ''), {_seen_(f'issuing{_Z}*country|country|دولة الإصدار')})",
    "surname": f"coalesce({_some_('CASE WHEN cutat > 0 THEN nm[:cutat - 1] ELSE nm END')}, {_seen_('surname|nom|اللقب|اسم العائلة')})", "given_names": f"coalesce({_some_('CASE WHEN cutat > 0 THEN nm[cutat + 2:] END')}, {_seen_(f'given{_Z}*names?|prénoms|الاسم')})",
    "passport_number": f"coalesce(nullif(replace(l2[1:9], '<', ''), ''), {found_(f'(?:passport{_Z}*(?:no|number)|رقم الجواز){_E}([A-Z0-9]{{7,10}})')})",
    "date_of_birth": f"coalesce({_six_(14, "CASE WHEN try_cast(l2[14:15] AS INT) > 30 THEN '19' ELSE '20' END")}, {found_(f'(?:date{_Z}*of{_Z}*birth|dob|né le|تاريخ الميلاد){_E}({_DAY})')})",
    "expiry_date": f"coalesce({_six_(22, "'20'")}, {found_(f'(?:date{_Z}*of{_Z}*expiry|expiry{_Z}*date|expire le|تاريخ الانتهاء){_E}({_DAY})')})",
    "mrz_detected": "CASE WHEN l1 IS NOT NULL THEN 'true' END",
}


@query(_columns_sql(_PASSPORT, "x").replace(f"({_DISTINCT})", f"({_MRZ})").replace("document_type = 'x' AND ", ""))
def q_extract_passport(spark: SparkSession, d: str) -> DataFrame:
    """What passports say in their machine-readable lines, else in print."""
    return _values(extraction.eav(_pages(spark, d, "passport"), extraction.registered()["passport"], "specialised", "passport"), *_PASSPORT)


_VALID = lambda n: f"(length({n}) = 14 AND {n}[1] IN ('2', '3') AND coalesce(try_strptime({_BORN.replace('n[', n + '[')}, '%Y-%m-%d') <= DATE '2026-01-01', false) AND {_GOV}[{n}[8:9]] IS NOT NULL)"
_GROUPS = "regexp_extract_all(v, '[0-9]+')"
_TURNED = f"array_to_string(list_reverse({_GROUPS}), '')"
_REPAIRED = f"CASE WHEN {n_('v', '0-9')} > length(regexp_replace(v, '[^' || chr(92) || 'p{{L}}]', '', 'g')) AND {n_('v', '0-9')} >= 10 AND len({_GROUPS}) > 1 AND regexp_matches({_TURNED}, '^[23][0-9]{{13}}$') THEN {_TURNED} ELSE v END"
_JOINED = "regexp_replace(regexp_replace({0}, '([0-9])[ \t]+([0-9])', '\\1\\2', 'g'), '([0-9])[ \t]+([0-9])', '\\1\\2', 'g')"
_CARD = f"""SELECT doc_id, page_number, list_filter(list_transform(regexp_split_to_array({digits_('raw_text')}, '{C.LINE_ENDS}'), lambda v: {strip_("translate(" + _JOINED.format(_REPAIRED) + ", '|_-؛;:.,»«', '          ')")}), lambda v: v <> '') AS ls
  FROM ({_DISTINCT}) WHERE document_type = 'id_card'"""
_BARE = "regexp_replace({0}, '[^0-9]', '', 'g')"
_NUMBERS = f"""SELECT *, coalesce(
  list_filter(flatten(list_transform(ls, lambda v: regexp_extract_all(v, '(?:^|[^{_W}])([23][0-9]{{13}})(?:$|[^{_W}])', 1))), lambda z: {_VALID('z')})[1],
  list_filter(flatten(list_transform(list_filter(list_transform(ls, lambda v: {_BARE.format('v')}), lambda z: length(z) >= 14), lambda z: list_transform(range(1, length(z) - 12), lambda i: z[i:i + 13]))), lambda z: {_VALID('z')})[1],
  list_filter(flatten(list_transform(range(1, len(sm)), lambda i: [sm[i] || sm[i + 1], sm[i + 1] || sm[i]])), lambda z: regexp_matches(z, '^[23][0-9]{{13}}$') AND {_VALID('z')})[1]) AS n
  FROM (SELECT *, list_transform(list_filter(ls, lambda v: {n_('v', '0-9')} >= 2), lambda v: {_BARE.format('v')}) AS sm FROM ({_CARD}))"""
_LABELLED = f"(?:^|[^{_W}])([0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}|[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})(?:$|[^{_W}])"
_BESIDE = f"list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN {any_('lower(ls[i])', C.BIRTH_LABELS)} THEN coalesce(nullif(regexp_extract(ls[i], '{_LABELLED}', 1), ''), nullif(regexp_extract(ls[i + 1], '{_LABELLED}', 1), '')) END), lambda z: z IS NOT NULL)[1]"
_HELD = {
    "national_id": "n", "birth_date": f"coalesce(try_strptime({_BORN}, '%Y-%m-%d')::DATE::VARCHAR, {_BESIDE})", "gender": "CASE WHEN n IS NOT NULL THEN CASE WHEN n[13]::INT % 2 <> 0 THEN 'Male' ELSE 'Female' END END",
    "governorate": f"{_GOV}[n[8:9]]", "governorate_code": "n[8:9]",
}


@query(" UNION ALL ".join(f"SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, '{k}' AS field_name, {v} AS value FROM ({_NUMBERS}) WHERE {v} IS NOT NULL" for k, v in _HELD.items()))
def q_id_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of identity cards, printed, in longer runs or in two lines, what they hold, and birth dates beside labels."""
    return _values(extraction.eav(_pages(spark, d, "id_card"), extraction.registered()["id_card"], "specialised", "id_card"), *_HELD)


@query()
def q_extract_id_card(spark: SparkSession, d: str) -> DataFrame:
    """All fields of identity cards."""
    return extraction.eav(_pages(spark, d, "id_card"), extraction.registered()["id_card"], "specialised", "id_card")


def _term_(term: str) -> str:
    p = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in term)
    end = f"(?:$|[^{_W}])" if term[-1].isalnum() else f"[{_W}]"
    return f"CASE WHEN contains(lower(raw_text), '{term}') AND regexp_matches(lower(raw_text), '(?:^|[^{_W}]){p}{end}') THEN '{term.title() if len(term) > 3 else term.upper()}' END"


def _terms_(terms: list[str]) -> str:
    return f"list_filter([{', '.join(map(_term_, terms))}], lambda v: v IS NOT NULL)"


_CV = {
    "name": f"[list_filter({lines_('raw_text')}[1:4], lambda v: NOT contains(v, '@') AND NOT {any_('lower(v)', ['curriculum', 'resume', 'cv', 'page', 'profile', 'contact'])} AND len({words_('v')}) BETWEEN 2 AND 5 AND length(v) < 45)[1]]",
    "email": "[regexp_extract(raw_text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,7}\\b')]",
    "phone": f"[{strip_('regexp_extract(raw_text, ' + chr(39) + '(?:[+]?20' + chr(92) + 's?|0020' + chr(92) + 's?|0)?(?:10|11|12|15)[0-9]{8}' + chr(92) + 'b|[+]?[1-9][0-9]{1,3}[-.' + chr(92) + 's]?[(]?[0-9]{2,4}[)]?[-.' + chr(92) + 's]?[0-9]{3,4}[-.' + chr(92) + 's]?[0-9]{3,4}' + chr(39) + ')')}]",
    "skills": _terms_(extraction.SKILLS), "languages": _terms_(extraction.LANGUAGES),
    "education": f"list_transform(regexp_extract_all(raw_text, '(?i)(?:Bachelor|Master|PhD|B[.]Sc|M[.]Sc|BSc|MSc|بكالوريوس|ماجستير|دكتوراه|جامعة|University|Faculty of)[^\\n]+')[1:5], lambda v: {strip_('v')})",
    "summary": f"[{strip_(found_(f'(?:summary|professional{_Z}*summary|profile|about{_Z}*me|نبذة{_Z}*شخصية|نبذة{_Z}*عني){_Z}*[:\n]{_Z}*([^\n]+(?:\n[^\n]+){{1,3}})'))}]",
}


@query(" UNION ALL ".join(f"SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, '{n}' AS field_name, v AS value FROM (SELECT doc_id, page_number, unnest({v}) AS v FROM ({_DISTINCT}) WHERE document_type = 'cv') WHERE v <> ''" for n, v in _CV.items()))
def q_extract_cv(spark: SparkSession, d: str) -> DataFrame:
    """Names, contacts, skills, languages, education and summaries of CVs."""
    return _values(extraction.eav(_pages(spark, d, "cv"), extraction.registered()["cv"], "specialised", "cv"), *_CV)


#: Texts of papers that the tables hold none of, with what is to be found in them.
FIXTURES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "driver_license": ("رخصة قيادة\nLicense No: DL-55781\nName: Karim Adel\nprivate\nفصيلة الدم: AB\n2020-03-01\n2027-03-01", [("license_number", "DL-55781"), ("holder_name", "Karim Adel"), ("license_class", "private"), ("blood_type", "AB"), ("issue_date", "2020-03-01"), ("expiry_date", "2027-03-01")]),
    "bank_document": ("North Bank\nAccount Number: 1234567890\nIBAN\nEG380019000500000000263180002\nSWIFT: NBEGEGCX\nClosing Balance: 12,500.75 EGP", [("bank_name", "North Bank"), ("account_number", "1234567890"), ("iban", "EG380019000500000000263180002"), ("swift_bic", "NBEGEGCX"), ("balance", "12500.75"), ("currency", "EGP")]),
    "contract": ("Lease Contract\nFirst Party: Nile Homes\nSecond Party: Omar Said\nDate: 2024-05-06\nArticle 1 Rent is due monthly\nClause 2 Notice is one month\nRent 5,000 EGP\nSignature", [("title", "Lease Contract"), ("first_party", "Nile Homes"), ("second_party", "Omar Said"), ("parties", "Nile Homes"), ("parties", "Omar Said"), ("date", "2024-05-06"), ("dates", "2024-05-06"), ("clauses", "Article 1 Rent is due monthly"), ("clauses", "Clause 2 Notice is one month"), ("amounts", "5,000 EGP"), ("signatures_detected", "true")]),
    "form": ("Application Form\nCity: Giza\nPhone:\nplain line", [("form_title", "Application Form"), ("form_fields", "City=Giza"), ("form_fields", "Phone=")]),
    "report": ("Annual Findings\nPrepared by: Mona Fathy\n2023/11/30", [("report_title", "Annual Findings"), ("author", "Mona Fathy"), ("date", "2023/11/30")]),
    "certificate": ("Certificate of Skill\nawarded to Hana Nabil\n12/01/2022", [("title", "Certificate of Skill"), ("recipient", "Hana Nabil"), ("date", "12/01/2022")]),
    "letter": ("To: Board Office\nSubject: Parking places\n2021-02-03", [("recipient", "Board Office"), ("subject", "Parking places"), ("date", "2021-02-03")]),
    "screenshot": ("https://example.org/a b\n09:41 AM www.example.net", [("detected_urls", "https://example.org/a"), ("detected_urls", "www.example.net"), ("detected_timestamps", "09:41 AM")]),
    "table": ("name | qty\na | 1\nb | 2", [("headers", "name"), ("headers", "qty"), ("row_count", "2")]),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{kind}', '{n}', '{v}')" for i, (kind, (_, found)) in enumerate(FIXTURES.items()) for n, v in found) + ") AS v(doc_id, extractor, field_name, value)")
def q_extract_others(spark: SparkSession, d: str) -> DataFrame:
    """Fields of licences, bank papers, contracts, forms, reports, certificates, letters, screenshots, tables."""
    rows = spark.createDataFrame([(i, 1, kind, text) for i, (kind, (text, _)) in enumerate(FIXTURES.items())], "doc_id BIGINT, page_number INT, category STRING, text STRING")
    extractors = extraction.registered()
    out = None
    for kind in FIXTURES:
        part = extraction.eav(rows.where(F.col("category") == kind), extractors[kind], "specialised", kind)
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", "extractor", "field_name", "value")


_PARTY = "([A-Za-z\\x{0600}-\\x{06FF}0-9\\s\\p{Z}.,]+)"
_ANY_DAY = found_(f"(?:^|[^{_W}])({_DAY})(?:$|[^{_W}])")
_PROSE = {
    "contract": {
        "title": f"[list_filter({lines_('raw_text')}[1:4], lambda v: {any_('v', ['عقد', 'اتفاقية', 'Agreement', 'Contract', 'Memorandum'])})[1]]", "first_party": f"[{first_line_(found_(f'(?:الطرف{_Z}*الأول|First{_Z}*Party){_E}{_PARTY}'))}]",
        "second_party": f"[{first_line_(found_(f'(?:الطرف{_Z}*(?:الثاني|الثانى)|Second{_Z}*Party){_E}{_PARTY}'))}]", "date": f"[regexp_extract_all(raw_text, '(?i)(?:تاريخ{_Z}*التحرير|حرر{_Z}*في|الموافق|Date|dated){_E}({_DAY})', 1)[1]]",
        "clauses": f"list_filter(list_transform(regexp_extract_all(raw_text, '(?i)(?:(?:البند|المادة|الفصل){_Z}*[\\x{{0600}}-\\x{{06FF}}0-9]+|Article{_Z}*\\p{{Nd}}+|Clause{_Z}*\\p{{Nd}}+)[^\\n]*'), lambda v: {strip_('v')}), lambda v: length(v) > 3 AND length(v) < 120)[1:15]",
        "signatures_detected": f"[CASE WHEN {any_('raw_text', ['توقيع', 'التوقيعات', 'Signature', 'Signatures', 'Signed by'])} THEN 'true' END]",
    },
    "report": {"report_title": f"[{lines_('raw_text')}[1]]", "date": f"[{_ANY_DAY}]", "author": f"[{first_line_(found_(f'(?:prepared{_Z}*by|author|إعداد|بواسطة){_E}{_NAMES}'))}]"},
    "letter": {"recipient": f"[{first_line_(found_(f'(?:السيد{_Z}*/|عناية{_Z}*/|to{_Z}*:|dear{_Z}+){_NAMES}'))}]", "subject": f"[{strip_(found_(f'(?:الموضوع|subject|re){_E}([^\\n]+)'))}]", "date": f"[{_ANY_DAY}]"},
}


@query(" UNION ALL ".join(f"SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, '{kind}' AS extractor, '{n}' AS field_name, v AS value FROM (SELECT doc_id, page_number, unnest({e}) AS v FROM ({_DISTINCT}) WHERE document_type = '{kind}') WHERE v <> ''" for kind, of in _PROSE.items() for n, e in of.items()))
def q_extract_prose(spark: SparkSession, d: str) -> DataFrame:
    """Fields of all reports, letters and contracts."""
    out = None
    for kind, of in _PROSE.items():
        part = extraction.eav(_pages(spark, d, kind), extraction.registered()[kind], "specialised", kind).where(F.col("field_name").isin(list(of)))
        out = part if out is None else out.unionByName(part)
    return out.select("doc_id", *big("page_number"), "extractor", "field_name", "value").distinct()


def _classified(spark: SparkSession, d: str) -> DataFrame:
    pages = _texts(spark, d, "raw_text", "width", "height").withColumnRenamed("raw_text", "text").distinct()
    return classification.classify(spread(pages))


@query()
def q_registry_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fields of classified pages, the specialised before the generic."""
    return extraction.extract(_classified(spark, d))


_LABEL = "list_aggregate(list_transform(string_split(field_name, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"


@query(f"""SELECT DISTINCT doc_id, page_number::BIGINT AS page_number, source, field_name, seq::BIGINT AS seq, value, {_LABEL} AS label, {lang_('nv')} AS language, {direction_('nv')} AS direction, coalesce(confidence, 1.0) AS confidence
  FROM (SELECT *, {normal_('value')} AS nv, dense_rank() OVER (PARTITION BY doc_id, page_number, field_name ORDER BY source DESC) AS k FROM fields WHERE value IS NOT NULL) WHERE k = 1""")
def q_structured_fields(spark: SparkSession, d: str) -> DataFrame:
    """The extracted fields, specialised before generic, with label, language and direction."""
    rows = table(spark, d, "fields", "doc_id", "page_number", "source", "field_name", "seq", "value", "confidence").where("value IS NOT NULL").distinct()
    return extraction.structured(extraction.merged(rows)).select("doc_id", *big("page_number"), "source", "field_name", *big("seq"), "value", "label", "language", "direction", "confidence").distinct()


@query(f"""SELECT doc_id, page_number::BIGINT AS page_number, string_agg(text, chr(10) ORDER BY line_number) AS text, string_agg(coalesce(nullif(raw, ''), text), chr(10) ORDER BY line_number) AS raw_text,
  string_agg(coalesce(nullif({normal_('text')}, ''), text), chr(10) ORDER BY line_number) AS normalized_text FROM (SELECT doc_id, page_number, line_number, string_agg(coalesce(text, ''), ' ' ORDER BY detection_order) AS text,
  string_agg(coalesce(CASE WHEN coalesce(raw_text, '') = '' THEN text ELSE raw_text END, ''), ' ' ORDER BY detection_order) AS raw FROM ({BLOCKS}) GROUP BY ALL) GROUP BY ALL""")
def q_page_text(spark: SparkSession, d: str) -> DataFrame:
    """The three texts of pages from their lines."""
    return recognition.page_text(_lines(spark, d)).select("doc_id", *big("page_number"), "text", "raw_text", "normalized_text")


@query(f"""WITH f AS (SELECT doc_id, page_number, field_name, string_agg(value, '|' ORDER BY seq, value) AS v FROM (SELECT DISTINCT doc_id, page_number, field_name, seq, value FROM fields WHERE value IS NOT NULL AND source = 'specialised') GROUP BY ALL),
  m AS (SELECT doc_id, page_number, string_agg(field_name || '=' || v, ';' ORDER BY field_name) AS fields FROM f GROUP BY ALL),
  l AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY line_number) AS text, min(confidence) < 0.5 AS low FROM ({LINES}) GROUP BY ALL)
  SELECT doc_id, page_number::BIGINT AS page_number, document_type AS type, {lang_('l.text')} AS language, l.text AS text, fields FROM (SELECT DISTINCT doc_id, page_number, document_type FROM doc_text) JOIN l USING (doc_id, page_number) LEFT JOIN m USING (doc_id, page_number)""")
def q_response(spark: SparkSession, d: str) -> DataFrame:
    """The nested record of every page, with the map of its fields."""
    pages = recognition.page_text(_lines(spark, d)).join(_texts(spark, d, "document_type").distinct().withColumnRenamed("document_type", "category"), ["doc_id", "page_number"])
    pages = pages.join(recognition.review_flags(_blocks(spark, d), _texts(spark, d)), ["doc_id", "page_number"]).withColumns({"language": T.language(F.col("text"))["lang"], "confidence": F.lit(1.0)})
    fields = table(spark, d, "fields", "doc_id", "page_number", "field_name", "seq", "value", "source").where("value IS NOT NULL AND source = 'specialised'").drop("source").distinct()
    found = recognition.responses(pages, fields).select("doc_id", *big("page_number"), "response.document.type", "response.document.language", "response.text", F.array_sort(F.map_entries("response.fields")).alias("e"))
    return found.select("doc_id", "page_number", "type", "language", "text", F.array_join(F.transform("e", lambda v: F.concat(v["key"], F.lit("="), F.array_join(v["value"], "|"))), ";").alias("fields"))


@query(f"""WITH f AS (SELECT DISTINCT doc_id, page_number, field_name, seq, value FROM fields WHERE value IS NOT NULL AND source = 'specialised'),
  v AS (SELECT f.*, lower({strip_('value')}) AS x, lower(list_aggregate(list_transform(string_split(field_name, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')) AS y FROM f),
  a AS (SELECT v.doc_id, v.page_number, field_name, seq, value, min(line_number) FILTER (contains(lower(text), x)) AS lv, min(line_number) FILTER (contains(lower(text), y)) AS ll FROM v LEFT JOIN ({LINES}) l ON l.doc_id = v.doc_id AND l.page_number = v.page_number GROUP BY ALL)
  SELECT doc_id, page_number::BIGINT AS page_number, field_name, seq::BIGINT AS seq, value, CASE WHEN {strip_('value')} <> '' THEN coalesce(lv, ll) END::BIGINT AS source_line FROM a""")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The line that each extracted value comes from."""
    fields = table(spark, d, "fields", "doc_id", "page_number", "field_name", "seq", "value", "source").where("value IS NOT NULL AND source = 'specialised'").drop("source").distinct()
    return extraction.provenance(fields, _lines(spark, d)).select("doc_id", *big("page_number"), "field_name", *big("seq"), "value", *big("source_line"))


@query()
def q_legacy_id(spark: SparkSession, d: str) -> DataFrame:
    """Identity cards as rows of fixed columns."""
    return extraction.legacy_id(_pages(spark, d, "id_card"))


# ---- accuracy (M1-M5) ---------------------------------------------------------------------------------------------
@query("""SELECT p_partkey, levenshtein(coalesce(p_name, ''), coalesce(p_brand, ''))::BIGINT AS character_errors, round(levenshtein(coalesce(p_name, ''), coalesce(p_brand, ''))::DOUBLE / greatest(length(coalesce(p_name, '')), 1), 6) AS cer,
  coalesce(p_name, '') = coalesce(p_brand, '') AS exact_match FROM part""")
def q_char_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M1, M2: character errors between two texts of every part."""
    found = evaluation.text_metrics(table(spark, d, "part", "p_partkey", "p_name", "p_brand"), "p_name", "p_brand")
    return found.select("p_partkey", *big("character_errors"), r6("cer").alias("cer"), "exact_match")


@query()
def q_text_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M2: character and word errors of the clean text of every page against its raw text."""
    pages = spread(_texts(spark, d, "raw_text", "normalized_text").distinct())
    return evaluation.text_metrics(pages, "raw_text", "normalized_text").drop("raw_text", "normalized_text")


@query("""SELECT count(*)::BIGINT AS samples, round(sum(e)::DOUBLE / greatest(sum(n), 1), 6) AS cer, round(avg(x::INT), 6) AS exact_match_rate FROM (
  SELECT levenshtein(coalesce(p_name, ''), coalesce(p_brand, '')) AS e, length(coalesce(p_name, '')) AS n, coalesce(p_name, '') = coalesce(p_brand, '') AS x FROM part)""")
def q_micro_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M4: micro-averages."""
    rows = evaluation.text_metrics(table(spark, d, "part", "p_partkey", "p_name", "p_brand"), "p_name", "p_brand")
    return evaluation.aggregate_text_metrics(rows).select("samples", r6("cer").alias("cer"), r6("exact_match_rate").alias("exact_match_rate"))


_FM = "SELECT doc_id, field_name, min(value) AS value FROM fields WHERE value IS NOT NULL AND {0} GROUP BY ALL"


@query(f"""SELECT doc_id, count(*) FILTER (e.value IS NOT NULL AND a.value IS NOT NULL AND e.value = a.value)::BIGINT AS correct, count(*)::BIGINT AS total, round(count(*) FILTER (e.value IS NOT NULL AND a.value IS NOT NULL AND e.value = a.value)::DOUBLE / count(*), 6) AS accuracy
  FROM ({_FM.format("is_valid")}) e FULL JOIN ({_FM.format("confidence >= 0.7")}) a USING (doc_id, field_name) GROUP BY ALL""")
def q_field_metrics(spark: SparkSession, d: str) -> DataFrame:
    """M3: agreement of the valid fields of documents with the sure ones."""
    fields = table(spark, d, "fields", "doc_id", "field_name", "value", "is_valid", "confidence").where("value IS NOT NULL")
    least = lambda f: f.groupBy("doc_id", "field_name").agg(F.min("value").alias("value"))
    return evaluation.field_metrics(least(fields.where("is_valid")), least(fields.where("confidence >= 0.7"))).select("doc_id", *big("correct", "total"), r6("accuracy").alias("accuracy"))


@query("SELECT * FROM (VALUES ('a', 1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('b', 1::BIGINT, 0.25::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), (NULL, 2::BIGINT, 0.1::DOUBLE, 0.333333::DOUBLE, 0.5::DOUBLE, 0.666667::DOUBLE)) AS v(id, samples, cer, wer, exact_match_rate, field_accuracy)")
def q_evaluate(spark: SparkSession, d: str) -> DataFrame:
    """M5: a manifest's records and their total."""
    rows = [("a", "ab cde", "ab cde", {"x": "1"}, {"x": "1"}), ("b", "abcd", "abcx", {"x": "1", "y": "2"}, {"x": "1"})]
    manifest = spark.createDataFrame(rows, "id STRING, expected_text STRING, actual_text STRING, expected_fields MAP<STRING,STRING>, actual_fields MAP<STRING,STRING>")
    return evaluation.evaluate(manifest).select("id", "samples", *(r6(c).alias(c) for c in ("cer", "wer", "exact_match_rate", "field_accuracy")))


# ---- uploads (S1-S17) ---------------------------------------------------------------------------------------------
_HEX = "hex(content)"
_SNIFF = f"CASE WHEN coalesce(octet_length(content), 0) < 4 THEN NULL " + " ".join(f"WHEN starts_with({_HEX}, '{s}') THEN '{m}'" for s, m in U.SIGNATURES) + f" WHEN starts_with({_HEX}, '52494646') AND {_HEX}[17:24] = '57454250' THEN 'image/webp' END"
_DECL = f"lower({strip_('coalesce(declared_type, chr(0)[1:0])')})"
_CANON = f"CASE {_DECL} " + " ".join(f"WHEN '{a}' THEN '{m}'" for a, m in U.ALIASES.items()) + f" ELSE {_DECL} END"
_LIST = ", ".join(f"'{a}'" for a in U.ALLOWED)


@query(f"""SELECT doc_id, uploaded_at, mime, CASE WHEN coalesce(size_bytes, 0) <= 0 THEN 'INVALID_IMAGE' WHEN size_bytes > 10485760 THEN 'PAYLOAD_TOO_LARGE' WHEN mime IS NULL OR mime NOT IN ({_LIST}, 'application/pdf') THEN 'UNSUPPORTED_MEDIA_TYPE'
  WHEN dc NOT IN ('', 'application/octet-stream') AND dc <> mime THEN 'UNSUPPORTED_MEDIA_TYPE' END AS error_code FROM (SELECT doc_id, uploaded_at, size_bytes, CASE WHEN starts_with({_HEX}, '255044462D') THEN 'application/pdf' ELSE {_SNIFF} END AS mime, {_CANON} AS dc FROM uploads)""")
def q_content_check(spark: SparkSession, d: str) -> DataFrame:
    """Media type of every upload by its bytes, and the error that it would meet."""
    rows = table(spark, d, "uploads", "doc_id", "uploaded_at", "size_bytes", "content", "declared_type")
    return U.content_check(rows).select("doc_id", "uploaded_at", "mime", "error_code")


@query(f"""SELECT doc_id, uploaded_at, CASE WHEN {strip_("coalesce(filename, '')")} = '' THEN 'VALIDATION_ERROR' WHEN coalesce(declared_type, '') <> '' AND declared_type NOT IN ({_LIST}, 'application/octet-stream') THEN 'UNSUPPORTED_MEDIA_TYPE'
  WHEN m IS NULL OR m NOT IN ({_LIST}) THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN coalesce(declared_type, '') NOT IN ('', 'application/octet-stream') AND declared_type <> m THEN 'UNSUPPORTED_MEDIA_TYPE' WHEN size_bytes > 10485760 THEN 'PAYLOAD_TOO_LARGE' END AS error_code
  FROM (SELECT *, {_SNIFF} AS m FROM uploads)""")
def q_metadata_check(spark: SparkSession, d: str) -> DataFrame:
    """The older check of uploads."""
    return U.metadata_check(table(spark, d, "uploads", "doc_id", "uploaded_at", "filename", "size_bytes", "content", "declared_type")).select("doc_id", "uploaded_at", "error_code")


@query("""SELECT doc_id, page_number::BIGINT AS page_number, coalesce(width >= 1 AND height >= 1 AND greatest(width, height) <= 10000 AND width::BIGINT * height <= 50000000, false) AS good,
  round(CASE WHEN width > 0 AND height > 0 THEN least(200.0 / 72, 3200.0 / greatest(width, height), sqrt(12000000.0 / (width * height))) END, 6)::DOUBLE AS pdf_scale FROM doc_text""")
def q_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Whether pages have good dimensions, and the scale of a PDF page of that size."""
    w, h = F.col("width"), F.col("height")
    return _texts(spark, d, "width", "height").select("doc_id", *big("page_number"), U.dimensions_good(w, h).alias("good"), r6(U.pdf_scale(w, h)).alias("pdf_scale"))


@query("SELECT doc_id, uploaded_at, CASE WHEN coalesce(page_count, 0) < 1 THEN 'INVALID_IMAGE' WHEN page_count > 20 THEN 'PAYLOAD_TOO_LARGE' END AS error_code FROM uploads")
def q_page_guard(spark: SparkSession, d: str) -> DataFrame:
    """Uploads with too few or too many pages."""
    return table(spark, d, "uploads", "doc_id", "uploaded_at", "page_count").select("doc_id", "uploaded_at", U.page_count_check(F.col("page_count")).alias("error_code"))


@query("""SELECT doc_id, page_number::BIGINT AS page_number, rp::BIGINT AS running_pixels FROM (SELECT doc_id, page_number, sum(width::BIGINT * height) OVER (PARTITION BY doc_id ORDER BY page_number) AS rp
  FROM (SELECT DISTINCT doc_id, page_number, width, height FROM doc_text WHERE width IS NOT NULL AND height IS NOT NULL)) WHERE rp <= 100000000""")
def q_pixel_guard(spark: SparkSession, d: str) -> DataFrame:
    """Pages within the running sum of pixels of their document."""
    pages = _texts(spark, d, "width", "height").where("width IS NOT NULL AND height IS NOT NULL").distinct()
    return U.pages_within_pixels(pages).select("doc_id", *big("page_number", "running_pixels"))



# ---- images (I1-I8) -----------------------------------------------------------------------------------------------
def _drawn(spark: SparkSession) -> DataFrame:
    """Images of every kind that the thresholds part: flat, half dark, lines of text, the same shadowed, small, unreadable."""
    white = np.full((400, 600), 255, np.uint8)
    text = white.copy()
    for y in range(40, 360, 30):
        text[y : y + 8, 50:550:3] = 0
    half = white.copy()
    half[:, 300:] = 20
    shadow = (text * np.linspace(0.4, 1, 600)[None, :]).astype(np.uint8)
    rows = [(i, (a.shape[0], a.shape[1], 1, a.tobytes())) for i, a in enumerate((white, text, half, shadow, text[:100, :120]))] + [(5, (-1, -1, -1, b""))]
    return spark.createDataFrame(rows, "doc_id BIGINT, image STRUCT<height INT, width INT, nChannels INT, data BINARY>")


@query()
def q_image_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality and skew of drawn images."""
    return images.quality(_drawn(spark)).select("doc_id", "quality.*")


@query()
def q_image_plan(spark: SparkSession, d: str) -> DataFrame:
    """What preprocessing would do to drawn images."""
    found = images.measured(_drawn(spark)).where("image.height > 0")
    return found.select("doc_id", images.plan(F.col("image.width"), F.col("image.height"), F.col("measures")).alias("p")).select("doc_id", "p.*")
