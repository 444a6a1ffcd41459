"""Recognised text blocks: cleaning, boxes, quality, passes, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import constants as C
from folioscope.functions.text import filled, occurrences

PAGE = ("doc_id", "page_number")
#: Thresholds of review, retry, orientation, merging.
REVIEW, RETRY, ORIENTATION, WEAK_SHARE, WEAK_SCORE, VERTICAL = 0.5, 0.60, 0.30, 0.30, 0.50, 0.60
MERGE_CONFIDENCE, MERGE_OVERLAP, CANVAS = 0.60, 0.18, 3200
_STRUCTURED = rf"(?<![{C.WORD}])(?:\p{{Nd}}{{4}}[-/]\p{{Nd}}{{1,2}}[-/]\p{{Nd}}{{1,2}}|\p{{Nd}}{{6,}}|20\p{{Nd}}{{8,10}}|[A-Za-z0-9_-]+@[A-Za-z0-9.-]+)(?![{C.WORD}])"


def mean(values: Column | str) -> Column:
    """Average by exact decimal sums, the same in whatever order rows are added; null over nothing."""
    value = F.col(values) if isinstance(values, str) else values
    return F.sum(value.cast("decimal(18,9)")).cast("double") / F.count(value)


def edge(points: Column, axis: str, least: bool) -> Column:
    """Smallest or greatest coordinate of a polygon."""
    values = F.transform(points, lambda p: p[axis])
    return F.array_min(values) if least else F.array_max(values)


def sanitized(blocks: DataFrame) -> DataFrame:
    """Blocks with text, a confidence from 0 to 1 and four finite corners."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    corners = F.coalesce((F.size("points") == 4) & F.forall("points", lambda p: finite(p["x"]) & finite(p["y"])), F.lit(False))
    return blocks.where(filled(F.col("text")) & F.coalesce(F.col("confidence").between(0, 1) & ~F.isnan("confidence"), F.lit(False)) & corners)


def boxed(blocks: DataFrame) -> DataFrame:
    """Adds left, top, right, bottom, width, height, area, cx, cy."""
    out = blocks
    for name, axis, least in (("left", "x", True), ("top", "y", True), ("right", "x", False), ("bottom", "y", False)):
        out = out.withColumn(name, edge(F.col("points"), axis, least))
    return out.withColumns({
        "width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top"), "cx": (F.col("left") + F.col("right")) / 2, "cy": (F.col("top") + F.col("bottom")) / 2,
    }).withColumn("area", F.col("width") * F.col("height"))


def normalised_points(points: Column, width: Column, height: Column) -> Column:
    """Corners as shares of the image; sides of null or under 1 count as 1."""
    w, h = (F.greatest(F.coalesce(v.cast("double"), F.lit(1.0)), F.lit(1.0)) for v in (width, height))
    return F.transform(points, lambda p: F.struct((p["x"] / w).alias("x"), (p["y"] / h).alias("y")))


def rescaled(points: Column, sx: Column, sy: Column, corrected: Column) -> Column:
    """Corners in source pixels; left alone where the geometry was corrected."""
    return F.when(F.coalesce(corrected, F.lit(False)), points).otherwise(F.transform(points, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y"))))


def overlap(a: str, b: str) -> Column:
    """Intersection over union of two boxes (structs with left, top, right, bottom); areas count 1 at least."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}.right", f"{b}.right") - F.greatest(f"{a}.left", f"{b}.left"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}.bottom", f"{b}.bottom") - F.greatest(f"{a}.top", f"{b}.top"))
    size = lambda x: F.greatest(F.lit(1.0), (F.col(f"{x}.right") - F.col(f"{x}.left")) * (F.col(f"{x}.bottom") - F.col(f"{x}.top")))
    return w * h / (size(a) + size(b) - w * h)


def magnification(longest: Column) -> Column:
    return F.when(longest <= 1200, 1.5).when(longest <= 1800, 1.25).otherwise(1.0)


def retry_scale(longest: Column, canvas: int = CANVAS) -> Column:
    """Factor by which an original image is resized before its retry."""
    return F.when(longest > canvas, canvas / longest).when(longest <= 1200, F.least(F.lit(1.5), canvas / longest)).otherwise(1.0)


def page_quality(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Quality of each page: average confidence, coherence, counts, structured data, composite score from 0 to 1."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("detection_order", F.coalesce("text", F.lit("")).alias("text")))), lambda b: b["text"]), " ")
    page = blocks.groupBy(*keys).agg(mean("confidence").alias("avg_confidence"), F.count("*").alias("block_count"), ordered.alias("_text"))
    return page.withColumns(_quality(F.col("_text"), F.col("avg_confidence"))).drop("_text")


def _quality(text: Column, average: Column) -> dict[str, Column]:
    plain = F.length(F.translate(text, " ", ""))
    meaning = occurrences(text, C.ARABIC_BLOCK + "a-zA-Z" + C.DIGITS)
    coherence = meaning / F.greatest(plain, F.lit(1))
    structured = F.coalesce(text.rlike(_STRUCTURED), F.lit(False))
    score = 0.35 * average + 0.35 * coherence + 0.15 * F.least(F.lit(1.0), plain / 60.0) + F.when(structured, 0.1).otherwise(0.0)
    some = plain > 0
    return {
        "char_count": plain, "coherence": F.when(some, coherence).otherwise(0.0), "structured": structured,
        "composite": F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0),
    }


def review_flags(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """needs_review (no blocks, or one under REVIEW) and uncertain_lines (mean under REVIEW) of every page."""
    lines = blocks.groupBy(*PAGE, "line_number").agg(mean("confidence").alias("mean"), F.min("confidence").alias("least"))
    unsure = F.array_sort(F.collect_list(F.when(F.col("mean") < REVIEW, F.col("line_number"))))
    flags = lines.groupBy(*PAGE).agg(F.coalesce(F.bool_or(F.col("least") < REVIEW), F.lit(False)).alias("low"), unsure.alias("uncertain_lines"))
    joined = pages.select(*PAGE).distinct().join(flags, list(PAGE), "left")
    return joined.select(*PAGE, F.coalesce("low", F.lit(True)).alias("needs_review"), F.coalesce("uncertain_lines", F.array().cast("array<int>")).alias("uncertain_lines"))


def routing(blocks: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Which pages are read again, and how: ``rotate``, ``original`` or ``keep``."""
    boxes = boxed(blocks)
    shape = boxes.groupBy(*keys).agg(
        mean((F.col("confidence") < REVIEW).cast("double")).alias("weak_fraction"),
        mean((F.col("height") > F.greatest(F.col("width"), F.lit(1.0)) * 1.5).cast("double")).alias("vertical_fraction"),
    )
    page = page_quality(blocks, keys).join(shape, list(keys))
    vertical = (F.col("block_count") >= 3) & (F.col("vertical_fraction") >= VERTICAL)
    very = F.coalesce(F.col("avg_confidence") < ORIENTATION, F.lit(True)) | vertical
    weak = very | (F.col("avg_confidence") < RETRY) | (F.col("weak_fraction") >= WEAK_SHARE) | (F.col("composite") < WEAK_SCORE)
    return page.withColumn("route", F.when(very, "rotate").when(weak, "original").otherwise("keep"))


def best_attempt(attempts: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The attempt kept: (attempt_no from 0, composite, average, block_count, rotation); strictly better ones replace it,
    and rotations end at the first that is good."""
    order = W.partitionBy(*keys).orderBy("attempt_no")
    good = (F.coalesce("rotation", F.lit(0)) != 0) & (F.col("average") >= 0.80) & (F.col("composite") >= 0.70)
    before = F.sum(F.when(good, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1))
    tried = attempts.withColumn("_before", F.coalesce(before, F.lit(0))).where("_before = 0 AND (attempt_no = 0 OR block_count > 0)")
    return tried.groupBy(*keys).agg(F.max_by("attempt_no", F.struct("composite", -F.col("attempt_no"))).alias("attempt_no"), F.max("composite").alias("composite"), F.count("*").alias("attempts"))


def merged_passes(primary: DataFrame, secondary: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Two recognitions of a page as one: the better pass, and of the other every sure block that overlaps no block yet taken.

    The blocks of a page are few; they are folded in their order, as blocks that were added can stand in the way too.
    """
    box = F.struct("detection_order", "text", "confidence", "left", "top", "right", "bottom")
    sides = [boxed(x).groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias(n)) for x, n in ((primary, "p"), (secondary, "s"))]
    scores = [page_quality(x, keys).select(*keys, F.col("composite").alias(f"{n}_score")) for x, n in ((primary, "p"), (secondary, "s"))]
    page = sides[0].join(sides[1], list(keys), "full")
    for s in scores:
        page = page.join(s, list(keys), "left")
    none = F.array().cast("array<struct<detection_order:int,text:string,confidence:double,left:double,top:double,right:double,bottom:double>>")
    np, ns = F.coalesce(F.size("p"), F.lit(0)), F.coalesce(F.size("s"), F.lit(0))
    alone = F.when((ns <= 0) | ((ns <= 1) & (np >= 4)), "primary").when((np <= 0) | ((np <= 1) & (ns >= 4)), "secondary")
    first = F.coalesce(F.col("p_score"), F.lit(0.0)) >= F.coalesce(F.col("s_score"), F.lit(0.0))
    page = page.withColumn("_alone", alone).withColumn("_first", F.when(F.col("_alone").isNotNull(), F.col("_alone") == "primary").otherwise(first))
    base, other = F.when(F.col("_first"), F.col("p")).otherwise(F.col("s")), F.when(F.col("_first"), F.col("s")).otherwise(F.col("p"))

    def iou(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]))
        h = F.greatest(F.lit(0.0), F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]))
        size = lambda x: F.greatest(F.lit(1.0), (x["right"] - x["left"]) * (x["bottom"] - x["top"]))
        return w * h / (size(a) + size(b) - w * h)

    page = page.withColumn("_base", F.coalesce(base, none)).withColumn("_other", F.when(F.col("_alone").isNotNull(), none).otherwise(F.coalesce(other, none)))
    taken = F.aggregate("_other", F.col("_base"), lambda kept, b: F.when((b["confidence"] < MERGE_CONFIDENCE) | F.exists(kept, lambda k: iou(b, k) > MERGE_OVERLAP), kept).otherwise(F.concat(kept, F.array(b))))
    page = page.withColumn("_taken", taken)
    label = F.when(F.size("_taken") > F.size("_base"), "merged").when(F.col("_first"), "primary").otherwise("secondary")
    return page.select(*keys, label.alias("label"), F.size("_taken").alias("block_count"), F.aggregate("_taken", F.lit(0).cast("decimal(28,9)"), lambda s, b: (s + F.coalesce(b["confidence"], F.lit(0.0)).cast("decimal(18,9)")).cast("decimal(28,9)")).cast("double").alias("_sum"), F.col("_taken").alias("blocks")).withColumn(
        "average_confidence", F.col("_sum") / F.greatest(F.col("block_count"), F.lit(1))
    ).drop("_sum")


def page_text(page_lines: DataFrame) -> DataFrame:
    """Pages from their lines (``layout.lines``): text, raw_text and normalized_text, where a line without one gives its text."""
    line = F.struct("line_number", "text", F.coalesce(F.nullif("raw_text", F.lit("")), "text").alias("raw_text"), F.coalesce(F.nullif("normalized_text", F.lit("")), "text").alias("normalized_text"))
    page = page_lines.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("_l"))
    joined = lambda c: F.array_join(F.transform("_l", lambda v: F.coalesce(v[c], F.lit(""))), "\n").alias(c)
    return page.select(*PAGE, *map(joined, ("text", "raw_text", "normalized_text")))


def responses(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """One nested record per page: document(type, language, confidence), texts, review, and the map of its fields, which is
    null without any. Pages have page_text's columns, category, language, confidence, needs_review and uncertain_lines."""
    held = fields.groupBy(*PAGE, "field_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda v: v["value"]).alias("values"))
    held = held.groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "values")))).alias("fields"))
    record = F.struct(
        F.struct(F.col("category").alias("type"), "language", "confidence").alias("document"), "text", "raw_text", "normalized_text", "needs_review", "uncertain_lines", "fields",
    )
    return pages.join(held, list(PAGE), "left").select(*PAGE, record.alias("response"))


def document_rollup(pages: DataFrame) -> DataFrame:
    """Documents: pages in order joined by a form feed, page count, review if any page needs it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n\f\n")
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.coalesce(F.bool_or("needs_review"), F.lit(False)).alias("needs_review"), joined.alias("text"))
