"""Reading order and layout of pages: lines, paragraphs, sections, tables, titles.

Everything is local to a page, so one exchange by (doc_id, page_number) serves the whole chain. The clustering of
blocks into lines depends on a running mean and is a fold over the page's blocks in order; the rest are windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import constants as C
from folioscope.functions.text import any_of, direction, language, normalized, occurrences, stripped, words_of
from folioscope.operators.recognition import PAGE, boxed, mean

#: Tolerances and bands.
LINE_TOLERANCE, LEAST_HEIGHT, ENGINE_TOLERANCE, HEADER_HEIGHT, GAP = 0.65, 5.0, 0.5, 1.30, 1.7


def upper_median(heights: Column) -> Column:
    """The middle of sorted values, the upper one of two."""
    ordered = F.array_sort(heights)
    return ordered[F.floor(F.size(ordered) / 2).cast("int")]


def clustered_lines(blocks: DataFrame) -> DataFrame:
    """Adds ``line``, the cluster of each block: a block joins a line while its centre is near the line's running mean.

    Blocks need the columns of ``recognition.boxed`` and a detection_order that is unique on the page.
    """
    entry = F.struct("top", "detection_order", "cy", F.greatest("height", F.lit(LEAST_HEIGHT)).alias("h"), F.struct(*blocks.columns).alias("block"))
    page = blocks.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry), _by("top")).alias("_all"))
    page = page.withColumn("_near", LINE_TOLERANCE * upper_median(F.transform("_all", lambda b: b["h"])))
    start = F.struct(F.lit(1).alias("line"), F.col("_all")[0]["cy"].alias("mean"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, b: Column) -> Column:
        joins = F.abs(b["cy"] - state["mean"]) <= F.col("_near")
        line, total, n = F.when(joins, state["line"]).otherwise(state["line"] + 1), F.when(joins, state["total"] + b["cy"]).otherwise(b["cy"]), F.when(joins, state["n"] + 1).otherwise(1)
        return F.struct(line.alias("line"), (total / n).alias("mean"), total.alias("total"), n.alias("n"), F.concat(state["out"], F.array(line)).alias("out"))

    return _unfolded(page.withColumn("_lines", F.aggregate("_all", start, step, lambda s: s["out"])), blocks.columns)


def _by(first: str) -> Callable[[Column, Column], Column]:
    """Order of blocks by a coordinate, then by detection."""

    def compare(a: Column, b: Column) -> Column:
        less = (a[first] < b[first]) | ((a[first] == b[first]) & (a["detection_order"] < b["detection_order"]))
        return F.when(less, -1).when((a[first] == b[first]) & (a["detection_order"] == b["detection_order"]), 0).otherwise(1)

    return compare


def _unfolded(page: DataFrame, columns: list[str]) -> DataFrame:
    """Blocks of folded pages with their line and place: the blocks ride in the fold's array, so no join follows."""
    each = page.select(*PAGE, F.posexplode(F.arrays_zip(F.col("_all"), F.col("_lines").alias("_lines"))).alias("place", "_e"))
    # the keys stay the grouping's own, so that later windows need no exchange
    return each.select(*(F.col(c) if c in PAGE else F.col("_e._all.block")[c].alias(c) for c in columns), F.col("_e._lines").alias("line"), (F.col("place") + 1).alias("place"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds line_number, reading_order, line_direction and run to boxed blocks: lines from the top, runs of one direction
    inside a line from the side where the line begins."""
    placed = clustered_lines(blocks)
    arabic, latin = occurrences(F.col("text"), C.ARABIC_BLOCK), occurrences(F.col("text"), C.LATIN)
    placed = placed.withColumns({"_ar": arabic, "_la": latin}).withColumn("block_direction", F.when(F.col("_ar") > F.col("_la"), "rtl").otherwise("ltr"))
    line = W.partitionBy(*PAGE, "line")
    placed = placed.withColumns({"_mean": F.avg("cy").over(line), "_ars": F.sum("_ar").over(line), "_las": F.sum("_la").over(line), "_last": F.max_by("_ar", F.struct("cx", -F.col("place"))).over(line)})
    tie = F.when((F.col("_ars") > 0) & (F.col("_last") > 0), "rtl").otherwise("ltr")
    placed = placed.withColumn("line_direction", F.when(F.col("_ars") > F.col("_las"), "rtl").when(F.col("_las") > F.col("_ars"), "ltr").otherwise(tie))
    across = line.orderBy("left", "place")
    placed = placed.withColumn("_turn", F.when(F.lag("block_direction").over(across) == F.col("block_direction"), 0).otherwise(1))
    placed = placed.withColumn("run", F.sum("_turn").over(across))
    placed = placed.withColumn("_run_mean", F.avg("cx").over(W.partitionBy(*PAGE, "line", "run")))
    side = F.when(F.col("line_direction") == "rtl", -F.col("_run_mean")).otherwise(F.col("_run_mean"))
    inside = F.when(F.col("block_direction") == "rtl", -F.col("cx")).otherwise(F.col("cx"))
    page = W.partitionBy(*PAGE)
    placed = placed.withColumn("line_number", F.dense_rank().over(page.orderBy("_mean", "line")))
    placed = placed.withColumn("reading_order", F.row_number().over(page.orderBy("line_number", side, "run", inside, "left", "place")))
    return placed.drop("_ar", "_la", "_mean", "_ars", "_las", "_last", "_turn", "_run_mean", "place", "line")


def engine_order(blocks: DataFrame) -> DataFrame:
    """The recognizer's own order: blocks join a line while near its first block, each line from the right."""
    centre = lambda axis: F.aggregate("points", F.lit(0.0), lambda s, p: s + p[axis]) / 4
    base = blocks.withColumns({"_y": centre("y"), "_x": centre("x")})
    entry = F.struct("_y", "detection_order", "height", F.struct(*base.columns).alias("block"))
    page = base.groupBy(*PAGE).agg(F.array_sort(F.collect_list(entry), _by("_y")).alias("_all"))
    start = F.struct(F.lit(1).alias("line"), F.col("_all")[0]["_y"].alias("first"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, b: Column) -> Column:
        joins = (F.abs(b["_y"] - state["first"]) < b["height"] * ENGINE_TOLERANCE) | (F.size(state["out"]) == 0)
        line, first = F.when(joins, state["line"]).otherwise(state["line"] + 1), F.when(joins, state["first"]).otherwise(b["_y"])
        return F.struct(line.alias("line"), first.alias("first"), F.concat(state["out"], F.array(line)).alias("out"))

    joined = _unfolded(page.withColumn("_lines", F.aggregate("_all", start, step, lambda s: s["out"])), base.columns)
    order = W.partitionBy(*PAGE).orderBy("line", F.col("_x").desc(), "place")
    return joined.withColumn("line_number", F.col("line")).withColumn("reading_order", F.row_number().over(order)).drop("_x", "_y", "line", "place")


def _joined(column: str, separator: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(column, F.lit("")).alias("t")))), lambda x: x["t"]), separator)


def lines(ordered: DataFrame, local: bool = False) -> DataFrame:
    """Lines of blocks in reading order: text, box, mean confidence, language, direction.

    ``local`` says that pages already lie whole in partitions, as after ``reading_order``; else they are brought there by
    one exchange, which serves everything that follows.
    """
    ordered = ordered if local else ordered.repartition(*PAGE)
    raw = F.when(F.coalesce(F.col("raw_text"), F.lit("")) == "", F.col("text")).otherwise(F.col("raw_text"))
    out = ordered.withColumn("_raw", raw).groupBy(*PAGE, "line_number").agg(
        _joined("text", " ", "reading_order").alias("text"), _joined("_raw", " ", "reading_order").alias("raw_text"), mean("confidence").alias("confidence"),
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count("*").alias("blocks"),
    )
    text = F.col("text")
    return out.withColumns({"normalized_text": normalized(text), "language": language(text)["lang"], "direction": direction(text), "height": F.col("bottom") - F.col("top")})


def _header(text: Column, height: Column, median: Column) -> Column:
    low = F.lower(stripped(text))
    n = F.size(words_of(text))
    starts = F.lit(False)
    for word in C.SECTION_WORDS:
        starts = starts | low.startswith(word)
    return ((height > median * HEADER_HEIGHT) & (n <= 8)) | (starts & (n > 0) & (n <= 10))


def paragraphs_of_lines(page_lines: DataFrame) -> DataFrame:
    """Adds is_header and block_id to lines: a paragraph ends at headers and at wide gaps."""
    base = page_lines.withColumn("_median", F.median("height").over(W.partitionBy(*PAGE)))
    base = base.withColumn("is_header", _header(F.col("text"), F.col("height"), F.col("_median")))
    order = W.partitionBy(*PAGE).orderBy("line_number")
    gap = F.greatest(F.lit(0.0), F.col("top") - F.lag("bottom").over(order))
    new = F.lag("line_number").over(order).isNull() | F.col("is_header") | F.lag("is_header").over(order) | (gap > F.col("_median") * GAP)
    return base.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("block_id", F.sum("_new").over(order)).drop("_new", "_median")


def paragraphs(page_lines: DataFrame) -> DataFrame:
    """Paragraphs of lines with their type (header or paragraph)."""
    base = paragraphs_of_lines(page_lines)
    out = base.groupBy(*PAGE, "block_id").agg(
        _joined("text", "\n", "line_number").alias("text"), mean("confidence").alias("confidence"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"),
        F.max("bottom").alias("bottom"), F.count("*").alias("lines"), F.min_by("is_header", "line_number").alias("_first"),
    )
    return out.withColumns({"type": F.when(F.col("_first"), "header").otherwise("paragraph"), "language": language(F.col("text"))["lang"], "direction": direction(F.col("text"))}).drop("_first")


def sections(page_lines: DataFrame, titles: DataFrame) -> DataFrame:
    """Sections: a header paragraph and the paragraphs up to the next; the page's title begins none."""
    base = paragraphs_of_lines(page_lines)
    order = W.partitionBy(*PAGE).orderBy("line_number")
    head = F.col("is_header") & (F.coalesce(F.lag("block_id").over(order), F.lit(0)) != F.col("block_id"))
    base = base.withColumn("_head", head).withColumn("section_id", F.sum(F.when(F.col("_head"), 1).otherwise(0)).over(order)).where("section_id > 0")
    title = F.max(F.when(F.col("_head"), stripped(F.col("text"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("line_number", "text")))), lambda x: x["text"]), "\n")
    out = base.groupBy(*PAGE, "section_id").agg(title.alias("title"), body.alias("content"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    joined = out.join(titles.select(*PAGE, F.col("title").alias("_title")), list(PAGE), "left")
    return joined.where(F.col("_title").isNull() | (F.col("title") != F.col("_title"))).withColumn("content", stripped(F.col("content"))).drop("_title")


def page_info(page_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """title, header, footer and has_signatures of every page with lines; pages need width and height (1000 where null)."""
    size = pages.groupBy(*PAGE).agg(F.coalesce(F.max("height"), F.lit(1000)).cast("double").alias("_h"))
    base = page_lines.join(size, list(PAGE), "left").withColumn("_h", F.coalesce("_h", F.lit(1000.0)))
    text, low, height = F.col("text"), F.lower("text"), F.col("_h")
    in_top = F.col("top") <= F.greatest(height * 0.30, F.lit(200.0))
    in_head = F.col("bottom") <= F.greatest(height * 0.08, F.lit(60.0))
    in_foot = (F.col("top") >= F.least(height * 0.90, height - 60)) | low.contains("page") | text.contains("صفحة")
    best = F.max_by(text, F.when(in_top, F.struct(F.col("height"), -F.length(text), -F.col("line_number"))))
    out = base.groupBy(*PAGE).agg(
        F.when(F.bool_or(in_top), best).alias("_title"), F.min_by(text, F.when(in_head, F.col("line_number"))).alias("_head"), F.max_by(text, F.when(in_foot, F.col("line_number"))).alias("_foot"),
        F.bool_or(in_head).alias("_heads"), F.bool_or(in_foot).alias("_feet"), F.coalesce(F.bool_or(any_of(low, C.SIGNATURE_WORDS)), F.lit(False)).alias("has_signatures"),
    )
    kept = F.col("_title").isNotNull() & (F.size(words_of(F.col("_title"))) <= 10) & ~any_of(F.lower("_title"), C.TITLE_STOPS)
    title = F.when(kept, stripped(F.col("_title")))
    header = F.when(F.col("_heads"), stripped(F.col("_head")))
    return out.select(*PAGE, title.alias("title"), F.when(title.isNull() | (header != title), header).alias("header"), F.when(F.col("_feet"), stripped(F.col("_foot"))).alias("footer"), "has_signatures")


def columns(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """1 or 2 columns of every page with blocks."""
    size = pages.groupBy(*PAGE).agg(F.coalesce(F.max("width"), F.lit(1000)).cast("double").alias("_w"))
    base = boxes.join(size, list(PAGE), "left").withColumn("_w", F.coalesce("_w", F.lit(1000.0)))
    left, right = F.count_if(F.col("right") <= F.col("_w") * 0.48), F.count_if(F.col("left") >= F.col("_w") * 0.52)
    return base.groupBy(*PAGE).agg(F.when((F.count("*") >= 4) & (left >= 2) & (right >= 2), 2).otherwise(1).alias("columns"))


def table_parts(text: Column) -> Column:
    """Cells of a line: what stands between double blanks; null unless three, or two with a digit in the line."""
    parts = F.filter(F.transform(F.split(text, "  "), stripped), lambda x: x != "")
    return F.when((F.size(parts) >= 3) | ((F.size(parts) == 2) & text.rlike(r"\p{Nd}")), parts)


def tables(page_lines: DataFrame) -> DataFrame:
    """Cells of the one table of every page with two table rows or more: row, col, text, rows, cols, language, direction."""
    rows = page_lines.select(*PAGE, "line_number", table_parts(F.col("text")).alias("parts")).where("parts IS NOT NULL")
    page = W.partitionBy(*PAGE)
    rows = rows.withColumns({"row": F.row_number().over(page.orderBy("line_number")) - 1, "rows": F.count("*").over(page), "cols": F.max(F.size("parts")).over(page)}).where("rows >= 2")
    cells = rows.select(*PAGE, "rows", "cols", "row", F.posexplode("parts").alias("col", "text"))
    return cells.withColumns({"language": language(F.col("text"))["lang"], "direction": direction(F.col("text"))})
