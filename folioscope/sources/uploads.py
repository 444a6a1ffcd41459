"""Uploads: bounded reading, content checks, page guards; sinks for reports."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.text import stripped

# Limits of uploads and pages, and media types.
UPLOAD_MB, DOCUMENT_PAGES, SIDE, PIXELS, DOCUMENT_PIXELS, PDF_PAGE_PIXELS, DPI, CANVAS = 10, 20, 10_000, 50_000_000, 100_000_000, 12_000_000, 200, 3200
ALLOWED = ["image/jpeg", "image/jpg", "image/png", "image/webp", "image/tiff", "image/bmp"]
ALIASES = {"image/jpg": "image/jpeg", "image/x-ms-bmp": "image/bmp"}
SIGNATURES = [("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"), ("424D", "image/bmp")]


@dataclass(frozen=True)
class Limits:
    """Bounds of uploads; ``of`` reads those that the session sets as ``folioscope.limit.<name>``, and refuses other than positive ones."""

    upload_mb: int = UPLOAD_MB
    document_pages: int = DOCUMENT_PAGES
    pixels: int = PIXELS
    document_pixels: int = DOCUMENT_PIXELS

    @classmethod
    def of(cls, spark: SparkSession) -> Limits:
        found = {f.name: int(spark.conf.get(f"folioscope.limit.{f.name}", str(f.default))) for f in fields(cls)}
        if bad := [n for n, v in found.items() if v <= 0]:
            raise ValueError(f"limits must be positive: {', '.join(bad)}")
        return cls(**found)


def tiff_frames(content: bytes | None) -> list[tuple[int, int]]:
    """(width, height) of every frame of a TIFF file, from its directories alone; a directory that lies beyond the bytes, or is
    met twice, ends the list, and other files have no frames."""
    if not content or content[:4] not in (b"II*\0", b"MM\0*"):
        return []
    order = "<" if content[:2] == b"II" else ">"
    out, seen, at = [], set(), struct.unpack_from(f"{order}I", content, 4)[0] if len(content) >= 8 else 0
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        (n,) = struct.unpack_from(f"{order}H", content, at)
        if at + 2 + 12 * n + 4 > len(content):
            break
        size = {}
        for k in range(n):
            tag, kind, _, value = struct.unpack_from(f"{order}HHI4s", content, at + 2 + 12 * k)
            if tag in (256, 257):
                size[tag] = struct.unpack(f"{order}H", value[:2])[0] if kind == 3 else struct.unpack(f"{order}I", value)[0]
        out.append((size.get(256, 0), size.get(257, 0)))
        (at,) = struct.unpack_from(f"{order}I", content, at + 2 + 12 * n)
    return out


def document_frames(uploads: DataFrame) -> DataFrame:
    """(doc_id, page_number, width, height) of the frames of TIFF uploads (doc_id, content), a page each; the pixels are not decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, i, w, h) for d, c in zip(batch["doc_id"], batch["content"]) for i, (w, h) in enumerate(tiff_frames(c), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "width", "height"])

    return uploads.select("doc_id", "content").mapInPandas(run, "doc_id BIGINT, page_number INT, width INT, height INT")


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under the size limit as (path, size_bytes, content); larger ones are never read, as the length is pushed down."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.where((F.col("length") > 0) & (F.col("length") <= UPLOAD_MB * 1024 * 1024)).select("path", F.col("length").alias("size_bytes"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that cannot be decoded have a height of -1."""
    return spark.read.format("image").load(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines manifest of labelled texts and fields."""
    schema = "id STRING, expected_text STRING, actual_text STRING, expected_fields MAP<STRING,STRING>, actual_fields MAP<STRING,STRING>"
    return spark.read.schema(schema).json(path)


def write_report(frame: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept, other letters than ASCII as they are."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sniffed(content: Column) -> Column:
    """Media type by the first bytes; null for less than four bytes and for unknown ones."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(F.coalesce(F.octet_length(content), F.lit(0)) < 4, F.lit(None).cast("string"))
    for signature, mime in SIGNATURES:
        out = out.when(head.startswith(signature), mime)
    return out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")


def canonical_type(declared: Column) -> Column:
    out = declared
    for alias, mime in ALIASES.items():
        out = F.when(declared == alias, mime).otherwise(out)
    return out


def content_check(uploads: DataFrame, pdf: bool = True) -> DataFrame:
    """Adds mime and error_code (null if good): the bytes must be of an allowed type and of the declared one."""
    found = F.when(F.hex(F.substring("content", 1, 5)) == "255044462D", "application/pdf").otherwise(sniffed(F.col("content")))
    declared = canonical_type(F.lower(stripped(F.coalesce("declared_type", F.lit("")))))
    allowed = found.isin([*ALLOWED, *(["application/pdf"] if pdf else [])])
    code = (
        F.when(F.coalesce("size_bytes", F.lit(0)) <= 0, "INVALID_IMAGE").when(F.col("size_bytes") > UPLOAD_MB * 1024 * 1024, "PAYLOAD_TOO_LARGE")
        .when(~F.coalesce(allowed, F.lit(False)), "UNSUPPORTED_MEDIA_TYPE").when(~declared.isin("", "application/octet-stream") & (declared != found), "UNSUPPORTED_MEDIA_TYPE")
    )
    return uploads.withColumns({"mime": found, "error_code": code})


def metadata_check(uploads: DataFrame) -> DataFrame:
    """Adds error_code of the older check: file name, declared type in the list, signature, size."""
    found, declared = sniffed(F.col("content")), F.coalesce("declared_type", F.lit(""))
    code = (
        F.when(stripped(F.coalesce("filename", F.lit(""))) == "", "VALIDATION_ERROR").when((declared != "") & ~declared.isin([*ALLOWED, "application/octet-stream"]), "UNSUPPORTED_MEDIA_TYPE")
        .when(~F.coalesce(found.isin(ALLOWED), F.lit(False)), "UNSUPPORTED_MEDIA_TYPE").when(~declared.isin("", "application/octet-stream") & (declared != found), "UNSUPPORTED_MEDIA_TYPE")
        .when(F.col("size_bytes") > UPLOAD_MB * 1024 * 1024, "PAYLOAD_TOO_LARGE")
    )
    return uploads.withColumn("error_code", code)


def dimensions_good(width: Column, height: Column) -> Column:
    return F.coalesce((width >= 1) & (height >= 1) & (F.greatest(width, height) <= SIDE) & (width.cast("bigint") * height <= PIXELS), F.lit(False))


def page_count_check(count: Column) -> Column:
    return F.when(F.coalesce(count, F.lit(0)) < 1, "INVALID_IMAGE").when(count > DOCUMENT_PAGES, "PAYLOAD_TOO_LARGE")


def pages_within_pixels(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number, width, height) whose document's running sum of pixels stays in the limit."""
    pixels = F.sum(F.col("width").cast("bigint") * F.col("height")).over(W.partitionBy("doc_id").orderBy("page_number"))
    return pages.withColumn("running_pixels", pixels).where(F.col("running_pixels") <= DOCUMENT_PIXELS)


def pdf_scale(width: Column, height: Column) -> Column:
    """Scale at which a PDF page of these points is drawn; null where its size is none."""
    good = (width > 0) & (height > 0)
    return F.when(good, F.least(F.lit(DPI / 72), CANVAS / F.greatest(width, height), F.sqrt(PDF_PAGE_PIXELS / (width * height))))
