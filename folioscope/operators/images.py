"""Image kernels: quality, skew, rotation, scaling and contrast of decoded pages, in numpy over Arrow batches.

Images come as the struct of Spark's image source (height, width, nChannels, data in BGR order). Thresholds and decisions
stay Catalyst expressions over the measured values; only pixels are touched in Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of quality and preprocessing.
BLUR, DARK, BRIGHT, CONTRAST, LEAST_SIDE, SKEW_WARN, SKEW_FIX = 80.0, 40.0, 230.0, 25.0, 300, 1.0, 0.6
MAX_SIDE, SMALL, OPTIMAL, SHADOW, TEXT_CONTRAST, FADED, DULL = 3200, 900, 750, 45.0, 100.0, 45.0, 55.0

MEASURES = "STRUCT<blur DOUBLE, brightness DOUBLE, contrast DOUBLE, skew DOUBLE, shadow DOUBLE, text_contrast DOUBLE, flat BOOLEAN>"


def as_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """Pixels, or None for an image that could not be decoded."""
    if height is None or height <= 0 or width <= 0 or not data:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels) if channels > 1 else np.frombuffer(data, np.uint8).reshape(height, width)
    return on_white(pixels) if channels == 4 else pixels


def on_white(pixels: np.ndarray) -> np.ndarray:
    """Colours of pixels with transparency as they look on white paper."""
    share = pixels[..., 3:].astype(np.float64) / 255
    return np.rint(pixels[..., :3] * share + 255 * (1 - share)).astype(np.uint8)


def gray(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def laplacian_variance(image: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, edges mirrored."""
    p = np.pad(image.astype(np.float64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.float64), 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def otsu(image: np.ndarray) -> int:
    """The threshold that parts dark and light best."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def skew_angle(image: np.ndarray, limit: float = 15.0) -> float:
    """Corrective rotation in degrees: the shear at which the profile of rows is sharpest; under half a degree 0."""
    g = gray(image)
    if g.size == 0 or int(g.max()) == int(g.min()):
        return 0.0
    ink = g <= otsu(g)
    step = max(1, max(g.shape) // 800)
    y, x = np.nonzero(ink[::step, ::step])
    if len(y) < 20:
        return 0.0
    y, x = y.astype(float), x - x.mean()

    def sharpness(angle: float) -> tuple[float, float]:
        rows = np.rint(y - x * np.tan(np.radians(angle))).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum()), -abs(angle)  # the least of equal angles

    best = max(np.arange(-limit, limit + 0.01, 0.5), key=sharpness)
    best = max(np.arange(best - 0.5, best + 0.51, 0.1), key=sharpness)
    return 0.0 if abs(best) < 0.5 else round(float(best), 2)


def rotated(image: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a right angle; other angles leave the image as it is."""
    return np.ascontiguousarray(np.rot90(image, {90: -1, 180: 2, 270: 1}.get(degrees, 0)))


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize."""
    h, w = image.shape[:2]
    ys, xs = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    y0, x0 = np.clip(np.floor(ys).astype(int), 0, h - 1), np.clip(np.floor(xs).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[:, None], np.clip(xs - x0, 0, 1)[None, :]
    if image.ndim == 3:
        fy, fx = fy[..., None], fx[..., None]
    a = image.astype(np.float64)
    out = (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def deskewed(image: np.ndarray, angle: float) -> np.ndarray:
    """Turned by the corrective angle on a canvas that holds all of it, white around; under half a degree unchanged."""
    if abs(angle) < 0.5:
        return image
    h, w = image.shape[:2]
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    width, height = int(np.ceil(abs(w * c) + abs(h * s))), int(np.ceil(abs(w * s) + abs(h * c)))
    y, x = np.mgrid[0:height, 0:width].astype(float)
    dx, dy = x - width / 2, y - height / 2
    sx, sy = np.rint(c * dx - s * dy + w / 2).astype(int), np.rint(s * dx + c * dy + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((height, width, *image.shape[2:]), 255, np.uint8)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def measure(image: np.ndarray) -> dict:
    g = gray(image)
    h, w = max(g.shape[0] // 2, 1), max(g.shape[1] // 2, 1)
    corners = [q.mean() for q in (g[:h, :w], g[:h, w:], g[h:, :w], g[h:, w:]) if q.size]
    cut = otsu(g)
    dark, light = g[g <= cut], g[g > cut]
    return {
        "blur": laplacian_variance(g), "brightness": float(g.mean()), "contrast": float(g.std()), "skew": skew_angle(g), "shadow": float(max(corners) - min(corners)),
        "text_contrast": float(np.median(light) - np.median(dark)) if dark.size and light.size else 0.0, "flat": bool(g.max() == g.min()),
    }


def measured(images: DataFrame, image: str = "image") -> DataFrame:
    """Adds ``measures`` of each image; null for one that could not be decoded."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        rows = [measure(a) if (a := as_array(*r)) is not None else dict.fromkeys(("blur", "brightness", "contrast", "skew", "shadow", "text_contrast", "flat")) for r in parts[["height", "width", "nChannels", "data"]].itertuples(index=False)]
        return pd.DataFrame(rows)

    run.__annotations__ = {"parts": pd.DataFrame, "return": pd.DataFrame}
    return images.withColumn("measures", F.pandas_udf(run, MEASURES)(F.struct(f"{image}.height", f"{image}.width", f"{image}.nChannels", f"{image}.data")))


def quality(images: DataFrame, image: str = "image") -> DataFrame:
    """Adds ``quality``: measures, flags and warnings; an image that could not be read is blurry and of no resolution."""
    m, h, w = F.col("measures"), F.col(f"{image}.height"), F.col(f"{image}.width")
    empty = m["brightness"].isNull()
    warnings = F.array_compact(F.array(
        F.when(empty, "There are no pixels to read."), F.when(m["blur"] < BLUR, F.format_string("Edges are soft (variance %.1f): letters may be misread.", m["blur"])),
        F.when(m["brightness"] < DARK, F.format_string("Dark on the whole (mean %.1f of 255).", m["brightness"])), F.when(m["brightness"] > BRIGHT, F.format_string("Bright on the whole (mean %.1f of 255).", m["brightness"])),
        F.when(m["contrast"] < CONTRAST, F.format_string("Letters stand out little from the paper (contrast %.1f).", m["contrast"])), F.when(~empty & (F.least(w, h) < LEAST_SIDE), F.format_string("Small image (%d by %d): 300 pixels a side are needed.", w, h)),
        F.when(F.abs(m["skew"]) >= SKEW_WARN, F.format_string("Lines are tilted (%+.1f°).", m["skew"])),
    ))
    out = F.struct(
        F.coalesce(w, F.lit(0)).alias("width"), F.coalesce(h, F.lit(0)).alias("height"), F.coalesce(m["blur"] < BLUR, F.lit(True)).alias("is_blurry"), F.round(m["blur"], 2).alias("blur_score"), F.round(m["brightness"], 2).alias("brightness"),
        F.round(m["contrast"], 2).alias("contrast"), F.coalesce(~empty & (F.least(w, h) >= LEAST_SIDE), F.lit(False)).alias("resolution_ok"), F.coalesce(m["skew"], F.lit(0.0)).alias("skew_angle"), warnings.alias("warnings"),
    )
    return measured(images, image).withColumn("quality", out)


def plan(width: Column, height: Column, measures: Column) -> Column:
    """What preprocessing would do: struct(deskew, scale, flatten, clahe, corrected)."""
    longest, shortest = F.greatest(width, height), F.greatest(F.least(width, height), F.lit(1))
    scale = F.when(longest > MAX_SIDE, MAX_SIDE / longest).when(longest < SMALL, F.greatest(F.lit(1.0), F.least(F.lit(2.0), OPTIMAL / shortest))).otherwise(1.0)
    keep = (measures["text_contrast"] >= TEXT_CONTRAST) | measures["flat"]
    clahe = F.when(~keep & (measures["contrast"] < FADED), 2.0).when(~keep & (measures["contrast"] < DULL), 1.2)
    tilted = F.abs(measures["skew"]) >= SKEW_FIX
    return F.struct(tilted.alias("deskew"), scale.alias("scale"), (measures["shadow"] > SHADOW).alias("flatten"), clahe.alias("clahe"), tilted.alias("corrected"))


#: Share of an image that a page on a dark ground covers at least, and its least side in pixels.
QUAD_SHARE, QUAD_SIDE = 0.35, 150
#: Tiles of local contrast along each side.
TILES = 8


def page_corners(image: np.ndarray) -> np.ndarray | None:
    """Corners of a bright page on a dark ground, from the upper left clockwise, or None where the page fills the image, is
    too small, or is no convex quadrangle."""
    g = gray(image)
    bright = g > otsu(g)
    y, x = np.nonzero(bright)
    if not len(y) or bright[[0, 0, -1, -1], [0, -1, 0, -1]].any():
        return None
    at = [(x + y).argmin(), (x - y).argmax(), (x + y).argmax(), (x - y).argmin()]
    corners = np.stack([x[at], y[at]], 1).astype(float)
    sides = np.roll(corners, -1, 0) - corners
    turns = sides[:, 0] * np.roll(sides, -1, 0)[:, 1] - sides[:, 1] * np.roll(sides, -1, 0)[:, 0]
    area = abs(np.sum(corners[:, 0] * np.roll(corners[:, 1], -1) - np.roll(corners[:, 0], -1) * corners[:, 1])) / 2
    good = (turns > 0).all() and area >= QUAD_SHARE * g.size and np.hypot(*sides.T).min() >= QUAD_SIDE
    return corners if good else None


def straightened(image: np.ndarray) -> np.ndarray:
    """The page of ``page_corners`` seen from above; the image itself where there is none."""
    corners = page_corners(image)
    if corners is None:
        return image
    sides = np.hypot(*(np.roll(corners, -1, 0) - corners).T)
    width, height = int(max(sides[0], sides[2])), int(max(sides[1], sides[3]))
    flat = np.array([[0, 0], [width - 1, 0], [width - 1, height - 1], [0, height - 1]], float)
    rows, right = [], []
    for (u, v), (x, y) in zip(flat, corners):  # from flat places back to the image's
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    a, b, c, d, e, f, p, q = np.linalg.solve(np.array(rows), np.array(right))
    v, u = np.mgrid[0:height, 0:width]
    w = p * u + q * v + 1
    x, y = np.clip(np.rint((a * u + b * v + c) / w), 0, image.shape[1] - 1).astype(int), np.clip(np.rint((d * u + e * v + f) / w), 0, image.shape[0] - 1).astype(int)
    return image[y, x]


def equalized(image: np.ndarray, limit: float) -> np.ndarray:
    """Contrast evened out in tiles: each tile's counts are cut at ``limit`` times their mean, what is cut is spread, and a pixel
    takes a mean of the four tiles around it."""
    h, w = image.shape
    edges = [np.linspace(0, n, TILES + 1).astype(int) for n in (h, w)]
    maps = np.empty((TILES, TILES, 256))
    for i in range(TILES):
        for j in range(TILES):
            tile = image[edges[0][i] : edges[0][i + 1], edges[1][j] : edges[1][j + 1]]
            counts = np.bincount(tile.ravel(), minlength=256).astype(float)
            most = max(1.0, limit * tile.size / 256)
            over = np.maximum(counts - most, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(counts, most) + over / 256) * 255 / max(tile.size, 1)
    place = [np.clip((np.arange(n) + 0.5) * TILES / n - 0.5, 0, TILES - 1) for n in (h, w)]
    low = [np.minimum(p.astype(int), TILES - 2) for p in place]
    fy, fx = (place[0] - low[0])[:, None], (place[1] - low[1])[None, :]
    at = lambda i, j: maps[(low[0] + i)[:, None], (low[1] + j)[None, :], image]
    mixed = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.clip(np.rint(mixed), 0, 255).astype(np.uint8)


def preprocessed(image: np.ndarray) -> np.ndarray:
    """Straightened, deskewed, scaled and flattened gray pixels with even contrast, by the decisions of ``plan``."""
    image = straightened(image)
    m = measure(image)
    out = deskewed(gray(image), m["skew"]) if abs(m["skew"]) >= SKEW_FIX else gray(image)
    h, w = out.shape
    longest = max(h, w)
    scale = MAX_SIDE / longest if longest > MAX_SIDE else max(1.0, min(2.0, OPTIMAL / max(min(h, w), 1))) if longest < SMALL else 1.0
    if scale != 1.0:
        out = resized(out, int(w * scale), int(h * scale))
    if m["shadow"] > SHADOW:
        back = resized(resized(out, max(1, out.shape[1] // 50), max(1, out.shape[0] // 50)), out.shape[1], out.shape[0])
        out = np.clip(out / (back + 1e-5) * 255, 0, 255).astype(np.uint8)
    if m["text_contrast"] < TEXT_CONTRAST and not m["flat"] and m["contrast"] < DULL:
        out = equalized(out, 2.0 if m["contrast"] < FADED else 1.2)
    return out


def recognised(images: DataFrame, engine: Callable[[np.ndarray], list[tuple]], key: str = "doc_id", image: str = "image") -> DataFrame:
    """Detections of a recognizer: ``engine`` takes pixels and gives (points, text, confidence) rows; malformed ones are dropped."""
    schema = f"{key} BIGINT, detection_order INT, points ARRAY<STRUCT<x DOUBLE, y DOUBLE>>, text STRING, confidence DOUBLE"

    def run(batches):
        for batch in batches:
            rows = []
            for k, r in zip(batch[key], batch[image]):
                pixels = as_array(r["height"], r["width"], r["nChannels"], r["data"])
                for i, row in enumerate(engine(pixels) if pixels is not None else [], 1):
                    try:
                        points, text, confidence = row
                        rows.append((k, i, [{"x": float(x), "y": float(y)} for x, y in points], str(text), float(confidence)))
                    except (TypeError, ValueError):
                        continue
            yield pd.DataFrame(rows, columns=[key, "detection_order", "points", "text", "confidence"])

    return images.select(key, image).mapInPandas(run, schema)
