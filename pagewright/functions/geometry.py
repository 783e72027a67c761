"""Boxes: overlap, greedy matching, reading order, rescaling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least overlap of a match, least area of a region, height of a line band in pixels.
IOU_THRESHOLD, MIN_AREA, BAND = 0.5, 64 * 64, 50
#: Least score that a detector's region needs.
SCORE_THRESHOLD = 0.5


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (l, t, r, b); 0 where they don't overlap or have no area."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)
    inter = side(F.greatest(a["l"], b["l"]), F.least(a["r"], b["r"])) * side(F.greatest(a["t"], b["t"]), F.least(a["b"], b["b"]))
    area = lambda x: side(x["l"], x["r"]) * side(x["t"], x["b"])
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def scored_pairs(pred: Column, base: Column) -> Column:
    """All pairs of two arrays of boxes as (iou, pred index, base index), best first; equal overlaps by larger index."""
    indexed = lambda x: F.transform(x, lambda v, i: F.struct(i.alias("at"), v.alias("box")))
    crossed = F.flatten(
        F.transform(indexed(pred), lambda p: F.transform(indexed(base), lambda q: F.struct(iou(p["box"], q["box"]).alias("iou"), p["at"].alias("p"), q["at"].alias("q"))))
    )
    return F.reverse(F.array_sort(crossed))


def greedy(pairs: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """From best-first pairs those of threshold or more whose two boxes aren't taken yet."""
    taken = lambda done, x: F.exists(done, lambda y: (y["p"] == x["p"]) | (y["q"] == x["q"]))
    start = F.filter(pairs, lambda x: F.lit(False))
    return F.aggregate(F.filter(pairs, lambda x: x["iou"] >= threshold), start, lambda done, x: F.when(taken(done, x), done).otherwise(F.concat(done, F.array(x))))


def greedy_matches(pred: Column, base: Column, threshold: float = IOU_THRESHOLD) -> Column:
    """Matches (iou, p, q) between two arrays of boxes."""
    return greedy(scored_pairs(pred, base), threshold)


def large_enough(regions: Column, min_area: float = MIN_AREA) -> Column:
    """Regions with positive sides and at least min_area."""
    w, h = (lambda r: r["bbox"]["r"] - r["bbox"]["l"]), (lambda r: r["bbox"]["b"] - r["bbox"]["t"])
    return F.filter(regions, lambda r: (w(r) > 0) & (h(r) > 0) & (w(r) * h(r) >= min_area))


def certain(regions: Column, least: float = SCORE_THRESHOLD) -> Column:
    """Regions that score at least so much."""
    return F.filter(regions, lambda r: r["score"] >= least)


def in_reading_order(regions: Column) -> Column:
    """By given order, then top and left, if all regions have one; else by bands of BAND pixels (tops rounded half to even), then left. Equal places keep their sequence."""
    given = F.forall(regions, lambda r: r["reading_order"].isNotNull())
    box = lambda r: r["bbox"]
    first = lambda r: F.when(given, r["reading_order"].cast("double")).otherwise(F.bround(box(r)["t"] / BAND) * BAND)
    second = lambda r: F.when(given, box(r)["t"]).otherwise(box(r)["l"])
    keyed = F.transform(regions, lambda r, i: F.struct(first(r).alias("a"), second(r).alias("b"), F.when(given, box(r)["l"]).otherwise(0.0).alias("c"), i.alias("i"), r.alias("r")))
    at = F.array_sort(F.transform(keyed, lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"), k["c"].alias("c"), k["i"].alias("i"))))
    return F.transform(at, lambda k: F.element_at(regions, k["i"] + 1))


def smart_resize(height: Column, width: Column, factor: int = 28, min_pixels: int = 3136, max_pixels: int = 11289600) -> Column:
    """(h, w) as multiples of factor: rounded half to even, shrunk by flooring above max_pixels and grown by ceiling below min_pixels."""
    h, w = height.cast("double"), width.cast("double")
    near = lambda x: F.greatest(F.lit(float(factor)), F.bround(x / factor) * factor)
    area = near(h) * near(w)
    shrink, grow = F.sqrt(h * w / max_pixels), F.sqrt(F.try_divide(F.lit(float(min_pixels)), h * w))
    floor = lambda x: F.floor(F.try_divide(x, shrink) / factor) * factor
    ceil = lambda x: F.ceil(x * grow / factor) * factor
    pick = lambda x: F.when(area > max_pixels, floor(x)).when(area < min_pixels, ceil(x)).otherwise(near(x)).cast("bigint")
    return F.struct(pick(h).alias("h"), pick(w).alias("w"))


def rescaled(box: Column, page_height: Column, page_width: Column, **limits) -> Column:
    """A box from the resized page back to the page's own pixels; unchanged for pages without size or of the same size."""
    to = smart_resize(page_height, page_width, **limits)
    sx, sy = F.try_divide(page_width, to["w"]), F.try_divide(page_height, to["h"])
    skip = (F.coalesce(page_height, F.lit(0)) <= 0) | (F.coalesce(page_width, F.lit(0)) <= 0) | (to["h"] <= 0) | (to["w"] <= 0) | ((F.abs(sx - 1) < 1e-6) & (F.abs(sy - 1) < 1e-6))
    moved = F.struct((box["l"] * sx).alias("l"), (box["t"] * sy).alias("t"), (box["r"] * sx).alias("r"), (box["b"] * sy).alias("b"))
    return F.when(skip, box).otherwise(moved)


def to_pixels(box: Column, sx: Column, sy: Column) -> Column:
    """A box on an image that is sx, sy times its space, in whole pixels, halves to even."""
    return F.struct(*[F.bround(box[k] * s).cast("bigint").alias(k) for k, s in (("l", sx), ("t", sy), ("r", sx), ("b", sy))])


def py_iou(a: tuple, b: tuple) -> float:
    """The same in plain Python, for tests and small data."""
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    areas = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)]
    union = math.fsum([*areas, -w * h])
    return w * h / union if w * h > 0 and union > 0 else 0.0
