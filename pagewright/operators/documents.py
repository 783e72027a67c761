"""Documents as nested rows: from markdown or layout JSON, their counts, statistics and regions."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import geometry, markup
from pagewright.functions.pieces import by_pieces

# Labels of text items by kind of block, and labels that count as headings.
TEXT_LABELS = {"text": "text", "paragraph": "paragraph", "list_item": "list_item", "caption": "caption", "footnote": "footnote", "page_header": "page_header", "page_footer": "page_footer", "formula": "formula", "code": "code", "furniture": "page_header", "reference": "reference"}
HEADING_KINDS = ("heading", "section_header")
HEADING_LABELS = ("title", "section_header", "subtitle_level_1", "subtitle_level_2", "subtitle_level_3", "subtitle_level_4", "subtitle_level_5", "page_header")


def _item(order: int, kind: str, label: str, text: str = "", level: int = 0, box=None, table: dict | None = None) -> dict:
    held = table or {"cells": None, "num_rows": None, "num_cols": None}
    return {"ord": order, "kind": kind, "label": label, "text": text, "level": level, "bbox": box, **held}


def from_markdown(name: str, text: str | None) -> dict:
    """Level 1 headings are titles, others section headers; tables keep their cells; the rest are paragraphs."""
    items = []
    for i, block in enumerate(markup.blocks(text)):
        kind, payload, level = block["kind"], block["payload"], block["level"]
        if kind == "heading":
            items.append(_item(i, "text", "title" if level == 1 else "section_header", payload, level))
        elif kind == "paragraph":
            items.append(_item(i, "text", "paragraph", payload))
        else:
            items.append(_item(i, "table", "table", table=markup.html_table(payload) if kind == "html_table" else markup.pipe_table(payload)))
    return {"name": name, "page": None, "items": items}


def _box(raw, scale: tuple[float, float] | None) -> dict | None:
    if raw is None:
        return None
    if not isinstance(raw, list) or len(raw) != 4:
        raise ValueError("a box has four numbers")
    sx, sy = scale or (1.0, 1.0)
    left, top, right, bottom = map(float, raw)
    return {"l": left * sx, "t": top * sy, "r": right * sx, "b": bottom * sy}


def _level(block: dict) -> int:
    return min(6, max(1, int(block.get("level", 1))))


#: What becomes of a block by its kind, given the block and its text: kind of item, label, what else it has. Other kinds are text.
_BECOMES = {
    "title": lambda block, text: ("text", "title", {"text": text, "level": 1}),
    **dict.fromkeys(HEADING_KINDS, lambda block, text: ("text", "section_header", {"text": text, "level": _level(block)})),
    "picture": lambda block, text: ("picture", "picture", {}),
    "table": lambda block, text: ("table", "table", {"table": markup.table(text)}),
}


def _block(order: int, block: dict, categories: dict[str, str], scale) -> dict:
    said = block.get("category", "Text")
    kind = categories.get(said, str(said).lower())
    plain = lambda block, text: ("text", TEXT_LABELS.get(kind, "text"), {"text": text})
    what, label, more = _BECOMES.get(kind, plain)(block, (block.get("text") or "").strip())
    return _item(order, what, label, box=_box(block.get("bbox"), scale), **more)


def from_layout(name: str, payload: str | None, categories: dict[str, str] | None = None, width: float | None = None, height: float | None = None, scale: tuple[float, float] | None = None) -> dict | None:
    """Blocks of a JSON list; None if it isn't one, or is nested too deeply to read. A malformed block is passed over, the others count."""
    try:
        blocks = json.loads(payload or "")
    except (ValueError, RecursionError):
        return None
    if not isinstance(blocks, list):
        return None
    items = []
    for block in blocks:
        try:
            items.append(_block(len(items), block, categories or {}, scale))
        except Exception:  # whatever is wrong with one block: the page's others count
            continue
    return {"name": name, "page": {"width": width, "height": height}, "items": items}


def markdown_document(name: str | Column, text: str | Column) -> Column:
    return by_pieces(from_markdown, schemas.DOCUMENT)(name, text)


def layout_document(categories: dict[str, str] | None = None, resized: bool = False, **limits):
    """A function of the columns (name, payload, width, height); resized: boxes are in the resized page's space."""

    def convert(name, payload, width, height):
        return from_layout(name, payload, categories, width, height, scale_of(height, width, **limits) if resized else None)

    return by_pieces(convert, schemas.DOCUMENT)


def scale_of(height: float | None, width: float | None, factor: int = 28, min_pixels: int = 3136, max_pixels: int = 11289600) -> tuple[float, float] | None:
    """(x, y) from the resized page to the page's own pixels; None for pages without size and where nothing changes."""
    if not height or not width or height <= 0 or width <= 0:
        return None
    sides = [max(factor, round(x / factor) * factor) for x in (height, width)]
    if sides[0] * sides[1] > max_pixels:
        by = (height * width / max_pixels) ** 0.5
        sides = [int(x / by / factor) * factor for x in (height, width)]
    elif sides[0] * sides[1] < min_pixels:
        by = (min_pixels / (height * width)) ** 0.5
        sides = [-int(-x * by / factor // 1) * factor for x in (height, width)]
    if min(sides) <= 0:
        return None
    x, y = width / sides[1], height / sides[0]
    return None if abs(x - 1) < 1e-6 and abs(y - 1) < 1e-6 else (x, y)


def _of_kind(document: Column, kind: str) -> Column:
    return F.filter(document["items"], lambda i: i["kind"] == kind)


def item_counts(document: Column) -> Column:
    """Text items by label, and under __tables__ and __pictures__ the others."""
    labels = F.transform(_of_kind(document, "text"), lambda i: i["label"])
    each = F.transform(F.array_distinct(labels), lambda x: F.struct(x.alias("k"), F.size(F.filter(labels, lambda y: y == x)).alias("n")))
    rest = F.array(*[F.struct(F.lit(f"__{k}s__").alias("k"), F.size(_of_kind(document, k)).alias("n")) for k in ("table", "picture")])
    return F.map_from_entries(F.concat(each, rest))


def heading_count(counts: Column) -> Column:
    return sum((F.coalesce(F.try_element_at(counts, F.lit(x)), F.lit(0)) for x in HEADING_LABELS), F.lit(0))


def deltas(pred: Column, base: Column) -> Column:
    """Headings, tables and pictures that pred has more than base; null where either document is missing."""
    a, b = item_counts(pred), item_counts(base)
    at = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    found = F.struct(
        a.alias("item_counts_pred"), b.alias("item_counts_base"), (heading_count(a) - heading_count(b)).cast("bigint").alias("heading_count_delta"),
        (at(a, "__tables__") - at(b, "__tables__")).cast("bigint").alias("table_count_delta"), (at(a, "__pictures__") - at(b, "__pictures__")).cast("bigint").alias("picture_count_delta"),
    )
    return F.when(pred.isNotNull() & base.isNotNull(), found)


def missing_callouts(delta: Column) -> Column:
    """What one side lacks altogether while the other has three or more, and headings that differ by five or more."""
    at = lambda side, k: F.coalesce(F.try_element_at(delta[f"item_counts_{side}"], F.lit(f"__{k}__")), F.lit(0))
    parts = []
    for k in ("tables", "pictures"):
        parts.append(F.when((at("pred", k) == 0) & (at("base", k) >= 3), F.format_string(f"Prediction has no {k}; baseline has %d.", at("base", k))))
        parts.append(F.when((at("base", k) == 0) & (at("pred", k) >= 3), F.format_string(f"Baseline has no {k}; prediction has %d.", at("pred", k))))
    d = delta["heading_count_delta"]
    parts.append(F.when(F.abs(d) >= 5, F.format_string("Prediction has %d %s headings than the baseline.", F.abs(d), F.when(d > 0, "more").otherwise("fewer"))))
    return F.array_compact(F.array(*parts))


def statistics(document: Column) -> Column:
    """Number of items and length of the text items."""
    length = F.aggregate(_of_kind(document, "text"), F.lit(0).cast("bigint"), lambda n, i: n + F.length(i["text"]))
    return F.struct(F.size(document["items"]).cast("bigint").alias("item_count"), length.alias("text_length"))


def plain_text(document: Column) -> Column:
    return F.array_join(F.filter(F.transform(_of_kind(document, "text"), lambda i: i["text"]), lambda t: t != ""), "\n\n")


def _cell_rows(item: Column) -> Column:
    of = lambda r: F.transform(F.filter(item["cells"], lambda c: c["r0"] == r), lambda c: c["text"])
    row = lambda r: F.concat(F.lit("| "), F.array_join(of(r), " | "), F.lit(" |"))
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), item["num_rows"]) - 1), row)
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), item["num_cols"]))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, 1 << 20)), "\n")


def rendered(document: Column) -> Column:
    """The document as markdown in a form of our own: headings with #, pipe tables, items apart by blank lines."""
    heading = lambda i: F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), i["level"])), F.lit(" "), i["text"])
    one = lambda i: F.when(i["kind"] == "picture", F.lit("<!-- picture -->")).when((i["kind"] == "table") & (F.coalesce(i["num_rows"], F.lit(0)) > 0), _cell_rows(i)).when(i["label"].isin("title", "section_header"), heading(i)).otherwise(i["text"])
    return F.array_join(F.filter(F.transform(document["items"], one), lambda t: t != ""), "\n\n")


def sections(document: Column) -> Column:
    """(label, text) of each item in order, with a placeholder for what has no text."""
    stub = lambda i: F.when(i["kind"] == "table", "[table]").when(i["kind"] == "picture", "[picture]").otherwise("[empty]")
    return F.transform(document["items"], lambda i: F.struct(i["label"].alias("label"), F.coalesce(F.nullif(F.trim(i["text"]), F.lit("")), stub(i)).alias("text")))


def regions(document: Column) -> Column:
    """Labelled boxes of texts, then pictures, then tables; items without a box are left out."""
    order = F.concat(*[_of_kind(document, k) for k in ("text", "picture", "table")])
    boxed = F.filter(order, lambda i: i["bbox"].isNotNull())
    return F.transform(boxed, lambda i: F.struct(F.coalesce(F.nullif(i["label"], F.lit("")), F.lit("unknown")).alias("category"), i["bbox"].alias("bbox")))


def has_layout(document: Column) -> Column:
    return F.coalesce(F.exists(document["items"], lambda i: i["bbox"].isNotNull()), F.lit(False))


def layout_comparison(pred: Column, base: Column, threshold: float = geometry.IOU_THRESHOLD) -> Column:
    """Greedy matches of regions by category: mean overlap (0.0 without matches), also by category, and counts; null where a side has no regions."""
    boxes = lambda side, cat: F.transform(F.filter(side, lambda r: r["category"] == cat), lambda r: r["bbox"])
    categories = F.array_union(F.transform(pred, lambda r: r["category"]), F.transform(base, lambda r: r["category"]))
    each = F.transform(categories, lambda c: F.struct(c.alias("category"), F.transform(geometry.greedy_matches(boxes(pred, c), boxes(base, c), threshold), lambda m: m["iou"]).alias("ious")))
    mean = lambda xs: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)).otherwise(0.0)
    ious = F.flatten(F.transform(each, lambda x: x["ious"]))
    found = F.struct(
        mean(ious).alias("iou_mean"),
        F.map_from_entries(F.transform(F.filter(each, lambda x: F.size(x["ious"]) > 0), lambda x: F.struct(x["category"].alias("k"), mean(x["ious"]).alias("v")))).alias("iou_per_category"),
        F.size(ious).alias("matched_regions"), (F.size(pred) - F.size(ious)).alias("unmatched_pred"), (F.size(base) - F.size(ious)).alias("unmatched_base"),
    )
    return F.when((F.size(pred) > 0) & (F.size(base) > 0), found)
