"""Tokens, error rates, multiset similarity and sequence diffs of texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.distances import edit_distance
from pagewright.functions.pieces import by_pieces
from pagewright.functions.sequences import opcodes

#: Words and runs of newlines; other white space separates.
TOKEN = r"(?U)\S+|\n+"
_PY_TOKEN = re.compile(r"\S+|\n+")
#: Product of two lengths up to which the built-in edit distance, quadratic, is the quicker one.
_SHORT = 1_000_000


def tokens(column: str | Column) -> Column:
    return F.regexp_extract_all(F.col(column) if isinstance(column, str) else column, F.lit(TOKEN), F.lit(0))


def py_tokens(text: str) -> list[str]:
    return _PY_TOKEN.findall(text)


def stripped(column: str | Column) -> Column:
    """The text without white space at its ends, in one pass: from its first to its last visible character."""
    return F.regexp_extract(column, r"(?Us)^\s*+(.*\S)?", 1)


def cer(base: str, pred: str) -> Column:
    """Character edit distance over the length of the baseline, both stripped; null where either is empty. Can exceed 1.

    Long pairs take the bit-parallel distance, which two texts of 200,000 characters keep busy for seconds.
    """
    b, p = stripped(base), stripped(pred)
    short = F.length(b).cast("long") * F.length(p) <= _SHORT
    long = _by_pairs(_py_distance, F.when(~short, b), F.when(~short, p))
    return F.when((F.length(b) > 0) & (F.length(p) > 0), F.when(short, F.levenshtein(b, p)).otherwise(long) / F.length(b))


def wer(base: str | Column, pred: str | Column) -> Column:
    """Word edit distance over the number of baseline words, both stripped; null where either is empty. Words end at a blank, or where two white spaces or more meet; a lone line break doesn't end one."""
    return _by_pairs(_py_wer, base, pred)


def py_words(text: str | None) -> list[str]:
    """The words that wer counts."""
    return [w for w in re.sub(r"\s\s+", " ", (text or "").strip()).split(" ") if w]


def _py_distance(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else float(edit_distance(a, b))


def _py_wer(b: str | None, p: str | None) -> float | None:
    b, p = py_words(b), py_words(p)
    return edit_distance(b, p) / len(b) if b and p else None


def _by_pairs(one, base: str | Column, pred: str | Column) -> Column:
    """A number for each pair of texts, worked out batch by batch."""

    def work(b: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(b, p, strict=True)], dtype="float64")

    return F.pandas_udf(work, "double")(base, pred)


def disagreement(rows: DataFrame, page: str, model: str, text: str) -> DataFrame:
    """(page, disagreement, n_models): the mean over pairs of a page's texts of 1 - 2 * common tokens / all tokens.

    Null and empty texts don't count; fewer than two leave 0. Tokens are counted per text before anything is joined, so a
    pair of texts costs as many rows as they share distinct tokens.
    """
    w = rows.select(F.col(page).alias("page"), F.col(model).alias("model"), F.col(text).alias("text"))
    models = w.groupBy("page").agg(F.countDistinct(F.nullif(F.col("model").cast("string"), F.lit(""))).alias("n_models"))
    texts = w.filter(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("tokens", tokens("text"))
    counted = texts.select("page", "model", F.size("tokens").alias("size"), F.explode_outer("tokens").alias("token")).groupBy("page", "model", "size", "token").agg(F.count("token").alias("n"))
    a, b = counted.alias("a"), counted.alias("b")
    common = (
        a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.model") < F.col("b.model")))
        .groupBy(F.col("a.page").alias("page"), F.col("a.model").alias("ma"), F.col("b.model").alias("mb"))
        .agg(F.sum(F.least("a.n", "b.n")).alias("common"))
    )
    sizes = texts.select("page", "model", F.size("tokens").alias("size"))
    x, y = sizes.alias("x"), sizes.alias("y")
    pairs = x.join(y, (F.col("x.page") == F.col("y.page")) & (F.col("x.model") < F.col("y.model"))).select(
        F.col("x.page").alias("page"), F.col("x.model").alias("ma"), F.col("y.model").alias("mb"), (F.col("x.size") + F.col("y.size")).alias("total")
    )
    ratio = F.when(F.col("total") > 0, 2 * F.coalesce("common", F.lit(0)) / F.col("total")).otherwise(1.0)
    mean = pairs.join(common, ["page", "ma", "mb"], "left").groupBy("page").agg(F.avg(1 - ratio).alias("mean"))
    return models.join(mean, "page", "left").select("page", F.coalesce("mean", F.lit(0.0)).alias("disagreement"), "n_models")


_FIELDS = ("tag", "i1", "i2", "j1", "j2")


def _diffed(base: list[str], pred: list[str]) -> tuple[list[dict], list[tuple[str, int | None, int | None]], float]:
    """Opcodes by name, rows of the side-by-side view, and the matching share."""
    codes, ratio = opcodes(base, pred)
    return [dict(zip(_FIELDS, c, strict=True)) for c in codes], row_classes(codes), ratio


def compared(base: str | None, pred: str | None) -> dict | None:
    """Word and line diffs of two texts; None where either is empty once stripped. Lines that stand side by side and differ are diffed by words."""
    sides = {"base": (base or "").strip(), "pred": (pred or "").strip()}
    if not all(sides.values()):
        return None
    words, lines = ({k: cut(x) for k, x in sides.items()} for cut in (py_tokens, lambda x: x.split("\n")))
    codes, rows, share = _diffed(**words)
    line_codes, line_rows, _ = _diffed(**lines)
    beside = ((i, py_tokens(lines["base"][i]), py_tokens(lines["pred"][j])) for kind, i, j in line_rows if kind == "changed")
    count = lambda rows, side, at: sum(r[0] == side or r[0] == "changed" and r[at] is not None for r in rows)
    same = lambda rows: sum(r[0] == "unchanged" for r in rows)
    out = {"similarity": share, "opcodes": codes, "common": same(rows), "removed": count(rows, "removed", 1), "added": count(rows, "added", 2)}
    out |= {"line_opcodes": line_codes, "lines_unchanged": same(line_rows), "lines_removed": count(line_rows, "removed", 1), "lines_added": count(line_rows, "added", 2)}
    out |= {f"{k}_tokens": x for k, x in words.items()} | {f"{k}_lines": x for k, x in lines.items()}
    return out | {"inline_word_opcodes": {str(i): _diffed(a, b)[0] for i, a, b in beside if a or b}}


def _py_comparison(base: str | None, pred: str | None) -> dict | None:
    out = compared(base, pred)
    return out and out | {"inline_word_opcodes": list(out["inline_word_opcodes"].items())}


def text_comparison(base: str | Column, pred: str | Column) -> Column:
    """The diff of two texts; sequence matching is order-bound and has no counterpart among built-in functions."""
    return by_pieces(_py_comparison, schemas.TEXT_COMPARISON)(base, pred)


def _py_similarity(b: str | None, p: str | None) -> float | None:
    b, p = (b or "").strip(), (p or "").strip()
    return opcodes(py_tokens(b), py_tokens(p))[1] if b and p else None


def similarity(base: str | Column, pred: str | Column) -> Column:
    """Matching share of the tokens of two texts, 0 to 100; null where either is empty."""
    return _by_pairs(_py_similarity, base, pred)


def row_classes(codes: list[tuple]) -> list[tuple[str, int | None, int | None]]:
    """Rows of a side-by-side view: (class, base line, pred line); of an uneven replacement the surplus is removed or added alone."""
    out = []
    for tag, i1, i2, j1, j2 in codes:
        n = max(i2 - i1, j2 - j1)
        for k in range(n):
            i, j = (i1 + k if i1 + k < i2 else None), (j1 + k if j1 + k < j2 else None)
            kind = "unchanged" if tag == "equal" else "changed" if i is not None and j is not None else "removed" if j is None else "added"
            out.append((kind, i, j))
    return out
