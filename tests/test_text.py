import difflib
import random
import time

from pyspark.sql import functions as F

from pagewright.functions import text

CASES = ["a b\n\nc", "a\nb c", "a\tb", "a\u00a0b \u00a0c", "\n lead and trail \n", "tab\tand nbsp", "", None, "one", "Ünï cödé wörd", "x x x y", "y x x x"]


def pairs(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in CASES for b in CASES)], "i int, a string, b string")


def test_tokens(spark):
    got = spark.createDataFrame([(c,) for c in CASES if c is not None], "t string").select("t", text.tokens("t").alias("k")).collect()
    assert all(r.k == text.py_tokens(r.t) for r in got)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_words_of_the_error_rate():
    """Runs of white space are one blank, and blanks part words; a lone line break, tab or other space doesn't."""
    words = {"a\nb c": ["a\nb", "c"], "a\tb": ["a\tb"], "a\u00a0b": ["a\u00a0b"], "a \u00a0b": ["a", "b"], " a \n\n b ": ["a", "b"], "a  b": ["a", "b"], "": []}
    assert {t: text.py_words(t) for t in words} == words


def test_error_rates(spark):
    for r in pairs(spark).select("a", "b", text.cer("a", "b").alias("cer"), text.wer("a", "b").alias("wer")).collect():
        a, b = (r.a or "").strip(), (r.b or "").strip()
        if not a or not b:
            assert r.cer is None and r.wer is None
            continue
        x, y = text.py_words(a), text.py_words(b)
        assert abs(r.cer - plain_distance(a, b) / len(a)) < 1e-12 and abs(r.wer - plain_distance(x, y) / len(x)) < 1e-12


def test_bit_parallel_distance():
    pick = random.Random(7)
    for n in (0, 1, 2, 9, 63, 64, 65, 130):
        for letters in ("ab", "abcdefgh", [("a", 1), ("b", 2), None]):
            for _ in range(12):
                a, b = pick.choices(letters, k=n), pick.choices(letters, k=pick.randint(0, 140))
                assert text.edit_distance(a, b) == plain_distance(a, b)


def test_long_texts(spark):
    """Two pages of 200,000 characters, and long runs of blanks; each in seconds."""
    pick = random.Random(1)
    page = "".join(pick.choices("abcdefghij klmno", k=200_000))
    other = "".join(pick.choices("abcdefghij klmno", k=200_000))
    few = list(page)
    for at in range(100, 200_000, 4000):
        few[at] = "#"
    blanks = "x" + " " * 1_000_000 + "y"
    df = spark.createDataFrame([("few", page, "".join(few)), ("other", page, other), ("blanks", blanks + "   ", blanks), ("trail", "z" + " \n" * 500_000, "z")], "k string, a string, b string")
    began = time.time()
    got = {r.k: r for r in df.select("k", text.cer("a", "b").alias("cer"), text.wer("a", "b").alias("wer"), F.length(text.stripped("a")).alias("n")).collect()}
    assert time.time() - began < 90
    assert abs(got["few"].cer * len(page.strip()) - 50) < 1e-6 and 0.3 < got["other"].cer < 1 and got["blanks"].cer == 0 and got["trail"].cer == 0
    assert got["blanks"].n == 1_000_002 and got["trail"].n == 1 and 0 < got["few"].wer < 0.01


def test_comparison_against_difflib(spark):
    for r in pairs(spark).select("a", "b", text.text_comparison("a", "b").alias("d"), text.similarity("a", "b").alias("s")).collect():
        a, b = (r.a or "").strip(), (r.b or "").strip()
        if not a or not b:
            assert r.d is None and r.s is None
            continue
        m = difflib.SequenceMatcher(None, text.py_tokens(a), text.py_tokens(b), autojunk=False)
        assert [tuple(o) for o in r.d.opcodes] == m.get_opcodes() and abs(r.s - m.ratio() * 100) < 1e-9
        assert r.d.common + r.d.removed == len(r.d.base_tokens) and r.d.common + r.d.added == len(r.d.pred_tokens)
        assert r.d.lines_unchanged + r.d.lines_removed == len(a.split("\n"))


def test_inline_diffs_pair_lines():
    d = text.compared("a b\nc d\nsame", "a x\nsame")
    assert set(d["inline_word_opcodes"]) == {"0"} and d["lines_removed"] == 2 and d["lines_added"] == 1
    assert text.row_classes([("replace", 0, 2, 0, 1), ("equal", 2, 3, 1, 2)]) == [("changed", 0, 0), ("removed", 1, None), ("unchanged", 2, 1)]


def test_disagreement_is_quick_ratio(spark):
    pick = random.Random(3)
    words = ["a", "b", "c", "dd", "\n"]
    rows = [(f"p{p}", f"m{m}", " ".join(pick.choices(words, k=pick.randint(0, 12)))) for p in range(25) for m in range(p % 5 + 1)]
    rows += [("same", "m1", "x y"), ("same", "m2", "x y"), ("apart", "m1", "x"), ("apart", "m2", "y"), ("gaps", "m1", ""), ("gaps", "m2", None), ("gaps", "m3", "z"), ("nameless", None, "q"), ("nameless", "", "r")]
    got = {r.page: r for r in text.disagreement(spark.createDataFrame(rows, "page string, model string, text string"), "page", "model", "text").collect()}
    for page in {r[0] for r in rows} - {"nameless"}:
        own = [text.py_tokens(t) for p, _, t in rows if p == page and t]
        ratios = [1 - difflib.SequenceMatcher(None, own[i], own[j], autojunk=False).quick_ratio() for i in range(len(own)) for j in range(i + 1, len(own))]
        assert abs(got[page].disagreement - (sum(ratios) / len(ratios) if ratios else 0.0)) < 1e-9, page
    assert got["same"].disagreement == 0 and got["apart"].disagreement == 1 and got["nameless"].n_models == 0


def test_word_error_rate_of_many_words(spark):
    many = " ".join(f"w{i}" for i in range(36000))
    rows = spark.createDataFrame([(many, "w35999 w2 x"), ("w1 w2 x", many), ("a b c d e", "a x c y e z"), ("", many), (None, many)], "a string, b string")
    got = [r.w for r in rows.select(text.wer("a", "b").alias("w")).collect()]
    assert got == [35999 / 36000, 35998 / 3, 3 / 5, None, None]


def test_matching_blocks_are_those_of_the_longest_runs():
    """Against the standard library's matcher: random sequences of few and of many different items."""
    pick = random.Random(5)
    for letters in ("ab", "abc", "abcdefghijklmnop", ["x"]):
        for _ in range(150):
            a, b = pick.choices(letters, k=pick.randint(0, 40)), pick.choices(letters, k=pick.randint(0, 40))
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            codes, share = text.opcodes(a, b)
            assert codes == m.get_opcodes() and abs(share - 100 * m.ratio()) < 1e-9
    a = [str(pick.randint(0, 3000)) for _ in range(20_000)]
    b = [x if pick.random() < 0.98 else "changed" for x in a]
    began = time.time()
    codes, share = text.opcodes(a, b)
    assert time.time() - began < 60 and 97 < share < 99 and [x for c in codes if c[0] == "equal" for x in a[c[1] : c[2]]] == [x for c in codes if c[0] == "equal" for x in b[c[3] : c[4]]]
