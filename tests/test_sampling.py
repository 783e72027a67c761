import pytest
from pyspark.sql import functions as F

from pagewright.operators import sampling
from pagewright.sources import catalog

VOLUMES = "item_id string, title_id string, barcode string, rights string, language string, year int"


def tables(spark, volumes=30, pages=8):
    v = [(f"i{k}", f"t{k % 5}", f"b{k}", "open" if k % 3 else "closed", "ENG" if k % 2 else "GER", 1800 + k if k % 7 else None) for k in range(volumes)]
    p = [(f"i{k}-p{n % 6}" if k % 4 else f"p{n % 6}", f"i{k}", n) for k in range(volumes) for n in range(k % pages)]  # page ids repeat in a volume and across volumes
    return spark.createDataFrame(v, VOLUMES), spark.createDataFrame(p, "page_id string, item_id string, n int")


def rows(df):
    return [tuple(r) for r in df.select("item_id", "page_id", "n", "prank").collect()]


def test_same_sample_however_rows_lie(spark):
    v, p = tables(spark)
    take = lambda v, p, **k: rows(sampling.stratified_sample(v, p, sample=25, volumes_n=12, pages_per_volume=3, ties=("n",), **k))
    first = take(v, p)
    assert first == take(v.orderBy(F.rand(1)).repartition(7), p.orderBy(F.rand(2)).repartition(3))
    assert first != take(v, p, seed=43)
    assert len({r[1] for r in first}) == len(first) and max(r[3] for r in first) <= 3
    by = {}
    for item, *_ in first:
        by[item] = by.get(item, 0) + 1
    assert max(by.values()) <= 3


def test_filters(spark):
    v, p = tables(spark)
    got = sampling.stratified_sample(v, p, sample=500, pages_per_volume=10, rights="open", languages=["eng"], year_range=(1801, 1820))
    kept = {r.item_id for r in v.filter("rights = 'open' and language = 'ENG' and year between 1801 and 1820").collect()}
    assert {r[0] for r in rows(got)} <= kept and rows(got)
    assert sampling.stratified_sample(v, p, sample=500, pages_per_volume=10, languages=[]).count() > len(rows(got))


def test_one_row_an_item(spark):
    v = spark.createDataFrame([("a", "10", "x"), ("a", "9", "w"), ("a", None, "v"), ("b", "1", "z"), ("b", "1", "y"), ("c", None, None)], "item_id string, title_id string, barcode string")
    got = {r.item_id: (r.title_id, r.barcode) for r in sampling.eligible_volumes(v).collect()}
    assert got == {"a": ("10", "x"), "b": ("1", "y"), "c": (None, None)}  # as text, nulls last


def test_impossible_samples():
    with pytest.raises(ValueError):
        sampling.check_sizes(100, 3, 10)
    with pytest.raises(ValueError):
        sampling.check_sizes(None, None, None, (1900, 1800))
    assert [sampling.rank_slice(10, 3, r) for r in range(3)] == [(0, 3), (3, 6), (6, 10)]


def test_plan(spark):
    v, p = tables(spark)
    plan = sampling.stratified_sample(v, p, sample=25, volumes_n=12, pages_per_volume=3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_volumes(spark):
    r = spark.createDataFrame(
        [("i1", "", "T", " A ", "ENG", 1900, "open", 2), ("i1", "", "T", " A ", "ENG", 1900, "open", 1), ("i2", "b2", None, " ", None, None, None, 1)],
        "item_id string, barcode string, title string, author string, language string, year int, rights string, prank int",
    )
    got = {x.barcode: x for x in sampling.sampled_volumes(r).collect()}
    assert got["i1"].page_count == 2 and got["i1"].creators == ["A"] and got["b2"].creators == []


def test_numbers_and_years(spark):
    df = spark.createDataFrame([(x,) for x in ["1887", "v.1 1887-90", "abc", "", None, "12345", " 7 ", "\\N", "NULL"]], "x string")
    assert [r[0] for r in df.select(catalog.year_in("x")).collect()] == [1887, 1887, None, None, None, 1234, None, None, None]
    assert [r[0] for r in df.select(catalog.number_in("x")).collect()] == [1887, None, None, None, None, 12345, 7, None, None]


def test_null_safe_prejoin(spark):
    cols = catalog.RIGHTS
    items = spark.createDataFrame(
        [("1", None, "x"), ("2", "", "x"), ("3", "p", "x"), ("4", None, "y"), ("5", "q", "x")], "ItemID string, CopyrightStatus string, RightsStatement string"
    ).withColumns({"LicenseType": F.lit(None).cast("string"), "RightsHolder": F.lit(""), "TitleID": F.lit("t"), "BarCode": F.lit("b"), "Year": F.lit("1900")})
    titles = spark.createDataFrame([("t", None, "short", "ENG", "m", "a")], "TitleID string, FullTitle string, ShortTitle string, LanguageCode string, MARCBibID string, TL2Author string")
    combos = catalog.rights_combinations(items)
    assert combos.count() == 5 and len({r.rights_json for r in combos.collect()}) == 4  # null and '' are two combinations of one meaning
    verdicts = combos.withColumn("classification", F.when(F.col("CopyrightStatus").isNull(), "b").otherwise("a")).withColumn("parsing_success", F.coalesce(F.col("CopyrightStatus"), F.lit("")) != "q")
    got = {r.ItemID: (r.Rights, r.Title, r.Year) for r in catalog.volumes_table(items, titles, verdicts).collect()}
    assert got == {"1": ("a", "short", 1900), "2": ("a", "short", 1900), "3": ("a", "short", 1900), "4": ("b", "short", 1900)}
    assert catalog.one_verdict(verdicts, cols).count() == 3


def test_ingest(spark, tmp_path):
    dump, target = tmp_path / "d.tsv", f"file://{tmp_path}/out"
    dump.write_text('a\tb\tc\n1\t\\N\t"q"\n2\tx "y\t\n')
    got = catalog.ingest(spark, f"file://{dump}", target)
    assert [tuple(r)[:3] for r in got.orderBy("a").collect()][0] == ("1", None, '"q"')
    assert got.orderBy("a").collect()[1].b == 'x "y'
    assert {k for _, k in got.dtypes} == {"string"}
    assert catalog.is_fresh(spark, f"file://{dump}", target) and not catalog.is_fresh(spark, f"file://{dump}", target, force=True)
    assert not catalog.is_fresh(spark, f"file://{dump}", f"file://{tmp_path}/none")
