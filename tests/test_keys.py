from pagewright.functions import scalars


def test_long_keys_are_not_cut(spark):
    """Numbers are padded to six, eight and four digits; longer ones stay whole, so no two items share a path."""
    rows = spark.createDataFrame([("7", "8", 9), ("1234567", "123456789", 12345)], "i string, p string, s int")
    got = [r[0] for r in rows.select(scalars.ocr_text_path(rows.i, rows.p, rows.s)).collect()]
    assert got == ["item-000007/item-000007-00000008-0009.txt", "item-1234567/item-1234567-123456789-12345.txt"]
