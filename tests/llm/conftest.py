import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Null, empty, blank, tied, repeated and long texts.
ODD = [None, "", " ", "a", "a", "  two  blanks ", "\n \n x", "tab\t \tx", "é" * 5000, "word " * 20000, "x" * 30000, "Ünïcode ß", "don't we'll I'm", "12 3456 7.8", "<|endoftext|> a <|endoftext|>b", "  　nb", "emoji 😀😀 end\n\n"]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with clashing names, nulls in every column and repeated rows."""
    rows = [(i, t, None, "src0", None, "clash") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None, None), (3, "a", "en", "s", 1, "x"), (3, "a", "en", "s", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
