import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Texts that no operator may stumble over; ids 5 and 6 repeat, and so does the whole row of id 7.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n \t ", "en", "a", 7),
    (4, "one", None, "b", 3),
    (5, "the same text, twice here\nwith two lines of it", "en", "b", 46),
    (6, "the same text, twice here\nwith two lines of it", "de", None, 46),
    (7, "repeated row", "en", "a", 12),
    (7, "repeated row", "en", "a", 12),
    (8, "日本語🙂 ▁ é\r\nx\x00y", "ja", "c", 15),
    (9, "long words and lines \n" * 9000, "en", "a", 198000),
    (None, "no id at all", "en", "a", 12),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, repeats, and clashing extra columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ["bucket", "word", "h", "kept", "score", "component_id", "rank", "slot", "count", "value", "label", "toxicity", "mix", "keep_bitmap", "row", "doc", "all", "named", "draw", "simhash", "part", "shard", "tail", "token", "places", "keys"]
    return df.withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
