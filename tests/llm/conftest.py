import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SAME = "the quick brown fox jumps over the lazy dog while seven wizards brew a green potion under the old stone bridge at dawn"


def messy_rows():
    """Nulls, empty and long texts, ties, repeated rows and one doc_id with two texts."""
    return [
        (1, SAME, "en", "src0"), (2, SAME, "en", "src0"), (2, SAME, "en", "src0"), (3, None, None, None), (4, "", "en", "src1"),
        (5, " \n\t ", None, "src1"), (None, SAME, "en", None), (None, None, None, None), (6, LONG, "en", "src0"), (7, LONG + " end", "de", "src2"),
        (8, "one two", "en", "src2"), (8, SAME + " indeed", "en", "src2"), (9, "été … 123 — ok\n\nété … 123 — ok\n", "fr", "src0"), (10, "12345 67", "fr", "src0"),
    ]


CLASH = ("node", "band", "rank", "line", "row", "text_key", "copy_key", "n", "root", "score", "mix_n", "words", "seed", "count")


@pytest.fixture(scope="session")
def make(spark):
    """documents from rows (doc_id, text, lang, source), with extra columns whose names the operators might use."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASH),
    ])

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), *["extra"] * len(CLASH)) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def messy(make):
    return make(messy_rows())
