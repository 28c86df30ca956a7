import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF0001 = "/root/testdata/sf0.001"
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])

HARD_TEXTS = [
    None, "", " ", "\n\n", "one", " lead", "trail ", "a b c d", "don't  we'll\tx\n\n y", "naïve Ünïcödé ÀÉ", "x y   z", "a 　b  c",
    "ctl\x1cx \x1d y", "<|endoftext|> in text <|startoftext|>", "é ́x", "12,345.67 (€) 😀😀", "ΣΑΣ ΟΔΟΣ", "w" * 300, "́", "a\r\nb\x0bc\x0cd",
]


def documents(spark, rows, extra=()):
    """rows: (doc_id, text[, source]); extra: columns with clashing names."""
    data = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(data, DOCS)
    from pyspark.sql import functions as F
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def long_text():
    words = [f"w{(i * 7919) % 4001}" for i in range(60_000)]
    return " ".join(words)
