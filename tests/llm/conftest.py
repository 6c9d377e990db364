import pytest

#: Rows with nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "The quick brown fox, it's 12 o'clock!\n\n  Don't   stop"),
    (2, None),
    (3, ""),
    (4, "naïve café ἀρχή 中文 <|endoftext|> x²  \t\r\n"),
    (5, "ab " * 9000),
    (6, "same"),
    (6, "same"),
    (6, "other"),
    (7, "   \n \n"),
    (8, "!!!'s 've'll 'twas done ###"),
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    # extra columns whose names clash with those the operators use inside
    for name in ("start", "length", "units", "part", "n_tokens", "id", "path", "lang", "source"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def bpe_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
