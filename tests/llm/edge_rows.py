"""Fixtures of awkward rows, imported by the tests that use them."""
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the cat sat on a mat and saw one red bird fly over green hills while rain fell down".split()


def sentence(i, n):
    return " ".join(WORDS[(i * 7 + j * (1 + i % 5)) % len(WORDS)] + ("." if j % 9 == 8 else "") for j in range(n))


@pytest.fixture(scope="session")
def rows():
    """Null in every column, empty and blank texts, a very long text, ties,
    repeated rows, texts without letters, special strings and odd code points."""
    out = [(i, sentence(i, 5 + i % 40), ("en", "fr", None)[i % 3], f"s{i % 4}", 10) for i in range(60)]
    out += [(100, None, "en", "s0", None), (101, "", None, None, 0), (102, " \n\t ", "fr", "s1", 4),
            (103, sentence(3, 60_000), "en", "s0", 1), (104, "12 34 ++ --", "en", "s0", 11),
            (105, "a<|endoftext|>b <|startoftext|>'s It's", "en", "s0", 5), (106, "Été İstanbul ΑΣ ﬁ 漢字 é́ ​ ²½", "fr", None, 5),
            (107, sentence(4, 30), "en", "s2", 9), (108, sentence(4, 30), "en", "s2", 9), (None, sentence(5, 20), "en", "s1", 3),
            (None, None, None, None, None)]
    return out + out[3:5] + [out[-2]]                 # repeated rows


CLASHES = {"ids": 1, "decoded": "x", "node": 2, "n": 3, "keys": "k", "bucket": 4, "late": 5, "score": 0.5, "rate": 0.1,
           "topic": "t", "tokens": 7, "sig": "s", "_found": 1, "start": 2, "component": 3, "sampled": True, "h": 9}


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for k, v in CLASHES.items():
        df = df.withColumn(k, F.lit(v))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
