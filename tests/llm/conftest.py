import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or inside.
CLASHES = ["score", "lang_pred", "length", "start", "size", "ids", "node", "kept", "epoch", "tokens", "shard", "slot", "secrets", "domain", "words",
           "n_words", "keys", "offset", "sequence_id", "part", "group", "weight", "budget", "rank", "bucket", "whole", "lines", "windows"]


def lines_of(*rows):
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


LONG = " ".join(f"the word{i % 977} of line{i % 13}." for i in range(30_000))
ODD = lines_of(
    (1, "The cat sat on the mat and it was the best of all days for a cat to sit on a mat in the sun", "en", "src0"),
    (2, "The cat sat on the mat and it was the best of all days for a cat to sit on a mat in the sun", "en", "src0"),
    (3, None, "en", "src1"), (4, "", "de", "src1"), (5, " \n\t ", None, None), (6, "12 34 !!", "fr", "src2"),
    (7, LONG, "en", "src3"), (None, "ein Haus und der Hund sind nicht im Garten", "de", None),
    (8, "ein Haus und der Hund sind nicht im Garten", None, "src4"), (8, "ein Haus und der Hund sind nicht im Garten", "de", "src4"),
    (8, "ein Haus und der Hund sind nicht im Garten", "de", "src4"), (9, "é́ 中文 \x02 <|endoftext|> \U0001f600 x", "xx", "src5"),
    (-10, "a", "en", "src0"), (11, "token = abcdefghijklmnop", "en", "src0"))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F
    return docs.select("*", *[F.lit("own").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
