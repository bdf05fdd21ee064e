import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that is was for on with as his they at be this from have or by one had not".split(),
    "fr": "le la les des une dans est que pour qui sur avec plus par au ce il elle nous vous être été où".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "ment" if lang == "fr" else "ing"]) for _ in range(n))


def hostile_rows():
    """Nulls in every column, empty and white texts, a long text, ties and repeated rows."""
    return [
        (1, None, None, None, None), (2, "", "en", "", 0), (3, " \t\n", "en", "src", 3), (4, "é", "fr", "HTTP://Host.example/x", 1),
        (5, "a  b\tc", "en", "src", 6), (6, "a b c", "en", "src", 5), (6, "a b c", "en", "src", 5), (None, "a b c", None, "src", 5),
        (None, None, None, None, None), (7, "word " * 20_000, "en", "src", 100_000), (8, "12 34 --", "en", "src", 8),
        (9, "x\x00y 中文 😀 <|endoftext|> </s>", "en", "src", 30), (9, "other text of the same id", "en", "src", 30),
    ]


@pytest.fixture(scope="session")
def hostile(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hostile_rows(), DOCS)
    # extra columns whose names operators use inside
    for name in ("fp", "content", "digest", "salt", "__rules", "__host", "__failed", "__score", "__kept_id", "__first_id", "host", "piece", "ids", "length", "a.b", "__salt", "__hot", "__rank", "_rank", "label", "o"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """160 documents in two languages, good prose and junk, with copies and near copies."""
    rng, rows = random.Random(5), []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append((i, sentence(rng, lang, rng.randint(12, 120)), lang, f"src{i % 4}", 0))
    for i in range(120, 140):
        rows.append((i, " ".join(w.upper() + "!!" for w in sentence(rng, "en", 40).split()), "en", "src0", 0))
    for i in range(140, 150):
        rows.append((i, rows[i - 140][1].replace(" ", "  ", 3), rows[i - 140][2], "src1", 0))
    for i in range(150, 160):
        words = rows[i - 60][1].split()
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), rows[i - 60][2], "src1", 0))
    return spark.createDataFrame(rows, DOCS).repartition(3)
