import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees nearby "
#: doc_id, text: nulls, empties, blanks, repeated rows, copies by case, a very long text, odd characters.
ROWS = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "Hello World, this is a line that is long enough\nshort\nHello World, this is a line that is long enough"),
    (5, "hello world, this is a line that is long enough\nother tail of words here today"),
    (6, "HELLO WORLD, THIS IS A LINE THAT IS LONG ENOUGH"),
    (6, "HELLO WORLD, THIS IS A LINE THAT IS LONG ENOUGH"),
    (7, "hello world, this is a line that is long enough"),
    (8, "Été ÉTÉ été naïve 日本語 テスト 😀 ▁ x"),
    (9, LONG * 3000),
    (10, LONG * 3000 + "one more"),
    (11, "1234567890 !!! ???"),
    (12, "a"),
    (None, "a text without an id that stands alone here"),
    (13, "Released under the MIT License.\n" + LONG),
    (14, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"),
    (14, "a second text under the same id with nothing shared at all with others"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """Documents with more columns, under the names that operators use inside."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("digest", "digest_of_text", "text_tag", "fp", "kept", "accepted", "words", "n", "_keep_id", "key"):
        out = out.withColumn(name, F.lit(f"own {name}"))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    """A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
