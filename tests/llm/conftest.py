import pytest

#: Null and empty texts, white space, repeated rows, ties, one long text, letters beyond ASCII, null ids; extra columns whose names operators use themselves.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog.\nToken = \"abcdef0123456789abcdef01\" here.", "en", "a"),
    (2, "", "en", "a"),
    (3, None, None, None),
    (4, "   \n\t ", "fr", "b"),
    (5, "Éte là-bas, ünd schön 日本語 😀 | a | b | c", "fr", "b"),
    (6, "the quick brown fox jumps over the lazy dog.\ntoken = \"abcdef0123456789abcdef01\" HERE.", "en", "a"),
    (6, "the quick brown fox jumps over the lazy dog.\ntoken = \"abcdef0123456789abcdef01\" HERE.", "en", "a"),
    (7, "word " * 30_000, "en", "a"),
    (None, "a b c", "en", "a"),
    (8, "a b c", None, "c"),
    (9, "JUNK!! JUNK!! JUNK!!\nJUNK!! JUNK!!", "de", "c"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, id string, key string, tokens int, node string, range string, n int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "s", "i", "k", 7, "n", "r", 1) for r in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
