import pytest

LONG = "Lorem ipsum dolor. " * 4000 + "x" * 50_000
#: Nulls in every column, empty and very long texts, repeated rows, odd white space and scripts.
DOCS = [
    (1, "The cat sat on the mat. The dog ran off.\nIt was a fine day for them all.", "en", "a", 70),
    (2, "The cat sat on the mat. The dog ran off.\nIt was a fine day for them all!", "en", "a", 70),
    (3, None, "en", "a", None),
    (4, "", "de", "b", 0),
    (5, "   \n\t ", None, "b", 5),
    (6, LONG, "en", "c", len(LONG)),
    (7, "Der Hund und die Katze sind im Haus. Das ist gut so, sagt der Mann.", "de", None, 60),
    (8, "Le chat et le chien sont dans la maison. C'est très bien, dit l'homme.", "fr", "a", 60),
    (9, "one two three\x0bfour\x1cfive", "en", "a", 20),
    (10, "The cat sat on the mat. The dog ran off.\nIt was a fine day for them all.", "en", "b", 70),
    (10, "The cat sat on the mat. The dog ran off.\nIt was a fine day for them all.", "en", "b", 70),
    (11, "日本語の文書です。 <|endoftext|> </s>", "ja", "d", 20),
    (None, "a text without an id", "en", "a", 20),
    (12, "word", "en", "a", 4),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
