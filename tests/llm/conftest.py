import public_tokenizers
import pytest

from eventlens.llm.common import importable

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows that every operator on documents has to live with: nulls, empty and odd texts, ties, repeated rows.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 58),
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 58),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t \x0b\x0c\r", "fr", "b", 6),
    (None, "Un texte sans numéro, mais avec des mots et un identifiant nul.", "fr", None, None),
    (None, None, None, "a", None),
    (5, "x" * 30_000, None, "b", 30_000),
    (6, "word " * 5_000, "en", "b", 25_000),
    (7, "12345 67890 !!! ???", "de", "c", 19),
    (8, "日本語のテキスト ひらがな <|endoftext|> é ﬁ", "ja", "c", 10),
    (9, "The quick brown fox jumps over the lazy dog and runs away. " * 40, "en", "a", 2360),
]


@pytest.fixture(autouse=True)
def _workers(spark):
    importable(spark)


@pytest.fixture()
def odd(spark):
    """The odd rows with columns whose names clash with those that operators add."""
    more = ", size long, root string, kept boolean, score double, `no text` string, row string"
    return spark.createDataFrame([(*r, 1, "r", True, 0.5, "t", "w") for r in ODD], DOCUMENTS + more)


@pytest.fixture()
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")
