import pytest

WEIRD = [
    (1, None, "en", None),
    (2, "", None, "src1"),
    (3, " \n\t ", "en", "src1"),
    (4, "one", "en", "src1"),
    (5, "One two three four five six seven eight nine ten eleven twelve.", "en", "src2"),
    (6, "One two three four five six seven eight nine ten eleven twelve.", "en", "src2"),
    (7, "word " * 40_000, "en", "src2"),
    (None, "no id here at all, but a text of some words that goes on for a while", "de", "src2"),
    (8, "x" * 200_000, "fr", "src3"),
    (9, "ünï cödé 𝒳 𝒴 — „Zitat“ 漢字 \u0000   end", "de", "src3"),
    (9, "ünï cödé 𝒳 𝒴 — „Zitat“ 漢字 \u0000   end", "de", "src3"),
]


@pytest.fixture(scope="session")
def weird(spark):
    """Nulls in every column, empty, blank, very long, repeated and odd texts, and columns named like internal ones."""
    rows = [(*r, None if r[1] is None else len(r[1]), "clash", 1.5, None) for r in WEIRD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, base string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
