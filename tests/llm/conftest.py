import pytest

#: NULLs, empty and white-space texts, ties, repeated rows, a long text, odd characters.
ODD = [
    (1, "The cat sat on the mat.\nThe cat sat on the mat.", "en", "a", 47),
    (2, "", "en", "a", 0), (3, None, None, None, None), (None, "no key here at all", "en", None, 18),
    (4, " \t\n ", "en", "b", 4), (5, "déjà vu — 日本語のテキスト 😀 <|endoftext|>", "fr", "b", 30),
    (6, "word " * 3000, "en", "c", 15000), (7, "x" * 3000 + " y", "en", "c", 3002),
    (8, "same row", "en", "a", 8), (8, "same row", "en", "a", 8), (9, "aaaa bbbb!!! ##$ 12345  \u00a0z", "en", "c", 20),
]


CLASHING = ["_digest", "_node", "_key", "_rows", "_h0", "_copy", "_m0", "_copies", "_kept", "_g0", "_evenness0", "row", "found",
            "kept", "node", "key", "a.b", "with space"]


@pytest.fixture(scope="session")
def odd(spark):
    """The columns of documents and some with names that operators use themselves, or that need quotes."""
    rows = [(*r, "clash", 7, *range(len(CLASHING))) for r in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size string, n_tokens int, "
        + ", ".join(f"`{name}` long" for name in CLASHING))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
