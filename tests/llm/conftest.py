import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (id, text) or (id, text, source) rows."""

    def make(rows, schema=DOCS):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names the operators use for results."""
    long = "lorem ipsum dolor sit amet " * 8_000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, "en", "a", len(long)), (3, long, "en", "a", len(long)), (None, "no id here, friend", None, None, 5), (4, " \n\t ", "en", "b", 4), (5, "héllo wörld œuvre ß 日本 \x1c x", "fr", "b", 9)]
    names = "kept score slot n_words n_tokens n_bytes labels spans block place predicted base_failed digests key node t words _source _text"
    extra = [(*r, *["x"] * len(names.split())) for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names.split()))
