import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from {id: text} or (id, text[, lang]) rows, with the usual other columns and
    some whose names the operators use within."""

    def make(rows):
        rows = rows.items() if isinstance(rows, dict) else rows
        full = [(row[0], row[1], row[2] if len(row) > 2 else "en", "src0", len(row[1] or ""), 1.5, "x", 7, b"k") for row in rows]
        return spark.createDataFrame(full, f"{DOCS}, h1 double, _keep string, text_hash long, rest binary")

    return make
