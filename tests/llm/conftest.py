import pytest


@pytest.fixture
def docs(spark):
    """docs(text, ...) or docs((id, text), ...): rows with all columns of documents and clashing ones."""

    def make(*rows, clash=()):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in clash)
        full = [(i, t, "en", "s", None if t is None else len(t), *(["x"] * len(clash))) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return make
