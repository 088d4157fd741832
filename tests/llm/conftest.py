import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang), with columns whose names operators use inside."""

    def make(rows, extra=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("h", "fp", "kept", "component_id", "score", "_h", "_items", "similarity", "row", "length", "lang_pred"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
