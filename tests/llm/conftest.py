import pytest

DOCS = "doc_id long, text string, lang string, source string, kept string"


@pytest.fixture()
def docs(spark):
    """Rows with NULLs, empty and repeated texts, ties and a clashing extra column."""
    base = " ".join(f"word{i}" for i in range(120))
    block = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", "x"), (2, base, "en", "a", "x"), (3, base.replace("word60 ", "other "), "de", "b", "x"),
        (4, f"head four\n{block}\ntail four", "en", "b", "x"), (5, f"start five\n{block}\nend five", "en", None, "x"),
        (6, "", "en", "c", "x"), (7, None, None, None, None), (8, "   \n ", None, "c", "x"), (9, "!!!", "en", "c", "x"), (10, "!!!", "en", "c", "x"),
        (11, "kurz", "de", "a", "x"), (11, "kurz", "de", "a", "x"), (None, "kein name hier", "de", "a", "x"), (12, "z" * 50_000, "en", "b", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def stored(spark, docs, tmp_path):
    """The same rows as a table of several files below a folder."""
    docs.repartition(4, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)
