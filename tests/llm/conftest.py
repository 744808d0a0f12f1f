import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document(doc_id, text, source="s", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text))


@pytest.fixture
def write(spark, tmp_path):
    """Writes rows as the documents table of a folder and returns the folder."""

    def put(rows, schema=COLUMNS):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return put
