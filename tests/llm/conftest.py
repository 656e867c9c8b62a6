import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, key string, level int, rank int, node long, prob double"


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 7, "k", 3, 9, 1, 0.5) for r in rows]
        return spark.createDataFrame(full, FIELDS)

    return make
