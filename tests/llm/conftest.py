import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text[, lang]) tuples, with columns whose names clash with results."""
    def build(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("score", "row", "key", "text_key", "n", "component", "piece", "rank", "h", "label"):
                df = df.withColumn(c, F.lit("clash"))
        return df.repartition(3)
    return build
