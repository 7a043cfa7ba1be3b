import pytest


@pytest.fixture
def documents(spark, tmp_path):
    """Writes rows (doc_id, text[, source]) as the table ``documents`` with clashing extra columns and reads it back."""

    def make(rows, parts=3):
        rows = [(*r, None)[:3] if len(r) == 2 else r for r in rows]
        schema = "doc_id long, text string, source string"
        df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS shard", "'x' AS _row", "2 AS component", "3 AS kept", "4 AS n_entities", "0 AS fold", "'y' AS entities")
        path = str(tmp_path / f"docs{make.n}")
        make.n += 1
        df.repartition(parts).write.parquet(path)
        return spark.read.parquet(path)

    make.n = 0
    return make
