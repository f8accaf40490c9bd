import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents as (doc_id, text), with extra columns whose names the operators use inside."""

    def make(*rows):
        df = spark.createDataFrame([(i, t, "en", "h", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "1 as id", "'x' as host", "2 as _id", "3 as bucket", "4 as spans", "5 as n", "6 as covered")

    return make
