import pytest

from cardwatch.llm import base


@pytest.fixture
def lm(spark, tmp_path_factory):
    """The session with the package's settings and a folder for its tables."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return base.prepare(spark)


@pytest.fixture
def frame(lm):
    def make(rows, schema="doc_id long, text string"):
        return lm.createDataFrame(rows, schema)

    return make
