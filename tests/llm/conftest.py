import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder that a cluster would name; set only where it is unset."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def docs(spark):
    def make(rows, extra=()):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
        full = [(i, t, "en", s, len(t or ""), *["x"] * len(extra)) for i, t, s in rows]
        return spark.createDataFrame(full, schema)

    return make
