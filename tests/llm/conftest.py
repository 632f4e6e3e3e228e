import pytest

from .cases import SCHEMA, hard_documents, hard_items


@pytest.fixture(scope="session")
def rows():
    return hard_documents()


@pytest.fixture(scope="session")
def hard_dir(spark, tmp_path_factory):
    """A folder of tables with the hard cases."""
    base = str(tmp_path_factory.mktemp("hard"))
    spark.createDataFrame(hard_documents(), SCHEMA).repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(0, 1, 0), (0, 0, 0), (None, 1, 0), (3, None, None), (999, 1, 1)] + [(i, int(i != 10), 0) for i in range(5, 20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(hard_items(), "item_id long, text string, doc_id int").write.parquet(f"{base}/benchmark.parquet")
    return base


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{base}/pages.parquet")
    return base


@pytest.fixture(scope="session")
def hard(spark, hard_dir):
    return spark.read.parquet(f"{hard_dir}/documents.parquet")
