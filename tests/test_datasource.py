"""The document data source."""

import os

import pytest
from pyspark.sql import functions as F

from quirework.sources import adapters, datasource


@pytest.fixture
def elements(spark, data):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield adapters.elements(spark, data)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_saved_rows_come_back(spark, elements, tmp_path):
    path = f"file://{tmp_path}/doc"
    back = datasource.saved(elements, path)
    assert back.schema.simpleString() == elements.schema.simpleString() and rows_of(back) == rows_of(elements)
    assert rows_of(back.select("kind", "page_id").filter("kind = 'text' AND page_id > 20")) == rows_of(elements.select("kind", "page_id").filter("kind = 'text' AND page_id > 20"))
    more = elements.withColumn("page_id", F.lit(None).cast("long")).limit(3)
    assert rows_of(datasource.saved(more, path, mode="append")) == sorted(rows_of(elements) + rows_of(more))
    assert datasource.opened(spark, path).filter("page_id IS NULL").count() == 3


def test_filters_on_the_key_read_fewer_files(spark, elements, tmp_path):
    back = datasource.saved(elements, str(tmp_path / "doc"))
    entries = datasource.current(str(tmp_path / "doc"))["files"]
    assert len(entries) == 4 and back.rdd.getNumPartitions() == 4
    back = datasource.opened(spark, str(tmp_path / "doc"), push_filters=True)
    for condition in ("page_id = 7", "page_id IN (1, 2)", "page_id < 9", "page_id <= 9", "page_id > 140", "page_id >= 140 AND page_id < 145", "page_id = 100000", "page_id IN (1, NULL)"):
        some = back.filter(condition)
        assert rows_of(some) == rows_of(elements.filter(condition)), condition
        assert some.rdd.getNumPartitions() < 4 or "NULL" in condition, condition


def test_ranges_read_fewer_files_and_a_table_may_be_used_twice(spark, elements, tmp_path):
    path = str(tmp_path / "doc")
    back = datasource.saved(elements, path)
    low, high = datasource.opened(spark, path, high=20), datasource.opened(spark, path, low=130)
    assert low.rdd.getNumPartitions() < 4 and high.rdd.getNumPartitions() < 4
    assert rows_of(low.union(high)) == rows_of(elements.filter("page_id <= 20 OR page_id >= 130"))
    assert rows_of(back.filter("page_id <= 20").union(back.filter("page_id >= 130"))) == rows_of(low.union(high))


def test_a_failed_save_leaves_the_old_table(spark, elements, tmp_path):
    path = str(tmp_path / "doc")
    datasource.saved(elements, path)
    before, folders = datasource.current(path), set(os.listdir(path))
    broken = elements.withColumn("z_index", F.when(F.col("element_id") % 700 == 699, F.raise_error("no").cast("int")).otherwise(F.col("z_index")))
    with pytest.raises(Exception, match="no"):
        datasource.saved(broken, path)
    assert datasource.current(path) == before and set(os.listdir(path)) == folders and rows_of(datasource.opened(spark, path)) == rows_of(elements)
    datasource.saved(elements.limit(5), path)
    assert datasource.opened(spark, path).count() == 5 and len(os.listdir(path)) == 2


def test_what_is_refused(spark, elements, tmp_path):
    path = str(tmp_path / "doc")
    with pytest.raises(Exception, match="no document table"):
        datasource.opened(spark, path).count()
    with pytest.raises(Exception, match="no column of what is saved"):
        datasource.saved(elements.drop("page_id"), path, key="page_id")
    datasource.saved(elements.filter("false"), path)
    assert datasource.opened(spark, path).count() == 0
    with pytest.raises(Exception, match="another schema"):
        datasource.saved(elements.drop("kind"), path, mode="append")
