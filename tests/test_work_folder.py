"""A run's work tables lie in one folder and go with it, on success and on failure."""

import pytest

from clipmill.session import new_path, shared_folder, stored, work_folder


def exists(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def test_work_tables_go_with_the_run(spark):
    with work_folder(spark) as folder:
        path = new_path(spark, "x")
        assert path.startswith(folder)
        df = stored(spark.range(10), "numbers")
        df.write.bucketBy(2, "id").format("parquet").option("path", new_path(spark, "buckets")).saveAsTable("work_folder_test")
        assert df.count() == 10 and exists(spark, folder) and spark.catalog.tableExists("work_folder_test")
    assert not exists(spark, folder) and not spark.catalog.tableExists("work_folder_test")
    assert new_path(spark, "x").startswith(shared_folder(spark)) and not new_path(spark, "x").startswith(folder)


def test_work_tables_go_after_an_error(spark):
    with pytest.raises(KeyError), work_folder(spark) as folder:
        stored(spark.range(3))
        raise KeyError
    assert not exists(spark, folder)


def test_runs_do_not_share_folders(spark):
    with work_folder(spark) as a:
        kept = stored(spark.range(4))
        with work_folder(spark) as b:
            assert a != b and stored(spark.range(5)).count() == 5
        assert kept.count() == 4 and new_path(spark, "y").startswith(a)
