"""Tables written on the way belong to one application."""

import os

from signalloom.sources import shared


def local(path):
    return path.removeprefix("file:")


def test_clearing_leaves_other_applications_alone(spark):
    mine = shared.materialise(spark.range(3), "mine")
    assert spark.sparkContext.applicationId in shared.shared_dir(spark) and mine.count() == 3
    other = f"{os.path.dirname(local(shared.shared_dir(spark)))}/application-other/kept"
    spark.range(5).write.mode("overwrite").parquet(f"file:{other}")
    name = shared.scratch_table(spark)
    spark.sql(f"CREATE TABLE {name} (x BIGINT) USING parquet LOCATION '{shared.shared_path(spark, 'scratch')}'")
    shared.clear_shared(spark)
    assert not os.path.exists(local(shared.shared_dir(spark))) and not spark.catalog.tableExists(name)
    assert spark.read.parquet(f"file:{other}").count() == 5
