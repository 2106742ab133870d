"""Densities don't depend on the order of the Gaussians, not even in the last bit."""

import pytest
from pyspark.sql import functions as F

from voxelore.operators import density
from voxelore.plans.standard import scene


@pytest.fixture(scope="module")
def gaussians(spark):
    return scene(spark, "/root/testdata/sf0.1").gaussians


def test_any_order_gives_the_same_density(spark, gaussians):
    points = gaussians.where("gid % 20 = 0").select(F.col("gid").alias("pid"), *[(F.col(k) + 0.01).alias(k) for k in "xyz"]).cache()
    found = []
    for key in ("gid", "x", "-y"):
        own = spark.createDataFrame(gaussians.orderBy(F.expr(key)).collect(), gaussians.schema)
        found.append({r.pid: (r.rho, r.gx, r.gy, r.gz) for r in density.at_points(own.coalesce(1), points).collect()})
    assert len(found[0]) == 100 and found[0] == found[1] == found[2]
