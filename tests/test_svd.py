import random

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from skein.operators import learn


def jobs(spark):
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def test_reduction_equals_numpy_in_few_passes(spark):
    """Sparse, dense and empty rows, on both sides of LONG_ROW; as many jobs whatever k is."""
    rng = random.Random(4)
    x = np.zeros((120, 400))
    for i in range(1, 120):
        for j in rng.sample(range(400), 300 if i % 40 == 0 else rng.randint(1, 12)):
            x[i, j] = rng.random() + (j < 20)
    rows = [(i, Vectors.dense(r) if i % 7 == 0 and i else Vectors.sparse(400, [(j, v) for j, v in enumerate(r) if v])) for i, r in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, ["key", "features"])
    before = jobs(spark)
    reduced, values, explained = learn.svd(df, "key", 30)
    assert jobs(spark) - before < 12
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:30]) and abs(explained - (s[:30] ** 2).sum() / (s**2).sum()) < 1e-9
    got = np.array([r.reduced for r in reduced.orderBy("key").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :30] * s[:30]), atol=1e-8)


def test_reduction_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(i, Vectors.sparse(50, [(i, 2.0)])) for i in range(3)], ["key", "features"])
    reduced, values, explained = learn.svd(df, "key", 10)
    assert np.allclose(values, [2, 2, 2]) and abs(explained - 1) < 1e-9 and all(len(r.reduced) == 3 for r in reduced.collect())
    assert learn.svd(df.where(F.col("key") < 0), "key", 10)[0].collect() == []
