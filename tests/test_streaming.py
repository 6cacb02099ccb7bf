import numpy as np
import pytest

from loom.streaming.running import RunningSums


def test_running_sums_over_files(spark, tmp_path):
    m = np.random.default_rng(0).standard_normal((60, 3))
    for k in range(3):
        rows = [(i, m[i].tolist()) for i in range(20 * k, 20 * k + 20)]
        spark.createDataFrame(rows, "id long, v array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sums = RunningSums()
    sums.start(stream, str(tmp_path / "state")).awaitTermination()
    assert sums.count == 60 and np.allclose(sums.gram, m.T @ m) and np.allclose(sums.total, m.sum(0)) and np.allclose(sums.covariance(), m.T @ m / 60)
    again = spark.createDataFrame([(0, [1.0, 1.0, 1.0])], "id long, v array<double>")
    sums.add(again, sums.last)  # delivered twice
    assert sums.count == 60
    other = RunningSums.restore(sums.state())
    other.add(again, sums.last + 1)
    assert other.count == 61 and np.allclose(other.gram, m.T @ m + 1)
    with pytest.raises(ValueError):
        RunningSums().covariance()
