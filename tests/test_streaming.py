"""Streaming state: a replayed micro-batch is not counted twice."""
import tempfile

from pyspark.sql import functions as F

from tablecraft.streaming.online import fold_loss_batch


def test_replayed_batch_is_idempotent(spark):
    state = tempfile.mkdtemp(prefix="tablecraft-state-") + "/state"
    b0 = spark.createDataFrame([(0.5, 1.0), (0.25, 2.0)], "a double, b double")
    b1 = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    fold_loss_batch(b0, 0, ["a", "b"], state)
    fold_loss_batch(b1, 1, ["a", "b"], state)
    fold_loss_batch(b1, 1, ["a", "b"], state)   # replay after a failure
    got = {r.expert: r.s for r in spark.read.parquet(state).groupBy("expert")
           .agg(F.sum("loss").alias("s")).collect()}
    assert got == {"a": 1.75, "b": 4.0}
