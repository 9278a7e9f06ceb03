"""Structured Streaming forms of the "online" phase.

* ``stream_score``: an unbounded stream of bookings is enriched with fitted
  target-encoding tables (stream-static left joins, broadcast when the state
  is small) and scored by a pure projection (no streaming aggregation, so it
  runs in append mode with no state store).
* ``stream_ewa``: labelled arrivals update the EWA expert weights.  The
  weights depend only on the per-expert cumulative loss, so each micro-batch
  folds its loss sums into a small state table through ``foreachBatch``.
  The write is keyed by batch id (dynamic partition overwrite), so a batch
  replayed after a failure replaces its own contribution instead of adding it
  twice.

Sources, sinks and checkpoints live under the session's shared
``spark.checkpoint.dir``; the file source / sink plus the checkpoint give
exactly-once output across executor or driver restarts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import PROB_EPS
from ..operators.transforms import TargetEncodeState
from ..session import ensure_checkpoint_dir


def stream_dirs(spark: SparkSession, name: str) -> dict[str, str]:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    return {"in": f"{base}/in", "out": f"{base}/out", "chk": f"{base}/chk", "state": f"{base}/state"}


ROWS_PER_FILE = 1_000_000


def land_files(df: DataFrame, path: str, least_files: int = 4) -> None:
    """Write rows as parquet files, the arrivals of a file source: as many files
    as the rows need at ``ROWS_PER_FILE``, and a few at least."""
    n = max(least_files, -(-df.count() // ROWS_PER_FILE))
    df.repartition(n).write.mode("overwrite").parquet(path)


def expert_probs_projection(df: DataFrame, state: TargetEncodeState, *keep: str) -> DataFrame:
    """Uniform average of the prior and the per-column encodings as columns
    p_0.. plus argmax ``prediction`` (and ``keep`` columns); projection only
    (stream friendly)."""
    enc = state.apply(df, keep=False)
    cls = state.classes
    n_exp = 1 + len(state.columns)
    probs = [(F.lit(state.prior[j]) + sum(F.col(f"{c}_{j}") for c in state.columns)) / float(n_exp)
             for j in cls]
    arr = F.array(*probs)
    idx = F.array_position(arr, F.array_max(arr)).cast("int")
    return enc.select("row_id", *keep, *[p.alias(f"p_{j}") for j, p in zip(cls, probs)],
                      F.element_at(F.array(*[F.lit(j) for j in cls]), idx).cast("int").alias("prediction"))


def stream_score(spark: SparkSession, arrivals: DataFrame, state: TargetEncodeState,
                 files_per_trigger: int = 1) -> DataFrame:
    """Runs the scoring stream over ``arrivals`` landed as files, with an
    ``availableNow`` trigger; returns the sink read back as a table."""
    d = stream_dirs(spark, "score")
    land_files(arrivals, d["in"])
    src = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(d["in"])
    scored = expert_probs_projection(src, state)
    q = (scored.writeStream.format("parquet").option("path", d["out"])
         .option("checkpointLocation", d["chk"]).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(d["out"])


def fold_loss_batch(batch: DataFrame, batch_id: int, names, state_path: str) -> None:
    """Per-expert loss sums of one micro-batch written to the state table under
    partition ``batch_id`` (dynamic overwrite: a replayed batch replaces its
    own partition, so it is never counted twice)."""
    sums = batch.agg(*[F.sum(n).alias(n) for n in names])
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("expert"),
                                                     F.coalesce(F.col(n), F.lit(0.0)).alias("loss"))
                                           for n in names])).alias("e")) \
        .select("e.expert", "e.loss", F.lit(batch_id).alias("batch_id"))
    (long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(state_path))


def stream_ewa(spark: SparkSession, arrivals: DataFrame, state: TargetEncodeState,
               eta: float = 0.5, files_per_trigger: int = 1) -> DataFrame:
    """Running EWA weights over labelled arrivals; returns (expert, cum_loss, weight)."""
    d = stream_dirs(spark, "ewa")
    land_files(arrivals, d["in"])
    src = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_trigger) \
        .parquet(d["in"])
    enc = state.apply(src, keep=False)
    experts = [("prior", [F.lit(state.prior[j]) for j in state.classes])] + \
              [(f"te_{c}", [F.col(f"{c}_{j}") for j in state.classes]) for c in state.columns]
    p_true = [F.element_at(F.array(*ps), F.col("label") + 1) for _, ps in experts]
    losses = enc.select("row_id", *[(-F.log(F.least(F.greatest(p, F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))))
                          .alias(name) for (name, _), p in zip(experts, p_true)])
    names = [n for n, _ in experts]
    # an arrival that is delivered twice counts once; the keys are the stream's state
    losses = losses.dropDuplicates(["row_id"])

    def fold(batch: DataFrame, batch_id: int) -> None:
        fold_loss_batch(batch, batch_id, names, d["state"])

    q = (losses.writeStream.foreachBatch(fold).option("checkpointLocation", d["chk"])
         .trigger(availableNow=True).start())
    q.awaitTermination()
    st = spark.read.parquet(d["state"])
    cum = st.groupBy("expert").agg(F.sum("loss").alias("cum_loss"))
    from pyspark.sql import Window
    w = Window.partitionBy()
    u = cum.withColumn("_u", F.exp(-eta * (F.col("cum_loss") - F.min("cum_loss").over(w))))
    return u.select("expert", "cum_loss", (F.col("_u") / F.sum("_u").over(w)).alias("weight"))
