"""The incremental loop: new parts are read once, checked against the earlier ones, and the loop stops on a rule."""

from __future__ import annotations

import os
import traceback
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.session import shared_dir

BatchFunction = Callable[[DataFrame, int], None]


def process_new_files(spark: SparkSession, folder: str, schema: str, work: BatchFunction, checkpoint: str, pattern: str = "*.parquet", files_per_batch: int = 100) -> list[dict]:
    """Runs ``work`` on every file not yet seen, then stops; returns the batches that failed, with their errors.

    A batch that raises doesn't stop the rest. Its files are noted beside the checkpoint before the stream goes on, and the
    next call runs ``work`` on them again, under the same batch number, before anything new; the note goes when that
    succeeds. So each file is worked on at least once, and ``work`` should overwrite by batch number.
    """
    failed = f"{checkpoint.rstrip('/')}-failed"
    errors: list[dict] = []

    def attempt(df: DataFrame, batch: int) -> bool:
        try:
            work(df, batch)
        except Exception:
            errors.append({"batch": batch, "error": traceback.format_exc()[-2000:]})
            return False
        return True

    for name in _listed(spark, failed):
        files = [r[0] for r in spark.read.parquet(f"{failed}/{name}").collect()]
        if attempt(spark.read.schema(schema).parquet(*files), int(name.removeprefix("batch="))):
            _remove(spark, f"{failed}/{name}")

    def guarded(df: DataFrame, batch: int) -> None:
        if not attempt(df.drop("_file"), batch):
            df.select("_file").distinct().write.mode("overwrite").parquet(f"{failed}/batch={batch}")

    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    source = source.withColumn("_file", F.col("_metadata.file_path"))
    source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(guarded).start().awaitTermination()
    return errors


def incremental_totals(spark: SparkSession, folder: str, schema: str, keys: list[str], value: str, pattern: str) -> DataFrame:
    """Count and sum by key over a folder, one partial table a batch in the shared folder, merged at the end."""
    root = os.path.join(shared_dir(spark), f"totals-{uuid.uuid4().hex}")

    def work(df: DataFrame, batch: int) -> None:
        part = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        part.write.mode("overwrite").parquet(f"{root}/parts/batch={batch}")

    errors = process_new_files(spark, folder, schema, work, f"{root}/checkpoint", pattern)
    if errors:
        raise RuntimeError(errors[0]["error"])
    return spark.read.parquet(f"{root}/parts").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def windowed_counts(spark: SparkSession, folder: str, schema: str, when: str, key: str, width: str, late: str, pattern: str, files_per_batch: int = 100) -> DataFrame:
    """Tumbling event-time windows with a watermark, drained into the shared folder. Beyond what the workload had.

    Each batch writes the windows that it changed; the watermark drops the state of those that can't change any more. The
    last word on a window is that of its latest batch.
    """
    root = os.path.join(shared_dir(spark), f"windows-{uuid.uuid4().hex}")
    source = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    counted = source.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n"))
    out = counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/part={batch}")

    out.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("start", key).agg(F.max_by("n", "_batch").alias("n"))


def run_loop(spark: SparkSession, root: str, produce: Callable[[int], DataFrame], passed: Callable[[DataFrame], bool], most: int) -> tuple[int, bool]:
    """Produce a part, keep it, decide whether to stop; a restart goes on after the parts that are complete.

    ``produce(k)`` gives the k-th part, which is written to ``root/part=k``; ``passed`` sees all parts so far. Parts that
    were cut off have no _SUCCESS file and are produced again. Returns the number of parts and whether the rule stopped it.
    """

    def complete() -> int:
        done = [name for name in _listed(spark, root) if _exists(spark, f"{root}/{name}/_SUCCESS")]
        return len(done)

    k = complete()
    if k and passed(spark.read.parquet(root)):
        return k, True
    while k < most:
        produce(k).write.mode("overwrite").parquet(f"{root}/part={k}")
        k += 1
        if passed(spark.read.parquet(root)):
            return k, True
    return k, False


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, folder: str) -> bool:
    path, system = _path(spark, folder)
    return system.exists(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path, system = _path(spark, folder)
    system.delete(path, True)


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path, system = _path(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(path)) if system.exists(path) else []


def stop_rule(metrics: DataFrame, frobenius_limit: float, jsd_limit: float) -> DataFrame:
    """run, passed: whether there are comparisons with earlier checkpoints and all of them stay under both limits."""
    ok = (F.col("frobenius") < frobenius_limit) & (F.col("jsd") < jsd_limit)
    return metrics.groupBy("run").agg(((F.count("*") > 0) & F.coalesce(F.bool_and(ok), F.lit(False))).alias("passed"))


def adapt_until(ladder: DataFrame, rates_of: Callable[[DataFrame], DataFrame], threshold: float, most: int) -> tuple[DataFrame, int]:
    """Cycles that insert rungs while any exchange rate is under the threshold; the counter restarts with each insertion."""
    from tessellar.operators.reshape import insert_rungs
    from tessellar.session import materialise

    for cycle in range(most):
        rates = rates_of(ladder)
        if not rates.where(F.col("rate") < threshold).limit(1).count():
            return ladder, cycle
        ladder = materialise(insert_rungs(ladder, rates, threshold).drop("source_state"), "ladder")
    return ladder, most
