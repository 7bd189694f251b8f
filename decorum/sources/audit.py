"""The append-only audit table.

Layout: ``<path>/batch_id=<id>/log_date=<day>/``. A batch that is written again
replaces its own folder only, so a replay after a failure changes nothing.
"""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_COLUMNS = ["id", "timestamp", "original_text_masked", "ml_score", "llm_confidence",
                 "hybrid_score", "risk_level", "policy_violation"]


def audit_schema():
    """S5. Timestamps are UTC without a zone."""
    return T.StructType([
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("original_text_masked", T.StringType(), False),
        T.StructField("ml_score", T.DoubleType()),
        T.StructField("llm_confidence", T.DoubleType()),
        T.StructField("hybrid_score", T.DoubleType()),
        T.StructField("risk_level", T.StringType()),
        T.StructField("policy_violation", T.StringType()),
        T.StructField("log_date", T.DateType()),
    ])


def init_audit(spark, path):
    """Create the table if it is missing."""
    empty = spark.createDataFrame([], audit_schema())
    empty.write.mode("ignore").partitionBy("log_date").parquet(f"{path}/batch_id=init")


def utc_now():
    """M5: the time of writing, UTC without a zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def audit_rows(predictions, at=None, row_id=None):
    """One row per prediction that was computed: no repeats, no errors.

    ``at`` is the time column, by default the time of writing. Ids are hashes of text
    and time unless ``row_id`` gives one; a running number would need all rows in one
    task.
    """
    computed = predictions
    if "cached" in predictions.columns:
        computed = computed.filter(~F.col("cached"))
    if "error" in predictions.columns:
        computed = computed.filter(F.col("error").isNull())
    policy = F.col("policy_violation") if "policy_violation" in predictions.columns else F.lit(None)
    timed = computed.withColumn("timestamp", at if at is not None else utc_now())
    return timed.select(
        (row_id if row_id is not None
         else F.xxhash64("comment", F.col("timestamp").cast("string"))).alias("id"),
        "timestamp",
        F.col("masked_comment").alias("original_text_masked"),
        "ml_score", "llm_confidence", "hybrid_score", "risk_level",
        F.coalesce(policy, F.lit("None")).alias("policy_violation"),
        F.col("timestamp").cast("date").alias("log_date"),
    )


def append_audit(predictions, path, batch_id=None, at=None, row_id=None, files_per_day=None, summary=None):
    """Append the computed predictions as one batch, ``files_per_day`` files for each day, or as many as
    adaptive execution takes for a day's size: one for a small day, and no task writes all rows of a
    large one. With ``summary`` the batch's sums are written there: see ``summarize``."""
    batch = batch_id if batch_id is not None else f"run-{uuid.uuid4().hex}"
    rows = audit_rows(predictions, at, row_id)
    if files_per_day:
        rows = rows.repartition("log_date", F.pmod(F.xxhash64("id"), F.lit(files_per_day)))
    else:
        rows = rows.hint("rebalance", F.col("log_date"))
    rows.write.mode("overwrite").partitionBy("log_date").parquet(f"{path}/batch_id={batch}")
    if summary:
        summarize(predictions.sparkSession, path, summary, batch)


SUMMED = {"avg_ml": "ml_score", "avg_llm": "llm_confidence", "avg_hybrid": "hybrid_score"}


def summarize(spark, path, summary, batch):
    """The sums and counts of one batch by day, risk and policy, from its own folder only. They replace
    those of an earlier try."""
    rows = spark.read.schema(audit_schema()).option("basePath", f"{path}/batch_id={batch}").parquet(f"{path}/batch_id={batch}")
    sums = rows.groupBy("log_date", "risk_level", "policy_violation").agg(
        F.count("*").alias("n"),
        *[x for name, c in SUMMED.items() for x in (F.sum(c).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n"))])
    sums.write.mode("overwrite").parquet(f"{summary}/batch_id={batch}")


def read_summary(spark, summary):
    """Rows and mean scores by day, risk and policy, as ``risk_summary`` gives them from the
    whole log; only the batches' sums are read."""
    sums = spark.read.parquet(summary)
    return sums.groupBy("log_date", "risk_level", "policy_violation").agg(
        F.sum("n").alias("n"), *[(F.sum(f"{name}_sum") / F.sum(f"{name}_n")).alias(name) for name in SUMMED])


def read_audit(spark, path):
    """The whole table; filter on ``log_date`` to prune days."""
    return spark.read.schema(audit_schema()).parquet(path)
