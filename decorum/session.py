"""Small helpers that depend on the running session."""

import contextlib
import os
import uuid

from pyspark.sql import functions as F


def shared_folder(spark, purpose, base=None):
    """A new folder for checkpoints or intermediate tables, under ``base`` or else
    under ``spark.checkpoint.dir``, the folder all executors share."""
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share, or pass one")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


@contextlib.contextmanager
def arrow_batches(spark, size):
    """Within it, a batch of rows on its way to Python has ``size`` bytes (or one larger row), on either side: for wide
    rows, of which Spark's 64 MB a task are several hundred once vectors have grown."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df, partitions=None):
    """Deal rows out to ``partitions`` for compute-heavy row work, where the caller asks for
    it: a table of one small file arrives as one piece."""
    return df.repartition(partitions) if partitions else df


def utc_timestamp(col):
    """A zone-less UTC time as an instant, whatever the session zone is."""
    minutes = F.unix_date(col.cast("date")) * 1440 + F.hour(col) * 60 + F.minute(col)
    seconds = F.extract(F.lit("SECOND"), col)
    return F.timestamp_micros(minutes.cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long"))


def small_table(spark, rows, names):
    """A table of a few literal rows (hundreds at most), whose size the planner
    knows (and so broadcasts it)."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
