"""Exact duplicates by a heavy-hitter split.

Texts are equal when their SHA-256 digests are. A third of all rows may share
one digest, so the frequent digests are found first by mergeable Misra-Gries
summaries, counted exactly, and the verified ones (at most ``counters``, however
large the table) are broadcast: their copies are marked where they lie and never
meet in one task. All other digests go through one ordinary shuffle of slim rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from decorum.llm.store import Shelf

COUNTERS = 1000


def digest(text):
    """SHA-256 of the UTF-8 text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def trim(summary, block, key, count, counters):
    """Misra-Gries reduction of each block: subtract the (counters+1)-th largest
    count and keep what stays above zero, at most ``counters`` keys."""
    order = Window.partitionBy(block).orderBy(F.col(count).desc(), key)
    whole = Window.partitionBy(block)
    placed = summary.withColumn("_place", F.row_number().over(order))
    cut = F.max(F.when(F.col("_place") == counters + 1, F.col(count))).over(whole)
    left = placed.withColumn("_left", F.col(count) - F.coalesce(cut, F.lit(0)))
    return left.filter((F.col("_place") <= counters) & (F.col("_left") > 0)).select(
        block, key, F.col("_left").alias(count))


def misra_gries(df, key, counters=COUNTERS, fan_in=64, parts=64):
    """Keys with a lower bound of their count, at most ``counters`` rows.

    Every key on more than a share 1/(counters+1) of the rows is among them. Each
    scan partition is summed up first, in ``parts`` blocks by hash; summaries merge by
    adding counts and trimming again, in two rounds.
    """
    block = F.spark_partition_id() * parts + F.pmod(F.xxhash64(key), F.lit(parts))
    first = df.groupBy(block.alias("_block"), key).agg(F.count("*").alias("_count"))
    summary = trim(first, "_block", key, "_count", counters)
    for block in (F.pmod(F.col("_block"), F.lit(fan_in)), F.lit(0)):
        merged = summary.groupBy(block.alias("_block"), key).agg(F.sum("_count").alias("_count"))
        summary = trim(merged, "_block", key, "_count", counters)
    return summary.select(key, "_count")


def heavy_digests(digests, counters=COUNTERS):
    """(_digest, _size, _keep) of each digest on more than 1/(counters+1) of the
    rows: the Misra-Gries candidates with their exact counts. At most ``counters`` rows."""
    candidates = misra_gries(digests, "_digest", counters).select("_digest")
    exact = digests.join(F.broadcast(candidates), "_digest").groupBy("_digest").agg(
        F.count("*").alias("_size"), F.max("_id").alias("_keep"))
    rows = digests.count()
    return exact.filter(F.col("_size") * (counters + 1) > rows)


def mark_copies(docs, id_col="doc_id", text_col="text", counters=COUNTERS, folder=None):
    """One row per input row: _id, _digest, _keep (id of the row that stays),
    _size (rows with this text) and _kept.

    Of equal texts the row with the largest id stays; ids that are null come
    last. Of repeated rows with one id and one text exactly one is kept. A null
    text equals the empty text. Other columns are not read; an empty table gives
    no rows. If ids are unique, no task holds more than 1/(counters+1) of the rows for one text.
    """
    shelf = Shelf(docs.sparkSession, "exact-dedup", folder)
    digests = shelf.put("digests", docs.select(
        F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest")))
    heavy = shelf.put("heavy", heavy_digests(digests, counters))
    # The broadcast holds at most ``counters`` rows by construction.
    seen = digests.join(F.broadcast(heavy), "_digest", "left")
    loses = F.col("_size").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_keep"))
    lost = seen.filter(loses).select("_id", "_digest", "_keep", "_size", F.lit(False).alias("_kept"))
    same = Window.partitionBy("_digest")
    rest = seen.filter(~loses).select(
        "_id", "_digest",
        F.coalesce("_keep", F.max("_id").over(same)).alias("_keep"),
        F.coalesce("_size", F.count("*").over(same)).alias("_size"),
        (F.row_number().over(same.orderBy(F.col("_id").desc_nulls_last())) == 1).alias("_kept"))
    return lost.unionByName(rest)


def drop_copies(docs, id_col="doc_id", text_col="text", counters=COUNTERS, folder=None):
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Null, empty, tied and repeated rows are treated as in :func:`mark_copies`.
    Copies of heavy texts go before the shuffle; only the others carry their
    text through it.
    """
    names = docs.columns
    shelf = Shelf(docs.sparkSession, "exact-dedup", folder)
    digests = shelf.put("digests", docs.select(
        F.col(id_col).alias("_id"), digest(F.col(text_col)).alias("_digest")))
    heavy = shelf.put("heavy", heavy_digests(digests, counters))
    row = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"),
                      digest(F.col(text_col)).alias("_digest"))
    row = row.join(F.broadcast(heavy), "_digest", "left")
    row = row.filter(F.col("_size").isNull() | F.col("_id").eqNullSafe(F.col("_keep")))
    best = Window.partitionBy("_digest").orderBy(F.col("_id").desc_nulls_last())
    return row.withColumn("_place", F.row_number().over(best)).filter("_place = 1").select(
        *[F.col("_row")[n].alias(n) for n in names])
