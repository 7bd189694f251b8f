"""The scoring pipeline over streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from decorum.operators.cleaning import split_valid
from decorum.operators.reuse import distinct_texts, join_unique, successes, text_key, with_key
from decorum.operators.skew import hot_keys
from decorum.plans.predict import can_fail, score_texts
from decorum.session import utc_timestamp
from decorum.sources.audit import append_audit
from decorum.sources.results import Results

#: The texts of a result. Answers go without them; ``read_answers`` joins them.
TEXTS = ["comment", "masked_comment", "normalized_comment"]


def with_event_time(sdf, col="ts"):
    """A watermark needs an instant, not a zone-less time."""
    if dict(sdf.dtypes)[col] == "timestamp_ntz":
        return sdf.withColumn(col, utc_timestamp(F.col(col)))
    return sdf


def score_stream(sdf, col="text", **scoring):
    """Score each arriving comment; the same columns as in batch."""
    return score_texts(split_valid(sdf, col)[0], col=col, **scoring)


def first_sightings(sdf, seen, checkpoint, col="text", id_col="id", ts="ts"):
    """R2: write the first sighting of each text to the table ``seen`` (see ``Results``), however late it
    arrives. Of the arrivals of one micro-batch the earliest counts."""
    schema = T.StructType([*sdf.select(id_col, ts).schema.fields, T.StructField("text_key", T.StringType())])

    def keep(batch, batch_id):
        table = Results(batch.sparkSession, seen, schema)
        ok = with_key(split_valid(batch, col)[0], col).drop(col)
        row = F.struct(F.col(ts), F.col(id_col))
        firsts = ok.groupBy("text_key").agg(F.min(row).alias("_row")).select("text_key", "_row.*")
        firsts = firsts.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            table.add(firsts.join(table.of(firsts).select("text_key"), "text_key", "left_anti"), batch_id)
        finally:
            firsts.unpersist()

    return sdf.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def dedup_stream(sdf, ts="ts", col="text", keep_for="1 day"):
    """R2, bounded variant: the first sighting of each text within ``keep_for`` of event
    time, which bounds the state; only hashes are kept. Rows that arrive later than
    that are dropped: use ``first_sightings`` where none may be lost."""
    keyed = with_event_time(sdf, ts).withColumn("text_key", text_key(F.col(col)))
    return keyed.withWatermark(ts, keep_for).dropDuplicatesWithinWatermark(["text_key"])


def answer_stream(sdf, results, answers, checkpoint, col="text", id_col="id", audit=None, at=None, counts=None,
                  ts="ts", window="1 hour", **scoring):
    """R2: answer every comment, scoring only texts never scored before.

    Results live in the table ``results`` (see ``Results``), of which a batch reads the rows of its own
    keys. Answers get one folder per micro-batch in ``answers``, which a replay replaces; they carry
    ``scored_in``, the batch that scored the text. A text that failed is answered with its error, but is no
    result: it is scored again when it comes again.

    However often a text arrives, it is written once: answers have its key and its scores, and ``read_answers``
    gives them with the texts (those of failed ones lie in ``<answers>-failed``, once a batch). Arrivals that bring
    their ``text_key`` are not hashed again.

    With ``audit`` the newly scored texts are also appended to that audit table (``at``: see ``audit_rows``).
    With ``counts`` the batch's share of the counts by time ``window`` of ``ts`` and risk level is written there: see ``window_counts``.
    """
    spark = sdf.sparkSession

    def scorer(texts):
        return score_texts(texts, col=col, **scoring)

    schema = scorer(spark.createDataFrame([], f"text_key string, {col} string")).schema
    fails = can_fail(spark, **scoring)

    def answer(batch, batch_id):
        spark = batch.sparkSession
        table = Results(spark, results, schema)
        ok = with_key(split_valid(batch, col)[0], col)
        rows = ok.drop(col).persist(StorageLevel.MEMORY_AND_DISK)
        keys = rows.select("text_key").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # Dealt by bucket before they are scored: so dealt, they meet the stored keys and are stored themselves.
            new = table.dealt(distinct_texts(ok, col)).join(table.of(keys).select("text_key"), "text_key", "left_anti")
            if fails:
                # Written, so that what is stored of it does not change it.
                scored = f"{results}-scored/batch_id={batch_id}"
                scorer(new).write.mode("overwrite").option("compression", "zstd").parquet(scored)
                fresh = spark.read.schema(schema).parquet(scored)
                table.add(successes(fresh), batch_id)
            else:
                table.store(scorer(new), batch_id)
                fresh = spark.createDataFrame([], schema)
            stored = table.of(keys)
            if audit:
                append_audit(stored.filter(F.col("scored_in") == batch_id), audit, batch_id, at)
            failed = fresh.filter(F.col("error").isNotNull()).withColumn("scored_in", F.lit(batch_id).cast("long"))
            failed.select("text_key", *TEXTS).write.mode("overwrite").parquet(f"{answers}-failed/batch_id={batch_id}")
            found = stored.unionByName(failed).drop(*TEXTS)
            answered = join_unique(rows, found, "text_key", F.col(id_col))
            answered.write.mode("overwrite").parquet(f"{answers}/batch_id={batch_id}")
            if counts:
                mine = spark.read.parquet(f"{answers}/batch_id={batch_id}").withColumn("batch_id", F.lit(batch_id).cast("long"))
                share = stream_hits(mine, ts, window, id_col, ["risk_level"])
                share.write.mode("overwrite").parquet(f"{counts}/batch_id={batch_id}")
        finally:
            keys.unpersist()
            rows.unpersist()

    return sdf.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)


def read_answers(spark, answers, results, id_col="id"):
    """R2: the answers of all batches, each with its ``TEXTS``: those of its result, or for a failed text those of
    its batch."""
    rows, chosen = spark.read.parquet(answers), ["text_key", *TEXTS]
    failed = spark.read.schema(", ".join(f"{c} string" for c in chosen) + ", batch_id long").parquet(f"{answers}-failed")
    place = F.concat_ws(":", "text_key", "batch_id").alias("_place")
    bad = rows.filter(F.col("error").isNotNull()).select("*", place)
    bad = join_unique(bad, failed.select(place, *TEXTS), "_place", F.col(id_col))
    # Texts stay in their buckets, where the rows come to them; only those of hot keys are sent to their rows.
    good = rows.filter(F.col("error").isNull())
    texts = Results(spark, results, spark.read.parquet(results).schema).read().select(*chosen)
    hot = F.broadcast(hot_keys(good, "text_key"))
    found = good.join(hot, "text_key", "left_anti").join(texts, "text_key").select(*rows.columns, *TEXTS)
    often = join_unique(good.join(hot, "text_key", "left_semi"), texts.join(hot, "text_key", "left_semi"), "text_key", F.col(id_col))
    return found.unionByName(often).unionByName(bad.drop("_place"))


def window_counts(spark, counts, by=("window_start", "risk_level")):
    """Arrivals, misses and hits by time window and risk level, from the shares of all batches.

    A share is replaced when its batch is run again. A late row adds to its window whenever it
    comes; no answer is read twice."""
    shares = spark.read.parquet(counts)
    return shares.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("arrivals", "misses", "hits")])


def audit_stream(scored, path, checkpoint, at=None):
    """Append scored comments to the audit table, one folder per micro-batch."""
    return (
        scored.writeStream
        .foreachBatch(lambda batch, batch_id: append_audit(batch, path, batch_id, at))
        .option("checkpointLocation", checkpoint)
    )


def stream_hits(answers, ts="ts", window="1 hour", id_col="id", by=()):
    """Per time window of the answers of ``answer_stream`` the arrivals, the misses (the
    first arrival of a text in the batch that scored it) and the hits (all others). A text's misses are of
    one batch, so the counts of batches add up."""
    answers = with_event_time(answers, ts)
    arrival = F.struct(F.col(ts), F.col(id_col))
    first = answers.filter(F.col("batch_id") == F.col("scored_in")).groupBy("text_key").agg(F.min(arrival).alias("_first"))
    marked = join_unique(answers, first, "text_key", F.col(id_col), how="left")
    miss = F.coalesce((F.col("_first") == arrival) & (F.col("batch_id") == F.col("scored_in")), F.lit(False))
    return marked.groupBy(F.window(ts, window), *by).agg(
        F.count("*").alias("arrivals"), F.count_if(miss).alias("misses"), F.count_if(~miss).alias("hits")
    ).select(F.col("window.start").alias("window_start"), *by, "arrivals", "misses", "hits")
