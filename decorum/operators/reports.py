"""Audit pages and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.scores import pct, pct_str
from decorum.plans.normalize import STEPS, normalize_steps


def recent_audit(df, n=lexicon.RECENT_ROWS):
    """L1: the newest ``n`` rows, ties by id; rows without a time come last. ``newest_days`` spares
    the older days of a stored log."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(n)


def newest_days(log, n=lexicon.RECENT_ROWS, days=None):
    """L1: the days of ``log`` that hold its newest ``n`` rows; older days' files are not read.

    ``days`` has the rows (n) by log_date, such as ``read_summary``; without it they are counted, which
    reads no column of the log. Rows without a time belong to no day and come after all others.
    """
    if days is None:
        days = log.groupBy("log_date").agg(F.count("*").alias("n"))
    # A row a day: few enough for one task.
    per_day = days.groupBy("log_date").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc_nulls_last("log_date"))) - F.col("n")
    wanted = per_day.withColumn("before", before).filter(F.col("before") < n)
    oldest = wanted.agg(F.min("log_date").alias("day"), F.bool_or(F.col("log_date").isNull()).alias("timeless"))
    has_timeless = oldest.select(F.coalesce("timeless", F.lit(False))).scalar()
    return log.filter((F.col("log_date") >= oldest.select("day").scalar()) | (F.col("log_date").isNull() & has_timeless))


def iso_time(col):
    """ISO form; the fraction only when there is one."""
    fraction = F.date_format(col, "SSSSSS")
    return F.concat(
        F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
    )


def audit_view(df):
    """the rows as handed out: missing text and time become empty."""
    return df.select(
        "id",
        F.coalesce(iso_time(F.col("timestamp")), F.lit("")).alias("timestamp"),
        F.coalesce("original_text_masked", F.lit("")).alias("original_text_masked"),
        "ml_score", "llm_confidence", "hybrid_score", "risk_level", "policy_violation",
    )


def _shown(col):
    return F.when(col.isNull() | (col == ""), "—").otherwise(col)


def audit_display(df):
    """the rows as displayed, with fallbacks for missing values."""
    risk = F.col("risk_level")
    return df.select(
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("id"),
        _shown(F.date_format("timestamp", "M/d/yyyy, h:mm:ss a")).alias("time"),
        F.col("original_text_masked").alias("text"),
        _shown(pct_str(F.col("ml_score"))).alias("ml"),
        _shown(pct_str(F.col("llm_confidence"))).alias("llm"),
        _shown(pct_str(F.col("hybrid_score"))).alias("hybrid"),
        F.when(F.col("hybrid_score") > lexicon.TOXIC_ABOVE, "danger").otherwise("success").alias("colour"),
        F.when(risk.isNull() | (risk == ""), "low").otherwise(F.lower(risk)).alias("badge"),
        _shown(risk).alias("risk"),
        _shown(F.col("policy_violation")).alias("policy"),
    )


def risk_summary(df):
    """Rows and mean scores by day, risk and policy."""
    return df.groupBy("log_date", "risk_level", "policy_violation").agg(
        F.count("*").alias("n"),
        F.avg("ml_score").alias("avg_ml"),
        F.avg("llm_confidence").alias("avg_llm"),
        F.avg("hybrid_score").alias("avg_hybrid"),
    )


def risk_rollup(df):
    """Rows by day and risk, with subtotals per day and over all. ``level`` tells a
    subtotal (1: of a day, 3: of all) from a row whose day or risk is null."""
    return df.rollup("log_date", "risk_level").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("hybrid_score").alias("avg_hybrid")
    )


def evasion_report(df, col="text", mode="compat"):
    """Number of texts that each of the nine steps changed, in one pass."""
    steps = normalize_steps(df.select(col), col, mode)
    pairs = list(zip([col, *STEPS], STEPS))
    counts = steps.agg(*[F.count_if(F.col(a) != F.col(b)).alias(b) for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(name).alias("texts_changed"))
        for i, name in enumerate(STEPS, 1)
    ])
    return counts.select(F.inline(rows))


def score_long(df, id_col="id"):
    """M4: one row per score for the bar chart, in whole percent."""
    bars = F.array(*[
        F.struct(F.lit(name).alias("name"), pct(F.col(col)).alias("score"))
        for name, col in (("ML Model", "ml_score"), ("LLM (BERT)", "llm_confidence"),
                          ("Hybrid", "hybrid_score"))
    ])
    return df.select(id_col, F.inline(bars))
