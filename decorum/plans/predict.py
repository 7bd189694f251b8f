"""The whole scoring pipeline."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from decorum.functions import scores as S
from decorum.operators.cleaning import split_valid
from decorum.operators.policy import map_policy, policy_table
from decorum.operators.privacy import mask_person, mask_pii
from decorum.operators.reuse import distinct_texts, first_arrivals, with_key
from decorum.plans.classify import ml_score
from decorum.plans.normalize import normalize
from decorum.session import spread

PREDICTION = ["comment", "masked_comment", "normalized_comment", "ml_score", "llm_label",
              "llm_confidence", "hybrid_score", "is_toxic", "risk_level",
              "policy_violation", "llm_explanation", "error"]


def blend(df):
    """The blended score and what follows from it."""
    hybrid = F.col("hybrid_score")
    return (
        df.withColumn("hybrid_score", S.hybrid_score(F.col("ml_score"), F.col("llm_confidence")))
        .withColumns({"is_toxic": S.is_toxic(hybrid), "risk_level": S.risk_level(hybrid)})
    )


def score_texts(df, ml=S.lexicon_rate, scorer=S.lexicon_scorer, policies=None, mode="compat",
                names=None, col="text", key="text_key"):
    """All prediction columns for a table (or stream) of texts, row by row.

    ``ml`` is a fitted pipeline or a Column function, ``scorer`` a Column function
    that gives ``struct(label, score[, error])``. Both read the normalized text.
    ``mode="compat"`` masks the normalized text, ``"strict"`` the original (P3).
    ``names``: see ``mask_person``. A text that ``scorer`` fails on
    keeps its row, with nulls and the ``error``.
    """
    out = normalize(df.withColumn("comment", F.col(col)), "comment", "normalized_comment", mode, guard=True)
    source = "comment" if mode == "strict" else "normalized_comment"
    out = mask_pii(out, source, "masked_comment")
    out = mask_person(out, "masked_comment", names, key)
    if isinstance(ml, PipelineModel):
        out = ml_score(out.drop("text"), ml, "normalized_comment")
    else:
        out = out.withColumn("ml_score", ml(F.col("normalized_comment")))
    out = out.withColumn("_text", scorer(F.col("normalized_comment")))
    has_error = "error" in out.schema["_text"].dataType.names
    out = out.withColumns({
        "llm_label": F.col("_text.label"),
        "llm_confidence": F.col("_text.score"),
        "error": F.col("_text.error") if has_error else F.lit(None).cast("string"),
    })
    out = blend(out.drop("_text"))
    policies = policies if policies is not None else policy_table(df.sparkSession)
    rest = [c for c in df.columns if c != col]
    return map_policy(out, policies).select(*rest, *PREDICTION)


def can_fail(spark, scorer=S.lexicon_scorer, **_):
    """Whether ``scorer`` gives errors, for texts it fails on."""
    result = spark.createDataFrame([], "text string").select(scorer(F.col("text")).alias("r"))
    return "error" in result.schema["r"].dataType.names


def predict(df, col="text", id_col="id", order_col=None, computed_only=False, **scoring):
    """(predictions, rejected rows). Each distinct text is scored once.

    With ``order_col`` a ``cached`` flag tells repeats from first arrivals (W1); ``computed_only`` gives
    only what ``audit_rows`` takes of them, the first arrivals of texts without an error. Texts
    cross the network on their way to be scored only; the rows that get the result back
    carry their key, and a frequent key's rows are split by adaptive execution.
    """
    ok, rejected = split_valid(df, col)
    keyed = with_key(ok, col)
    results = score_texts(distinct_texts(keyed, col), col=col, **scoring)
    if not order_col:
        return keyed.drop(col).join(results, "text_key"), rejected
    firsts = first_arrivals(keyed, order_col, id_col)
    arrival = F.struct(F.col(order_col).alias("at"), F.col(id_col).alias("id"))
    if computed_only:
        # Rows find their first arrival before they meet the texts, so these cross the network once.
        computed = keyed.drop(col).join(firsts, "text_key").filter(F.col("_first") == arrival).drop("_first")
        scored = computed.join(results.filter(F.col("error").isNull()), "text_key")
        return scored.withColumn("cached", F.lit(False)), rejected
    # One slim aggregate by key meets the results, one row per key on either side;
    # both go back to the rows in the same join. A text that failed has no result to reuse.
    results = results.join(firsts, "text_key")
    scored = keyed.drop(col).join(results, "text_key")
    cached = (F.col("_first") != arrival) & F.col("error").isNull()
    return scored.withColumn("cached", cached).drop("_first"), rejected


def predict_rows(df, col="text", partitions=None, **scoring):
    """As ``predict`` without reuse: narrow, for tables with few repeats (``partitions``:
    see ``spread``)."""
    ok, rejected = split_valid(df, col)
    return score_texts(spread(ok, partitions), col=col, **scoring), rejected
