"""Score arithmetic and display forms, and the stand-in scorers."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.patterns import NO_WORD_NOR_BLANK, whole_words


def hybrid_score(ml, text_score):
    """F8: weighted blend of the two scores."""
    return ml * lexicon.ML_WEIGHT + text_score * lexicon.TEXT_WEIGHT


def is_toxic(hybrid):
    """F9."""
    return hybrid > lexicon.TOXIC_ABOVE


def risk_level(hybrid):
    """HIGH, MEDIUM or LOW."""
    return (
        F.when(hybrid > lexicon.HIGH_ABOVE, "HIGH")
        .when(hybrid > lexicon.MEDIUM_ABOVE, "MEDIUM")
        .otherwise("LOW")
    )


def explanation(confidence, policy):
    """M1: the sentence shown with a score, null without one. Tenths of a percent are
    rounded as the exact binary value asks, a tie to the even digit."""
    percent = confidence * 100
    below = F.floor(percent * 10)
    # Twenty times the percentage against the odd number between two tenths, in two
    # exact parts: sixteen times on one side, four times on the other.
    gap, rest = (2 * below + 1).cast("double") - percent * 16, percent * 4
    tenths = F.when(rest > gap, below + 1).when(rest < gap, below).otherwise(below + below % 2)
    sentence = F.format_string(
        "LLM confidence: %d.%d%% - %s", F.floor(tenths / 10), tenths % 10,
        F.coalesce(policy, F.lit(lexicon.DEFAULT_ADVICE)),
    )
    return F.when(confidence.isNotNull(), sentence)


def pct(score):
    """M2: whole percent, halves up."""
    return F.floor(score * 100 + 0.5)


def pct_str(score):
    """M3: percent text of the audit page; null stays null."""
    return F.when(score.isNotNull(), F.format_string("%.0f%%", score * 100))


def lexicon_hits(col, words):
    """Number of whole words of ``col`` that are in ``words``."""
    return F.regexp_count(F.concat(F.lit(" "), col), F.lit(whole_words(words)))


def word_count(col):
    """Number of words of two or more characters."""
    spaced = F.regexp_replace(col, NO_WORD_NOR_BLANK, " ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: F.length(w) > 1))


def lexicon_rate(col, words=None):
    """Stand-in for a trained ML score: ten times the share of lexicon words
    among the words of two or more characters, at most one."""
    words = words or sorted({w for group in lexicon.STANDIN_LABELS.values() for w in group})
    return F.least(F.lit(1.0), lexicon_hits(col, words) * 10.0 / F.greatest(word_count(col), F.lit(1)))


def lexicon_scorer(col):
    """T9 stand-in for a deep text model: ``struct(label, score)``.

    The label is the word group with most hits (the earlier group on a tie,
    "toxic" without any), the score grows with the hits: 1 - 1 / (1 + hits),
    and 0.001 without any.
    """
    every = sorted({w for words in lexicon.STANDIN_LABELS.values() for w in words})
    # One scan finds the words of all groups.
    found = F.regexp_extract_all(F.concat(F.lit(" "), col), F.lit(whole_words(every)), 1)

    def result(found):
        groups = [
            F.struct(F.size(F.filter(found, lambda w: F.lower(w).isin(words))).alias("hits"), F.lit(-i).alias("order"), F.lit(label).alias("label"))
            for i, (label, words) in enumerate(lexicon.STANDIN_LABELS.items())
        ]
        best = F.array_max(F.array(*groups, F.struct(F.lit(0).alias("hits"), F.lit(1).alias("order"),
                                                     F.lit("toxic").alias("label"))))
        return F.get(F.transform(F.array(best), lambda b: F.struct(
            b["label"].alias("label"),
            F.when(b["hits"] > 0, 1 - 1 / (1 + b["hits"])).otherwise(0.001).alias("score"),
        )), 0)

    return F.get(F.transform(F.array(found), result), 0)


def batch_scorer(load, error_label="error"):
    """Wrap any Python classifier as a scorer column function.

    ``load()`` runs once per worker and returns a function from one text to
    ``(label, score)``. A text on which it raises gets a null score and the message
    in ``error``; the other rows of the batch are not affected.
    """

    @F.pandas_udf("label string, score double, error string")
    def score_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        classify = load()

        def one(text):
            try:
                label, score = classify(text)
                return label, float(score), None
            except Exception as e:  # noqa: BLE001 - a bad row must not stop the job
                return error_label, None, str(e)

        for texts in batches:
            rows = [(None, None, None) if t is None else one(t) for t in texts]
            yield pd.DataFrame(rows, columns=["label", "score", "error"])

    # So that a later filter on the result does not run the classifier a second time.
    return score_batches.asNondeterministic()
