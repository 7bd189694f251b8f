"""The whole rewriting chain over a table or stream."""

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions import text as T

STEPS = ["nfkd", "homoglyphs", "leet", "separators", "repetition",
         "slurs", "transpositions", "anagrams", "near_words"]


def _steps(strict, split_words):
    safe = lexicon.SAFE_WORDS + (lexicon.STRICT_SAFE_WORDS if strict else [])
    yield "nfkd", T.nfkd
    yield "homoglyphs", T.fold_homoglyphs
    yield "leet", lambda c: T.reverse_leet(c, strict=strict)
    yield "separators", lambda c: T.strip_separators(c, strict=strict)
    yield "repetition", T.reduce_repetition
    yield "slurs", lambda c: T.match_patterns(c, lexicon.SLUR_PATTERNS, strict)
    yield "transpositions", lambda c: T.match_patterns(c, lexicon.TRANSPOSITION_PATTERNS, strict)
    if split_words:
        yield "anagrams", lambda c: T.fold_anagrams(c, safe=safe)
        yield "near_words", lambda c: T.fold_near_words(c, safe=safe)
    else:
        yield "near_words", lambda c: T.fold_words(c, safe=safe)


def normalize(df, col="text", out="normalized", mode="compat", guard=False):
    """Add ``out``, the text after all nine steps.

    Narrow: no shuffle, and Python only for rows with unusual characters. Each
    step is its own projection, so that a step which looks at its input twice
    does not compute the earlier steps twice. ``mode="strict"`` spares trailing
    punctuation, plain numbers and more everyday words.

    Filters on other columns reach the scan. A filter on the result makes Spark copy the
    chain into the filter; ``guard`` prevents that by a condition that is always true but
    not deterministic, and then no later filter passes this step.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    done = df.withColumn(out, F.col(col))
    for _, step in _steps(mode == "strict", split_words=False):
        done = done.withColumn(out, step(F.col(out)))
    return done.withColumn(out, F.when(F.spark_partition_id() >= 0, F.col(out))) if guard else done


def normalize_steps(df, col="text", mode="compat"):
    """As ``normalize``, keeping the text after each step in its own column."""
    before = col
    for name, step in _steps(mode == "strict", split_words=True):
        df = df.withColumn(name, step(F.col(before)))
        before = name
    return df
