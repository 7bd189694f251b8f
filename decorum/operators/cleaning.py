"""Cleaning of labelled comments."""

import hashlib

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.text import strip_blanks


def clean_text(df, col="comment_text"):
    """lower case, blanks trimmed. A missing text stays missing."""
    return df.withColumn(col, strip_blanks(F.lower(F.col(col))))


def ensure_labels(df, extra=None):
    """in a table of more than two columns, add the label columns that are
    missing, as zeros."""
    if len(df.columns) <= 2:
        return df
    missing = [c for c in extra or lexicon.EXTRA_LABELS if c not in df.columns]
    return df.withColumns({c: F.lit(0) for c in missing})


def is_missing(raw):
    """A raw text that a CSV reader takes as missing, before or after cleaning."""
    cleaned = strip_blanks(F.lower(raw))
    return raw.isNull() | raw.isin(lexicon.RAW_NA) | cleaned.isin(lexicon.LOWER_NA)


def drop_missing(df, col="comment_text"):
    """to be applied to the raw text, before ``clean_text``."""
    return df.filter(~is_missing(F.col(col)))


def drop_blank(df, col="comment_text"):
    """F4."""
    return df.filter(strip_blanks(F.col(col)) != "")


def fill_text(df, col="comment_text", default=lexicon.EMPTY_TEXT):
    """F5."""
    return df.na.fill({col: default})


def label_int(df, col="toxic"):
    """(rows whose label is a whole number, rows whose label is not)."""
    value = F.col(col).try_cast("int")
    good = df.filter(value.isNotNull()).withColumn(col, value)
    return good, df.filter(value.isNull())


def select_xy(df, col="comment_text", label="toxic"):
    """feature and label."""
    return df.select(F.col(col).alias("text"), F.col(label).alias("label"))


def prepare(df, col="comment_text"):
    """F1-F5 in order: raw labelled comments to cleaned ones."""
    return fill_text(drop_blank(clean_text(drop_missing(ensure_labels(df), col), col), col), col)


#: The ``text_key`` of the empty text.
EMPTY_KEY = hashlib.sha256(b"").hexdigest()


def split_valid(df, col="text"):
    """(rows with a text, its ends trimmed; rejected rows with a reason).

    A table that has its ``text_key`` (see ``reuse.with_key``) holds trimmed texts already. There the key tells
    blank texts, so that rows which need no text are never joined with it.
    """
    if "text_key" in df.columns:
        key = F.coalesce("text_key", F.lit(EMPTY_KEY))
        return df.filter(key != EMPTY_KEY), df.filter(key == EMPTY_KEY).withColumn("reason", F.lit(lexicon.EMPTY_REASON))
    text = F.coalesce(strip_blanks(F.col(col)), F.lit(""))
    ok = df.filter(text != "").withColumn(col, text)
    return ok, df.filter(text == "").withColumn("reason", F.lit(lexicon.EMPTY_REASON))


def row_counts(df, col="comment_text"):
    """A1: rows before cleaning, rows each rule drops, rows after; one pass."""
    raw = F.col(col)
    missing = is_missing(raw)
    blank = ~missing & (strip_blanks(raw) == "")
    return df.agg(
        F.count("*").alias("rows_raw"),
        F.count_if(missing).alias("rows_missing"),
        F.count_if(blank).alias("rows_blank"),
        F.count_if(~missing & ~blank).alias("rows_clean"),
    )
