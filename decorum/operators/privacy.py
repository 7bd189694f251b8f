"""Personal data in tables."""

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.privacy import count_entity, mask_entity, mask_names, name_tokens
from decorum.operators.reuse import text_key
from decorum.operators.skew import join_unique


def mask_pii(df, col="text", out="masked", entities=None):
    """Replace e-mail addresses, SSNs and phone numbers by ``<TYPE>``, most
    specific type first, one projection each. The recognizers are ours. ``entities``
    picks some of ``lexicon.PII_ENTITIES``; names are masked by ``mask_person``."""
    unknown = set(entities or ()) - set(lexicon.PII_ENTITIES)
    if unknown:
        raise ValueError(f"unknown entities {sorted(unknown)}")
    df = df.withColumn(out, F.col(col))
    for name in lexicon.PII_PATTERNS:
        if entities is None or name in entities:
            df = df.withColumn(out, mask_entity(F.col(out), name))
    return df


def mask_person(df, col, names=None, id_col=None, in_row=5_000):
    """Names from the table ``names`` (column ``name``; default
    ``lexicon.FIRST_NAMES``), with the capitalised words that follow them. ``names`` may also be a
    function from Column to Column: a recognizer of the caller's own. ``operators.names``
    learns names from texts.

    Up to ``in_row`` names become literals (they are collected while the plan is built) and are masked
    row by row, on streams too. A larger table meets the distinct capitalised words of each distinct text in a
    join, in which frequent words and frequent texts are salted; the result is the same. A stream
    cannot take it: give such a stream fewer names. ``id_col`` is not used any more.
    """
    if callable(names):
        return df.withColumn(col, names(F.col(col)))
    if names is None:
        known = lexicon.FIRST_NAMES
    else:
        names = names.select("name").filter("name IS NOT NULL").distinct()
        # At most in_row + 1 short rows.
        known = [r.name for r in names.limit(in_row + 1).collect()]
    if len(known) <= in_row:
        found = F.filter(name_tokens(F.col(col)), lambda t: t.isin(known)) if known else F.array().cast("array<string>")
        return df.withColumn(col, mask_names(F.col(col), F.sort_array(found)))
    if df.isStreaming:
        raise ValueError(f"a stream takes at most {in_row} names")
    # Texts, not rows, are the key: ids may be null or repeat.
    keyed = df.withColumn("_key", text_key(F.col(col)))
    tokens = keyed.select("_key", F.explode(name_tokens(F.col(col))).alias("name")).distinct()
    found = join_unique(tokens, names, "name", F.col("_key")).groupBy("_key")
    found = found.agg(F.sort_array(F.collect_set("name")).alias("_names"))
    met = F.coalesce("_names", F.array().cast("array<string>"))
    marked = join_unique(keyed.withColumn("_row", F.monotonically_increasing_id()), found, "_key", F.col("_row"), how="left")
    return marked.withColumn(col, mask_names(F.col(col), met)).select(*df.columns)


def pii_summary(df, col="text"):
    """A10: texts and entities by type, in one pass. Counted as ``mask_pii`` finds
    them: what an earlier type took is gone for the later ones."""
    df = df.select(F.col(col).alias("_left"))
    for name in lexicon.PII_PATTERNS:
        df = df.withColumn(name, count_entity(F.col("_left"), name))
        df = df.withColumn("_left", mask_entity(F.col("_left"), name))
    totals = df.agg(*[
        F.struct(F.count_if(F.col(name) > 0).alias("texts"),
                 F.coalesce(F.sum(name), F.lit(0)).alias("entities")).alias(name)
        for name in lexicon.PII_PATTERNS
    ])
    rows = F.array(*[
        F.struct(F.lit(name).alias("entity"), F.col(name)["texts"].alias("texts"),
                 F.col(name)["entities"].alias("entities"))
        for name in lexicon.PII_PATTERNS
    ])
    return totals.select(F.inline(rows))
