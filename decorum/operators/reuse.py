"""Score each distinct text once and reuse the result.

Texts are identified by their SHA-256, so the wide text crosses the network only on
its way to be scored.
"""

from pyspark.sql import functions as F

from decorum.operators.skew import join_unique


def text_key(col):
    return F.sha2(col, 256)


def with_key(df, col="text"):
    """Add ``text_key`` unless it is there already, of texts whose ends are trimmed (see ``split_valid``)."""
    return df if "text_key" in df.columns else df.withColumn("text_key", text_key(F.col(col)))


def distinct_texts(df, col="text"):
    """(text_key, text), each text once. Copies are dropped before the shuffle. The text is a
    grouping key rather than an aggregate, so it is hashed and not sorted."""
    return with_key(df, col).select("text_key", col).distinct()


def first_arrivals(keyed, order_col, id_col):
    """(text_key, _first): time and id of the first arrival, pre-aggregated. ``keyed``
    has its text_key; the text itself is not read."""
    arrival = F.struct(F.col(order_col).alias("at"), F.col(id_col).alias("id"))
    return keyed.groupBy("text_key").agg(F.min(arrival).alias("_first"))


def score_distinct(df, scorer, col="text", id_col="id"):
    """Run ``scorer`` (a function from a table with ``col`` to the same table
    with more columns) on distinct texts, and give every row the result of its text.

    Every text is scored once, however frequent; only its result is repeated, over the
    salts of a hot text, so that the rows of one never meet in one task.
    """
    keyed = with_key(df, col)
    return join_unique(keyed.drop(col), scorer(distinct_texts(keyed, col)), "text_key", F.col(id_col))


def new_texts(df, prior, col="text"):
    """Distinct texts of ``df`` that have no row in ``prior`` (keyed by text_key)."""
    return distinct_texts(df, col).join(prior.select("text_key"), "text_key", "left_anti")


def score_new(df, prior, scorer, col="text", id_col="id"):
    """Reuse earlier results (``prior``: one row per text_key), score the rest.

    Adds ``reused``: did the result come from ``prior``? A row of ``prior`` with an
    error is no result: its text is scored again. The rows get their result back without
    the text, which the results hold as ``comment``.
    """
    prior = successes(prior)
    fresh = scorer(new_texts(df, prior, col)).drop(col).withColumn("reused", F.lit(False))
    texts = distinct_texts(df, col).select("text_key")
    known = prior.join(texts, "text_key", "left_semi").withColumn("reused", F.lit(True))
    results = known.unionByName(fresh.select(known.columns))
    return join_unique(with_key(df, col).drop(col), results, "text_key", F.col(id_col))


def successes(results):
    """results without an error; only these are reused."""
    return results.filter(F.col("error").isNull()) if "error" in results.columns else results


def with_cached_flag(df, order_col="ts", col="text", id_col="id"):
    """``cached`` is true for the second and later arrivals of a text.

    The first arrival is an aggregate that combines before the shuffle; unlike a
    ranking window it never sorts all copies of a text in one task.
    """
    keyed = with_key(df, col)
    arrival = F.struct(F.col(order_col).alias("at"), F.col(id_col).alias("id"))
    marked = join_unique(keyed, first_arrivals(keyed, order_col, id_col), "text_key", F.col(id_col))
    return marked.withColumn("cached", F.col("_first") != arrival).drop("_first")


def cache_stats(df, col="text"):
    """A2: misses are the distinct texts, hits all further arrivals. ``df`` holds the valid
    arrivals, stripped (see ``split_valid``)."""
    per_text = with_key(df, col).groupBy("text_key").agg(F.count("*").alias("rows"))
    return per_text.agg(
        (F.coalesce(F.sum("rows"), F.lit(0)) - F.count("*")).alias("hits"),
        F.count("*").alias("misses"),
    )
