"""Hot keys: find them, and salt them so that no task gets all copies of one key."""

from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows. So there are at most
# 2,000 hot keys whatever the data, and at most 2 x 2,000 salted copies of them.
HOT_SHARE = 1 / 2_000


def hot_keys(df, key, share=HOT_SHARE, at_least=1_000):
    """(key, salts) for the hot keys: how many parts each is to be cut into.

    The count is pre-aggregated before its shuffle. The result has at most
    ``1 / share`` rows, which bounds its broadcast.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    limit = counts.agg(
        F.greatest(F.lit(at_least), F.ceil(F.coalesce(F.sum("rows"), F.lit(0)) * share)).alias("limit")
    )
    hot = counts.filter(F.col("rows") > limit.scalar())
    return hot.select(key, F.ceil(F.col("rows") / limit.scalar()).alias("salts"))


def add_salt(df, hot, key, spread_by, out="salt"):
    """Add ``out``: zero, or for a hot key a number below its salts that depends on
    ``spread_by`` only, so that it is the same wherever it is computed."""
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("salts")), F.lit(0))
    return df.join(F.broadcast(hot), key, "left").withColumn(out, salt).drop("salts")


def join_unique(left, right, key, spread_by, how="inner", share=HOT_SHARE, at_least=1_000):
    """Equi-join with a right side that holds each key once.

    Left rows of a hot key are spread over its salts; the one right row of that key
    is repeated once per salt.
    """
    hot = hot_keys(left, key, share, at_least)
    salted = add_salt(left, hot, key, spread_by, "_salt")
    repeated = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")
