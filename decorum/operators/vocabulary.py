"""Dictionary look-ups for a whole vocabulary, as joins.

The dictionaries are tables and may be of any size: no side is forced to be
broadcast, Spark does it when the table is small.
"""

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.text import osa_within_1, sorted_letters
from decorum.operators.features import term_rows
from decorum.session import small_table


def words(df, col="text"):
    """(word, n): distinct lower-case words of letters and their number."""
    found = F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"\p{L}+"), 0)
    return term_rows(df, found).groupBy(F.col("term").alias("word")).agg(F.count("*").alias("n"))


def lexicon_table(spark, entries=None):
    """(ord, lexicon_word) of a word list."""
    return small_table(spark, enumerate(entries or lexicon.TOXIC_WORDS), ("ord", "lexicon_word"))


def word_table(spark, entries):
    return small_table(spark, [(w,) for w in entries], ("word",))


def _with_deletions(word):
    """A word and the word with each of its letters left out."""
    return F.array_distinct(F.concat(
        F.array(word),
        F.transform(
            F.sequence(F.lit(1), F.length(word)),
            lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, F.length(word))),
        ),
    ))


def fuzzy_lexicon_join(vocabulary, entries):
    """For each word the first entry at distance one, swaps included.

    Two words within one edit share the word or the word less one letter, so an
    equi-join on these forms finds every pair and no others but near ones; the exact
    test follows.
    """
    left = vocabulary.withColumn("form", F.explode(_with_deletions(F.col("word"))))
    right = entries.withColumn("form", F.explode(_with_deletions(F.col("lexicon_word"))))
    pairs = left.join(right, "form").filter(osa_within_1(F.col("word"), F.col("lexicon_word")))
    first = F.min(F.struct("ord", "lexicon_word"))
    return (
        pairs.groupBy("word").agg(first.alias("first"))
        .select("word", F.col("first.lexicon_word").alias("lexicon_word"))
    )


def anagram_lexicon_join(vocabulary, entries):
    """Words with the letters of an entry (the last such entry, as a dictionary
    keeps it) that are not that entry themselves."""
    by_key = (
        entries.groupBy(sorted_letters(F.col("lexicon_word")).alias("letters"))
        .agg(F.max(F.struct("ord", "lexicon_word")).alias("last"))
        .select("letters", F.col("last.lexicon_word").alias("lexicon_word"))
    )
    keyed = vocabulary.withColumn("letters", sorted_letters(F.col("word")))
    return keyed.join(by_key, "letters").filter("word <> lexicon_word").drop("letters")


def exclude_words(vocabulary, safe):
    """Words that are not in the table ``safe``."""
    return vocabulary.join(safe, "word", "left_anti")
