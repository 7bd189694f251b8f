"""A recognizer of names that learns from the texts themselves.

A run of capitalised words is seen from two sides: how it is spelled (its first word) and
where it stands (the word before it, the word behind it). From a few known names and titles, each side
teaches the other in turn: places where known names stand make new names, and new names
make new places. Words that mostly stand in small letters are never names.

All rounds work on counts of (first word, word before, word behind), one aggregate of the texts.
"""

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.patterns import WORD
from decorum.functions.privacy import _NAME
from decorum.operators.privacy import mask_person
from decorum.session import small_table

#: Rules of places that are applied to a text in one pattern.
PLACES = 200
_BEFORE = rf"(?:{'|'.join(lexicon.NAME_TITLES)})\.?|\p{{Ll}}[\p{{L}}]*"
# ``*+``: a run never gives words back. It needs not to, and Java's stack would not hold the way back of a run of thousands.
_RUN = rf"(?<![{WORD}'’-])(?:({_BEFORE}) )?({_NAME})(?: {_NAME})*+(?:(?= (\p{{Ll}}[\p{{L}}]*)))?"


def name_runs(df, col):
    """(first, before, after, n): capitalised runs by their first word and their neighbours, "" without one."""
    text = F.col(col)
    parts = [F.regexp_extract_all(text, F.lit(_RUN), i) for i in (1, 2, 3)]
    rows = df.select(F.explode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("before", "first", "after"))])).alias("r"))
    return rows.groupBy("r.first", F.lower("r.before").alias("before"), "r.after").agg(F.count("*").alias("n"))


def small_words(df, col):
    """(word, small): how often a word stands in small letters."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(rf"(?<![{WORD}'’-])(\p{{Ll}}[\p{{L}}'’-]*)"), 1)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("small"))


def learn_names(df, col, folder, names=None, rounds=2, support=2, sure=0.9, share=0.5):
    """Rules (view, feature, weight) from the texts of ``df``; ``names`` are seeds (default
    ``lexicon.FIRST_NAMES``), beside the titles. Counts are kept in ``folder``.

    A place ("before" or "after" a run) is a rule if different names stand there, ``support`` at least, and of its runs that are
    known to be a name or none, ``sure`` are names. A word is a "name" if it stands in such places ``support`` times
    and in ``share`` of its places. The weight is the share of names among all runs of a place, or of such places
    among all of a name. Null texts teach nothing; without any capitalised run there are only the seeds' rules.
    """
    spark = df.sparkSession
    name_runs(df, col).write.parquet(f"{folder}/runs")
    small_words(df, col).write.parquet(f"{folder}/small")
    runs, small = spark.read.parquet(f"{folder}/runs"), spark.read.parquet(f"{folder}/small")
    seeds = names.select("name").distinct() if names is not None else small_table(spark, [(n,) for n in lexicon.FIRST_NAMES], ["name"])
    seeds = seeds.select(F.col("name").alias("first"), F.lit(1.0).alias("weight"))
    # A seed stays a name however often it stands in small letters.
    firsts = runs.groupBy("first").agg(F.sum("n").alias("n")).withColumn("word", F.lower("first"))
    usual = firsts.join(small, "word").filter(F.col("small") > F.col("n")).select("first", F.lit(True).alias("usual"))
    usual = usual.join(seeds, "first", "left_anti")
    rows = runs.join(usual, "first", "left").select("first", "n", F.coalesce("usual", F.lit(False)).alias("usual"), F.explode(F.array(
        F.struct(F.lit("before").alias("view"), F.col("before").alias("feature")),
        F.struct(F.lit("after").alias("view"), F.col("after").alias("feature")))).alias("p")).select("first", "n", "usual", "p.*")
    rows.filter(F.col("feature") != "").write.parquet(f"{folder}/places")
    rows = spark.read.parquet(f"{folder}/places")
    titles = small_table(spark, [("before", t.lower() + dot, 1.0) for t in lexicon.NAME_TITLES for dot in ("", ".")], ["view", "feature", "weight"])
    known = seeds
    for turn in range(rounds):
        marked = rows.join(known.select("first", F.lit(True).alias("name")), "first", "left")
        person, other = F.col("name").isNotNull(), F.col("name").isNull() & F.col("usual")
        places = marked.groupBy("view", "feature").agg(
            F.count_if(person).alias("kinds"), F.sum(F.when(person, F.col("n")).otherwise(0)).alias("yes"),
            F.sum(F.when(other, F.col("n")).otherwise(0)).alias("no"), F.sum("n").alias("all"))
        places = places.filter((F.col("kinds") >= support) & (F.col("yes") >= sure * (F.col("yes") + F.col("no"))))
        places = places.select("view", "feature", (F.col("yes") / F.col("all")).alias("weight"))
        places = places.join(titles, ["view", "feature"], "left_anti").unionByName(titles)
        places.write.parquet(f"{folder}/rules-{turn}")
        places = spark.read.parquet(f"{folder}/rules-{turn}")
        inside = rows.filter("NOT usual").join(places.select("view", "feature", F.lit(True).alias("rule")), ["view", "feature"], "left")
        found = inside.groupBy("first").agg(
            F.sum(F.when(F.col("rule"), F.col("n")).otherwise(0)).alias("yes"), F.sum("n").alias("all"))
        found = found.filter((F.col("yes") >= support) & (F.col("yes") >= share * F.col("all")))
        found = found.select("first", (F.col("yes") / F.col("all")).alias("weight")).join(seeds, "first", "left_anti")
        seeds.unionByName(found).write.parquet(f"{folder}/names-{turn}")
        known = spark.read.parquet(f"{folder}/names-{turn}")
    rules = known.select(F.lit("name").alias("view"), F.col("first").alias("feature"), "weight")
    return rules.unionByName(places.select("view", "feature", "weight"))


def mask_learned(df, col, rules, sure=0.9, in_row=5_000):
    """Replace the runs that the rules of ``learn_names`` call names by ``<PERSON>``: those that begin
    with a name and those in a place where ``sure`` of all runs are names (the ``PLACES`` surest)."""
    names = rules.filter("view = 'name'").select(F.col("feature").alias("name"))
    # At most PLACES short rows.
    places = rules.filter((F.col("view") != "name") & (F.col("weight") >= sure)).orderBy(F.desc("weight"), "view", "feature").limit(PLACES).collect()
    df = mask_person(df, col, names, in_row=in_row)
    run = rf"({_NAME})(?: {_NAME})*+"
    for view in ("before", "after"):
        words = "|".join(r.feature.replace(".", r"\.") for r in places if r.view == view)
        if words:
            # What follows a run is looked at from its first word only, else a long run is gone through once a word.
            later = rf"(?=\p{{Lu}})(?<!(?<![{WORD}'’-])\p{{Lu}}[\p{{L}}'’-]{{0,30}} )"
            cased = rf"(?<![{WORD}'’-])((?i:{words})) {run}" if view == "before" else rf"(?<![{WORD}'’-]){later}{run}(?= (?:{words})(?![{WORD}'’-]))"
            df = df.withColumn(col, F.regexp_replace(col, cased, "$1 <PERSON>" if view == "before" else "<PERSON>"))
    return df
