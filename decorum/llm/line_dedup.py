"""Repeated runs of lines, by a suffix array over line sequences.

Lines are numbered in sorted order, and the suffixes of the documents' line
sequences are ranked by distributed prefix doubling: the rank of the first 2w
lines at a place is the rank of the pair (rank of w lines here, rank of w lines
w further on). Only places whose run occurs at least twice go into the next
round, so the table shrinks and the rounds end with the longest repeated run.

Places of one rank after the round of width w are a longest-common-prefix
interval: they share w lines at least. Two overlapping ranks name a run of any
length between w and 2w, so runs of one content are grouped by (length, rank at
the first w lines, rank at the last w lines), and all but the first in a group
are later copies.

A maximal repeated run of at least ``min_words`` words is the union of the
shortest such runs from each of its lines on and up to each of its lines, so
these are what is compared; their union is deleted.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from decorum.llm.store import Shelf

DOC = ["_id", "_hash"]


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def ranked(classes, *keys):
    """Classes in sorted order with _rank, increasing along that order: the number
    of the range partition and the place in it."""
    return classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_rank", F.monotonically_increasing_id())


def suffix_ranks(lines, shelf):
    """(_id, _hash, _pos, _level, _rank) of each place whose next 2^_level lines
    occur at two places or more; equal ranks of a level mean equal lines."""
    classes = lines.groupBy("_line").agg(F.count("*").alias("_n")).filter("_n > 1").select("_line")
    classes = shelf.put("classes", ranked(classes, "_line"))
    level = shelf.put("level", lines.join(classes, "_line").select(*DOC, "_pos", "_rank"))
    levels, width = level.withColumn("_level", F.lit(0)), 1
    for depth in range(1, 31):
        ahead = Window.partitionBy(*DOC).orderBy("_pos").rangeBetween(width, width)
        pairs = shelf.put("pairs", level.withColumn("_next", F.max("_rank").over(ahead)).filter("_next IS NOT NULL")
                          .withColumnRenamed("_rank", "_first"))
        classes = pairs.groupBy("_first", "_next").agg(F.count("*").alias("_n")).filter("_n > 1").select("_first", "_next")
        classes = shelf.put("classes", ranked(classes, "_first", "_next"))
        if classes.isEmpty():
            break
        level = shelf.put("level", pairs.join(classes, ["_first", "_next"]).select(*DOC, "_pos", "_rank"))
        shelf.drop(pairs)
        levels = levels.union(level.withColumn("_level", F.lit(depth)))
        width *= 2
    return levels


def shortest_runs(lines, min_words):
    """(_id, _hash, _from, _to): for each line the shortest run of at least
    ``min_words`` words that starts with it, and the shortest that ends with it.
    ``lines`` needs _words and _end, the words of the document up to the line."""
    start = F.col("_end") - F.col("_words")
    none = F.lit(None).cast("int")
    place = F.col("_pos")

    def sweep(asking, key, offered, at, down):
        asks = lines.select(*DOC, key.alias("_key"), place.alias("_asks"), none.alias("_offers"))
        offers = lines.select(*DOC, at.alias("_key"), none.alias("_asks"), place.alias("_offers"))
        order = F.col("_key").desc() if down else F.col("_key").asc()
        seen = Window.partitionBy(*DOC).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
        best = (F.min if down else F.max)("_offers").over(seen)
        return asks.union(offers).withColumn("_best", best).filter("_asks IS NOT NULL AND _best IS NOT NULL").select(
            *DOC, F.col("_asks").alias(asking), F.col("_best").alias(offered))

    onward = sweep("_from", start + min_words, "_to", F.col("_end"), True)
    back = sweep("_to", F.col("_end") - min_words, "_from", start, False)
    return onward.unionByName(back).distinct()


def find_repeats(docs, id_col="doc_id", text_col="text", min_words=10, folder=None):
    """(_id, _hash, _removed): of each document with later copies of a repeated run
    the line numbers to delete. _hash is xxhash64 of the text.

    The first copy by id (null last), then _hash and line number, stays. Runs are compared
    across and inside documents; words are cut at ASCII white space. Rows with one
    id and one text are one document, a null text is one empty line, other columns are not
    read, and an empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession, "line-dedup", folder)
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("_id"), text_hash(text).alias("_hash"),
                        F.posexplode(split_lines(text)).alias("_pos", "_text"))
    lines = lines.select(*DOC, "_pos", F.unhex(F.md5("_text")).alias("_line"),
                         F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")).alias("_words"))
    order = Window.partitionBy(*DOC).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.repartition(*DOC).distinct().withColumn("_end", F.sum("_words").over(order))
    lines = shelf.put("lines", lines)
    levels = suffix_ranks(lines, shelf)
    # Only repeated lines can lie in a repeated run; a gap between them fails the look-up of its ranks.
    places = levels.filter("_level = 0").select(*DOC, "_pos")
    candidates = lines.join(places, [lines[c].eqNullSafe(places[c]) for c in (*DOC, "_pos")], "left_semi")
    runs = shortest_runs(shelf.put("candidates", candidates), min_words)
    runs = runs.withColumn("_lines", F.col("_to") - F.col("_from") + 1)
    runs = runs.withColumn("_level", F.length(F.bin("_lines")) - 1)
    runs = runs.withColumn("_second", F.expr("_to - shiftleft(1, _level) + 1"))
    for at, name in (("_from", "_head"), ("_second", "_tail")):
        named = levels.select(*[F.col(c).alias("_l" + c) for c in (*DOC, "_pos", "_level")], F.col("_rank").alias(name))
        same = (F.col("_id").eqNullSafe(F.col("_l_id")) & (F.col("_hash") == F.col("_l_hash"))
                & (F.col(at) == F.col("_l_pos")) & (F.col("_level") == F.col("_l_level")))
        runs = runs.join(named, same).drop(*[c for c in named.columns if c != name])
    spot = F.struct(F.col("_id").isNull(), "_id", "_hash", F.col("_from"))
    runs = shelf.put("runs", runs.select(*DOC, "_from", "_to", "_lines", "_head", "_tail"))
    key = ["_lines", "_head", "_tail"]
    first = shelf.put("first", runs.groupBy(*key).agg(F.count("*").alias("_n"), F.min(spot).alias("_first")).filter("_n > 1").drop("_n"))
    later = runs.join(first, key).filter(spot > F.col("_first"))
    gone = later.select(*DOC, F.explode(F.sequence("_from", "_to")).alias("_pos")).groupBy(*DOC).agg(
        F.sort_array(F.collect_set("_pos")).alias("_removed"))
    return shelf.put("gone", gone)


def drop_repeats(docs, id_col="doc_id", text_col="text", min_words=10, folder=None):
    """The rows and columns of ``docs`` with the later copies deleted from the text,
    and _n_lines and _removed (line numbers deleted), which replace columns of
    ``docs`` with these names. A null text stays null. Edge cases as in :func:`find_repeats`."""
    gone = find_repeats(docs, id_col, text_col, min_words, folder)
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_hash").alias("_gone_hash"), "_removed")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_old"))
    here = F.col("_key").eqNullSafe(F.col("_gone_id")) & (text_hash(F.col("_old")) == F.col("_gone_hash"))
    lines = split_lines(F.col("_old"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_removed"))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("_old")).otherwise(rest)
    return rows.join(gone, here, "left").select(
        *[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns
          if c not in ("_n_lines", "_removed")],
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"))
