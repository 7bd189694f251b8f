"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets are shares of all words by weight, none above ``ceiling`` times its
source's size. A target is paid in blocks of about ``block`` words: the highest
quotients target / (2k - 1) over all sources win the k-th block of a source, so
every source gets an integer quota. The quota of a source is dealt to its shards
by the same rule. In a shard the documents lie in a seeded order, the words are
cut into equal blocks, and the quota picks blocks evenly spaced from a seeded
start; a quota above the number of blocks takes all blocks again.

Documents meet only inside shards of a bounded number of words, so a source with
a third of the rows is many shards.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from decorum.llm.store import Shelf

WEIGHTS = (5, 2, 1)
#: Buckets of quotients up to the mean of the last ones that win, and numbers of items ranked at once.
BUCKETS = 1 << 14
RANGE = 1 << 16


def sainte_lague(table, group, item, weight, seats, name, shelf=None):
    """Deal the seats of each group to its items: the column ``name`` is the number
    of an item's quotients weight / (2k - 1) among the group's highest.

    ``seats`` is the group's number of seats, the same in all rows of a group. An
    item's seats differ from its exact share by no more than share * (items + 1) / 2 + 1/2, so
    only the quotients near that share are looked at, about five for each item. Ties
    go to the lower item (a number). Groups without weight get no seats.

    Nothing ranks the quotients of a group. A histogram tells the bucket of the last
    quotient that wins, the values in that bucket its value. The items that tie there
    are counted in ranges of ``RANGE`` numbers, and one such range is ranked. With that
    value and the last item that wins by it, each row knows its seats. ``table`` is read
    several times. Null groups get no seats.
    """
    shelf = shelf or Shelf(table.sparkSession, "seats")
    whole = shelf.put("totals", table.groupBy(group).agg(
        F.sum(weight).alias("_total"), F.count("*").alias("_items"), F.first(seats).alias("_all")))
    part = F.col(weight) / F.col("_total")
    exact, slack = part * F.col("_all"), part * (F.col("_items") + 1) / 2 + 1
    sure, most = F.greatest(F.floor(exact - slack), F.lit(0)), F.ceil(exact + slack)
    known = whole.filter("_total > 0")
    near = table.filter(F.col(weight) > 0).join(known, group).select(
        group, F.col(item).alias("_item"), F.col(weight).alias("_w"), sure.alias("_sure"), most.alias("_most"),
        (2 * F.col("_all") / F.col("_total")).alias("_scale"))
    quotient = F.col("_w") / (2 * F.col("_k") - 1)
    quotients = near.select(group, "_w", "_scale", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k")).select(
        group, quotient.alias("_q"), F.least(F.floor(quotient * F.col("_scale") * BUCKETS), F.lit(64 * BUCKETS)).alias("_bucket"))

    def reach(counts, key, need, descending):
        """Per group the first ``key`` in order at which ``need`` rows are reached, and what is left for it."""
        order = F.col(key).desc() if descending else F.col(key).asc()
        upto = F.sum("_n").over(Window.partitionBy(group).orderBy(order))
        at = F.struct((-F.col(key) if descending else F.col(key)).alias("at"), (F.col(need) - F.col("_upto") + F.col("_n")).alias("left"))
        met = counts.withColumn("_upto", upto).filter(F.col("_upto") >= F.col(need)).groupBy(group).agg(F.min(at).alias("_at"))
        return met.select(group, (-F.col("_at.at") if descending else F.col("_at.at")).alias(key), F.col("_at.left").alias("_left"))

    need = near.groupBy(group).agg(F.sum("_sure").alias("_given")).join(known, group).select(
        group, (F.col("_all") - F.col("_given")).alias("_need")).filter("_need > 0")
    counts = quotients.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).join(need, group)
    edge = shelf.put("edge", reach(counts, "_bucket", "_need", True).withColumnRenamed("_left", "_need"))
    values = quotients.join(edge, [group, "_bucket"]).groupBy(group, "_q").agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
    last = shelf.put("last", reach(values, "_q", "_need", True).withColumnRenamed("_left", "_need"))
    # An item's quotients differ, so it ties with one of them at most.
    ties = near.join(last, group).filter(F.exists(F.sequence(F.col("_sure") + 1, F.col("_most")),
                                                  lambda k: F.col("_w") / (2 * k - 1) == F.col("_q"))).withColumn(
        "_range", F.floor(F.col("_item") / RANGE))
    ranges = ties.groupBy(group, "_range").agg(F.count("*").alias("_n"), F.first("_need").alias("_need"))
    ranges = shelf.put("ranges", reach(ranges, "_range", "_need", False))
    place = F.row_number().over(Window.partitionBy(group).orderBy("_item"))
    final = ties.join(ranges, [group, "_range"]).withColumn("_place", place).filter("_place = _left").select(
        group, F.col("_q").alias("_last"), F.col("_item").alias("_last_item"))
    cuts = shelf.put("cuts", known.join(need.select(group, "_need"), group, "left").join(final, group, "left"))
    mine = F.filter(F.sequence(F.col("_sure") + 1, F.col("_most")), lambda k: (
        (F.col(weight) / (2 * k - 1) > F.col("_last")) | ((F.col(weight) / (2 * k - 1) == F.col("_last")) & (F.col(item) <= F.col("_last_item")))))
    won = F.when(F.col("_need").isNull(), 0).when(F.col("_last").isNull(), F.col("_most") - F.col("_sure")).otherwise(F.size(mine))
    dealt = table.join(cuts, group, "left").withColumn("_sure", sure).withColumn("_most", most)
    return dealt.select(*table.columns, F.when((F.col("_total") > 0) & (F.col(weight) > 0), F.col("_sure") + won).otherwise(0).cast("long").alias(name))


def targets(sizes, ceiling=3.0, weights=WEIGHTS):
    """Sources with _rank, _weight and _target, from one row per source (_source, _size).

    Sources are ordered by code point, null last; weights repeat in that order.
    All sizes are shared by weight; a target stops at ``ceiling`` times its size
    and the excess is shared again by weight until none is above. Sources in
    order of ceiling * size / weight reach their ceilings one after the other,
    which gives that fixed point in one pass. There is one row per source.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy(F.col("_source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("_rank"), F.lit(len(weights))) + 1)
    cap = F.col("_size") * F.lit(float(ceiling))
    by_cap = whole.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.withColumn("_rank", F.row_number().over(ordered) - 1).withColumn("_weight", weight).withColumn("_cap", cap)
    left = F.sum("_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    full = ranked.withColumn("_full", F.col("_cap") * F.sum("_weight").over(after) < F.col("_weight") * left)
    rest = F.sum("_size").over(whole) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(whole)
    share = F.col("_weight") * rest / open_weight
    return full.select("_source", "_size", "_rank", "_weight",
                       F.when(F.col("_full"), F.col("_cap")).otherwise(share).alias("_target"))


def draw(*parts):
    """A seeded number below 2^60, from MD5 so that other engines draw alike. Nulls are skipped."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def times(block):
    """How often the mix takes a block of its shard: quota / blocks, evenly spaced."""
    passed = lambda n: F.floor(((n + F.col("_start")) * F.col("_quota")) / F.col("_blocks"))
    return (passed(block + 1) - passed(block)).cast("long")


def edge(block):
    """First word of a block: equal blocks, their ends rounded down."""
    return F.floor((block * F.col("_words")) / F.col("_blocks")).cast("long")


def plan(docs, id_col="doc_id", text_col="text", source_col="source", size=None, block=32, shard_words=1 << 18,
         ceiling=3.0, weights=WEIGHTS, seed=17, folder=None):
    """One row per input row with its place in the mix: _id, _source, _size,
    _source_size, _target, _at (its first word in its shard), and the shard's
    _words, _blocks, _quota and _start.

    ``size`` counts the words of a text (default: runs of what is not ASCII white
    space). Null and empty texts have size 0. A null source is a source. Repeated
    rows count each; rows that share an id lie in one shard, and their order only
    swaps equal ids. An empty table gives no rows.
    """
    shelf = Shelf(docs.sparkSession, "mixing", folder)
    count = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")) if size is None else size
    slim = shelf.put("sizes", docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
        F.coalesce(count, F.lit(0)).cast("long").alias("_size"), draw(F.lit(seed), F.col(id_col)).alias("_draw")))
    per_source = slim.groupBy("_source").agg(F.sum("_size").alias("_size"))
    aims = shelf.put("aims", targets(per_source, ceiling, weights).withColumn("_mix", F.lit(0)).withColumn(
        "_blocks", F.round(F.sum("_target").over(Window.partitionBy(F.lit(0))) / block).cast("long")))
    aims = sainte_lague(aims, "_mix", "_rank", "_target", "_blocks", "_seats", shelf)
    aims = shelf.put("targets", aims.select("_source", F.col("_size").alias("_source_size"), "_target", "_seats",
                                            F.ceil(F.greatest("_size", F.lit(1)) / shard_words).alias("_shards"), "_rank"))
    # One row per source; spread over the rows by whichever join fits its size.
    dealt = slim.join(aims, slim["_source"].eqNullSafe(aims["_source"])).select(
        slim["*"], "_rank", F.pmod("_draw", "_shards").alias("_shard"))
    dealt = shelf.put("dealt", dealt)
    shards = dealt.groupBy("_rank", "_shard").agg(F.sum("_size").alias("_words")).join(
        aims.select("_rank", "_seats", "_source_size", "_target"), "_rank")
    shards = sainte_lague(shelf.put("words", shards), "_rank", "_shard", "_words", "_seats", "_quota", shelf)
    blocks = F.greatest(F.round(F.col("_words") / block), F.lit(1)).cast("long")
    shards = shelf.put("shards", shards.withColumn("_blocks", blocks).select(
        "_rank", "_shard", "_words", "_blocks", "_source_size", "_target",
        F.least("_quota", (F.col("_blocks") * ceiling).cast("long")).alias("_quota"),
        F.pmod(draw(F.lit(seed), F.col("_rank"), F.col("_shard")), "_blocks").alias("_start")))
    line = Window.partitionBy("_rank", "_shard").orderBy("_draw", "_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_at", F.coalesce(F.sum("_size").over(line), F.lit(0)))
    return placed.join(shards, ["_rank", "_shard"])


def overlaps():
    """Blocks that share words with a row of :func:`plan`, as (from, to, times):
    words of the document, counted from 0, and how often they are taken."""
    last = F.col("_at") + F.col("_size")
    find = lambda x: F.floor(((x + 1) * F.col("_blocks") - 1) / F.col("_words")).cast("long")
    spans = F.transform(F.sequence(find(F.col("_at")), find(last - 1)), lambda b: F.struct(
        (F.greatest(edge(b), F.col("_at")) - F.col("_at")).alias("from"),
        (F.least(edge(b + 1), last) - F.col("_at")).alias("to"), times(b).alias("times")))
    empty = F.array().cast("array<struct<from:bigint,to:bigint,times:bigint>>")
    return F.when(F.col("_size") > 0, spans).otherwise(empty)


def mix(docs, **options):
    """:func:`plan` with _spans (see :func:`overlaps`) and _taken, the words that
    the mix takes from the document, repeats counted. No document exceeds
    ``ceiling`` times its size."""
    spans = plan(docs, **options).withColumn("_spans", overlaps())
    taken = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"]) * s["times"])
    return spans.select("_id", "_source", "_size", "_source_size", "_target", "_spans", taken.alias("_taken"))
