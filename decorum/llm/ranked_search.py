"""Ranked lexical search by K2-treaps over the term-document grid.

A shard is a range of documents. Its grid has a row for every term that an item asks for
and a column for every document, by rising id. The grid is cut into quadrants again and
again; only quadrants with a posting are kept, each with the largest impact inside, stored as what it
lacks to its parent's. The rows of terms lie apart, so that small quadrants hold one term.

An item follows the paths of all its rows at once: a range of documents has the bound
that the quadrants of the paths give it, weighted by term. The ranges with the highest bounds
are halved first; at a single document the bound is its score. A range below the
k-th score found so far is left.
"""

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from decorum.llm.decontaminate import words
from decorum.llm.store import Shelf, stretches

#: Rows lie 2 ** APART places from each other: a quadrant of that width holds one term.
APART = 5
#: Number of bits below a place in a mask of four.
BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.int8)


def spread_bits(x):
    """The bits of ``x`` (below 2 ** 31) at the even places of a 62-bit number."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


class Treap:
    """A grid's quadrants, level by level: ``masks`` says which of a quadrant's four parts
    exist, ``most`` is its largest impact, ``child`` the number of its first part. The last level has
    the postings."""

    def __init__(self, sizes, masks, lacks):
        self.height = len(sizes) - 1
        self.masks = masks
        inner = len(masks)
        count = BELOW[masks, 3] + (masks >> 3)
        self.child = 1 + np.cumsum(count, dtype=np.int64) - count
        self.most = np.zeros(int(sum(sizes)), np.int64)
        self.most[:1] = lacks[:1]
        at = 0
        for here, after in zip(sizes[:-1], sizes[1:]):
            parent = np.repeat(np.arange(at, at + here), count[at:at + here])
            at += here
            self.most[at:at + after] = self.most[parent] - lacks[at:at + after]
        assert inner + sizes[-1] == len(lacks)

    @staticmethod
    def pack(row, column, impact, rows, columns):
        """(sizes, masks, lacks) of the levels, from the top, of postings without repeats."""
        height = max(1, int(max(rows - 1, 0)).bit_length() + APART, int(max(columns - 1, 0)).bit_length())
        code = spread_bits(row << APART) << 1 | spread_bits(column)
        order = np.argsort(code, kind="stable")
        code, most = code[order], impact[order].astype(np.int64)
        levels = []
        for _ in range(height):
            up = code >> 2
            begin = np.flatnonzero(np.append(True, up[1:] != up[:-1])) if len(up) else np.zeros(0, np.int64)
            best = np.maximum.reduceat(most, begin) if len(up) else most
            mask = np.bitwise_or.reduceat(1 << (code & 3), begin).astype(np.uint8) if len(up) else np.zeros(0, np.uint8)
            lack = np.repeat(best, np.diff(begin, append=len(up))) - most
            levels.append((len(code), mask, lack))
            code, most = up[begin], best
        levels = levels[::-1]
        sizes = [len(code), *[n for n, _, _ in levels]]
        lacks = np.concatenate([most, *[lack for _, _, lack in levels]]).astype(np.int32)
        return sizes, np.concatenate([mask for _, mask, _ in levels]), lacks

    def search(self, row, weight, k, floor=0, some=64):
        """The ``k`` best (score, column) of a set of rows, ties to the lower column. ``floor``: a
        score below which nothing is wanted."""
        none = np.zeros(0, np.int64)
        if not len(self.masks) or not len(row):
            return none, none
        place = row.astype(np.int64) << APART
        bound = np.array([(weight * self.most[0]).sum()])
        cells, begin, level = np.zeros((1, len(row)), np.int64), none[:0].copy(), np.zeros(1, np.int64)
        begin = np.zeros(1, np.int64)
        score, column = none, none
        least, last = max(floor, 1), np.iinfo(np.int64).max
        while True:
            live = (bound > least) | ((bound == least) & (begin < last))
            if not live.all():
                bound, cells, begin, level = bound[live], cells[live], begin[live], level[live]
            if not len(bound):
                break
            if len(bound) > some:
                mixed = np.argpartition(-bound, some)
                pick, rest = mixed[:some], mixed[some:]
            else:
                pick, rest = np.arange(len(bound)), none
            here, depth, start = cells[pick], level[pick], begin[pick]
            there = here >= 0
            inside = np.where(there, here, 0)
            mask, first = self.masks[inside], self.child[inside]
            down = self.height - 1 - depth
            side = (place[None, :] >> down[:, None]) & 1
            new = []
            for half in (0, 1):
                quarter = 2 * side + half
                met = there & ((mask >> quarter) & 1 > 0)
                part = np.where(met, first + BELOW[mask, quarter], -1)
                worth = (np.where(met, self.most[np.maximum(part, 0)], 0) * weight).sum(1)
                new.append((worth, part, start + (half << down), depth + 1))
            worth, part, start, depth = [np.concatenate(x) for x in zip(*new)]
            done = depth == self.height
            if done.any():
                score, column = np.append(score, worth[done]), np.append(column, start[done])
                best = np.lexsort((column, -score))[:k]
                score, column = score[best], column[best]
                score, column = score[score > 0], column[score > 0]
                if len(score) == k and score[-1] >= least:
                    least, last = score[-1], column[-1]
                worth, part, start, depth = worth[~done], part[~done], start[~done], depth[~done]
            bound, cells = np.append(bound[rest], worth), np.concatenate([cells[rest], part])
            begin, level = np.append(begin[rest], start), np.append(level[rest], depth)
        good = score >= max(floor, 1)
        return score[good], column[good]


def item_blocks(items, id_col, text_col, limit):
    """[(item, its terms)] for the driver, block by block: of about ``limit`` terms with
    repeats by item, or one longer item."""
    def work(batches):
        for batch in batches:
            for lo, hi in stretches(batch.column(1)):
                found = [sorted(set(words(t))) for t in batch.column(1)[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    rows = rows.mapInArrow(work, f"item {kind}, terms array<binary>").filter(F.size("terms") > 0)
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    count = max(1, -(-total * 2 // limit)) if total > limit else 1
    for k in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        terms = {}
        for row in part.orderBy("item").collect():
            terms.setdefault(row["item"], set()).update(map(bytes, row.terms))
        yield [(item, sorted(some)) for item, some in terms.items()]


def postings(docs, shared, id_col, text_col):
    """(id, n, rows, tfs) of the documents with a term: all their terms, and which of the
    broadcast terms they hold how often."""
    def work(batches):
        number = {term: i for i, term in enumerate(shared.value)}
        width = max(len(number), 1)
        for batch in batches:
            for lo, hi in stretches(batch.column(1)):
                split = [words(t) for t in batch.column(1)[lo:hi].to_pylist()]
                size = np.array([len(w) for w in split], np.int64)
                found = np.fromiter((x for w in split for x in map(number.get, w, repeat(-1))), np.int64, size.sum())
                owner = np.repeat(np.arange(len(split)), size)[found >= 0]
                code, tf = np.unique(owner * width + found[found >= 0], return_counts=True)
                cuts = pa.array(np.searchsorted(code // width, np.arange(len(split) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (code % width, tf)]
                full = pa.array(size > 0)
                yield pa.RecordBatch.from_arrays(
                    [c.filter(full) for c in (batch.column(0)[lo:hi], pa.array(size), *lists)], ["id", "n", "rows", "tfs"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n long, rows array<int>, tfs array<int>")


def build_index(posted, order, n_docs, n_terms, docs_per_shard=4096, postings_per_shard=1 << 19):
    """One treap a row: ids (rising, nulls last), sizes, masks and lacks of its levels.

    ``order`` gives every term its row. A shard has at most ``docs_per_shard`` documents and, but for
    its last document, ``postings_per_shard`` postings, which bounds a row of the index.
    """
    kind = posted.schema["id"].dataType.simpleString()

    def shard(parts):
        table = pa.Table.from_batches(parts)
        table = table.take(pc.sort_indices(table, [("id", "ascending")])).combine_chunks()
        held = np.diff(table["rows"].combine_chunks().offsets.to_numpy())
        row, tf = [table[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("rows", "tfs")]
        column = np.repeat(np.arange(len(held)), held)
        # Python's integers: the product may pass 64 bits.
        m = np.array([10 + 90 * n * n_docs // n_terms for n in table["n"].to_pylist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[column])
        sizes, masks, lacks = Treap.pack(order[row], column, impact, len(order), len(held))
        ids = table["id"].combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([sizes], pa.list_(pa.int64())), pa.array([masks.tobytes()], pa.binary()), pa.array([lacks.tobytes()], pa.binary())],
            ["ids", "sizes", "masks", "lacks"])

    def work(batches):
        parts, docs, size = [], 0, 0
        for batch in batches:
            held = np.diff(batch.column(2).offsets.to_numpy())
            lo = 0
            for hi in range(1, batch.num_rows + 1):
                docs, size = docs + 1, size + held[hi - 1]
                if docs == docs_per_shard or size >= postings_per_shard:
                    yield shard([*parts, batch.slice(lo, hi - lo)])
                    parts, docs, size, lo = [], 0, 0, hi
            if lo < batch.num_rows:
                parts.append(batch.slice(lo))
        if parts:
            yield shard(parts)

    return posted.mapInArrow(work, f"ids array<{kind}>, sizes array<long>, masks binary, lacks binary")


def search_index(index, queries, item_kind, k):
    """(item, id, score): of each item the ``k`` best of every task's shards. ``queries`` is a broadcast
    list of (item, rows, weights)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def work(batches):
        best = [[] for _ in queries.value]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes = batch.column(0)[i].values, batch.column(1)[i].as_py()
                masks, lacks = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.uint8), (3, np.int32))]
                treap = Treap(sizes, masks, lacks)
                for found, (_, row, weight) in zip(best, queries.value):
                    floor = found[-1][0] if len(found) == k else 0
                    score, column = treap.search(row, weight, k, floor)
                    found += [(int(s), ids[int(c)].as_py()) for s, c in zip(score, column)]
                    found.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
                    del found[k:]
        rows = [(item, x, s) for found, (item, _, _) in zip(best, queries.value) for s, x in found]
        yield pa.RecordBatch.from_pylist([dict(zip(("item", "id", "score"), r)) for r in rows], schema=schema)

    frame = index.sparkSession.createDataFrame([], f"item {item_kind}, id {kind}, score long")
    schema = to_arrow_schema(frame.schema)
    return index.mapInArrow(work, frame.schema)


def weight_of(df, n_docs):
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs, items, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", k=10, limit=1 << 18,
           folder=None):
    """The ``k`` best documents of each item: _item, _rank, _id, _score; scores above 0, ties by
    rising id (a null id last).

    Items are worked off in blocks of about ``limit`` terms, which bounds what is broadcast; each
    block has its own index, of its terms, over all documents. Rows of equal item id are one item
    with the terms of all; a null id is one too. Null and empty texts, and those without a term,
    are no documents and no items. Repeated documents are ranked each, long texts are read whole, other
    columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "ranked-search", folder)
    found, kind, totals = [], items.schema[item_col].dataType.simpleString(), None
    for block in item_blocks(items, item_col, item_text_col, limit):
        terms = sorted({t for _, some in block for t in some})
        posted = shelf.put("postings", postings(docs, spark.sparkContext.broadcast(terms), id_col, text_col))
        if totals is None:
            totals = posted.agg(F.count("*"), F.sum("n")).first()
        # One row per term of the block at most.
        df = np.zeros(len(terms), np.int64)
        for row in posted.select(F.explode("rows").alias("term")).groupBy("term").count().collect():
            df[row.term] = row["count"]
        # Rows by falling document frequency: neighbours in the grid weigh about the same.
        order = np.empty(len(terms), np.int64)
        order[np.argsort(-df, kind="stable")] = np.arange(len(terms))
        index = shelf.put("index", build_index(posted, order, totals[0], totals[1] or 1))
        shelf.drop(posted)
        number, queries = {t: i for i, t in enumerate(terms)}, []
        for item, some in block:
            at = np.array([number[t] for t in some if df[number[t]]], np.int64)
            weight = np.array([weight_of(int(x), totals[0]) for x in df[at]], np.int64)
            queries.append((item, order[at], weight))
        found.append(shelf.put("found", search_index(index, spark.sparkContext.broadcast(queries), kind, k)))
        shelf.drop(index)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    ranked = every.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return ranked.select(F.col("item").alias("_item"), "_rank", F.col("id").alias("_id"), F.col("score").alias("_score"))
