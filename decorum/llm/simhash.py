"""Near duplicates by SimHash fingerprints and sharded vantage-point trees.

Texts are hashed to 64-bit fingerprints; fingerprints within ``radius`` bits are
linked and documents fall into connected components.

The links are found by vantage-point trees. The upper levels are the same for
all tasks: the 64 bits are cut into fields, each with a vantage point, and a
fingerprint lives in the shard of its distances in them (rings). If two
fingerprints differ by r bits, the ring differences of the fields add up
to r at most (triangle inequality, field by field), so a fingerprint is sent as
a query to the shards within that bound, once for each pair of shards. Inside a
shard a vantage-point tree over narrower fields prunes branches by the same
bound until a leaf is small enough for direct comparison. Nothing is missed and
nothing is capped.

A shard returns a spanning forest of its links, never all pairs; the components
are joined by large-star and small-star rounds over written tables.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from decorum.llm.store import Shelf

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: One vantage point for all fields, fixed so that every task has the same.
VANTAGE = 0x9E3779B97F4A7C15
#: Fields of the trees inside a shard.
NARROW = [np.uint64(((1 << 8) - 1) << (8 * i)) for i in range(8)]
LEAF = 1 << 16
LINKS = 1 << 20


def words(text):
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(text, width, seed):
    """XXH64 of each shingle, repeats included; of the whole sequence if it has
    fewer words than a shingle; none if it has no words."""
    w = words(text)
    if not w:
        return []
    if len(w) < width:
        return [xxhash.xxh64_intdigest(b" ".join(w), seed)]
    return [xxhash.xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*[w[i:] for i in range(width)]))]


def fold(hashes, counts):
    """Fingerprints of consecutive runs of ``hashes``, ``counts`` of them each: a
    bit is set if it is set in more than half of a run. No hashes give zero.

    Eight byte-wide counters share a word, and at most 255 hashes are summed
    before the counters are widened.
    """
    counts = np.asarray(counts, dtype=np.int64)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // 255)
    starts = np.cumsum(n) - n
    first = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + inner * 255
    lanes = np.uint64(0x0101010101010101)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, cuts)
        wide = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = 2 * wide > n[:, None]
        for byte in range(8):
            out[full] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints(docs, id_col="doc_id", text_col="text", width=3, seed=42):
    """(_id, _hash, _fp): the SimHash of each row's whole text, and its xxhash64. Null
    counts as empty, and an empty text has fingerprint zero. Other columns are not read."""
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_hash"))

    def work(batches):
        for batch in batches:
            hashes, counts = [], []
            for text in batch.column(1):
                got = shingle_hashes(text.as_py(), width, seed)
                hashes.append(np.array(got, dtype=np.uint64))
                counts.append(len(got))
            prints = fold(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(prints.view(np.int64))], ["_id", "_hash", "_fp"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"_id {kind}, _hash long, _fp long")


class Forest:
    """Links among n items, kept as their connected components only."""

    def __init__(self, n):
        self.label = np.arange(n)
        self.pending, self.size = [], 0

    def add(self, u, v):
        if len(u):
            self.pending.append((u, v))
            self.size += len(u)
            if self.size > LINKS:
                self.settle()

    def settle(self):
        if not self.pending:
            return self.label
        u = np.concatenate([x for x, _ in self.pending])
        v = np.concatenate([x for _, x in self.pending])
        self.pending, self.size = [], 0
        label = self.label
        while True:
            low = np.minimum(label[u], label[v])
            new = label.copy()
            np.minimum.at(new, label[u], low)
            np.minimum.at(new, label[v], low)
            while True:
                jumped = new[new]
                if np.array_equal(jumped, new):
                    break
                new = jumped
            if np.array_equal(new, label):
                break
            label = new
        self.label = label
        return label


def search(prints, homes, queries, radius, found, level=0):
    """Find all pairs of a home and a query within ``radius`` bits.

    ``homes`` and ``queries`` are (positions in prints, bits still allowed). The
    vantage point of a node is its first home; branches whose ring lies farther
    from a query's than its allowance are pruned, and each level takes its ring
    difference off the allowance because the fields are disjoint.
    """
    spots, (asks, allowed) = homes, queries
    if not len(spots) or not len(asks):
        return
    if level == len(NARROW) or len(spots) * len(asks) <= LEAF:
        step = max(1, LEAF * 16 // len(asks))
        for at in range(0, len(spots), step):
            part = spots[at:at + step]
            near = np.bitwise_count(prints[part][:, None] ^ prints[asks][None, :]) <= radius
            i, j = np.nonzero(near)
            found.add(part[i], asks[j])
        return
    field, point = NARROW[level], prints[spots[0]]
    home_ring = np.bitwise_count((prints[spots] ^ point) & field).astype(np.int64)
    ask_ring = np.bitwise_count((prints[asks] ^ point) & field).astype(np.int64)
    for ring in np.unique(home_ring):
        left = allowed - np.abs(ask_ring - ring)
        pick = left >= 0
        search(prints, spots[home_ring == ring], (asks[pick], left[pick]), radius, found, level + 1)


def shard_links(prints, home, radius):
    """Spanning forest of the links of one shard, as two arrays of fingerprints."""
    prints = prints.view(np.uint64)
    found = Forest(len(prints))
    homes = np.flatnonzero(home)
    if len(homes):
        asks = np.arange(len(prints))
        search(prints, homes, (asks, np.full(len(asks), radius, dtype=np.int64)), radius, found)
    label = found.settle()
    tied = np.flatnonzero(label != np.arange(len(label)))
    return prints[label[tied]].view(np.int64), prints[tied].view(np.int64)


def offsets(radius, fields):
    """Ring steps from a shard to those that a query must visit; of each pair of
    shards one direction is enough."""
    span = range(-radius, radius + 1)
    return [d for d in itertools.product(span, repeat=fields)
            if sum(map(abs, d)) <= radius and d >= (0,) * fields]


def masks(fields):
    """The 64 bits cut into ``fields`` runs, as signed 64-bit masks."""
    cuts = [64 * i // fields for i in range(fields + 1)]
    plain = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in plain]


def links(prints, radius, fields):
    """(u, v): links that connect what lies within ``radius`` bits, by shard."""
    point = VANTAGE - (1 << 64) if VANTAGE >> 63 else VANTAGE
    rings = [F.bit_count(F.col("_fp").bitwiseXOR(F.lit(point)).bitwiseAND(F.lit(m))) for m in masks(fields)]
    visits = [F.struct(sum((F.lit(0).cast("long") + (ring + step + radius) * (65 + 2 * radius) ** i
                            for i, (ring, step) in enumerate(zip(rings, d)))).cast("long").alias("shard"),
                       F.lit(not any(d)).alias("home")) for d in offsets(radius, fields)]
    sent = prints.select("_fp", F.inline(F.array(*visits)))

    def work(key, table):
        u, v = shard_links(table.column("_fp").to_numpy(), table.column("home").to_numpy(), radius)
        return pa.table({"u": u, "v": v})

    return sent.groupBy("shard").applyInArrow(work, "u long, v long").distinct()


def components(edges, shelf):
    """(node, root): root is the least node that each linked node can reach.

    Large-star and small-star rounds until the edges no longer change. Least
    neighbours are pre-aggregated, and the table that goes back to the edges is
    written first, so that a hub's edges can be split between tasks.
    """

    def measure(table):
        return table.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = shelf.put("edges", edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = measure(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = shelf.put("least", both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = shelf.put("large", both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = shelf.put("low", large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = shelf.put("edges", small.union(low.select("u", F.col("m").alias("v"))).filter("u != v")
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        for old in (edges, least, large, low):
            shelf.drop(old)
        after = measure(new)
        edges = new
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_copies(docs, id_col="doc_id", text_col="text", width=3, radius=2, seed=42, fields=3, folder=None):
    """One row per input row: _id, _hash, _fp and _component, the smallest id whose
    fingerprint can be reached by links of at most ``radius`` bits.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows that share an id get one row each. Null ids are linked too but never
    name a component unless it has no other id. An empty table gives no rows.
    ``fields`` sets the number of shards: a shard holds about 1/850 of the distinct
    fingerprints with three fields, 1/4,700 with four and 1/90,000 with six, while a
    fingerprint is sent to 13, 21 and 43 shards. Shards are groups of one task, so
    raise it for more than some 10^9 distinct fingerprints.
    """
    shelf = Shelf(docs.sparkSession, "simhash", folder)
    marked = shelf.put("marked", fingerprints(docs, id_col, text_col, width, seed))
    prints = shelf.put("prints", marked.groupBy("_fp").agg(F.min("_id").alias("_first")))
    root = components(links(prints.select("_fp"), radius, fields), shelf)
    tree = shelf.put("tree", root.union(root.select("root", "root").distinct()))
    named = tree.join(prints, tree["node"] == prints["_fp"]).groupBy("root").agg(F.min("_first").alias("_component"))
    named = shelf.put("named", named)
    linked = tree.join(named, "root").select(F.col("node").alias("_fp"), "_component")
    final = prints.join(linked, "_fp", "left").select("_fp", F.coalesce("_component", "_first").alias("_component"))
    return marked.join(shelf.put("final", final), "_fp").select("_id", "_hash", "_fp", "_component")


def drop_near_copies(docs, id_col="doc_id", text_col="text", width=3, radius=2, seed=42, fields=3, folder=None):
    """The rows of ``docs`` that stay: of each component the document with the
    smallest id. Rows with one id and one text are one document and stay or go together;
    a row without an id stays only if its component has no id at all."""
    shelf = Shelf(docs.sparkSession, "simhash-drop", folder)
    found = near_copies(docs, id_col, text_col, width, radius, seed, fields, folder)
    gone = shelf.put("gone", found.filter(~F.col("_id").eqNullSafe(F.col("_component")))
                     .select(F.col("_id").alias("_gone"), F.col("_hash").alias("_gone_hash")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_key"),
                       F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_hash"))
    same = F.col("_key").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_gone_hash"))
    return rows.join(gone, same, "left_anti").select("_row.*")
