"""Benchmark passages inside documents, by Wu-Manber multi-pattern search.

Patterns are the windows of benchmark items: ``window`` consecutive words, or a
whole item that is shorter. Texts become sequences of word numbers, and a block
is two neighbouring words. For the blocks that end a pattern's first m words
(m: the shortest pattern of a set) a shift table says how far the search may
jump; where the shift is zero, the bucket of the block's hash lists the
patterns, and comparison word by word confirms an occurrence. Patterns of equal
length form a set of their own, so a short item does not shorten the jumps of
the others.

Inside a task many texts are searched in step with numpy: long texts are cut
into overlapping stretches, and all cursors jump at once.

The tables are built once, by a task for each piece of the benchmark, and written
to the shared folder as plain arrays; search tasks read them there. A pattern is a
place in the stream of the items' word numbers, so no task holds one object a
window, and the driver sees no text.
"""

import array
import json

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import functions as F

from decorum.llm.store import Shelf, stretches

#: Bytes of an array in one row of the written tables.
CHUNK = 1 << 22
STRETCH = 512
#: Bytes that are parts of words stay (A-Z lower-cased), all others become blanks.
CLEAN = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256))


def words(text):
    """Words of a text as bytes; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(CLEAN).split()


def mixed(first, second):
    """64-bit hash of two columns of numbers."""
    both = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return both * np.uint64(0xD6E8FEB86659FD93)


def block_slots(ids, last, bits):
    """Table slots of the blocks that end at the places ``last``."""
    return mixed(ids[last - 1], ids[last]) >> np.uint64(64 - bits)


def pattern_keys(ids, last, length, bits):
    """Slot of the last block, then 40 bits of a hash of the words before it: keys
    of one bucket are neighbours, and equal patterns have equal keys."""
    before = np.zeros(len(last), dtype=np.uint64)
    for back in range(2, length):
        before = mixed(before, ids[last - back])
    return (block_slots(ids, last, bits) << np.uint64(40)) | (before >> np.uint64(24))


def pattern_set(ids, starts, items, length):
    """Tables of the patterns of ``length`` words at ``starts`` (ascending) of the
    stream ``ids``: shift table, and for each different pattern its key, one place
    of it and the items that hold it."""
    out = {}
    if length == 1:
        keys = ids[starts].astype(np.uint64)
    else:
        bits = min(24, max(18, (8 * len(starts)).bit_length()))
        out["shift"] = np.full(1 << bits, min(length - 1, 255), dtype=np.uint8)
        # Later blocks have smaller shifts and overwrite the earlier ones'.
        for at in range(1, length):
            out["shift"][block_slots(ids, starts + at, bits)] = min(length - 1 - at, 255)
        keys = pattern_keys(ids, starts + length - 1, length, bits)
    order = np.argsort(keys, kind="stable")
    keys, starts, items = keys[order], starts[order], items[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    for at in range(length):
        fresh[1:] |= ids[starts[1:] + at] != ids[starts[:-1] + at]
    other = fresh.copy()
    other[1:] |= items[1:] != items[:-1]
    return out | {"keys": keys[fresh], "starts": starts[fresh], "owners": items[other],
                  "offsets": np.append(np.flatnonzero(fresh[other]), other.sum()).astype(np.int32)}


def build(items, window):
    """(name, bytes) of the tables of some (item, text)."""
    number, stream, names, runs = {}, array.array("i"), [], {}
    for item, text in items:
        ids = [number.setdefault(w, len(number)) for w in words(text)]
        if ids:
            runs.setdefault(min(window, len(ids)), []).append((len(stream), len(ids), len(names)))
            stream.extend(ids)
            names.append(item)
    yield "words", b" ".join(number)
    yield "names", json.dumps(names).encode()
    del number
    ids = np.frombuffer(stream, dtype=np.int32) if stream else np.zeros(0, dtype=np.int32)
    yield "stream", ids.tobytes()
    for length, places in runs.items():
        starts = np.concatenate([np.arange(at, at + n - length + 1, dtype=np.int32) for at, n, _ in places])
        owners = np.repeat(np.array([i for _, _, i in places], dtype=np.int32), [n - length + 1 for _, n, _ in places])
        for name, table in pattern_set(ids, starts, owners, length).items():
            yield f"{length}.{name}", table.tobytes()


KINDS = {"shift": np.uint8, "keys": np.uint64, "starts": np.int32, "owners": np.int32, "offsets": np.int32}


class PatternSet:
    """Patterns of one length, as :func:`pattern_set` made them."""

    def __init__(self, length, stream, shift=None, *, keys, starts, owners, offsets):
        self.length, self.stream, self.shift, self.keys = length, stream, shift, keys
        self.starts, self.owners, self.offsets = starts, owners, offsets
        self.bits = 0 if shift is None else len(shift).bit_length() - 1

    def find(self, ids, lo, hi):
        """(pattern, position of its first word) of all occurrences inside the
        stretches [lo, hi) of ``ids``."""
        m = self.length
        if m == 1:
            at = np.searchsorted(self.keys, ids.astype(np.uint64))
            hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == ids.astype(np.uint64))
            return at[hit], hit
        at, end = lo + m - 1, hi
        rows, places = [], []
        while True:
            live = at < end
            at, end = at[live], end[live]
            if not len(at):
                break
            jump = self.shift[block_slots(ids, at, self.bits)]
            here = at[jump == 0]
            if len(here):
                key = pattern_keys(ids, here, m, self.bits)
                row = np.searchsorted(self.keys, key)
                while True:
                    more = row < len(self.keys)
                    more[more] = self.keys[row[more]] == key[more]
                    here, key, row = here[more], key[more], row[more]
                    if not len(here):
                        break
                    same = np.ones(len(here), dtype=bool)
                    for back in range(m):
                        same &= ids[here - back] == self.stream[self.starts[row] + (m - 1 - back)]
                    rows.append(row[same])
                    places.append(here[same] - m + 1)
                    row = row + 1
            at = at + np.maximum(jump, 1)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(rows or [none]), np.concatenate(places or [none])

    def holders(self, texts, rows):
        """Different (text, item) of the occurrences of patterns ``rows`` in ``texts``."""
        texts, rows = np.divmod(np.unique(texts * len(self.starts) + rows), len(self.starts))
        n = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(self.offsets[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return set(zip(np.repeat(texts, n).tolist(), self.owners[at].tolist()))


class Patterns:
    """All windows of a piece of the benchmark, from the tables of :func:`build`."""

    def __init__(self, tables):
        tables = dict(tables)
        self.number = {w: i for i, w in enumerate(tables.pop("words", b"").split())}
        self.names = json.loads(tables.pop("names", b"[]"))
        stream, sets = np.frombuffer(tables.pop("stream", b""), dtype=np.int32), {}
        for name, data in tables.items():
            length, table = name.split(".")
            sets.setdefault(int(length), {})[table] = np.frombuffer(data, dtype=KINDS[table])
        self.sets = [PatternSet(length, stream, **arrays) for length, arrays in sets.items()]

    def search(self, texts, named=True):
        """For each text: number of words, marks of the words inside an occurrence
        and, if ``named``, the set of items that occur."""
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        # One number that no pattern has stands between texts.
        get, flat = self.number.get, array.array("q")
        for w in split:
            flat.extend([get(x, -1) for x in w])
            flat.append(-2)
        ids = np.frombuffer(flat, dtype=np.int64)
        starts = np.cumsum(counts + 1) - counts - 1
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        items = [set() for _ in split]
        for patterns in self.sets:
            lo = np.arange(0, len(ids), STRETCH)
            hi = np.minimum(lo + STRETCH + patterns.length - 1, len(ids))
            row, place = patterns.find(ids, lo, hi)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + patterns.length, -1)
            if named:
                for text, item in patterns.holders(np.searchsorted(starts, place, side="right") - 1, row):
                    items[text].add(self.names[item])
        hit = np.cumsum(edge[:-1]) > 0
        return counts, [hit[s:s + n] for s, n in zip(starts.tolist(), counts.tolist())], items


def builder(window):
    def work(group):
        items = ((i.as_py(), t.as_py()) for i, t in zip(group["item"], group["text"]))
        rows = [(name, at // CHUNK, data[at:at + CHUNK])
                for name, data in build(items, window) for at in range(0, max(len(data), 1), CHUNK)]
        names, parts, data = zip(*rows)
        return pa.table({"piece": pa.repeat(group["piece"][0], len(rows)), "name": pa.array(names),
                         "part": pa.array(parts, pa.int32()), "data": pa.array(data, pa.binary())})

    return work


def write_tables(benchmark, id_col, text_col, window, limit, shelf):
    """Folder of the written tables and number of pieces, each of about ``limit``
    bytes of text at most (or one longer item)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total * 2 // limit) if total > limit else 1
    items = items.withColumn("piece", F.pmod(F.xxhash64("item", "text"), F.lit(count)).cast("int"))
    tables = items.groupBy("piece").applyInArrow(builder(window), "piece int, name string, part int, data binary")
    return shelf.put("tables", tables)._shelf_path, count


def load(path, piece):
    """The patterns of a piece, from the shared folder."""
    system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    rows = dataset.dataset(folder, filesystem=system, format="parquet").to_table(filter=dataset.field("piece") == piece)
    rows, parts = rows.sort_by([("name", "ascending"), ("part", "ascending")]), {}
    for name, data in zip(rows["name"].to_pylist(), rows["data"]):
        parts.setdefault(name, []).append(data.as_buffer())
    return Patterns((name, b"".join(data)) for name, data in parts.items())


def through_pieces(rows, benchmark, id_col, text_col, window, limit, worker):
    """``rows`` after a pass of ``worker(path, piece)`` for each piece of the
    benchmark. What a pass gives is written before the next, so that no task holds two pieces."""
    shelf = Shelf(rows.sparkSession, "decontaminate")
    path, count = write_tables(benchmark, id_col, text_col, window, limit, shelf)
    for piece in range(count):
        before, rows = rows, rows.mapInArrow(worker(path, piece), rows.schema)
        if piece + 1 < count:
            rows = shelf.put("rows", rows)
        if piece and piece + 1 < count:
            shelf.drop(before)
    return rows


def find_leaks(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
               window=10, limit=64_000_000):
    """One row per input row: _id, _n_words, _spans (start and end of each run of
    hit words, in words), _items (ids of the occurring items, sorted as strings).

    The tables of the benchmark are written when this is called. One of more than
    ``limit`` bytes of text is searched for in several passes, each written before the next; a task
    holds the tables of one piece. Null texts have no words;
    items without words and null item ids name nothing (the words of an item
    without an id are still hit). Repeated items count once; repeated and extra
    columns of ``docs`` are not read. Empty tables give no rows or no hits.
    """
    span, name = "array<struct<start:long,end:long>>", "array<string>"
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(0).cast("long").alias("_n_words"),
        F.array().cast(span).alias("_spans"), F.array().cast(name).alias("_items"))
    return through_pieces(rows, benchmark, item_col, item_text_col, window, limit, searcher).drop("_text")


def searcher(path, piece):
    def work(batches):
        patterns = load(path, piece)
        for batch in batches:
            for lo, hi in stretches(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                counts, hits, items = patterns.search(part.column(1).to_pylist())
                spans, names = [], []
                for hit, before, old, new in zip(hits, part.column(3).to_pylist(), part.column(4).to_pylist(), items):
                    hit = hit.copy()
                    for span in before:
                        hit[span["start"]:span["end"]] = True
                    step = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": a, "end": b} for a, b in zip(step[::2].tolist(), step[1::2].tolist())])
                    names.append(sorted(set(old) | (new - {None})))
                kinds = part.schema
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts), pa.array(spans, kinds.field(3).type),
                     pa.array(names, kinds.field(4).type)], schema=kinds)

    return work


def hit_words():
    """Number of hit words of a row of :func:`find_leaks`."""
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def items_digest():
    """SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join("_items", ","), 256)


def drop_leaks(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
               window=10, limit=64_000_000):
    """The rows of ``docs`` without any word inside an occurrence, with the
    columns of ``docs``, without a shuffle. Pieces and edge cases as in
    :func:`find_leaks`."""
    place = docs.columns.index(text_col)
    return through_pieces(docs, benchmark, item_col, item_text_col, window, limit, lambda path, piece: keeper(path, piece, place))


def keeper(path, piece, place):
    def work(batches):
        patterns = load(path, piece)
        for batch in batches:
            for lo, hi in stretches(batch.column(place)):
                _, hits, _ = patterns.search(batch.column(place)[lo:hi].to_pylist(), named=False)
                yield batch.slice(lo, hi - lo).filter(pa.array([not h.any() for h in hits], pa.bool_()))

    return work
