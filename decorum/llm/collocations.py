"""Collocations: phrases whose words occur together more often than apart, counted by
vertical partitioning of suffixes.

Every word begins a suffix of at most ``longest`` words inside its piece of text. Its prefixes
are taken in turn: words are counted first, then, by hash, the longer prefixes. A prefix that occurs
less than ``least`` times ends its suffixes; one that occurs more often than the memory budget
allows is extended by a word. The prefixes that are left are dealt to groups of about that
budget. Each group is independent: a task gathers its suffixes, copies summed up, sorts them and
builds the subtree level by level, cut at ``longest`` words; a node's count is the total of
its leaves. Nodes above an extended prefix have leaves in several groups and are summed up at the end.

Which words and prefixes are frequent reaches the tasks as bit maps of fixed size. A bit may be
shared, so now and then a rare one passes; it is counted like any other and dropped at the end.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from decorum.llm.store import Shelf, stretches

NO_LANG = "und"
#: A-Z to a-z, ends of pieces to full stops; blanks are spaces and tabs.
CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: log2 of the bits of a map: 16 MB, and its parts of 2 ** 15 bits come as rows.
BITS = 27
PART = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)


def pair_hash(first, second):
    """Hash of two words from theirs; their order matters."""
    return ((first * MIX) ^ (second + MIX)) * np.uint64(0xD6E8FEB86659FD93)


def slot(h):
    """Place of a hash in a bit map."""
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def summed(keys, counts):
    """Different keys, rising, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts[order], begin) if len(keys) else counts


class Words(dict):
    """Numbers of the words of one language, with hash and, if a bit map is given, whether
    the word may be frequent. Number 0 is the end of a piece."""

    def __init__(self, lang, bits=None):
        super().__init__({b".": 0})
        self.names, self.fresh = [b"."], []
        self.stale = False
        self.seed, self.bits = zlib.crc32(lang.encode("utf-8", "surrogatepass")), bits
        self.hashes, self.often = np.zeros(1, np.uint64), np.zeros(1, bool)

    def __missing__(self, word):
        number = self[word] = len(self.names)
        self.names.append(word)
        self.fresh.append(word)
        return number

    def number(self, texts):
        """Word numbers of texts; every text ends with 0."""
        raw = b" . ".join([*texts, b""]).translate(CLEAN)
        found = raw.replace(b".", b" . ").split()
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.fresh:
            new = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in self.fresh], np.uint64)
            self.hashes = np.append(self.hashes, new)
            if self.bits is not None:
                self.often = np.append(self.often, has(self.bits, slot(new)))
            self.fresh = []
        return out


def has(bits, place):
    return (bits[place >> 3] >> (place & 7)) & 1 > 0


def by_language(batches, bits=None, most=400_000):
    """(language, its Words, word numbers) of the texts of a stretch, language by language.
    Words are numbered anew when there are more than ``most``."""
    known = {}
    for batch in batches:
        for lo, hi in stretches(batch.column("_text"), 1 << 21):
            langs, texts = batch.column("_lang")[lo:hi].to_pylist(), batch.column("_text")[lo:hi]
            groups = {}
            for lang, text in zip(langs, texts):
                groups.setdefault(lang, []).append(text.as_buffer().to_pybytes())
            for lang, some in groups.items():
                if sum(map(len, known.values())) > most:
                    for words in known.values():
                        words.stale = True
                    known.clear()
                if lang not in known:
                    known[lang] = Words(lang, bits)
                yield lang, known[lang], known[lang].number(some)


def rows_of(lang, columns, n, names):
    """A batch of language, columns and counts; at most 2 ** 17 rows are yielded at once."""
    for lo in range(0, len(n), 1 << 17):
        part = [c[lo:lo + (1 << 17)] for c in columns]
        size = min(1 << 17, len(n) - lo)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), *part, pa.array(n[lo:lo + size], pa.int64())], names)


def count_words(docs):
    """(lang, word, h, n) of all words, summed up by stretch."""
    def work(batches):
        for lang, words, numbers in by_language(batches):
            n = np.bincount(numbers, minlength=1)
            n[0] = 0
            at = np.flatnonzero(n)
            columns = [pa.array([words.names[i] for i in at.tolist()], pa.binary()).cast(pa.string()), pa.array(words.hashes[at].view(np.int64))]
            yield from rows_of(lang, columns, n[at], ["lang", "word", "h", "n"])

    found = docs.mapInArrow(work, "lang string, word string, h long, n long")
    return found.groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def planes(numbers, width):
    """Numbers as bytes, all first bytes first, so that they pack well."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def pack(keys, counts):
    """Rising keys and their counts as bytes."""
    raw = planes(np.diff(keys, prepend=np.uint32(0)), 4) + planes(counts, 8)
    return zlib.compress(raw, 1)


def unpack(data, n):
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    steps, counts = raw[:4 * n].reshape(4, n), raw[4 * n:].reshape(8, n)
    return (np.cumsum(np.ascontiguousarray(steps.T).view("<u4").ravel(), dtype=np.uint32),
            np.ascontiguousarray(counts.T).view("<i8").ravel())


def runs(words, numbers, longest, pairs=None, longer=None):
    """(k, places, hashes) for k = 2 to ``longest``: where a suffix may have k words, and the hash of
    these k. Places are left out when the bit map ``pairs`` lacks their last pair or the bit map
    ``longer`` lacks their three words or more."""
    numbers = np.append(numbers, np.zeros(longest, np.int64))
    often = words.often[numbers]
    near = often[:-1] & often[1:]
    at = np.flatnonzero(near)
    of_pair = np.zeros(len(near), np.uint64)
    of_pair[at] = pair_hash(words.hashes[numbers[at]], words.hashes[numbers[at + 1]])
    if pairs is not None:
        near[at] = has(pairs, slot(of_pair[at]))
        at = np.flatnonzero(near)
    h = of_pair[at]
    for k in range(2, longest + 1):
        if k > 2:
            on = near[at + k - 2]
            at, h = at[on], h[on]
            h = pair_hash(h, words.hashes[numbers[at + k - 1]])
            if longer is not None:
                on = has(longer, slot(h))
                at, h = at[on], h[on]
        yield k, at, h


def ranges_of(total, most):
    """Number of ranges that leave about ``most`` of ``total`` to each: a power of two, 16 to 65,536."""
    return 1 << (min(max(-(-total // most), 16), 1 << 16) - 1).bit_length()


def count_runs(docs, often, pairs, lengths, least, total, most, room=1 << 22):
    """(at, large): places in a bit map of the runs of words, of some ``lengths``, that may occur ``least``
    times; ``large`` is the key of a run that may occur more than ``most`` times (else null).

    Runs are counted by their key, the upper 32 bits of their hash. A task packs what it has
    counted into one row for each range of keys and holds ``room`` keys at a time.
    """
    ranges = ranges_of(total, room)
    wide = np.uint32(32 - ranges.bit_length() + 1)

    def work(batches):
        keys, counts, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0

        def flush():
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            cuts = np.append(np.searchsorted(k >> wide, np.arange(ranges)), len(k))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [pack(k[cuts[i]:cuts[i + 1]], n[cuts[i]:cuts[i + 1]]) for i in used.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int64()), pa.array(np.diff(cuts)[used], pa.int64()), pa.array(blobs, pa.binary())], ["range", "n", "keys"])

        for _, words, numbers in by_language(batches, often.value):
            for length, _, h in runs(words, numbers, max(lengths), pairs and pairs.value):
                if length in lengths:
                    k, n = np.unique((h >> np.uint64(32)).astype(np.uint32), return_counts=True)
                    keys.append(k)
                    counts.append(n)
                    size += len(k)
            if size > 2 * room:
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [n], len(k)
                if size > room:
                    yield flush()
                    keys, counts, size = [k[:0]], [n[:0]], 0
        yield flush()

    def merge(batches):
        met = {}

        def tidy(i):
            met[i] = [summed(np.concatenate([k for k, _ in met[i]]), np.concatenate([n for _, n in met[i]]))]

        for batch in batches:
            for i, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                met.setdefault(i, []).append(unpack(data, n))
                if sum(len(k) for k, _ in met[i][1:]) > max(room, len(met[i][0][0])):
                    tidy(i)
        for i in met:
            tidy(i)
            k, n = met[i][0]
            k, n = k[n >= least].astype(np.int64), n[n >= least]
            for lo in range(0, len(k), 1 << 17):
                part = k[lo:lo + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(part >> (32 - BITS)), pa.array(part, mask=n[lo:lo + (1 << 17)] <= most)], ["at", "large"])

    packed = docs.mapInArrow(work, "range long, n long, keys binary")
    return packed.repartition(ranges, "range").mapInArrow(merge, "at long, large long")


def cut_suffixes(docs, often, pairs, longer, large, longest, ranges, most=1 << 20):
    """(range, lang, names, grid, n): suffixes of two to ``longest`` words, copies summed up, ``most`` of a
    language at a time, packed by the range of their prefix. That is the shortest whose key is not among the
    sorted keys ``large``. ``names`` are the words of a row, ``grid`` and ``n`` packed numbers."""
    def work(batches):
        held = {}

        def flush(lang):
            words, grids, prefixes, _ = held.pop(lang)
            grid, prefix = np.concatenate(grids), np.concatenate(prefixes)
            _, first, n = np.unique(grid.view(np.dtype((np.void, 4 * longest))).ravel(), return_index=True, return_counts=True)
            place = (prefix[first] & np.uint64(ranges - 1)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, first, n = place[order], first[order], n[order]
            cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                used, local = np.unique(grid[first[lo:hi]], return_inverse=True)
                # Number -1 stands behind the last word and comes first.
                local = local.reshape(-1, longest) - (used[0] < 0)
                names = [words.names[i].decode("utf-8", "surrogatepass") for i in used[used >= 0].tolist()]
                packed = [zlib.compress(planes(x.ravel(), w), 1) for x, w in ((local.astype(np.int32), 4), (n[lo:hi], 8))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[lo]]), pa.array([lang]), pa.array([names], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in packed]],
                    ["range", "lang", "names", "grid", "n"])

        for lang, words, numbers in by_language(batches, often.value):
            # Words that were numbered anew have other numbers.
            for other in [x for x in held if held[x][0].stale]:
                yield from flush(other)
            mine, open_at = np.append(numbers, np.zeros(longest, np.int64)), None
            for k, at, h in runs(words, numbers, longest, pairs.value, longer.value):
                if k == 2:
                    grid = np.full((len(at), longest), -1, np.int32)
                    grid[:, 0], prefix, row = mine[at], h, np.full(len(mine), -1)
                    row[at] = np.arange(len(at))
                    open_at = np.ones(len(at), bool)
                here = row[at]
                grid[here, k - 1] = mine[at + k - 1]
                # A prefix that is still too large is extended, where the suffix goes on.
                prefix[here[open_at[here]]] = h[open_at[here]]
                key, keys = (h >> np.uint64(32)).astype(np.int64), large.value
                if len(keys):
                    open_at[here] &= keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                else:
                    open_at[:] = False
            some = held.setdefault(lang, [words, [], [], 0])
            some[1].append(grid)
            some[2].append(prefix)
            some[3] += len(grid)
            if some[3] > most:
                yield from flush(lang)
        for lang in list(held):
            if held[lang][3]:
                yield from flush(lang)

    return docs.mapInArrow(work, "range long, lang string, names array<string>, grid binary, n binary")


def subtree(grid, n, longest):
    """(first row, depth, total) of all nodes of two words or more of the sorted suffixes ``grid``, level by level."""
    new, size = np.ones(len(grid), bool), (grid >= 0).sum(1)
    new[1:] = grid[1:, 0] != grid[:-1, 0]
    for depth in range(2, longest + 1):
        new[1:] |= grid[1:, depth - 1] != grid[:-1, depth - 1]
        begin = np.flatnonzero(new)
        total, whole = np.add.reduceat(n, begin), size[begin] >= depth
        yield begin[whole], depth, total[whole]


class Group:
    """Suffixes of a group, copies summed up now and then."""

    def __init__(self, longest):
        self.longest, self.number, self.names = longest, {}, []
        self.grids, self.counts, self.size, self.kept = [], [], 0, 0

    def add(self, names, grid, n):
        at = np.full(len(names) + 1, -1, np.int64)
        for i, name in enumerate(names):
            if name not in self.number:
                self.number[name] = len(self.names)
                self.names.append(name)
            at[i] = self.number[name]
        raw = [np.frombuffer(zlib.decompress(x), np.uint8) for x in (grid, n)]
        local, counts = [np.ascontiguousarray(x.reshape(w, -1).T).view(f"<i{w}").ravel() for x, w in zip(raw, (4, 8))]
        self.grids.append(at[local.reshape(-1, self.longest)])
        self.counts.append(counts)
        self.size += len(counts)
        if self.size > 2 * self.kept + (1 << 18):
            self.tidy()

    def tidy(self):
        grid, n = np.concatenate(self.grids), np.concatenate(self.counts)
        order = np.lexsort(grid.T[::-1])
        grid = grid[order]
        begin = np.flatnonzero(np.append(True, (grid[1:] != grid[:-1]).any(1)))
        self.grids, self.counts = [grid[begin]], [np.add.reduceat(n[order], begin)]
        self.size = self.kept = len(begin)

    def nodes(self):
        self.tidy()
        return subtree(self.grids[0], self.counts[0], self.longest)


def subtrees(suffixes, longest, ranges, least, parted):
    """(lang, words, n) of the phrases of two words or more that occur ``least`` times. Where prefixes
    were extended (``parted``), a node's count may be the sum of several groups'."""
    names, kinds = ["lang", "words", "n"], (pa.string(), pa.list_(pa.string()), pa.int64())

    def work(batches):
        groups = {}
        for batch in batches:
            for place, lang, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                groups.setdefault((place, lang), Group(longest)).add(*rest)
        for (_, lang), group in groups.items():
            for begin, depth, total in group.nodes():
                shown = total >= (1 if parted else least)
                rows = group.grids[0][begin[shown], :depth]
                out = [lang] * len(rows), [[group.names[i] for i in row] for row in rows.tolist()], total[shown]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names)

    found = suffixes.repartition(ranges, "range").mapInArrow(work, "lang string, words array<string>, n long")
    if parted:
        found = found.groupBy("lang", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return found


def bit_map(spark, places):
    """Broadcast bit map of the numbers ``at`` of ``places``. What the driver gets are parts of
    fixed size, 2 ** BITS bits in all, however many rows there are."""
    parts = places.groupBy((F.col("at") / PART).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.col("at") % PART).alias("bits")).collect()
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for row in parts:
        bits[row.part * (PART // 8):][:PART // 8] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(bits)


def frequent_phrases(docs, text_col="text", lang_col="lang", longest=5, least=100, budget=1 << 20, folder=None):
    """(counts, sizes): ``counts`` has lang, phrase (space-joined), size (words) and f of
    every phrase of 1 to ``longest`` words that occurs ``least`` times inside pieces, overlaps
    included; ``sizes`` has lang and n, all its words. Null texts are empty, null
    languages are ``und``, very long texts are counted whole, repeated rows each, other
    columns are not read; an empty table has no phrases."""
    spark = docs.sparkSession
    shelf = Shelf(spark, "collocations", folder)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("_lang"), F.col(text_col).alias("_text"))
    rows = rows.filter(F.length("_text") > 0)
    words = shelf.put("words", count_words(rows))
    common = words.filter(F.col("n") >= least)
    total = words.agg(F.sum("n")).first()[0] or 0
    # At most 65,536 prefixes of a length are larger than this.
    most = max(budget, -(-total // (1 << 16)))
    often = bit_map(spark, common.select(F.shiftrightunsigned("h", 64 - BITS).alias("at")))
    two = shelf.put("pairs", count_runs(rows, often, None, (2,), least, total, most))
    pairs = bit_map(spark, two)
    more = shelf.put("runs", count_runs(rows, often, pairs, tuple(range(3, longest + 1)), least, total, most))
    large = np.sort(np.array([r.large for t in (two, more) for r in t.select("large").dropna().collect()], np.int64))
    ranges = ranges_of(total, budget)
    suffixes = cut_suffixes(rows, often, pairs, bit_map(spark, more), spark.sparkContext.broadcast(large), longest, ranges)
    deep = subtrees(suffixes, longest, ranges, least, len(large) > 0)
    counts = common.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"))
    counts = counts.unionByName(deep.select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("size"), F.col("n").alias("f")))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return shelf.put("counts", counts), shelf.put("sizes", sizes)


def score_phrases(counts, sizes):
    """Candidates with their lowest-scoring cut: lang, phrase, a, l, r, n, score, kept.

    Each cut of a phrase meets the counts of its two parts. A phrase is not kept if a phrase
    one word longer occurs as often, which is so if any longer one does.
    """
    many = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    cuts = many.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "_w")
    cuts = cuts.select("lang", "phrase", "size", "a", "k", F.array_join(F.expr("slice(_w, 1, k)"), " ").alias("first"),
                       F.array_join(F.expr("slice(_w, k + 1, size)"), " ").alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumns({f"_{c}": x for c, x in wide.items()}).withColumn("score", F.expr("(_a * 1000 * _n) div (_l * _r)"))
    inner = F.filter(F.array(F.when((F.col("k") == F.col("size") - 1) & (F.col("l") == F.col("a")), F.col("first")),
                             F.when((F.col("k") == 1) & (F.col("r") == F.col("a")), F.col("rest"))), lambda x: x.isNotNull())
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("_cut"), F.flatten(F.collect_list(inner)).alias("_inner"))
    gone = best.select("lang", F.explode("_inner").alias("phrase")).distinct().withColumn("_gone", F.lit(True))
    return best.drop("_inner").join(gone, ["lang", "phrase"], "left").select(
        "lang", "phrase", *[f"_cut.{c}" for c in ("a", "l", "r", "n", "score")], F.col("_gone").isNull().alias("kept"))


def collocations(docs, text_col="text", lang_col="lang", longest=5, least=100, top=2000, budget=1 << 20, folder=None):
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, by falling
    score and a, then by phrase. Edge cases as in :func:`frequent_phrases`."""
    scored = score_phrases(*frequent_phrases(docs, text_col, lang_col, longest, least, budget, folder)).filter("kept")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
