"""Language-model scores of documents: word frequencies and causal attention.

Training: one pass over the training documents gathers the count of every word.
The subword ids and their neighbours inside words are counted from the words'
counts; frequent ids get a class of their own, the others share classes by the
company they keep, and in a class an id has its share of all counts. A second pass
cuts every training text, from its start to its end, into windows of classes. An
attention model (:mod:`decorum.llm.attention`) starts from the counts of
neighbouring classes and learns all windows, each in one of the rounds: every task
trains a copy on its own, the copies are averaged, and that is repeated.

Scoring: one pass over all documents scores every subword id once, by class and
share. A small attention model cannot remember single words, so the probability of
a word is MEMORY parts its frequency and the rest what the attention model gives
its subwords. Frequent words are summed up at once; the rare words of the
documents meet their counts in a shuffle, since the vocabulary grows with the corpus.
"""

import base64
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from decorum.llm.attention import WIDTH, Attention, Scorer, train
from decorum.llm.store import Shelf, stretches
from decorum.llm.token_counts import PIECES

#: The end of a text counts as a word; no word is empty.
END = b""
CLASSES = 128
SIZE = 32
FREQUENT = 1 << 18
#: Ids that are put into classes by their company, and neighbours that are told apart for that.
CLUSTERED = 4096
COMPANY = 128
#: Weight of the words' own frequencies in the model's probability of a word.
MEMORY = 0.3


class Subwords:
    """Subword ids of words, each after a blank, by a byte-level vocabulary file of ranks."""

    def __init__(self, path):
        import tiktoken

        with open(path() if callable(path) else path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coder = tiktoken.Encoding("words", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def encode(self, many):
        """(ids one after the other, number of ids) of words; the end of a text has the id
        after the vocabulary. Words hold no blank, so the ids of many of them, joined
        by blanks, fall apart where an id begins with one."""
        flat, length = [], np.ones(len(many), np.int64)
        real = [w for w in many if w != END]
        counts = []
        for lo in range(0, len(real), 2000):
            part = real[lo:lo + 2000]
            ids = np.array(self.coder.encode_ordinary((b" " + b" ".join(part)).decode("utf-8", "replace")), np.int64)
            begin = np.flatnonzero(self.opens[ids])
            flat.append(ids)
            counts.append(np.diff(begin, append=len(ids)))
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int64)
        whole = np.array([w != END for w in many], bool)
        length[whole] = np.concatenate(counts) if counts else 0
        out = np.full(int(length.sum()), self.size, np.int64)
        out[np.repeat(whole, length)] = ids
        return out, length


def split(texts):
    """(number of words of each text, the words one after the other) of an Arrow column:
    as :func:`decorum.llm.simhash.words`, A-Z lower-cased and cut at ASCII white space."""
    lines = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    # White space at either end of a text leaves an empty word there.
    flat = lines.flatten().cast(pa.large_binary())
    real = pc.not_equal(flat, pa.scalar(b"", pa.large_binary()))
    kept = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    bounds = lines.offsets.to_numpy().astype(np.int64)
    return np.diff(kept[bounds - bounds[0]]), flat.filter(real)


def gather(docs, text_col):
    """(word, n): word counts by stretch of texts."""
    def work(batches):
        for batch, at, end in ((b, lo, hi) for b in batches for lo, hi in stretches(b.column(0))):
            seen = split(batch.column(0).slice(at, end - at))[1].value_counts()
            word, n = seen.flatten()
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([word.cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([end - at], pa.int64())])],
                ["word", "n"])
        # The worker goes on to other steps, which need the room.
        pa.default_memory_pool().release_unused()

    return docs.select(F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(work, "word binary, n long")


def profiles(pairs, rows, columns):
    """Square roots of smoothed shares of each row's neighbours."""
    seen = np.zeros((rows, columns))
    for row, column, n in pairs:
        seen[row, column] += n
    usual = seen.sum(0) / max(seen.sum(), 1)
    return np.sqrt((seen + 2 * usual) / (seen.sum(1, keepdims=True) + 2))


def class_table(counts, company, classes, rounds=12):
    """(class of each id, log10 of its share of the class) from the ids' counts.

    The most frequent ids stand alone. Of the others the first CLUSTERED by count
    are grouped by ``company``, one row of figures each (k-means, started from the
    most frequent of them); all rarer ones join the last class.
    """
    order = np.argsort(-counts, kind="stable")
    alone = classes // 2
    of = np.full(len(counts), classes - 1, np.int64)
    of[order[:alone]] = np.arange(alone)
    rest = np.arange(alone, len(company))
    if len(rest) > classes - alone:
        x, weight = company[rest], counts[order[rest]] + 0.5
        centre = x[:classes - alone].copy()
        for _ in range(rounds):
            near = (-2 * x @ centre.T + (centre ** 2).sum(1)).argmin(1)
            total = np.bincount(near, weights=weight, minlength=len(centre))
            for j in np.flatnonzero(total):
                centre[j] = weight[near == j] @ x[near == j] / total[j]
        of[order[rest]] = alone + near
    else:
        of[order[rest]] = rest
    smooth = counts + 0.5
    total = np.bincount(of, weights=smooth, minlength=classes)
    return of, np.log10(smooth / total[of])


def windows_of(stream, counts, classes):
    """Rows of WIDTH + 1 classes, padded with ``classes + 1``: the start mark and all of
    ``stream``, the classes of texts of ``counts`` tokens one after the other. Each token
    is the target of one place, and a row begins with the last class of the row before."""
    rows = -(-counts // WIDTH)
    room = rows * WIDTH + 1
    at = np.cumsum(room) - room
    padded = np.full(int(room.sum()), classes + 1, dtype=np.int16)
    padded[at] = classes
    padded[np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(len(stream)) + 1] = stream
    starts = np.repeat(at, rows) + WIDTH * (np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows))
    return padded[starts[:, None] + np.arange(WIDTH + 1)]


def cut_windows(docs, path, shared, text_col, classes, share, rounds, some=256):
    """(window, n, turn): bytes of ``some`` windows of the texts at most, their number and
    their round. Windows are dealt to rounds in a mixed order. ``share`` above 1 keeps
    one window in ``share`` only."""
    def work(batches):
        of = shared.value
        subwords = Subwords(path)
        for _, _, _, lexicon, n, number in numbered(batches, 0, subwords, of, np.zeros(len(of)), {}):
            length = lexicon.length[number]
            stream = lexicon.classes[spread_runs(lexicon.begin[number], length)]
            rows = windows_of(stream, np.add.reduceat(length, np.cumsum(n) - n), classes)
            rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))[::share]]
            parts = [(turn, rows[turn::rounds][lo:lo + some]) for turn in range(rounds) for lo in range(0, len(rows[turn::rounds]), some)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for _, r in parts], pa.binary()), pa.array([len(r) for _, r in parts], pa.int64()),
                 pa.array([turn for turn, _ in parts], pa.int64())], ["window", "n", "turn"])

    return docs.select(F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(work, "window binary, n long, turn long")


def count_by(table, keys, names):
    """Sums of ``keys`` over the words of ``table`` (n, ids). The function maps the ids of
    words, the count of each id, and where each word begins and ends, to columns
    of integers, the last of them counts."""
    kinds = ", ".join(f"{c} long" for c in names)

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy().astype(np.int64)
                length = np.diff(batch.column(1).offsets.to_numpy())
                first = np.cumsum(length) - length
                columns = keys(flat, np.repeat(batch.column(0).to_numpy(), length), first, first + length - 1)
                # The columns as digits of one number.
                code = np.zeros(len(columns[0]), np.int64)
                for column in columns[:-1]:
                    code = code * (1 << 20) + column
                code, place = np.unique(code, return_inverse=True)
                total = np.bincount(place, weights=columns[-1], minlength=len(code)).astype(np.int64)
                digits = [code >> (20 * i) & ((1 << 20) - 1) for i in range(len(columns) - 1)][::-1]
                yield pa.RecordBatch.from_arrays([*map(pa.array, digits), pa.array(total)], names)

    return table.mapInArrow(work, kinds).groupBy(*names[:-1]).agg(F.sum(names[-1]).alias(names[-1]))


def fit(docs, path, shelf, text_col="text", share=1, rounds=3, classes=CLASSES):
    """What scoring needs from the training documents: the written table of word
    counts, N, V, the class of each subword id, its share, and the attention model."""
    counts = shelf.put("counts", gather(docs, text_col).groupBy("word").agg(F.sum("n").alias("n")))
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()

    def encode(batches):
        subwords = Subwords(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                flat, length = subwords.encode(part.column(0).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(1), ids], ["n", "ids"])

    coded = shelf.put("coded", counts.mapInArrow(encode, "n long, ids array<int>"))
    by_id = np.zeros(Subwords(path).size + 1)
    # One row per subword id at most: the tokenizer's vocabulary is the bound.
    for row in count_by(coded, lambda flat, times, *_: (flat, times), ["id", "n"]).collect():
        by_id[row.id] = row.n
    order = np.argsort(-by_id, kind="stable")
    rank = np.full(len(by_id), CLUSTERED, np.int64)
    rank[order[:CLUSTERED]] = np.arange(min(CLUSTERED, len(order)))

    def company(flat, times, first, last):
        """(rank of an id, side, neighbour, n); neighbours past COMPANY are one, and so is the edge of a word."""
        place, near = rank[flat], np.minimum(rank[flat], COMPANY)
        before, after = np.roll(near, 1), np.roll(near, -1)
        before[first], after[last] = COMPANY + 1, COMPANY + 1
        half = np.zeros(len(flat), np.int64)
        return np.tile(place, 2), np.append(half, half + 1), np.append(before, after), np.tile(times, 2)

    # At most CLUSTERED * 2 * (COMPANY + 2) rows, far fewer in fact; as columns, since rows of objects take much more room.
    rows = count_by(coded, company, ["place", "side", "near", "n"]).filter(F.col("place") < CLUSTERED)
    rows = rows.select("place", "side", "near", "n").toArrow()
    met = np.stack([c.to_numpy() for c in rows.columns], axis=1)
    used = int(np.count_nonzero(by_id[order[:CLUSTERED]]))
    sides = [profiles(met[met[:, 1] == side][:, [0, 2, 3]], used, COMPANY + 2) for side in (0, 1)]
    of, part = class_table(by_id, np.hstack(sides), classes)

    def neighbours(flat, times, first, last):
        """(class, next class, n) inside words; ``classes`` stands for the edge of a word."""
        here = of[flat]
        after = np.roll(here, -1)
        after[last] = classes
        edge = np.full(len(first), classes, np.int64)
        return np.append(here, edge), np.append(after, here[first]), np.append(times, times[first])

    inside = np.zeros((classes + 1, classes + 1))
    # At most (classes + 1) ** 2 rows.
    for row in count_by(coded, neighbours, ["a", "b", "n"]).collect():
        inside[row.a, row.b] = row.n
    # Words follow each other as if by chance; what more there is the windows teach.
    end = of[by_id.shape[0] - 1]
    first = inside[classes, :classes] / max(inside[classes].sum(), 1)
    final = inside[:classes, classes].copy()
    texts = final[end] if len(final) else 0
    pairs = np.zeros((classes + 1, classes))
    pairs[:classes] = inside[:classes, :classes] + np.outer(np.where(np.arange(classes) == end, 0, final), first)
    pairs[classes] = first * texts
    shared = docs.sparkSession.sparkContext.broadcast(of)
    windows = shelf.put("windows", cut_windows(docs, path, shared, text_col, classes, share, rounds))
    return counts, total or 0, distinct, of, part, fit_attention(windows, pairs, rounds, classes)


def fit_attention(windows, pairs, rounds, classes, group=16384, least=128):
    """Average of the tasks' models after ``rounds`` rounds over a part of the windows each.

    A task trains on about ``group`` windows, and again on the same ones until it has made
    ``least`` steps.
    """
    spark = windows.sparkSession
    tasks = max(1, -(-(windows.agg(F.sum("n")).first()[0] or 0) // (group * rounds)))
    model = Attention(classes, SIZE).start(pairs)
    for turn in range(rounds):
        flat = spark.sparkContext.broadcast(model.flat)

        def learn(batches):
            raw = b"".join(x for b in batches for x in b.column(0).to_pylist())
            rows = np.frombuffer(raw, dtype=np.int16).reshape(-1, WIDTH + 1)
            if len(rows):
                rows = rows[np.random.default_rng(len(rows)).permutation(len(rows))]
                new = train(Attention(classes, SIZE, flat.value), rows.astype(np.int64), least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(new))), pa.array(new.astype(np.float64) * len(rows)), pa.array(np.full(len(new), len(rows)))],
                    ["at", "x", "n"])

        mine = windows.filter(F.col("turn") == turn).select("window").repartition(tasks)
        mean = mine.mapInArrow(learn, "at long, x double, n long").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("x"))
        # One row per parameter, however many tasks there were.
        got = [row.x for row in mean.orderBy("at").collect()]
        if got:
            model = Attention(classes, SIZE, got)
    return model


class Lexicon(dict):
    """Numbers of words, with what is known of each: subword classes, log10 of the
    shares, and a frequent word's count (else not a number)."""

    def __init__(self, subwords, of, part, frequent):
        super().__init__()
        self.subwords, self.of, self.part, self.frequent = subwords, of, part, frequent
        self.words, self.fresh = [], []
        self.classes, self.length, self.share, self.base = [np.zeros(0, t) for t in (np.int16, np.int64, float, float)]

    def __missing__(self, word):
        number = self[word] = len(self.words)
        self.words.append(word)
        self.fresh.append(word)
        return number

    def number(self, texts):
        """(words of each text, the number of every word), with the end of a text as its last word."""
        n, flat = split(texts)
        coded = flat.dictionary_encode()
        # Every distinct word is looked up once.
        known = np.fromiter(map(self.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        number = np.full(len(flat) + len(n), self[END], np.int64)
        number[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = known[coded.indices.to_numpy()]
        self.learn()
        return n + 1, number

    def learn(self):
        """Look up the words met since the last call."""
        if not self.fresh:
            return
        flat, length = self.subwords.encode(self.fresh)
        begins = np.cumsum(length) - length
        base = np.array([self.frequent.get(w, np.nan) for w in self.fresh], float)
        self.classes = np.concatenate([self.classes, self.of[flat].astype(np.int16)])
        self.length = np.concatenate([self.length, length])
        self.share = np.concatenate([self.share, np.add.reduceat(self.part[flat], begins)])
        self.base = np.concatenate([self.base, base])
        self.begin = np.cumsum(self.length) - self.length
        self.fresh = []


def mix(seen, total, p):
    """log10 of MEMORY parts the frequency of words met ``seen`` times and the rest 10 ** ``p``, however small that is."""
    with np.errstate(divide="ignore"):
        memory = np.log(MEMORY * np.asarray(seen, float) / max(total, 1))
    return np.logaddexp(memory, p * math.log(10) + math.log(1 - MEMORY)) / math.log(10)


def numbered(batches, column, subwords, of, part, frequent, group=2):
    """(batch, first, last + 1, lexicon, words of each text, numbers of the words) of stretches
    of texts. A group of them is numbered at once, which looks up fewer words."""
    lexicon = Lexicon(subwords, of, part, frequent)
    for batch in batches:
        spans = list(stretches(batch.column(column), 1 << 20))
        for some in (spans[i:i + group] for i in range(0, len(spans), group)):
            if len(lexicon.words) > 300_000:
                lexicon = Lexicon(subwords, of, part, frequent)
            first, last = some[0][0], some[-1][1]
            n, number = lexicon.number(batch.column(column).slice(first, last - first))
            ends = np.append(0, np.cumsum(n))
            for at, end in some:
                yield batch, at, end, lexicon, n[at - first:end - first], number[ends[at - first]:ends[end - first]]


def spread_runs(begins, lengths):
    """Positions begins[i], begins[i] + 1, ... of each run, one after the other."""
    total = np.cumsum(lengths)
    return np.arange(total[-1]) + np.repeat(begins - (total - lengths), lengths)


def score(docs, path, learn, id_col="doc_id", text_col="text", share=1, rounds=3, frequent=FREQUENT, folder=None):
    """One row per input row: _id, _n_tokens, _n_known, _train_tokens, _base (log10
    probability by smoothed word counts) and _score (log10 probability by the model).

    ``learn`` is the condition of the training documents. Tokens are words, A-Z
    lower-cased, and one end. Null and empty texts are one end. Without training
    documents every token is unknown and the model is uniform over its classes. Repeated rows are scored
    and, if they are training documents, counted each. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "lm-score", folder)
    counts, total, distinct, of, part, model = fit(docs.filter(learn), path, shelf, text_col, share, rounds)
    # At most ``frequent`` rows leave the executors and are broadcast.
    often = counts.orderBy(F.col("n").desc(), "word").limit(frequent).toArrow()
    top = dict(zip(often["word"].to_pylist(), often["n"].to_pylist()))
    shared = spark.sparkContext.broadcast((top, of, part, model.classes, model.flat))

    def work(batches):
        frequent, of, part, classes, flat = shared.value
        subwords, scorer = Subwords(path), Scorer(Attention(classes, SIZE, flat))
        for batch, at, _, lexicon, n, number in numbered(batches, 1, subwords, of, part, frequent):
            begin = np.cumsum(n) - n
            length = lexicon.length[number]
            stream = lexicon.classes[spread_runs(lexicon.begin[number], length)]
            ids = np.add.reduceat(length, begin)
            by_model = np.add.reduceat(scorer.log_probs(stream, ids).astype(float), np.cumsum(length) - length) / math.log(10)
            by_model = by_model + lexicon.share[number]
            count = lexicon.base[number]
            rare = np.isnan(count)
            seen = np.where(rare, 0.0, count)
            logs = np.where(rare, 0.0, np.log10(seen + 0.5))
            mixed = np.where(rare, 0.0, mix(seen, total, by_model))
            # Each rare word with what the attention model gives it, in order of text.
            names = pa.array([lexicon.words[i] for i in number[rare].tolist()], pa.binary())
            cuts = pa.array(np.append(0, np.cumsum(np.add.reduceat(rare, begin))), pa.int32())
            tail = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays([names, pa.array(by_model[rare].astype(np.float32))], ["word", "p"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(n)), pa.array(n), pa.array(np.add.reduceat(~rare, begin).astype(np.int64)),
                 pa.array(np.add.reduceat(logs, begin)), pa.array(np.add.reduceat(mixed, begin)), tail],
                ["_id", "_n_tokens", "_known", "_logs", "_mixed", "_tail"])

    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    schema = (f"_id {rows.schema['_id'].dataType.simpleString()}, _n_tokens long, _known long, _logs double, "
              "_mixed double, _tail array<struct<word: binary, p: float>>")
    passed = shelf.put("passed", rows.mapInArrow(work, schema).withColumn("_row", F.monotonically_increasing_id()))
    met = passed.select("_row", F.inline("_tail")).join(counts, "word", "left")
    seen = F.coalesce(F.col("n"), F.lit(0))
    # As in mix(): the larger part is taken out of the sum, since 10 ** p of a long word is below any float.
    memory, rest = F.log10(MEMORY * seen / max(total, 1)), F.col("p").cast("double") + math.log10(1 - MEMORY)
    both = F.greatest(memory, rest) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(memory - rest)))
    mixed = F.when(seen > 0, both).otherwise(rest)
    tails = met.groupBy("_row").agg(F.count_if(seen > 0).alias("_tail_known"), F.sum(F.log10(seen + 0.5)).alias("_tail_logs"),
                                    F.sum(mixed).alias("_tail_mixed"))
    tails = shelf.put("tails", tails)
    norm = math.log10(total + 0.5 * (distinct + 1))
    return passed.drop("_tail").join(tails, "_row", "left").select(
        "_id", "_n_tokens", (F.col("_known") + F.coalesce("_tail_known", F.lit(0))).alias("_n_known"),
        F.lit(total).cast("long").alias("_train_tokens"),
        (F.col("_logs") + F.coalesce("_tail_logs", F.lit(0.0)) - F.col("_n_tokens") * norm).alias("_base"),
        (F.col("_mixed") + F.coalesce("_tail_mixed", F.lit(0.0))).alias("_score"))
