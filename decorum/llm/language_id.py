"""Language of documents by a convolutional network over bytes.

A text is cut into windows of LENGTH bytes, from its start to its end. Every byte has a
small vector; filters of several widths slide over the bytes of a window, each keeps its
largest response, and a softmax over those names the language. A text's probabilities are
the mean of its windows', weighted by their bytes.

The network is trained in numpy, on windows of a bounded sample of labelled documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from decorum.llm.store import stretches

LENGTH = 256
#: Widths of the filters, filters of each width, figures of a byte.
WIDTHS = (2, 3, 4)
FILTERS = 24
VECTOR = 8
#: Stands for the places behind the end of a text; its vector stays zero.
PAD = 256
UNKNOWN = "und"


def windows_of(raw):
    """(rows of LENGTH byte numbers, bytes of each row, rows of each text) of some byte strings,
    all of every text; an empty text is one empty window."""
    size = np.array([len(t) for t in raw], np.int64)
    rows = np.maximum(1, -(-size // LENGTH))
    out = np.full(int(rows.sum()) * LENGTH, PAD, np.int16)
    begin = (np.cumsum(rows) - rows) * LENGTH
    out[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.frombuffer(b"".join(raw), np.uint8)
    used = np.full(len(out) // LENGTH, LENGTH, np.int64)
    used[np.cumsum(rows) - 1] = size - (rows - 1) * LENGTH
    return out.reshape(-1, LENGTH), used, rows


class Network:
    """Byte vectors, filters and softmax. Filters of smaller widths have zeros behind their
    width, so one product serves all of them."""

    def __init__(self, labels, seed=7):
        rng = np.random.default_rng(seed)
        span, kinds = max(WIDTHS), len(WIDTHS) * FILTERS
        self.labels = labels
        self.mask = np.repeat(np.array([[[t < w] for t in range(span)] for w in WIDTHS], np.float32), FILTERS, axis=0)
        self.vectors = (rng.standard_normal((PAD + 1, VECTOR)) * 0.5).astype(np.float32)
        self.vectors[PAD] = 0
        self.filters = (rng.standard_normal((kinds, span, VECTOR)) * self.mask / np.sqrt(span * VECTOR)).astype(np.float32)
        self.bias = np.zeros(kinds, np.float32)
        self.out = np.zeros((kinds, max(len(labels), 1)), np.float32)
        self.prior = np.zeros(max(len(labels), 1), np.float32)

    def parts(self):
        return [self.vectors, self.filters, self.bias, self.out, self.prior]

    def responses(self, rows):
        """(rows, places, filters) before pooling, and the vectors each place sees."""
        span = max(WIDTHS)
        padded = np.pad(rows, ((0, 0), (0, span - 1)), constant_values=PAD)
        flat = self.vectors[padded].reshape(len(rows), -1)
        seen = np.lib.stride_tricks.sliding_window_view(flat, span * VECTOR, axis=1)[:, ::VECTOR]
        seen = np.ascontiguousarray(seen).reshape(-1, span * VECTOR)
        wide = self.filters.reshape(len(self.filters), -1)
        return (seen @ wide.T).reshape(len(rows), LENGTH, -1), seen, padded

    def pooled(self, rows):
        return np.maximum(self.responses(rows)[0].max(1) + self.bias, 0)

    def probabilities(self, rows, step=64):
        """Softmax of every row, ``step`` rows at a time."""
        out = np.zeros((len(rows), len(self.prior)), np.float32)
        for lo in range(0, len(rows), step):
            z = self.pooled(rows[lo:lo + step]) @ self.out + self.prior
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo:lo + step] = z / z.sum(1, keepdims=True)
        return out

    def slopes(self, rows, label):
        """Gradient of the mean log loss, part by part. Only the winning place of each filter
        passes it on."""
        n, span = len(rows), max(WIDTHS)
        all_places, seen, padded = self.responses(rows)
        best = all_places.argmax(1)
        top = np.take_along_axis(all_places, best[:, None], 1)[:, 0] + self.bias
        hidden = np.maximum(top, 0)
        z = hidden @ self.out + self.prior
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), label] -= 1
        p /= n
        back = (p @ self.out.T) * (top > 0)
        at = np.arange(n)[:, None] * LENGTH + best
        won = seen[at].reshape(n, -1, span, VECTOR)
        filters = np.einsum("nf,nfsv->fsv", back, won) * self.mask
        share = back[:, :, None, None] * self.filters[None]
        places = padded[np.arange(n)[:, None, None], best[:, :, None] + np.arange(span)].ravel()
        share = share.reshape(-1, VECTOR)
        vectors = np.stack([np.bincount(places, weights=share[:, v], minlength=PAD + 1) for v in range(VECTOR)], axis=1)
        vectors[PAD] = 0
        return [vectors, filters, back.sum(0), hidden.T @ p, p.sum(0)]


def train(rows, label, labels, epochs=12, batch=64, rate=4e-3, seed=7):
    """A network for ``labels`` from windows and the number of each one's label. In every
    second window of a batch, only some bytes from its start are kept, so that short texts
    are learned too. Adam; every label weighs alike."""
    net, rng = Network(labels, seed), np.random.default_rng(seed)
    if not len(rows) or len(labels) < 2:
        return net
    weight = 1 / np.bincount(label, minlength=len(labels))[label]
    first, second = [[np.zeros(x.shape) for x in net.parts()] for _ in range(2)]
    steps, total = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.choice(len(rows), len(rows), p=weight / weight.sum())
        for lo in range(0, len(rows), batch):
            some = order[lo:lo + batch]
            x = rows[some].copy()
            cut = np.where(np.arange(len(x)) % 2, rng.integers(8, LENGTH, len(x)), LENGTH)
            x[np.arange(LENGTH) >= cut[:, None]] = PAD
            steps += 1
            pace = rate * (1 - steps / (total + 1))
            for part, slope, a, b in zip(net.parts(), net.slopes(x, label[some]), first, second):
                a += 0.1 * (slope - a)
                b += 0.001 * (slope * slope - b)
                part -= pace * (a / (1 - 0.9 ** steps)) / (np.sqrt(b / (1 - 0.999 ** steps)) + 1e-8)
    return net


def sample_windows(docs, learn, id_col, text_col, lang_col, per_label, sample, pieces):
    """(label, window): ``pieces`` windows at most of each sampled document, evenly apart.

    Sampled are the documents with the lowest hashes of their ids, ``per_label`` at most of
    a label and ``sample`` at most in all (the k-th of every label before the next of any).
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    slim = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_label"))
    slim = slim.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_id"), 1))
    # Hashes below a share that leaves about four times ``per_label`` rows of a label: what is
    # ranked does not grow with the table.
    sizes = slim.groupBy("_label").agg((F.lit(4.0 * per_label) / F.count("*")).alias("_share"))
    some = slim.join(sizes, "_label").filter(F.col("_hash") < F.col("_share") * float(1 << 63)).drop("_share").distinct()
    turn = F.row_number().over(Window.partitionBy("_label").orderBy("_hash", "_id"))
    picked = some.withColumn("_turn", turn).filter(F.col("_turn") <= per_label)
    picked = picked.orderBy("_turn", "_hash", "_label", "_id").limit(sample).select("_id", "_label")
    # At most ``sample`` rows are broadcast, so no text is shuffled.
    texts = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_label"), F.col(text_col).alias("_text"))
    texts = texts.join(F.broadcast(picked), ["_id", "_label"])

    def work(batches):
        for batch in batches:
            for lo, hi in stretches(batch.column("_text")):
                label, out = [], []
                for name, text in zip(batch.column("_label")[lo:hi].to_pylist(), batch.column("_text")[lo:hi].to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    count = -(-len(raw) // LENGTH)
                    for k in sorted(set(np.linspace(0, count - 1, min(count, pieces)).astype(int).tolist())):
                        label.append(name)
                        out.append(raw[k * LENGTH:(k + 1) * LENGTH])
                yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(out, pa.binary())], ["label", "window"])

    return texts.mapInArrow(work, "label string, window binary")


def fit(docs, learn, id_col="doc_id", text_col="text", lang_col="lang", per_label=600, sample=6_000, pieces=3):
    """A network from at most ``sample`` documents on which the condition ``learn`` holds,
    ``pieces`` windows of each at most: that bounds what the driver gets (4.6 MB of bytes)
    and the number of labels. Null labels and texts without a letter teach nothing. Without
    labels the network names nothing."""
    rows = sample_windows(docs, learn, id_col, text_col, lang_col, per_label, sample, pieces).orderBy("label", "window").toArrow()
    labels = sorted(set(rows["label"].to_pylist()))
    number = {name: i for i, name in enumerate(labels)}
    x, _, count = windows_of(rows["window"].to_pylist())
    label = np.array([number[name] for name in rows["label"].to_pylist()], np.int64)
    return train(x, np.repeat(label, count), labels)


def predict(docs, net, id_col="doc_id", text_col="text"):
    """One row per input row: _id, _lang (a label, or ``und``) and _score (0 to 1), from every
    byte of the text.

    A null text or one without a letter, or any text where nothing was learned, is ``und``
    with score 0. With one label only, every other text has that label. Repeated rows are
    answered each, ties go to the first label, very long texts are read to their end, other
    columns are not read, and an empty table gives no rows.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.when(text.rlike(r"\p{L}"), text).alias("_text"))
    if not net.labels:
        return rows.select("_id", F.lit(UNKNOWN).alias("_lang"), F.lit(0.0).alias("_score"))

    def work(batches):
        names = np.array([*net.labels, UNKNOWN], dtype=object)
        for batch in batches:
            for lo, hi in stretches(batch.column("_text"), 1 << 20):
                column = batch.column("_text")[lo:hi]
                known = column.is_valid().to_numpy(zero_copy_only=False)
                raw = [t.as_buffer().to_pybytes() for t in column.drop_null()]
                place, score = np.full(hi - lo, len(net.labels)), np.zeros(hi - lo)
                if raw:
                    x, used, count = windows_of(raw)
                    p = net.probabilities(x).astype(float) * used[:, None]
                    begin = np.cumsum(count) - count
                    p = np.add.reduceat(p, begin) / np.add.reduceat(used, begin)[:, None]
                    place[known], score[known] = p.argmax(1), np.clip(p.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id")[lo:hi], pa.array(names[place], pa.string()), pa.array(score)], ["_id", "_lang", "_score"])

    return rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, _lang string, _score double")
