"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's evidence is its own features and
those of the lines before and after it; the chain adds the habit of good lines
to follow good ones. Only documents carry labels, so in training all lines of a
document take its label. A document's score is the mean of its lines' marginal
probabilities of being good, weighted by length.
"""

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from decorum.llm.store import stretches

#: Byte classes: 0 other symbols, 1 upper, 2 lower, 3 digits, 4 blanks, 5 punctuation of prose, 6 beyond ASCII.
KIND = np.zeros(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58] = 1, 2, 3
KIND[[32, 9, 11, 12, 13]] = 4
KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
KIND[128:] = 6
OWN = 12
FEATURES = 3 * OWN + 3


def line_features(texts):
    """(features, byte lengths, lines per text) of all lines of some texts.

    A null or empty text is one empty line. Each row has the line's own values,
    the same values of the line before and of the line after (zero beyond the
    ends), marks for the first and last line, and a constant.
    """
    raw = [("" if t is None else t).encode("utf-8", "surrogatepass") for t in texts]
    split = [t.split(b"\n") for t in raw]
    count = np.array([len(x) for x in split], dtype=np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), count
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    size = np.array([len(line) for x in split for line in x], dtype=np.int64)
    line_of = np.repeat(np.arange(total), np.append(size[:-1] + 1, size[-1]))
    kinds = np.bincount(line_of * 8 + KIND[data], minlength=total * 8).reshape(-1, 8).astype(np.float64)
    kinds[:-1, 0] -= 1  # the line feed itself
    words, distinct, doubled, copies = np.zeros((4, total))
    at = 0
    for lines in split:
        seen = {}
        for line in lines:
            w = line.split()
            words[at], distinct[at], doubled[at] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
            seen[line] = seen.get(line, 0) + 1
            at += 1
        copies[at - len(lines):at] = [seen[line] / len(lines) for line in lines] if len(lines) > 1 else 0.0
    n = np.maximum(size, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 6], 1)
    per_word = np.maximum(words, 1)
    own = np.stack([
        np.log1p(size) / 6,
        kinds[:, 1] / letters,
        np.minimum(kinds[:, 0] / n * 5, 1),
        np.minimum(kinds[:, 0] / per_word, 1),
        np.minimum(kinds[:, 3] / n * 5, 1),
        np.minimum(kinds[:, 5] / per_word * 2, 1),
        np.minimum(n / per_word / 12, 1),
        distinct / per_word,
        np.minimum(doubled / per_word * 4, 1),
        ((words > 5) & (distinct < 0.4 * words)).astype(float),
        copies,
        (size == 0).astype(float),
    ], axis=1)
    first = np.cumsum(count) - count
    last = first + count - 1
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    ends = np.zeros((total, 3))
    ends[first, 0], ends[last, 1], ends[:, 2] = 1, 1, 1
    return np.hstack([own, before, after, ends]).astype(np.float32), np.maximum(size, 1), count


def marginals(score, count, chain):
    """P(good) of every line, the pair sums the gradient needs, and log Z of each text.

    ``score`` is the log-odds of good for each line, ``chain`` the 2 x 2 scores of
    neighbours. Texts run side by side, longest first, one line number at a time.
    """
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    length = count[order]
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) if len(length) else 0)]
    alpha = np.zeros((len(score), 2))
    beta = np.zeros((len(score), 2))
    alpha[:, 1] = score
    for t in range(1, len(live)):
        at = first[:live[t]] + t
        back = alpha[at - 1]
        for s in (0, 1):
            alpha[at, s] += np.logaddexp(back[:, 0] + chain[0, s], back[:, 1] + chain[1, s])
    for t in range(len(live) - 2, -1, -1):
        at = first[:live[t + 1]] + t
        ahead = beta[at + 1] + np.stack([np.zeros(len(at)), score[at + 1]], axis=1)
        for s in (0, 1):
            beta[at, s] = np.logaddexp(ahead[:, 0] + chain[s, 0], ahead[:, 1] + chain[s, 1])
    both = alpha + beta
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    ends = np.cumsum(count) - 1
    log_z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    inner = np.ones(len(score), dtype=bool)
    inner[np.cumsum(count) - count] = False
    here = np.flatnonzero(inner)
    z = np.repeat(log_z, count)[here]
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(alpha[here - 1, a] + chain[a, b] + b * score[here] + beta[here, b] - z).sum()
    return good, pairs, log_z


def train(features, count, label, steps=200, rate=0.1, penalty=1e-3):
    """Weights and chain scores that maximize the likelihood of the labelled texts
    (Adam on full batches, ``penalty`` on squared weights). Long texts count once,
    like short ones: a line's share of the gradient is 1 / lines."""
    line_label = np.repeat(label, count).astype(np.float64)
    texts = max(len(count), 1)
    w, chain = np.zeros(features.shape[1]), np.zeros((2, 2))
    state = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    x = features.astype(np.float64)
    by_line = 1 / np.repeat(count, count)
    inner = np.ones(len(line_label), dtype=bool)
    inner[np.cumsum(count) - count] = False
    seen = np.zeros((2, 2))
    for a in (0, 1):
        seen[a, a] = (line_label[inner] == a).sum()
    lines = max(inner.sum(), 1)
    for step in range(1, steps + 1):
        good, pairs, _ = marginals(x @ w, count, chain)
        slope = np.concatenate([x.T @ ((line_label - good) * by_line) / texts - penalty * w,
                                ((seen - pairs) / lines - penalty * chain).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.999 * state[1] + 0.001 * slope * slope
        move = rate * (state[0] / (1 - 0.9 ** step)) / (np.sqrt(state[1] / (1 - 0.999 ** step)) + 1e-8)
        w = w + move[:-4]
        chain = chain + move[-4:].reshape(2, 2)
    return w, chain


def text_scores(texts, w, chain):
    """Length-weighted mean of P(good) over the lines of each text."""
    features, size, count = line_features(texts)
    if not len(count):
        return np.zeros(0)
    good, _, _ = marginals(features.astype(np.float64) @ w, count, chain)
    first = np.cumsum(count) - count
    return np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 0, 1)


def fit(docs, labels, id_col="doc_id", text_col="text", label_id="doc_id", label_col="quality", learn=None, sample=6000):
    """A model from at most ``sample`` labelled documents, those with the lowest
    hashes of their ids among the rows where ``learn`` (a condition on the id
    column of ``labels``; default all) holds.

    Null labels are left out; a document with several labels takes the lowest.
    Only line features leave the executors. Without any labelled text, or with
    one label only, the model still scores (near one half, or toward that label).
    """
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    picked = rows.groupBy(F.col(label_id).alias("_labelled")).agg(F.min(label_col).cast("int").alias("_label"))
    picked = picked.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    # At most ``sample`` rows are broadcast, so no text is shuffled.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), F.col("_id") == F.col("_labelled")).select("_id", "_text", "_label")

    def work(batches):
        for batch in batches:
            for lo, hi in stretches(batch.column(1)):
                features, _, count = line_features(batch.column(1)[lo:hi].to_pylist())
                cut = np.split(features, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(count), pa.array([c.tobytes() for c in cut], pa.binary())],
                    ["_id", "label", "lines", "x"])

    got = texts.mapInArrow(work, f"_id {texts.schema['_id'].dataType.simpleString()}, label int, lines long, x binary").orderBy("_id", "x").collect()
    if not got:
        return np.zeros(FEATURES), np.zeros((2, 2))
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in got])
    w, chain = train(x, np.array([r["lines"] for r in got]), np.array([r["label"] for r in got]))
    return w, chain


def score(docs, model, id_col="doc_id", text_col="text"):
    """(_id, _score) of each row from its whole text; null counts as empty, and an
    empty text is scored as one empty line. Other columns are not read."""
    w, chain = model

    def work(batches):
        for batch in batches:
            for lo, hi in stretches(batch.column(1)):
                scores = text_scores(batch.column(1)[lo:hi].to_pylist(), w, chain)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(scores)], ["_id", "_score"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, _score double")


def keep_good(docs, model, text_col="text", least=0.7):
    """The rows of ``docs`` whose text scores at least ``least``, in one scan."""
    place = docs.columns.index(text_col)
    w, chain = model

    def work(batches):
        for batch in batches:
            for lo, hi in stretches(batch.column(place)):
                good = text_scores(batch.column(place)[lo:hi].to_pylist(), w, chain) >= least
                yield batch.slice(lo, hi - lo).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
