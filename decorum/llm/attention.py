"""A small causal self-attention model over classes of subword ids, in numpy.

One residual attention layer: a token's state is its embedding plus the attended
values of the tokens before it and itself, with a learned bias for each distance;
the softmax gives the class of the next token. Class ``classes`` marks the start
of a text, ``classes + 1`` stands for nothing.
"""

import math

import numpy as np

WIDTH = 32
FRESH = 24


class Attention:
    """Parameters by name, and how they lie in one flat vector."""

    def __init__(self, classes, size=16, flat=None):
        self.classes, self.size = classes, size
        self.shapes = {"embed": (classes + 1, size), "query": (size, size), "key": (size, size), "value": (size, size),
                       "distance": (WIDTH,), "out": (classes, size), "bias": (classes,)}
        sizes = [math.prod(s) for s in self.shapes.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else np.asarray(flat, dtype=np.float32)
        at = 0
        for (name, shape), size in zip(self.shapes.items(), sizes):
            stop = at + size
            setattr(self, name, self.flat[at:stop].reshape(shape))
            at = stop

    def start(self, pairs, steps=800, rate=0.02):
        """Begin at the best bigram model of this size, with little attention.
        ``pairs[a, b]`` counts class b after class a; row ``classes`` is the start mark."""
        rng = np.random.default_rng(7)
        seen = pairs + 1e-3
        share = seen / seen.sum()
        before, after = share.sum(1, keepdims=True), share.sum(0, keepdims=True)
        lift = np.clip(np.log(share / (before * after)), -2, 2) * np.sqrt(before) * np.sqrt(after)
        left, values, right = np.linalg.svd(lift, full_matrices=False)
        root = np.sqrt(values[:self.size])
        k = len(root)
        part = [np.zeros(self.embed.shape), np.zeros(self.out.shape), np.log(after[0])]
        part[0][:, :k] = left[:, :k] * root / np.sqrt(before)
        part[1][:, :k] = right[:k].T * root / np.sqrt(after.T)
        part[0], part[1] = np.clip(part[0], -4, 4), np.clip(part[1], -4, 4)
        first, second = [np.zeros_like(x) for x in part], [np.zeros_like(x) for x in part]
        for t in range(1, steps + 1):
            e, u, bias = part
            z = e @ u.T + bias
            z = np.exp(z - z.max(1, keepdims=True))
            slope = share - before * z / z.sum(1, keepdims=True)
            for i, g in enumerate((slope @ u - 1e-7 * e, slope.T @ e - 1e-7 * u, slope.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                part[i] = part[i] + rate * (1 - t / (steps + 1)) * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.99 ** t)) + 1e-9)
        self.embed[:], self.out[:], self.bias[:] = part
        for name in ("query", "key", "value"):
            getattr(self, name)[:] = rng.normal(0, 0.1 / np.sqrt(self.size), (self.size, self.size))
        self.distance[:] = -0.05 * np.arange(WIDTH)
        return self


def distances(width):
    """Distance from each place to each earlier one, and where it is allowed."""
    gap = np.arange(width)[:, None] - np.arange(width)[None, :]
    return np.maximum(gap, 0), gap >= 0


class Room:
    """Arrays that batches of one shape are worked out in, made once for all of them."""

    def __init__(self, rows, width, c, d):
        places = rows * width
        make = lambda *shape: np.empty(shape, np.float32)
        self.shape = rows, width, c, d
        self.gap, self.causal = distances(width)
        self.pairs = np.empty((rows, width, width), np.intp)
        self.weight, self.slope = make(rows, width, width), make(rows, width, width)
        self.value, self.met, self.part = make(rows, width, d + 1), make(rows, width, d + 1), make(rows, width, d + 1)
        self.state, self.back, self.both = make(places, d), make(places, d), make(rows, width, 2 * d)
        self.odds = make(places, c)
        self.rows = np.arange(places)
        self.ones, self.all = np.ones(c, np.float32), np.ones(places, np.float32)


def longest(rows):
    return math.sqrt(np.einsum("ij,ij->i", rows, rows).max())


def step(model, inputs, targets, room=None):
    """Mean loss of a batch and its gradient; targets below zero do not count.

    Places know each other by class and distance only, so queries, keys, values and
    the weight of one class for another are worked out once per class, and so are
    their gradients. ``room`` is used if it fits the batch.
    """
    c, d = model.classes, model.size
    rows, width = inputs.shape
    if room is None or room.shape != (rows, width, c, d):
        room = Room(rows, width, c, d)
    e = np.vstack([model.embed, np.zeros((1, d), np.float32)])
    turns = np.concatenate([model.query, model.key, model.value], axis=1)
    turned = e @ turns
    q, k, v = turned[:, :d], turned[:, d:2 * d], turned[:, 2 * d:]
    valued = np.ones((c + 2, d + 1), np.float32)
    valued[:, :d] = v
    table = q @ k.T
    table *= np.float32(1 / math.sqrt(d))
    # Nothing has the score zero with all, so no score is further from zero than that.
    if not table.max() - table.min() < 50:
        table -= table[:, :c + 1].max(1, keepdims=True)
        np.clip(table, -50, 0, out=table)
    np.exp(table, out=table)
    table[:c + 1, c + 1] = 0
    near = np.exp(np.maximum(model.distance - model.distance.max(), -30))[room.gap] * room.causal
    np.add((inputs * (c + 2))[:, :, None], inputs[:, None, :], out=room.pairs)
    # Indices are in range; "clip" lets take write to its place at once.
    weight = np.take(table.ravel(), room.pairs, out=room.weight, mode="clip")
    weight *= near
    value = np.take(valued, inputs, axis=0, out=room.value, mode="clip")
    met = np.matmul(weight, value, out=room.met)
    # The last column of ones has added up the weights.
    per = 1 / met[..., d:]
    attended = (met[..., :d] * per).reshape(-1, d)
    state = np.take(e, inputs.ravel(), axis=0, out=room.state, mode="clip")
    state += attended
    p = np.matmul(state, model.out.T, out=room.odds)
    p += model.bias
    if not (longest(e) + longest(v)) * longest(model.out) + np.abs(model.bias).max() < 80:
        p -= p.max(-1, keepdims=True)
    np.exp(p, out=p)
    total = p @ room.ones
    targets = targets.ravel()
    counted = targets >= 0
    n = max(int(counted.sum()), 1)
    hit = room.rows * c + np.maximum(targets, 0)
    loss = -(np.log(np.take(p.ravel(), hit) / total + 1e-30) * counted).sum() / n
    g = Attention(c, d)
    share = (counted / n).astype(np.float32)
    p *= (share / total)[:, None]
    p.ravel()[hit] -= share
    np.matmul(p.T, state, out=g.out)
    np.matmul(room.all, p, out=g.bias)
    dh = np.matmul(p, model.out, out=room.back).reshape(rows, width, d)
    part, both = room.part, room.both
    np.multiply(dh, per, out=part[..., :d])
    np.negative(np.einsum("bij,bij->bi", part[..., :d], attended.reshape(dh.shape)), out=part[..., d])
    ds = np.matmul(part, value.transpose(0, 2, 1), out=room.slope)
    ds *= weight
    g.distance[:] = np.bincount(room.gap.ravel(), weights=(ds.sum(0) * room.causal).ravel(), minlength=WIDTH)
    # Sums by class of what each place hands back as a state and as a value.
    both[..., :d] = dh
    np.matmul(weight.transpose(0, 2, 1), part[..., :d], out=both[..., d:])
    order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
    hot = inputs.ravel()[order]
    firsts = np.append(0, np.flatnonzero(hot[1:] != hot[:-1]) + 1)
    back = np.zeros((c + 2, 2 * d), np.float32)
    back[hot[firsts]] = np.add.reduceat(np.take(both.reshape(-1, 2 * d), order, axis=0), firsts, axis=0)
    ds = np.bincount(room.pairs.ravel(), weights=ds.ravel(), minlength=(c + 2) ** 2).reshape(c + 2, c + 2).astype(np.float32)
    ds *= np.float32(1 / math.sqrt(d))
    parts = np.concatenate([ds @ k, ds.T @ q, back[:, d:]], axis=1)
    slopes = e.T @ parts
    g.query[:], g.key[:], g.value[:] = slopes[:, :d], slopes[:, d:2 * d], slopes[:, 2 * d:]
    np.add(back[:c + 1, :d], (parts @ turns.T)[:c + 1], out=g.embed)
    return loss, g.flat


def train(model, windows, least=0, batch=32, rate=0.015):
    """One pass of Adam over windows of classes (rows of WIDTH + 1, padded with
    ``classes + 1``) in the order given, and up to two more passes until there
    were ``least`` steps. Returns the new parameters."""
    new = Attention(model.classes, model.size, model.flat.copy())
    m, s = np.zeros_like(new.flat), np.zeros_like(new.flat)
    room = Room(batch, windows.shape[1] - 1, model.classes, model.size)
    once = -(-len(windows) // batch)
    steps = max(once, min(least, 3 * once))
    for t in range(1, steps + 1):
        rows = windows[(t - 1) % once * batch:((t - 1) % once + 1) * batch].astype(np.intp)
        targets = np.where(rows[:, 1:] < model.classes, rows[:, 1:], -1)
        _, slope = step(new, np.ascontiguousarray(rows[:, :-1]), targets, room)
        m *= 0.9
        m += 0.1 * slope
        s *= 0.99
        slope *= slope
        slope *= 0.01
        s += slope
        pace = rate * min(1, (t + 4) / 20) * (1 - 0.9 * (t - 1) / steps)
        size = np.sqrt(s * (1 / (1 - 0.99 ** t)))
        size += 1e-6
        new.flat -= (pace / (1 - 0.9 ** t)) * m / size
    return new.flat


class Scorer:
    """Log probabilities of whole texts with overlapping windows.

    Places know each other by class and distance only, so the attention of one
    class to another is a table made once. A window has WIDTH places; its last
    FRESH places are scored, each token of a text in exactly one window, with at
    least WIDTH - FRESH places of context.
    """

    def __init__(self, model):
        c, d = model.classes, model.size
        self.classes = c
        score = (model.embed @ model.query) @ (model.embed @ model.key).T / np.sqrt(d)
        table = np.zeros((c + 2, c + 2), np.float32)
        table[:c + 1, :c + 1] = np.exp(np.clip(score - score.max(1, keepdims=True), -60, 0))
        table[c + 1, c + 1] = 1
        self.table = table.ravel()
        self.embed = np.vstack([model.embed, np.zeros(d)]).astype(np.float32)
        # A last column of ones adds up the weights on the way.
        self.value = np.hstack([self.embed @ model.value, np.ones((c + 2, 1))]).astype(np.float32)
        gap, causal = distances(WIDTH)
        self.near = (np.exp(model.distance[gap] - model.distance.max()) * causal).astype(np.float32)[-FRESH:]
        # The bias is one more row, met by a one at the end of every state.
        self.out = np.vstack([model.out.T, model.bias]).astype(np.float32)
        self.ones = np.ones(c, np.float32)
        reach = (longest(self.embed) + longest(self.value[:, :-1])) * longest(model.out) + float(np.abs(model.bias).max())
        #: Could a logit be too large for exp?
        self.steep = not reach < 80

    def log_probs(self, stream, counts, batch=64):
        """Natural log probability of each class in ``stream``, the classes of texts of
        ``counts`` tokens one after the other. Every text needs one token at least."""
        counts = np.asarray(counts, dtype=np.int64)
        fresh = -(-counts // FRESH)
        lead = WIDTH - FRESH
        # Each text lies on places of its own: nothing, the start mark, then its tokens.
        room = lead + fresh * FRESH + 1
        at = np.cumsum(room) - room
        padded = np.full(int(room.sum()), self.classes + 1, dtype=np.intp)
        first = np.cumsum(counts) - counts
        places = np.repeat(at + lead - first, counts) + np.arange(len(stream)) + 1
        padded[places] = stream
        padded[at + lead] = self.classes
        starts = np.repeat(at, fresh) + FRESH * (np.arange(fresh.sum()) - np.repeat(np.cumsum(fresh) - fresh, fresh))
        out = np.zeros(len(padded), dtype=np.float32)
        span = np.arange(WIDTH)
        c, d, most = self.classes, self.embed.shape[1], min(batch, len(starts))
        pairs, picked = np.empty((most, FRESH, WIDTH), np.intp), np.empty((most, FRESH, WIDTH), np.float32)
        value, met = np.empty((most, WIDTH, d + 1), np.float32), np.empty((most, FRESH, d + 1), np.float32)
        odds, spots = np.empty((most * FRESH, c), np.float32), np.arange(most * FRESH) * c
        for lo in range(0, len(starts), batch):
            begin = starts[lo:lo + batch]
            n = len(begin)
            x = padded[begin[:, None] + span]
            mine = x[:, lead:]
            np.add((mine * (c + 2))[:, :, None], x[:, None, :], out=pairs[:n])
            # Indices are in range; "clip" lets take write to its place at once.
            weight = np.take(self.table, pairs[:n], out=picked[:n], mode="clip")
            weight *= self.near
            h = np.matmul(weight, np.take(self.value, x, axis=0, out=value[:n], mode="clip"), out=met[:n])
            h /= h[..., -1:]
            h[..., :-1] += np.take(self.embed, mine, axis=0)
            z = np.matmul(h.reshape(-1, d + 1), self.out, out=odds[:n * FRESH])
            # The next token of each place; what lies beyond a text's end is not read.
            ahead = (begin[:, None] + span[lead:] + 1).ravel()
            hit = np.take(z.ravel(), np.minimum(padded[ahead], c - 1) + spots[:len(z)])
            if self.steep:
                top = z.max(-1)
                z -= top[:, None]
                hit -= top
            np.exp(z, out=z)
            out[ahead] = hit - np.log(z @ self.ones)
        return out[places]
