"""Ranked search, language identification and collocations."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from decorum.llm import collocations, language_id, ranked_search
from decorum.llm.queries import fold_of
from decorum.llm.store import read

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FOLDER = "/root/testdata/sf0.001"


# Ranked search

def terms_of(text):
    return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranking(docs, items, k=10):
    """{(item, rank, id, score)} by scoring every document for every item."""
    held = [(i, collections.Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    total = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * len(held) // total
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs_of, docs, items, **how):
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, item string")
    rows = ranked_search.search(docs_of(docs), table, **how).collect()
    return sorted([(r["_item"], r["_rank"], r["_id"], r["_score"]) for r in rows], key=str)


@pytest.mark.parametrize("how", [{}, {"limit": 40}, {"k": 1}])
def test_search_ranks_as_scoring_all_does(spark, docs_of, odd, how):
    rng = random.Random(5)
    some = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = odd + [(100 + i, " ".join(rng.sample(some, rng.randrange(1, 40)))) for i in range(400)]
    docs += [(1000 - i, "w1 w2 rare copies W3") for i in range(50)]
    items = [(i, " ".join(rng.sample(some, 12))) for i in range(25)]
    items += [(50, "rare copies"), (50, "The, WORD1"), (51, None), (52, ""), (53, "..."), (None, "日本語 one"), (54, "notthere"), (55, "w1"), (55, "w1")]
    assert found(spark, docs_of, docs, items, **how) == ranking(docs, items, how.get("k", 10))


def test_search_over_small_shards(spark, docs_of):
    rng = random.Random(6)
    docs = [(i, " ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(30)))) for i in range(300)]
    posted = ranked_search.postings(docs_of(docs), spark.sparkContext.broadcast([f"t{i}".encode() for i in range(60)]), "doc_id", "text")
    index = ranked_search.build_index(posted, np.arange(60), 300, 4000, 7, 40)
    rows = index.collect()
    assert sum(len(r.ids) for r in rows) == sum(1 for _, t in docs if t) and max(len(r.ids) for r in rows) <= 7
    assert all(r.ids == sorted(r.ids) for r in rows)


def test_treap_holds_the_grid():
    rng = np.random.default_rng(3)
    for rows, columns in ((1, 1), (1, 90), (40, 3), (37, 300)):
        code = rng.choice(rows * columns, max(1, rows * columns // 4), replace=False)
        row, column, impact = code // columns, code % columns, rng.integers(1, 9, len(code))
        treap = ranked_search.Treap(*ranked_search.Treap.pack(row, column, impact, rows, columns))
        for _ in range(20):
            asked = np.unique(rng.integers(0, rows, 6))
            weight = rng.integers(0, 5, len(asked))
            total = np.zeros(columns, np.int64)
            for r, w in zip(asked, weight):
                np.add.at(total, column[row == r], w * impact[row == r])
            want = sorted(((-s, c) for c, s in enumerate(total.tolist()) if s > 0))[:5]
            score, place = treap.search(asked, weight, 5, some=3)
            assert [(-int(s), int(c)) for s, c in zip(score, place)] == want


def test_search_of_empty_tables(spark, docs_of):
    assert found(spark, docs_of, [], [(1, "a")]) == [] == found(spark, docs_of, [(1, "a")], [])
    assert found(spark, docs_of, [(1, None), (2, " ")], [(1, "a")]) == []


# Language identification

def test_network_responses_are_sums_over_places():
    net = language_id.Network(["a", "b"])
    rng = np.random.default_rng(1)
    net.out = rng.standard_normal(net.out.shape).astype(np.float32)
    raw = [b"", b"x", "The quick brown föx".encode(), bytes(rng.integers(0, 256, 700, dtype=np.uint8))]
    rows, used, count = language_id.windows_of(raw)
    assert used.tolist() == [0, 1, 20, 256, 256, 188] and count.tolist() == [1, 1, 1, 3]
    back = [bytes(r[:n].astype(np.uint8)) for r, n in zip(rows, used)]
    assert b"".join(back) == b"".join(raw) and all((r[n:] == language_id.PAD).all() for r, n in zip(rows, used))
    for row, p in zip(rows, net.probabilities(rows)):
        padded = [*row.tolist(), language_id.PAD, language_id.PAD, language_id.PAD]
        hidden = []
        for f in range(len(net.filters)):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            sums = [sum(float(net.filters[f, t] @ net.vectors[padded[at + t]]) for t in range(width)) for at in range(language_id.LENGTH)]
            hidden.append(max(0.0, max(sums) + float(net.bias[f])))
        z = np.array(hidden) @ net.out + net.prior
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_network_slopes_are_the_losses():
    net = language_id.Network(["a", "b", "c"])
    rng = np.random.default_rng(2)
    net.out = rng.standard_normal(net.out.shape)
    net.vectors, net.filters, net.prior = net.vectors.astype(float), net.filters.astype(float), net.prior.astype(float)
    net.bias = rng.standard_normal(net.bias.shape) / 10  # no response lies on the bend
    rows = language_id.windows_of([b"some words here", "änderung für".encode(), b"la casa"])[0]
    label = np.array([0, 1, 2])

    def loss():
        z = net.pooled(rows) @ net.out + net.prior
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(3), label]).mean())

    slopes = net.slopes(rows, label)
    for part, slope in zip(net.parts(), slopes):
        at = np.unravel_index(np.abs(slope).argmax(), part.shape)
        keep = part[at]
        part[at] = keep + 1e-5
        up = loss()
        part[at] = keep - 1e-5
        down = loss()
        part[at] = keep
        assert (up - down) / 2e-5 == pytest.approx(slope[at], rel=1e-3)


def test_held_out_documents_are_named(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    learn = fold_of(F.col("doc_id"), 4) != 2
    named = language_id.predict(docs, language_id.fit(docs, learn)).withColumnRenamed("_id", "doc_id")
    held = named.join(docs, "doc_id").filter(~learn)
    right, n = held.select(F.count_if(F.col("_lang") == F.col("lang")), F.count("*")).first()
    assert n > 200 and right / n > 0.98


def test_language_edge_cases(spark, docs_of, odd):
    docs = docs_of([*odd, (20, "123 ... \n"), (21, "é"), (22, "x" * 3_000_000)]).withColumn("lang", F.when(F.col("doc_id") != 7, F.col("lang")))
    for learn, label in ((F.lit(True), "en"), (F.lit(False), "und")):
        got = language_id.predict(docs, language_id.fit(docs, learn)).collect()
        assert len(got) == docs.count()
        for r in got:
            assert 0 <= r["_score"] <= 1
            if r["_id"] in (1, 2, 3, 20):
                assert (r["_lang"], r["_score"]) == ("und", 0)
            elif r["_id"] is not None:
                assert r["_lang"] == label
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0), F.lit(True))).count() == 0
    net = language_id.fit(docs, F.lit(True), per_label=3, sample=2, pieces=1)
    assert net.labels == ["en"]


# Collocations

def phrases(rows, least, top, longest=5):
    """{(lang, rank, phrase, a, l, r, n, score)} by counting every phrase."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    many = {p: a for p, a in f.items() if a >= least and len(p[1]) >= 2}
    gone = {(lang, p[i:j]) for (lang, p), a in many.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1)
            if j - i < len(p) and a >= f[lang, p[i:j]]}
    out = collections.defaultdict(list)
    for (lang, p), a in many.items():
        if (lang, p) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, some in out.items() for i, x in enumerate(sorted(some)[:top], 1)}


def mined(docs, **how):
    got = [tuple(r) for r in collocations.collocations(docs, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("budget", [1 << 20, 40])
def test_phrases_as_counting_all_gives(spark, docs_of, odd, budget):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcd") + rng.choice(["", "", ",", "\t", "!\n"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["New York City, new  york\x0bcity; x\x01 x x\x01 x é É日本 é"] * 9
    docs = odd + [(100 + i, t) for i, t in enumerate(texts)]
    table = docs_of(docs).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "en"))
    rows = [(r.lang, r.text) for r in table.collect()]
    got = mined(table, least=5, top=40, budget=budget)
    assert got == phrases(rows, 5, 40) and len(got) > 60


def letters_table(docs_of):
    rng = random.Random(1)
    docs = docs_of([(i, " ".join(rng.choice("abc") for _ in range(200))) for i in range(30)])
    return docs.select(F.lit("en").alias("_lang"), F.col("text").alias("_text"))


def full_map(spark):
    return spark.sparkContext.broadcast(np.full((1 << collocations.BITS) // 8, 255, np.uint8))


def unpacked(rows):
    """{range: Counter of suffixes} of packed suffixes."""
    out = collections.defaultdict(collections.Counter)
    for r in rows:
        group = collocations.Group(5)
        group.add(r.names, r.grid, r.n)
        group.tidy()
        for row, n in zip(group.grids[0].tolist(), group.counts[0].tolist()):
            out[r.range][tuple(group.names[i] for i in row if i >= 0)] += n
    return out


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_prefixes_are_extended_where_they_are_large(spark, docs_of, most):
    rows, full = letters_table(docs_of), full_map(spark)
    runs = collocations.count_runs(rows, full, full, (2, 3, 4, 5), 1, 6000, 150).collect()
    met = collections.Counter(tuple(t[i:i + k]) for r in rows.collect() for t in [r["_text"].split()] for i in range(200) for k in range(2, 6) if i + k <= 200)
    large = {p for p, n in met.items() if n > 150}
    assert len({r.large for r in runs if r.large is not None}) == len(large) > 9
    keys = spark.sparkContext.broadcast(np.sort(np.array([r.large for r in runs if r.large is not None])))
    got = unpacked(collocations.cut_suffixes(rows, full, full, full, keys, 5, 64, most).collect())
    place = {}
    for i, suffixes in got.items():
        for w in suffixes:
            prefix = next((w[:k] for k in range(2, len(w)) if w[:k] not in large), w)
            assert place.setdefault(prefix, i) == i
    assert len({place[p] for p in place if p[:2] == ("a", "b")}) > 1
    whole = sum(got.values(), collections.Counter())
    for p, n in met.items():
        assert sum(m for w, m in whole.items() if w[:len(p)] == p) == n


def test_subtree_totals(spark, docs_of):
    rng = random.Random(2)
    counts = collections.Counter(tuple(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(300))
    want = collections.Counter()
    for path, n in counts.items():
        for depth in range(2, len(path) + 1):
            want[path[:depth]] += n
    rows = np.array([[ord(c) for c in p] + [-1] * (5 - len(p)) for p in sorted(counts)])
    got = {tuple(map(chr, rows[i, :depth])): n for begin, depth, total in collocations.subtree(rows, np.array([counts[p] for p in sorted(counts)]), 5)
           for i, n in zip(begin.tolist(), total.tolist())}
    assert got == want


def test_pair_counts_come_back():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
        counts = rng.integers(1, 1 << 40, len(keys))
        back = collocations.unpack(collocations.pack(keys, counts), len(keys))
        assert (back[0] == keys).all() and (back[1] == counts).all()


def test_small_buffers_count_alike(spark, docs_of):
    rows, full = letters_table(docs_of), full_map(spark)

    def frequent(room):
        return sorted(r.at for r in collocations.count_runs(rows, full, None, (2,), 660, 6000, 1 << 20, room).collect())

    assert 0 < len(frequent(1 << 22)) < 9 and frequent(400) == frequent(1 << 22)


def test_no_phrases(spark, docs_of):
    assert mined(docs_of([])) == set() == mined(docs_of([(1, None), (2, "one two")]))


def test_a_full_bit_map_changes_nothing(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"a b c{i % 7} a b d. e f g") for i in range(40)])
    want = mined(docs, least=4)
    monkeypatch.setattr(collocations, "has", lambda bits, place: np.ones(len(place), bool))
    full = collocations.Words("en", np.zeros(1, np.uint8))
    full.number([b"a b"])
    assert full.often.tolist() == [False, True, True]
    monkeypatch.setattr(collocations, "bit_map", lambda spark, places: full_map(spark))
    assert mined(docs, least=4) == want
