"""Exact, near and line duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from decorum.llm import exact_dedup, line_dedup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_exact_copies_of_odd_rows(docs_of, odd):
    got = exact_dedup.mark_copies(docs_of(odd), counters=2).collect()
    assert len(got) == len(odd)
    groups = collections.defaultdict(list)
    for doc, text in odd:
        groups[hashlib.sha256((text or "").encode()).digest()].append(doc)
    kept = collections.Counter()
    for r in got:
        ids = groups[bytes(r._digest)]
        assert r._size == len(ids)
        assert r._keep == max((i for i in ids if i is not None), default=None)
        assert not r._kept or r._id == r._keep
        kept[bytes(r._digest)] += r._kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_one_row_of_each_text_stays(docs_of, odd):
    table = docs_of(odd)
    left = exact_dedup.drop_copies(table, counters=2)
    assert left.columns == table.columns
    texts = [r.text or "" for r in left.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in odd})


@pytest.mark.parametrize("counters", [1, 3, 10])
def test_misra_gries_keeps_every_frequent_key(spark, counters):
    rng = random.Random(counters)
    keys = [rng.choice("aaaaabbbccd") + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
    got = {r.k: r["_count"] for r in exact_dedup.misra_gries(df, "k", counters).collect()}
    real = collections.Counter(keys)
    assert len(got) <= counters
    assert all(k in got for k, n in real.items() if n > len(keys) / (counters + 1))
    assert all(0 < n <= real[k] for k, n in got.items())


def test_a_heavy_text_is_dropped_before_the_shuffle(docs_of):
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(3000)]
    found = exact_dedup.heavy_digests(docs_of(rows).select(F.col("doc_id").alias("_id"), exact_dedup.digest(F.col("text")).alias("_digest")))
    (hot,) = found.collect()
    assert hot["_size"] == 2000 and hot["_keep"] == 2999
    assert exact_dedup.drop_copies(docs_of(rows)).count() == 1001


def test_empty_tables(docs_of):
    none = docs_of([])
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert simhash.near_copies(none).count() == 0 and simhash.drop_near_copies(none).count() == 0
    assert line_dedup.drop_repeats(none).count() == 0


def plain_print(text, width=3, seed=42):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + width]).encode(), seed) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Component number of each fingerprint, by comparing all pairs."""
    n = len(prints)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def near_rows(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 60, 300]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i * 7 % n, " ".join(w)))
    return rows


def test_near_copies_against_all_pairs(docs_of, odd):
    rows = near_rows(random.Random(5), 240) + [(1000 + (d or 0), t) if d else (d, t) for d, t in odd if len(t or "") < 500]
    prints = [plain_print(t) for _, t in rows]
    label = plain_components(prints, 2)
    least = {}
    for (doc, _), comp in zip(rows, label):
        least[comp] = min((x for x in (doc, least.get(comp)) if x is not None), default=None)
    wanted = sorted((str(d), p, least[c]) for (d, _), p, c in zip(rows, prints, label))
    got = sorted((str(r._id), r._fp % (1 << 64), r._component) for r in simhash.near_copies(docs_of(rows)).collect())
    assert got == wanted
    left = simhash.drop_near_copies(docs_of(rows))
    assert {r.doc_id for r in left.collect()} == set(least.values())
    assert left.columns == docs_of([]).columns


def test_very_long_and_empty_texts_have_their_fingerprint(docs_of, odd):
    got = {(r["_id"], r["_fp"] % (1 << 64)) for r in simhash.fingerprints(docs_of(odd)).collect()}
    assert got == {(d, plain_print(t)) for d, t in odd}


@pytest.mark.parametrize("fields", [2, 3, 5])
def test_shards_lose_no_link(spark, fields):
    rng = np.random.default_rng(fields)
    base = rng.integers(-2**63, 2**63 - 1, 40)
    prints = set(base.tolist())
    for p in base.tolist():
        for _ in range(6):
            q = p % (1 << 64)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                q ^= 1 << int(b)
            prints.add(q - (1 << 64) if q >> 63 else q)
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "_fp long")
    at = {p: i for i, p in enumerate(prints)}
    label = list(range(len(prints)))
    for r in simhash.links(df, 2, fields).collect():
        a, b = label[at[r.u]], label[at[r.v]]
        label = [min(a, b) if x in (a, b) else x for x in label]
    assert label == plain_components([p % (1 << 64) for p in prints], 2)


def test_vantage_search_equals_comparison_of_all(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    prints[150:] = prints[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    pairs = []

    class Found:
        def add(self, u, v):
            pairs.extend(zip(u.tolist(), v.tolist()))

    simhash.search(prints, np.arange(0, 300, 2), (np.arange(300), np.full(300, 2)), 2, Found())
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    wanted = {(i, j) for i, j in zip(*map(list, np.nonzero(near))) if i % 2 == 0}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted


def test_components_of_a_long_path(spark, tmp_path):
    from decorum.llm.store import Shelf

    order = random.Random(1).sample(range(60), 60)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(100, 101), (102, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges, Shelf(spark, "t", str(tmp_path))).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100, 102: 100}


def plain_runs(rows, least):
    """Lines to delete: of every run of lines with enough words, each occurrence but
    the first, by trying all runs of all documents."""
    docs = {(d is None, d or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) - 2**64
             if xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63 else xxhash.xxh64_intdigest((t or "").encode(), 42)):
            (t or "").split("\n") for d, t in rows}
    first, gone = {}, collections.defaultdict(set)
    spots = []
    for key in sorted(docs):
        lines = docs[key]
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                run = tuple(lines[s:e + 1])
                if sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run) >= least:
                    spots.append((run, key, s, e))
                    first[run] = min(first.get(run, (key, s)), (key, s))
    for run, key, s, e in spots:
        if first[run] < (key, s):
            gone[key].update(range(s, e + 1))
    return {k: sorted(gone[k]) for k in docs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_runs_against_all_runs(docs_of, odd, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"{c}{i}" for i in range(rng.randrange(0, 5))) for c in "abcdefgh"] + [""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    rows += [(100 + (d or 0), t) if d else (d, t) for d, t in odd if len(t or "") < 500]
    least = 6
    wanted = plain_runs(rows, least)
    got = line_dedup.drop_repeats(docs_of(rows), min_words=least).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(k, v) for k, v in wanted.items() if k[0] == (r.doc_id is None) and (k[0] or k[1] == r.doc_id)]
        original = [t for d, t in rows if d == r.doc_id]
        assert r["_removed"] in [v for _, v in mine]
        kept = {None if t is None and not r["_removed"] else "\n".join(
            x for i, x in enumerate((t or "").split("\n")) if i not in r["_removed"]) for t in original}
        assert r.text in kept


def test_a_threshold_of_one_word_leaves_no_repeated_line(docs_of):
    rng = random.Random(11)
    pool = ["Les.", "And ornd.", "a b c", "one two three four", "", " ", "x"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {j}"]) for j in range(rng.randrange(1, 12)))) for i in range(30)]
    wanted = plain_runs(rows, 1)
    got = {r.doc_id: r for r in line_dedup.drop_repeats(docs_of(rows), min_words=1).collect()}
    assert {k[1]: v for k, v in wanted.items()} == {d: r["_removed"] for d, r in got.items()}
    left = [x for r in got.values() for x in r.text.split("\n") if x.strip()]
    assert len(left) == len(set(left))


def test_a_run_that_no_line_reaches_alone_is_found(docs_of):
    passage = "\n".join(f"line {i} has words" for i in range(20))
    rows = [(1, "first\n" + passage + "\nend of one"), (2, "other\n" + passage + "\nend of two"), (3, "line 3 has words")]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeats(docs_of(rows), min_words=50).collect()}
    assert got == {1: rows[0][1], 2: "other\nend of two", 3: rows[2][1]}
