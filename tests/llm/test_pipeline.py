"""The pipeline and the registered queries as wholes."""

import collections
import random
import re

import pytest
from test_dedup import plain_components, plain_print
from test_texts import plain_leaks, water_level

import corpus_pipeline
from decorum.llm import quality_crf, queries
from decorum.llm.store import read


def prose(rng, n):
    pick = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "st"]) for _ in range(rng.randrange(1, 5)))
    return "\n".join(" ".join(pick() for _ in range(12)) + "." for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, docs_of, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    passage = prose(rng, 2).replace("\n", " ")
    rows = [(1000 + i if d is None else d, t, None) for i, (d, t) in enumerate(odd) if d != 4 and d != 5]
    rows += [(20 + i, prose(rng, rng.randrange(1, 9)), rng.choice("aab")) for i in range(150)]
    rows += [(300 + i, rows[30][1], "a") for i in range(40)]
    rows += [(400 + i, rows[40 + i % 5][1] + " more", "b") for i in range(20)]
    rows += [(500 + i, prose(rng, 2) + "\n" + passage + "\n" + prose(rng, 1), "a") for i in range(5)]
    rows += [(600 + i, " ".join(w.upper() + "!!" for w in prose(rng, 3).split(" ")), "a") for i in range(60)]
    docs_of(rows, clash=False).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(d, 0 if d >= 600 else 1, 0) for d, *_ in rows if d >= 20 and d % 3]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_plain_steps(spark, folder):
    docs = [(r.doc_id, r.text, r.source) for r in read(spark, folder, "documents").collect()]
    model = queries.quality_model(read(spark, folder, "documents"), read(spark, folder, "labels"))
    good = [d for d, s in zip(docs, quality_crf.text_scores([t for _, t, _ in docs], *model)) if s >= 0.7]
    assert not any(d >= 600 for d, _, _ in good if d < 1000) and sum(20 <= d < 600 for d, _, _ in good) == 215
    last = {}
    for d in good:
        if d[1] not in last or last[d[1]][0] < d[0]:
            last[d[1]] = d
    unique = sorted(last.values())
    label = plain_components([plain_print(t) for _, t, _ in unique], 2)
    first = {}
    for d, c in zip(unique, label):
        first.setdefault(c, d)
    passage = [r.text for r in read(spark, folder, "benchmark").collect() if r.text]
    clean = [d for d in first.values() if not any(plain_leaks(d[1], [(7, p) for p in passage], 10)[0])]
    assert not any(500 <= d < 505 for d, _, _ in clean)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in clean}
    total = collections.Counter()
    for d, _, s in clean:
        total[s] += size[d]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    aim = dict(zip(names, water_level([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3)))
    got = corpus_pipeline.run(spark, folder).collect()
    taken = collections.Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.target == pytest.approx(aim[r.source]) and 0 < r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert {r.doc_id for r in got} <= set(size)
    for s in names:
        assert abs(taken[s] - aim[s]) <= 64 + 0.01 * aim[s]


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = read(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_chat_format", "op8_line_dedup"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_cluster_needs_a_shared_folder():
    from decorum.llm.store import Shelf

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        Shelf(Session, "x")
