"""Cleaning, sampling, reuse, vocabulary, privacy, metrics, display."""

import datetime as dt
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decorum import lexicon as L
from decorum.functions import scores as S
from decorum.operators import (
    cleaning, features, metrics, policy, privacy, reports, reuse, sampling, skew, vocabulary,
)
from decorum.plans.predict import blend
from decorum.sources.comments import comment_schema, read_comments, write_dataset


# ------------------------------------------------------ sources and cleaning

def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    text = 'He said ""no""'
    (tmp_path / "in.csv").write_text(f'comment_text,toxic\n"{text},\nand left",1\nplain,0\n')
    df = read_comments(spark, str(tmp_path / "in.csv"), "csv", comment_schema(labels=False))
    assert sorted(map(tuple, df.collect())) == [('He said "no",\nand left', "1"), ("plain", "0")]
    write_dataset(df, str(tmp_path / "out"))
    assert read_comments(spark, str(tmp_path / "out")).count() == 2
    write_dataset(df, str(tmp_path / "out_csv"), "csv")
    back = read_comments(spark, str(tmp_path / "out_csv"), "csv", comment_schema(labels=False))
    assert sorted(back.collect()) == sorted(df.collect())


def test_cleaning_rules(spark):
    kept = {"  Hello ": "hello", "none": "none", "NaN or not": "nan or not"}
    dropped = [None, "", "   ", "NA", "NULL", "None", "nan", "n/a", " N/A ", "Null"]
    rows = [(t, 1) for t in [*kept, *dropped]]
    df = spark.createDataFrame(rows, "comment_text string, toxic int")
    assert sorted(r.comment_text for r in cleaning.prepare(df).collect()) == sorted(kept.values())
    counts = cleaning.row_counts(df).first()
    assert (counts.rows_raw, counts.rows_clean) == (13, 3)
    assert counts.rows_missing + counts.rows_blank == len(dropped)


def test_label_columns(spark):
    two = spark.createDataFrame([("a", 1)], "comment_text string, toxic int")
    assert cleaning.ensure_labels(two).columns == ["comment_text", "toxic"]
    four = spark.createDataFrame([("a", 1, 1, 1)], "comment_text string, toxic int, obscene int, insult int")
    full = cleaning.ensure_labels(four)
    assert set(full.columns) == {"comment_text", "toxic", *L.EXTRA_LABELS}
    assert full.first().threat == 0 and full.first().obscene == 1


def test_bad_labels_are_set_aside(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None)], "comment_text string, toxic string")
    good, bad = cleaning.label_int(df)
    assert [r.toxic for r in good.collect()] == [1]
    assert sorted(r.comment_text for r in bad.collect()) == ["b", "c"]


def test_blank_comments_are_rejected(spark):
    df = spark.createDataFrame([(" a ",), (" \n ",), (None,)], "text string")
    ok, rejected = cleaning.split_valid(df)
    assert [r.text for r in ok.collect()] == ["a"]
    assert {r.reason for r in rejected.collect()} == {"Comment cannot be empty."}
    assert rejected.count() == 2


# ------------------------------------------------------------------ sampling

def test_sample_size_and_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    one = {r.doc_id for r in sampling.sample_n(df, 700).collect()}
    assert len(one) == 700
    assert one == {r.doc_id for r in sampling.sample_n(df.repartition(11), 700).collect()}
    by_hash = df.orderBy(F.md5(F.concat_ws(":", F.lit("42"), F.col("doc_id").cast("string")))).limit(700)
    assert one == {r.doc_id for r in by_hash.collect()}
    assert sampling.sample_n(df, 0).count() == 0
    assert sampling.sample_n(df, 5000).count() == sampling.sample_n(df, 9999).count() == 5000


@pytest.mark.parametrize("exact", [False, True])
def test_split_is_a_partition(spark, exact):
    df = spark.range(4003).withColumnRenamed("id", "doc_id")
    train, val = sampling.train_val_split(df, exact=exact)
    assert sorted(r.doc_id for r in train.unionByName(val).collect()) == list(range(4003))
    if exact:
        assert val.count() == math.ceil(0.2 * 4003)
    else:
        assert abs(val.count() / 4003 - 0.2) < 0.03


# --------------------------------------------------------------- reuse, skew

def _hot(spark, n=6000):
    """A third of all rows are one text."""
    return spark.range(n).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 997)).alias("text"),
        (F.col("id") * 7919 % n).alias("ts"),
    )


def test_hot_keys_are_few_and_salted(spark):
    df = _hot(spark)
    hot = skew.hot_keys(df, "text", share=0.01, at_least=50).collect()
    assert [r.text for r in hot] == ["hot"] and hot[0].salts == math.ceil(2000 / 60)
    salted = skew.add_salt(df, skew.hot_keys(df, "text", share=0.01, at_least=50), "text", F.col("id"))
    sizes = salted.groupBy("text", "salt").count().agg(F.max("count")).first()[0]
    assert sizes < 200


def test_join_with_hot_keys_is_whole(spark):
    df = _hot(spark)
    right = df.groupBy("text").agg(F.count("*").alias("n"))
    got = skew.join_unique(df, right, "text", F.col("id"), share=0.01, at_least=50)
    assert sorted(got.select("id", "text", "n").collect()) == sorted(
        df.join(right, "text").select("id", "text", "n").collect())


def test_each_text_is_scored_once_and_reused(spark):
    df = _hot(spark)
    seen = spark.sparkContext.accumulator(0)

    def scorer(texts):
        @F.udf("int")
        def measure(text):
            seen.add(1)
            return len(text)

        return texts.withColumn("score", measure("text")).withColumnRenamed("text", "comment")

    got = {r.id: (r.comment, r.score) for r in reuse.score_distinct(df, scorer).collect()}
    assert got == {r.id: (r.text, len(r.text)) for r in df.collect()}
    assert seen.value == df.select("text").distinct().count()


def test_known_texts_are_not_scored_again(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id long, text string")

    def scorer(texts):
        return texts.withColumn("score", F.lit(1))

    prior = reuse.distinct_texts(df.filter("text = 'a'")).drop("text").withColumn("score", F.lit(9))
    assert [r.text for r in reuse.new_texts(df.filter("id < 4"), prior).collect()] == ["b"]
    got = {r.id: (r.score, r.reused) for r in reuse.score_new(df, prior, scorer).collect()}
    assert got == {1: (9, True), 2: (1, False), 3: (9, True), 4: (1, False)}


def test_cached_flags_and_stats(spark):
    rows = [(1, " a "), (2, "a"), (3, "b"), (4, "a"), (5, "   ")]
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "id long, text string, ts long")
    ok, rejected = cleaning.split_valid(df)
    flags = {r.id: r.cached for r in reuse.with_cached_flag(ok).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: True} and rejected.count() == 1
    assert tuple(reuse.cache_stats(ok).first()) == (2, 2)
    hot = _hot(spark)
    first = {}
    for r in sorted(hot.collect(), key=lambda r: (r.ts, r.id)):
        first.setdefault(r.text, r.id)
    marked = reuse.with_cached_flag(hot).collect()
    assert len(marked) == 6000 and all(r.cached == (first[r.text] != r.id) for r in marked)


# ---------------------------------------------------------------- vocabulary

def test_vocabulary_joins(spark):
    words = ["fcuk", "fck", "pass", "that", "hello", "carp", "fuck", "table", "as"]
    vocab = spark.createDataFrame([(w,) for w in words], "word string")
    table = vocabulary.lexicon_table(spark)
    near = {r.word: r.lexicon_word for r in vocabulary.fuzzy_lexicon_join(vocab, table).collect()}
    assert near == {"fcuk": "fuck", "fck": "fuck", "pass": "ass", "that": "twat", "hello": "hell",
                    "carp": "crap", "as": "ass"}
    same = {r.word: r.lexicon_word for r in vocabulary.anagram_lexicon_join(vocab, table).collect()}
    assert same == {"fcuk": "fuck", "carp": "crap"}
    safe = vocabulary.word_table(spark, ["that"])
    assert vocabulary.exclude_words(vocab, safe).count() == len(words) - 1


# ------------------------------------------------------------------- privacy

def test_masking(spark):
    rows = [
        ("ssn 123-45-6789", "ssn <US_SSN>"), ("call 212-555-0123", "call <PHONE_NUMBER>"),
        ("(212) 555-0123 or +1 212.555.0123", "<PHONE_NUMBER> or <PHONE_NUMBER>"),
        ("mail a.b+c@mail.example.com.", "mail <EMAIL_ADDRESS>."), ("nothing @ all", "nothing @ all"),
        ("0123-45-67890", "0123-45-67890"), ("johnacompany.com", "johnacompany.com"),
    ]
    df = spark.createDataFrame(rows, "text string, wanted string")
    for r in privacy.mask_pii(df).collect():
        assert r.masked == r.wanted
    only = privacy.mask_pii(df, entities=["US_SSN"]).collect()
    assert only[0].masked == "ssn <US_SSN>" and only[1].masked == only[1].text
    summary = {r.entity: (r.texts, r.entities) for r in privacy.pii_summary(df).collect()}
    assert summary == {"EMAIL_ADDRESS": (1, 1), "US_SSN": (1, 1), "PHONE_NUMBER": (2, 3)}


def test_masking_has_no_length_limit(spark):
    rows = [("a" * n + "@example.com", "<EMAIL_ADDRESS>") for n in (64, 70, 5000)]
    rows += [("joe@example.xn--vermgensberatung-pwb", "<EMAIL_ADDRESS>"), ("josé@exämple.com!", "<EMAIL_ADDRESS>!"),
             ("x@" + "a." * 3000 + "com", "<EMAIL_ADDRESS>"), ("2125550123", "<PHONE_NUMBER>"), ("(212)-555-0123", "<PHONE_NUMBER>"),
             ("212–555–0123", "<PHONE_NUMBER>"), ("+12125550123", "<PHONE_NUMBER>"), ("4644348398010899", "4644348398010899"),
             ("a" * 50_000, "a" * 50_000)]
    df = spark.createDataFrame(rows, "text string, wanted string")
    for r in privacy.mask_pii(df).collect():
        assert r.masked == r.wanted
    with pytest.raises(ValueError):
        privacy.mask_pii(df, entities=["IBAN"])


def test_many_names_mask_like_few(spark):
    texts = [(i, f"The Report of Nam{"abcdefghij"[i % 10] * (1 + i % 4)} Smith, not Nameless. The end") for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string")
    names = spark.createDataFrame([("Nam" + "abcde"[i % 5] * (1 + i % 4),) for i in range(20)] * 2, "name string")
    few, many = (sorted(privacy.mask_person(df, "text", names, in_row=n).collect()) for n in (100, 5))
    assert few == many and few[3].text == "The Report of <PERSON>, not Nameless. The end"
    assert privacy.mask_person(spark.createDataFrame([(1, "Ask John Doe")], "id long, text string"), "text").first().text == "Ask <PERSON>"


def test_names(spark):
    text = "John Smith is a terrible manager, call him at john@company.com"
    df = spark.createDataFrame([(1, text), (2, "Johnny went Home"), (3, "Ask O'Neil")], "id long, text string")
    names = spark.createDataFrame([("John",), ("O'Neil",)], "name string")
    masked = privacy.mask_person(privacy.mask_pii(df, out="text"), "text", names)
    assert {r.id: r.text for r in masked.collect()} == {
        1: "<PERSON> is a terrible manager, call him at <EMAIL_ADDRESS>",
        2: "Johnny went Home", 3: "Ask <PERSON>",
    }
    own = privacy.mask_person(df, "text", lambda c: F.regexp_replace(c, "Home", "<PERSON>"))
    assert own.filter("id = 2").first().text == "Johnny went <PERSON>"


# ---------------------------------------------------------- scores, policies

def test_percentages_round_as_the_binary_value_asks(spark):
    values = [i / 10000 for i in range(10001)] + [0.0005, 0.0015, 0.12345, 1e-9, 0.99949999]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = {r.v: r.s for r in df.select("v", S.explanation(F.col("v"), F.lit("x")).alias("s")).collect()}
    assert got.pop(None) is None
    assert all(s == f"LLM confidence: {v:.1%} - x" for v, s in got.items())


def test_blend_and_bands(spark):
    rows = [(0.82, 0.97, 0.925, True, "HIGH"), (0.60, 0.05, 0.215, False, "LOW"), (0.85, 0.992, 0.9494, True, "HIGH")]
    df = spark.createDataFrame(rows, "ml_score double, llm_confidence double, h double, t boolean, r string")
    for r in blend(df).collect():
        assert r.hybrid_score == pytest.approx(r.h) and (r.is_toxic, r.risk_level) == (r.t, r.r)
    edges = spark.createDataFrame([(0.3,), (0.5,), (0.7,), (0.71,)], "h double")
    got = edges.select(S.risk_level(F.col("h")), S.is_toxic(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [("LOW", False), ("MEDIUM", False), ("MEDIUM", True), ("HIGH", True)]


def test_policies(spark):
    rows = [(1, "toxic", 0.97), (2, "insult", 0.5), (3, "toxic", 0.001), (4, "insult", 0.9375)]
    df = spark.createDataFrame(rows, "id int, llm_label string, llm_confidence double")
    got = {r.id: (r.policy_violation, r.llm_explanation)
           for r in policy.map_policy(df, policy.policy_table(spark)).collect()}
    hr = "🚨 HR Harassment Policy Violated"
    assert got == {
        1: (hr, f"LLM confidence: 97.0% - {hr}"),
        2: ("ℹ️ Review Required", "LLM confidence: 50.0% - Monitor"),
        3: (hr, f"LLM confidence: 0.1% - {hr}"),
        4: ("ℹ️ Review Required", "LLM confidence: 93.8% - Monitor"),
    }


def test_small_tables_are_broadcast_without_a_shuffle(spark):
    df = spark.range(10).select(F.concat(F.lit("t"), "id").alias("llm_label"), F.rand().alias("llm_confidence"))
    plan = policy.map_policy(df, policy.policy_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


# ------------------------------------------------------------ audit displays

def test_recent_rows_and_views(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), "t", 0.1, 0.2, 0.3, "LOW", "p") for i in range(60)]
    rows += [(99, at + dt.timedelta(minutes=59), None, None, None, None, None, None)]
    names = ("id long, timestamp timestamp_ntz, original_text_masked string, ml_score double, "
             "llm_confidence double, hybrid_score double, risk_level string, policy_violation string")
    df = spark.createDataFrame(rows, names)
    assert [r.id for r in reports.recent_audit(df).collect()] == [99, *range(59, 10, -1)]
    assert reports.recent_audit(df, 20).count() == 20 and reports.recent_audit(df, 0).count() == 0
    with pytest.raises(ValueError):
        reports.recent_audit(df, -1)
    view = {r.id: r for r in reports.audit_view(df).collect()}
    assert view[1].timestamp == "2024-01-01T00:01:00" and view[99].original_text_masked == ""
    half = df.limit(1).withColumn("timestamp", F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz"))
    assert reports.audit_view(half).first().timestamp == "2024-01-01T00:00:00.500000"
    shown = {r.id: r for r in reports.audit_display(df).collect()}
    assert (shown["#99"].ml, shown["#99"].badge, shown["#99"].risk, shown["#99"].colour) == ("—", "low", "—", "success")
    assert (shown["#5"].ml, shown["#5"].badge, shown["#5"].time) == ("10%", "low", "1/1/2024, 12:05:00 AM")
    bars = reports.score_long(df.filter("id = 5")).collect()
    assert {r.name: r.score for r in bars} == {"ML Model": 10, "LLM (BERT)": 20, "Hybrid": 30}


def test_percent_forms(spark):
    df = spark.createDataFrame([(0.9494,), (0.125,), (None,)], "s double")
    got = df.select(S.pct(F.col("s")), S.pct_str(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(95, "95%"), (13, "13%"), (None, None)]


# ------------------------------------------------------------ terms, metrics

def test_terms_of_a_small_corpus(spark):
    texts = ["The big cat saw a big dog", "big cat", "a cat", "big dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = features.ngrams(features.remove_stops(features.tokenize(df)))
    first = terms.filter("doc_id = 0").first().terms
    assert first == ["big", "cat", "saw", "big", "dog", "big cat", "cat saw", "saw big", "big dog"]
    tf, df_ = Counter(), Counter()
    for r in terms.collect():
        tf.update(r.terms)
        df_.update(set(r.terms))
    assert {r.term: r.tf for r in features.term_frequency(terms).collect()} == tf
    assert {r.term: r.df for r in features.document_frequency(terms, min_df=2).collect()} == {
        t: n for t, n in df_.items() if n >= 2}
    top = features.top_terms(terms, k=2, min_df=2).collect()
    assert [(r.term, r.tf, r.df) for r in top] == [("big", 4, 3), ("cat", 3, 3)]
    assert features.tokenize(spark.createDataFrame([("a",), ("",)], "text string")).select("tokens").collect() == [([],), ([],)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, pred int")
    assert metrics.accuracy(df).first().accuracy == pytest.approx(0.6)
    report = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert report["1"].f1 == pytest.approx(0.5) and report["1"].support == 2
    assert report["0"].precision == pytest.approx(2 / 3) and report["0"].support == 3
    assert report["macro avg"].f1 == pytest.approx(0.583333, abs=1e-6)
    assert report["weighted avg"].f1 == pytest.approx(0.6) and report["accuracy"].f1 == pytest.approx(0.6)
    weights = {r.label: r.weight for r in metrics.class_weights(df).collect()}
    assert weights == {0: pytest.approx(5 / 6), 1: pytest.approx(5 / 4)}
    never = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    assert {r["class"]: r.precision for r in metrics.classification_report(never).collect()}["1"] == 0.0


@pytest.mark.parametrize("k, min_df, spare, room", [(3, 1, 20, 5), (10, 2, 20, 1 << 20), (10, 3, 0, 40), (200, 1, 20, 20), (1, 1, 20, 1)])
def test_top_terms_equal_the_plain_count(spark, k, min_df, spare, room, monkeypatch):
    """Many stretches with different leaders, ties, a hot term, nulls; ``spare=0`` takes the way for too many winners."""
    rows = [(i, ["hot"] * (i % 3) + [f"t{i * j % 37}" for j in range(i % 11)] + ([None] if i % 5 == 0 else [])) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None), (301, [])], "doc_id long, terms array<string>").repartition(7, "doc_id")
    tf, docs = Counter(), Counter()
    for _, terms in rows:
        terms = [t for t in terms if t is not None]
        tf.update(terms)
        docs.update(set(terms))
    want = sorted(((t, n, docs[t]) for t, n in tf.items() if docs[t] >= min_df), key=lambda r: (-r[1], r[0]))[:k]
    cut = features.local_sums
    monkeypatch.setattr(features, "local_sums", lambda d, c, n: cut(d, c, n, room))
    assert [tuple(r) for r in features.top_terms(df, k=k, min_df=min_df, spare=spare).collect()] == want
    assert features.top_terms(df.limit(0), k=k, min_df=min_df).collect() == []


def test_top_terms_send_few_rows(spark):
    """Only leaders and possible winners are shuffled, not every term there is."""
    rows = [(i, [f"often{j}" for j in range(20)] + [f"once{i}_{j}" for j in range(50)]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(8, "doc_id")
    local = features.local_sums(df, "terms", 20).collect()
    assert len(local) == 20_000 + 20 * len({r.node for r in local})
    assert sum(r.top for r in local) == 20 * len({r.node for r in local})
    assert {r.term for r in features.top_terms(df, k=20, min_df=2).collect()} == {f"often{j}" for j in range(20)}


def test_local_sums_count_small_pieces(spark):
    """A batch of any size is counted in pieces, so a stretch ends within a batch too."""
    rows = [(i, [f"t{i * j % 101}" for j in range(i % 40)]) for i in range(500)] + [(500, None)]
    df = spark.createDataFrame(rows, "doc_id long, terms array<string>").coalesce(1)

    def counts(**how):
        local = features.local_sums(df, "terms", 20, **how)
        return {r.term: (r.tf, r.df) for r in local.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).collect()}

    assert counts(piece=64) == counts(piece=1) == counts()
    assert features.local_sums(df, "terms", 20, room=50, piece=64).select("node").distinct().count() > 1


def test_a_stretch_is_merged_part_by_part(monkeypatch):
    """A worker never holds a whole stretch twice, however large it is."""
    import pyarrow as pa

    docs = [[f"{'w' * (j % 19)}{i * 500 + j}" for j in range(500)] + ["often"] for i in range(40)]
    batches = [pa.record_batch([pa.array(docs[i:i + 10], pa.list_(pa.string()))], ["terms"]) for i in range(0, 40, 10)]

    class Frame:
        def select(self, _):
            return self

        def mapInArrow(self, work, _):
            return list(work(iter(batches)))

    most, concat = [0], pa.concat_tables
    monkeypatch.setattr(features.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    monkeypatch.setattr(pa, "concat_tables", lambda tables, **how: most.append(sum(t.num_rows for t in tables)) or concat(tables, **how))
    got = pa.Table.from_batches(features.local_sums(Frame(), k=20, room=1 << 20, piece=2_000)).to_pylist()
    assert sorted((r["term"], r["tf"], r["df"]) for r in got) == sorted([(t, 1, 1) for d in docs for t in d[:-1]] + [("often", 40, 40)])
    assert sum(r["top"] for r in got) == 20 and {r["node"] for r in got} == {3 << 24} and {r["top"] for r in got if r["term"] == "often"} == {True}
    assert max(most) < len(got) / 3


def test_terms_travel_in_small_batches(spark, monkeypatch):
    """Wide rows meet Python in batches of some MB; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    cut, before, seen = features.local_sums, spark.conf.get(key, None), []
    monkeypatch.setattr(features, "local_sums", lambda *a: seen.append(spark.conf.get(key)) or cut(*a))
    df = spark.createDataFrame([(["a b", "c"],), (["c"],)], "terms array<string>")
    assert [tuple(r) for r in features.top_terms(df, k=1, min_df=1).collect()] == [("c", 2, 2)]
    assert [int(s) for s in seen] == [features.BATCH] and spark.conf.get(key, None) == before
