"""The classifier, the scoring pipeline, the audit table and the streams."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from decorum import lexicon as L
from decorum.functions import scores as S
from decorum.operators import features, metrics
from decorum.plans import classify
from decorum.plans.predict import PREDICTION, predict, predict_rows
from decorum.session import shared_folder, utc_timestamp
from decorum.sources import audit
from decorum.sources.comments import read_comment_stream
from decorum.operators import reports
from decorum.sources.results import compact
from decorum.streaming import stream


@pytest.fixture(scope="module")
def corpus(spark):
    good = ["the report looks great and the team agrees", "see you at the weekly meeting tomorrow",
            "thanks for the review of my draft"]
    bad = ["you are a worthless idiot", "what a stupid moron you are", "nobody likes you worthless moron"]
    rows = [(i, good[i % 3] + f" item{i % 5}", 0) for i in range(40)]
    rows += [(100 + i, bad[i % 3] + f" item{i % 5}", 1) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int").cache()


@pytest.fixture(scope="module")
def model(corpus):
    return classify.train_classifier(corpus, max_iter=200)


def test_classifier_learns_and_survives_a_round_trip(spark, corpus, model, tmp_path):
    pairs = classify.evaluate(corpus, model)
    assert metrics.accuracy(pairs).first().accuracy == 1.0
    classify.save_model(model, str(tmp_path / "model"))
    again = classify.load_model(str(tmp_path / "model"))
    a, b = ({r.doc_id: r.ml_score for r in classify.ml_score(corpus, m).collect()} for m in (model, again))
    assert a == b and all(0 < s < 1 for s in a.values())


def test_pipeline_weights_equal_the_table_form(spark, corpus):
    """T5: the ML vectors and the relational tf-idf agree."""
    stops = L.COMMON_STOPS
    model = classify.train_classifier(corpus, max_iter=1, stop_words=stops)
    words = model.stages[4].vocabulary
    pipeline = {}
    for r in model.transform(corpus).select("doc_id", "features").collect():
        for i, v in zip(r.features.indices, r.features.values):
            pipeline[r.doc_id, words[int(i)]] = v
    terms = features.ngrams(features.remove_stops(features.tokenize(corpus), stops))
    table = {(r.doc_id, r.term): r.tfidf for r in features.tfidf(terms).collect()}
    assert table.keys() == pipeline.keys()
    assert all(table[k] == pytest.approx(pipeline[k]) for k in table)


COMMENTS = ["You are an idiot", "fcuk you, John", "You are an idiot", "  ", "Great job team!",
            "I will kill you", " You are an idiot ", "call 212-555-0123"]


@pytest.fixture(scope="module")
def comments(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, t, at + dt.timedelta(minutes=i)) for i, t in enumerate(COMMENTS)]
    return spark.createDataFrame(rows, "id long, text string, ts timestamp_ntz").cache()


def test_prediction_fields(spark, comments):
    scored, rejected = predict(comments, order_col="ts")
    rows = {r.id: r for r in scored.collect()}
    assert set(PREDICTION) <= set(scored.columns) and rejected.count() == 1 and len(rows) == 7
    assert [rows[i].cached for i in (0, 1, 2, 4, 5, 6)] == [False, False, True, False, False, True]
    first = rows[0]
    assert (first.comment, first.normalized_comment, first.llm_label) == (COMMENTS[0], COMMENTS[0], "insult")
    assert first.hybrid_score == pytest.approx(first.ml_score * 0.3 + first.llm_confidence * 0.7)
    assert rows[1].normalized_comment == "fuck you, John" and rows[1].llm_label == "toxic"
    assert rows[5].llm_label == "threat" and rows[5].policy_violation == L.POLICIES["threat"]
    assert rows[4].llm_label == "toxic" and rows[4].llm_confidence == 0.001 and rows[4].risk_level == "LOW"
    same = ["comment", "hybrid_score", "risk_level", "llm_explanation"]
    assert [rows[0][c] for c in same] == [rows[2][c] for c in same] == [rows[6][c] for c in same]


def test_reuse_changes_nothing(comments):
    with_reuse = {tuple(r[c] for c in ["id", *PREDICTION]) for r in predict(comments)[0].collect()}
    without = {tuple(r[c] for c in ["id", *PREDICTION]) for r in predict_rows(comments, key="id")[0].collect()}
    assert with_reuse == without


def test_masking_order(comments):
    """Compat masks what the normalizer left, strict masks the original."""
    compat = {r.id: r.masked_comment for r in predict(comments)[0].collect()}
    strict = {r.id: r.masked_comment for r in predict(comments, mode="strict")[0].collect()}
    assert compat[7] == "call ziz-ss-oize" and strict[7] == "call <PHONE_NUMBER>"


def test_names_are_masked(spark, comments):
    names = spark.createDataFrame([("John",)], "name string")
    masked = {r.id: r.masked_comment for r in predict(comments, names=names)[0].collect()}
    assert masked[1] == "fuck you, <PERSON>"


def test_trained_model_in_the_pipeline(comments, model):
    rows = {r.id: r for r in predict(comments, ml=model)[0].collect()}
    assert rows[0].ml_score > 0.5 > rows[4].ml_score


def fragile():
    """A classifier that fails on one text."""
    def load():
        def classify_one(text):
            if "John" in text:
                raise ValueError("no such thing")
            return "toxic", 0.9

        return classify_one

    return S.batch_scorer(load)


def test_a_bad_row_does_not_stop_the_job(spark, comments, tmp_path):
    scored, _ = predict(comments, order_col="ts", scorer=fragile())
    rows = {r.id: r for r in scored.collect()}
    assert rows[1].error == "no such thing" and rows[1].hybrid_score is None
    assert rows[0].error is None and rows[0].llm_confidence == 0.9 and len(rows) == 7
    assert audit.audit_rows(scored).count() == 4


def test_audit_table(spark, comments, tmp_path):
    path = str(tmp_path / "log")
    audit.init_audit(spark, path)
    assert audit.read_audit(spark, path).count() == 0
    scored, _ = predict(comments, order_col="ts")
    audit.append_audit(scored, path, batch_id=1, at=F.col("ts"))
    audit.append_audit(scored, path, batch_id=1, at=F.col("ts"))
    assert audit.read_audit(spark, path).count() == 5
    audit.append_audit(scored, path)
    log = audit.read_audit(spark, path)
    assert log.count() == 10 and log.filter("log_date = '2024-01-01'").count() == 5
    assert log.select("id").distinct().count() == 10
    audit.init_audit(spark, path)
    assert log.count() == 10
    bare = audit.audit_rows(scored.drop("policy_violation"))
    assert {r.policy_violation for r in bare.collect()} == {"None"}


def place(data, folder, n):
    """Files are taken in the order of their times."""
    (folder / f"{n}.parquet").write_bytes(data.read_bytes())
    os.utime(folder / f"{n}.parquet", (1_700_000_000 + n * 60,) * 2)


@pytest.fixture()
def feed(spark, comments, tmp_path):
    """Comments that arrive in three files, repeats across files included."""
    folder = tmp_path / "feed"
    folder.mkdir()
    for n, ids in enumerate(([0, 1, 2], [3, 4, 5], [6, 7])):
        part = str(tmp_path / f"part{n}")
        comments.filter(F.col("id").isin(ids)).coalesce(1).write.parquet(part)
        (data,) = (tmp_path / f"part{n}").glob("*.parquet")
        place(data, folder, n)
    return read_comment_stream(spark, str(folder), comments.schema, files_per_batch=1)


def run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_stream_scores_equal_batch_scores(spark, comments, feed, tmp_path):
    out = stream.score_stream(feed)
    run(out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")))
    cols = ["id", "comment", "hybrid_score", "risk_level", "masked_comment"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols).collect()
    assert sorted(got) == sorted(predict(comments)[0].select(cols).collect())


def test_stream_answers_repeats_from_stored_results(spark, comments, feed, tmp_path):
    base = str(tmp_path)
    run(stream.answer_stream(feed, f"{base}/results", f"{base}/answers", f"{base}/state"))
    results = spark.read.parquet(f"{base}/results")
    assert results.count() == results.select("text_key").distinct().count() == 5
    answers = {r.id: r for r in spark.read.parquet(f"{base}/answers").collect()}
    assert sorted(answers) == [0, 1, 2, 4, 5, 6, 7]
    assert answers[6].scored_in == answers[0].scored_in == 0 and answers[6].batch_id == 2
    assert answers[6].hybrid_score == answers[0].hybrid_score


def test_a_failed_text_is_scored_again(spark, comments, feed, tmp_path):
    base = str(tmp_path)
    run(stream.answer_stream(feed, f"{base}/results", f"{base}/answers", f"{base}/state", scorer=fragile(), audit=f"{base}/log"))
    results = spark.read.parquet(f"{base}/results")
    assert results.filter("error IS NOT NULL").count() == 0 and results.count() == 4
    answers = {r.id: r for r in spark.read.parquet(f"{base}/answers").collect()}
    assert answers[1].error == "no such thing" and sorted(answers) == [0, 1, 2, 4, 5, 6, 7]
    assert audit.read_audit(spark, f"{base}/log").count() == 4
    # The same feed with a scorer that works answers the text that failed, and only that one is scored.
    run(stream.answer_stream(feed, f"{base}/results", f"{base}/answers2", f"{base}/state2"))
    compact(spark, f"{base}/results", f"{base}/results2")
    assert spark.read.parquet(f"{base}/results2").select("text_key").distinct().count() == 5


def test_failed_texts_are_never_cached(spark, comments):
    twice = comments.unionByName(comments.withColumn("id", F.col("id") + 100))
    rows = predict(twice, order_col="ts", scorer=fragile())[0].filter("error IS NOT NULL").collect()
    assert len(rows) == 2 and not any(r.cached for r in rows)


def test_late_first_sightings_are_kept(spark, tmp_path):
    at = dt.datetime(2024, 6, 1)
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate([[(1, "new", at), (2, "new", at)], [(3, "new", at)], [(4, "years late", dt.datetime(2010, 1, 1)), (5, "new", at)]]):
        part = tmp_path / f"b{n}"
        spark.createDataFrame(rows, "id long, text string, ts timestamp_ntz").coalesce(1).write.parquet(str(part))
        (data,) = part.glob("*.parquet")
        place(data, folder, n)
    feed = read_comment_stream(spark, str(folder), "id long, text string, ts timestamp_ntz", files_per_batch=1)
    run(stream.first_sightings(feed, str(tmp_path / "seen"), str(tmp_path / "state")))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "seen")).collect()) == [1, 4]


def test_stream_audit_logs_first_sightings(spark, feed, tmp_path):
    from decorum.operators.cleaning import split_valid

    firsts = stream.dedup_stream(split_valid(feed)[0])
    run(stream.audit_stream(stream.score_stream(firsts), str(tmp_path / "log"), str(tmp_path / "state")))
    assert audit.read_audit(spark, str(tmp_path / "log")).count() == 5


def test_late_rows_count_in_their_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 10)
    batches = [[(1, "You are an idiot", at), (2, "fine", at + dt.timedelta(minutes=59))],
               [(3, "fine", at + dt.timedelta(hours=5)), (4, "fine", at + dt.timedelta(days=3))],
               [(5, "days too late", at), (6, "fine", at - dt.timedelta(days=5)), (7, "days too late", at - dt.timedelta(hours=1))]]
    folder = tmp_path / "in"
    folder.mkdir()
    for n, rows in enumerate(batches):
        part = tmp_path / f"b{n}"
        spark.createDataFrame(rows, "id long, text string, ts timestamp_ntz").coalesce(1).write.parquet(str(part))
        (data,) = part.glob("*.parquet")
        place(data, folder, n)
    feed = read_comment_stream(spark, str(folder), "id long, text string, ts timestamp_ntz", files_per_batch=1)
    base = str(tmp_path)
    run(stream.answer_stream(feed, f"{base}/results", f"{base}/answers", f"{base}/state", counts=f"{base}/counts"))
    got = {(r.window_start.day, r.window_start.hour, r.risk_level): (r.arrivals, r.misses, r.hits)
           for r in stream.window_counts(spark, f"{base}/counts").collect()}
    assert got == {(10, 0, "MEDIUM"): (1, 1, 0), (10, 0, "LOW"): (2, 1, 1), (10, 5, "LOW"): (1, 0, 1), (13, 0, "LOW"): (1, 0, 1),
                   (5, 0, "LOW"): (1, 0, 1), (9, 23, "LOW"): (1, 1, 0)}
    whole = stream.stream_hits(spark.read.parquet(f"{base}/answers"), by=["risk_level"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, stream.window_counts(spark, f"{base}/counts").select(whole.columns).collect()))
    # A batch that is run again, on an empty checkpoint, changes neither results nor counts of its number.
    again = stream.answer_stream(feed, f"{base}/results", f"{base}/answers", f"{base}/state2", counts=f"{base}/counts")
    run(again)
    assert spark.read.parquet(f"{base}/results").count() == 3
    assert {(r.window_start.day, r.window_start.hour, r.risk_level): (r.arrivals, r.misses, r.hits)
            for r in stream.window_counts(spark, f"{base}/counts").collect()} == got


def test_results_are_looked_up_without_a_shuffle_of_them(spark, tmp_path):
    from decorum.sources import results

    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("text_key"), "id")
    table = results.Results(spark, str(tmp_path / "r"), rows.schema)
    table.add(rows.filter("id < 3000"), 0)
    table.add(rows.filter("id >= 3000"), 1)
    assert table.read().count() == 5000 and table.of(rows.filter("id % 2 = 0")).count() == 2500

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    few = table.of(rows.filter("id IN (7, 4000, 9999)"))
    assert sorted((r.id, r.scored_in) for r in few.collect()) == [(7, 0), (4000, 1)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        many = plan(table.of(rows.filter("id < 4000")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # One exchange, of the keys.
    assert many.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in many
    compact(spark, str(tmp_path / "r"), str(tmp_path / "r2"))
    # Few keys read their buckets only: all other files may be unreadable.
    wanted = {r.b for r in spark.createDataFrame([(7,), (4000,)], "id long").select(
        F.pmod(F.hash(F.sha2(F.col("id").cast("string"), 256)), F.lit(64)).alias("b")).collect()}
    for file in (tmp_path / "r").glob("*.parquet"):
        if int(file.name.split("_")[1][:5]) not in wanted:
            file.write_bytes(b"junk" * 100)
            (tmp_path / "r" / f".{file.name}.crc").unlink(missing_ok=True)
    assert sorted(r.id for r in table.of(rows.filter("id IN (7, 4000)")).collect()) == [7, 4000]
    assert len(list((tmp_path / "r2").glob("*.parquet"))) <= 64
    assert results.Results(spark, str(tmp_path / "r2"), rows.schema).read().count() == 5000


def test_no_csv_record_is_lost(spark, tmp_path):
    from decorum.sources.comments import comment_schema, read_checked

    (tmp_path / "in.csv").write_text('comment_text,toxic\n"fine, ""quoted"" text",1\nplain,0\n"two\nlines",1\n'
                                     'too,1,many\n"also, too",1,many,"x,y"\nfew\n,\n"never closed,0\nlast,1\n')
    good, bad = read_checked(spark, str(tmp_path / "in.csv"), comment_schema(labels=False))
    assert {(r.comment_text, r.toxic) for r in good.collect()} == {('fine, "quoted" text', "1"), ("plain", "0"), ("two\nlines", "1"), (None, None)}
    got = {(r.line.strip(), r.reason) for r in bad.collect()}
    assert got == {("too,1,many", "surplus fields"), ('"also, too",1,many,"x,y"', "surplus fields"), ("few", "missing fields"),
                   ('"never closed,0\nlast,1', "unclosed quote")}
    lines, broken = read_checked(spark, str(tmp_path / "in.csv"), comment_schema(labels=False), multiline=False)
    assert ("last", "1") in {(r.comment_text, r.toxic) for r in lines.collect()}
    assert '"never closed,0' in {r.line for r in broken.collect() if r.reason == "unclosed quote"}
    numbers = comment_schema(labels=False)
    numbers["toxic"].dataType = __import__("pyspark").sql.types.IntegerType()
    (tmp_path / "n.csv").write_text("comment_text,toxic\na,1\nb,no\n")
    good, bad = read_checked(spark, str(tmp_path / "n.csv"), numbers)
    assert [(r.comment_text, r.toxic) for r in good.collect()] == [("a", 1)] and [tuple(r) for r in bad.collect()] == [("b,no", "other type")]


def test_the_slope_is_that_of_the_objective(spark, corpus):
    model = classify.train_classifier(corpus, min_df=1)
    assert classify.steepest(corpus, model) < 1e-4
    early = classify.train_classifier(corpus, min_df=1, max_iter=1)
    assert classify.steepest(corpus, early) > 1e-3


def test_newest_rows_read_the_newest_days_only(spark, tmp_path):
    path, sums = str(tmp_path / "log"), str(tmp_path / "sums")
    rows = spark.range(600).select(
        F.concat(F.lit("t"), "id").alias("comment"), F.lit("m").alias("masked_comment"), F.lit(0.1).alias("ml_score"),
        F.when(F.col("id") % 3 > 0, F.col("id") / 600).alias("llm_confidence"), F.lit(0.3).alias("hybrid_score"), F.lit("LOW").alias("risk_level"),
        F.when(F.col("id") % 50 > 0, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))")).alias("ts"), "id")
    for batch in (0, 1, 1):
        audit.append_audit(rows.filter(F.col("id") % 2 == batch), path, batch, F.col("ts"), F.col("id"), summary=sums)
    log = audit.read_audit(spark, path)
    want = reports.risk_summary(log)
    got = audit.read_summary(spark, sums).select(want.columns)
    show = lambda df: sorted(str([x if not isinstance(x, float) else round(x, 9) for x in r]) for r in df.collect())
    assert show(got) == show(want)
    for n in (0, 1, 20, 50, 588, 589, 600, 700):
        for days in (None, audit.read_summary(spark, sums)):
            some = reports.recent_audit(reports.newest_days(log, n, days), n)
            assert [r.id for r in some.collect()] == [r.id for r in reports.recent_audit(log, n).collect()]
    newest = reports.newest_days(log, 50, got)
    assert newest.select(F.input_file_name()).distinct().count() <= 6
    assert "PartitionFilters: [(" in newest._jdf.queryExecution().executedPlan().toString() or "log_date" in newest._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


class Unset:
    """A session without the setting for shared folders."""

    class conf:  # noqa: N801
        get = staticmethod(lambda name, default=None: default)


def test_shared_folder_needs_a_setting(tmp_path):
    with pytest.raises(ValueError):
        shared_folder(Unset, "x")
    first, second = (shared_folder(Unset, "x", str(tmp_path)) for _ in range(2))
    assert first != second and first.startswith(str(tmp_path))


def test_utc_timestamp_ignores_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got.append(df.select(F.unix_micros(utc_timestamp(F.col("ts")))).first()[0])
        assert got[0] == got[1] == 1710037800000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_answers_hold_no_texts(spark, comments, feed, tmp_path):
    """A text lies once with its result, or once a batch if it failed, however often it arrives."""
    base = str(tmp_path)
    run(stream.answer_stream(feed, f"{base}/results", f"{base}/answers", f"{base}/state", scorer=fragile()))
    assert not {"text", *stream.TEXTS} & set(spark.read.parquet(f"{base}/answers").columns)
    assert spark.read.parquet(f"{base}/answers-failed").count() == 1
    cols = ["id", "comment", "masked_comment", "normalized_comment", "hybrid_score", "error"]
    got = stream.read_answers(spark, f"{base}/answers", f"{base}/results").select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, predict(comments, scorer=fragile())[0].select(cols).collect()))


def test_keyed_rows_are_valid_by_their_key(spark):
    from decorum.operators.cleaning import split_valid
    from decorum.operators.reuse import with_key

    keyed = with_key(spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "id int, text string"))
    ok, rejected = split_valid(keyed)
    assert [r.id for r in ok.collect()] == [1] and sorted(r.id for r in rejected.collect()) == [2, 3]
    assert "trim" not in ok.drop("text")._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_day_has_many_files(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(
        "id", F.md5(F.col("id").cast("string")).alias("comment"), F.md5(F.col("id").cast("string")).alias("masked_comment"), F.lit(0.1).alias("ml_score"),
        F.lit(0.2).alias("llm_confidence"), F.lit(0.3).alias("hybrid_score"), F.lit("LOW").alias("risk_level"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        audit.append_audit(rows, str(tmp_path / "log"), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    log = audit.read_audit(spark, str(tmp_path / "log"))
    assert log.count() == log.select("id").distinct().count() == 20_000
    assert log.select(F.input_file_name()).distinct().count() >= 4


def test_csv_of_many_files(spark, tmp_path, monkeypatch):
    """No task writes or reads all lines."""
    from decorum import queries

    texts = [f"text {i}, \"quoted\"\nnext" if i % 7 else None for i in range(4_000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "folder_for", lambda spark, purpose: str(tmp_path / purpose))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.kind: (r.n, r.chars) for r in queries.csv_rejects(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "csv-rejects" / "comments").glob("part-*"))
    assert len(files) > 1 and all(f.read_text().startswith("comment_text,toxic\n") for f in files if f.stat().st_size)
    assert sum(n for n, _ in got.values()) == sum(t is not None or i % 10 != 6 for i, t in enumerate(texts))
    assert got["surplus fields"][0] == sum(t is not None and i % 10 == 3 for i, t in enumerate(texts))


def tables(spark, folder, rows, events):
    """Documents (doc_id, text) and events that bring them by number."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    times = [(i, dt.datetime(2024, 5, 1 + i % 3, i % 24)) for i in range(events)]
    spark.createDataFrame(times, "event_id long, ts timestamp_ntz").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("fails", [False, True])
def test_computed_only_gives_the_rows_that_the_log_takes(spark, comments, fails):
    scorer = fragile() if fails else S.lexicon_scorer
    twice = comments.unionByName(comments.withColumn("id", F.col("id") + 100)).unionByName(comments.limit(2))
    late = twice.withColumn("ts", F.when(F.col("id") % 3 > 0, F.col("ts")))
    for df in (twice, late):
        whole = audit.audit_rows(predict(df, order_col="ts", scorer=scorer)[0], F.col("ts"), F.col("id")).collect()
        slim = audit.audit_rows(predict(df, order_col="ts", computed_only=True, scorer=scorer)[0], F.col("ts"), F.col("id")).collect()
        assert whole and sorted(map(str, whole)) == sorted(map(str, slim))


def test_an_audit_log_keeps_no_text_once_an_arrival(spark, tmp_path):
    from decorum import queries

    texts = ["you idiot", "see you", "you idiot", None, " ", "mail ann@example.com"]
    folder = tables(spark, tmp_path, list(enumerate(texts)), 60)
    path = queries._audit_log(spark, folder)
    kept = spark.read.parquet(f"{path}/scored")
    assert kept.count() == 3 and not {"comment", "normalized_comment"} & set(kept.columns)
    log = audit.read_audit(spark, f"{path}/log").collect()
    assert sorted(r.id for r in log) == [0, 1, 5]
    assert sum(r.n for r in audit.read_summary(spark, f"{path}/sums").collect()) == 3


def test_stream_texts_are_stored_once_and_stay_in_their_buckets(spark, tmp_path):
    """A frequent text too comes back with every answer; only such texts are sent to their rows."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, "you idiot" if i % 2 else f"see you at {i % 1500}", at + dt.timedelta(seconds=i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, text string, ts timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    base = str(tmp_path)
    run(stream.answer_stream(read_comment_stream(spark, f"{base}/in", df.schema), f"{base}/results", f"{base}/answers", f"{base}/state"))
    assert not os.path.exists(f"{base}/results-scored") and spark.read.parquet(f"{base}/results").count() == 751
    answers = stream.read_answers(spark, f"{base}/answers", f"{base}/results")
    cols = ["id", *stream.TEXTS, "hybrid_score", "risk_level", "error"]
    assert sorted(map(str, answers.select(cols).collect())) == sorted(map(str, predict(df)[0].select(cols).collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = stream.read_answers(spark, f"{base}/answers", f"{base}/results")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # The largest join, of all rows but hot ones and failed ones, reads the buckets with no exchange between.
    first = plan[plan.index("SortMergeJoin"):].split("SortMergeJoin")[1]
    assert "Bucketed: true" in plan and "hashpartitioning(text_key" in first and ", 64)" in first
