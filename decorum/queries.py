"""The registered queries: each takes (spark, folder of the test tables)."""

import atexit
import shutil
import tempfile

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions import scores as S
from decorum.functions import text as T
from decorum.functions.privacy import name_tokens
from decorum.operators import (
    cleaning, features, metrics, privacy, reports, reuse, sampling, vocabulary,
)
from decorum.operators.names import learn_names, mask_learned
from decorum.operators.policy import map_policy, policy_table
from decorum.plans import classify, textmodel
from decorum.plans.normalize import normalize
from decorum.plans.predict import PREDICTION, blend, predict, score_texts
from decorum.session import shared_folder, spread
from decorum.sources import audit
from decorum.sources.comments import comment_schema, read_checked, read_comment_stream, read_comments, write_dataset
from decorum.streaming import stream

SCORES = ["ml_score", "llm_confidence", "hybrid_score"]


def table(spark, folder, name):
    return read_comments(spark, f"{folder}/{name}.parquet")


def dealt(df, source):
    """The test tables are one small file each: deal such a table out to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return spread(df, cores if len(source.inputFiles()) < cores else None)


def folder_for(spark, purpose):
    """A shared folder; a local session without the setting, as in tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="decorum-")
        atexit.register(shutil.rmtree, base, True)
    return shared_folder(spark, purpose, base)


def rounded(df, cols=SCORES):
    return df.withColumns({c: F.round(c, 6) for c in cols if c in df.columns})


# ------------------------------------------------------------- normalizer

def _docs(spark, folder):
    docs = table(spark, folder, "documents")
    return dealt(docs.select("doc_id", "text"), docs)


def _step(name, step):
    def query(spark, folder):
        return _docs(spark, folder).select("doc_id", step(F.col("text")).alias(name))

    return query


def chat_normalize(spark, folder):
    chats = table(spark, folder, "conversations")
    return normalize(dealt(chats.select("conv_id", "turn", "text"), chats)).select("conv_id", "turn", "normalized")


def normalize_full(spark, folder):
    return normalize(_docs(spark, folder)).select("doc_id", "normalized")


def evasion_report(spark, folder):
    return reports.evasion_report(_docs(spark, folder))


def _words(spark, folder):
    return vocabulary.words(_docs(spark, folder))


def vocab_near_words(spark, folder):
    return vocabulary.fuzzy_lexicon_join(_words(spark, folder), vocabulary.lexicon_table(spark))


def vocab_anagrams(spark, folder):
    return vocabulary.anagram_lexicon_join(_words(spark, folder), vocabulary.lexicon_table(spark))


def vocab_unsafe_words(spark, folder):
    return vocabulary.exclude_words(
        _words(spark, folder), vocabulary.word_table(spark, lexicon.SAFE_WORDS)
    )


# ---------------------------------------------------------------- privacy

def mask_pii_texts(spark, folder):
    return privacy.mask_pii(_docs(spark, folder)).select("doc_id", "masked")


def mask_after_normalize(spark, folder):
    done = normalize(_docs(spark, folder))
    return privacy.mask_pii(done, "normalized").select("doc_id", "masked")


def pii_summary(spark, folder):
    return privacy.pii_summary(_docs(spark, folder))


def mask_names(spark, folder):
    # Names: all capitalised words of all chat turns.
    chats = table(spark, folder, "conversations")
    names = chats.select(F.explode(name_tokens(F.col("text"))).alias("name"))
    return privacy.mask_person(_docs(spark, folder), "text", names, "doc_id")


#: Sentences around a planted name, with the same ones in the DuckDB statement.
PLANTED = ["my friend {} said so", "we met {} yesterday", "then they asked {} politely", "greet Dr. {} kindly"]


def names_learned(spark, folder):
    """Names in no list. Every document gets a sentence with a name: a listed first name, or one
    made of a nation's, which no list holds. All are to be found, and nothing else."""
    docs = _docs(spark, folder)
    nations = table(spark, folder, "nation").select(F.collect_list(F.struct("n_nationkey", "n_name")).alias("l"))
    nations = nations.select(F.transform(F.array_sort("l"), lambda x: F.initcap(F.translate(F.lower(x["n_name"]), "_0123456789", "zabcdefghij"))).alias("l")).scalar()
    first = F.array(*[F.lit(n) for n in lexicon.FIRST_NAMES])
    name = F.when(F.col("doc_id") % 2 == 0, F.get(first, (F.col("doc_id") % len(lexicon.FIRST_NAMES)).cast("int")))
    name = name.otherwise(F.get(nations, (F.col("doc_id") % F.size(nations)).cast("int")))
    texts = [F.format_string(p.replace("{}", "%s"), name) for p in PLANTED]
    sentence = F.get(F.array(*texts), F.pmod(F.floor(F.col("doc_id") / 2), F.lit(len(PLANTED))).cast("int"))
    planted = docs.select("doc_id", F.concat_ws("\n", "text", sentence).alias("text"))
    rules = learn_names(planted, "text", folder_for(spark, "names"))
    return mask_learned(planted, "text", rules)


# ------------------------------------------------------------- preparation

def _labelled(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("comment_text"))
    return docs.join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")


def _lines(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))


def clean_comments(spark, folder):
    return cleaning.prepare(_labelled(spark, folder))


def cleaning_counts(spark, folder):
    return cleaning.row_counts(_lines(spark, folder), "line")


def reject_blank(spark, folder):
    ok, rejected = cleaning.split_valid(_lines(spark, folder), "line")
    both = ok.withColumn("reason", F.lit("ok")).unionByName(rejected.withColumn("line", F.lit("")))
    return both.groupBy(F.col("reason").alias("status")).agg(
        F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")
    )


def label_int(spark, folder):
    # Every third label is no number: both halves are returned.
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    label = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("toxic").cast("string"))
    good, bad = cleaning.label_int(docs.select("doc_id", label.alias("label")), "label")
    return good.withColumn("rejected", F.lit(None).cast("string")).unionByName(
        bad.select("doc_id", F.lit(None).cast("int").alias("label"), F.col("label").alias("rejected")))


def select_xy(spark, folder):
    return cleaning.select_xy(_labelled(spark, folder))


def sample_n(spark, folder):
    return sampling.sample_n(table(spark, folder, "documents").select("doc_id", "text"), 200)


def _split(exact):
    def query(spark, folder):
        docs = table(spark, folder, "documents").select("doc_id")
        train, val = sampling.train_val_split(docs, exact=exact)
        return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))

    return query


# ---------------------------------------------------------------- features

def _tokens(spark, folder):
    return features.remove_stops(features.tokenize(_docs(spark, folder)))


def _terms(spark, folder):
    return features.ngrams(_tokens(spark, folder))


def tokens(spark, folder):
    found = features.tokenize(_docs(spark, folder))
    return found.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                        F.array_join("tokens", " ").alias("tokens"))


def stop_filtered(spark, folder):
    return _tokens(spark, folder).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def bigrams(spark, folder):
    pairs = features.term_rows(_tokens(spark, folder), features.bigrams(F.col("tokens")), "doc_id")
    return pairs.groupBy("doc_id", F.col("term").alias("bigram")).agg(F.count("*").alias("n"))


def doc_frequency(spark, folder):
    return features.document_frequency(_terms(spark, folder))


def term_frequency(spark, folder):
    return features.term_frequency(_terms(spark, folder))


def top_terms(spark, folder):
    return features.top_terms(_terms(spark, folder))


def tfidf_terms(spark, folder):
    return rounded(features.tfidf(_terms(spark, folder)), ["tfidf"])


# ----------------------------------------------------- classifier, metrics

def class_weights(spark, folder):
    labels = table(spark, folder, "labels").select(F.col("toxic").alias("label"))
    return rounded(metrics.class_weights(labels), ["weight"])


def _rule(spark, folder):
    hit = S.lexicon_hits(F.col("comment_text"), lexicon.STANDIN_LABELS["insult"]) > 0
    return _labelled(spark, folder).select(F.col("toxic").alias("label"), hit.cast("int").alias("pred"))


def accuracy_rule(spark, folder):
    return rounded(metrics.accuracy(_rule(spark, folder)), ["accuracy"])


def classification_report(spark, folder):
    report = metrics.classification_report(_rule(spark, folder))
    return rounded(report, ["precision", "recall", "f1"])


def lr_predictions(spark, folder):
    rows = cleaning.prepare(_labelled(spark, folder)).select(
        "doc_id", F.col("comment_text").alias("text"), F.col("toxic").alias("label")
    )
    train, val = sampling.train_val_split(rows)
    model = classify.train_classifier(train)
    return classify.ml_score(val, model, pred="pred").select("doc_id", "label", "ml_score", "pred")


#: The optimizer stops at about this slope; it begins at some hundredths.
STEEPEST = 2e-4


def lr_checks(spark, folder):
    """What must hold of the classifier on any data: rows on either side, and that scores
    are probabilities, decisions follow from them, the fit is a minimum (no entry of the
    gradient, over all coefficients and the intercept, is larger than ``STEEPEST``), and a
    stored model scores alike. DuckDB computes the rows only; the rest must be true."""
    rows = cleaning.prepare(_labelled(spark, folder)).select(
        "doc_id", F.col("comment_text").alias("text"), F.col("toxic").alias("label"))
    train, val = sampling.train_val_split(rows)
    model = classify.train_classifier(train)
    path = f"{folder_for(spark, 'model')}/lr"
    classify.save_model(model, path)
    again = classify.load_model(path)
    scored = classify.ml_score(val, model, pred="pred")
    stored = classify.ml_score(val, again).select("doc_id", F.col("ml_score").alias("stored"))
    held = scored.join(stored, "doc_id").agg(
        F.count("*").alias("n_val"),
        F.bool_and((F.col("ml_score") > 0) & (F.col("ml_score") < 1)).alias("probabilities"),
        F.bool_and((F.col("pred") == 1) == (F.col("ml_score") > 0.5)).alias("decided"),
        F.bool_and(F.abs(F.col("ml_score") - F.col("stored")) < 1e-9).alias("stored_alike"))
    minimum = classify.steepest(train, model) < STEEPEST
    n_train = train.agg(F.count("*")).scalar()
    return held.select("*", n_train.alias("n_train"), F.lit(minimum).alias("minimum"))


def model_predictions(spark, folder):
    """T8-T10 with fitted models: both are trained on the training side, all labelled documents
    are predicted, and each side is evaluated. Figures of the models depend on the training, so
    what is returned of them are facts; DuckDB computes the counts and the word lists' AUC."""
    rows = cleaning.prepare(_labelled(spark, folder)).select(
        "doc_id", F.col("comment_text").alias("text"), F.col("toxic").alias("label"))
    train, val = sampling.train_val_split(rows)
    ml = classify.train_classifier(train)
    # The text model reads normalized texts, so it learns from such.
    base = folder_for(spark, "predicted")
    normalize(dealt(train, train), guard=True).select("normalized", F.col("label").alias("toxic")).write.parquet(f"{base}/normalized")
    text = textmodel.train_text_model(spark.read.parquet(f"{base}/normalized"), col="normalized")
    scored, _ = predict(dealt(rows.drop("label"), rows), id_col="doc_id", ml=ml, scorer=textmodel.text_model_scorer(spark, text))
    sides = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    words = S.lexicon_scorer(F.col("text"))["score"].alias("by_words")
    path = f"{base}/rows"
    kept = scored.select("doc_id", "error", *SCORES, "is_toxic", "llm_label").join(sides.select("doc_id", "label", "split", words), "doc_id")
    kept.write.parquet(path)
    kept = spark.read.parquet(path)
    blended = F.abs(F.col("hybrid_score") - 0.3 * F.col("ml_score") - 0.7 * F.col("llm_confidence")) < 1e-9
    out = None
    for split in ("train", "val"):
        mine = kept.filter(F.col("split") == split)
        area = {c: metrics.auc(mine, "label", c).scalar() for c in ("by_words", "ml_score", "llm_confidence", "hybrid_score")}
        right = metrics.accuracy(mine.select("label", (F.col("ml_score") > 0.5).cast("int").alias("pred"))).scalar()
        row = mine.agg(
            F.count("*").alias("n"), F.sum("label").alias("toxic"), F.count("error").alias("errors"),
            F.bool_and(blended & F.col("ml_score").between(0, 1) & F.col("llm_confidence").between(0, 1)
                       & (F.col("is_toxic") == (F.col("hybrid_score") > 0.5)) & (F.col("llm_label") == "toxic")).alias("blended"))
        better = (area["llm_confidence"] > area["by_words"]) & (area["hybrid_score"] > 0.5) & (right > 0.5)
        row = row.select(F.lit(split).alias("split"), "*", F.round(area["by_words"], 6).alias("auc_of_words"),
                         F.when(F.col("toxic") >= 5, better).alias("better"))
        out = row if out is None else out.unionByName(row)
    return out


def scorer_errors(spark, folder):
    """a classifier that fails on normalized texts of certain lengths; each such text is an error
    of its own row, and all others have their result."""
    def load():
        def classify(text):
            if len(text) % 7 == 0:
                raise ValueError(f"length {len(text)}")
            return "toxic", (len(text) % 100) / 100

        return classify

    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored, _ = predict(docs, id_col="doc_id", scorer=S.batch_scorer(load))
    return rounded(scored, ["hybrid_score"]).select("doc_id", "error", "llm_confidence", "hybrid_score", "risk_level")


def csv_round_trip(spark, folder):
    path = f"{folder_for(spark, 'csv')}/comments"
    write_dataset(_labelled(spark, folder).select("comment_text", F.col("toxic").cast("string")), path, "csv")
    back = read_comments(spark, path, "csv", comment_schema(labels=False))
    return back.groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum(F.length("comment_text")).alias("chars"),
        F.sum(F.conv(F.substring(F.md5("comment_text"), 1, 8), 16, 10).cast("long")).alias("check"))


def csv_rejects(spark, folder):
    """Lines that are no comments. Of a well-formed file's rows, some get a surplus field, some
    lose one; what is read and what is rejected are all rows."""
    path = f"{folder_for(spark, 'csv-rejects')}/comments"
    quoted = F.concat(F.lit('"'), F.regexp_replace("text", '["\n]', " "), F.lit('"'))
    line = F.when(F.col("doc_id") % 10 == 3, F.concat_ws(",", quoted, F.lit("0"), F.lit("extra"))) \
        .when(F.col("doc_id") % 10 == 6, quoted).otherwise(F.concat_ws(",", quoted, (F.col("doc_id") % 2).cast("string")))
    # Files of some ten MB, each with the header before the first line of its task.
    head = F.when(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0, "comment_text,toxic")
    docs = table(spark, folder, "documents").select("doc_id", "text").hint("rebalance")
    lines = docs.select(F.concat_ws("\n", head, line).alias("value"))
    lines.write.text(path)
    good, bad = read_checked(spark, path, comment_schema(labels=False))
    kinds = good.select(F.lit("read").alias("kind"), "comment_text").unionByName(
        bad.select(F.col("reason").alias("kind"), F.col("line").alias("comment_text")))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("comment_text")).alias("chars"))


def written_set(spark, folder):
    path = f"{folder_for(spark, 'cleaned')}/set"
    write_dataset(cleaning.prepare(_labelled(spark, folder)), path)
    return spark.read.parquet(path).groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.length("comment_text")).alias("chars"))


def write_times(spark, folder):
    """M5: rows appended without a time get the time of writing, in UTC."""
    path = folder_for(spark, "times")
    before = spark.range(1).select(audit.utc_now().alias("t")).first().t
    audit.append_audit(_scored(spark, folder), path)
    log = audit.read_audit(spark, path)
    return log.groupBy(F.lit(True).alias("written")).agg(
        F.count("*").alias("n"), F.bool_and(F.col("timestamp") >= F.lit(before)).alias("not_early"),
        F.bool_and(F.col("timestamp") <= audit.utc_now()).alias("not_late"),
        F.bool_and(F.col("log_date") == F.col("timestamp").cast("date")).alias("dated"))


def mask_strict(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return predict(docs, id_col="doc_id", mode="strict")[0].select("doc_id", "masked_comment")


# ----------------------------------------------------------------- scoring

def _scored(spark, folder):
    return predict(table(spark, folder, "documents").select("doc_id", "text"), id_col="doc_id")[0]


def predict_batch(spark, folder):
    return rounded(_scored(spark, folder)).select("doc_id", *[c for c in PREDICTION if c != "error"])


def policy_map(spark, folder):
    docs = normalize(_docs(spark, folder))
    text = S.lexicon_scorer(F.col("normalized"))
    labelled = docs.select("doc_id", text.alias("s")).select(
        "doc_id", F.col("s.label").alias("llm_label"), F.col("s.score").alias("llm_confidence")
    )
    mapped = map_policy(labelled, policy_table(spark))
    return mapped.select("doc_id", "llm_label", "policy_violation", "llm_explanation")


def hybrid_risk(spark, folder):
    docs = normalize(_docs(spark, folder))
    scores = docs.select(
        "doc_id", S.lexicon_rate(F.col("normalized")).alias("ml_score"),
        S.lexicon_scorer(F.col("normalized"))["score"].alias("llm_confidence"),
    )
    return rounded(blend(scores)).select("doc_id", "hybrid_score", "is_toxic", "risk_level")


def score_long(spark, folder):
    return reports.score_long(_scored(spark, folder), "doc_id")


def explanations(spark, folder):
    # Scores in steps of 1/10,000, spread over the events.
    total = table(spark, folder, "documents").agg(F.sum("n_chars")).scalar()
    score = ((F.col("event_id") * 7919 + total) % 10001) / F.lit(10000.0)
    events = table(spark, folder, "events")
    return events.select("event_id", S.explanation(score, F.col("event_type")).alias("sentence"))


def percent_display(spark, folder):
    return _scored(spark, folder).select(
        "doc_id", *[S.pct_str(F.col(c)).alias(n) for c, n in zip(SCORES, ("ml", "llm", "hybrid"))]
    )


def flagship_risk(spark, folder):
    return rounded(
        _scored(spark, folder).groupBy("risk_level", "policy_violation")
        .agg(F.count("*").alias("n"), F.avg("hybrid_score").alias("avg_hybrid")), ["avg_hybrid"]
    )


# ------------------------------------------------------- reuse and audit

def _keyed_docs(spark, folder):
    """Texts trimmed and hashed once per document, before events repeat them."""
    docs = table(spark, folder, "documents")
    return dealt(reuse.with_key(docs.select("doc_id", T.strip_blanks(F.col("text")).alias("text"))), docs)


def _arrivals(spark, folder):
    """A timed stream of comments: each event brings one document."""
    docs = _keyed_docs(spark, folder)
    n = table(spark, folder, "documents").agg(F.count("*").alias("n")).scalar()
    events = table(spark, folder, "events").select("event_id", "ts", (F.col("event_id") % n).alias("doc_id"))
    return events.join(docs, "doc_id").select("event_id", "ts", "text", "text_key")


def cached_flags(spark, folder):
    ok, _ = cleaning.split_valid(_arrivals(spark, folder))
    return reuse.with_cached_flag(ok, "ts", "text", "event_id").select("event_id", "cached")


def cache_stats(spark, folder):
    return reuse.cache_stats(cleaning.split_valid(_arrivals(spark, folder))[0])


def score_new_only(spark, folder):
    # Results of the chat texts are at hand; documents among them are not scored again.
    chats, _ = cleaning.split_valid(table(spark, folder, "conversations").select("text"))
    prior = score_texts(reuse.distinct_texts(chats))
    docs, _ = cleaning.split_valid(_docs(spark, folder))
    out = reuse.score_new(docs, prior, lambda t: score_texts(t), id_col="doc_id")
    return rounded(out).select("doc_id", "hybrid_score", "risk_level", "reused")


def _audit(spark, folder):
    scored, _ = predict(_arrivals(spark, folder), id_col="event_id", order_col="ts")
    return audit.audit_rows(scored, F.col("ts"), F.col("event_id"))


def audit_recent(spark, folder):
    return rounded(reports.recent_audit(_audit(spark, folder)))


def _audit_log(spark, folder, batches=3):
    """A written audit log of several batches, the last of which is written twice, and the batches' sums."""
    path = folder_for(spark, "audit-log")
    kept = f"{path}/scored"
    # Repeats are not logged, and of the texts only the masked one is: no text is kept once an arrival.
    scored, _ = predict(_arrivals(spark, folder), id_col="event_id", order_col="ts", computed_only=True)
    scored.drop("comment", "normalized_comment").write.option("compression", "zstd").parquet(kept)
    scored = spark.read.parquet(kept)
    for batch in [*range(batches), batches - 1]:
        mine = scored.filter(F.pmod(F.xxhash64("event_id"), F.lit(batches)) == batch)
        audit.append_audit(mine, f"{path}/log", batch, F.col("ts"), F.col("event_id"), summary=f"{path}/sums")
    return path


def audit_newest(spark, folder):
    """L1 over a stored log: the newest rows, from the newest days only."""
    path = _audit_log(spark, folder)
    days = audit.read_summary(spark, f"{path}/sums")
    log = audit.read_audit(spark, f"{path}/log").drop("batch_id")
    return rounded(reports.recent_audit(reports.newest_days(log, days=days)))


def risk_summary_kept(spark, folder):
    """A8, kept up batch by batch."""
    kept = audit.read_summary(spark, f"{_audit_log(spark, folder)}/sums")
    return rounded(kept, ["avg_ml", "avg_llm", "avg_hybrid"])


def audit_view(spark, folder):
    return rounded(reports.audit_view(_audit(spark, folder)))


def audit_display(spark, folder):
    return reports.audit_display(reports.recent_audit(_audit(spark, folder), 20))


def risk_summary(spark, folder):
    return rounded(reports.risk_summary(_audit(spark, folder)), ["avg_ml", "avg_llm", "avg_hybrid"])


def risk_rollup(spark, folder):
    return rounded(reports.risk_rollup(_audit(spark, folder)), ["avg_hybrid"])


def audit_written(spark, folder):
    path = folder_for(spark, "audit")
    audit.init_audit(spark, path)
    scored, _ = predict(_arrivals(spark, folder), id_col="event_id", order_col="ts")
    audit.append_audit(scored, path, at=F.col("ts"), row_id=F.col("event_id"))
    return audit.read_audit(spark, path).groupBy("log_date").agg(
        F.count("*").alias("n"), F.sum(F.length("original_text_masked")).alias("chars")
    )


# --------------------------------------------------------------- streaming

def _arrival_stream(spark, folder):
    # A stream reads folders; the pattern makes it take a table that is one file too.
    schema = table(spark, folder, "events").schema
    events = read_comment_stream(spark, f"{folder}/events.parque[t]", schema)
    docs = _keyed_docs(spark, folder)
    n = table(spark, folder, "documents").agg(F.count("*")).scalar()
    keyed = events.select("event_id", "ts", (F.col("event_id") % n).alias("doc_id"))
    return keyed.join(docs, "doc_id").select("event_id", "ts", "text", "text_key")


def _utc_text(col):
    """A zone-less or session-zone time as UTC text."""
    start = F.timestamp_diff("SECOND", F.timestamp_seconds(F.lit(0)), F.col(col).cast("timestamp"))
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=start.cast("decimal(18,6)"))
    return F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias(col)


def _finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _answers(spark, folder, **how):
    base = folder_for(spark, "answers")
    _finish(stream.answer_stream(
        _arrival_stream(spark, folder), f"{base}/results", f"{base}/answers", f"{base}/state",
        id_col="event_id", **{k: f"{base}/{v}" for k, v in how.items()},
    ))
    return base


def stream_scored(spark, folder):
    base = _answers(spark, folder)
    answers = stream.read_answers(spark, f"{base}/answers", f"{base}/results", id_col="event_id")
    return rounded(answers).select("event_id", "masked_comment", "hybrid_score", "risk_level")


def stream_dedup(spark, folder):
    base = folder_for(spark, "dedup")
    arrivals = _arrival_stream(spark, folder)
    _finish(stream.first_sightings(arrivals, f"{base}/firsts", f"{base}/state", id_col="event_id"))
    return spark.read.parquet(f"{base}/firsts").select("text_key")


def stream_misses(spark, folder):
    answers = spark.read.parquet(f"{_answers(spark, folder)}/answers")
    return stream.stream_hits(answers, id_col="event_id").select(_utc_text("window_start"), "arrivals", "misses", "hits")


def stream_risk_windows(spark, folder):
    base = _answers(spark, folder, counts="counts")
    return stream.window_counts(spark, f"{base}/counts").select(
        _utc_text("window_start"), "risk_level", F.col("arrivals").alias("n"))


def stream_audit(spark, folder):
    base = _answers(spark, folder, audit="log")
    return audit.read_audit(spark, f"{base}/log").groupBy("risk_level").agg(F.count("*").alias("n"))


QUERIES = {
    "nfkd_text": _step("nfkd", T.nfkd),
    "homoglyph_fold": _step("homoglyphs", T.fold_homoglyphs),
    "leet_reverse": _step("leet", T.reverse_leet),
    "strip_separators": _step("separators", T.strip_separators),
    "reduce_repetition": _step("repetition", T.reduce_repetition),
    "slur_patterns": _step("slurs", lambda c: T.match_patterns(c, lexicon.SLUR_PATTERNS)),
    "transposition_patterns": _step(
        "transpositions", lambda c: T.match_patterns(c, lexicon.TRANSPOSITION_PATTERNS)),
    "anagram_fold": _step("anagrams", T.fold_anagrams),
    "near_word_fold": _step("near_words", T.fold_near_words),
    "chat_normalize": chat_normalize,
    "normalize_full": normalize_full,
    "evasion_report": evasion_report,
    "vocab_near_words": vocab_near_words,
    "vocab_anagrams": vocab_anagrams,
    "vocab_unsafe_words": vocab_unsafe_words,
    "mask_pii": mask_pii_texts,
    "mask_after_normalize": mask_after_normalize,
    "mask_names": mask_names,
    "names_learned": names_learned,
    "pii_summary": pii_summary,
    "clean_comments": clean_comments,
    "cleaning_counts": cleaning_counts,
    "reject_blank": reject_blank,
    "label_int": label_int,
    "select_xy": select_xy,
    "sample_n": sample_n,
    "train_val_split": _split(False),
    "train_val_split_exact": _split(True),
    "tokens": tokens,
    "stop_filtered": stop_filtered,
    "bigrams": bigrams,
    "doc_frequency": doc_frequency,
    "term_frequency": term_frequency,
    "top_terms": top_terms,
    "tfidf_terms": tfidf_terms,
    "class_weights": class_weights,
    "accuracy_rule": accuracy_rule,
    "classification_report": classification_report,
    "lr_predictions": lr_predictions,
    "lr_checks": lr_checks,
    "model_predictions": model_predictions,
    "scorer_errors": scorer_errors,
    "csv_round_trip": csv_round_trip,
    "csv_rejects": csv_rejects,
    "written_set": written_set,
    "write_times": write_times,
    "mask_strict": mask_strict,
    "policy_map": policy_map,
    "hybrid_risk": hybrid_risk,
    "score_long": score_long,
    "explanations": explanations,
    "percent_display": percent_display,
    "predict_batch": predict_batch,
    "flagship_risk": flagship_risk,
    "cached_flags": cached_flags,
    "cache_stats": cache_stats,
    "score_new_only": score_new_only,
    "audit_recent": audit_recent,
    "audit_view": audit_view,
    "audit_display": audit_display,
    "risk_summary": risk_summary,
    "risk_rollup": risk_rollup,
    "audit_newest": audit_newest,
    "risk_summary_kept": risk_summary_kept,
    "audit_written": audit_written,
    "stream_scored": stream_scored,
    "stream_dedup": stream_dedup,
    "stream_risk_windows": stream_risk_windows,
    "stream_audit": stream_audit,
    "stream_misses": stream_misses,
}
