"""Registered queries of the operators, over whole tables, with production parameters."""

from pyspark.sql import functions as F

from decorum.llm import (
    chat_format, collocations, decontaminate, exact_dedup, html_extract, language_id, line_dedup, lm_score, mixing,
    quality_crf, ranked_search, simhash, token_counts)
from decorum.llm.store import read


def op1_exact_dedup(spark, sf_dir):
    marked = exact_dedup.mark_copies(read(spark, sf_dir, "documents"))
    return marked.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def op2_chat_format(spark, sf_dir):
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    kinds = dict(chats.dtypes)
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-1).alias("conv_id"), F.lit(turn).alias("turn"), F.lit(role).alias("role"), F.lit(hard).alias("text"))
        for turn, role in enumerate(("user", "assistant"))]))).select(*[F.col(c).cast(kinds[c]) for c in chats.columns])
    shown = chat_format.format_chats(chats.unionByName(extra)).withColumn("_learned", chat_format.loss_text())
    turns = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return shown.select(
        F.col("_conv").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.char_length("_learned").cast("long").alias("loss_chars"),
        F.sha2("_learned", 256).alias("loss_sha256"), F.char_length("_text").cast("long").alias("formatted_chars"))


def op3_html_text(spark, sf_dir):
    texts = html_extract.extract(read(spark, sf_dir, "pages"), keep=["url"])
    return texts.select(F.col("_id").alias("page_id"), "url", F.col("_text").alias("text"),
                        F.char_length("_text").cast("long").alias("n_chars"))


def vocabulary():
    """Place of the vocabulary file on the worker that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks():
    """Place of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_token_counts(spark, sf_dir):
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"), vocabulary)
    return counted.select(
        F.col("_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"),
        (F.col("_n_tokens") > 1024).alias("over_limit"))


def fold_of(ids, folds):
    return F.pmod(F.crc32(ids.cast("string")), F.lit(folds))


def quality_model(docs, labels):
    return quality_crf.fit(docs, labels, learn=fold_of(F.col("doc_id"), 4) != 2)


def op5_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = quality_crf.score(docs, quality_model(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        F.col("_id").alias("doc_id"), (fold_of(F.col("_id"), 4) == 2).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


def op6_simhash(spark, sf_dir):
    found = simhash.near_copies(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_component").alias("component_id"))


def op7_lm_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = lm_score.score(docs, ranks, learn=fold_of(F.col("doc_id"), 5) != 1)
    return scored.select(
        F.col("_id").alias("doc_id"), (fold_of(F.col("_id"), 5) == 1).alias("held_out"),
        F.col("_n_tokens").alias("n_tokens"), F.col("_n_known").alias("n_known"),
        F.col("_train_tokens").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))


def op8_line_dedup(spark, sf_dir):
    left = line_dedup.drop_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return left.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"),
        F.char_length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op9_mixing(spark, sf_dir):
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def op10_decontaminate(spark, sf_dir):
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op11_ranked_search(spark, sf_dir):
    found = ranked_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_item").alias("item_id"), F.col("_rank").alias("rank"), F.col("_id").alias("doc_id"), F.col("_score").alias("score"))


def op12_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    named = language_id.predict(docs, language_id.fit(docs, learn=fold_of(F.col("doc_id"), 4) != 2))
    return named.select(
        F.col("_id").alias("doc_id"), (fold_of(F.col("_id"), 4) == 2).alias("held_out"),
        F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_html_text": op3_html_text,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_lm_score": op7_lm_score,
    "op8_line_dedup": op8_line_dedup,
    "op9_mixing": op9_mixing,
    "op10_decontaminate": op10_decontaminate,
    "op11_ranked_search": op11_ranked_search,
    "op12_language_id": op12_language_id,
    "op13_collocations": op13_collocations,
}
