"""The corpus pipeline: documents in, mixed training documents out.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns rows; :func:`run` writes every stage as Parquet and reads it back, so
a lost executor never repeats an earlier stage. All stages but the last return
the columns of ``documents``. Null and empty texts, repeated rows and empty
tables are treated as the stage's operator says.
"""

from pyspark.sql import functions as F

from decorum.llm import decontaminate, exact_dedup, mixing, quality_crf, simhash
from decorum.llm.queries import quality_model
from decorum.llm.store import Shelf, read


def quality(spark, docs, sf_dir):
    """Documents with a quality score of 0.7 or more stay."""
    return quality_crf.keep_good(docs, quality_model(docs, read(spark, sf_dir, "labels")))


def exact(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of each component of near copies the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def clean(spark, docs, sf_dir):
    """Documents without a word inside a benchmark passage stay."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """(doc_id, source, size, source_size, target, spans, taken) of the documents
    the mix takes words from; spans are (from, to, times) in words."""
    return mixing.mix(docs).filter("_taken > 0").select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.filter("_spans", lambda s: s["times"] > 0).alias("spans"), F.col("_taken").alias("taken"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("mix", mix)]

#: SQL cannot express the classifier and the fingerprints; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    shelf = Shelf(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shelf.put(name, stage(spark, docs, sf_dir))
    return docs
