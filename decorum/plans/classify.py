"""The TF-IDF and logistic-regression classifier as a Spark ML pipeline."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
    SQLTransformer, StopWordsRemover,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from decorum import lexicon
from decorum.operators.features import top_terms
from decorum.operators.metrics import class_weights


def text_stages(stop_words=None):
    """Text to unigrams and bigrams."""
    stops = StopWordsRemover(inputCol="tokens", outputCol="kept")
    if stop_words is not None:
        stops = stops.setStopWords(list(stop_words))
    return [
        RegexTokenizer(inputCol="text", outputCol="tokens", gaps=False, toLowercase=True,
                       pattern=r"[\p{L}\p{N}_]{2,}"),
        stops,
        NGram(n=2, inputCol="kept", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(kept, pairs) AS terms FROM __THIS__"),
    ]


def train_classifier(df, k=lexicon.VOCABULARY_SIZE, min_df=lexicon.MIN_DF, max_iter=2000,
                     stop_words=None):
    """Fit on (text, label) with label 0 or 1.

    Classes are balanced by weight, so the weights add up to the number of rows and an
    inverse regularization strength of one is ``regParam = 1 / rows``.
    """
    terms = PipelineModel(text_stages(stop_words)).transform(df).select("label", "terms")
    terms = terms.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Ties in the vocabulary are broken by the term, so the model is the same on any layout.
        words = [r.term for r in top_terms(terms, k, min_df).collect()]
        counts = CountVectorizerModel.from_vocabulary(words or [""], inputCol="terms", outputCol="tf")
        idf = IDF(inputCol="tf", outputCol="idf").fit(counts.transform(terms))
        # The pipeline's idf lacks the constant 1, which is the term count itself.
        scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0),
                                   inputCol="tf", outputCol="scaled")
        unit = Normalizer(p=2.0, inputCol="scaled", outputCol="features")
        vectors = unit.transform(scale.transform(counts.transform(terms)))
        weights = {r.label: r.weight for r in class_weights(terms).collect()}
        weight = F.when(F.col("label") == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))
        weighted = vectors.select("label", "features", weight.alias("weight"))
        lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                maxIter=max_iter, regParam=1.0 / terms.count(), elasticNetParam=0.0,
                                standardization=False)
        fitted = lr.fit(weighted)
    finally:
        terms.unpersist()
    return PipelineModel([*text_stages(stop_words), counts, scale, unit, fitted])


def save_model(model, path):
    """S3."""
    model.write().overwrite().save(path)


def load_model(path):
    """S3."""
    return PipelineModel.load(path)


def ml_score(df, model, col="text", out="ml_score", pred=None):
    """Add P(toxic = 1); with ``pred`` also the hard decision."""
    keep = df.columns
    scored = model.transform(df.withColumn("text", F.col(col)) if col != "text" else df)
    added = {out: vector_to_array("probability")[1]}
    if pred:
        added[pred] = F.col("prediction").cast("int")
    scored = scored.withColumns(added)
    return scored.select(*keep, *added)


def steepest(df, model):
    """The largest entry of the training objective's gradient on (text, label), the penalty and the
    intercept included: nothing at the minimum. One distributed sum of vectors."""
    lr = model.stages[-1]
    weight = class_weights(df.select("label")).select("label", "weight")
    # Two rows.
    by_label = {r.label: r.weight for r in weight.collect()}
    rows = model.transform(df.select("text", "label"))
    miss = vector_to_array("probability")[1] - F.col("label")
    w = F.when(F.col("label") == 1, by_label.get(1, 1.0)).otherwise(by_label.get(0, 1.0))
    rows = rows.select("features", (miss * w).alias("miss"), w.alias("w"))
    # A sum of vectors takes weights of one sign.
    sums = rows.agg(Summarizer.sum(F.col("features"), F.greatest("miss", F.lit(0.0))).alias("over"),
                    Summarizer.sum(F.col("features"), F.greatest(-F.col("miss"), F.lit(0.0))).alias("under"),
                    F.sum("miss").alias("miss"), F.sum("w").alias("w")).first()
    slope = (sums.over.toArray() - sums.under.toArray()) / sums.w + lr.getRegParam() * lr.coefficients.toArray()
    return float(max(abs(slope).max(initial=0.0), abs(sums.miss / sums.w)))


def evaluate(df, model):
    """(label, pred) pairs for the metrics."""
    return ml_score(df, model, pred="pred").select("label", "pred")
