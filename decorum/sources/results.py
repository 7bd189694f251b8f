"""Stored results, one row per text, in buckets of the text's key."""

import hashlib

from pyspark.sql import functions as F

BUCKETS = 64
#: Keys up to this many are looked up by value, which leaves out the buckets that hold none of them.
BY_VALUE = 1_000


class Results:
    """A table at ``path`` in ``buckets`` files by hash of ``text_key``, each file in order of the key.

    The columns are ``columns`` (a schema with text_key) and ``scored_in``, the batch that stored the row. A look-up by key
    shuffles the keys only, never the stored rows, and few keys read few buckets. Rows are only added. A batch
    that is run again finds what it had stored, so nothing is stored twice. The number of buckets is the same for
    the table's life; ``compact`` gives each bucket one file again.
    """

    def __init__(self, spark, path, columns, buckets=BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.columns = [f.name for f in columns if f.name != "scored_in"]
        self.name = f"results_{hashlib.md5(f'{path} {buckets}'.encode()).hexdigest()}"
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns if f.name != "scored_in")
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.name} ({kinds}, scored_in BIGINT) USING parquet
            OPTIONS (compression 'zstd') CLUSTERED BY (text_key) SORTED BY (text_key) INTO {buckets} BUCKETS LOCATION '{path}'""")

    def read(self):
        return self.spark.table(self.name)

    def add(self, df, batch_id):
        """Store rows of texts that have none yet."""
        self.store(self.dealt(df), batch_id)

    def dealt(self, df):
        """Rows dealt out as the table is."""
        return df.repartition(self.buckets, "text_key")

    def store(self, dealt, batch_id):
        """As ``add``, of rows that are ``dealt`` already, and what was made of them row by row."""
        rows = dealt.select(*self.columns, F.lit(batch_id).cast("long").alias("scored_in"))
        rows.sortWithinPartitions("text_key").write.insertInto(self.name)

    def of(self, keys):
        """The stored rows of the table ``keys`` (text_key, each once)."""
        # At most BY_VALUE + 1 short rows.
        some = [r.text_key for r in keys.select("text_key").limit(BY_VALUE + 1).collect()]
        stored = self.read()
        if len(some) <= BY_VALUE:
            return stored.filter(F.col("text_key").isin(some))
        return stored.join(keys.select("text_key"), "text_key", "left_semi")


def compact(spark, source, target, buckets=BUCKETS):
    """Rewrite a table of results with one file a bucket, for a stream that starts again on ``target``."""
    old = Results(spark, source, spark.read.parquet(source).schema, buckets)
    new = Results(spark, target, old.read().schema, buckets)
    # By the bucket's number: a repartition by the key itself would be taken for the source's own
    # layout, and its files would stay as they are.
    rows = old.read().repartition(buckets, F.pmod(F.hash("text_key"), F.lit(buckets))).sortWithinPartitions("text_key")
    rows.write.insertInto(new.name)
