"""Tables written between the steps of an operator."""

import os
import tempfile
import uuid


class Shelf:
    """Tables of one run, written under ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs a task that reads
    files, not the steps before. ``folder`` replaces the setting; a session that
    has neither (as in tests) gets a temporary folder.
    """

    def __init__(self, spark, purpose, folder=None):
        self.spark = spark
        base = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="decorum-llm-")
        self.base = os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")

    def put(self, name, df):
        """Write ``df`` and return the written table."""
        path = os.path.join(self.base, f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._shelf_path = path
        return table

    def drop(self, table):
        """Delete a table of this shelf that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table._shelf_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stretches(texts, limit=1 << 21):
    """(first, last + 1) of consecutive rows of an Arrow string column with about
    ``limit`` bytes together, or one longer row, so that work on many texts at once stays small."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        size += text.as_buffer().size if text.is_valid else 0
        if size >= limit or i + 1 == len(texts):
            yield at, i + 1
            at, size = i + 1, 0
