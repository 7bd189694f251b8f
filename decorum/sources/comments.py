"""Labelled comments in, cleaned set out, comment streams."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from decorum import lexicon


def comment_schema(labels=True):
    """Columns of a labelled comment file; never inferred."""
    names = ["toxic", *lexicon.EXTRA_LABELS] if labels else ["toxic"]
    return T.StructType(
        [T.StructField("comment_text", T.StringType())]
        + [T.StructField(n, T.StringType()) for n in names]
    )


def read_comments(spark, path, fmt="parquet", schema=None):
    """A table of comments. Quoted CSV fields may hold line breaks and doubled
    quotes; labels are read as text so that a bad label can be told from a missing
    one (see ``label_int``)."""
    if fmt == "csv":
        reader = spark.read.schema(schema) if schema else spark.read
        return (
            reader.option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
        )
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(fmt).load(path)


def read_checked(spark, path, schema, multiline=True):
    """(rows, rejected) of a CSV file with a header. ``rejected`` has each ``line`` that is no row of the
    schema as it stands in the file, and the ``reason``: an unclosed quote, surplus or missing fields, or a
    value of another type. Every record of the file is in one of the two.

    An unclosed quote takes what follows, up to the next quote or the end of the file, into its
    record. ``multiline=False`` ends records at line ends, so it takes its own line only, and a large file is
    read by many tasks.
    """
    whole = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    records = (
        spark.read.schema(whole).option("header", True).option("multiLine", multiline).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_line").option("quote", '"').option("escape", '"')
        .option("enforceSchema", True).csv(path)
    )
    # Always true, but needs all fields: with some of them only, the parser does not count them.
    whole_row = F.hash(*schema.names) >= -(1 << 31)
    # Outside quotes, commas part fields; a doubled quote ends one quoted piece and begins the next.
    bare = F.regexp_replace("_line", '"[^"]*+"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    reason = (F.when(F.regexp_count("_line", F.lit('"')) % 2 == 1, "unclosed quote")
              .when(fields > len(schema), "surplus fields").when(fields < len(schema), "missing fields").otherwise("other type"))
    bad = records.filter(F.col("_line").isNotNull() & whole_row)
    return (records.filter(F.col("_line").isNull() & whole_row).drop("_line"),
            bad.select(F.col("_line").alias("line"), reason.alias("reason")))


def write_dataset(df, path, fmt="parquet"):
    """Write the cleaned set."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_comment_stream(spark, path, schema, fmt="parquet", files_per_batch=None):
    """Comments as they arrive in a folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
