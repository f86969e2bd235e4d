"""One large CSV file with line breaks inside quoted texts, read by
many tasks.

Spark's ``multiLine`` reader gives a whole file to one task, since a split
cannot tell whether it starts inside a quoted text.  It can once the quotes
before it are counted: a line begins a record exactly if an even number of
quotes lies before it (a quote inside a text is written twice).  So lines are
read split by split, the quotes of every split are summed up along its file
(one row for each split), and lines are put together to records.

Assumed is what CSV writers write: a quote appears only around a field or
doubled inside a quoted one.  An open quote runs to the end of its file, as it
does with ``multiLine``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record``: the records of CSV files (a file, folder or pattern)
    without their header lines and without empty lines.

    Quotes travel to the split sums, texts twice: to the lines of their split
    (at most ``spark.sql.files.maxPartitionBytes``) and to their record.
    """
    line = F.col("value")
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),  # rises along a split
            line.alias("line"),
            ((F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2).cast("int").alias("odd"),
        )
    )
    in_split = Window.partitionBy("file", "split").orderBy("at")
    # whether an odd number of quotes of the same split lies before the line
    before = F.coalesce(F.sum("odd").over(in_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("before", before)

    # each split: its quotes, and the records that begin in it for either
    # parity of the quotes before it
    splits = lines.groupBy("file", "split").agg(
        (F.sum("odd") % 2).alias("odd"),
        F.count_if(F.col("before") == 0).alias("begin_even"),
        F.count_if(F.col("before") == 1).alias("begin_odd"),
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("begin", F.when(F.col("inside") == 0, F.col("begin_even")).otherwise(F.col("begin_odd")))
    # the record that is open where a split begins: the last one begun before
    opened = F.last(F.when(F.col("begin") > 0, F.struct("split", F.col("begin").alias("n"))), ignorenulls=True).over(earlier)
    splits = splits.select("file", "split", "inside", opened.alias("opened"))

    begins = ((F.col("before") + F.col("inside")) % 2 == 0).cast("int")
    n = F.sum(begins).over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.join(splits, ["file", "split"]).withColumn("n", n)
    own = F.struct("split", F.col("n").alias("n"))
    placed = placed.select("file", "split", "at", "line", F.when(F.col("n") > 0, own).otherwise(F.col("opened")).alias("key"))
    records = placed.groupBy("file", "key").agg(F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    head = (F.col("key.split") == 0) & (F.col("key.n") == 1)
    return records.filter(~head).select("file", F.regexp_replace(text, "\r$", "").alias("record")).filter(F.col("record") != "")


def scan_split_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str], file_column: str | None = None) -> DataFrame:
    """The records as rows of a declared schema (``options`` as for
    ``from_csv``); ``file_column`` adds the path of the file."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = csv_records(spark, path).select("file", F.from_csv("record", ddl, options).alias("row"))
    return rows.select(*([F.col("file").alias(file_column)] if file_column else []), "row.*")
