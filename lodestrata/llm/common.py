"""What the training-data operators share: reading, written tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset and all runs in one process, as in tests, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    A plain Parquet table is used because an eager ``checkpoint()`` computes its input twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestrata_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    path = getattr(df, "_lodestrata_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written tables of one operator, deleted when nothing will read them again."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(written(df, name))
        return self.made[-1]

    def drop(self, *kept: DataFrame) -> None:
        for table in self.made:
            if not any(table is k for k in kept):
                discard(table)


#: Rows of one value from which on its label is broadcast instead of shuffled to.
HOT = 1_000_000


def labelled_by(rows: DataFrame, labels: DataFrame, on: str, count: str, hot: int = HOT) -> DataFrame:
    """Inner join of ``rows`` with ``labels``, which has one row for each value of ``on`` and how many ``rows`` have it.

    Rows of a value that more than ``hot`` rows have stay where they are and take its label from a broadcast, so they don't
    meet in one task; there are fewer than rows / hot such values. All others are joined by shuffling; the result is the same."""
    often = F.col(count) > hot
    few, rest = F.broadcast(labels.filter(often).drop(count)), labels.filter(~often).drop(count)
    return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(rest, on))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that internal names can't clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def unpacked(df: DataFrame, field: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(field).getField(c).alias(c) for c in columns])


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: rows with equal texts get equal decisions."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


#: Elements that are summed in one go by :func:`offsets`.
STRETCH = 512


def offsets(lengths: Column) -> Column:
    """Where each of consecutive pieces starts: exclusive running sums of an array of whole numbers.

    Spark has no running fold over an array, and appending to one copies it; so stretches are summed by
    themselves, and then their totals, which keeps the work far from the square of the pieces."""

    def run(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
        return F.aggregate(values, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"]).alias("all")))

    count = F.floor((F.size(lengths) + F.lit(STRETCH - 1)) / STRETCH).cast("int")
    cut = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: run(F.slice(lengths, (i - 1) * STRETCH + 1, F.lit(STRETCH))))
    bases = run(F.transform(cut, lambda c: c["at"]))["all"]
    return F.flatten(F.zip_with(cut, bases, lambda c, b: F.transform(c["all"], lambda x: x + b)))
