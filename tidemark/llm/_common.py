"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def free_name(columns: Iterable[str], wish: str) -> str:
    """A column name close to ``wish`` that clashes with none of ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    The files go to the shared folder that the session names in ``spark.checkpoint.dir``.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="spark-")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that a worker holds the Python objects of few rows at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A key with more than this part of all rows is joined apart.
HOT = 10_000


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` on columns without nulls, where no key fills a task.

    ``table`` has each key once, and in ``count`` how many of the about ``total`` rows have it. Keys with more
    than a ``HOT``-th of them are few, whatever the size of the tables, so theirs are sent to all tasks.
    """
    hot = table.where(F.col(count) * HOT > total).drop(count)
    if hot.isEmpty():
        return rows.join(table.drop(count), on)
    mark = free_name([*rows.columns, *table.columns], "hot")
    marked = rows.join(F.broadcast(hot.withColumn(mark, F.lit(True))), on, "left")
    usual = marked.where(F.col(mark).isNull()).select(*rows.columns).join(table.drop(count), on)
    return marked.where(F.col(mark).isNotNull()).drop(mark).unionByName(usual)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``; null values count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


class Remembered(dict):
    """A bounded table of computed values: two generations, of which the older is let go when full.

    Strings of over ``longest`` characters are computed anew each time.
    """

    def __init__(self, make: Callable, bound: int, longest: int = 40):
        super().__init__()
        self.make, self.bound, self.longest, self.older = make, bound, longest, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > self.longest:
                return value
        if len(self) >= self.bound // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value
