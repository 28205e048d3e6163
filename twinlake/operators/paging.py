"""Keyset paging: the next rows after a key, a cursor over a whole table, and an index that is sorted once."""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.functions.canonical import identifier
from twinlake.operators.filters import after
from twinlake.operators.lineage import delete, shared_folder

PAGE = 8192


def page(df: DataFrame, keys: Sequence[str], *, last: Sequence | None = None, size: int = PAGE) -> DataFrame:
    """The first ``size`` rows by key after ``last``; rows with a NULL key come first and are on the first page."""
    rows = df if last is None else df.filter(after(keys, last))
    return rows.orderBy(*map(identifier, keys)).limit(size)


def pages(df: DataFrame, keys: Sequence[str], *, size: int = PAGE) -> Iterator[list[Row]]:
    """All pages in key order; a short page is the last. Keys must be unique and not NULL."""
    last = None
    while True:
        rows = page(df, keys, last=last, size=size).collect()
        if rows:
            yield rows
        if len(rows) < size:
            return
        last = [rows[-1][k] for k in keys]


def rows_in_order(df: DataFrame, keys: Sequence[str]) -> Iterator[Row]:
    """All rows in key order, fetched partition by partition."""
    return df.orderBy(*map(identifier, keys)).toLocalIterator()


@dataclass
class PageIndex:
    """A table sorted once by its keys, from which any page is read by number or after a key.

    The sort leaves ranges of the keys, a folder each; ``starts`` has the number of the first row of each range, so a page
    is read from the folder or two that hold it, by row numbers that the files' footers prune. NULL keys come first. Keys
    should be unique; the order of rows with equal keys is fixed when the index is built.
    """

    df: DataFrame
    path: str
    keys: list[str]
    size: int
    rows: int
    ranges: list[int]
    starts: list[int]
    names: tuple[str, str]

    @classmethod
    def build(cls, df: DataFrame, keys: Sequence[str], *, size: int = PAGE, ranges: int | None = None) -> PageIndex:
        """ranges: how many ranges of the keys to sort; by default as the session shuffles."""
        spark, names = df.sparkSession, ["twinlake_range", "twinlake_at"]
        while {n.lower() for n in names} & {c.lower() for c in df.columns}:
            names = [f"{n}_" for n in names]
        path = f"{shared_folder(spark)}/pages/{uuid.uuid4().hex}"
        by = [identifier(k) for k in keys]
        ordered = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by) if ranges else df.orderBy(*by)
        placed = ordered.withColumns({names[0]: F.spark_partition_id(), names[1]: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        placed.write.partitionBy(names[0]).parquet(path)
        out = cls(df, path, list(keys), size, 0, [], [], tuple(names))
        counts = spark.read.schema(out.schema).parquet(path).groupBy(names[0]).agg(F.count("*").alias("n"))
        for r, n in sorted(counts.collect()):  # one row a range of the sort
            out.ranges.append(r)
            out.starts.append(out.rows)
            out.rows += n
        return out

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.df.schema.fields, T.StructField(self.names[1], T.LongType()), T.StructField(self.names[0], T.IntegerType())])

    @property
    def number(self) -> int:
        """The number of pages."""
        return -(-self.rows // self.size)

    def _read(self, first: int, last: int) -> DataFrame:
        """Rows of the ranges from the first to the last one."""
        folders = (f"{self.path}/{self.names[0]}={r}" for r in self.ranges[first : last + 1])
        return self.df.sparkSession.read.schema(self.schema).option("basePath", self.path).parquet(*folders)

    def page(self, n: int) -> DataFrame:
        """Page n, from 0, in the order of the keys; beyond the last page there are no rows."""
        low, high = n * self.size, min((n + 1) * self.size, self.rows)
        if n < 0 or low >= high:
            return self.df.limit(0)
        part, at = self.names
        first, last = bisect_right(self.starts, low) - 1, bisect_right(self.starts, high - 1) - 1
        wanted = F.lit(False)
        for i in range(first, last + 1):
            wanted = wanted | ((F.col(part) == self.ranges[i]) & (F.col(at) >= low - self.starts[i]) & (F.col(at) < high - self.starts[i]))
        return self._read(first, last).filter(wanted).orderBy(part, at).drop(part, at)

    def after(self, last: Sequence) -> DataFrame:
        """The page after a key; files and row groups whose footers end before the key are passed over."""
        part, at = self.names
        rows = self.df.sparkSession.read.schema(self.schema).parquet(self.path)
        return rows.filter(after(self.keys, last)).orderBy(part, at).limit(self.size).drop(part, at)

    def pages(self) -> Iterator[list[Row]]:
        for n in range(self.number):
            yield self.page(n).collect()

    def files(self) -> list[str]:
        return self.df.sparkSession.read.schema(self.schema).parquet(self.path).inputFiles()

    def close(self) -> None:
        delete(self.df.sparkSession, self.path)
