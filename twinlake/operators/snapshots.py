"""Pinned states of tables that are read from files: the list of files is kept, the files are not copied.

A frame holds the listing with which it was read, so all steps of a comparison read the same files and one that is
added meanwhile is in none of them. The manifest (path, size, time of each file), a table in the shared folder, tells
afterwards whether the files themselves were left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.operators.lineage import stored


class SnapshotChanged(RuntimeError):
    """A pinned file was rewritten or removed."""


def is_pinned(df: DataFrame) -> bool:
    """Whether all that df reads are files whose listing it holds (not tables whose files are listed at each query)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation":
            return False
        if leaf.relation().location().getClass().getSimpleName() != "InMemoryFileIndex":
            return False
    return True


def listing(df: DataFrame, files: list[str]) -> DataFrame:
    """(path, size, time) of the files as they are now; no content is read."""
    if not files:
        return df.sparkSession.createDataFrame([], "path string, size long, time timestamp")
    return df.sparkSession.read.format("binaryFile").load(files).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))


@dataclass
class Manifest:
    """The files of a side (as many as the driver lists for its scan anyhow) and the table of their sizes and times."""

    side: str
    df: DataFrame
    files: list[str]
    table: DataFrame
    path: str

    @classmethod
    def of(cls, side: str, df: DataFrame) -> Manifest:
        files = df.inputFiles()
        table, path = stored(listing(df, files), "manifests")
        return cls(side, df, files, table, path)

    def check(self) -> None:
        """Raise SnapshotChanged unless every file is still what it was."""
        try:
            changed = self.table.exceptAll(listing(self.df, self.files)).select("path").orderBy("path").head()
        except AnalysisException as e:  # a file is gone
            raise SnapshotChanged(f"a file of the {self.side} side was removed during the comparison: {e.getCondition()}") from e
        if changed:
            raise SnapshotChanged(f"a file of the {self.side} side changed during the comparison: {changed.path}")
