"""What there is: session facts, tables, columns and declared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.sources.registry import Source


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def database_info(spark: SparkSession) -> DataFrame:
    """One row of facts about the session."""
    row = spark.sql("select current_catalog() c, current_database() d, current_user() u, current_timezone() z, version() v").first()
    sc = spark.sparkContext
    return _frame(
        spark,
        [(spark.version, row.c, row.d, row.u, row.z, sc.applicationId, sc.master, sc.defaultParallelism, spark.conf.get("spark.sql.ansi.enabled") == "true")],
        "version string, catalog string, database string, user string, time_zone string, application string, master string, parallelism int, ansi boolean",
    )


def list_tables(spark: SparkSession, database: str | None = None, *, count: bool = False) -> DataFrame:
    """schema, name, type, engine, rows (counted if asked for, else from statistics), bytes, comment."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = f"`{t.name}`" if t.isTemporary or not t.namespace else ".".join(f"`{p}`" for p in (*t.namespace, t.name))
        df = spark.table(name)
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        known = int(stats.rowCount().get()) if stats.rowCount().isDefined() else None
        rows.append((".".join(t.namespace or []), t.name, t.tableType, "spark", df.count() if count else known, min(int(str(stats.sizeInBytes())), 2**63 - 1), t.description))
    return _frame(spark, rows, "schema string, name string, type string, engine string, rows long, bytes long, comment string")


def table_columns(df: DataFrame, key: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """column_name, data_type, nullable, default, ordinal, comment, column_key of a table."""
    rows = [
        (f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("CURRENT_DEFAULT"), i, (f.metadata or {}).get("comment"), "PRI" if f.name in key else "")
        for i, f in enumerate(df.schema, 1)
    ]
    return _frame(df.sparkSession, rows, "column_name string, data_type string, nullable boolean, default string, ordinal int, comment string, column_key string")


def table_indexes(spark: SparkSession, source: Source, table: str, df: DataFrame | None = None) -> DataFrame:
    """The declared key as an index; whether it is unique is measured if the table is given."""
    key = source.declared_key(table)
    unique = None
    if key and df is not None:
        unique = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    rows = [("PRIMARY", unique if unique is not None else True, True, ",".join(key), "declared")] if key else []
    return _frame(spark, rows, "index_name string, is_unique boolean, is_primary boolean, columns string, index_type string")


def describe(df: DataFrame) -> DataFrame:
    """Column facts for comparison: whether the type can be compared."""
    from twinlake.functions.canonical import comparable

    rows = [(f.name, f.dataType.simpleString(), comparable(f.dataType), isinstance(f.dataType, (T.FloatType, T.DoubleType))) for f in df.schema]
    return _frame(df.sparkSession, rows, "column_name string, data_type string, comparable boolean, is_float boolean")
