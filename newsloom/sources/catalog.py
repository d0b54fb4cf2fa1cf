"""Tables of the catalog: partitions replaced as they come, statistics, and statements with named parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from newsloom.errors import SchemaError
from newsloom.schema import TABLES, conforms


def create(spark: SparkSession, table: str, schema: StructType, by: tuple[str, ...] = (), location: str | None = None) -> bool:
    """Makes a Parquet table if there is none of that name; whether it did."""
    if spark.catalog.tableExists(table):
        return False
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet" + (f" PARTITIONED BY ({', '.join(by)})" if by else "") + (f" LOCATION '{location}'" if location else ""))
    return True


def create_all(spark: SparkSession, database: str = "default", root: str | None = None) -> list[str]:
    """Makes the engine's tables that are missing; their names."""
    return [n for n, (schema, by) in TABLES.items() if create(spark, f"{database}.{n}", schema, by, f"{root}/{n}" if root else None)]


def status(spark: SparkSession, database: str = "default") -> dict[str, bool]:
    return {name: spark.catalog.tableExists(f"{database}.{name}") for name in TABLES}


def load(rows: DataFrame, table: str, statistics: bool = True) -> None:
    """Replaces the partitions of table that rows has; others stay. Loading the same rows again changes nothing."""
    spark = rows.sparkSession
    lacking = conforms(rows, spark.table(table).schema)
    if lacking:
        raise SchemaError(f"{table} needs {', '.join(lacking)}", "SCHEMA_MISMATCH", columns=lacking)
    by = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    rows = rows.select(*spark.table(table).columns)
    # few files a partition; a large one is split among tasks by rebalancing
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        (rows.hint("rebalance", *by) if by else rows).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)
    if statistics:
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS")


def ask(spark: SparkSession, statement: str, **given) -> DataFrame:
    """A statement with :named parameters, which are values and never text of the statement."""
    return spark.sql(statement, args=given)


def rows_known(spark: SparkSession, table: str) -> int | None:
    """Rows by the table's statistics; None without any."""
    found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}.get("Statistics", "")
    counts = [int(w) for w, unit in zip(found.split(), found.split()[1:], strict=False) if unit.startswith("rows")]
    return counts[0] if counts else None


def healthy(spark: SparkSession) -> bool:
    """Whether the catalog answers."""
    try:
        return ask(spark, "SELECT :one AS one", one=1).first()["one"] == 1 and spark.catalog.databaseExists("default")
    except Exception:  # a catalog that is down raises errors of its own kinds through the JVM
        return False
