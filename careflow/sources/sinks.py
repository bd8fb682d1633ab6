"""Report files, SQL text dumps and table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from careflow.functions import scalars as S

# The tables of the SQL dump, and the lines around it.
DUMPED = ["patients", "staff", "sessions", "machines", "medical_supplies"]
DUMP_TITLE = "-- Partial SQL Dump generated on "
DUMP_BEGIN = ["PRAGMA foreign_keys=OFF;", "BEGIN TRANSACTION;"]
DUMP_END = ["COMMIT;"]


def labelled(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The labelled columns under their display names."""
    return df.select(*[F.col(c).alias(label) for c, label in labels.items()])


def write_report(
    df: DataFrame, path: str, fmt: str = "csv", labels: dict[str, str] | None = None, mode: str = "error"
) -> None:
    """Writes report rows as csv, json or parquet, in their order."""
    out = labelled(df, labels) if labels else df
    writer = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def insert_lines(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row; values are quoted text or NULL."""
    values = F.concat_ws(", ", *[S.sql_literal(S.plain_text(c, t)) for c, t in df.dtypes])
    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.lit(table).alias("table_name"), F.concat(F.lit(head), values, F.lit(");")).alias("line"))


def sql_dump(tables: dict[str, DataFrame]) -> DataFrame:
    """The INSERT lines of the dumped tables."""
    parts = [insert_lines(tables[name], name) for name in DUMPED if name in tables]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_sql_dump(spark: SparkSession, tables: dict[str, DataFrame], path: str, now: str) -> None:
    """Text files in folders whose names sort in load order: begin, one per table, end."""
    path = path.rstrip("/")

    def lines(rows: list[str], folder: str) -> None:
        spark.createDataFrame([(r,) for r in rows], "line string").coalesce(1).write.text(f"{path}/{folder}")

    lines([f"{DUMP_TITLE}{now}", *DUMP_BEGIN], "00-begin")
    for i, name in enumerate((n for n in DUMPED if n in tables), 1):
        insert_lines(tables[name], name).select("line").write.text(f"{path}/{i:02d}-{name}")
    lines(DUMP_END, "99-end")


def snapshot(tables: dict[str, DataFrame], base: str, stamp: str) -> str:
    """Copies all tables under base/backup-<stamp>; returns that folder."""
    folder = f"{base.rstrip('/')}/backup-{stamp.replace(':', '-').replace('.', '-')}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return folder


def list_snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Name, size in KB and time of each snapshot, newest first. File contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(base)
    )
    name = F.regexp_extract("path", r"/(backup-[^/]+)/", 1)
    return (
        files.groupBy(name.alias("name"))
        .agg(
            F.round(F.sum("length") / 1024, 2).alias("size_kb"),
            F.min("modificationTime").alias("created"),
        )
        .where("name <> ''")
        .orderBy(F.desc("created"), F.desc("name"))
    )
