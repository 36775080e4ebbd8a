"""Exports: spreadsheet-safe CSV, project backups, redaction and report tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def safe_cell(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula: such cells get a leading apostrophe; null is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^\s*[=+@-]") | text.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_csv(df: DataFrame) -> DataFrame:
    """Every column as a safe cell, nested ones as JSON."""
    nested = lambda t: isinstance(t, ArrayType | MapType | StructType)
    return df.select(*(safe_cell(F.to_json(f.name) if nested(f.dataType) else F.col(f.name)).alias(f.name) for f in df.schema))


def csv_lines(df: DataFrame) -> DataFrame:
    """(value): the lines of safe CSV, all cells quoted; the first of each of Spark's partitions is the header after a byte order mark."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            first = False
            yield batch

    return safe_csv(df).select(F.concat_ws(",", *(quoted(F.col(f"`{c}`")) for c in df.columns)).alias("value")).mapInArrow(headed, "value string")


def write_csv(df: DataFrame, path: str) -> None:
    """Files that a spreadsheet opens: UTF-8 with a byte order mark, CRLF, safe cells."""
    csv_lines(df).write.option("lineSep", "\r\n").text(path)


#: Columns that a backup leaves out, whatever the table.
PRIVATE = ("worker_id", "heartbeat_at", "lease_until")


def export_project(tables: dict[str, DataFrame], project_id: str | None, path: str) -> None:
    """JSON backup of all tables, or of one project's rows, in a folder for each table and project."""
    for name, df in tables.items():
        df = df.drop(*PRIVATE)
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("settings", "ledger_id") if c in df.columns})
        df = df.filter(F.col("project_id") == project_id) if project_id is not None else df
        df.write.partitionBy("project_id").json(f"{path}/{name}")


def redact(df: DataFrame, secrets: list[str]) -> DataFrame:
    """Known secrets replaced in every string, in arrays and structs of strings too."""

    def cleaned(c: Column, kind) -> Column:
        if isinstance(kind, StringType):
            for secret in filter(None, secrets):
                c = F.replace(c, F.lit(secret), F.lit("[REDACTED]"))
            return c
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: cleaned(x, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*(cleaned(c[f.name], f.dataType).alias(f.name) for f in kind)))
        return c

    return df.select(*(cleaned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema))


def report_tables(metrics: DataFrame, claims: DataFrame, domains: DataFrame, pages: DataFrame, gaps: DataFrame, plan: DataFrame, top: int = 5) -> dict[str, DataFrame]:
    """The tables of a project's report, by project."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("priority"), "id"))
    return {
        "brand_metrics": metrics,
        "claims": claims,
        "citation_domains": domains,
        "pages": pages.select("project_id", "page_id", "url", "score", "evaluated_weight"),
        "gaps": gaps,
        "top_actions": plan.withColumn("place", rank).filter(F.col("place") <= top),
        "actions_by_month": plan.groupBy("project_id", "month").agg(F.count("*").alias("actions"), F.max("priority").alias("priority")),
    }
