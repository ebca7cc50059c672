"""History tables (captures, sessions, findings) and read-only paged queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.net import csv_cell
from packetloom.operators.files import page


def session_rows(sessions: DataFrame, capture_id: str, masked: bool = False) -> DataFrame:
    """Rows for the history; masked leaves out process names and query names."""
    hide = lambda c: F.lit(None).cast("string") if masked else F.col(c)
    return sessions.select(
        F.lit(capture_id).alias("capture_id"), "session_id", "proto", "app", "client_ip", "client_port", "server_ip", "server_port", "start", "duration", "status", "bytes_up", "bytes_down", hide("process").alias("process"), hide("dns_query").alias("dns_query")
    )


def capture_row(sessions: DataFrame, capture_id: str) -> DataFrame:
    return sessions.groupBy(F.lit(capture_id).alias("id")).agg(F.count("*").alias("sessions"), F.sum("bytes").alias("bytes"), F.min("start").alias("started_at"), F.max("start").alias("ended_at"))


def write(rows: DataFrame, folder: str) -> None:
    """Replace one capture's partition and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("capture_id").parquet(folder)


def sessions_page(history: DataFrame, after: tuple | None = None, size: int = 100) -> DataFrame:
    return page(history.where("start IS NOT NULL"), ["start", "session_id"], after, size)


def as_csv(rows: DataFrame) -> DataFrame:
    """One text line per row, cells guarded against formulas."""
    return rows.select(F.concat_ws(",", *[F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in rows.columns]).alias("line"))
