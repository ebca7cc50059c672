"""Hex dumps as captures: lines of an offset and byte groups; a frame starts where the offset is zero again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_hexdump(spark: SparkSession, path: str, offset_base: int = 16, link_type: int = 1) -> DataFrame:
    """Frames of the dumps at path: path, ordinal, bytes, link_type. Other lines are ignored."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    pattern = r"^\s*([0-9a-fA-F]{2,8})[:\s]\s*((?:[0-9a-fA-F]{2}[ \t]?)+)"
    hits = lines.select("path", "line", F.conv(F.regexp_extract("text", pattern, 1), offset_base, 10).cast("long").alias("at"), F.regexp_replace(F.regexp_extract("text", pattern, 2), r"\s", "").alias("hex"), F.regexp_like("text", F.lit(pattern)).alias("ok")).where("ok")
    order = Window.partitionBy("path").orderBy("line")
    framed = hits.withColumn("ordinal", F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).over(order)).where("ordinal > 0")
    whole = framed.groupBy("path", "ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hex"))), lambda x: x["hex"]), "").alias("hex"))
    return whole.select("path", "ordinal", F.unhex("hex").alias("bytes"), F.lit(link_type).alias("link_type"))
