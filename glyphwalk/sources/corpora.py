"""Text corpora: JSON lines (plain, gzip, zstd), word lists, dimension tables."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAGRAPHS = "\n\n"


def read_jsonl(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """(text) of JSON lines. A list of strings is one text, its parts joined by an empty line."""
    lines = spark.read.text(path)
    single, many = F.get_json_object("value", f"$.{text}"), F.from_json("value", f"`{text}` array<string>").getField(text)
    is_list = F.regexp_like(F.ltrim(single), F.lit(r"\A\["))
    return lines.where("value <> ''").select(F.when(is_list & many.isNotNull(), F.array_join(many, PARAGRAPHS)).otherwise(single).alias(text))


def read_zstd_jsonl(spark: SparkSession, path: str, text: str = "text", rows: int = 4096) -> DataFrame:
    """(text) of all zstd-compressed JSON-lines files under ``path``; each file is one stream, read in pieces."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for part in parts:
            for content in part.column(0):
                held = []
                stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py()), read_across_frames=True)
                for line in io.TextIOWrapper(stream, encoding="utf-8"):
                    if line.strip():
                        value = json.loads(line).get(text)
                        held.append(PARAGRAPHS.join(value) if isinstance(value, list) else value)
                    if len(held) == rows:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], [text])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], [text])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zst").load(path).select("content")
    return files.mapInArrow(run, T.StructType([T.StructField(text, T.StringType())]))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct words of a list, one on a line, in lower case."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def with_validity(urls: DataFrame, checked: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``valid``: whether a table of checked URLs (url, status) has it below 300; null if it was never checked."""
    codes = checked.select(F.col("url").alias("__u"), "status").dropDuplicates(["__u"])
    return urls.join(codes, F.col(url) == F.col("__u"), "left").withColumn("valid", F.col("status") < 300).drop("__u", "status")
