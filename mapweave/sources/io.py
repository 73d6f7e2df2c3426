"""Reading configurations, schemas and payloads; writing results."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.errors import ConfigValidationError


def read_bytes(path: str, spark: SparkSession | None = None) -> bytes:
    """A small file: by the local file system, or by Spark for other stores."""
    if "://" in path and not path.startswith("file:"):
        row = (spark or SparkSession.active()).read.format("binaryFile").load(path).select("content").first()
        return bytes(row.content)
    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
        return f.read()


def load_schema(ref: str, roots: list[str], spark: SparkSession | None = None) -> Any:
    """classpath: looks below roots alone; file: and stores are read as named; a bare path as file, else below roots."""
    name, inside = ref.removeprefix("classpath:"), ref.startswith("classpath:")
    candidates = [] if inside else [ref]
    if inside or "://" not in ref:
        candidates += [os.path.join(r, name.lstrip("/")) for r in roots]
    for path in candidates:
        try:
            return json.loads(read_bytes(path, spark))
        except (OSError, FileNotFoundError):
            continue
        except ValueError as e:
            raise ConfigValidationError(f"schema {ref} isn't JSON: {e}") from e
    raise ConfigValidationError(f"schema {ref} isn't found")


def json_payloads(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """One row for each line (or each file) of JSON text, in column payload; empty text counts as an empty object."""
    text = spark.read.text(path, wholetext=whole)
    return text.select(F.when(F.trim("value") == "", "{}").otherwise(F.col("value")).alias("payload"))


def one_payload(spark: SparkSession, payload: dict | str | None) -> DataFrame:
    """A single payload in memory as a DataFrame with column payload."""
    text = payload if isinstance(payload, str) else json.dumps(payload or {})
    return spark.createDataFrame([(text if text.strip() else "{}",)], "payload string")


def write_lines(df: DataFrame, path: str, fmt: str = "text") -> None:
    """The output column as text lines, JSON or Parquet; replaces what is there."""
    writer = df.write.mode("overwrite")
    writer.text(path) if fmt == "text" else writer.format(fmt).save(path)


def write_document(text: str, path: str) -> None:
    """One document as UTF-8; parent folders are made."""
    if os.path.dirname(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
