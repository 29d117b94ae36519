"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: Column) -> Column:
    """Tells rows of one doc_id apart by their text; equal rows share the key and the result."""
    return F.coalesce(F.xxhash64(text), F.lit(0).cast("long"))


def batches_of(rows: Iterator[dict], schema: pa.Schema, at_most: int = 2000,
               most_bytes: int = 16 << 20, weight=None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length; ``weight(row)`` counts the bytes of large rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= at_most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than blank and tab to carriage return, which is what bytes.split takes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once a session, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_saleloom_shipped", False):
        return
    import pathlib
    import tempfile
    import zipfile

    top = pathlib.Path(__file__).resolve().parents[1]
    path = pathlib.Path(tempfile.mkdtemp(prefix="saleloom-code-")) / "saleloom_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(path))
    context._saleloom_shipped = True
