"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and \x09-\x0D (what bytes.split() splits on).
SPLIT = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs its running tasks alone. Parquet is compressed, which plain
    ``checkpoint()`` is not.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        folder = hadoop(path)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect garbage, on which Spark removes the shuffle files of tables that are gone."""
    spark._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lowered, as a native array (null text: no words)."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(low, SPLIT), lambda w: w != "")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of a table that may be broadcast, where its rows are not all of a few numbers.
MAX_BYTES = 64_000_000


def small(df: DataFrame, max_rows: int, bytes_of_row: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint only if it is proven to have at most ``max_rows`` rows; joins shuffle otherwise.

    With ``bytes_of_row`` the rows must also sum to ``MAX_BYTES`` at most. ``df`` should be materialized, as
    its rows are counted (up to the bound) here.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    if bytes_of_row is not None and (df.agg(F.sum(bytes_of_row)).first()[0] or 0) > MAX_BYTES:
        return df
    return F.broadcast(df)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def matched(df: DataFrame, by: list[Column], keys: DataFrame, how: str, max_rows: int = 400_000) -> DataFrame:
    """Rows of ``df`` whose columns ``by`` are (left_semi), or are not (left_anti), a row of ``keys``; null is like null."""
    other = small(keys.toDF(*[unused(df, f"_key{k}") for k in range(len(by))]), max_rows)
    return df.join(other, reduce(lambda a, b: a & b, [c.eqNullSafe(other[n]) for c, n in zip(by, other.columns, strict=True)]), how)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds about ``max_bytes`` each; one longer text stays whole."""
    for batch in batches:
        lengths = batch.column(column).nbytes if batch.num_rows else 0
        step = max(1, int(batch.num_rows * max_bytes / max(lengths, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
