"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where it names none, a folder of our own serves executors in this process alone; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="areaweave-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table of ours."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table replaces the lineage: a lost executor re-reads it and recomputes nothing before it.
    The table is removed when the application's file system handle closes.
    """
    return written(df, what)[0]


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """`cut`, and where the table lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of one key that a task is given; a key with more is dealt to several.
SHARE = 1000
#: Keys that are told apart as hot, at most: what is broadcast has no more rows.
HOT_KEYS = 50_000


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], many: str, salt: Column, share: int = SHARE, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Join ``table`` (one row for each key, ``many`` of its rows in ``rows``) to ``rows``, however unevenly keys are spread.

    A key is hot if it has more than ``share`` rows and more than the ``hot_keys``-th part of all: of such keys there are
    fewer than ``hot_keys``, so they are broadcast at every size and no row moves by an unsalted key. Rows of a hot key are
    told apart by ``salt``, and its row of the table is sent as many times as it has parts. A key that is not hot holds no more
    than a ``hot_keys``-th of the rows, which is nothing that a task would wait for.
    """
    table = cut(table, "join-table")
    total = table.agg(F.sum(many)).first()[0] or 0
    share = max(share, -(-total // hot_keys))
    hot = cut(table.where(F.col(many) > share).select(*keys, F.ceil(F.col(many) / share).alias("__parts")), "join-hot")
    parted = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.pmod(salt.cast("long"), F.coalesce("__parts", F.lit(1)).cast("long"))).drop("__parts")
    copies = F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(F.col(many), F.lit(1)) / share).cast("long") - 1)
    spread = table.withColumn("__salt", F.explode(F.when(F.col(many) > share, copies).otherwise(F.array(F.lit(0).cast("long")))))
    return parted.join(spread, [*keys, "__salt"]).drop("__salt")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch, column: str, limit: int = 8 << 20):
    """Cut an Arrow record batch into runs of rows of about ``limit`` bytes of text, in order.

    A single row may be longer than the limit; it then stands alone, whole.
    """
    import numpy as np
    import pyarrow as pa

    at = batch.schema.get_field_index(column)
    col = batch.column(at)
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    n = batch.num_rows
    sizes = np.zeros(n, dtype=np.int64)
    if n:
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i in range(n):
        if i > start and total + sizes[i] > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    if start < n:
        yield batch.slice(start, n - start)
