"""Tables in the folder that the cluster shares, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session that sets none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def land(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table of its own in the shared folder and read it back: this cuts lineage,
    and the files outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with over this share of all rows is hot; so fewer than its inverse are.
HOT = 1 / 2000
#: Landed tables of at most so many short rows are broadcast.
SMALL_TABLE = 100_000


def join_hot(rows: DataFrame, values: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined to ``values``, a landed table of one row for each key with ``n``, the number of its rows in ``rows``.

    A small table is broadcast. Of others the hot keys are broadcast, which fewer than 2,000 rows of ``values`` are, and the rest
    are joined by a shuffle, which has no hot key then.
    """
    total, number = values.agg(F.sum(n), F.count("*")).first()
    if number <= SMALL_TABLE:
        return rows.join(F.broadcast(values), key)
    least = (total or 0) * HOT
    hot = F.broadcast(values.where(F.col(n) > least))
    cold = rows.join(F.broadcast(values.where(F.col(n) > least).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(values.where(F.col(n) <= least), key))


def set_aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns of these names under others, and a function that gives the rows of a result exactly the columns of ``docs`` back."""
    held = {c.lower() for c in docs.columns}
    aside = {}
    for c in docs.columns:
        if c.lower() in names:
            n = 0
            while (other := f"aside{n}_{c.lower()}") in held:
                n += 1
            aside[c] = other
            held.add(other)
    return docs.withColumnsRenamed(aside), lambda out: out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(batches, rows: int = 256, chars: int = 4_000_000, column: int = 1):
    """Slice Arrow batches so that one slice has few rows and little text; one row is never split."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total, start = np.concatenate([[0], np.cumsum(size)]), 0
        while start < batch.num_rows:
            end = int(np.searchsorted(total, total[start] + chars, side="right")) - 1
            end = max(start + 1, min(end, start + rows, batch.num_rows))
            yield batch.slice(start, end - start)
            start = end


def files_of(landed: DataFrame) -> list[str]:
    """The files of a landed table, for tasks that read them one after the other with ``groups_of``."""
    return landed.inputFiles()


def groups_of(path: str):
    """The row groups of a landed file, as functions from column names to their rows; nothing is read before they are called."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    with fs.open_input_file(inner) as held:
        file = pq.ParquetFile(held)
        for k in range(file.num_row_groups):
            yield lambda *columns, k=k: file.read_row_group(k, columns=list(columns))
