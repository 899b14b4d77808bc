"""Scans, partition layouts and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, by_name: bool = False) -> DataFrame:
    """Parquet files, folders or globs; ``by_name`` unites different schemas by column name."""
    df = spark.read.option("mergeSchema", str(by_name).lower()).parquet(*paths)
    return df.select(*columns) if columns else df


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted, on any Hadoop file system."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or [])


def months(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(YYYY-MM, folder) of a ``year=YYYY/month=MM`` layout."""
    out = []
    for path in list_files(spark, f"{root}/year=*/month=*"):
        m = re.search(r"year=(\d{4})/month=(\d{1,2})/?$", path)
        if m:
            out.append((f"{m[1]}-{int(m[2]):02d}", path))
    return sorted(out)


def month_path(root: str, month: str) -> str:
    year, number = month.split("-")
    return f"{root}/year={year}/month={number}"


def scan_months(spark: SparkSession, root: str, wanted: Sequence[str] | None = None, limit: int | None = None, order: str | None = None) -> DataFrame:
    """The months of a layout with an explicit ``month`` column and without the path's own.

    ``limit`` holds for each month; it takes the first rows by ``order`` if that
    is given, else any.
    """
    parts = []
    for month, path in months(spark, root):
        if wanted is None or month in wanted:
            df = spark.read.parquet(path)
            df = df.drop("month").withColumn("month", F.lit(month))
            if limit is not None:
                df = (df.orderBy(order) if order else df).limit(limit)
            parts.append(df)
    if not parts:
        raise ValueError(f"no months under {root}")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_months(df: DataFrame, root: str, month: str = "month", mode: str = "overwrite") -> None:
    """Writes ``year=/month=`` folders; only the months in ``df`` are replaced."""
    out = df.withColumn("year", F.substring(month, 1, 4)).withColumn("__m", F.col(month)).withColumn("month", F.substring("__m", 6, 2)).drop("__m")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(root)


def write_table(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet, in at most ``files`` files; the committer makes it all or nothing."""
    (df.coalesce(files) if files else df).write.mode(mode).option("compression", "zstd").parquet(path)


def write_text_lines(df: DataFrame, column: str, path: str) -> None:
    """One JSON object ``{"text": ...}`` a line."""
    df.select(F.col(column).alias("text")).write.mode("overwrite").json(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: nothing is left")
    return df


def merge_parts(spark: SparkSession, parts: str, target: str, files: int = 1) -> int:
    """Writes the rows of all part files under ``parts`` as ``files`` files under ``target``, then drops the parts; returns the rows.

    Parts are united by column name.  They are dropped only once the target is
    committed; a part folder without rows is an error and stays.
    """
    rows = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(parts)
    n = require_rows(rows, parts).count()
    write_table(rows, target, files)
    folder = spark._jvm.org.apache.hadoop.fs.Path(parts)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def newest_run(spark: SparkSession, path: str) -> str:
    """``path`` if it exists, else the same within the newest stamped run of that name (``name-YYYYMMDD-HHMMSS``), else ``path``.

    The stamp sorts as text; folders' own times do not count.
    """
    if list_files(spark, path):
        return path
    folder, _, leaf = path.rpartition("/")
    base, rest = (folder, f"/{leaf}") if "." in leaf else (path, "")
    stamp = re.compile(re.escape(base.rpartition("/")[2]) + r"-\d{8}-\d{6}$")
    runs = [p for p in list_files(spark, base + "-*") if stamp.search(p)]
    return runs[-1] + rest if runs else path


def file_hashes(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they are listed, a megabyte at a time, so a file may have any size."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        for df in batches:
            sums = []
            for name in df["path"]:
                system, inner = fs.FileSystem.from_uri(name if "://" in name else re.sub("^file:/+", "file:///", name))
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while chunk := stream.read(1 << 20):
                        digest.update(chunk)
                sums.append(digest.hexdigest())
            yield pd.DataFrame({"path": df["path"], "bytes": df["length"], "sha256": sums})

    return listed.mapInPandas(run, "path string, bytes bigint, sha256 string")


def write_vectors(df: DataFrame, key: str, vector: str, folder: str, dtype: str = "float32") -> dict:
    """Writes ``vectors-NNNNN.npy`` and a table ``rows`` (shard, row, key) that says whose vector each row is.

    Every task writes a shard of its own rows into ``folder``, which all
    executors share; rows with a null vector are left out.  A shard is written
    under another name and then renamed, so a repeated task leaves whole shards.
    Returns {shards, rows, width}; vectors of different widths are an error.
    """
    import os

    kept = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector"))
    low, high, n = kept.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count(F.lit(1))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers")
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        task = TaskContext.get()
        keys, parts = [], []
        for b in batches:
            keys.append(b["key"])
            parts += list(b["vector"])
        if parts:
            name = f"{folder}/vectors-{task.partitionId():05d}.npy"
            half = f"{name}.{task.taskAttemptId()}"
            with open(half, "wb") as out:
                np.save(out, np.array(parts, dtype=dtype))
            os.replace(half, name)
            yield pd.DataFrame({"shard": task.partitionId(), "row": range(len(parts)), "key": pd.concat(keys)})

    kind = dict(kept.dtypes)["key"]
    kept.mapInPandas(run, f"shard int, row bigint, key {kind}").write.mode("overwrite").parquet(f"{folder}/rows")
    return {"shards": df.sparkSession.read.parquet(f"{folder}/rows").select("shard").distinct().count(), "rows": n, "width": high or 0}


def write_token_stream(packed: DataFrame, folder: str, dtype: str = "uint16") -> dict:
    """Writes ``tokens.npy``, ``starts.npy`` and ``meta.json`` of rows (start, ids), streaming by partition.

    For exports that a trainer maps into memory; ids that do not fit ``dtype``
    are an error.  ``start`` orders the rows.
    """
    import json
    import os

    import numpy as np

    top = np.iinfo(dtype).max
    worst = packed.agg(F.max(F.array_max("ids"))).first()[0]
    if worst is not None and worst > top:
        raise ValueError(f"id {worst} does not fit {dtype}")
    total, rows = packed.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count(F.lit(1))).first()
    os.makedirs(folder, exist_ok=True)
    tokens = np.lib.format.open_memmap(f"{folder}/tokens.npy", mode="w+", dtype=dtype, shape=(total,))
    starts = np.lib.format.open_memmap(f"{folder}/starts.npy", mode="w+", dtype="int64", shape=(rows,))
    for i, r in enumerate(packed.select("start", "ids").orderBy("start").toLocalIterator(prefetchPartitions=True)):
        starts[i] = r.start
        tokens[r.start : r.start + len(r.ids)] = r.ids
    tokens.flush()
    starts.flush()
    meta = {"tokens": int(total), "sequences": int(rows), "dtype": dtype}
    with open(f"{folder}/meta.json", "w") as out:
        json.dump(meta, out)
    return meta
