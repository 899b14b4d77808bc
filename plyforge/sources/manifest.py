"""Provenance beside a table, and closed-world configuration."""

from __future__ import annotations

import dataclasses
import json
import typing
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import plyforge
from plyforge.sources.files import file_hashes, write_table


def write_with_manifest(df: DataFrame, path: str, dataset: str, filters: dict, counters: dict[str, Column], files: int | None = None) -> dict:
    """Writes a table and ``manifest.json`` in it: filters, counts and file hashes.

    Counters are observed while the table is written; there is no second pass.
    """
    from pyspark.sql import Observation

    seen = Observation(dataset)
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()]), path, files)
    spark = df.sparkSession
    hashed = [r.asDict() for r in file_hashes(spark, path).orderBy("path").collect()]
    manifest = {"dataset": dataset, "filters": filters, "counts": dict(seen.get), "files": hashed, "created_at": datetime.now(timezone.utc).isoformat(), "version": plyforge.__version__}
    _write_text(spark, f"{path}/manifest.json", json.dumps(manifest, default=str, indent=1))
    return manifest


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_manifests(spark: SparkSession, pattern: str) -> DataFrame:
    """Manifests that match a glob, a row each; documents without counts are left out."""
    return spark.read.option("multiLine", "true").json(pattern).filter("counts is not null")


def counted_rows(manifests: DataFrame, excluded: typing.Sequence[str]) -> DataFrame:
    """(dataset, rows): sum of a manifest's counts but the excluded keys."""
    long = manifests.select("dataset", F.explode(F.from_json(F.to_json("counts"), "map<string,bigint>")).alias("key", "n"))
    return long.filter(~F.col("key").isin(*excluded)).groupBy("dataset").agg(F.sum("n").alias("rows"))


#: Upper edges of size classes.
SIZE_CLASSES = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"), (10_000_000, "1M<n<10M"), (100_000_000, "10M<n<100M"), (1_000_000_000, "100M<n<1B"))


def size_class(rows: Column) -> Column:
    out = F.lit("n>1B")
    for edge, name in reversed(SIZE_CLASSES):
        out = F.when(rows < edge, name).otherwise(out)
    return out


def flatten(settings: dict, head: str = "") -> dict[str, object]:
    """``{"a": {"b": 1}}`` as ``{"a.b": 1}``."""
    out: dict[str, object] = {}
    for k, v in settings.items():
        out |= flatten(v, f"{head}{k}.") if isinstance(v, dict) else {f"{head}{k}": v}
    return out


def flat_columns(df: DataFrame) -> DataFrame:
    """Struct columns as columns ``a.b``."""
    from pyspark.sql.types import StructType

    def walk(schema, head):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, [*head, f.name])
            else:
                yield F.col(".".join(f"`{x}`" for x in [*head, f.name])).alias(".".join([*head, f.name]))

    return df.select(*walk(df.schema, []))


def load_config(cls: type, values: dict):
    """A dataclass from a mapping, by the closed world: unknown keys and missing required ones are errors."""
    fields = {f.name: f for f in dataclasses.fields(cls)}
    unknown = sorted(set(values) - set(fields))
    if unknown:
        raise ValueError(f"{cls.__name__}: unknown {', '.join(unknown)}")
    types = typing.get_type_hints(cls)
    made = {k: load_config(types[k], v) if dataclasses.is_dataclass(types[k]) and isinstance(v, dict) else v for k, v in values.items()}
    try:
        return cls(**made)
    except TypeError as e:
        raise ValueError(str(e)) from None


def load_yaml(path: str, cls: type):
    """The same from a YAML (if a parser is installed) or JSON file."""
    with open(path) as f:
        text = f.read()
    try:
        import yaml

        values = yaml.safe_load(text)
    except ImportError:
        values = json.loads(text)
    return load_config(cls, values or {})
