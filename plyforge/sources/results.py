"""Results tables: upsert, delete, rendering; and the memo of finished items."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in or in the place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def drop_rows(table: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    return table.filter(~F.coalesce(F.col(key).isin(*values), F.lit(False)))


def render_markdown(table: DataFrame, columns: Sequence[str], order: str) -> str:
    """A Markdown table of a results table, whose rows are few by nature."""
    rows = table.select(*[F.coalesce(F.col(c).cast("string"), F.lit("n/a")).alias(c) for c in columns]).orderBy(order).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])


def nested_json(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, items): one JSON array a key, ordered by its fields."""
    return df.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("items"))


def missing_items(items: DataFrame, memo: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items that the memo does not hold."""
    return items.join(memo.select(*keys).distinct(), list(keys), "left_anti")


def with_memo(items: DataFrame, memo: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], enabled: bool = True) -> DataFrame:
    """Hits from the memo and, for misses, what ``compute`` returns (with the memo's columns)."""
    if not enabled:
        return compute(items).select(*memo.columns)
    hits = memo.join(items.select(*keys).distinct(), list(keys), "left_semi")
    return hits.unionByName(compute(missing_items(items, memo, keys)).select(*memo.columns))


#: Settings that change the meaning of a cached item, by family.
CACHE_FIELDS = {
    "games": ("temperature", "top_k", "masked", "header_elo", "engine_time", "engine_depth"),
    "puzzles": ("temperature", "top_k", "masked", "header_elo", "prompt_style"),
    "positions": ("temperature", "top_k", "masked", "header_elo"),
}


def cache_settings(family: str, settings: dict) -> dict:
    return {k: settings.get(k) for k in CACHE_FIELDS[family]}


def require_same(measured: DataFrame, shipped: DataFrame, key: str, *fingerprints: str) -> DataFrame:
    """``measured`` joined to what is shipped under the same key, failing where none of the fingerprints agree.

    A key that is not shipped is an error as well; a null fingerprint agrees with nothing.
    """
    there = shipped.select(key, *[F.col(f).alias(f"shipped_{f}") for f in fingerprints]).withColumn("__there", F.lit(True))
    same = F.lit(False)
    for f in fingerprints:
        same = same | F.coalesce(F.col(f) == F.col(f"shipped_{f}"), F.lit(False))
    fails = F.raise_error(F.concat(F.lit("measured on something else than is shipped: "), F.col(key).cast("string"))).cast("boolean")
    joined = measured.join(there, key, "left").withColumn("verified", F.when(F.coalesce("__there", F.lit(False)) & same, True).otherwise(fails))
    return joined.drop("__there")


def share_settings(steps: dict[str, dict], shared: dict) -> dict[str, dict]:
    """The settings of each step with the shared ones put in where the step has none of its own, at any depth."""

    def under(own: dict, common: dict) -> dict:
        out = dict(own)
        for k, v in common.items():
            out[k] = under(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else out.get(k, v)
        return out

    return {name: under(own, shared) for name, own in steps.items()}


def dry_run(steps: dict[str, Callable[[], DataFrame]]) -> dict[str, str]:
    """The physical plan of each step's table, without running any: a step builds its table and writes nothing."""
    out = {}
    for name, step in steps.items():
        df = step()
        mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        out[name] = df._jdf.queryExecution().explainString(mode)
    return out


def run_catalogue(steps: dict[str, Callable[[], object]], only: Sequence[str] | None = None) -> list[dict]:
    """Runs steps by name; a failure is recorded and the rest still run."""
    import time

    out = []
    for name, step in steps.items():
        if only and name not in only:
            continue
        began = time.monotonic()
        try:
            step()
            out.append({"name": name, "status": "ok", "seconds": round(time.monotonic() - began, 3), "error": None})
        except Exception as e:  # noqa: BLE001 - one failure must not lose the rest
            out.append({"name": name, "status": "failed", "seconds": round(time.monotonic() - began, 3), "error": str(e)[:500]})
    return out
