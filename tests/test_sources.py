"""Files, PGN, manifests, configuration, results, ingestion: round trips in temporary folders."""

import dataclasses
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plyforge.sources import files, manifest, pgn, results
from plyforge.streaming import ingest

PGN = """[Event "a"]
[Site "https://x/1"]
[Result "1-0"]

1. e4 e5
2. Nf3 1-0

[Event "only headers"]
[Site "https://x/2"]

[Event "b"]
[WhiteElo "?"]

1. d4 d5 1/2-1/2
"""


def test_months_layout(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2025-01"), (2, "2025-01"), (3, "2025-02")], "id int, month string")
    files.write_months(df, root)
    assert [m for m, _ in files.months(spark, root)] == ["2025-01", "2025-02"]
    assert sorted((r.id, r.month) for r in files.scan_months(spark, root).collect()) == [(1, "2025-01"), (2, "2025-01"), (3, "2025-02")]
    assert files.scan_months(spark, root, ["2025-01"], limit=1, order="id").first().id == 1
    files.write_months(spark.createDataFrame([(9, "2025-02")], "id int, month string"), root)  # replaces one month only
    assert sorted(r.id for r in files.scan_months(spark, root).collect()) == [1, 2, 9]
    with pytest.raises(ValueError):
        files.scan_months(spark, str(tmp_path / "none"))


def test_union_by_name_and_pushdown(spark, tmp_path):
    spark.range(3).select(F.col("id").alias("a")).write.parquet(str(tmp_path / "x"))
    spark.range(3).select(F.col("id").alias("a"), F.lit("b").alias("b")).write.parquet(str(tmp_path / "y"))
    df = files.scan(spark, str(tmp_path / "x"), str(tmp_path / "y"), by_name=True)
    assert sorted(df.columns) == ["a", "b"] and df.filter("b is null").count() == 3
    plan = files.scan(spark, str(tmp_path / "y"), columns=["a"]).filter("a > 1")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(a), GreaterThan(a,1)]" in plan and "ReadSchema: struct<a:bigint>" in plan


def test_pgn_files_and_zips(spark, tmp_path):
    (tmp_path / "a.pgn").write_text(PGN)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("in/x.pgn", PGN)
    rows = pgn.read_pgn(spark, str(tmp_path)).collect()
    assert len(rows) == 4
    one = sorted((r for r in rows if r.path.endswith("a.pgn")), key=lambda r: r.game_no)
    assert one[0].Site == "https://x/1" and one[0].movetext == "1. e4 e5 2. Nf3 1-0" and one[1].Event == "b" and one[1].Site is None
    with pytest.raises(ValueError):
        with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
            z.writestr("x.pgn", PGN), z.writestr("y.pgn", PGN)
        pgn.members("two.zip", (tmp_path / "two.zip").read_bytes())


def test_manifest_counts_and_hashes(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "out")
    m = manifest.write_with_manifest(spark.range(10), path, "ten", {"min": 1}, {"even": F.count_if(F.col("id") % 2 == 0)}, files=1)
    assert m["counts"] == {"rows": 10, "even": 5} and len(m["files"]) == 1
    data = next((tmp_path / "out").glob("*.parquet")).read_bytes()
    assert m["files"][0]["sha256"] == hashlib.sha256(data).hexdigest() and m["files"][0]["bytes"] == len(data)
    assert json.loads((tmp_path / "out" / "manifest.json").read_text())["dataset"] == "ten"
    read = manifest.read_manifests(spark, f"{path}/manifest.json")
    assert manifest.counted_rows(read, ["even"]).first().rows == 10


def test_closed_world_configuration(tmp_path):
    @dataclasses.dataclass
    class Inner:
        n: int = 1

    @dataclasses.dataclass
    class Outer:
        name: str
        inner: Inner = dataclasses.field(default_factory=Inner)

    Outer.__annotations__ = {"name": str, "inner": Inner}
    assert manifest.load_config(Outer, {"name": "x", "inner": {"n": 3}}).inner.n == 3
    for bad in ({"name": "x", "more": 1}, {}, {"name": "x", "inner": {"m": 1}}):
        with pytest.raises(ValueError):
            manifest.load_config(Outer, bad)
    assert manifest.flatten({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    (tmp_path / "c.json").write_text('{"name": "y"}')
    assert manifest.load_yaml(str(tmp_path / "c.json"), Outer).name == "y"


def test_flat_columns_and_sizes(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit(1).alias("c")).alias("b"), F.lit(2).alias("d")).alias("a"))
    assert manifest.flat_columns(df).columns == ["a.b.c", "a.d"]
    assert spark.range(1).select(manifest.size_class(F.lit(999)).alias("x")).first().x == "n<1K"


def test_results_memo_and_catalogue(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "stage string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "stage string, v int")
    got = {r.stage: r.v for r in results.upsert(old, new, "stage").collect()}
    assert got == {"a": 1, "b": 3, "c": 4}
    assert results.render_markdown(results.drop_rows(old, "stage", ["a"]), ["stage", "v"], "stage").splitlines()[-1] == "| b | 2 |"
    assert results.nested_json(old, "stage", ["v"]).count() == 2
    calls = []

    def compute(missing):
        calls.append(sorted(r.stage for r in missing.collect()))
        return missing.withColumn("v", F.lit(9))

    items = spark.createDataFrame([("b",), ("z",)], "stage string")
    assert {r.stage: r.v for r in results.with_memo(items, old, ["stage"], compute).collect()} == {"b": 2, "z": 9} and calls == [["z"]]
    ran = results.run_catalogue({"good": lambda: 1, "bad": lambda: 1 / 0, "last": lambda: 2})
    assert [x["status"] for x in ran] == ["ok", "failed", "ok"]
    assert results.cache_settings("puzzles", {"temperature": 1, "seed": 2}) == {"temperature": 1, "top_k": None, "masked": None, "header_elo": None, "prompt_style": None}


def test_token_stream_export(spark, tmp_path):
    import numpy as np

    rows = spark.createDataFrame([(3, [4, 5]), (0, [1, 2, 3])], "start bigint, ids array<int>")
    assert files.write_token_stream(rows, str(tmp_path / "s"))["tokens"] == 5
    assert np.load(tmp_path / "s" / "tokens.npy").tolist() == [1, 2, 3, 4, 5] and np.load(tmp_path / "s" / "starts.npy").tolist() == [0, 3]
    with pytest.raises(ValueError):
        files.write_token_stream(spark.createDataFrame([(0, [70000])], "start bigint, ids array<int>"), str(tmp_path / "t"))


def test_ingestion_resumes_without_repeats(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.range(5).coalesce(1).write.parquet(source)
    ingest.ingest_files(spark, source, target, mark, lambda df: df.filter("id > 0"))
    assert spark.read.parquet(target).count() == 4
    ingest.ingest_files(spark, source, target, mark, lambda df: df.filter("id > 0"))
    assert spark.read.parquet(target).count() == 4
    spark.range(5, 8).coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_files(spark, source, target, mark, lambda df: df.filter("id > 0"), max_files=1)
    assert spark.read.parquet(target).count() == 7


def test_event_windows_as_a_stream_equal_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "events")
    events.write.parquet(path)
    batch = ingest.windowed_counts(events)
    query = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(path)).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows")
    assert got.count() == batch.count() > 0 and got.agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]
    assert ingest.sessions(events).agg(F.sum("n")).first()[0] == events.filter("user_id is not null and ts is not null").count()


def test_text_lines(spark, tmp_path):
    files.write_text_lines(spark.createDataFrame([("a\nb", 1)], "game string, n int"), "game", str(tmp_path / "j"))
    assert [r.text for r in spark.read.json(str(tmp_path / "j")).collect()] == ["a\nb"]


def test_large_texts_are_cut_by_record(spark, tmp_path):
    game = '[Event "e{0}"]\n[Site "s{0}"]\n[%odd line]\n\n1. e4 {{ [%clk 1] }} e5 *\n\n'
    (tmp_path / "many.pgn").write_text("".join(game.format(i) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = pgn.read_pgn(spark, str(tmp_path))
        rows = df.orderBy("game_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.Event for r in rows] == [f"e{i}" for i in range(3000)] and [r.game_no for r in rows] == list(range(3000))
    assert {r.movetext for r in rows} == {"1. e4 { [%clk 1] } e5 *"}


def test_an_illegal_game_fails_a_strict_read(spark):
    df = spark.createDataFrame([(1, "kept"), (2, "illegal")], "id int, reason string")
    assert pgn.strict(df.filter("id = 1")).count() == 1
    with pytest.raises(Exception, match="illegal game"):
        pgn.strict(df).collect()


def test_vectors_and_their_rows(spark, tmp_path):
    import numpy as np

    df = spark.createDataFrame([(f"k{i}", [float(i), i / 2]) for i in range(50)] + [("none", None)], "k string, v array<double>").repartition(4)
    meta = files.write_vectors(df, "k", "v", str(tmp_path / "out"))
    assert meta["rows"] == 50 and meta["width"] == 2
    shards = {}
    for r in spark.read.parquet(str(tmp_path / "out/rows")).collect():
        if r.shard not in shards:
            shards[r.shard] = np.load(tmp_path / f"out/vectors-{r.shard:05d}.npy")
        assert shards[r.shard][r.row].tolist() == [float(r.key[1:]), float(r.key[1:]) / 2]
    with pytest.raises(ValueError):
        files.write_vectors(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "k string, v array<double>"), "k", "v", str(tmp_path / "bad"))


def test_shards_are_filtered_resumed_and_merged(spark, tmp_path):
    shards = []
    for i in range(4):
        shards.append(str(tmp_path / f"s{i}"))
        spark.range(i * 100, i * 100 + 100).write.parquet(shards[-1])
    seen = []

    def keep(df):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("broken off")
        return df.filter("id % 10 = 0")

    target = str(tmp_path / "out")
    with pytest.raises(RuntimeError):
        ingest.ingest_shards(spark, shards, target, keep, drop_shards=True)
    assert ingest.ingest_shards(spark, shards, target, keep) == 40 and len(seen) == 5  # two parts were there
    assert spark.read.parquet(target).count() == 40 and not (tmp_path / "out.parts").exists() and not (tmp_path / "s0").exists()
    assert ingest.ingest_shards(spark, shards[2:], str(tmp_path / "few"), lambda df: df, limit=30) == 30
    with pytest.raises(ValueError):
        ingest.ingest_shards(spark, shards[2:], str(tmp_path / "none"), lambda df: df.filter("id < 0"))


def test_newest_run_by_name(spark, tmp_path):
    for name in ("m-20250101-000000", "m-20250301-000000", "m-big-20260101-000000", "n"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "best.pt").write_text("x")
    at = lambda p: files.newest_run(spark, f"{tmp_path}/{p}").rpartition(str(tmp_path))[2]
    assert at("m/best.pt") == "/m-20250301-000000/best.pt" and at("m") == "/m-20250301-000000" and at("n") == "/n" and at("q/best.pt") == "/q/best.pt"


def test_provenance_settings_and_dry_runs(spark):
    shipped = spark.createDataFrame([("a", "1", "x"), ("b", "2", None)], "k string, file string, weights string")
    measured = lambda *rows: spark.createDataFrame(list(rows), "k string, file string, weights string")
    assert results.require_same(measured(("a", "0", "x"), ("b", "2", None)), shipped, "k", "file", "weights").filter("verified").count() == 2
    for bad in (("b", "0", None), ("c", "1", "x")):
        with pytest.raises(Exception, match="something else than is shipped"):
            results.require_same(measured(bad), shipped, "k", "file", "weights").collect()
    steps = results.share_settings({"one": {"engine": {"threads": 2}}, "two": {}}, {"engine": {"threads": 8, "memory": "4g"}})
    assert steps == {"one": {"engine": {"threads": 2, "memory": "4g"}}, "two": {"engine": {"threads": 8, "memory": "4g"}}}
    assert "Range" in results.dry_run({"r": lambda: spark.range(5)})["r"]
