import hashlib
import random
from collections import Counter, defaultdict

import pytest

from plyforge.llm.mixing import mix_documents, mix_report, supply_report

SIZES = "doc_id bigint, source string, tokens bigint, finish string, position int"
TARGETS = "mix_name string, source string, weight double, max_repeats int, budget_tokens bigint"


def brute(sizes, targets, salt="mix1"):
    out = {}
    by_source = defaultdict(list)
    for doc, (source, n) in sorted({d: (s, n) for d, s, n in sizes if d is not None and s is not None and n and n > 0}.items()):
        by_source[source].append((hashlib.md5(f"{salt}:{doc}".encode()).hexdigest(), doc, n))
    for mix in {t[0] for t in targets}:
        queue, budget = [], max(t[4] for t in targets if t[0] == mix)
        for _, source, weight, most, _ in (t for t in targets if t[0] == mix):
            total = sum(n for _, _, n in by_source[source])
            for p in range(1, most + 1):
                run = 0
                for _, doc, n in sorted(by_source[source]):
                    run += n
                    queue.append((((p - 1) * total + run) / weight, source, p, doc, n))
        run, rows = 0, []
        for f, source, p, doc, n in sorted(queue):
            run += n
            if run > budget:
                break
            rows.append((source, doc, p, n))
        out[mix] = rows
    return out


def data(seed=1):
    rng = random.Random(seed)
    sizes = [(i, rng.choice(["big"] * 6 + ["mid", "mid", "small"]), rng.choice([0, 5, 40, 300, None])) for i in range(1500)] + [(None, "big", 5), (9999, None, 5)]
    targets = [("even", "big", 1.0, 1, 20000), ("even", "mid", 1.0, 2, 20000), ("even", "small", 1.0, 4, 20000), ("skew", "big", 70.0, 3, 9000), ("skew", "small", 30.0, 1, 9000), ("all", "small", 2.0, 2, 10**9), ("none", "absent", 1.0, 5, 100)]
    return sizes, targets


def frames(spark, sizes, targets):
    return spark.createDataFrame([(*r, "x", 1) for r in sizes], SIZES), spark.createDataFrame(targets, TARGETS)


def test_mixes_equal_a_plain_queue(spark):
    sizes, targets = data()
    got = defaultdict(list)
    for r in mix_documents(*frames(spark, sizes, targets), bins=64).orderBy("mix_name", "position").collect():
        got[r.mix_name].append((r.source, r.doc_id, r["pass"], r.tokens))
        assert r.position == len(got[r.mix_name])
    want = {k: v for k, v in brute(sizes, targets).items() if v}
    assert dict(got) == want
    assert max(p for _, _, p, _ in got["all"]) == 2  # a budget beyond the supply: each document twice, no more


def test_shares_and_repeats_are_reported(spark):
    sizes, targets = data(2)
    s, t = frames(spark, sizes, targets)
    report = {(r.mix_name, r.source): r for r in mix_report(mix_documents(s, t), s, t).collect()}
    assert len(report) == len(targets)
    assert report["skew", "big"].actual_share == pytest.approx(0.7, abs=0.05) or report["skew", "small"].short
    assert all(r.most_repeats <= m for (mix, source, _, m, _) in targets for r in [report[mix, source]])
    assert report["none", "absent"].short and report["none", "absent"].tokens == 0
    supply = {(r.mix_name, r.source): r.short for r in supply_report(s, t).collect()}
    total = Counter()
    for d, source, n in sizes:
        total[source] += n or 0
    for mix, source, w, m, budget in targets:
        share = budget * w / sum(x[2] for x in targets if x[0] == mix)
        assert supply[mix, source] == (total[source] * m < share)


def test_empty_tables_and_bad_rows(spark):
    sizes, targets = data()
    s, t = frames(spark, sizes, targets)
    assert mix_documents(s.limit(0), t).count() == 0 and mix_documents(s, t.limit(0)).count() == 0
    bad = spark.createDataFrame([("m", None, 1.0, 1, 10), (None, "big", 1.0, 1, 10), ("m", "big", 0.0, 1, 10), ("m", "mid", None, 1, 10), ("m", "small", 1.0, None, 5000)], TARGETS)
    assert {(r.mix_name, r.source) for r in mix_documents(s, bad).collect()} == {("m", "small")}


def test_short_sources_come_from_the_queue(spark):
    sizes, targets = data(3)
    targets = [*targets, ("nil", "small", 1.0, 0, 100)]
    s, t = frames(spark, [*sizes, (1, "big", 10**6)], targets)
    mixed = mix_documents(s, t)
    report = {(r.mix_name, r.source): r.short for r in mix_report(mixed, s, t).collect()}
    supply = {(r.mix_name, r.source): r.short for r in supply_report(s, t).collect()}
    assert report == supply and {("all", "small"), ("none", "absent"), ("nil", "small")} <= {k for k, v in report.items() if v} != set(report)
    with pytest.raises(Exception, match="queue and supply differ"):
        mix_report(mixed.filter("source <> 'small'"), s, t).collect()


def test_found_runs_the_queue(spark, tmp_path, monkeypatch):
    from plyforge.llm import mixing, queries

    spark.createDataFrame([(i, "forum", "a few words " * (i + 1)) for i in range(5)], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("m", "Forum", 1.0, 2, 10**6)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    calls, run = [], mixing.mix_documents
    monkeypatch.setattr(mixing, "mix_documents", lambda *a, **k: calls.append(1) or run(*a, **k))
    assert [tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect()] == [("m", "Forum")] and calls
