import random
from collections import Counter, defaultdict

from plyforge.llm.bin_packing import pack_histogram, pack_items, packing_report
from plyforge.llm.token_sizes import token_count


def one_by_one(sizes, capacity):
    """Best-two-fit on a plain list of items."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        inside, gap = [], capacity
        for s in list(left):
            if s <= gap:
                inside.append(s)
                left.remove(s)
                gap -= s
        if gap and inside:
            small, best, pair = min(inside), min(inside), None
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    two = left[i] + left[j]
                    if best < two <= gap + small:
                        best, pair = two, (left[i], left[j])
            if pair:
                inside.remove(small)
                for s in pair:
                    inside.append(s)
                    left.remove(s)
                left.append(small)
                left.sort(reverse=True)
        bins.append(inside)
    return bins


def test_runs_equal_one_bin_after_another():
    rng = random.Random(1)
    for trial in range(60):
        capacity = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 90))]
        runs = pack_histogram(Counter(sizes), capacity)
        want = one_by_one(sizes, capacity)
        assert sum(n for n, _ in runs) == len(want)
        total = Counter()
        for n, used in runs:
            assert sum(s * k for s, k in used.items()) <= capacity
            for s, k in used.items():
                total[s] += n * k
        assert total == Counter(sizes)
        filled = sorted(sum(s * k for s, k in used.items()) for n, used in runs for _ in range(n))
        assert filled == sorted(map(sum, want))


def test_every_item_is_packed_once_and_whole(spark):
    rng = random.Random(2)
    rows = [(i if rng.random() < 0.9 else 5, rng.choice([7, 7, 7, rng.randint(1, 130), 300, 200, 100, 0, None, -3]), 1, "x") for i in range(2500)] + [(None, 9, 1, "x")]
    packed = pack_items(spark.createDataFrame(rows, "doc bigint, n int, bin int, piece string"), "doc", "n", 100).collect()
    bins = defaultdict(int)
    for r in packed:
        if r.bin is not None:
            bins[r.bin] += r.tokens
    assert max(bins.values()) <= 100 and set(bins) == set(range(len(bins)))
    whole = Counter((r.doc, r.tokens) for r in packed if r.bin is not None and r.piece == 0 and r.tokens < 100)
    assert all(whole[k] == v for k, v in Counter((d, n) for d, n, *_ in rows if n is not None and 0 < n < 100).items())
    assert sum(r.tokens for r in packed if r.bin is not None) == sum(n for _, n, *_ in rows if n and n > 0)
    assert sum(r.bin is None for r in packed) == sum(n is None or n <= 0 for _, n, *_ in rows)
    pieces = Counter(r.doc for r in packed if r.piece == 2)
    assert sum(pieces.values()) == sum(n == 300 for _, n, *_ in rows)
    report = packing_report(spark.createDataFrame(packed), 100).first()
    assert report.bins == len(bins) and report.bins <= report.least_bins * 1.02 + 1


def test_empty_and_order_do_not_matter(spark):
    df = spark.createDataFrame([(i, i % 50 + 1) for i in range(400)], "doc bigint, n int")
    a, b = sorted(pack_items(df, "doc", "n", 64).collect()), sorted(pack_items(df.repartition(7), "doc", "n", 64).collect())
    assert a == b
    empty = pack_items(df.limit(0), "doc", "n", 64)
    assert empty.count() == 0 and packing_report(empty, 64).first().bins == 0


def test_token_counts_of_odd_texts(spark):
    from pyspark.sql import functions as F

    texts = ["", None, "a", "<|endoftext|>", "x" * 200_000, " " * 50_000, "ñ�🙂" * 100]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t")).alias("n")).collect()]
    assert got[0] == got[1] == 0 and got[2] == 1 and got[3] > 1 and min(got[4:]) > 100
