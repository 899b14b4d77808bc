"""Samples with target shares of categories, by min-cost flow on cell counts.

Records are counted in cells (category x stratum).  In the network, category
arcs carry the targets and floors, cell arcs the availability, and stratum arcs
the second margin (for the queries, the recorded split); slack arcs, dearer than any other path, take what the cells
cannot supply, so the flow on them is the shortfall.  Only counts reach the
driver: categories of the targets times strata, whatever the number of records.
"""

from __future__ import annotations

import heapq
import random
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.operators.ordering import bottom_k, salted_hash


@dataclass
class Network:
    """Successive shortest paths with potentials; integer capacities and costs."""

    to: list[int] = field(default_factory=list)
    cap: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=dict)
    names: dict[object, int] = field(default_factory=dict)

    def node(self, name: object) -> int:
        if name not in self.names:
            self.names[name] = len(self.names)
            self.out[self.names[name]] = []
        return self.names[name]

    def arc(self, a: object, b: object, cap: int, cost: int) -> int:
        a, b = self.node(a), self.node(b)
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.cap[arc + 1]

    def push(self, source: object, sink: object, amount: int) -> int:
        """Sends up to ``amount`` at least cost; costs must not be negative.  Returns what went."""
        s, t, sent = self.node(source), self.node(sink), 0
        potential = [0] * len(self.names)
        while sent < amount:
            best, via, queue = {s: 0}, {}, [(0, s)]
            while queue:
                far, a = heapq.heappop(queue)
                if far > best[a]:
                    continue
                for e in self.out[a]:
                    if self.cap[e]:
                        new = far + self.cost[e] + potential[a] - potential[self.to[e]]
                        if new < best.get(self.to[e], 1 << 62):
                            best[self.to[e]], via[self.to[e]] = new, e
                            heapq.heappush(queue, (new, self.to[e]))
            if t not in best:
                break
            top = max(best.values())
            for v in range(len(potential)):
                potential[v] += best.get(v, top)
            step, v = amount - sent, t
            while v != s:
                step, v = min(step, self.cap[via[v]]), self.to[via[v] ^ 1]
            v = t
            while v != s:
                self.cap[via[v]] -= step
                self.cap[via[v] ^ 1] += step
                v = self.to[via[v] ^ 1]
            sent += step
        return sent


@dataclass(frozen=True)
class Target:
    category: str
    share: Fraction
    floor: int


def needed(target: Target, size: int) -> int:
    """The greater of the floor and share * size rounded up."""
    return max(target.floor, -(-target.share.numerator * size // target.share.denominator))


def shortfalls(cells: Mapping[tuple[str, object], int], targets: Sequence[Target], size: int) -> dict[str, int]:
    """Flow on the slack arcs: what each category lacks of its need."""
    net, slack = Network(), {}
    for t in targets:
        need = needed(t, size)
        net.arc(("category", t.category), "sink", need, 0)
        slack[t.category] = net.arc("source", ("category", t.category), need, 1000)
    for (category, stratum), n in cells.items():
        if category in slack:
            net.arc("source", ("cell", category, stratum), n, 0)
            net.arc(("cell", category, stratum), ("category", category), n, 0)
    net.push("source", "sink", sum(needed(t, size) for t in targets))
    return {c: net.flow(e) for c, e in slack.items()}


def rounded(parts: Mapping[object, Fraction], rng: random.Random) -> dict[object, int]:
    """Each part rounded up with the odds of its fraction, and the sums of any first parts too, by one random start."""
    upto, out = Fraction(rng.randrange(1 << 30), 1 << 30), {}
    for key, part in parts.items():
        out[key] = int(upto + part) - int(upto)
        upto += part
    return out


def spread(amount: int, rooms: Mapping[str, int], weights: Mapping[str, Fraction], rng: random.Random) -> dict[str, int]:
    """``amount`` dealt by weight to those with room, what one cannot take to the others; by room if no weight is left."""
    out, left = dict.fromkeys(rooms, 0), min(amount, sum(rooms.values()))
    while left:
        open_ = {c: weights.get(c, Fraction(0)) for c in sorted(rooms) if out[c] < rooms[c]}
        if not any(open_.values()):
            open_ = {c: Fraction(rooms[c] - out[c]) for c in open_}
        whole = sum(open_.values())
        for c, part in rounded({c: left * w / whole for c, w in open_.items()}, rng).items():
            out[c] = min(rooms[c], out[c] + part)
        left = min(amount, sum(rooms.values())) - sum(out.values())
    return out


Cell = tuple[tuple[str, ...], object]


def _goals(supply: Mapping[tuple[str, ...], int], targets: Sequence[Target], size: int, rng: random.Random) -> dict[str, int]:
    """What each category gives, by a flow from the targets to the records that say one or more categories."""

    def flow(surplus: Mapping[str, int] | None) -> dict[str, int]:
        net, given = Network(), {}
        for t in targets:
            exact = t.share * size
            floor, whole, node = min(t.floor, size), int(exact), ("category", t.category)
            arcs = [(floor, 0), (max(0, whole - floor), 10_000), (int(exact != whole and whole >= floor), 20_000 + int(1000 * (1 - (exact - whole))))]
            if surplus is not None:
                arcs += [(surplus.get(t.category, 0), 100_000), (size, 200_000)]
            given[t.category] = [net.arc("source", node, cap, cost) for cap, cost in arcs]
        for said, n in sorted(supply.items()):
            net.arc(("cell", said), "sink", n, 0)
            for c in said:
                if c in given:
                    net.arc(("category", c), ("cell", said), n, 0)
        net.push("source", "sink", size)
        return {c: sum(net.flow(e) for e in arcs) for c, arcs in given.items()}

    first = flow(None)
    rooms = {c: max(0, sum(n for said, n in supply.items() if c in said) - got) for c, got in first.items()}
    missing = size - sum(first.values())
    return flow(spread(missing, rooms, {t.category: t.share for t in targets}, rng)) if missing > 0 else first


def cell_quotas(cells: Mapping[Cell, int], targets: Sequence[Target], size: int, seed: str) -> dict[tuple[tuple[str, ...], object, str], int]:
    """Integer quotas (categories of the cell, stratum, category it serves) of a sample of ``size`` records.

    A cell holds the records that say the same categories and have the same
    stratum; one that says several may serve any of them, each record once.  A
    first flow fixes what each category gives.  Dear to miss, in this order:
    floors, then target shares (whole parts, then one more by the size of the
    fraction), then the surplus: what categories cannot supply is spread over
    the others by their shares, as far as they have records.
    A second flow divides that over the cells.  A cell's part is proportional
    to its records among those of the category, a stratum's margin the sum of
    its cells' parts; each is rounded up or down at random with the odds of its
    fraction, and so that parts still add up.  Dear to miss there, in this
    order: margins within one record, cells within one record, then the drawn
    roundings.
    """
    rng = random.Random(seed)
    ordered = sorted(cells.items(), key=lambda x: (x[0][0], str(x[0][1])))
    supply: dict[tuple[str, ...], int] = {}
    for (said, _), n in ordered:
        supply[said] = supply.get(said, 0) + n
    goals = _goals(supply, targets, size, rng)
    of = {c: [(cell, n) for cell, n in ordered if c in cell[0]] for c in goals}
    parts = {c: {cell: Fraction(goal * n, sum(m for _, m in of[c])) for cell, n in of[c]} for c, goal in goals.items() if goal}
    margins: dict[object, Fraction] = {}
    for by_cell in parts.values():
        for (_, s), part in by_cell.items():
            margins[s] = margins.get(s, Fraction(0)) + part
    net, arcs = Network(), {}
    for c, by_cell in parts.items():
        net.arc("source", ("category", c), goals[c], 0)
        for cell, up in rounded(by_cell, rng).items():
            n, top = cells[cell], -(-by_cell[cell].numerator // by_cell[cell].denominator)
            arcs[c, cell] = [net.arc(("category", c), ("cell", cell), cap, cost) for cap, cost in ((up, 0), (top - up, 1 + rng.randrange(100)), (max(0, n - top), 100_000))]
    for (said, s), n in ordered:
        if ("cell", (said, s)) in net.names:
            net.arc(("cell", (said, s)), ("stratum", s), n, 0)
    for s, up in rounded(margins, rng).items():
        top = -(-margins[s].numerator // margins[s].denominator)
        for cap, cost in ((up, 0), (top - up, 1000), (sum(goals.values()), 10_000_000)):
            net.arc(("stratum", s), "sink", cap, cost)
    net.push("source", "sink", sum(goals.values()))
    return {(*cell, c): sum(net.flow(e) for e in es) for (c, cell), es in arcs.items()}


def quotas(cells: Mapping[tuple[str, object], int], targets: Sequence[Target], size: int, seed: str) -> dict[tuple[str, object], int]:
    """``cell_quotas`` where every record says one category: (category, stratum) to its quota."""
    got = cell_quotas({((c,), s): n for (c, s), n in cells.items()}, targets, size, seed)
    named = {t.category for t in targets}
    return {(c, s): got.get(((c,), s, c), 0) for c, s in cells if c in named}


def plan_sample(cells: Mapping[tuple[str, object], int], targets: Sequence[Target], size: int, seed: str) -> tuple[dict[str, int], dict[tuple[str, object], int]]:
    """(shortfall of each category, quota of each cell)."""
    return shortfalls(cells, targets, size), quotas(cells, targets, size, seed)


# ---- on tables ---------------------------------------------------------------------


def phase_name(column: Column) -> Column:
    """opening, middlegame or endgame out of the ways a phase is spelled; else null."""
    text = F.regexp_replace(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), r"[\s_-]+", "")
    return F.when(text.isin("opening", "openings", "op"), "opening").when(text.isin("middlegame", "middle", "mid", "mg"), "middlegame").when(text.isin("endgame", "ending", "end", "eg"), "endgame")


def band_name(column: Column) -> Column:
    """``low-high`` or ``low+`` out of the ways a band is spelled; else null."""
    text = F.lower(F.regexp_replace(column, r"\s+", ""))
    low, high = F.regexp_extract(text, r"^(\d+)(?:-|–|—|_|to)(\d+)$", 1), F.regexp_extract(text, r"^(\d+)(?:-|–|—|_|to)(\d+)$", 2)
    opened = F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d+)(?:\+|plus)$", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"^(?:≥|>=)(\d+)$", 1), F.lit("")))
    return F.when(low != "", F.concat_ws("-", low, high)).when(opened.isNotNull(), F.concat(opened, F.lit("+")))


def category_records(df: DataFrame, keys: Sequence[str], category: Column, stratum: Column | None = None) -> DataFrame:
    """(record, category, stratum): the distinct categories that the rows of a record say; records with a null key are none.

    A record has one stratum, the smallest that any of its rows says; "" if none says any.
    """
    rows = df.select(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("record"), category.alias("category"), (stratum if stratum is not None else F.lit(None)).cast("string").alias("stratum"), *keys).dropna(subset=list(keys))
    # a row a record, with the few categories it says
    one = rows.groupBy("record").agg(F.collect_set("category").alias("said"), F.coalesce(F.min("stratum"), F.lit("")).alias("stratum"))
    return one.select("record", F.explode("said").alias("category"), "stratum")


def read_targets(sample_targets: DataFrame) -> dict[str, dict]:
    """{sample: {table, field, size, targets}}; the table of targets is small by nature (a row a category).

    Rows without sample or category are ignored; a missing share or floor is 0.
    """
    out: dict[str, dict] = {}
    for r in sorted(sample_targets.collect(), key=lambda r: (str(r.sample_name), str(r.category))):
        if r.sample_name is None or r.category is None:
            continue
        x = out.setdefault(r.sample_name, {"table": r.base_table, "field": r.category_field, "size": r.sample_size or 0, "targets": []})
        x["targets"].append(Target(r.category, Fraction(repr(round(r.target_share or 0.0, 9))), int(r.min_records or 0)))
    return out


def count_cells(records: DataFrame, stratum: str | None = None) -> dict[tuple[str, object], int]:
    """Distinct records of each (category, stratum)."""
    by = ["category"] + ([stratum] if stratum else [])
    return {(r.category, r[stratum] if stratum else None): r.n for r in records.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}


def target_report(tables: Mapping[str, DataFrame], sample_targets: DataFrame) -> DataFrame:
    """(sample_name, category, needed, available, shortfall) of every target row.

    ``tables`` maps a base table to its (record, category, stratum) rows.
    """
    spark = sample_targets.sparkSession
    cells = {name: count_cells(df, "stratum") for name, df in tables.items()}
    rows = []
    for sample, x in read_targets(sample_targets).items():
        have = cells.get(x["table"], {})
        short = shortfalls(have, x["targets"], x["size"])
        whole = Counter()
        for (category, _), n in have.items():
            whole[category] += n
        rows += [(sample, t.category, needed(t, x["size"]), whole[t.category], short[t.category]) for t in x["targets"]]
    return spark.createDataFrame(rows, "sample_name string, category string, needed bigint, available bigint, shortfall bigint")


_SEPARATOR = "\u0001"


def draw_samples(tables: Mapping[str, DataFrame], sample_targets: DataFrame, *, salt: str = "draw1") -> DataFrame:
    """(sample_name, category, stratum, record): the records drawn for every sample.

    A record that says several categories may be drawn for any of them, once a
    sample.  Of each cell the quota's records with the smallest salted hash are
    taken, by hash buckets, so no task holds a category; where a cell serves
    several categories they take theirs in that order.  A null or unknown
    category is never drawn.
    """
    spark = sample_targets.sparkSession
    plans = read_targets(sample_targets)
    drawn = None
    for name, df in sorted(tables.items()):
        mine = {s: x for s, x in plans.items() if x["table"] == name}
        if not mine:
            continue
        # a row a record, with the few categories it says
        single = df.groupBy("record").agg(F.array_join(F.array_sort(F.collect_set("category")), _SEPARATOR).alias("said"), F.min("stratum").alias("stratum"))
        cells = {(tuple(r.said.split(_SEPARATOR)), r.stratum): r.n for r in single.groupBy("said", "stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
        by_cell: dict[tuple, list[tuple[str, int]]] = {}
        for s, x in mine.items():
            for (said, stratum, c), q in sorted(cell_quotas(cells, x["targets"], x["size"], f"{salt}:{s}").items(), key=lambda x: (x[0][0], str(x[0][1]), x[0][2])):
                if q:
                    ends = by_cell.setdefault((s, _SEPARATOR.join(said), stratum), [])
                    ends.append((c, (ends[-1][1] if ends else 0) + q))
        # a row a sample and cell
        quota = spark.createDataFrame([(*k, ends, ends[-1][1]) for k, ends in by_cell.items()], "sample_name string, said string, stratum string, ends array<struct<category string, upto bigint>>, quota bigint")
        wanted = single.join(F.broadcast(quota), (single.said == quota.said) & single.stratum.eqNullSafe(quota.stratum)).select("sample_name", single.said, single.stratum, "record", "ends", "quota").withColumn("h", salted_hash(salt, F.col("sample_name"), F.col("record")))
        part = bottom_k(wanted, ["sample_name", "said", "stratum"], "h", F.col("quota"), ["record"], rank="place")
        served = F.get(F.filter("ends", lambda e: e["upto"] >= F.col("place")), F.lit(0))
        part = part.withColumn("serves", served).select("sample_name", F.col("serves.category").alias("category"), "stratum", "record")
        drawn = part if drawn is None else drawn.unionByName(part)
    return drawn if drawn is not None else spark.createDataFrame([], "sample_name string, category string, stratum string, record string")


def draw_report(drawn: DataFrame, sample_targets: DataFrame) -> DataFrame:
    """(sample_name, category, needed, drawn, shortfall) of every target row, from the records that were drawn."""
    spark = sample_targets.sparkSession
    rows = [(s, t.category, needed(t, x["size"])) for s, x in read_targets(sample_targets).items() for t in x["targets"]]
    want = spark.createDataFrame(rows, "sample_name string, category string, needed bigint")
    got = drawn.groupBy("sample_name", "category").agg(F.count(F.lit(1)).alias("drawn"))
    out = want.join(got, ["sample_name", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return out.withColumn("shortfall", F.greatest(F.lit(0), F.col("needed") - F.col("drawn")))
