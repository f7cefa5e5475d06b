"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to).  Words flow from patterns to
sources: a pattern gives its size once at cost 0, a second time at cost 1 and so on (convex, so a first reading always
comes before a repetition), and a source takes its target.  The patterns' flows are then turned into copies of
documents in a seeded order.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Steps of the seeded order that are summed as one before single documents are looked at.
STEPS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null has none."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return words.cast("long")


def source_targets(sizes: dict, weights: dict, share: float, most: float, words: int | None = None) -> dict:
    """Targets of ``share`` times all ``words`` by weight, each at most ``most`` times its source's size.

    ``words`` is the sum of the sizes, unless sources overlap.

    What exceeds that is shared again by weight among the others until none exceeds.
    """
    left, out = share * (sum(sizes.values()) if words is None else words), {}
    rest = [s for s in sizes if weights[s] > 0]
    while rest:
        total = sum(weights[s] for s in rest)
        full = [s for s in rest if left * weights[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weights[s] / total for s in rest}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        rest = [s for s in rest if s not in out]
    return {s: out.get(s, 0.0) for s in sizes}


class Flow:
    """Successive shortest paths (Bellman-Ford with a queue) on a small network with whole capacities."""

    def __init__(self):
        self.to, self.cap, self.cost, self.out = [], [], [], defaultdict(list)

    def edge(self, a, b, cap: int, cost: int) -> int:
        for x, y, c, k in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(k)
        return len(self.to) - 2

    def run(self, start, end) -> None:
        while True:
            best, via, queue, queued = {start: 0}, {}, [start], {start}
            for x in queue:
                queued.discard(x)
                for e in self.out[x]:
                    if self.cap[e] > 0 and best[x] + self.cost[e] < best.get(self.to[e], 1 << 60):
                        best[self.to[e]], via[self.to[e]] = best[x] + self.cost[e], e
                        if self.to[e] not in queued:
                            queue.append(self.to[e])
                            queued.add(self.to[e])
            if end not in via:
                return
            path, x = [], end
            while x != start:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            amount = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= amount
                self.cap[e ^ 1] += amount


def route(sizes: dict[tuple, int], targets: dict, copies: int) -> dict[tuple, dict]:
    """Words of each pattern that each of its sources takes, with the least repetition.

    Patterns that share no source, even through others, are separate networks and solved one by one.
    """
    group = {s: s for p in sizes for s in p}

    def find(s):
        while group[s] != s:
            group[s] = group[group[s]]
            s = group[s]
        return s

    for pattern in sizes:
        for s in pattern[1:]:
            group[find(s)] = find(pattern[0])
    parts = defaultdict(list)
    for pattern in sizes:
        if pattern:
            parts[find(pattern[0])].append(pattern)
    out: dict[tuple, dict] = {p: {} for p in sizes}
    for patterns in parts.values():
        flow, taken = Flow(), {}
        for p in patterns:
            for k in range(copies):
                flow.edge("start", ("pattern", p), sizes[p], k)
            for s in p:
                taken[p, s] = flow.edge(("pattern", p), ("source", s), copies * sizes[p], 0)
        for s in {s for p in patterns for s in p}:
            flow.edge(("source", s), "end", round(targets[s]), 0)
        flow.run("start", "end")
        for (p, s), e in taken.items():
            out[p][s] = flow.cap[e ^ 1]
    return out


#: Patterns whose table is sent to every task; a larger one is joined by a shuffle.
SENT = 100_000


def _sent(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= SENT else table


def _step(steps: int) -> Column:
    """The slice of the seeded order that a row lies in by its ``draw``."""
    return F.pmod(F.shiftright("draw", 20), F.lit(steps))


def borders(sized: DataFrame, flows: list[tuple], copies: int, steps: int = STEPS) -> list[tuple]:
    """(pattern, rounds, step, left) for every pattern: all its documents are read ``rounds`` times, those of the slices before
    ``step`` once more, and ``left`` words of that slice.

    ``flows``: (pattern, flow, total).  The driver gets one row per pattern, as many as ``flows`` has.
    """
    spark = sized.sparkSession
    kind = "pattern array<struct<none boolean, name string>>, rounds long, goal long"
    rounds = [(p, min(copies, flow // total) if total else 0, flow, total) for p, flow, total in flows]
    goals = spark.createDataFrame([(p, q, flow - q * total) for p, q, flow, total in rounds], kind)
    sums = sized.groupBy("pattern", _step(steps).alias("step")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    reached = sums.withColumn("upto", upto).join(_sent(goals, len(rounds)), "pattern").filter(F.col("upto") > F.col("goal"))
    first = reached.groupBy("pattern").agg(F.min_by(F.struct("step", (F.col("goal") - F.col("upto") + F.col("words")).alias("left")), "step").alias("b")).collect()
    at = {tuple((s["none"], s["name"]) for s in r["pattern"]): (r["b"]["step"], r["b"]["left"]) for r in first}
    # Without a slice that goes beyond the goal, all of them are read once more.
    return [(p, q, *at.get(tuple(map(tuple, p)), (steps, 0))) for p, q, _, _ in rounds]


def seeded_takes(sized: DataFrame, plan: DataFrame, patterns: int, whole_only: bool, size: Column, steps: int = STEPS) -> DataFrame:
    """``sized`` (id, pattern, draw, ...) with ``size``, the columns of ``plan`` (pattern, rounds, at, left, ...) and ``taken``.

    Sums over ``steps`` slices of the seeded order found the slice where the last reading ends (:func:`borders`).  All other
    rows are decided on the spot, without a shuffle; only that slice, one in ``steps``, is ordered document by document, so
    a pattern that holds most rows is spread over all tasks.  The document at the end is taken in part, or, with
    ``whole_only``, whole if at least half of it is wanted.  ``plan`` has a row for each of the ``patterns``; it is sent to
    every task only if these are few.
    """
    rows = sized.withColumn("_step", _step(steps)).join(_sent(plan, patterns), "pattern")
    order = Window.partitionBy("pattern").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("left") - (F.sum("size").over(order) - F.col("size"))
    if whole_only:
        part = F.when((F.col("_left") > 0) & (2 * F.col("_left") >= F.col("size")), F.col("size")).otherwise(0)
    else:
        part = F.greatest(F.lit(0), F.least(F.col("_left"), F.col("size")))
    border = rows.filter(F.col("_step") == F.col("at")).withColumn("size", size).withColumn("_left", left).withColumn("more", part).drop("_left")
    most = rows.filter(F.col("_step") != F.col("at")).withColumn("size", size).withColumn("more", F.when(F.col("_step") < F.col("at"), F.col("size")).otherwise(0))
    return most.unionByName(border).withColumn("taken", (F.col("rounds") * F.col("size") + F.col("more")).cast("long"))


def mix(
    docs: DataFrame, members: Column, weights, share: float, most: int, whole_only: bool = False, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False
) -> DataFrame:
    """``id_col, sources, size, source_size, target, taken``: how many words of each document the mix takes; with
    ``whole_rows`` instead ``row, size, taken``, where ``row`` is a struct of all columns of ``docs``.

    ``members``: the array of sources of a document (a null in it is a source of its own; no source: takes 0).
    ``weights``: a function from the list of sources, by code point and null last, to their weights.  ``source_size``
    and ``target`` are sums over the document's sources.  The driver holds one number per pattern and per source,
    never a document.  No document gives more than ``most`` times its size; null and empty texts, of size 0, give 0;
    texts are counted whole, however long, and not shuffled (but for one slice in 4,096 with ``whole_rows``); repeated
    rows are documents of their own, ties in the seeded order go by id and size; a null id is drawn like any other;
    columns named like those made here don't matter; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sources = F.array_sort(F.array_distinct(F.transform(members, lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))))
    draw = F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col))
    wide = docs.select(F.col(id_col).cast("long").alias("id"), sources.alias("pattern"), draw.alias("draw"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    sized = scratch.save(wide.select("id", "pattern", "draw", word_count(F.col("text")).alias("size")))
    sizes = {tuple((s["none"], s["name"]) for s in r["pattern"]): r["n"] for r in sized.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    each: dict = defaultdict(int)
    for pattern, n in sizes.items():
        for s in pattern:
            each[s] += n
    names = sorted(each)  # Python compares strings by code point
    targets = source_targets({s: each[s] for s in names}, dict(zip(names, weights([None if none else name for none, name in names]))), share, most, sum(n for p, n in sizes.items() if p))
    flows = route(sizes, targets, most)
    plan = borders(sized, [([*p], sum(flows[p].values()), n) for p, n in sizes.items()], most)
    kind = "pattern array<struct<none boolean, name string>>, rounds long, at long, left long, target double, source_size long"
    table = [(p, *at, float(sum(targets[tuple(s)] for s in p)), sum(each[tuple(s)] for s in p)) for p, *at in plan]
    plan_table = spark.createDataFrame(table, kind)
    if whole_rows:  # words are counted once more, which is cheaper than to carry texts through a shuffle
        return seeded_takes(wide, plan_table, len(table), whole_only, word_count(F.col("text"))).select("row", "size", "taken")
    taken = seeded_takes(sized, plan_table, len(table), whole_only, F.col("size"))
    named = F.transform("pattern", lambda s: F.when(~s["none"], s["name"]))
    return taken.select(F.col("id").alias(id_col), named.alias("sources"), "size", "source_size", "target", "taken")


def cycle(pattern: list[float]):
    """Weights that repeat ``pattern`` along the sources."""
    return lambda names: [pattern[i % len(pattern)] for i in range(len(names))]
