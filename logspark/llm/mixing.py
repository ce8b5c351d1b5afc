"""Mixing sources to target weights by a Pfair schedule.

Each source's documents form blocks. With weights a / D (integers that sum to D), block k of a
source is released at slot floor(k D / a) and due by slot ceil((k + 1) D / a). Earliest deadline
first over released blocks fills every slot on time, so at any slot each source has received its
share to within less than one block. The schedule repeats after D slots: one period, a function of
the weights alone, is laid out once and joined to the blocks by their place in the period.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, small, text_of

#: Slots in a period (the precision of a weight), documents in a block, and sources with blocks of their own besides those with a target: the largest ones; all others share the blocks of one more.
PERIOD, BLOCK_ROWS, OWN_SOURCES = 1000, 4, 20_000
#: Target shares of the production mix; what they leave is shared by all other sources, as their sizes to the power of TEMPERATURE.
TARGETS = {"src0": 0.20, "src1": 0.10, "src2": 0.05}
TEMPERATURE = 0.5
NO_SOURCE, OTHERS = "\x00", "\x01"


def quantise(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Weights as integers of at least 1 that sum to the period, by largest remainders (ties by name)."""
    if not weights:
        return {}
    if min(weights.values()) <= 0:
        raise ValueError("target weights are positive")
    period = max(period, 2 * len(weights))
    total = sum(weights.values())
    exact = {s: w * (period - len(weights)) / total for s, w in weights.items()}
    parts = {s: 1 + int(e) for s, e in exact.items()}
    order = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in order[: period - sum(parts.values())]:
        parts[s] += 1
    return parts


def period_schedule(parts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block in the period, slot, release, deadline) of one period: earliest deadline first, ties by name."""
    d = sum(parts.values())
    release = lambda s, k: k * d // parts[s]
    due = lambda s, k: -(-(k + 1) * d // parts[s])
    waiting = [(0, s, 0) for s in sorted(parts)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(d):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k, slot, release(s, k), due(s, k)))
        if k + 1 < parts[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return out


def source_of() -> Column:
    return F.coalesce(F.col("source"), F.lit(NO_SOURCE))


def source_sizes(docs: DataFrame, own: int = OWN_SOURCES, named: list[str] | None = None) -> dict[str, int]:
    """Documents of each source; those beyond the `own` largest that aren't named together, under OTHERS."""
    sizes = materialize(docs.groupBy(source_of().alias("s")).count(), "sizes")
    is_named = F.col("s").isin(named or [])
    found = {r["s"]: r["count"] for r in sizes.filter(is_named).unionByName(sizes.filter(~is_named).orderBy(F.desc("count"), "s").limit(own)).collect()}
    total = sizes.agg(F.sum("count")).first()[0] or 0
    release(sizes)
    rest = total - sum(found.values())
    return found | ({OTHERS: rest} if rest else {})


def target_weights(sizes: dict[str, int], targets: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> dict[str, float]:
    """A weight for every source: its target, or its part of what the targets leave (equal to 1 where they leave nothing), by size to the power of temperature."""
    named = {s: w for s, w in (targets or {}).items() if s in sizes}
    free = {s: float(n) ** temperature for s, n in sizes.items() if s not in named}
    left = 1.0 - sum(named.values())
    share = (left if named and left > 0 else 1.0) / sum(free.values()) if free else 0.0
    return named | {s: w * share for s, w in free.items()}


def horizon(parts: dict[str, int], sizes: dict[str, int], block_rows: int) -> int:
    """The first slot whose source has no full block left: up to it the mix has its target weights."""
    slots = {(s, k): t for s, k, t, _, _ in period_schedule(parts)}
    full = {s: n // block_rows for s, n in sizes.items()}
    d = sum(parts.values())
    return min((full[s] // parts[s] * d + slots[s, full[s] % parts[s]] for s in parts), default=0)


def ranked(rows: DataFrame, keys: list[str], order: list[str], total: str | None = None) -> DataFrame:
    """rows with rank, the place (from 0) of each among rows of equal keys: a range partitioning, so that no key sits in one task.

    Only the counts of each (partition, key) are gathered to turn places within a partition into ranks.
    total: a column for the number of rows of equal keys. Keys aren't null.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    place = F.monotonically_increasing_id()
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("__part"), place.alias("__at")), "dealt")
    counts = dealt.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    if total:
        counts = counts.withColumn(total, F.sum("__n").over(Window.partitionBy(*keys)))
    counts = counts.drop("__n", "__first")
    joined = dealt.join(small(materialize(counts, "counts")), ["__part", *keys])
    return joined.withColumn("rank", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def mix_plan(
    docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = TEMPERATURE, period: int = PERIOD, block_rows: int = BLOCK_ROWS,
    seed: int = 17, own: int = OWN_SOURCES, tie: Column | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, source, weight (of the period), block, slot, release, deadline, place (in the block), on_target.

    Sorting by (slot, place) gives the mix. All rows stay: once a source has no blocks left its
    slots are empty, and the others keep theirs; on_target tells the rows before the first such
    slot. A null source is a source; sources without a target beyond the `own` largest share blocks. Within a
    source, rows come in an order hashed from doc_id; rows without doc_id, and repeated ones, in
    any, or in that of the column tie, which is then given too. Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    sizes = source_sizes(docs, own, list(targets or {}))
    parts = quantise(target_weights(sizes, targets, temperature), period)
    doc_id = F.col("doc_id").cast("long")
    order = F.conv(F.substring(F.md5(F.concat_ws("/", doc_id.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    ties = [] if tie is None else ["tie"]
    if not parts:
        empty = "doc_id long, source string, weight int, block long, slot long, release long, deadline long, place long, on_target boolean" + ", tie long" * len(ties)
        return spark.createDataFrame([], empty)
    d = sum(parts.values())
    table = spark.createDataFrame([(s, k, t, r, e, parts[s]) for s, k, t, r, e in period_schedule(parts)], "part string, k long, t long, r long, e long, weight int")
    weights = small(spark.createDataFrame(list(parts.items()), "part string, w long"), own + len(targets or {}) + 1)
    rows = docs.select(doc_id.alias("doc_id"), source_of().alias("source"), order.alias("order"), *([] if tie is None else [tie.alias("tie")]))
    if OTHERS in parts:
        rows = rows.join(weights.select(F.col("part").alias("source"), "part"), "source", "left").withColumn("part", F.coalesce("part", F.lit(OTHERS)))
    else:
        rows = rows.withColumn("part", F.col("source"))
    placed = ranked(rows, ["part"], ["order", "doc_id", *ties])
    block = F.expr(f"rank div {block_rows}")
    placed = placed.select("doc_id", "source", "part", *ties, block.alias("block"), (F.col("rank") % block_rows).alias("place")).join(weights, "part")
    placed = placed.withColumns({"k": F.col("block") % F.col("w"), "turn": F.expr("block div w") * d})
    joined = placed.join(small(table, max(PERIOD, period, 2 * (own + len(targets or {})) + 2)), ["part", "k"])
    source, slot = F.when(F.col("source") != NO_SOURCE, F.col("source")), F.col("turn") + F.col("t")
    return joined.select(
        "doc_id", source.alias("source"), "weight", "block", slot.alias("slot"), (F.col("turn") + F.col("r")).alias("release"), (F.col("turn") + F.col("e")).alias("deadline"),
        "place", (slot < horizon(parts, sizes, block_rows)).alias("on_target"), *ties,
    )


def with_spots(docs: DataFrame, **options) -> DataFrame:
    """docs with mix_slot and mix_place: sorting by both gives the mix. Rows that share doc_id and text share a spot."""
    # a text's hash keeps rows of one doc_id (or of none) apart, and the many rows of a missing one out of one task
    digest = F.xxhash64(text_of())
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    spot = F.min(F.struct("slot", "place")).alias("__spot")
    plan = mix_plan(docs, tie=digest, **options)
    plan = materialize(plan.groupBy(name.alias("__id"), F.col("tie").alias("__digest")).agg(spot), "mix")
    marked = docs.withColumns({"__id": name, "__digest": digest})
    found = marked.join(plan, ["__id", "__digest"])
    return found.select(*docs.columns, F.col("__spot.slot").alias("mix_slot"), F.col("__spot.place").alias("mix_place"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the mix, written order included; columns as they were. Nulls and repeated rows as in with_spots; an empty table stays empty."""
    return with_spots(docs, **options).orderBy("mix_slot", "mix_place").select(*docs.columns)
