"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

Rows are dealt by a hash of doc_id, or in runs of a given order such as a source mix, into packing
groups of bounded size, each packed by one task step. Within a group, pieces go longest first into
the tightest open bin that has room and no conflict: every bin carries a bitmap of the sources and
one of the duplicate clusters it holds, and the search walks the bins in order of residual space
until one is compatible. Only lengths, sources and clusters are moved, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_are_keys, materialize, text_of
from .mixing import ranked
from .quality import words_of

#: Tokens (words) of a sequence, expected rows of a packing group, and how often one source may occur in a bin.
CAPACITY, GROUP_ROWS = 2048, 1500
PIECES = "doc_id long, piece long, start long, length long, bin_id string, bin_offset long, bin_fill long, rank long"


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item. Items come longest first (ties as given); of bins with equal room the oldest is taken.

    Sources and clusters are small integers; no two items of a bin share a source or a cluster
    (a negative number conflicts with nothing).
    """
    placed: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending: the successor of a length is the tightest bin
    held: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        own = (1 << sources[i] if sources[i] >= 0 else 0, 1 << clusters[i] if clusters[i] >= 0 else 0)
        at = bisect_left(rooms, (lengths[i], -1))
        while at < len(rooms) and (held[rooms[at][1]][0] & own[0] or held[rooms[at][1]][1] & own[1]):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        placed[i] = (b, capacity - room)
        held[b][0] |= own[0]
        held[b][1] |= own[1]
        if room > lengths[i]:
            insort(rooms, (room - lengths[i], b))
    return placed


def _codes(values: pd.Series) -> list[int]:
    return pd.factorize(values)[0].tolist()  # nulls are -1


def _pack(capacity: int, by_source: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id", "length", "cluster"], kind="stable").reset_index(drop=True)
        sources = _codes(pdf["source"]) if by_source else [-1] * len(pdf)
        clusters = _codes(pdf["cluster"])
        placed = best_fit(pdf["length"].tolist(), sources, clusters, capacity)
        bins = pd.Series([b for b, _ in placed], dtype="int64")
        fill = pdf["length"].groupby(bins).transform("sum")
        name = pdf["grp"].astype(str) + "-" + bins.astype(str)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "bin_id": name, "bin_offset": [o for _, o in placed], "bin_fill": fill, "rank": pdf["rank"]})

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, by_source: bool = True, group_rows: int = GROUP_ROWS, order: list[str] | None = None, cluster: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start (first word), length, bin_id, bin_offset, bin_fill.

    A text's length is its number of words; one longer than the capacity is cut into full pieces,
    each a bin of its own, and a rest that is packed. Texts without words (null, empty, blank) have
    one piece of length 0 in no bin (bin_id null). Two pieces of one bin never come from the same
    source (unless by_source is off) or from documents of one duplicate cluster: those with equal
    texts, or with equal values of the column that cluster names; nulls conflict with nothing.
    Repeated rows have equal texts and so are kept apart. With order, documents that
    follow each other in it are packed together, and the column rank tells a document's place in
    it. Other columns are ignored.
    """
    words = F.size(words_of(text_of())).cast("long")
    same = F.xxhash64(text_of()) if cluster is None else F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", same.alias("cluster"), words.alias("n"), *[F.col(c).alias(f"__order{i}") for i, c in enumerate(order or [])])
    if order:
        keys = [f"__order{i}" for i in range(len(order))]
        rows = ranked(rows, [], [*keys, "doc_id", "cluster"]).drop(*keys)
        grp = F.expr(f"rank div {group_rows}")
    else:
        # the lengths are read several times; rows that share an id are told apart by their place, so that they are dealt as well
        rows = materialize(rows.select("*", F.monotonically_increasing_id().alias("at"), F.lit(0).cast("long").alias("rank")), "lengths")
        key = ["doc_id"] if ids_are_keys(rows) else ["doc_id", "at"]
        grp = F.pmod(F.xxhash64(*key), F.lit(max(1, -(-rows.count() // group_rows))))
    rows = rows.withColumn("grp", grp)
    rest = F.col("n") % capacity
    cut = F.col("n") - rest
    whole = F.when(F.col("n") >= capacity, F.transform(F.sequence(F.lit(1), F.expr(f"n div {capacity}")), lambda i: i - 1)).otherwise(F.array().cast("array<bigint>"))
    full = rows.filter(F.col("n") >= capacity).select("doc_id", F.explode(whole).alias("piece"), "cluster", "source", "rank")
    full = full.select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
        F.concat(F.lit("full-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("-"), F.monotonically_increasing_id()).alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"), F.lit(capacity).cast("long").alias("bin_fill"), "rank",
    )
    blank = rows.filter("n = 0").select(
        "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"),
        F.lit(None).cast("string").alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"), F.lit(0).cast("long").alias("bin_fill"), "rank",
    )
    loose = rows.filter(rest > 0).select("doc_id", F.expr(f"n div {capacity}").alias("piece"), cut.alias("start"), rest.alias("length"), "source", "cluster", "rank", "grp")
    none = F.lit(-(1 << 63))  # stands for a missing doc_id: pandas has no nullable long by default
    loose = loose.withColumn("doc_id", F.coalesce("doc_id", none))
    packed = loose.groupBy("grp").applyInPandas(_pack(capacity, by_source), PIECES)
    packed = packed.withColumn("doc_id", F.nullif("doc_id", none))
    out = packed.unionByName(full).unionByName(blank)
    return out if order else out.drop("rank")


def packed_sequences(docs: DataFrame, **options) -> DataFrame:
    """One row per bin: bin_id, fill, n_pieces, doc_ids, pieces (doc_id, piece, start, length) in bin order; texts without words are left out.

    With the option order there is also place, the place in that order of the bin's first document.
    """
    pieces = pack_documents(docs, **options).filter("bin_id IS NOT NULL")
    place = [F.min("rank").alias("place")] if "rank" in pieces.columns else []
    item = F.struct("bin_offset", "doc_id", "piece", "start", "length")
    bins = pieces.groupBy("bin_id").agg(F.max("bin_fill").alias("fill"), F.array_sort(F.collect_list(item)).alias("items"), *place)
    return bins.select(
        "bin_id", "fill", F.size("items").alias("n_pieces"), F.transform("items", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("items", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["start"].alias("start"), x["length"].alias("length"))).alias("pieces"),
        *(["place"] if place else []),
    )
