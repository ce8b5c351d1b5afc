"""Exact Jaccard self-join on word shingles by a token-group matrix, with components of the links.

Documents with equal shingle sets form a class, and only classes are compared. Similar classes are
first put into groups: bands of min-hashes propose (leader, member) pairs, which are checked on
the texts. The matrix has, for each shingle, the groups with a member of which it is one of the
n - ceil(t n) + 1 rarest: a class that links to a member shares one of these, so it meets no other
group. The token union of every group that is met is stored, and a class's overlap with a member
is at most its overlap with that union: unless this reaches t n, the group stays closed. In open
groups the class is compared with the members it shares a rare shingle with. A group of one class
is its own union, so bound and comparison are one. Shingles are known by 64-bit hashes of at least
five words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_are_keys, materialize, release, shuffle_partitions, text_of
from .components import connected_components
from .mixing import ranked
from .words import mix, pack, shingles, slices, unpack


@dataclass(frozen=True)
class Settings:
    size: int = 5
    percent: int = 80
    #: Min-hash bands and rows of each, for the proposals of groups only.
    bands: int = 6
    rows: int = 2
    #: Shingles of more documents than this count as frequent and come last in the order; at most max_frequent of them, the most frequent, are known to tasks.
    frequent: int = 12
    max_frequent: int = 500_000
    #: Frequencies are counted in the lowest part of the hash space, of the share counted + spread / sqrt(shingles) of a
    #: document: that is where its rarest shingles are found (the order of shingles affects speed only).
    counted: float = 0.4
    spread: float = 3.0
    #: Lists of up to so many classes are paired at once; longer ones are first reduced to one row a group.
    short_list: int = 32
    #: Classes of a long list that are compared at once.
    block: int = 1024
    #: Classes that are held against a group's union at once.
    asked: int = 256
    #: Bits of the bounded filter of wanted identifiers.
    filter_bits: int = 1 << 26

    def shards(self, partitions: int) -> int:
        return 4 * partitions


TOKEN_SHIFT = np.uint64(20)  # frequencies and lists know shingles by their upper 44 bits
SKETCH = "rid long, doc_id long, th long, n long, cls long, bands array<long>, shard int, blob binary"


def _identified(docs: DataFrame) -> DataFrame:
    """rid stands for doc_id; rows without one get a negative number made from their text. As doc_ids may repeat, th, a hash of the text, tells their rows apart."""
    missing = -F.pmod(F.xxhash64(text_of()), F.lit(1 << 62)) - 1
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), missing).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("th"))


def set_hash(tokens: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles."""
    total = np.add.reduce(mix(tokens ^ np.uint64(0xA5A5A5A5DEADBEEF)), keepdims=True)
    return int(mix(total + np.array([len(tokens)], dtype=np.uint64)).view(np.int64)[0])


def _texts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column(batch.schema.get_field_index("text"))
    for first, end, words, at in slices(column):
        for i in range(end - first):
            yield first + i, shingles(words[at[i] : at[i + 1]], size)


def _prefix(n: int, percent: int) -> int:
    """How many of n shingles must be looked at: n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def _cut(tokens: np.ndarray, shards: int) -> np.ndarray:
    """Ends of the shards' shares of sorted tokens; shards split the hash space evenly."""
    edges = (np.arange(1, shards, dtype=np.float64) / shards * 2.0**64).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


def _sketch(s: Settings, shards: int):
    """Per document its size, class and bands; per shard the shingles of all documents in the counted share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = s.bands * s.rows
        factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
        held, count = [], 0

        def counts() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            cut = _cut(tokens, shards)
            at = [i for i in range(shards) if cut[i + 1] > cut[i]]
            none = pa.nulls(len(at), pa.int64())
            blobs = [pack(tokens[cut[i] : cut[i + 1]] >> TOKEN_SHIFT, delta=True) for i in at]
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, none, pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at, pa.int32()), pa.array(blobs, pa.binary())],
                names=["rid", "doc_id", "th", "n", "cls", "bands", "shard", "blob"],
            )

        for batch in batches:
            rows = batch.num_rows
            n, cls = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            bands: list = [None] * rows
            for i, tokens in _texts(batch, s.size):
                n[i] = len(tokens)
                if not len(tokens):
                    continue
                cls[i] = set_hash(tokens)
                least = np.array([(tokens * f).min() for f in factors], dtype=np.uint64).reshape(s.bands, s.rows)
                key = np.arange(s.bands, dtype=np.uint64)
                for r in range(s.rows):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + least[:, r])
                bands[i] = key.view(np.int64)
                share = s.counted + s.spread / len(tokens) ** 0.5
                low = tokens if share >= 1 else tokens[: np.searchsorted(tokens, np.uint64(int(share * 2.0**64)))]
                held.append(low)
                count += len(low)
                if count > 3_000_000:
                    yield counts()
                    held, count = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(n), pa.array(cls), pa.array(bands, pa.list_(pa.int64())), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=["rid", "doc_id", "th", "n", "cls", "bands", "shard", "blob"],
            )
        if count:
            yield counts()

    return run


def _frequent(sketch: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(shingles by their upper bits, sorted; their document counts): the max_frequent most frequent at most."""
    least = s.frequent

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([unpack(b, np.uint64, delta=True) for b in pdf["blob"]])
        found, times = np.unique(tokens, return_counts=True)
        keep = times > least
        return pd.DataFrame({"token": found[keep].astype(np.int64), "df": times[keep].astype(np.int64)})

    counted = sketch.filter("shard IS NOT NULL").select("shard", "blob").groupBy("shard").applyInPandas(count, "token long, df long")
    counted = materialize(counted, "frequent")
    # the smallest limit that leaves few enough, from the sizes of count classes
    scale = F.floor(F.log2(F.col("df")) * 8)
    sizes = counted.groupBy(scale.alias("c")).count().orderBy(F.desc("c")).collect()  # at most a few hundred classes
    limit, total = None, 0
    for row in sizes:
        total += row["count"]
        if total > s.max_frequent:
            break
        limit = row["c"]
    if limit is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counted.filter(scale >= limit).toPandas()
    order = np.argsort(top["token"].to_numpy())
    return top["token"].to_numpy().astype(np.uint64)[order], top["df"].to_numpy()[order]


def _lists(s: Settings, shards: int, known):
    """Per shard the (shingle, class, size) of every class's rarest shingles; equal classes of a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, df = known.value
        seen_bits = np.zeros(1 << 22, dtype=bool)
        shift = np.uint64(64 - 22)
        seen_bits[((frequent << TOKEN_SHIFT) >> shift).astype(np.int64)] = True
        held: list[tuple[np.ndarray, int, int]] = []
        count, seen = 0, set()

        def rarest(tokens: np.ndarray) -> np.ndarray:
            p = _prefix(len(tokens), s.percent)
            part = tokens[: 2 * p + 16]
            for part in (part, tokens):
                rank = np.zeros(len(part), np.int64)
                maybe = np.flatnonzero(seen_bits[(part >> shift).astype(np.int64)])
                if len(maybe):
                    short = part[maybe] >> TOKEN_SHIFT
                    at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
                    rank[maybe] = np.where(frequent[at] == short, df[at], 0)
                light = np.flatnonzero(rank == 0)
                if len(light) >= p or len(part) == len(tokens):
                    break
            if len(light) >= p:
                return part[light[:p]]
            heavy = np.flatnonzero(rank)
            heavy = heavy[np.lexsort((part[heavy], rank[heavy]))]
            return part[np.concatenate([light, heavy])[:p]]

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            lengths = np.array([len(h[0]) for h in held])
            cls = np.repeat(np.array([h[1] for h in held], np.int64), lengths)
            n = np.repeat(np.array([h[2] for h in held], np.uint32), lengths)
            rank = (np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint32)
            order = np.argsort(tokens, kind="stable")
            tokens, cls, n, rank = tokens[order], cls[order], n[order], rank[order]
            cut = _cut(tokens, shards)
            at = [i for i in range(shards) if cut[i + 1] > cut[i]]
            part = [slice(cut[i], cut[i + 1]) for i in at]
            return pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([pack(tokens[p] >> TOKEN_SHIFT, delta=True) for p in part], pa.binary()), pa.array([pack(cls[p]) for p in part], pa.binary()), pa.array([pack(n[p]) for p in part], pa.binary()), pa.array([pack(rank[p]) for p in part], pa.binary())],
                names=["shard", "tokens", "classes", "sizes", "ranks"],
            )

        for batch in batches:
            for _, tokens in _texts(batch, s.size):
                if not len(tokens):
                    continue
                cls = set_hash(tokens)
                if cls in seen:
                    continue
                seen.add(cls)
                if len(seen) > 1_000_000:
                    seen.clear()
                first = rarest(tokens)
                held.append((first, cls, len(tokens)))
                count += len(first)
                if count > 3_000_000:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def _pairs(s: Settings):
    """Within a shard: pairs of classes (a < b) that share a rare shingle, and the rows of long lists for later."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([unpack(b, np.uint64, delta=True) for b in pdf["tokens"]])
        cls = np.concatenate([unpack(b, np.int64) for b in pdf["classes"]])
        n = np.concatenate([unpack(b, np.uint32) for b in pdf["sizes"]]).astype(np.int64)
        rank = np.concatenate([unpack(b, np.uint32) for b in pdf["ranks"]]).astype(np.int64)
        order = np.lexsort((cls, tokens))
        tokens, cls, n, rank = tokens[order], cls[order], n[order], rank[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1])
        tokens, cls, n, rank = tokens[new], cls[new], n[new], rank[new]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        length = np.diff(np.append(start, len(tokens)))
        found = []
        for size in np.unique(length[(length > 1) & (length <= s.short_list)]):
            runs = start[length == size]
            left, right = np.triu_indices(size, 1)
            i, j = (runs[:, None] + left).ravel(), (runs[:, None] + right).ravel()
            # of the overlap that a link needs, none may lie before the first shared shingle
            need = -(-(n[i] + n[j]) * s.percent // (100 + s.percent))
            fits = (rank[i] <= n[i] - need) & (rank[j] <= n[j] - need)
            found.append(np.stack([cls[i[fits]], cls[j[fits]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        late = np.repeat(length > s.short_list, length)
        some, none = late.sum(), len(pairs)
        column = lambda head, tail: pd.arrays.IntegerArray(  # noqa: E731  None stands for nulls
            np.concatenate([np.zeros(none, np.int64) if head is None else head, np.zeros(some, np.int64) if tail is None else tail]),
            np.repeat([head is None, tail is None], [none, some]),
        )
        return pd.DataFrame(
            {
                "a": column(pairs[:, 0], cls[late]),
                "b": column(pairs[:, 1], None),
                "token": column(None, tokens[late].astype(np.int64)),
                "n": column(None, n[late]),
                "rank": column(None, rank[late]),
            }
        )

    return run


def _wanted(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of fixed size that has every id of ids (a superset passes): one bit by hash for each."""
    bit = F.pmod(F.xxhash64("rid"), F.lit(bits))
    words = ids.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rid), {bits}) % 64 as int))")).alias("mask"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.mapInArrow(_packed, "words binary, masks binary").collect():  # at most bits / 64 of them, packed
        out[unpack(row["words"], np.int64)] = unpack(row["masks"], np.int64)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            blobs = [pa.array([pack(batch.column(i).to_numpy(zero_copy_only=False))], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(blobs, names=["words", "masks"])


def _select(known, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = known.value.view(np.uint8)
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (mask[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            keep = pa.array(hit.astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1, 3)], names=["rid", "text", "th"])

    return run


def _compare(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
            column = batch.column(batch.schema.get_field_index(name)).dictionary_encode()
            table = pa.RecordBatch.from_arrays([column.dictionary], names=["text"])
            each = [t for _, t in _texts(table, s.size)]
            return [each[i] for i in column.indices.to_pylist()]

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                linked = []
                for x, y, a, b in zip(sets(batch, "text_a"), sets(batch, "text_b"), batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    # hashes of texts may meet: only the text of the class counts
                    if set_hash(x) == a and set_hash(y) == b:
                        inter = len(np.intersect1d(x, y, assume_unique=True))
                        linked.append(100 * inter >= s.percent * (len(x) + len(y) - inter))
                    else:
                        linked.append(False)
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of classes whose texts reach the threshold."""
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    texts = _texts_of(ends, classes, docs, s)
    joined = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    out = materialize(joined.select("a", "b", "text_a", "text_b").mapInArrow(_compare(s), "a long, b long"), "links")
    release(texts)
    return out


def _texts_of(ends: DataFrame, classes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """(cls, text) of the classes in ends, one row each: the text of one row, however many rows have its doc_id or repeat it."""
    spark = docs.sparkSession
    ends = materialize(ends.join(classes.select("cls", "rid", "th"), "cls"), "ends")
    known = spark.sparkContext.broadcast(_wanted(ends, s.filter_bits))
    texts = docs.select("rid", "text", F.pmod(F.xxhash64("rid"), F.lit(s.filter_bits)).alias("bit"), "th").mapInArrow(_select(known, s.filter_bits), "rid long, text string, th long")
    texts = texts.groupBy("rid", "th").agg(F.first("text").alias("text"))
    out = materialize(ends.join(texts, ["rid", "th"]).select("cls", "text"), "texts")
    release(ends)
    return out


def _unions(s: Settings):
    """(grp, tokens) of a task's texts (grp, cls, text): one union a group, written out when they grow large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        count = 0

        def flush() -> pa.RecordBatch:
            blobs = [pack(np.unique(np.concatenate(t)), delta=True) for t in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(blobs, pa.binary())], names=["grp", "tokens"])

        for batch in batches:
            grp, cls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, tokens in _texts(batch, s.size):
                if set_hash(tokens) == cls[i]:
                    held.setdefault(grp[i], []).append(tokens)
                    count += len(tokens)
                    if len(held[grp[i]]) > 64:
                        held[grp[i]] = [np.unique(np.concatenate(held[grp[i]]))]
            if count > 4_000_000:
                yield flush()
                held, count = {}, 0
        if held:
            yield flush()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    tokens = np.unique(np.concatenate([unpack(b, np.uint64, delta=True) for b in pdf["tokens"]]))
    return pd.DataFrame({"grp": pdf["grp"][:1], "tokens": [pack(tokens, delta=True)]})


def _bounded(s: Settings):
    """Of classes (cls, grp, text) those whose overlap with the group's union reaches the threshold of their size."""

    def run(asked: pd.DataFrame, unions: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(unions):
            return asked[["cls", "grp"]].head(0)
        union = unpack(unions["tokens"].iloc[0], np.uint64, delta=True)
        keep = np.zeros(len(asked), bool)
        cls = asked["cls"].tolist()
        for i, tokens in _texts(pa.RecordBatch.from_pydict({"text": asked["text"].tolist()}), s.size):
            if set_hash(tokens) == cls[i]:
                keep[i] = 100 * len(np.intersect1d(tokens, union, assume_unique=True)) >= s.percent * len(tokens)
        return asked.loc[keep, ["cls", "grp"]]

    return run


def _opened(pairs: DataFrame, groups: DataFrame, classes: DataFrame, docs: DataFrame, s: Settings) -> DataFrame:
    """Of pairs (a, b) of classes in different groups (ga, gb, null for a group of one) those in which neither class's overlap with the other's group is too small for a link."""
    asked = pairs.filter("gb IS NOT NULL").select(F.col("a").alias("cls"), F.col("gb").alias("grp"))
    asked = asked.unionByName(pairs.filter("ga IS NOT NULL").select(F.col("b").alias("cls"), F.col("ga").alias("grp")))
    asked = materialize(asked.distinct(), "asked")
    members = groups.select(F.col("label").alias("grp"), F.col("node").alias("cls")).join(asked.select("grp").distinct(), "grp")
    texts = _texts_of(members.select("cls").unionByName(asked.select("cls")).distinct(), classes, docs, s)
    parts = members.join(texts, "cls").select("grp", "cls", "text").mapInArrow(_unions(s), "grp long, tokens binary")
    unions = materialize(parts.groupBy("grp").applyInPandas(_merge, "grp long, tokens binary"), "unions", compression="none")
    # a union meets the classes that ask for it in parts of bounded size
    counts = materialize(asked.groupBy("grp").agg(F.expr(f"(count(1) + {s.asked - 1}) div {s.asked}").alias("parts")), "parts")
    dealt = asked.join(counts, "grp").join(texts, "cls").select("cls", "grp", "text", F.pmod(F.xxhash64("cls"), F.col("parts")).alias("part"))
    copies = unions.join(counts, "grp").select("grp", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = dealt.groupBy("grp", "part").cogroup(copies.groupBy("grp", "part"))
    opened = materialize(met.applyInPandas(_bounded(s), "cls long, grp long"), "qualifying")
    release(texts, unions, asked, counts)
    first = opened.select(F.col("cls").alias("a"), F.col("grp").alias("gb"), F.lit(True).alias("fits_a"))
    second = opened.select(F.col("cls").alias("b"), F.col("grp").alias("ga"), F.lit(True).alias("fits_b"))
    marked = pairs.join(first, ["a", "gb"], "left").join(second, ["b", "ga"], "left")
    out = materialize(marked.filter("(gb IS NULL OR fits_a) AND (ga IS NULL OR fits_b)").select("a", "b"), "open-pairs")
    release(opened)
    return out


def _within(s: Settings):
    """Links between the groups of one block of a list: intersections of all its classes from the shingles that two of them share; of the links found, as many as join the groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # hashes of texts may meet: the text of the class is found below
        pdf = pdf.drop_duplicates(["cls", "text"])
        sets, cls, grp, held = [], [], [], set()
        for (_, tokens), c, g in zip(_texts(pa.RecordBatch.from_pydict({"text": pdf["text"].tolist()}), s.size), pdf["cls"].tolist(), pdf["grp"].tolist(), strict=True):
            if set_hash(tokens) == c and c not in held:
                held.add(c)
                sets.append(tokens)
                cls.append(c)
                grp.append(g)
        n = np.array([len(t) for t in sets], dtype=np.int64)
        shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
        if sets:
            _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            column = np.cumsum(times > 1) - 1
            owner, keep = np.repeat(np.arange(len(sets)), n), times[place] > 1
            owner, place = owner[keep], column[place[keep]]
            order = np.argsort(place, kind="stable")
            owner, place = owner[order], place[order]
            for first in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
                lo, hi = np.searchsorted(place, [first, first + 4096])
                part = np.zeros((len(sets), 4096), dtype=np.float32)
                part[owner[lo:hi], place[lo:hi] - first] = 1
                shared += part @ part.T
        linked = np.triu(100 * shared >= s.percent * (n[:, None] + n[None, :] - shared), 1)
        root = {g: g for g in grp}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = find(grp[i]), find(grp[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((cls[i], cls[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _early(n: str, rank: str, m: str, other: str, s: Settings) -> Column:
    """Whether a shingle at these ranks of sets of n and m can be the first of as many shared ones as a link needs."""
    need = F.expr(f"(({n} + {m}) * {s.percent} + {99 + s.percent}) div {100 + s.percent}")
    return (F.col(rank) <= F.col(n) - need) & (F.col(other) <= F.col(m) - need)


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with grp, the group of their class (the class itself if it has no links)."""
    found = rows.join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    return found.select("token", "cls", "n", "rank", F.coalesce("label", "cls").alias("grp"))


def _compatible(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id that links reach. A null or empty text, or one without
    words, has no shingles and is its own component; fewer words than a shingle form one shingle.
    Rows without doc_id take part and link others, but never name a component: theirs is null if
    no row of it has a doc_id. Repeated rows are alike. Other columns are ignored.
    """
    s, spark = settings or Settings(), docs.sparkSession
    docs = _identified(docs)
    shards = s.shards(shuffle_partitions(spark))
    sketch = materialize(docs.mapInArrow(_sketch(s, shards), SKETCH), "sketch")
    rows = sketch.filter("shard IS NULL").select("rid", "doc_id", "th", "n", "cls", "bands")
    classes = rows.filter("n > 0").groupBy("cls").agg(F.min(F.struct("rid", "th")).alias("r"), F.first("n").alias("n"))
    classes = materialize(classes.select("cls", "r.rid", "r.th", "n"), "classes")

    # groups: leaders of min-hash bands
    banded = rows.filter("n > 0").select("cls", "n", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min(F.struct("cls", "n")).alias("lead"), F.max("cls").alias("most"))
    leaders = materialize(leaders.filter("lead.cls < most").select("band", F.col("lead.cls").alias("a"), F.col("lead.n").alias("m")), "leaders")
    proposed = banded.join(leaders, "band").filter((F.col("cls") > F.col("a")) & _compatible(F.col("n"), F.col("m"), s.percent))
    proposed = materialize(proposed.select("a", F.col("cls").alias("b")).distinct(), "proposed")
    links = _linked(proposed, classes, docs, s)
    release(leaders, proposed)
    groups = materialize(connected_components(links), "groups")

    # token-group matrix on the rarest shingles
    known = spark.sparkContext.broadcast(_frequent(sketch, s))
    lists = docs.select("text").mapInArrow(_lists(s, shards, known), "shard int, tokens binary, classes binary, sizes binary, ranks binary")
    found = materialize(lists.groupBy("shard").applyInPandas(_pairs(s), "a long, b long, token long, n long, rank long"), "found")
    late = found.filter("token IS NOT NULL").select("token", F.col("a").alias("cls"), "n", "rank")

    # long lists: first against the class whose rank is least, the most central of a family of near copies
    late = materialize(_grouped(late, groups), "long-lists")
    heads = late.groupBy("token").agg(F.min(F.struct("rank", "cls", "n", "grp")).alias("h"), F.max("grp").alias("hi"), F.min("grp").alias("lo"))
    heads = materialize(heads.filter("lo < hi").select("token", "h"), "heads")
    apart = late.join(heads, "token").filter((F.col("grp") != F.col("h.grp")) & _early("n", "rank", "h.n", "h.rank", s))
    central = apart.select(F.least("cls", "h.cls").alias("a"), F.greatest("cls", "h.cls").alias("b"))
    pairs = found.filter("b IS NOT NULL").select("a", "b").unionByName(central).distinct()
    named = lambda end: groups.select(F.col("node").alias(end), F.col("label").alias(f"g{end}"))
    pairs = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    pairs = materialize(pairs.filter(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b", "ga", "gb"), "pairs")
    release(found, heads)
    opened = _opened(pairs, groups, classes, docs, s)
    more = _linked(opened, classes, docs, s)
    release(pairs, opened, groups)
    links = links.unionByName(more)
    groups = materialize(connected_components(links), "groups")

    # what long lists still hold of different groups is compared list by list, in blocks of bounded size
    regrouped = materialize(_grouped(late.drop("grp"), groups), "long-lists")
    matrix = regrouped.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo < hi").select("token", "many")
    rows_left = regrouped.join(materialize(matrix, "matrix"), "token").filter(F.col("rank") <= F.col("n") - F.expr(f"(n * {s.percent} + 99) div 100"))
    blocks = F.expr(f"(many + {s.block - 1}) div {s.block}")
    own = F.pmod(F.xxhash64("cls"), blocks)
    cells = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y"))))
    rows_left = materialize(rows_left.select("token", "cls", "n", "rank", "grp", cells.alias("cell")), "left")
    release(late, regrouped, groups)
    if rows_left.limit(1).count():
        texts = _texts_of(rows_left.select("cls").distinct(), classes, docs, s)
        members = rows_left.join(texts, "cls").select("token", "cell", "cls", "grp", "text")
        within = materialize(members.groupBy("token", "cell").applyInPandas(_within(s), "a long, b long"), "within")
        release(texts)
        links = links.unionByName(within)
    release(rows_left)

    labels = materialize(connected_components(links), "labels")
    placed = rows.select("doc_id", "n", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    placed = materialize(placed.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "cls")).alias("label")), "placed")
    release(sketch, classes, labels)
    heads = materialize(placed.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "heads")
    out = placed.join(heads, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs with one document of each component, the smallest doc_id; columns as they were.

    Where doc_ids repeat or are missing, rows are told apart by doc_id and text: rows alike in both
    are one document, and a document without doc_id stays only where its component has no doc_id.
    Of documents that share the smallest doc_id of a component, or of a component without any, the
    one with the least digest stays.
    """
    if ids_are_keys(docs):
        verdicts = materialize(near_components(docs, settings), "near")
        return docs.join(verdicts.filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.sha2(text_of(), 256).alias("__digest")]
    marked = docs.select("*", *key).dropDuplicates(["__id", "__digest"])
    # number the documents in the order in which a component prefers them, and let the numbers be the ids
    order = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("doc_id")]
    numbers = ranked(marked.select(*order, "__id", "__digest"), [], ["none", "doc_id", "__digest"])
    marked = materialize(marked.join(numbers.select("__id", "__digest", F.col("rank").alias("__number")), ["__id", "__digest"]), "numbered")
    verdicts = materialize(near_components(marked.select(F.col("__number").alias("doc_id"), "text"), settings), "near")
    stay = verdicts.filter("doc_id = component_id").select(F.col("doc_id").alias("__number"))
    return marked.join(stay, "__number", "left_semi").select(*docs.columns)
