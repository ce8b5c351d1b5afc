"""Exact deduplication over a log-structured merge index of text digests.

Documents go into memtables; each is flushed as a run of level 0: one entry per digest with the
identifier that stays and the number of rows, sorted by digest within buckets of digests, in
Parquet files with Bloom filters on the digest. Compaction merges runs two by two, level by level:
both sides of a merge are sorted and bucketed alike, so it is a full outer merge join without a
shuffle. Only digests of more than one row are hits; their texts are read again and compared byte
by byte, so equal digests never decide alone. Lookups of single digests push them down to the
sort order and the filters of the files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, scratch_dir, shuffle_partitions, small, text_of

#: Memtables that the documents of one call are dealt to.
MEMTABLES = 4


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of one index live under a folder in shared storage. keep tells which identifier of a digest stays."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: str = "largest", digest: Callable[[Column], Column] = sha256, buckets: int | None = None):
        if keep not in ("largest", "smallest"):
            raise ValueError("keep is 'largest' or 'smallest'")
        self.spark, self.keep, self.digest = spark, keep, digest
        self.path = path or f"{scratch_dir(spark)}/digests-{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = [[]]  # names of runs
        self.entries: list[DataFrame] = []

    def _best(self, doc_id: str, row: str) -> Column:
        """What orders the rows of a digest: the greatest stays. Nulls rank lowest among identifiers, and of equal ones the first row stays."""
        rank = F.col(doc_id) if self.keep == "largest" else -F.col(doc_id)
        return F.struct(F.col(doc_id).isNotNull().alias("known"), rank.alias("rank"), (-F.col(row)).alias("less"), F.col(doc_id).alias("id"), F.col(row).alias("row"))

    def _write(self, run: DataFrame) -> str:
        """The name of a sorted run: digest, best, n, a file for each bucket of digests."""
        name = f"digests_{uuid.uuid4().hex}"
        (
            run.write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}").option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "200000").format("parquet").saveAsTable(name)
        )
        return name

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def flush(self, docs: DataFrame, memtables: int = 1) -> None:
        """Deal docs to memtables and write a run of each; entries (digest, doc_id, row) of all documents are kept beside the runs."""
        serial = len(self.entries)
        rows = docs.select(self.digest(text_of()).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id() + F.lit(serial) * F.lit(1 << 53)).alias("row"))
        rows = rows.withColumn("memtable", F.pmod(F.xxhash64("row"), F.lit(memtables)).cast("int"))
        entries = materialize(rows.sortWithinPartitions("memtable", "digest"), "entries", partition_by=["memtable"])
        self.entries.append(entries)
        for m in range(memtables):
            run = entries.filter(F.col("memtable") == m).groupBy("digest").agg(F.max(self._best("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
            self.levels[0].append(self._write(run.repartition(self.buckets, "digest")))

    def _merge(self, x: str, y: str) -> str:
        """One run of two: both are sorted and in the same buckets, so nothing is shuffled."""
        a, b = self.run(x), self.run(y)
        both = a.select("digest", F.col("best").alias("a"), F.col("n").alias("an")).join(b.select("digest", F.col("best").alias("b"), F.col("n").alias("bn")).hint("merge"), "digest", "full")
        best = F.greatest("a", "b")  # nulls are passed over
        return self._write(both.select("digest", best.alias("best"), (F.coalesce("an", F.lit(0)) + F.coalesce("bn", F.lit(0))).alias("n")))

    def compact(self) -> DataFrame:
        """Merge runs two by two into the next level, until one is left: digest, keep_id, keep_row, group_size."""
        level = 0
        while sum(map(len, self.levels)) > 1:
            runs = self.levels[level]
            if len(self.levels) == level + 1:
                self.levels.append([])
            while len(runs) > 1:
                a, b = runs.pop(0), runs.pop(0)
                self.levels[level + 1].append(self._merge(a, b))
                self._drop(a, b)
            self.levels[level + 1] += runs  # an odd one moves up as it is
            runs.clear()
            level += 1
        (last,) = self.levels[-1]
        # read by its files, not as buckets, so that a join may split a digest of very many rows
        return self.spark.read.schema(self.run(last).schema).parquet(f"{self.path}/{last}").select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))

    def _drop(self, *names: str) -> None:
        """Merged runs leave the catalog, and their files the folder."""
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def close(self) -> None:
        """Take the runs that are left out of the catalog; their files stay, and are read by path."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def delete(self) -> None:
        """Delete the index: its entries and runs."""
        self.close()
        release(*self.entries)
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def all_entries(self) -> DataFrame:
        out = self.entries[0]
        for more in self.entries[1:]:
            out = out.unionByName(more)
        return out.select("digest", "doc_id", "row")

    def find(self, digests: list[bytes]) -> DataFrame:
        """The entries of a few digests in all runs: the files' sort order and Bloom filters tell which parts are read."""
        wanted = F.col("digest").isin(*[F.lit(d) for d in digests])
        found = [self.run(name).filter(wanted) for level in self.levels for name in level]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out.select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def clashing_digests(docs: DataFrame, level1: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that stand for two different texts (none, unless sha-256 collides): the byte check of every hit.

    Only texts of shared digests are shuffled, and of those two a task and digest: the least and the greatest.
    """
    hits = small(level1.filter("group_size > 1").select("digest"))
    texts = docs.select(text_of().alias("text"), digest(text_of()).alias("digest")).join(hits, "digest")
    return texts.groupBy("digest").agg((F.min("text") != F.max("text")).alias("differ")).filter("differ").select("digest")


VERDICT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def exact_dedup(docs: DataFrame, keep: str = "largest", digest: Callable[[Column], Column] = sha256, memtables: int = MEMTABLES, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the
    largest (or smallest) doc_id stays; a null doc_id ranks below all others; of repeated rows with
    that doc_id one stays. Other columns of docs are ignored. An empty table gives an empty result.
    index: an empty one to use, for a caller that deletes it once the result is written.
    """
    index = index or DigestIndex(docs.sparkSession, keep=keep, digest=digest)
    index.flush(docs, memtables)
    level1 = index.compact()
    index.close()
    out = index.all_entries().join(level1, "digest").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "digest")
    clashes = materialize(clashing_digests(docs, level1, digest), "clashes")
    if not clashes.limit(1).count():
        return out.select(*VERDICT)
    return out.join(small(clashes), "digest", "left_anti").select(*VERDICT).unionByName(_by_text(docs, small(clashes), index))


def _by_text(docs: DataFrame, clashes: DataFrame, index: DigestIndex) -> DataFrame:
    """Verdicts of the rows whose digest stands for several texts, by the texts themselves."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), index.digest(text_of()).alias("digest"), F.monotonically_increasing_id().alias("row"))
    texts = materialize(texts.join(clashes, "digest"), "clashing-texts")
    groups = texts.groupBy("text").agg(F.max(index._best("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    joined = texts.select("doc_id", "row", "text").join(materialize(groups, "texts"), "text")
    return joined.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.sha2("text", 256).alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs without the rows whose text another row keeps; columns as they were.

    Rows are told apart by doc_id; of rows that share both text and doc_id one stays. A null text
    counts as empty, a null doc_id as an identifier of its own. An empty table stays empty.
    """
    index = DigestIndex(docs.sparkSession, keep=keep)
    verdicts = materialize(exact_dedup(docs, keep, index=index), "verdicts")
    index.delete()
    ids = verdicts.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("ids")).first()
    if ids["n"] == ids["ids"]:
        return docs.join(verdicts.filter("kept").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    # identifiers repeat or are missing: match on the text's digest as well, and take one row of each match
    marked = docs.withColumns({"__digest": F.sha2(text_of(), 256), "__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))})
    stay = verdicts.filter("kept").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.col("text_sha256").alias("__digest"))
    return marked.join(stay, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select(*docs.columns)
