"""Token files: documents as token ids in ORC, in ascending doc_id order.

Ids are ORC integers, so stripes run-length encode them; doc_id carries row indexes and a Bloom
filter, by which readers skip stripes and row groups, and stripes are read in parallel. A row also
holds the place of the document within its file (part and local_start), so that global starts
need only one total a file.
"""

from __future__ import annotations

import json
import os
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, scratch_dir, shuffle_partitions, small, text_of

END_ID = 1
#: Words whose ids a Python worker remembers.
MEMO_WORDS = 1_000_000
SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
_STATE: dict[str, WordEncoder] = {}
#: How byte-level files write the pattern that makes pieces of a text, if white space is never part of one.
APART = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def words_are_apart(spec: dict) -> bool:
    """Whether the ids of a text are those of its words, one after the other: white space must end every piece and leave no id.

    That is so if the normaliser only composes characters, makes white space one space and lowers
    letters, and the pre-tokeniser removes all but pieces without white space.
    """
    steps = spec["normalizer"]["normalizers"] if (spec.get("normalizer") or {}).get("type") == "Sequence" else [spec.get("normalizer")]
    plain = all(s is None or s["type"] in ("NFC", "Lowercase") or s == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for s in steps)
    cuts = spec["pre_tokenizer"]["pretokenizers"] if (spec.get("pre_tokenizer") or {}).get("type") == "Sequence" else [spec.get("pre_tokenizer")]
    first = cuts[0] or {}
    split = first.get("type") == "Split" and first["pattern"].get("Regex") in APART and first["behavior"] == "Removed" and first["invert"]
    later = all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
    return plain and split and later and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")


class WordEncoder:
    """Encodes texts with a tokenizer; where its words are apart, every distinct word goes through the tokenizer (small letters of ASCII: its model) once and its ids are remembered.

    Words are cut at the six white space characters of ASCII, which all patterns take for white
    space. Texts with a special token's letters, which the tokenizer seeks across words, are encoded
    whole, and so is every text of a tokenizer whose words are not apart.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart, self.model = words_are_apart(spec), self.tokenizer.model
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.memo: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not self.apart or any(t in text for t in self.special):
            return self.whole(text)
        for space in _SPACES:
            if space in text:
                text = text.replace(space, " ")
        words, memo = text.split(" "), self.memo
        try:
            return b"".join(map(memo.__getitem__, words))
        except KeyError:
            pass
        if len(memo) > MEMO_WORDS:
            memo.clear()
        missing = {w: _stem(w) for w in set(words).difference(memo)}
        new = {part for parts in missing.values() for part in parts}.difference(memo)
        letters = [part for part in new if part.isascii() and part.isalpha()]
        for part in letters:  # small letters of ASCII are one piece, and stand for themselves in the model
            memo[part] = array("I", [t.id for t in self.model.tokenize(part)]).tobytes()
        others = list(new.difference(letters))
        for part, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            memo[part] = array("I", found.ids).tobytes()
        for word, parts in missing.items():
            memo[word] = b"".join([memo[part] for part in parts])
        return b"".join(map(memo.__getitem__, words))


def _stem(word: str) -> tuple[str, ...]:
    """Letters and the marks after them are two pieces for the tokenizer, and capitals become small: such words share their ids."""
    stem = word.rstrip(_MARKS)
    if not stem.isalpha():
        return (word,)
    if stem.isascii():
        stem = stem.lower()
    elif not (lower := unicodedata.normalize("NFC", stem).lower()).isalpha():  # a letter that becomes a letter and a mark joins the marks after it
        return (word,)
    elif max(stem) < _STABLE and "\u03a3" not in stem:  # a capital sigma depends on its place here, not there
        stem = lower
    return (stem, word[len(stem) :]) if len(stem) < len(word) else (stem,)


#: Marks of ASCII but the apostrophe, which may begin a piece of letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Before it stand alphabets whose capitals have been the same for long.
_STABLE = "\u0530"
#: White space of ASCII besides the space.
_SPACES = "\n\t\r\x0b\x0c"


def encoder(path: str) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _STATE:
        _STATE[path] = WordEncoder(path)
    return _STATE[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, start = encoder(path), np.array([end_id], dtype="<u4").tobytes(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                blobs = [enc.encode(t) + end for t in batch.column(2).to_pylist()]
                n = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                ids = np.frombuffer(b"".join(blobs), dtype="<i4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(start + offsets[:-1]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Write the ids of every text of docs (columns doc_id, text), an end id after each, as ORC files in ascending doc_id order.

    A null text counts as empty and has the end id only. Rows without doc_id come first; rows that
    share one stand together in the order of their texts. Other columns are left out. The files
    are ranges of doc_id; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), "text")
    encoded = rows.mapInArrow(_encode(tokenizer_path, end_id), SCHEMA)
    (
        encoded.write.option("orc.compress", "ZSTD")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(16 << 20))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; doc_ids (a short list) is pushed down to file, stripe and row-group metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows.filter(F.col("doc_id").isin(doc_ids)) if doc_ids is not None else rows


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(3)], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
        )


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files, one row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    stored = read_tokens(spark, path)
    totals = stored.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    rows = stored.select("doc_id", "part", "local_start", "ids").mapInArrow(_checksum, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    joined = rows.join(small(materialize(totals, "totals")), "part")
    return joined.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write docs as token files (in shared storage unless a path is given) and digest what reads back: doc_id, start, n_tokens, ids_crc32.

    One row per row of docs, repeated rows and those without doc_id or text included (see
    write_tokens); an empty table gives none. Other columns are left out.
    """
    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(docs, path, tokenizer_path)
    return token_digests(spark, path)
