"""Token files: documents as ids of a public tokenizer, compressed by a
Re-Pair grammar per block.

File format: a Parquet folder (Spark's writer commits only whole, successful
tasks) with one row per block: shard, block, doc_ids (array), lengths
(uint32 each, ids per document), base, rules, rule_lengths, sequence (the
grammar), n_ids, crc32 (of the block's ids).  Shards are ranges of doc_id, so
documents follow one another in ascending doc_id order over shards, blocks
and rows.  All numbers in binary columns are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.bpe import _slices
from cadenza.llm.bpe_core import ChunkCoder
from cadenza.llm.common import bounded_batches, no_cycle_collector, remembers
from cadenza.llm.repair import Grammar, compress

#: Ids after which a block ends (at the end of a document).
BLOCK_IDS = 1 << 20
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8 << 20
#: Words of one generation of a worker's memo.
MEMO_WORDS = 500_000
_SCHEMA = ("shard int, block int, doc_ids array<bigint>, lengths binary, base int, rules binary, "
           "rule_lengths binary, sequence binary, n_ids long, crc32 long")


class _LibraryEncoder:
    """The tokenizers library over parts of texts: parts that start with a space are
    joined and encoded together, for no match crosses into such a part; the
    bytes of the tokens tell where each one ends."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.bytes_of = np.zeros(self.size, dtype=np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)                   # byte-level: one character per byte
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) \
            and not pre.get("add_prefix_space")

    def whole(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, list) else texts.to_pylist()
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, parts: list[str], run: int = 500) -> list[bytes]:
        spaced = [p for p in parts if p[0] == " "]
        done = iter(self._joined([spaced[a:a + run] for a in range(0, len(spaced), run)]))
        other = iter(self.whole([p for p in parts if p[0] != " "]) if len(spaced) < len(parts) else ())
        return [next(done if p[0] == " " else other) for p in parts]

    def _joined(self, runs: list[list[str]]) -> Iterator[bytes]:
        texts = ["".join(part) for part in runs]
        for part, text, ids in zip(runs, texts, self.whole(texts)):
            ends = np.cumsum(self.bytes_of[np.frombuffer(ids, dtype="<u4")])
            wanted = np.cumsum(list(map(len, part)) if text.isascii() else [len(p.encode()) for p in part])
            cut = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[cut], wanted):
                raise ValueError("tokens cross the parts of this tokenizer")
            at = 0
            for c in ((cut + 1) * 4).tolist():
                yield ids[at:c]
                at = c


@lru_cache(maxsize=2)
def _library(path: str) -> tuple[_LibraryEncoder, ChunkCoder]:
    lib = _LibraryEncoder(path)
    return lib, ChunkCoder(lib.parts, MEMO_WORDS)


remembers(_library.cache_clear)


def _pack(shard: int, block: int, ids: list, parts: list[bytes], base: int) -> pa.RecordBatch:
    data = b"".join(parts)
    g = compress(np.frombuffer(data, dtype="<u4"), base)
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
        "doc_ids": pa.array([ids], pa.list_(pa.int64())),
        "lengths": [np.array([len(p) // 4 for p in parts], dtype="<u4").tobytes()],
        "base": pa.array([base], pa.int32()), "rules": [g.rules.astype("<u4").tobytes()],
        "rule_lengths": [g.lengths.astype("<u4").tobytes()], "sequence": [g.sequence.astype("<u4").tobytes()],
        "n_ids": pa.array([len(data) // 4], pa.int64()), "crc32": pa.array([zlib.crc32(data)], pa.int64())})


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write all texts as ids, each document ended by ``end_id``, to the
    folder ``path`` (shared).  A null text is empty (the end id alone); null
    ids come first; rows that share an id follow one another by text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, coder = _library(tokenizer)
        encode = coder.encode if lib.by_chunk else lib.whole
        base, end = max(lib.size, end_id + 1), np.array([end_id], dtype="<u4").tobytes()
        shard, block, ids, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        for b in batches:
            keys, at = b.column("doc_id").to_pylist(), 0
            for texts in _slices(b.column("text"), SLICE_BYTES):
                with no_cycle_collector():
                    encoded = encode(texts)
                for x in encoded:
                    ids.append(keys[at])
                    parts.append(x + end)
                    at += 1
                    size += len(x) // 4 + 1
                    if size >= block_ids:
                        yield _pack(shard, block, ids, parts, base)
                        block, ids, parts, size = block + 1, [], [], 0
        if parts:
            yield _pack(shard, block, ids, parts, base)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SCHEMA).write.parquet(path)


def grammar_of(base: int, rules: bytes, rule_lengths: bytes, sequence: bytes) -> Grammar:
    u4 = lambda x: np.frombuffer(x, dtype="<u4")
    return Grammar(base, u4(rules).reshape(-1, 2), u4(rule_lengths), u4(sequence))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, shard, block, place, before, n_tokens, ids_crc32, ids):
    documents in the files' order; before = ids of the block's documents
    before this one.  A block whose checksum doesn't hold raises."""
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = grammar_of(r["base"], r["rules"], r["rule_lengths"], r["sequence"]).decode().astype("<u4").tobytes()
                if zlib.crc32(ids) != r["crc32"] or len(ids) != 4 * r["n_ids"]:
                    raise ValueError(f"shard {r['shard']}, block {r['block']}: damaged")
                lengths = np.frombuffer(r["lengths"], dtype="<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                n, one = len(lengths), lambda x, n: pa.array(np.full(n, x, dtype=np.int32))
                parts = [ids[4 * (e - k):4 * e] for e, k in zip(ends.tolist(), lengths.tolist())]
                out = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "shard": one(r["shard"], n), "block": one(r["block"], n),
                       "place": pa.array(np.arange(n, dtype=np.int32)), "before": pa.array(ends - lengths), "n_tokens": pa.array(lengths),
                       "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(parts, pa.binary())} if with_ids else {}))

    schema = "doc_id long, shard int, block int, place int, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.schema(_SCHEMA).parquet(path).mapInArrow(run, schema)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): start = ids of all documents
    before.  Running sums go over shards (as many rows as shards), then over
    the blocks of a shard; only these small tables meet."""
    sizes = spark.read.schema(_SCHEMA).parquet(path).select("shard", "block", "n_ids")
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(earlier(W.orderBy("shard"))), F.lit(0)).alias("shard_start"))
    blocks = sizes.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.coalesce(
        F.sum("n_ids").over(earlier(W.partitionBy("shard").orderBy("block"))), F.lit(0))).alias("block_start"))
    return read_token_files(spark, path, with_ids=False).join(blocks, ["shard", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """Random access: for each row (shard, block, start, stop) of ``ranges``
    the ids [start, stop) of that block, decoded from the symbols that cover
    them alone: (shard, block, start, stop, ids binary)."""
    blocks = spark.read.schema(_SCHEMA).parquet(path).select("shard", "block", "base", "rules", "rule_lengths", "sequence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [grammar_of(r["base"], r["rules"], r["rule_lengths"], r["sequence"]).decode(r["start"], r["stop"]).astype("<u4").tobytes()
                   for r in b.to_pylist()]
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in ("shard", "block", "start", "stop")} | {"ids": pa.array(ids, pa.binary())})

    src = ranges.select("shard", "block", F.col("start").cast("long"), F.col("stop").cast("long")).join(blocks, ["shard", "block"])
    return src.mapInArrow(run, "shard int, block int, start long, stop long, ids binary")
