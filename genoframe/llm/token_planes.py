"""Operator 3, token ids in binary files: fixed-size id blocks stored as compressed byte planes.

Documents are dealt by ranges of doc_id (ties by a hash of the text; null ids first) and encoded. A chunk holds whole documents, at most
CHUNK_IDS ids unless one document is longer. Its ids are cut into blocks of BLOCK_IDS; each block is
transposed into byte planes (all first bytes, all second bytes, ...), or with bits=True into bit planes, and
each plane is compressed with zstandard on its own. The chunk index holds each plane's end and each
document's length, so a block or a document can be read alone.
Chunks are rows of Parquet files with a binary payload: Spark's writer commits a task's file as a whole, so lost executors
leave no half files, and any store that Spark reaches will do.

The tokenizer sees each distinct segment once: its pre-tokens never span a non-space followed by one space and
a non-space, nor do they look past it, so a text's ids are its segments' ids in a row. A segment of Latin letters and then
marks is two pre-tokens; those go to the library's model as they are, past its pattern. Tokenizers of any other kind
(no byte-level pattern, a normalizer, a post-processor) get whole texts.
Null and empty texts hold the end id alone; repeated rows each get a place of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.llm import common

BLOCK_IDS, CHUNK_IDS, MAX_SEGMENTS = 1 << 16, 1 << 18, 800_000
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters (U+00D7 and U+00F7 between them are signs), then ASCII marks but no apostrophe, which may start a pre-token of its own.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
#: White space of Python, which holds all that Unicode calls so.
BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace()]
CHUNKS = "shard int, chunk long, n_ids long, doc_ids array<long>, doc_lengths array<long>, width int, bits boolean, plane_ends array<long>, payload binary"


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The byte planes of little-endian ids of width bytes, or their bit planes, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if not bits:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(width)]
    return [np.packbits((rows[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    rows = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        x = np.frombuffer(plane, np.uint8)
        if bits:
            rows[:, k // 8] |= np.unpackbits(x, bitorder="little")[:n] << (k % 8)
        else:
            rows[:, k] = x
    return rows.reshape(-1).view("<u4")


def packed(ids: np.ndarray, bits: bool = False, level: int = 3) -> tuple[int, list[int], bytes]:
    """Bytes an id takes, the end of each plane within the payload, and the payload."""
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    press, out, ends, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for k in range(0, len(ids), BLOCK_IDS):
        for plane in to_planes(ids[k : k + BLOCK_IDS], width, bits):
            out.append(press.compress(plane))
            at += len(out[-1])
            ends.append(at)
    return width, ends, b"".join(out)


def unpacked(payload: bytes, ends: list[int], n: int, width: int, bits: bool = False) -> np.ndarray:
    expand, per = zstandard.ZstdDecompressor(), width * (8 if bits else 1)
    starts, out = [0, *ends[:-1]], []
    for block in range(0, len(ends), per):
        planes = [expand.decompress(payload[starts[k] : ends[k]]) for k in range(block, block + per)]
        out.append(from_planes(planes, min(BLOCK_IDS, n - block // per * BLOCK_IDS), width, bits))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class SegmentIds(common.Memo):
    """Ids of a space and a word, keyed by the word, as little-endian bytes of width bytes an id."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(MAX_SEGMENTS)
        self.library = Tokenizer.from_file(path)
        self.model, self.tails = self.library.model, common.Memo(1 << 14)
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.kind, self.code = ("<u2", "H") if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else ("<u4", "I")
        about = json.loads(self.library.to_str())
        cuts = about["pre_tokenizer"] or {}
        self.cuttable = cuts.get("type") == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"] and not about["normalizer"] and not about["post_processor"]
        if self.cuttable:
            (self.space, _), = self.library.pre_tokenizer.pre_tokenize_str(" ")
            self.spelt = {c: self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x250)}

    def ids(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(self.space + (word if word.isascii() else word.translate(self.spelt)))]).tobytes()

    def marks(self, tail: str) -> bytes:
        found = self.tails.get(tail)
        if found is None:
            found = self.ids(tail)
            if len(tail) < 64:
                self.tails.keep(tail, found)
        return found

    def __missing__(self, word: str) -> bytes:
        parts = PLAIN.fullmatch(word)
        if not parts:
            found = self.ids(" " + word)
        elif parts[2]:
            found = self[parts[1]] + self.marks(parts[2])
        else:
            found = self.letters(word)
        if len(word) < 64:
            self.keep(word, found)
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuttable or any(s in text for s in self.specials):
            return self.ids(text)
        if text[0] == " " or text[-1] == " " or any(f"{c} " in text or f" {c}" in text for c in BLANKS if c in text):
            first, *rest = CUT.split(text)
        else:
            first, *rest = text.split(" ")
        return self.ids(first) + b"".join(map(self.__getitem__, rest))


@common.sole
def segment_ids(path: str) -> SegmentIds:
    return SegmentIds(path)


def chunks(docs: DataFrame, tokenizer: str, end_id: int = 0, bits: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of the file format, documents in ascending order within and across shards."""
    spark = docs.sparkSession
    common.small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")  # rows of one doc_id, or of none, are spread over shards too
    ordered = rows.repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text")).withColumn("shard", F.spark_partition_id())
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
    schema = pa.schema(list(zip((c.split()[0] for c in CHUNKS.split(", ")), types, strict=True)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = segment_ids(tokenizer)
        end = np.array([end_id], memo.kind).tobytes()
        held, keys, size, chunk, shard = [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), memo.kind)
            width, ends, payload = packed(ids, bits)
            return common.batch(schema, shard=[shard], chunk=[chunk], n_ids=[len(ids)], doc_ids=[keys], doc_lengths=[[len(x) // len(end) for x in held]], width=[width], bits=[bits], plane_ends=[ends], payload=[payload])

        for b in batches:
            shard = b.column("shard")[0].as_py() if len(b) else shard
            for doc, x in zip(b.column("doc_id").to_pylist(), common.texts(b.column("text")), strict=True):
                ids = memo.encode(x) + end
                if held and size + len(ids) // len(end) > CHUNK_IDS:
                    yield out()
                    held, keys, size, chunk = [], [], 0, chunk + 1
                held.append(ids)
                keys.append(doc)
                size += len(ids) // len(end)
        if held:
            yield out()

    return ordered.mapInArrow(write, CHUNKS)


def documents_of(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the stored chunks.

    A chunk's start is the sum over earlier shards (a table of one row a shard) plus that over earlier chunks of its shard."""
    sizes = files.select("shard", "chunk", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    starts = sizes.withColumn("inner", inner).join(shards, "shard").select("shard", "chunk", (F.col("inner") + F.col("before")).alias("chunk_start"))
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = unpacked(r["payload"], r["plane_ends"], r["n_ids"], r["width"], r["bits"])
                lengths = np.array(r["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                yield common.batch(schema, shard=[r["shard"]] * len(crc), chunk=[r["chunk"]] * len(crc), doc_id=r["doc_ids"], offset=ends - lengths, n_tokens=lengths, ids_crc32=crc)

    read = files.mapInArrow(load, "shard int, chunk long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["shard", "chunk"]).select("doc_id", (F.col("chunk_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return documents_of(common.stored(chunks(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "planes"))
