"""Operator 9, MinHash near-dedup with sequential Bayesian verification of banded candidates.

Documents of one word sequence form a class at once (hash of the whole sequence); class representatives go through
neardup.links: bands, posterior pruning in batches of minima, exact check on full shingle sets. A document's
component is the least doc_id that can be reached over links.

Null and empty texts have no shingles and stay by themselves; texts under five words are one shingle; repeated rows
give a row each, in one component; rows with a null doc_id take part, and their component_id is null only if no row with an id is in reach; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common, neardup


def sequence_hash(words: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, doc_id, text: equal rows have equal keys."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("row_key"), "doc_id", "text")


def classes(rows: DataFrame, hashes: int) -> DataFrame:
    """row_key, doc_id, same (hash of the lower-cased word sequence; null without words), n_shingles, sig."""
    common.small_batches(rows.sparkSession)
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("same", pa.binary()), ("n_shingles", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [neardup.words_of(x) for x in common.raw_texts(b.column("text"))]
            h, ends = neardup.hashes_of(words)
            some = np.flatnonzero(np.diff(ends, prepend=0))
            rows, starts = neardup.shingle_rows(h, ends[some - 1] * (some > 0), ends[some])
            n, sig = np.zeros(len(words), np.int64), [b""] * len(words)
            for k, own, low in zip(some.tolist(), np.split(rows, starts[1:]), neardup.signatures(rows, starts, hashes), strict=True) if len(some) else ():
                n[k], sig[k] = len(np.unique(own)), low.tobytes()
            yield common.batch(schema, row_key=b.column("row_key"), doc_id=b.column("doc_id"), same=[sequence_hash(x) for x in words], n_shingles=n, sig=sig)

    return rows.mapInArrow(run, "row_key long, doc_id long, same binary, n_shingles long, sig binary")


def _labelled(rows: DataFrame, percent: int) -> DataFrame:
    """row_key, doc_id, same, n_shingles, label (null without words) of every row: the component of its word sequence."""
    bands, size = neardup.tuned(percent)
    hashes = -(-bands * size // neardup.BATCH) * neardup.BATCH
    all_ = common.stored(classes(rows, hashes), "classes")

    def bodies(wanted: DataFrame) -> DataFrame:
        one = all_.withColumnRenamed("same", "id").join(wanted, "id").groupBy("id").agg(F.min("row_key").alias("row_key"))
        return rows.join(one.hint("merge"), "row_key").select("id", "text")

    label = neardup.links(all_.where("same is not null").select(F.col("same").alias("id"), "sig"), bodies, percent, bands, size, lambda: neardup.jaccard_at_least(percent))
    return all_.drop("sig").join(label, F.col("same") == F.col("id"), "left").withColumn("label", F.coalesce("label", "same")).drop("id")


def without_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that with the least (doc_id, nulls last; hash of the text), once. Rows without words stay, repeated ones too."""
    own = keyed(docs)
    rows = common.stored(_labelled(own, percent).where("same is not null").groupBy("row_key", "doc_id", "label").agg((F.count("*") > 1).alias("many")), "copies")
    stays = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("stays"))
    marks = rows.join(stays, "label").select("row_key", (F.col("row_key") != F.col("stays.row_key")).alias("gone"), "many").where("gone or many")
    key = F.expr("xxhash64(cast(d.doc_id as long), xxhash64(d.text)) = m.row_key")
    left = docs.alias("d").join(marks.hint("merge").alias("m"), key, "left").where("not coalesce(m.gone, false)")
    once = left.where("m.many is not null").select("d.*").dropDuplicates(["doc_id", "text"])
    return left.where("m.many is null").select("d.*").unionByName(once)


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document, for links at a Jaccard similarity of percent / 100 or more."""
    found = common.stored(_labelled(keyed(docs, key, text), percent), "labelled")
    least = found.where("same is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.join(least, "label", "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"), percent=85)
