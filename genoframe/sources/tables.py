"""Pedigrees, regions, chromosome orders, annotation tables, epistasis datasets and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ped(spark: SparkSession, path: str, variable: int | str = 6, unaffected: str = "1", affected: str = "2") -> DataFrame:
    """family_id, sample_id, father_id, mother_id, sex, phenotype, condition (1 unaffected, 2 affected, null otherwise).

    variable: column of the phenotype, by its number from 1 or by its name in a header line that starts with #."""
    if isinstance(variable, str) and not variable.isdigit():
        head = spark.read.text(path).where(F.col("value").startswith("#")).limit(1).collect()
        names = head[0]["value"].lstrip("#").split() if head else []
        if variable not in names:
            raise ValueError(f"no column {variable} in the header of {path}")
        variable = names.index(variable) + 1
    variable = int(variable)
    f = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.try_element_at(f, F.lit(k))
    value = at(variable)
    condition = F.when(value == unaffected, 1).when(value == affected, 2)
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(at(1).alias("family_id"), at(2).alias("sample_id"), at(3).alias("father_id"), at(4).alias("mother_id"), at(5).alias("sex"), value.alias("phenotype"), condition.alias("condition"))


def read_regions(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """GFF (or BED, by its ending; its starts count from 0) as chrom, start_pos, end_pos, type."""
    f = F.split("value", "\t")
    at = lambda k: F.try_element_at(f, F.lit(k))
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    if path.endswith(".bed"):
        out = rows.select(at(1).alias("chrom"), (at(2).cast("long") + 1).alias("start_pos"), at(3).cast("long").alias("end_pos"), at(4).alias("type"))
    else:
        out = rows.select(at(1).alias("chrom"), at(4).cast("long").alias("start_pos"), at(5).cast("long").alias("end_pos"), at(3).alias("type"))
    return out.where(F.col("type") == kind) if kind else out


def read_chrom_order(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, ord) of a file with a name a line."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("ord", "chrom")).where("trim(chrom) <> ''").select(F.trim("chrom").alias("chrom"), "ord")


#: Columns of an annotation file for the command line.
ANNOTATION = "chrom string, pos long, consequence string, so_code int, gene string, snp_id string"


def read_annotation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines or tab-separated rows in place of a remote service."""
    return spark.read.schema(schema).json(path) if path.endswith(".json") else spark.read.schema(schema).csv(path, sep="\t")


def read_epi(spark: SparkSession, path: str) -> DataFrame:
    """(variant_idx, sample_idx, code, affected) of a binary dataset: counts of variants, cases and controls, then a byte for each variant and sample, cases first; 255 is null."""
    schema = pa.schema([("variant_idx", pa.int64()), ("sample_idx", pa.int64()), ("code", pa.int32()), ("affected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                variants, cases, controls = (int(x) for x in np.frombuffer(raw, "<u4", 3))
                codes = np.frombuffer(raw, np.uint8, variants * (cases + controls), 12).reshape(variants, -1)
                for k, row in enumerate(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(row), pa.int64()), pa.array(range(len(row)), pa.int64()), pa.array([None if x == 255 else int(x) for x in row], pa.int32()), pa.array([j < cases for j in range(len(row))])], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "variant_idx long, sample_idx long, code int, affected boolean")


def epi_bytes(codes: list[list[int | None]], cases: int) -> bytes:
    """The binary form of a small dataset, variants by samples, cases first."""
    body = np.array([[255 if x is None else x for x in row] for row in codes], np.uint8)
    return np.array([len(codes), cases, body.shape[1] - cases], "<u4").tobytes() + body.tobytes()


def write_gwas(result: DataFrame, path: str) -> None:
    """Tab-separated, by chromosome (numbers first) and position."""
    result.orderBy(F.col("chrom").try_cast("int").asc_nulls_last(), "chrom", "pos").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_effects(found: DataFrame, path: str) -> None:
    """JSON by consequence, a summary of counts, and the genes."""
    found.withColumn("part", F.col("consequence")).write.mode("overwrite").partitionBy("part").json(f"{path}/effects")
    found.groupBy(F.lower("consequence").alias("consequence")).count().write.mode("overwrite").csv(f"{path}/summary", sep="\t")
    found.select(F.lower("gene").alias("gene")).distinct().write.mode("overwrite").csv(f"{path}/genes")


def write_stats(stats: DataFrame, path: str, chunk: int = 1_000_000) -> None:
    """Statistics as Parquet by chromosome and chunk of positions, so that a region reads few files."""
    stats.withColumn("chunk", F.floor(F.col("pos") / chunk)).repartition("chrom", "chunk").write.mode("overwrite").partitionBy("chrom", "chunk").parquet(path)
