"""VCF text as DataFrames, and back. Files are split by Spark; parsing runs in the executors' JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.genotype import allele, sample_field

FIXED = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]


def _parsed(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    at = lambda k: F.try_element_at(f, F.lit(k + 1))
    return lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        at(0).alias("chrom"), at(1).try_cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).try_cast("double").alias("qual"), at(6).alias("filter"), at(7).alias("info"), at(8).alias("format"),
        F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"), *[F.col(c) for c in lines.columns if c != "value"],
    )


def read_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records with the sample texts as an array, and the file. Files ending in .gz or .bgz are decompressed, each by one task."""
    return _parsed(spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")))


def stream_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The same for a folder that files are added to."""
    return _parsed(spark.readStream.text(path))


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, kind, value): FILTER, FORMAT, INFO, other entries, and the sample names line by line."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).where(F.col("value").startswith("#"))
    kind = F.regexp_extract("value", r"^##(FILTER|FORMAT|INFO)=", 1)
    return lines.select("file", F.when(F.col("value").startswith("#CHROM"), "samples").when(kind != "", kind).otherwise("other").alias("kind"), "value")


def sample_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, sample_idx, sample_id) in the order of the columns."""
    names = read_headers(spark, paths).where("kind = 'samples'").select("file", F.split("value", "\t").alias("f"))
    return names.select("file", F.posexplode(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0)))).alias("sample_idx", "sample_id"))


def genotypes(records: DataFrame, names: DataFrame) -> DataFrame:
    """Long form: a row for each record and sample with its alleles."""
    long = records.select("file", "chrom", "pos", "format", F.posexplode("samples").alias("sample_idx", "sample"))
    gt = sample_field(F.col("sample"), F.split("format", ":"), "GT")
    return long.join(names, ["file", "sample_idx"]).select("chrom", "pos", "sample_id", gt.alias("gt"), allele(gt, 0).alias("a1"), allele(gt, 1).alias("a2"), gt.contains("|").alias("phased"), "sample", "format")


def record_line(samples: bool = True) -> Column:
    quality = F.when(F.col("qual").isNull(), ".").otherwise(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""))
    fixed = ["chrom", F.col("pos").cast("string"), "id", "ref", "alt", quality, "filter", "info"]
    return F.concat_ws("\t", *fixed, *(["format", F.array_join("samples", "\t")] if samples else []))


def write_header(spark: SparkSession, headers: list[str], names: list[str], path: str, samples: bool = True) -> None:
    """Header lines and the line of columns in path/header."""
    columns = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *names] if samples else [])])
    spark.createDataFrame([(h,) for h in [*headers, columns]], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_vcf(records: DataFrame, headers: list[str], names: list[str], path: str, samples: bool = True) -> None:
    """A folder of parts in (chrom, pos) order: numbers first, then names. The header stands in a part of its own, ahead of the others."""
    write_header(records.sparkSession, headers, names, path, samples)
    ordered(records).select(record_line(samples).alias("value")).write.mode("overwrite").text(f"{path}/records")


def ordered(records: DataFrame, chroms: DataFrame | None = None) -> DataFrame:
    """By a chromosome order table (chrom, ord), without the chromosomes it lacks; else numbers first, then names."""
    if chroms is not None:
        return records.join(chroms, "chrom").orderBy("ord", "pos").drop("ord")
    return records.orderBy(F.col("chrom").try_cast("int").asc_nulls_last(), "chrom", "pos")


def write_passed_and_rejected(marked: DataFrame, path: str, headers: list[str], names: list[str]) -> None:
    """Both halves of FilterChain.mark(), below filtered and rejected, under one header with the filters' lines."""
    write_header(marked.sparkSession, headers, names, path)
    for name, keep in (("filtered", F.col("passed")), ("rejected", ~F.col("passed"))):
        ordered(marked.where(keep)).select(record_line().alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def write_split(records: DataFrame, label: Column, path: str, headers: list[str], names: list[str]) -> None:
    """One folder for each label, upper and lower case alike, and one header for all."""
    records.select(F.lower(label).alias("part"), record_line().alias("value")).write.mode("overwrite").partitionBy("part").text(f"{path}/records")
    write_header(records.sparkSession, headers, names, path)
