"""VCF files and pedigrees as the tables that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.functions.genotype import allele, alts, info_map, sample_field
from genoframe.sources import vcf


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, file_idx) in the order of the paths, a row a file."""
    listed = [(row["file"], k) for k, p in enumerate(paths) for row in spark.read.text(p).select(F.col("_metadata.file_path").alias("file")).limit(1).collect()]
    return spark.createDataFrame(listed, "file string, file_idx int")


def cohort(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """variants (a row a record, with its file_idx, INFO, FORMAT and sample texts), calls (a row a record and sample: a1, a2, dp, gq) and samples
    (file_idx, sample_idx, sample_id). variant_id numbers the records of the scan; it is equal in every run over the same files."""
    order = F.broadcast(files(spark, paths))  # a row for each path given
    records = vcf.read_vcf(spark, paths).withColumn("variant_id", F.monotonically_increasing_id()).join(order, "file")
    variants = records.withColumn("n_alleles", 1 + F.size(alts(F.col("alt")))).withColumn("dp", F.try_element_at(info_map(F.col("info")), F.lit("DP")).try_cast("long")).drop("file")
    names = vcf.sample_names(spark, paths).join(order, "file").drop("file")
    fields = F.split("format", ":")
    long = variants.select("variant_id", "file_idx", "format", F.posexplode("samples").alias("sample_idx", "sample")).join(F.broadcast(names), ["file_idx", "sample_idx"])  # names: the columns of the headers
    number = lambda name: sample_field(F.col("sample"), fields, name).try_cast("long").alias(name.lower())
    gt = sample_field(F.col("sample"), fields, "GT")
    return variants, long.select("variant_id", "sample_id", allele(gt, 0).alias("a1"), allele(gt, 1).alias("a2"), number("DP"), number("GQ")), names


def nuclear_families(ped: DataFrame) -> DataFrame:
    """A pedigree of any generations as nuclear families: (sample_id, family_id, role 0 father, 1 mother, 2 child, sex, condition).

    Each couple with children is a family of its own, named by family and parents; who is a child in one and a parent in others has a row in
    each. Children with a parent that the pedigree lacks belong to none. Joins are by ids within a family; nothing is walked."""
    person = ped.select("family_id", "sample_id", F.col("sex").cast("int").alias("sex"), "condition").dropDuplicates(["family_id", "sample_id"])
    known = lambda c: person.select("family_id", F.col("sample_id").alias(c))
    child = ped.select("family_id", "father_id", "mother_id", "sample_id").distinct().join(known("father_id"), ["family_id", "father_id"]).join(known("mother_id"), ["family_id", "mother_id"])
    place = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(c).alias("sample_id")) for k, c in enumerate(("father_id", "mother_id", "sample_id"))]))
    couple = F.concat_ws(":", "family_id", "father_id", "mother_id").alias("couple")
    rows = child.select("family_id", couple, place.alias("p")).select("family_id", "couple", "p.role", "p.sample_id").distinct()
    return rows.join(person, ["family_id", "sample_id"]).select("sample_id", F.col("couple").alias("family_id"), "role", "sex", "condition")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, chrom, start_pos, end_pos) of mapped SAM text records; the sample is the file's name without its ending. The end counts the
    reference bases of the CIGAR text."""
    f = F.split("value", "\t")
    at = lambda k: F.try_element_at(f, F.lit(k))
    rows = spark.read.text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1).alias("sample_id")).where(~F.col("value").startswith("@") & (F.trim("value") != ""))
    length = F.aggregate(F.regexp_extract_all(at(6), F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    out = rows.select("sample_id", at(3).alias("chrom"), at(4).try_cast("long").alias("start_pos"), length.alias("n"), at(2).try_cast("int").alias("flag"))
    return out.where((F.col("chrom") != "*") & (F.col("flag").bitwiseAND(4) == 0) & (F.col("n") > 0)).select("sample_id", "chrom", "start_pos", (F.col("start_pos") + F.col("n") - 1).alias("end_pos"))
