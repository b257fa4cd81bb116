"""Annotation joins: effects, phenotypes, known ids, and depth for missing calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effects(variants: DataFrame, annotation: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """A row for each variant and consequence; term 0 isn't one."""
    known = annotation.where("so_code <> 0")
    return variants.join(known.where(~F.col("consequence").isin(list(exclude))) if exclude else known, "variant_id")


def placed(annotation: DataFrame, variants: DataFrame) -> DataFrame:
    """Annotation rows of (chrom, pos), and of ref and alt where they have them, with the variant_id of each record there."""
    keys = [c for c in ("chrom", "pos", "ref", "alt") if c in annotation.columns]
    return annotation.join(variants.select("variant_id", *keys), keys).drop(*keys)


def of_genes(variants: DataFrame, annotation: DataFrame, genes: list[str]) -> DataFrame:
    """Variants with an annotation row of one of the genes, upper and lower case alike."""
    return variants.join(annotation.where(F.lower("gene").isin([g.lower() for g in genes])), "variant_id", "left_semi")


def effect_summary(found: DataFrame) -> DataFrame:
    return found.groupBy(F.lower("consequence").alias("consequence")).agg(F.count("*").alias("n"))


def effect_genes(found: DataFrame) -> DataFrame:
    return found.select(F.lower("gene").alias("gene")).distinct()


def unprocessed(variants: DataFrame, annotation: DataFrame) -> DataFrame:
    return variants.join(annotation.where("so_code <> 0"), "variant_id", "left_anti")


def effect_field(variants: DataFrame, annotation: DataFrame) -> DataFrame:
    """Distinct consequences of each variant as one comma list, in order; null without any."""
    each = annotation.where("so_code <> 0").groupBy("variant_id").agg(F.array_join(F.array_sort(F.collect_set("consequence")), ",").alias("eff"))
    return variants.join(each, "variant_id", "left")


def known_ids(variants: DataFrame, annotation: DataFrame) -> DataFrame:
    """ID as the comma list of known ids; unchanged without any."""
    each = annotation.where("snp_id is not null").groupBy("variant_id").agg(F.array_join(F.array_sort(F.collect_set("snp_id")), ",").alias("ids"))
    return variants.join(each, "variant_id", "left").withColumn("id", F.coalesce("ids", "id")).drop("ids")


def filled_missing(variants: DataFrame, calls: DataFrame, alignments: DataFrame, bin_size: int = 4096) -> DataFrame:
    """Missing calls with alignments over their position become 0/0 with that depth: (variant_id, sample_id, gt, dp).

    Alignments are spread over the bins they touch and joined by sample, chromosome and bin."""
    missing = calls.where("a1 is null and a2 is null").select("variant_id", "sample_id").join(variants.select("variant_id", "chrom", "pos"), "variant_id")
    spread = alignments.select("sample_id", "chrom", "start_pos", "end_pos", F.explode(F.sequence(F.floor(F.col("start_pos") / bin_size), F.floor(F.col("end_pos") / bin_size))).alias("bin"))
    hits = missing.withColumn("bin", F.floor(F.col("pos") / bin_size)).join(spread, ["sample_id", "chrom", "bin"]).where(F.col("pos").between(F.col("start_pos"), F.col("end_pos")))
    depth = hits.groupBy("variant_id", "sample_id").agg(F.count("*").alias("dp"))
    out = missing.select("variant_id", "sample_id").join(depth, ["variant_id", "sample_id"], "left")
    return out.select("variant_id", "sample_id", F.when(F.col("dp") > 0, "0/0").otherwise("./.").alias("gt"), F.coalesce("dp", F.lit(0)).alias("dp"))


def phenotypes(variants: DataFrame, annotation: DataFrame) -> DataFrame:
    """Variants with the phenotype records of their known ids."""
    return variants.join(annotation.where("snp_id is not null").select("variant_id", "snp_id", "gene"), "variant_id")
