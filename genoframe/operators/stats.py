"""Per-variant, per-group, per-sample and whole-file statistics, and their INFO form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genotype import info_map, info_text, mendel_code, milli
from genoframe.functions.mathx import div

def pairs(n: int) -> list[tuple[int, int]]:
    """Unordered genotypes of n alleles, in order."""
    return [(i, j) for i in range(n) for j in range(i, n)]


def gt_name(i: int, j: int) -> str:
    return f"g{i}{j}" if j < 10 else f"g{i}_{j}"


def widest(variants: DataFrame) -> int:
    """Alleles of the record that has most, three at least: a look at one column."""
    return max(3, variants.agg(F.max("n_alleles")).first()[0] or 0)


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def aggregates(n: int) -> list[Column]:
    """Counts of n alleles and their genotypes; a genotype counts where both alleles are called."""
    one = lambda c, k: F.when(F.col(c) == k, 1).otherwise(0)
    both = F.col("a1").isNotNull() & F.col("a2").isNotNull()
    pair = lambda i, j: both & (F.least("a1", "a2") == i) & (F.greatest("a1", "a2") == j)
    return [
        *[F.sum(one("a1", k) + one("a2", k)).cast("long").alias(f"c{k}") for k in range(n)],
        *[count_if(pair(i, j)).alias(gt_name(i, j)) for i, j in pairs(n)],
        count_if(both).alias("called"),
    ]


def finished(df: DataFrame, n_samples: Column, n: int) -> DataFrame:
    """Missing genotypes, total alleles and the minor allele frequency (over the alleles the record has) from the counts."""
    counts = [F.col(f"c{k}") for k in range(n)]
    own = [counts[0], counts[1], *[F.when(F.col("n_alleles") > k, counts[k]) for k in range(2, n)]]  # least() skips nulls
    df = df.withColumn("n_samples", n_samples.cast("long")).withColumn("an", sum(counts[1:], counts[0]))
    return df.withColumn("missing_genotypes", F.col("n_samples") - F.col("called")).withColumn("maf", F.round(div(F.least(*own), F.col("an")), 6))


def variant_stats(variants: DataFrame, calls: DataFrame, n_samples: int, alleles: int | None = None) -> DataFrame:
    """One row a variant: allele counts c0, c1, ..., genotype counts gij, called, an, missing_genotypes, maf. Absent calls are missing.

    alleles: the most that a record has, looked up where it isn't given; the counts are that many columns, so that one
    hash aggregation without lists does for all records."""
    n = alleles or widest(variants)
    counts = calls.groupBy("variant_id").agg(*aggregates(n))
    joined = variants.select("variant_id", "n_alleles").join(counts, "variant_id", "left").na.fill(0)
    return finished(joined, F.lit(n_samples), n)


def group_stats(variants: DataFrame, calls: DataFrame, ped: DataFrame, group: str, alleles: int | None = None) -> DataFrame:
    """The same for each value of a pedigree column."""
    n = alleles or widest(variants)
    counts = calls.join(ped.select("sample_id", group), "sample_id").groupBy("variant_id", group).agg(*aggregates(n))
    sizes = ped.groupBy(group).agg(F.count("*").alias("size"))
    joined = counts.join(variants.select("variant_id", "n_alleles"), "variant_id").join(sizes, group)
    return finished(joined, F.col("size"), n).drop("size")


def trios(calls: DataFrame, ped: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant, child) with the calls of father, mother and child; all three must have a row."""
    role = lambda k, p: ped.where(f"role = {k}").join(calls, "sample_id").select("variant_id", "family_id", F.col("a1").alias(f"{p}1"), F.col("a2").alias(f"{p}2"), *(["sex", "condition", F.col("sample_id").alias("child")] if k == 2 else []))
    joined = role(2, "c").join(role(0, "f"), ["variant_id", "family_id"]).join(role(1, "m"), ["variant_id", "family_id"])
    return joined.join(variants.select("variant_id", "chrom"), "variant_id")


def mendel_errors(calls: DataFrame, ped: DataFrame, variants: DataFrame) -> DataFrame:
    t = trios(calls, ped, variants)
    return t.withColumn("code", mendel_code(*(F.col(c) for c in ("chrom", "f1", "f2", "m1", "m2", "c1", "c2", "sex"))))


def sample_stats(calls: DataFrame, ped: DataFrame, variants: DataFrame) -> DataFrame:
    """Missing genotypes and Mendelian errors of each sample."""
    total = variants.agg(F.count("*").alias("n_variants"))
    called = calls.where("a1 is not null and a2 is not null").groupBy("sample_id").agg(F.count("*").alias("called"))
    errors = mendel_errors(calls, ped, variants).where("code > 0").groupBy(F.col("child").alias("sample_id")).agg(F.count("*").alias("mendel_errors"))
    out = ped.select("sample_id").join(called, "sample_id", "left").join(errors, "sample_id", "left").na.fill(0).crossJoin(F.broadcast(total))  # one row
    return out.select("sample_id", (F.col("n_variants") - F.col("called")).alias("missing_genotypes"), "mendel_errors")


def file_summary(variants: DataFrame, n_samples: int) -> DataFrame:
    from genoframe.operators.filters import variant_type

    single = (variant_type() == "snv") & (F.col("n_alleles") == 2)
    pair = F.concat("ref", "alt")
    transition = single & pair.isin("AG", "GA", "CT", "TC")
    return variants.agg(
        F.count("*").alias("n_variants"), F.lit(n_samples).cast("long").alias("n_samples"), count_if(F.col("id") != ".").alias("n_snps"), count_if(variant_type() == "indel").alias("n_indels"),
        count_if(F.col("n_alleles") == 2).alias("n_biallelic"), count_if(F.col("n_alleles") > 2).alias("n_multiallelic"), count_if(transition).alias("n_transitions"), count_if(single & ~transition).alias("n_transversions"),
        F.round(F.avg("qual"), 6).alias("mean_quality"), count_if(F.col("filter") == "PASS").alias("n_pass"),
    )


def inheritance(calls: DataFrame, ped: DataFrame) -> DataFrame:
    """Shares of called samples that follow the dominant and the recessive pattern."""
    x = calls.where("a1 is not null and a2 is not null").join(ped.select("sample_id", "condition"), "sample_id")
    affected, alt, both = F.col("condition") == 2, (F.col("a1") > 0) | (F.col("a2") > 0), (F.col("a1") > 0) & (F.col("a1") == F.col("a2"))
    return x.groupBy("variant_id").agg(F.avg((affected == alt).cast("int")).alias("dominant"), F.avg((affected == both).cast("int")).alias("recessive"))


def _listed(parts: list[tuple[int, Column]]) -> Column:
    """Texts in a row with commas; each stands only where the record has that many alleles."""
    return F.concat_ws(",", *[text if k < 2 else F.when(F.col("n_alleles") > k, text) for k, text in parts])


def genotype_counts_text(n: int) -> Column:
    """i/j:count over unordered pairs of the variant's alleles, then ./.:missing."""
    parts = [(j, F.concat(F.lit(f"{i}/{j}:"), F.col(gt_name(i, j)).cast("string"))) for i, j in pairs(n)]
    return F.concat(_listed(parts), F.lit(",./.:"), F.col("missing_genotypes").cast("string"))


def aggregate_info(variants: DataFrame, stats: DataFrame, overwrite: bool = False, prefix: str = "AGG_") -> DataFrame:
    """INFO of each record with AC, AF, AN and GTC added: under prefixed names, or with overwrite in place of what the record had. Flags stay; keys in order."""
    mark = "" if overwrite else prefix
    n = sum(c[:1] == "c" and c[1:].isdigit() for c in stats.columns)
    ac = _listed([(k, F.col(f"c{k}").cast("string")) for k in range(1, n)])
    af = _listed([(k, milli(F.col(f"c{k}"), F.col("an"))) for k in range(1, n)])
    fresh = F.create_map(*[x for k, v in (("AC", ac), ("AF", af), ("AN", F.col("an").cast("string")), ("GTC", genotype_counts_text(n))) for x in (F.lit(mark + k), v)])
    own = F.map_filter(info_map(F.coalesce("info", F.lit("."))), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    taken = stats.select("variant_id", *[c for c in stats.columns if c not in variants.columns or c == "n_alleles"])
    return variants.drop("n_alleles").join(taken, "variant_id").select("variant_id", info_text(F.map_concat(own, fresh)).alias("info"))
