"""Association tests (allelic chi-square, Fisher) and the transmission disequilibrium test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.mathx import chi_square_p, div, fisher_two_sided
from genoframe.operators.stats import mendel_errors


def r6(c: Column) -> Column:
    return F.round(c, 6)


def allelic_counts(variants: DataFrame, calls: DataFrame, ped: DataFrame) -> DataFrame:
    """A1, A2 (affected: reference, alternate alleles) and U1, U2 (unaffected). On X only homozygotes count, once.

    Calls meet the pedigree by sample and are added up by variant, which combines before the shuffle; the chromosome, which
    chooses between the sums, is joined to one row a variant."""
    x = calls.where("a1 is not null and a2 is not null").join(ped.where("condition in (1, 2)").select("sample_id", "condition"), "sample_id")
    same = F.col("a1") == F.col("a2")
    ref, alt = (F.col("a1") == 0).cast("int") + (F.col("a2") == 0).cast("int"), (F.col("a1") > 0).cast("int") + (F.col("a2") > 0).cast("int")
    kinds = {"ref": ref, "alt": alt, "hom_ref": (same & (F.col("a1") == 0)).cast("int"), "hom_alt": (same & (F.col("a1") > 0)).cast("int")}
    sums = [F.sum(F.when(F.col("condition") == cond, what).otherwise(0)).cast("long").alias(f"{group}_{name}") for group, cond in (("a", 2), ("u", 1)) for name, what in kinds.items()]
    counts = variants.select("variant_id", "chrom").join(x.groupBy("variant_id").agg(*sums), "variant_id", "left")
    chosen = lambda group, allele: F.coalesce(F.when(F.col("chrom") == "X", F.col(f"{group}_hom_{allele}")).otherwise(F.col(f"{group}_{allele}")), F.lit(0)).cast("long")
    return counts.select("variant_id", *[chosen(g, allele).alias(f"{g}{k}_count") for g in "au" for k, allele in ((1, "ref"), (2, "alt"))])


def _frequencies(df: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x) for x in ("a1_count", "a2_count", "u1_count", "u2_count"))
    share = lambda x, y: r6(F.coalesce(div(x, x + y), F.lit(0.0)))
    return df.withColumns({"f_a1": share(a, b), "f_u1": share(c, d), "f_a2": share(b, a), "f_u2": share(d, c), "odds_ratio": r6(div(a * d, b * c))})


def assoc_chisq(variants: DataFrame, calls: DataFrame, ped: DataFrame) -> DataFrame:
    a, b, c, d = (F.col(x) for x in ("a1_count", "a2_count", "u1_count", "u2_count"))
    chi = div((a + b + c + d) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))
    return _frequencies(allelic_counts(variants, calls, ped)).withColumn("chisq", r6(chi))


def assoc_fisher(variants: DataFrame, calls: DataFrame, ped: DataFrame, n_samples: int) -> DataFrame:
    """n_samples bounds the table of log-factorials."""
    p = fisher_two_sided(*(F.col(x) for x in ("a1_count", "a2_count", "u1_count", "u2_count")), 2 * n_samples)
    return _frequencies(allelic_counts(variants, calls, ped)).withColumn("p_value", r6(p))


def with_p(df: DataFrame, chisq: str = "chisq") -> DataFrame:
    return df.withColumn("p_value", F.when(F.col(chisq).isNotNull(), chi_square_p(F.col(chisq))))


def tdt(variants: DataFrame, calls: DataFrame, ped: DataFrame) -> DataFrame:
    """Transmissions t1 (reference) and t2 (alternate) to affected children, chi-square (-1 without any), odds ratio.

    Allele order within a call doesn't matter; transmissions are counted anew for each child."""
    t = mendel_errors(calls, ped, variants).where("condition = 2 and code = 0")
    low, high = (lambda p: F.least(f"{p}1", f"{p}2")), (lambda p: F.greatest(f"{p}1", f"{p}2"))
    het = lambda p: (low(p) == 0) & (high(p) > 0)
    any_het = lambda p: F.col(f"{p}1") != F.col(f"{p}2")
    hom_ref = lambda p: high(p) == 0
    both, father = any_het("f") & any_het("m"), any_het("f")
    t = t.where(any_het("f") | any_het("m"))
    tr_a = F.when(hom_ref("c"), 1).when(het("c"), F.when(both, 1).when(father, F.when(hom_ref("m"), 2).otherwise(1)).otherwise(F.when(hom_ref("f"), 2).otherwise(1))).otherwise(2)
    tr_b = F.when(both, F.when(hom_ref("c"), 1).otherwise(2))
    hits = lambda k: F.coalesce((tr_a == k).cast("int"), F.lit(0)) + F.coalesce((tr_b == k).cast("int"), F.lit(0))
    counts = t.groupBy("variant_id").agg(F.sum(hits(1)).cast("long").alias("t1"), F.sum(hits(2)).cast("long").alias("t2"))
    out = variants.select("variant_id").join(counts, "variant_id", "left").na.fill(0)
    n, d = F.col("t1") + F.col("t2"), F.col("t1") - F.col("t2")
    return out.withColumn("odds_ratio", r6(div(F.col("t1"), F.col("t2")))).withColumn("chisq", r6(F.coalesce(div(d * d, n), F.lit(-1.0))))
