"""Genotype and record expressions (parsing of sample text, codes, labels)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def alts(alt: Column) -> Column:
    """Alternates of ALT text; '.' has none."""
    return F.when(alt == ".", F.array().cast("array<string>")).otherwise(F.split(alt, ","))


def field_index(fields: Column, name: str) -> Column:
    """Place of a field in FORMAT, from 0; -1 where it is absent."""
    return (F.array_position(fields, name) - 1).cast("int")


def sample_field(sample: Column, fields: Column, name: str) -> Column:
    """A field of a sample's text; null where FORMAT or the sample lacks it."""
    return F.try_element_at(F.split(sample, ":"), F.nullif(F.array_position(fields, name), F.lit(0)).cast("int"))


def allele(gt: Column, k: int) -> Column:
    """k-th allele of a genotype text with / or |; null where missing."""
    return F.try_element_at(F.split(gt, r"[/|]"), F.lit(k + 1)).try_cast("int")


def code(a1: Column, a2: Column) -> Column:
    """Dataset code: null missing, 0 homozygous reference, 1 heterozygous, 2 homozygous alternate."""
    return F.when(a1.isNull() | a2.isNull(), None).when((a1 == 0) & (a2 == 0), 0).when(a1 != a2, 1).otherwise(2).cast("int")


def info_map(info: Column) -> Column:
    """INFO text as a map; flags map to null. Of repeated keys the last counts."""
    pairs = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, r"^[^=]*=", "")).alias("v"))
    made = F.transform(pairs, entry)
    last = F.filter(made, lambda e, i: ~F.exists(F.slice(F.transform(made, lambda x: x["k"]), i + 2, F.greatest(F.size(made) - i - 1, F.lit(0))), lambda k: k == e["k"]))
    return F.map_from_entries(last)


def info_text(info: Column) -> Column:
    """A map as INFO text in key order; flags without '='."""
    entries = F.array_sort(F.map_entries(info))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("")))), ";")
    return F.when(F.size(info) > 0, text).otherwise(".")


def milli(a: Column, b: Column) -> Column:
    """a / b with three places, rounded half up in whole numbers; '0.000' where b is 0."""
    n = F.when(b > 0, F.floor((2000 * a + b) / (2 * b))).otherwise(0).cast("long")
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def mendel_code(chrom: Column, f1: Column, f2: Column, m1: Column, m2: Column, c1: Column, c2: Column, sex: Column) -> Column:
    """Mendelian error code 0-10 of a trio; null with a missing call. sex: 1 male."""
    hom = lambda a, b, x: (a == x) & (b == x)
    male_x = (F.upper(chrom) == "X") & (sex == 1)
    het = c1 != c2
    c00, c11 = hom(c1, c2, 0), ~het & (c1 != 0)
    f00, f11, m00, m11 = hom(f1, f2, 0), (f1 == f2) & (f1 != 0), hom(m1, m2, 0), (m1 == m2) & (m1 != 0)
    missing = f1.isNull() | f2.isNull() | m1.isNull() | m2.isNull() | c1.isNull() | c2.isNull()
    return (
        F.when(missing, None).when(male_x & c11 & m00, 9).when(male_x & c00 & m11, 10).when(male_x, 0)
        .when(het & f00 & m00, 1).when(het & f11 & m11, 2).when(het, 0)
        .when(c00 & f11 & m11, 5).when(c00 & m11, 3).when(c00 & f11, 4)
        .when(c11 & f00 & m00, 8).when(c11 & f00, 6).when(c11 & m00, 7).otherwise(0).cast("int")
    )


def chromosome_label(chrom: Column) -> Column:
    return F.concat(F.lit("chromosome_"), chrom)


def coverage_label(dp: Column, limits: list[int]) -> Column:
    """coverage_<low>_<high> of the first limit that reaches the depth; beyond the last coverage_<last>_N."""
    label = F.when(dp.isNull(), "coverage_missing")
    for low, high in zip([0, *limits], limits, strict=False):
        label = label.when(dp <= high, f"coverage_{low}_{high}")
    return label.otherwise(f"coverage_{limits[-1]}_N")
