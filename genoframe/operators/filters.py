"""Variant filters: predicates as Columns, and a conjunctive chain with its complement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genotype import alts

#: Predicates over record columns, by name; users may add their own.
PREDICATES: dict[str, Callable[..., Column]] = {
    "alleles": lambda n: 1 + F.size(alts(F.col("alt"))) == n,
    "coverage": lambda n: F.col("dp") >= n,
    "quality": lambda n: F.col("qual") >= n,
    "maf": lambda x: F.col("maf") >= x,
    "missing": lambda x: F.col("missing_genotypes") / F.col("n_samples") <= x,
    "mendel": lambda n: F.coalesce(F.col("mendel_errors"), F.lit(0)) <= n,
    "snp": lambda mode="include": (F.col("id") == ".") if mode == "exclude" else (F.col("id") != "."),
    "indel": lambda mode="include": ~_indel() if mode == "exclude" else _indel(),
    "var_type": lambda kind="snv": variant_type() == kind.lower(),
    "inh_dom": lambda x: F.col("dominant") >= x,
    "inh_rec": lambda x: F.col("recessive") >= x,
}


def _indel() -> Column:
    return F.exists(alts(F.col("alt")), lambda a: F.length(a) != F.length("ref"))


def variant_type() -> Column:
    """structural for symbolic and breakend alternates, snv where all alleles have one base, else indel."""
    a = alts(F.col("alt"))
    return F.when(F.exists(a, lambda x: x.rlike(r"[<\[\]]")), "structural").when((F.length("ref") == 1) & F.forall(a, lambda x: F.length(x) == 1), "snv").otherwise("indel")


#: End of a region without a bound.
WHOLE = 1 << 62


class FilterChain:
    """A conjunction of predicates; cheap record predicates come before those over joined statistics."""

    LATE = ("maf", "missing", "mendel", "inh_dom", "inh_rec")

    def __init__(self) -> None:
        self.parts: list[tuple[bool, str, Column]] = []

    def add(self, name: str, *args) -> FilterChain:
        self.parts.append((name in self.LATE, name, PREDICATES[name](*args)))
        return self

    def predicate(self) -> Column:
        """A plain conjunction, null where it isn't decided: Catalyst moves each part below the joins as far as its columns allow."""
        out = F.lit(True)
        for _, _, p in sorted(self.parts, key=lambda x: x[0]):
            out = out & p
        return out

    def mark(self, df: DataFrame) -> DataFrame:
        return df.withColumn("passed", F.coalesce(self.predicate(), F.lit(False)))

    def passed(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())

    def rejected(self, df: DataFrame) -> DataFrame:
        return df.where(~F.coalesce(self.predicate(), F.lit(False)))

    def headers(self) -> list[str]:
        return [f'##FILTER=<ID={name},Description="Filter {name}">' for _, name, _ in self.parts]


def overlapping(variants: DataFrame, regions: DataFrame, bin_size: int = 16384) -> DataFrame:
    """Variants in a region (inclusive). Regions are spread over the bins they touch, so the range join is an equi-join of its own size."""
    bins = regions.select(F.col("chrom").alias("r_chrom"), "start_pos", "end_pos", F.explode(F.sequence(F.floor(F.col("start_pos") / bin_size), F.floor(F.col("end_pos") / bin_size))).alias("bin"))
    inside = (F.col("chrom") == F.col("r_chrom")) & (F.floor(F.col("pos") / bin_size) == F.col("bin")) & F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    return variants.join(bins, inside, "left_semi")


def in_regions(variants: DataFrame, listed: list[tuple[str, int, int]], regions: DataFrame | None = None) -> DataFrame:
    """Variants in a listed region (chrom, start, end), as parse_regions gives them, or in one of a table. Whole chromosomes need no join."""
    whole = F.col("chrom").isin([c for c, low, high in listed if (low, high) == (0, WHOLE)])
    some = [r for r in listed if r[1:] != (0, WHOLE)]
    # A listed region's bins are laid out by start and end, so an open end is a plain condition too.
    plain = whole
    for chrom, low, high in some:
        if high == WHOLE:
            plain = plain | ((F.col("chrom") == chrom) & (F.col("pos") >= low))
    some = [r for r in some if r[2] != WHOLE]
    if some:
        table = variants.sparkSession.createDataFrame(some, "chrom string, start_pos long, end_pos long")
        regions = table if regions is None else regions.select("chrom", "start_pos", "end_pos").unionByName(table)
    out = variants.where(plain)
    return out if regions is None else out.unionByName(overlapping(variants.where(~plain), regions))


def parse_regions(text: str) -> list[tuple[str, int, int]]:
    """'chr:start-end,...' as rows; a missing end is the start, missing bounds are the whole chromosome; 'chr:start-' runs to its end."""
    out = []
    for part in filter(None, text.split(",")):
        chrom, _, span = part.partition(":")
        low, dash, high = span.partition("-")
        out.append((chrom, int(low or 0), int(high or (WHOLE if dash else low) or WHOLE)))
    return out
