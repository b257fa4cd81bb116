"""Record filters and running counts over streams of VCF files; both are the batch expressions unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genotype import chromosome_label
from genoframe.operators.filters import FilterChain


def passed(records: DataFrame, chain: FilterChain) -> DataFrame:
    """Stateless: any chain of record predicates."""
    return chain.passed(records.withColumn("dp", F.regexp_extract("info", r"(?:^|;)DP=(\d+)", 1).try_cast("int")))


def part_counts(records: DataFrame) -> DataFrame:
    """Running counts by chromosome, for complete or update mode; the state is a row for each chromosome."""
    return records.groupBy(chromosome_label(F.col("chrom")).alias("part")).count()
