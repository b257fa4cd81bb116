"""Deterministic genomic views over the test tables; the same text runs in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {"part", "lineitem", "customer", "supplier", "events", "orders"}
CHROM = "case when {k} % 23 = 22 then 'X' else cast({k} % 23 + 1 as string) end"

#: name -> (views and tables it reads, text)
VIEWS: dict[str, tuple[list[str], str]] = {
    "variants": (["part"], f"""select p_partkey as variant_id, {CHROM.format(k='p_partkey')} as chrom, 1000 + p_partkey * 37 as pos,
 case when p_partkey % 5 = 0 then '.' else concat('rs', cast(p_partkey as string)) end as id, substr('ACGT', k4, 1) as ref,
 case when p_size % 20 = 0 then concat(substr('CGTA', k4, 1), ',', substr('GTAC', k4, 1), ',', substr('TACG', k4, 1)) when p_size % 10 = 0 then concat(substr('CGTA', k4, 1), ',', substr('GTAC', k4, 1)) when p_size % 7 = 0 then concat(substr('ACGT', k4, 1), 'T') when p_size % 11 = 0 then '<DEL>' else substr('CGTA', k4, 1) end as alt,
 case when p_size % 20 = 0 then 4 when p_size % 10 = 0 then 3 else 2 end as n_alleles, case when p_size % 9 = 0 then null else cast(p_size * 2 as double) end as qual,
 case p_partkey % 4 when 0 then 'PASS' when 1 then 'q10' when 2 then 'q10;bias' else '.' end as filter,
 case when p_partkey % 13 = 0 then null else cast((p_size * 3) % 100 as bigint) end as dp, k4
 from (select *, cast(p_partkey % 4 as int) + 1 as k4 from part) p"""),
    "ped": (["customer"], """select c_custkey as sample_id, cast(floor(c_custkey / 3) as bigint) as family_id, c_custkey % 3 as role,
 case when c_custkey % 3 = 0 then 1 when c_custkey % 3 = 1 then 2 else c_custkey % 2 + 1 end as sex,
 case when c_custkey % 3 = 2 or c_custkey % 4 = 1 then 2 else 1 end as condition, c_mktsegment as population from customer where c_custkey < 24"""),
    "calls": (["lineitem", "variants"], """select variant_id, sample_id, case when tax > 0.075 then null when quantity > 30 then 1 else 0 end as a1,
 case when tax > 0.075 then null when discount > 0.045 then case when n_alleles = 4 and line >= 7 then 3 when n_alleles > 2 and line >= 6 then 2 else 1 end else 0 end as a2
 from (select l_partkey as variant_id, l_orderkey % 24 as sample_id, l_quantity as quantity, l_discount as discount, l_tax as tax, l_linenumber as line,
 row_number() over (partition by l_partkey, l_orderkey % 24 order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as pick from lineitem) l
 join (select variant_id as v, n_alleles from variants) n on n.v = l.variant_id where pick = 1"""),
    "regions": (["supplier"], f"""select {CHROM.format(k='s_suppkey')} as chrom, 1000 + s_suppkey * 400 as start_pos, 3000 + s_suppkey * 400 as end_pos,
 case when s_nationkey % 2 = 0 then 'exon' else 'gene' end as type, concat('GENE', cast(s_suppkey % 50 as string)) as gene from supplier"""),
    "annotation": (["events"], """select cast(floor(event_id / 5) as bigint) as variant_id,
 case event_type when 'view' then 'intron_variant' when 'click' then 'missense_variant' when 'purchase' then 'stop_gained' when 'signup' then 'regulatory_region_variant' else 'none' end as consequence,
 case event_type when 'view' then 1627 when 'click' then 1583 when 'purchase' then 1587 when 'signup' then 1566 else 0 end as so_code,
 concat('GENE', cast(user_id % 50 as string)) as gene, case when event_id % 3 = 0 then concat('rs', cast(900000 + event_id as string)) end as snp_id from events"""),
    "alignments": (["orders"], f"""select o_orderkey % 24 as sample_id, {CHROM.format(k='o_custkey')} as chrom, 960 + o_custkey * 37 as start_pos, 1059 + o_custkey * 37 as end_pos from orders"""),
    "file_records": (["variants"], """select f as file_idx, variant_id, chrom, pos, case when f = 1 then '.' else id end as id,
 case when f = 1 and variant_id % 50 = 7 then concat(ref, 'G') when f = 1 and variant_id % 50 = 9 then 'N' else ref end as ref,
 case when f = 2 and variant_id % 3 = 0 then substr('TACG', k4, 1) else alt end as alt, case when f = 2 and variant_id % 6 = 0 then null else qual + f end as qual,
 case f when 0 then filter when 1 then 'PASS' else 'STD' end as filter, dp from variants cross join (select 0 as f union all select 1 union all select 2) f where (variant_id + f) % 4 <> 0"""),
    "file_samples": (["ped"], "select cast(floor(sample_id / 8) as bigint) as file_idx, sample_id from ped"),
}


def prefix(names: list[str], extra: dict[str, str] | None = None) -> str:
    """'with ...' clauses of the views that a query needs, in order of need; extra: clauses for the base tables."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done:
            return
        if name in TABLES:
            if extra:
                done[name] = extra[name]
            return
        for other in VIEWS[name][0]:
            need(other)
        done[name] = VIEWS[name][1]

    for name in names:
        need(name)
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in done.items())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of a folder."""
    tables = {t: f"select * from parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(f"{prefix([name], tables)} select * from {name}")


def oracle(names: list[str], query: str) -> str:
    """The query behind the clauses of the views it reads; base tables are there by name."""
    text = prefix(names)
    return f"{text},\n{query[5:]}" if query.startswith("with ") else f"{text}\n{query}"
