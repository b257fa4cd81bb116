"""Command line: python -m genoframe TOOL --vcf FILE... --out FOLDER [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from genoframe.functions.genotype import chromosome_label, coverage_label, info_map, info_text
from genoframe.operators import annotate, filters, gwas, mdr, merge, stats
from genoframe.sources import cohort, tables, vcf

FILTERS = {"alleles": int, "coverage": int, "quality": float, "maf": float, "missing": float, "snp": str, "indel": str, "var_type": str, "mendel": int, "inh_dom": float, "inh_rec": float}
TOOLS = ("filter", "split", "stats", "merge", "aggregate", "annot", "effect", "assoc", "tdt", "vcf2epi", "epi")
NEED_PED, NEED_ANNOTATION = ("assoc", "tdt", "vcf2epi", "epi"), ("annot", "effect")


def options(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="genoframe", description=__doc__)
    p.add_argument("tool", choices=TOOLS)
    p.add_argument("--vcf", nargs="+", required=True, help="VCF files; merge takes several")
    p.add_argument("--out", required=True, help="folder to write to")
    p.add_argument("--ped", help="pedigree of assoc, tdt, vcf2epi, epi and of the filters by family and inheritance")
    p.add_argument("--variable", default="6", help="the pedigree's phenotype column, by number or name")
    p.add_argument("--affected", default="2")
    p.add_argument("--unaffected", default="1")
    p.add_argument("--region", help="chr:start-end,... (filter)")
    p.add_argument("--region-file", help="GFF or BED (filter)")
    p.add_argument("--region-type", help="only regions of this type")
    p.add_argument("--by", choices=("chromosome", "coverage"), default="chromosome", help="what split goes by")
    p.add_argument("--intervals", type=lambda x: [int(k) for k in x.split(",")], default=[10, 20, 40, 80], help="limits of coverage")
    p.add_argument("--test", choices=("chisq", "fisher"), default="chisq")
    p.add_argument("--missing-mode", choices=("missing", "reference"), default="missing")
    p.add_argument("--strict-ref", action="store_true")
    p.add_argument("--info-fields", default="", help="INFO fields that merge writes anew, with commas")
    p.add_argument("--copy-filter", action="store_true", help="merge: each record's FILTER in its samples, as SFT")
    p.add_argument("--copy-info", action="store_true", help="merge: each record's INFO in its samples, as IN")
    p.add_argument("--overwrite", action="store_true", help="aggregate: in place of the record's own INFO fields")
    p.add_argument("--annotation", help=f"tab-separated or .json annotation: {tables.ANNOTATION}")
    p.add_argument("--exclude", default="", help="consequences that effect leaves out, with commas")
    p.add_argument("--gene", default="", help="only variants annotated with these genes, with commas (filter)")
    p.add_argument("--order", type=int, default=2, help="epi: variants in a combination")
    p.add_argument("--folds", type=int, default=10)
    p.add_argument("--repetitions", type=int, default=1, help="epi: cross-validations, each with folds of its own")
    p.add_argument("--top", type=int, default=50, help="epi: models in a ranking")
    p.add_argument("--rank-by", choices=("accuracy", "count"), default="count")
    p.add_argument("--evaluation", choices=tuple(mdr.EVALUATIONS), default="BA")
    p.add_argument("--partition", choices=("train", "test"), default="train", help="epi: samples that accuracy is taken on")
    for name, kind in FILTERS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=kind)
    o = p.parse_args(argv)
    if not o.ped and (o.tool in NEED_PED or o.tool == "filter" and any(x is not None for x in (o.mendel, o.inh_dom, o.inh_rec))):
        p.error(f"{o.tool} needs --ped")
    if not o.annotation and (o.tool in NEED_ANNOTATION or o.gene):
        p.error(f"{o.tool} needs --annotation")
    return o


def run(spark: SparkSession, o: argparse.Namespace) -> None:
    variants, calls, names = cohort.cohort(spark, o.vcf)
    place = variants.select("variant_id", "chrom", "pos", "id", "ref", "alt")
    ped = tables.read_ped(spark, o.ped, o.variable, o.unaffected, o.affected) if o.ped else None
    annotation = annotate.placed(tables.read_annotation(spark, o.annotation, tables.ANNOTATION), variants) if o.annotation else None
    if o.tool in ("filter", "split", "merge", "aggregate", "annot"):
        lines = [r["value"] for r in vcf.read_headers(spark, o.vcf).where("kind <> 'samples'").collect()]
        columns = [r["sample_id"] for r in names.orderBy("file_idx", "sample_idx").collect()]
    if o.tool == "split":
        label = chromosome_label(F.col("chrom")) if o.by == "chromosome" else coverage_label(F.col("dp"), o.intervals)
        vcf.write_split(variants, label, o.out, lines, columns)
        return
    if o.tool in ("assoc", "tdt"):
        if o.tool == "tdt":
            found = gwas.with_p(gwas.tdt(variants, calls, cohort.nuclear_families(ped)))
        elif o.test == "chisq":
            found = gwas.with_p(gwas.assoc_chisq(variants, calls, ped))
        else:
            found = gwas.assoc_fisher(variants, calls, ped, names.count())
        tables.write_gwas(place.join(found, "variant_id").drop("variant_id"), o.out)
        return
    if o.tool == "merge":
        if repeated := merge.repeated_samples(names).limit(5).collect():
            raise ValueError(f"samples in more than one file: {', '.join(r['sample_id'] for r in repeated)}")
        fill = "0/0" if o.missing_mode == "reference" else "./."
        one = merge.full_samples(merge.grouped(variants, names, o.strict_ref), names, fill, o.strict_ref, o.copy_filter, o.copy_info)
        fields = tuple(filter(None, o.info_fields.split(",")))
        rows = merge.positions(one, carried=("format", "samples"))
        if fields:
            info = merge.info_fields(one, merge.long_form(one), fill).select("chrom", "pos", merge.info_text(fields).alias("info"))
            rows = rows.join(info, ["chrom", "pos"])
        else:
            rows = rows.withColumn("info", F.lit("."))
        extra = [merge.FORMAT_LINES[k] for k, wanted in (("SFT", o.copy_filter), ("IN", o.copy_info)) if wanted]
        vcf.write_vcf(rows, list(dict.fromkeys([*lines, *extra])), columns, o.out)
        return
    if o.tool in ("vcf2epi", "epi"):
        ped = ped.where("condition is not null").join(names.select("sample_id"), "sample_id", "left_semi")
        if o.tool == "vcf2epi":
            mdr.bitmaps(calls, ped).join(place, "variant_id").write.mode("overwrite").parquet(f"{o.out}/genotypes")
            mdr.with_bits(ped.select("sample_id", "condition")).write.mode("overwrite").parquet(f"{o.out}/samples")
            return
        for k, ranking in enumerate(mdr.cross_validations(calls, ped, o.order, o.folds, o.top, o.repetitions, o.rank_by, o.evaluation, o.partition)):
            report = mdr.report(ranking, o.order, k, o.rank_by, o.partition)
            spark.createDataFrame([(x,) for x in report], "value string").coalesce(1).write.mode("overwrite").text(f"{o.out}/cross_validation_{k + 1}")
        return
    if o.tool == "effect":
        exclude = list(filter(None, o.exclude.split(",")))
        tables.write_effects(annotate.effects(place, annotation, exclude), o.out)
        annotate.unprocessed(place, annotation).write.mode("overwrite").csv(f"{o.out}/unprocessed", sep="\t")
        return
    if o.tool == "annot":
        known = annotate.effect_field(annotate.known_ids(variants, annotation), annotation)
        effect = F.when(F.col("eff").isNotNull(), F.create_map(F.lit("EFF"), F.col("eff"))).otherwise(F.create_map().cast("map<string,string>"))
        own = F.map_filter(info_map(F.coalesce("info", F.lit("."))), lambda k, v: F.col("eff").isNull() | (k != "EFF"))
        vcf.write_vcf(known.withColumn("info", info_text(F.map_concat(own, effect))), lines, columns, o.out)
        return
    found = stats.variant_stats(variants, calls, names.count())
    if o.tool == "stats":
        tables.write_stats(place.join(found.drop("n_alleles"), "variant_id").drop("variant_id"), o.out)
        return
    if o.tool == "aggregate":
        rows = variants.drop("info").join(stats.aggregate_info(variants, found, o.overwrite), "variant_id")
        vcf.write_vcf(rows, lines, [], o.out, samples=False)
        return
    chain = filters.FilterChain()
    for name in FILTERS:
        if getattr(o, name) is not None:
            chain.add(name, getattr(o, name))
    marked = variants
    if o.maf is not None or o.missing is not None:
        marked = marked.join(found.select("variant_id", "maf", "missing_genotypes"), "variant_id").withColumn("n_samples", F.lit(names.count()))
    if o.mendel is not None:
        errors = stats.mendel_errors(calls, cohort.nuclear_families(ped), variants).where("code > 0").groupBy("variant_id").agg(F.count("*").alias("mendel_errors"))
        marked = marked.join(errors, "variant_id", "left")
    if o.inh_dom is not None or o.inh_rec is not None:
        marked = marked.join(stats.inheritance(calls, ped), "variant_id", "left")
    marked = chain.mark(marked)
    if o.gene:
        inside = annotate.of_genes(place.select("variant_id"), annotation, o.gene.split(",")).withColumn("of_gene", F.lit(True))
        marked = marked.join(inside, "variant_id", "left").withColumn("passed", F.col("passed") & F.col("of_gene").isNotNull())
    regions = tables.read_regions(spark, o.region_file, o.region_type) if o.region_file else None
    if o.region or regions is not None:
        inside = filters.in_regions(variants, filters.parse_regions(o.region or ""), regions).select("variant_id", F.lit(True).alias("inside"))
        marked = marked.join(inside, "variant_id", "left").withColumn("passed", F.col("passed") & F.col("inside").isNotNull())
    vcf.write_passed_and_rejected(marked, o.out, [*lines, *chain.headers()], columns)


def main(argv: list[str] | None = None) -> None:
    o = options(argv)
    run(SparkSession.builder.appName(f"genoframe {o.tool}").getOrCreate(), o)


if __name__ == "__main__":
    main()
