"""Merging records of several files by position: one shuffle on (chrom, pos), then array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.functions.genotype import alts
from genoframe.functions.mathx import div


def grouped(records: DataFrame, file_samples: DataFrame, strict: bool = False) -> DataFrame:
    """A row a position: its records in file order (of one file the first), without positions whose REFs disagree.

    strict: all REFs are equal. Tolerant: all have one first base."""
    sizes = file_samples.groupBy("file_idx").agg(F.count("*").alias("n"))
    rows = records.join(F.broadcast(sizes), "file_idx")  # a row for each file
    info = F.col("info") if "info" in records.columns else F.lit(None).cast("string").alias("info")
    texts = [c for c in ("format", "samples") if c in records.columns]
    one = rows.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("file_idx", "id", "ref", "alt", "qual", "filter", "n", info, *texts))).alias("r"))
    text = (lambda x: x["ref"]) if strict else (lambda x: F.substring(x["ref"], 1, 1))
    return one.where(F.size(F.array_distinct(F.transform("r", text))) == 1)


def allele_table(r: Column) -> Column:
    """REF of the first record, then per file its REF and its alternates where they are new, upper and lower case alike."""
    every = F.flatten(F.transform(r, lambda x: F.concat(F.array(x["ref"]), alts(x["alt"]))))
    known = F.filter(every, lambda a: a != ".")
    return F.filter(known, lambda a, i: F.array_position(F.transform(known, lambda b: F.lower(b)), F.lower(a)) == i + 1)


def merged_id(r: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(r, lambda x: x["id"]), lambda i: i != "."), F.lit(1)), F.lit("."))


def merged_quality(r: Column) -> Column:
    """Mean of positive qualities weighted by samples, over the samples of all files with the position; -1 without samples."""
    part = lambda x: F.when(x["qual"] > 0, x["qual"] * x["n"]).otherwise(0.0)
    total = F.aggregate(r, F.lit(0.0), lambda s, x: s + part(x))
    n = F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return F.round(F.coalesce(div(total, n), F.lit(-1.0)), 6)


def merged_filter(r: Column) -> Column:
    """All failed filters in order of appearance; else PASS where any record passed; else '.'."""
    every = F.flatten(F.transform(r, lambda x: F.split(x["filter"], ";")))
    failed = F.array_distinct(F.filter(every, lambda f: ~f.isin("PASS", ".")))
    return F.when(F.size(failed) > 0, F.array_join(failed, ";")).when(F.array_contains(every, "PASS"), "PASS").otherwise(".")


def merged_format(formats: Column, copy_filter: bool = False, copy_info: bool = False) -> Column:
    """Fields of all FORMATs in order of appearance, then SFT and IN where filters and INFO are copied."""
    extra = [F.lit(x) for x, wanted in (("SFT", copy_filter), ("IN", copy_info)) if wanted]
    union = F.array_distinct(F.flatten(F.transform(formats, lambda f: F.split(f, ":"))))
    return F.array_join(F.concat(union, F.array(*extra)) if extra else union, ":")


def positions(one: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row a position with the merged fixed columns, and the carried columns of one."""
    table = allele_table(F.col("r"))
    alternates = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))
    return one.select(
        "chrom", "pos", F.size("r").cast("long").alias("n_files"), merged_id(F.col("r")).alias("id"), F.element_at(table, 1).alias("ref"),
        F.when(F.size(table) > 1, F.array_join(alternates, ",")).otherwise(".").alias("alt"), merged_quality(F.col("r")).alias("qual"), merged_filter(F.col("r")).alias("filter"), *carried,
    )


def samples(records: DataFrame, one: DataFrame, calls: DataFrame, file_samples: DataFrame, fill: str = "./.", strict: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, pos, sample_id, gt) for every kept position and every sample of every file, in the merged allele table, and the carried columns of calls.

    Files without the position give fill ('./.' missing, '0/0' reference). A tolerant 0 is the file's own REF."""
    table = F.transform(allele_table(F.col("r")), lambda a: F.lower(a))
    kept = one.select("chrom", "pos", table.alias("table"))
    every = kept.crossJoin(F.broadcast(file_samples.select("file_idx", "sample_id")))  # each position needs each sample: the result itself
    there = records.select("chrom", "pos", "file_idx", "variant_id", "ref", "alt")
    joined = every.join(there, ["chrom", "pos", "file_idx"], "left").join(calls, ["variant_id", "sample_id"], "left")
    own = F.concat(F.array("ref"), alts(F.col("alt")))
    index = lambda a: F.when((F.lit(strict)) & (F.col(a) == 0), 0).otherwise(F.array_position("table", F.lower(F.try_element_at(own, (F.col(a) + 1).cast("int")))) - 1)
    text = lambda a: F.when(F.col(a).isNull() | (index(a) < 0) | index(a).isNull(), ".").otherwise(index(a).cast("int").cast("string"))
    gt = F.when(F.col("variant_id").isNull(), fill).when(F.col("a1").isNull() & F.col("a2").isNull(), "./.").otherwise(F.concat(text("a1"), F.lit("/"), text("a2")))
    return joined.select("chrom", "pos", "sample_id", gt.alias("gt"), *carried)


def full_samples(one: DataFrame, file_samples: DataFrame, fill: str = "./.", strict: bool = False, copy_filter: bool = False, copy_info: bool = False) -> DataFrame:
    """The rows of one with format, the union of its FORMATs, and samples, an array of whole sample texts in the order of files and columns.

    Genotypes are recoded to the merged allele table and keep their phase mark; other fields are carried, '.' where a record or sample
    lacks them. SFT and IN hold the record's filter and INFO. Files without the position give fill and dots. Each record's samples
    stay one array, so there is no row for each position and sample and no further join. The files (a row each) become a literal."""
    sizes = [(r["file_idx"], r["n"]) for r in file_samples.groupBy("file_idx").agg(F.count("*").alias("n")).orderBy("file_idx").collect()]
    every = F.array(*[F.struct(F.lit(f).cast("int").alias("file_idx"), F.lit(n).cast("int").alias("n")) for f, n in sizes])
    table = F.transform(allele_table(F.col("r")), lambda a: F.lower(a))
    rows = one.select("*", table.alias("table"), merged_format(F.transform("r", lambda x: x["format"]), copy_filter, copy_info).alias("format")).withColumn("fields", F.split("format", ":"))
    empty = F.array_join(F.transform("fields", lambda f: F.when(f == "GT", fill).otherwise(".")), ":")

    def place(own: Column, allele: Column) -> Column:
        """An allele's number in the merged table, as text."""
        k = F.array_position("table", F.lower(F.try_element_at(own, allele.try_cast("int") + 1))) - 1
        found = F.when(k >= 0, k.cast("string")).otherwise(".")
        return F.when(allele == "0", "0").otherwise(found) if strict else found

    def genotype(own: Column, text: Column) -> Column:
        alleles = F.split(text, r"[/|]")
        absent = F.coalesce(F.forall(alleles, lambda a: a == "."), F.lit(True))
        mark = F.when(F.contains(text, F.lit("|")), "|").otherwise("/")
        return F.when(absent, "./.").otherwise(F.concat(place(own, F.element_at(alleles, 1)), F.when(F.size(alleles) > 1, F.concat(mark, place(own, F.try_element_at(alleles, F.lit(2))))).otherwise("")))

    def recoded(x: Column) -> Column:
        names, own = F.split(x["format"], ":"), F.concat(F.array(x["ref"]), alts(x["alt"]))

        def text(sample: Column) -> Column:
            parts = F.split(sample, ":")
            value = lambda f: F.try_element_at(parts, F.nullif(F.array_position(names, f), F.lit(0)).cast("int"))
            one_field = lambda f: F.when(f == "GT", genotype(own, value(f)))
            copied = lambda f: one_field(f).when(F.lit(copy_filter) & (f == "SFT"), x["filter"]).when(F.lit(copy_info) & (f == "IN"), x["info"])
            return F.array_join(F.transform("fields", lambda f: F.coalesce(copied(f).otherwise(value(f)), F.lit("."))), ":")

        return F.transform(x["samples"], text)

    def of_file(f: Column) -> Column:
        record = F.filter("r", lambda x: x["file_idx"] == f["file_idx"])
        return F.when(F.size(record) > 0, recoded(F.element_at(record, 1))).otherwise(F.array_repeat(empty, f["n"]))

    return rows.withColumn("samples", F.flatten(F.transform(every, of_file))).drop("table", "fields")


def long_form(full: DataFrame) -> DataFrame:
    """(chrom, pos, gt, dp, gq), a row a sample of full_samples(), for info_fields()."""
    rows = full.select("chrom", "pos", F.split("format", ":").alias("f"), F.explode("samples").alias("s"))
    at = lambda name: F.try_element_at(F.split("s", ":"), F.nullif(F.array_position("f", name), F.lit(0)).cast("int"))
    return rows.select("chrom", "pos", F.coalesce(at("GT"), F.lit("./.")).alias("gt"), *[at(c).try_cast("long").alias(c.lower()) for c in ("DP", "GQ")])


#: Header lines of the fields that full_samples() can add.
FORMAT_LINES = {"SFT": '##FORMAT=<ID=SFT,Number=.,Type=String,Description="Filter of the record in its own file">', "IN": '##FORMAT=<ID=IN,Number=.,Type=String,Description="INFO of the record in its own file">'}

#: INFO fields that a merge can write anew, and those of them that are flags.
INFO_FIELDS = ("AC", "AF", "AN", "DB", "DP", "H2", "H3", "MQ0", "MQ", "NS", "QD", "SOMATIC", "VALIDATED")
INFO_FLAGS = ("DB", "H2", "H3", "SOMATIC", "VALIDATED")


def has_flag(r: Column, key: str) -> Column:
    """Whether the INFO of any record has the key, as a flag or with a value."""
    return F.exists(r, lambda x: F.coalesce(F.array_contains(F.transform(F.split(x["info"], ";"), lambda e: F.substring_index(e, "=", 1)), key), F.lit(False)))


def info_fields(one: DataFrame, merged: DataFrame, fill: str = "./.") -> DataFrame:
    """A row a position with the recomputed INFO fields as columns.

    ac, af: count of each alternate and its share of all called alleles (an). dp: sum of the samples' depths. mq: root mean square of
    their qualities gq over all samples; mq0: samples without one or with zero. ns: samples that aren't empty (fill, and nothing carried).
    qd: quality by depth, null without depth. Samples are first counted by genotype, so a position's rows meet as a few counts."""
    extra = [c for c in ("dp", "gq") if c in merged.columns]
    dp, gq = (F.col(c) if c in extra else F.lit(None).cast("long") for c in ("dp", "gq"))
    empty = (F.col("gt") == fill) & dp.isNull() & gq.isNull()
    total = lambda c: F.sum(c.cast("long"))
    by = merged.groupBy("chrom", "pos", "gt").agg(F.count("*").alias("n"), total(dp).alias("dp"), total(gq * gq).alias("squares"), total(F.coalesce(gq == 0, F.lit(True))).alias("mq0"), total(~empty).alias("ns"))
    per = by.groupBy("chrom", "pos").agg(
        F.collect_list(F.struct(F.split("gt", "[/|]").alias("alleles"), "n")).alias("gts"), F.sum("n").alias("n_samples"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("dp", "squares", "mq0", "ns")],
    )
    counted = lambda wanted: F.aggregate("gts", F.lit(0).cast("long"), lambda s, g: s + g["n"] * F.size(F.filter(g["alleles"], wanted)))
    flags = one.select("chrom", "pos", *[has_flag(F.col("r"), k).alias(k.lower()) for k in INFO_FLAGS])
    out = positions(one).select("chrom", "pos", "alt", "qual").join(flags, ["chrom", "pos"]).join(per, ["chrom", "pos"], "left")
    number = F.transform(alts(F.col("alt")), lambda a, i: (i + 1).cast("string"))
    out = out.withColumn("ac", F.transform(number, lambda k: F.coalesce(counted(lambda a: a == k), F.lit(0)))).withColumn("an", F.coalesce(counted(lambda a: a != "."), F.lit(0)))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("dp", "mq0", "ns")}
    return out.select(
        "chrom", "pos", "ac", F.transform("ac", lambda x: div(x.cast("double"), F.col("an"))).alias("af"), "an", zero["dp"], F.sqrt(div(F.col("squares").cast("double"), F.col("n_samples"))).alias("mq"), zero["mq0"], zero["ns"],
        div(F.col("qual"), F.coalesce("dp", F.lit(0))).alias("qd"), *[k.lower() for k in INFO_FLAGS],
    )


def info_text(fields: tuple[str, ...] = INFO_FIELDS) -> Column:
    """The INFO text of a row of info_fields(), in the order asked for; unknown fields and those without a value are left out, nothing is '.'."""
    three = lambda c: F.format_string("%.3f", c)
    made = {k: F.when(F.col(k.lower()), k) for k in INFO_FLAGS}
    made |= {k: F.concat(F.lit(f"{k}="), F.col(k.lower()).cast("string")) for k in ("AN", "DP", "MQ0", "NS")}
    made |= {k: F.when(F.col(k.lower()).isNotNull(), F.concat(F.lit(f"{k}="), three(F.col(k.lower())))) for k in ("MQ", "QD")}
    made["AC"] = F.when(F.size("ac") > 0, F.concat(F.lit("AC="), F.array_join(F.col("ac").cast("array<string>"), ",")))
    made["AF"] = F.when((F.size("ac") > 0) & (F.col("an") > 0), F.concat(F.lit("AF="), F.array_join(F.transform("af", three), ",")))
    text = F.concat_ws(";", *[made[k] for k in fields if k in made])
    return F.when(text == "", ".").otherwise(text)


def recomputed_info(one: DataFrame, merged: DataFrame) -> DataFrame:
    """AC (as text), AN and NS of merged genotypes."""
    return info_fields(one, merged).select("chrom", "pos", F.array_join(F.col("ac").cast("array<string>"), ",").alias("ac"), "an", "ns")


def merged_headers(headers: DataFrame) -> DataFrame:
    """First occurrence of each (kind, text) over files in order."""
    first = headers.groupBy("kind", "text").agg(F.min(F.struct("file_idx", "ord")).alias("at"))
    return first.select("kind", "text", F.col("at.file_idx").alias("file_idx"), F.col("at.ord").alias("ord"))


def repeated_samples(file_samples: DataFrame) -> DataFrame:
    """Sample names that occur in more than one file; a merge must not have any."""
    return file_samples.groupBy("sample_id").agg(F.count("*").alias("n")).where("n > 1")
