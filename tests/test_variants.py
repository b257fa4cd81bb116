"""Golden cases and the queries against SQL on a second engine."""

import math

import duckdb
import pytest

from genoframe.functions.genotype import code, coverage_label, info_map, info_text, mendel_code
from genoframe.functions.mathx import chi_square_p, fisher_two_sided
from genoframe.operators import filters, gwas, mdr, merge, stats
from genoframe.operators.registry import ORACLES, QUERIES
from genoframe.__main__ import options, run
from genoframe.sources import cohort, tables, vcf
from genoframe.streaming import filters as stream_filters
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


MENDEL = [((0, 0, 0, 1, 0, 1), "1", 1, 0), ((0, 0, 0, 0, 0, 1), "1", 1, 1), ((1, 1, 1, 1, 0, 1), "1", 1, 2), ((0, 1, 1, 1, 0, 0), "1", 1, 3), ((1, 1, 0, 1, 0, 0), "1", 1, 4), ((1, 1, 1, 1, 0, 0), "1", 1, 5), ((0, 0, 0, 1, 1, 1), "1", 1, 6), ((0, 1, 0, 0, 1, 1), "1", 1, 7), ((0, 0, 0, 0, 1, 1), "1", 1, 8), ((0, 1, 0, 0, 1, 1), "X", 1, 9), ((0, 1, 1, 1, 0, 0), "X", 1, 10), ((0, 0, 0, 1, 1, 1), "X", 2, 6)]


def test_mendelian_codes(spark):
    rows = [(*g, c, s, want) for g, c, s, want in MENDEL]
    df = spark.createDataFrame(rows, "f1 int, f2 int, m1 int, m2 int, c1 int, c2 int, chrom string, sex int, want int")
    got = df.select("want", mendel_code(*(F.col(c) for c in ("chrom", "f1", "f2", "m1", "m2", "c1", "c2", "sex"))).alias("code")).collect()
    assert all(r["want"] == r["code"] for r in got), got


# father, mother, child, condition of the child, expected transmissions
TRIOS = [((0, 1), (0, 1), (0, 0), 1, 0, 0), ((0, 1), (0, 1), (0, 0), 2, 2, 0), ((0, 1), (0, 0), (0, 0), 2, 1, 0), ((0, 1), (0, 1), (0, 1), 2, 1, 1), ((0, 1), (0, 0), (0, 1), 2, 0, 1), ((0, 1), (1, 1), (0, 1), 2, 1, 0), ((0, 0), (0, 1), (0, 1), 2, 0, 1), ((1, 1), (0, 1), (0, 1), 2, 1, 0)]


def test_tdt_goldens(spark):
    calls, variants = [], []
    for k, (f, m, c, _, _, _) in enumerate(TRIOS):
        variants.append((k, "1"))
        calls += [(k, 3 * k + j, *g) for j, g in enumerate((f, m, c))]
    ped = [(3 * k + j, k, j, 1 if j != 1 else 2, t[3] if j == 2 else 1) for k, t in enumerate(TRIOS) for j in range(3)]
    got = gwas.tdt(spark.createDataFrame(variants, "variant_id long, chrom string"), spark.createDataFrame(calls, "variant_id long, sample_id long, a1 int, a2 int"), spark.createDataFrame(ped, "sample_id long, family_id long, role long, sex long, condition int")).collect()
    assert {r["variant_id"]: (r["t1"], r["t2"]) for r in got} == {k: t[4:] for k, t in enumerate(TRIOS)}
    assert next(r for r in got if r["variant_id"] == 0)["chisq"] == -1


@pytest.mark.parametrize(("cases", "controls", "k"), [(200, 200, 10), (150, 250, 4), (50, 75, 7), (8, 12, 8), (8, 12, 10), (16, 4, 5), (16, 4, 10)])
def test_fold_sizes(spark, cases, controls, k):
    ped = spark.createDataFrame([(i, 2 if i < cases else 1) for i in range(cases + controls)], "sample_id long, condition int")
    got = mdr.folds(ped, k).groupBy("condition", "fold").count().collect()
    for cond, n in ((2, cases), (1, controls)):
        sizes = [r["count"] for r in got if r["condition"] == cond]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and len(sizes) == min(k, n)


def test_high_risk_and_evaluation(spark):
    rows = [(8, 40), (4, 75), (9, 20), (8, 63), (0, 0)]
    got = spark.createDataFrame(rows, "a long, b long").select(mdr.high_risk(F.col("a"), F.col("b"), F.lit(10), F.lit(80)).alias("r")).collect()
    assert [r["r"] for r in got] == [True, False, True, True, False]
    m = spark.createDataFrame([(40, 2, 4, 10), (20, 10, 10, 20)], "tp long, fn long, fp long, tn long")
    ba = [r["accuracy"] for r in mdr.evaluated(m).collect()]
    assert ba == [pytest.approx((40 / 42 + 10 / 14) / 2, abs=1e-6), pytest.approx(2 / 3, abs=1e-6)]


def test_order_three_counts_against_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    codes = {v: [r.choice([None, 0, 1, 2]) for _ in range(10)] for v in range(5)}
    maps = spark.createDataFrame([(v, *(sum(1 << s for s, x in enumerate(c) if x == k) for k in range(3))) for v, c in codes.items()], "variant_id long, m0 long, m1 long, m2 long")
    ped = spark.createDataFrame([(s, 2 if s < 4 else 1) for s in range(10)], "sample_id long, condition int")
    dealt = {x["sample_id"]: x["fold"] for x in mdr.folds(ped, 2).collect()}
    got = {(x["v0"], x["v1"], x["v2"], x["fold"], x["cell"]): (x["cases"], x["controls"]) for x in mdr.fold_counts(maps, mdr.fold_masks(mdr.folds(ped, 2)), 3).collect()}
    for combo in itertools.combinations(range(5), 3):
        for fold in range(2):
            for cell in mdr.cells(3):
                own = [s for s in range(10) if dealt[s] != fold and all(codes[v][s] == c for v, c in zip(combo, cell, strict=True))]
                assert got[(*combo, fold, "".join(map(str, cell)))] == (sum(s < 4 for s in own), sum(s >= 4 for s in own))
    assert len(got) == 10 * 2 * 27


def test_statistics_functions(spark):
    row = spark.createDataFrame([(3.8414588206941, 8, 2, 1, 5)], "x double, a long, b long, c long, d long").select(chi_square_p(F.col("x")).alias("p"), fisher_two_sided(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 40).alias("f")).first()
    assert row["p"] == pytest.approx(0.05, abs=1e-6) and row["f"] == pytest.approx(0.034965, abs=1e-5)


def test_genotypes_info_and_labels(spark):
    df = spark.createDataFrame([(0, 0, "DP=3;H2;DP=5", 20), (0, 1, ".", None), (1, 2, "A=x=y", 500), (2, 2, "B=1", 0), (None, 1, "", 40)], "a1 int, a2 int, info string, dp int")
    got = df.select(code(F.col("a1"), F.col("a2")).alias("c"), info_text(info_map(F.col("info"))).alias("i"), coverage_label(F.col("dp"), [10, 20, 40]).alias("l")).collect()
    assert [r["c"] for r in got] == [0, 1, 1, 2, None] and [r["i"] for r in got] == ["DP=5;H2", ".", "A=x=y", "B=1", "."]
    assert [r["l"] for r in got] == ["coverage_10_20", "coverage_missing", "coverage_40_N", "coverage_0_10", "coverage_20_40"]


def test_merge_example(spark):
    records = spark.createDataFrame([(0, "1", 21111111111, "rs123456", "A", "T", 20.0, "PASS"), (1, "1", 21111111111, ".", "A", "G", 30.0, "STD_FILTER"), (2, "1", 21111111111, "rs654321", "A", "CT", 10.0, "q10"), (3, "1", 21111111111, ".", "A", "T", None, ".")], "file_idx int, chrom string, pos long, id string, ref string, alt string, qual double, filter string")
    files = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e"), (1, "f"), (2, "g"), (3, "h"), (3, "i")], "file_idx int, sample_id string")
    got = merge.positions(merge.grouped(records, files)).first()
    assert (got["alt"], round(got["qual"], 3), got["filter"], got["id"]) == ("T,G,CT", 17.778, "STD_FILTER;q10", "rs123456")
    fields = spark.createDataFrame([(["GT:GQ:DP:HQ", "GT:RD", "RD:HQ:GT:GQ", "GT"],)], "f array<string>")
    assert fields.select(merge.merged_format(F.col("f"))).first()[0] == "GT:GQ:DP:HQ:RD"


def test_merged_info_example(spark):
    """Four files, nine samples: depth, mapping quality and flags of the merged record; counts follow the genotypes."""
    records = spark.createDataFrame(
        [(0, 1, "1", 5, ".", "A", "T", 20.0, "PASS", "NS=3;DP=14;H2"), (1, 2, "1", 5, ".", "A", "G", 30.0, "q", "DP=10;XH3"), (2, 3, "1", 5, ".", "A", "CT", 10.0, "q10", "AF=0.5;DB"), (3, 4, "1", 5, ".", "A", "T", None, ".", None)],
        "file_idx int, variant_id long, chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string",
    )
    files = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e"), (1, "f"), (2, "g"), (3, "h"), (3, "i")], "file_idx int, sample_id string")
    calls = spark.createDataFrame(
        [(1, "a", 1, 1, 40, 20), (1, "b", 0, 1, 60, 10), (1, "c", 0, 0, 50, 30), (2, "d", 1, 1, None, None), (2, "e", 0, 1, None, None), (2, "f", 0, 0, None, None), (3, "g", 1, 1, None, 30), (4, "h", 1, 1, None, None), (4, "i", 0, 1, None, None)],
        "variant_id long, sample_id string, a1 int, a2 int, dp int, gq int",
    )
    one = merge.grouped(records, files)
    found = merge.info_fields(one, merge.samples(records, one, calls, files, carried=("dp", "gq")))
    row = found.first()
    assert (row["ac"], row["an"], row["dp"], row["mq0"], row["ns"]) == ([6, 3, 2], 18, 150, 5, 9)
    assert (round(row["mq"], 3), round(row["qd"], 3)) == (15.986, 0.119) and [row[k] for k in ("db", "h2", "h3", "somatic")] == [True, True, False, False]
    assert found.select(merge.info_text(("DP", "H2", "H3", "MQ", "QD", "AC", "none"))).first()[0] == "DP=150;H2;MQ=15.986;QD=0.119;AC=6,3,2"
    assert found.select(merge.info_text(())).first()[0] == "."


def test_merged_counts_have_no_bound_on_alternates(spark):
    alternates = ["C", "G", "T", "AC", "AG", "AT"]
    records = spark.createDataFrame([(0, 1, "1", 5, ".", "A", ",".join(alternates), 1.0, ".")], "file_idx int, variant_id long, chrom string, pos long, id string, ref string, alt string, qual double, filter string")
    files = spark.createDataFrame([(0, "a"), (0, "b")], "file_idx int, sample_id string")
    calls = spark.createDataFrame([(1, "a", 6, 6), (1, "b", 5, None)], "variant_id long, sample_id string, a1 int, a2 int")
    one = merge.grouped(records, files)
    assert tuple(merge.recomputed_info(one, merge.samples(records, one, calls, files)).first()) == ("1", 5, "0,0,0,0,1,2", 3, 2)


VCF = "##fileformat=VCFv4.1\n##FILTER=<ID=q10>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n2\t5\trs1\tA\tT\t40\tPASS\tDP=50\tGT:DP\t0/1:3\t1|1:4\n1\t21111111111\t.\tAC\tA\t.\tq10\tDP=5;H2\tDP:GT\t3:./.\t4:0/0\n"


def test_vcf_round_trip_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.vcf").write_text(VCF)
    records = vcf.read_vcf(spark, f"{tmp_path}/in")
    long = {(r["pos"], r["sample_id"]): (r["a1"], r["a2"], r["phased"]) for r in vcf.genotypes(records, vcf.sample_names(spark, f"{tmp_path}/in")).collect()}
    assert long == {(5, "s1"): (0, 1, False), (5, "s2"): (1, 1, True), (21111111111, "s1"): (None, None, False), (21111111111, "s2"): (0, 0, False)}
    vcf.write_vcf(records, ["##fileformat=VCFv4.1"], ["s1", "s2"], f"{tmp_path}/out")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/out/records").collect()]
    assert sorted(lines) == sorted(VCF.splitlines()[3:])
    q = stream_filters.passed(vcf.stream_vcf(spark, f"{tmp_path}/in"), filters.FilterChain().add("quality", 30).add("coverage", 10)).writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert [r["pos"] for r in spark.table("kept").collect()] == [5]


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "f.ped").write_text("#family\nF1 s1 0 0 1 2\nF1\ts2\t0\t0\t2\t1\nF2 s3 s1 s2 1 9\n")
    assert [(r["sample_id"], r["condition"]) for r in tables.read_ped(spark, f"{tmp_path}/f.ped").collect()] == [("s1", 2), ("s2", 1), ("s3", None)]
    (tmp_path / "r.bed").write_text("1\t9\t20\texon\n2\t0\t5\tgene\n")
    assert [tuple(r) for r in tables.read_regions(spark, f"{tmp_path}/r.bed", "exon").collect()] == [("1", 10, 20, "exon")]
    codes = [[0, 1, None, 2], [2, 2, 1, 0]]
    (tmp_path / "d.bin").write_bytes(tables.epi_bytes(codes, 1))
    got = {(r["variant_idx"], r["sample_idx"]): (r["code"], r["affected"]) for r in tables.read_epi(spark, f"{tmp_path}/d.bin").collect()}
    assert got == {(v, s): (x, s < 1) for v, row in enumerate(codes) for s, x in enumerate(row)}
    assert filters.parse_regions("1:5-9,X:3,2") == [("1", 5, 9), ("X", 3, 3), ("2", 0, 1 << 62)]


ONE = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tdad\tmum\n1\t5\trs1\tA\tT\t40\tPASS\tDP=50;H2\tGT:DP:GQ\t0/1:3:10\t1|1:4:0\n2\t9\t.\tAC\tA\t.\tq10\tDP=5\tDP:GT\t3:0/0\t4:0/1\n"
TWO = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tkid\n1\t5\t.\tA\tG\t10\tPASS\tDP=7\tGT:DP\t0/1:5\n"


def test_command_line(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(ONE)
    (tmp_path / "b.vcf").write_text(TWO)
    (tmp_path / "f.ped").write_text("F dad 0 0 1 2\nF mum 0 0 2 1\n")
    a, b, out = (f"{tmp_path}/{x}" for x in ("a.vcf", "b.vcf", "out"))
    lines = lambda path: sorted(r["value"] for r in spark.read.text(path).collect())
    run(spark, options(["filter", "--vcf", a, "--out", f"{out}/f", "--quality", "30", "--region", "1:1-10"]))
    assert lines(f"{out}/f/filtered") == ONE.splitlines()[2:3] and lines(f"{out}/f/rejected") == ONE.splitlines()[3:]
    run(spark, options(["split", "--vcf", a, "--out", f"{out}/s"]))
    assert lines(f"{out}/s/records/part=chromosome_2") == ONE.splitlines()[3:] and lines(f"{out}/s/header") == sorted(ONE.splitlines()[:2])
    assert lines(f"{out}/f/header") == sorted([*ONE.splitlines()[:2], '##FILTER=<ID=quality,Description="Filter quality">'])
    run(spark, options(["filter", "--vcf", a, "--out", f"{out}/w", "--region", "2"]))
    assert lines(f"{out}/w/filtered") == ONE.splitlines()[3:] and lines(f"{out}/w/rejected") == ONE.splitlines()[2:3]
    run(spark, options(["merge", "--vcf", a, b, "--out", f"{out}/m", "--info-fields", "DP,H2,NS,AC"]))
    assert lines(f"{out}/m/records") == ["1\t5\trs1\tA\tT,G\t30\tPASS\tDP=12;H2;NS=3;AC=3,1\tGT:DP:GQ\t0/1:3:10\t1|1:4:0\t0/2:5:.", "2\t9\t.\tAC\tA\t0\tq10\tDP=7;NS=2;AC=1\tDP:GT\t3:0/0\t4:0/1\t.:./."]
    with pytest.raises(ValueError, match="more than one file"):
        run(spark, options(["merge", "--vcf", a, a.replace("a.vcf", "c.vcf"), "--out", f"{out}/x"])) if (tmp_path / "c.vcf").write_text(ONE) else None
    run(spark, options(["stats", "--vcf", a, "--out", f"{out}/t"]))
    assert {(r["pos"], r["c0"], r["c1"]) for r in spark.read.parquet(f"{out}/t").collect()} == {(5, 1, 3), (9, 3, 1)}
    run(spark, options(["assoc", "--vcf", a, "--ped", f"{tmp_path}/f.ped", "--out", f"{out}/g"]))
    assert {(r["pos"], r["a1_count"], r["u2_count"]) for r in spark.read.csv(f"{out}/g", sep="\t", header=True).collect()} == {("5", "1", "2"), ("9", "2", "1")}


def test_command_line_of_epistasis_annotation_and_families(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(ONE.replace("\tmum", "\tmum\tkid").replace("1|1:4:0", "1|1:4:0\t0/0:5:9").replace("4:0/1", "4:0/1\t6:0/0"))
    (tmp_path / "f.ped").write_text("#FID IID PID MID SEX TRAIT\nF dad 0 0 1 2\nF mum 0 0 2 1\nF kid dad mum 1 2\n")
    (tmp_path / "e.tsv").write_text("1\t5\tmissense_variant\t1583\tBRCA\trs7\n1\t5\tintron_variant\t1627\tBRCA\t\n")
    a, ped, ann, out = (f"{tmp_path}/{x}" for x in ("a.vcf", "f.ped", "e.tsv", "out"))
    lines = lambda path: sorted(r["value"] for r in spark.read.text(path).collect())
    run(spark, options(["vcf2epi", "--vcf", a, "--ped", ped, "--out", f"{out}/v", "--variable", "TRAIT"]))
    assert {(r["pos"], r["m0"], r["m1"], r["m2"]) for r in spark.read.parquet(f"{out}/v/genotypes").collect()} == {(5, 2, 1, 4), (9, 3, 4, 0)}
    run(spark, options(["epi", "--vcf", a, "--ped", ped, "--out", f"{out}/e", "--folds", "2", "--repetitions", "2"]))
    for k in (1, 2):
        assert f"#CROSS VALIDATION {k}" in lines(f"{out}/e/cross_validation_{k}") and len(lines(f"{out}/e/cross_validation_{k}")) == 6
    run(spark, options(["effect", "--vcf", a, "--annotation", ann, "--out", f"{out}/f", "--exclude", "intron_variant"]))
    assert lines(f"{out}/f/summary") == ["missense_variant\t1"] and lines(f"{out}/f/genes") == ["brca"] and len(lines(f"{out}/f/unprocessed")) == 1
    run(spark, options(["annot", "--vcf", a, "--annotation", ann, "--out", f"{out}/n"]))
    first = lines(f"{out}/n/records")[0].split("\t")
    assert (first[2], first[7]) == ("rs7", "DP=50;EFF=intron_variant,missense_variant;H2")
    run(spark, options(["aggregate", "--vcf", a, "--out", f"{out}/g"]))
    assert lines(f"{out}/g/records")[0] == "1\t5\trs1\tA\tT\t40\tPASS\tAGG_AC=3;AGG_AF=0.500;AGG_AN=6;AGG_GTC=0/0:1,0/1:1,1/1:1,./.:0;DP=50;H2"
    run(spark, options(["filter", "--vcf", a, "--ped", ped, "--annotation", ann, "--out", f"{out}/m", "--mendel", "0"]))
    assert [x[:3] for x in lines(f"{out}/m/filtered")] == ["2\t9"] and [x[:3] for x in lines(f"{out}/m/rejected")] == ["1\t5"]
    run(spark, options(["filter", "--vcf", a, "--annotation", ann, "--out", f"{out}/b", "--gene", "brca"]))
    assert [x[:3] for x in lines(f"{out}/b/filtered")] == ["1\t5"]
    with pytest.raises(ValueError, match="no column"):
        tables.read_ped(spark, ped, "HEIGHT")


def test_merged_samples_hold_all_fields(spark):
    """Genotypes in the merged alleles, phase kept; other fields carried; dots and the fill where a file or field is absent."""
    own = [(0, "T", "PASS", "NS=3;DP=14;H2", "GT:GQ:DP:HQ", ["1/1:20:40:30", "0/1:10:60:50", "0|0:30:50:70"]), (1, "G", "STD_FILTER", "DP=10", "GT:RD", ["1/1:40", "0/1:60", "0/0:50"]), (2, "CT", "q10", "AF=0.5", "RD:HQ:GT:GQ", ["20:40:1/1:30"]), (3, "T", ".", "DB;H2", "GT", ["1/1", "0/1"])]
    records = spark.createDataFrame([(f, "1", 5, ".", "A", alt, 1.0, flt, info, fmt, s) for f, alt, flt, info, fmt, s in own], "file_idx int, chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, format string, samples array<string>")
    files = spark.createDataFrame([(f, f"{f}{k}") for f, *_, s in own for k in range(len(s))], "file_idx int, sample_id string")
    one = merge.grouped(records, files)
    row = merge.full_samples(one, files).first()
    want = ["1/1:20:40:30:.", "0/1:10:60:50:.", "0|0:30:50:70:.", "2/2:.:.:.:40", "0/2:.:.:.:60", "0/0:.:.:.:50", "3/3:30:.:40:20", "1/1:.:.:.:.", "0/1:.:.:.:."]
    assert row["format"] == "GT:GQ:DP:HQ:RD" and row["samples"] == want
    for k, options_ in ((2, {"copy_filter": True}), (3, {"copy_info": True})):
        last = [o[k] for o in own for _ in o[5]]
        assert merge.full_samples(one, files, **options_).first()["samples"] == [f"{x}:{y}" for x, y in zip(want, last, strict=True)]
    part = merge.full_samples(merge.grouped(records.where("file_idx in (0, 2)"), files), files, fill="0/0").first()["samples"]
    assert part == [*want[:3], *["0/0:.:.:.:."] * 3, "2/2:30:.:40:20", *["0/0:.:.:.:."] * 2]


def test_regions_of_any_extent(spark):
    v = spark.createDataFrame([("1", 5), ("1", 20_000), ("1", 21_111_111_111), ("2", 7), ("X", 3), (None, 3)], "chrom string, pos long")
    found = lambda text, table=None: sorted((r["chrom"], r["pos"]) for r in filters.in_regions(v, filters.parse_regions(text), table).collect())
    assert found("2") == [("2", 7)] and found("1:20000-") == [("1", 20_000), ("1", 21_111_111_111)] and found("") == []
    assert found("1:5,X:1-9,1:1-6") == [("1", 5), ("X", 3)] and found("1,1:5") == [("1", 5), ("1", 20_000), ("1", 21_111_111_111)]
    assert found("2", spark.createDataFrame([("X", 1, 4), ("2", 1, 9)], "chrom string, start_pos long, end_pos long")) == [("2", 7), ("X", 3)]


def test_cheap_filters_go_below_the_join(spark, capsys):
    v = spark.range(9).selectExpr("id as variant_id", "id as dp", "double(id) as qual")
    s = spark.range(9).selectExpr("id as variant_id", "id / 10 as maf")
    filters.FilterChain().add("maf", 0.2).add("quality", 4).passed(v.join(s, "variant_id")).explain()
    plan = capsys.readouterr().out
    join = plan[plan.index("Join") :]
    assert "4.0" not in join.splitlines()[0] and "4.0" in join
    marked = filters.FilterChain().add("quality", 4).mark(v.withColumn("qual", F.when(F.col("dp") > 2, F.col("qual"))))
    assert marked.where("passed is null").count() == 0 and marked.where("not passed").count() == 4


def test_epistasis_of_more_samples_than_a_word_has(spark):
    """150 named samples take three words: counts, ranking, repetitions and report against plain Python."""
    import itertools
    import random

    r = random.Random(2)
    n, order, k = 150, 2, 3
    alleles = {v: [r.choice([(None, None), (0, 0), (0, 1), (1, 1)]) for _ in range(n)] for v in range(4)}
    codes = {v: [None if a is None else 1 if a != b else 2 * (a > 0) for a, b in g] for v, g in alleles.items()}
    ids = [f"s{x:03}" for x in range(n)]
    ped = spark.createDataFrame([(s, 2 if x % 3 == 0 else 1) for x, s in enumerate(ids)], "sample_id string, condition int")
    calls = spark.createDataFrame([(v, ids[x], *g) for v, row in alleles.items() for x, g in enumerate(row)], "variant_id long, sample_id string, a1 int, a2 int")
    maps = mdr.bitmaps(calls, ped)
    assert maps.columns == ["variant_id", *[f"m{c}{w}" for c in range(3) for w in ("", "_w1", "_w2")]]
    folds = mdr.folds(ped, k)
    dealt = {int(x["sample_id"][1:]): x["fold"] for x in folds.collect()}
    masks = mdr.fold_masks(folds)
    got = {(x["v0"], x["v1"], x["fold"], x["cell"]): (x["cases"], x["controls"]) for x in mdr.fold_counts(maps, masks, order).collect()}
    assert len(got) == 6 * k * 9
    for pair in itertools.combinations(range(4), 2):
        for fold in range(k):
            for cell in mdr.cells(2):
                own = [x for x in range(n) if dealt[x] != fold and all(codes[v][x] == c for v, c in zip(pair, cell, strict=True))]
                assert got[(*pair, fold, "".join(map(str, cell)))] == (sum(x % 3 == 0 for x in own), sum(x % 3 > 0 for x in own))
    first, second = mdr.cross_validations(calls, ped, order, k, 3, 2)
    rows = first.collect()
    assert len(rows) == 3 and rows != second.collect() and all(x["risky"] and x["cv_count"] <= k for x in rows)
    lines = mdr.report(first, order)
    cells = "".join(f"({c[0]}-{c[1]}), " for c in rows[0]["risky"].split(","))
    assert lines[0] == "#CROSS VALIDATION 1" and lines[5] == f"1\t( {rows[0]['v0']}, {rows[0]['v1']} )\t{cells}{rows[0]['cv_count']}\t{rows[0]['cv_accuracy']:.3f}" and len(lines) == 8


def test_statistics_of_any_number_of_alternates(spark):
    variants = spark.createDataFrame([(1, 13, None), (2, 2, "AC=9;H2")], "variant_id long, n_alleles int, info string")
    calls = spark.createDataFrame([(1, 1, 12, 12), (1, 2, 0, 11), (1, 3, None, 5), (2, 1, 0, 1)], "variant_id long, sample_id long, a1 int, a2 int")
    found = stats.variant_stats(variants, calls, 4)
    row = found.where("variant_id = 1").first()
    assert (row["c12"], row["c11"], row["c5"], row["an"], row["g12_12"], row["g0_11"], row["called"], row["missing_genotypes"], row["maf"]) == (2, 1, 1, 5, 1, 1, 2, 2, 0.0)
    info = {r["variant_id"]: r["info"] for r in stats.aggregate_info(variants, found, overwrite=True).collect()}
    assert info[2] == "AC=1;AF=0.500;AN=2;GTC=0/0:0,0/1:1,1/1:0,./.:3;H2"
    assert info[1].startswith("AC=0,0,0,0,1,0,0,0,0,0,1,2;AF=0.000,") and ",0/11:1," in info[1] and info[1].endswith(",12/12:1,./.:2")


def test_generations_become_nuclear_families(spark):
    rows = [("F", "gd", "0", "0", "1", 1), ("F", "gm", "0", "0", "2", 1), ("F", "dad", "gd", "gm", "1", 2), ("F", "mum", "0", "0", "2", 1), ("F", "k1", "dad", "mum", "1", 2), ("F", "k2", "dad", "mum", "2", 1), ("F", "lost", "dad", "gone", "1", 2), ("G", "k1", "dad", "mum", "1", 2)]
    ped = spark.createDataFrame(rows, "family_id string, sample_id string, father_id string, mother_id string, sex string, condition int")
    got = sorted((r["family_id"], r["role"], r["sample_id"], r["sex"], r["condition"]) for r in cohort.nuclear_families(ped).collect())
    assert got == [("F:dad:mum", 0, "dad", 1, 2), ("F:dad:mum", 1, "mum", 2, 1), ("F:dad:mum", 2, "k1", 1, 2), ("F:dad:mum", 2, "k2", 2, 1), ("F:gd:gm", 0, "gd", 1, 1), ("F:gd:gm", 1, "gm", 2, 1), ("F:gd:gm", 2, "dad", 1, 2)]


def test_sam_text(spark, tmp_path):
    (tmp_path / "s1.sam").write_text("@HD\tVN:1\nr1\t0\t1\t100\t60\t5S10M2I3D5M\t*\t0\t0\tA\tB\nr2\t4\t1\t100\t0\t10M\t*\t0\t0\tA\tB\nr3\t0\t*\t0\t0\t*\t*\t0\t0\tA\tB\n")
    assert [tuple(r) for r in cohort.read_sam(spark, f"{tmp_path}/s1.sam").collect()] == [("s1", "1", 100, 117)]
