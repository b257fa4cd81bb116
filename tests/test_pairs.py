"""Pairs of variants, many at once, against the operators that make a row for each pair."""

import random

import numpy as np
import pytest
from genoframe.operators import mdr, pairs
from pyspark.sql import functions as F


def cohort(spark, n, variants, seed, copies=1):
    """Calls (copies: of so many variants in turn the genotypes are the same) and a pedigree of n samples."""
    r = random.Random(seed)
    rows = [[r.choice([(None, None), (0, 0), (0, 1), (1, 1)]) for _ in range(n)] for _ in range(variants // copies)]
    calls = [(7 * v - 20, s, *g) for v in range(variants) for s, g in enumerate(rows[(v * 5) % len(rows)])]
    ped = spark.createDataFrame([(s, 2 if s % 3 == 0 else 1) for s in range(n)], "sample_id long, condition int")
    return spark.createDataFrame(calls, "variant_id long, sample_id long, a1 int, a2 int"), ped


@pytest.mark.parametrize("n", [9, 70])
def test_pair_counts_of_one_pass(spark, n):
    calls, ped = cohort(spark, n, 40, 3)
    maps, masks = mdr.bitmaps(calls, ped), mdr.fold_masks(mdr.folds(ped, 3))
    want = {(r["fold"], r["cell"]): (r["n"], r["cases"], r["controls"]) for r in mdr.fold_counts(maps, masks, 2).groupBy("fold", "cell").agg(F.count("*").alias("n"), F.sum("cases").alias("cases"), F.sum("controls").alias("controls")).collect()}
    found = pairs.pair_counts(maps, masks)
    assert len(want) == 27
    got = {(r["fold"], f"{a}{b}"): (r["n"], r[f"cases_{a}{b}"], r[f"controls_{a}{b}"]) for r in found.collect() for a, b in mdr.cells(2)}
    assert got == want
    assert pairs.pair_counts(maps.limit(1), masks).collect() == []


def test_pair_counts_join_no_variants(spark):
    """Many variants take a scan: no join has a row for each pair."""
    maps = spark.range(200_000).selectExpr("id as variant_id", "id % 7 as m0", "(7 - id % 7) & ~(id % 7) as m1", "0L as m2")
    masks = spark.createDataFrame([(0, 3, 4)], "fold long, train_cases long, train_controls long")
    row = pairs.pair_counts(maps, masks).first()
    assert row["n"] == 200_000 * 199_999 // 2 and row["cases_22"] == 0 and row["cases_00"] > 0


@pytest.fixture(scope="module", params=[(24, 30, 1, 4), (9, 45, 3, 3), (12, 40, 40, 5), (30, 8, 2, 2)])
def judged(spark, request):
    """Bitmaps and masks, also with a sample of neither class; more samples than a table takes in the last."""
    n, variants, copies, k = request.param
    calls, ped = cohort(spark, n, variants, 7, copies)
    ped = ped.withColumn("condition", F.when(F.col("sample_id") == 4, 0).otherwise(F.col("condition")).cast("int"))
    return mdr.bitmaps(calls, ped).localCheckpoint(), mdr.fold_masks(mdr.folds(ped.where("condition > 0"), k).unionByName(ped.where("condition = 0").withColumn("fold", F.lit(0).cast("long")))).localCheckpoint()


@pytest.mark.parametrize("partition", ["train", "test"])
def test_confusions_of_classes(judged, partition):
    maps, masks = judged
    cols = ["fold", "tp", "fn", "fp", "tn"]
    want = mdr.models(maps, masks, 2, partition).groupBy(*cols).count().collect()
    got = pairs.confusions(maps, masks, partition).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_evaluations_make_no_pairs(spark):
    """epi_eval's plan has no join of variants by an inequality."""
    from genoframe.operators.registry import QUERIES

    plan = QUERIES["epi_eval"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_id" in plan and not any("Join" in line and "<" in line for line in plan.splitlines())


def test_risky_cells_of_classes(judged):
    maps, masks = judged
    want = mdr.models(maps, masks, 2).groupBy("fold", "risky").count().collect()
    got = pairs.risky_cells(maps, masks).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


@pytest.mark.parametrize(("evaluation", "partition", "top"), [("BA", "train", 5), ("GAMMA", "test", 40)])
def test_best_models_of_classes(judged, evaluation, partition, top):
    maps, masks = judged
    want = mdr.ranked(mdr.evaluated(mdr.models(maps, masks, 2, partition), evaluation), 2, 3, top)
    assert mdr.ranked(pairs.best_models(maps, masks, top, evaluation, partition), 2, 3, top).collect() == want.collect()


def test_ranking_by_count_through_cross_validations(spark):
    calls, ped = cohort(spark, 20, 36, 11, copies=2)
    found = mdr.cross_validations(calls, ped, 2, 3, 4, 2, "count")
    maps = mdr.bitmaps(calls, ped)
    for r, ranking in enumerate(found):
        masks = mdr.fold_masks(mdr.folds(ped, 3, 2654435761 + 7368787 * r))
        assert ranking.collect() == mdr.ranked(mdr.evaluated(mdr.models(maps, masks, 2)), 2, 3, 4, "count").collect()
        assert not any("Join" in line and "variant_id" in line and "<" in line for line in ranking._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize(("missing", "evaluation", "most"), [(0.36, "BA", 0.05), (0.36, "GAMMA", 1), (0, "BA", 1)])
def test_ranking_passes_over_pairs_that_cannot_be_best(spark, monkeypatch, missing, evaluation, most):
    """Pairs compared, as a share of a tile, and the best pairs against all pairs; where all samples are called, each pair is compared once for all folds."""
    r, top, n = np.random.default_rng(5), 20, 1200
    codes = np.where(r.random((n, 24)) < missing, 3, r.choice(3, (n, 24), p=[0.27, 0.51, 0.22]))
    m = [((codes == k) << np.arange(24)).sum(axis=1) for k in range(3)]
    ids = r.permutation(n) * 3
    cases, controls, rows = 0x555555, 0xAAAAAA, []
    for f in range(4):
        test = 0x3F << 6 * f
        rows.append({"fold": f, "cases": cases, "controls": controls, "train_cases": cases & ~test, "train_controls": controls & ~test})
    groups = pairs._groups(rows, "confusion")
    levels = pairs._levels(spark.range(1), rows, groups, evaluation, "train")
    variants = list(zip(*(x.tolist() for x in (ids, *m)), strict=True))
    bars = pairs._bars(variants[:300], cases | controls, groups, levels, top)
    compared, values = [], pairs._values
    monkeypatch.setattr(pairs, "_values", lambda p, q, *a: compared.append(p.n * q.n) or values(p, q, *a))
    found = [x for b in pairs._bests(groups, levels, top, bars)(pairs._one_block(variants, cases | controls, len(groups))) for x in b.to_pylist()]
    assert sum(compared) <= most * n * n
    a, b = np.triu_indices(n, 1)
    for k, row in enumerate(rows):
        tp, fp = np.zeros((2, len(a)), np.int64)
        for i, j in mdr.cells(2):
            c, u = (np.bitwise_count(m[i][a] & m[j][b] & row[f"train_{x}"]).astype(np.int64) for x in ("cases", "controls"))
            risky = (c + u > 0) & (c >= u)
            tp, fp = tp + c * risky, fp + u * risky
        level = levels[0][k][tp << groups[0][5][k][5] | fp]
        want = sorted(zip(level.tolist(), np.minimum(ids[a], ids[b]).tolist(), np.maximum(ids[a], ids[b]).tolist(), strict=True))[:top]
        assert [(x["level"], x["a"], x["b"]) for x in found if x["fold"] == k and not x["alone"]] == want


@pytest.mark.parametrize("seeds", [2, 40])
def test_ranking_with_few_seeds(spark, monkeypatch, seeds):
    """Whatever the first pairs are, also too few for a bar, the ranking is that over all pairs; one variant has no pairs."""
    monkeypatch.setattr(pairs, "SEEDS", seeds)
    calls, ped = cohort(spark, 22, 60, 13, copies=2)
    maps, masks = mdr.bitmaps(calls, ped).localCheckpoint(), mdr.fold_masks(mdr.folds(ped, 3)).localCheckpoint()
    want = mdr.ranked(mdr.evaluated(mdr.models(maps, masks, 2)), 2, 3, 6, "count").collect()
    assert mdr.ranked(pairs.best_models(maps, masks, 6), 2, 3, 6, "count").collect() == want
    assert pairs.best_models(maps.limit(1), masks, 6).collect() == []
