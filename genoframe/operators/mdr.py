"""Epistasis by multifactor dimensionality reduction: bitmaps, folds, counts, risk, ranking.

A variant's genotype codes are bitmaps over samples; a cell of a combination is the AND of bitmaps, its size a
bit count. A bitmap has a 64-bit column for each 64 samples: m0, then m0_w1, m0_w2, ... (word()), so that counting stays generated
code at any number of samples; plans grow with samples / 64. A sample's place is that among the pedigree's samples in order
of sample_id, a number or a name.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoframe.functions.genotype import code
from genoframe.functions.mathx import div


WORD = 64


def word(name: str, w: int) -> str:
    """The column of a bitmap's w-th word."""
    return name if w == 0 else f"{name}_w{w}"


def n_words(ped: DataFrame) -> int:
    """Words that the pedigree's samples take; counts the pedigree."""
    return max(1, -(-ped.count() // WORD))


def words_of(df: DataFrame, name: str) -> int:
    """Words that a bitmap of a table has."""
    w = 1
    while word(name, w) in df.columns:
        w += 1
    return w


def with_bits(ped: DataFrame) -> DataFrame:
    """ped with each sample's word and bit. The window over all rows is over a pedigree's samples, one row each."""
    place = (F.row_number().over(Window.orderBy("sample_id")) - 1).cast("int")
    return ped.withColumn("place", place).withColumn("word", F.floor(F.col("place") / WORD).cast("int")).withColumn("bit", F.expr(f"shiftleft(1L, place % {WORD})")).drop("place")


def _mask(where: Column, name: str, words: int) -> list[Column]:
    """A bitmap of the rows that meet a condition, word by word."""
    return [F.coalesce(F.bit_or(F.when(where & (F.col("word") == w), F.col("bit"))), F.lit(0)).cast("long").alias(word(name, w)) for w in range(words)]


def bitmaps(calls: DataFrame, ped: DataFrame, words: int | None = None) -> DataFrame:
    """variant_id and m0, m1, m2 (and further words): a sample's bit is set where it has that genotype code."""
    words = words or n_words(ped)
    x = calls.join(with_bits(ped.select("sample_id")), "sample_id").withColumn("code", code(F.col("a1"), F.col("a2")))
    return x.groupBy("variant_id").agg(*[c for k in range(3) for c in _mask(F.col("code") == k, f"m{k}", words)])


def folds(ped: DataFrame, k: int, salt: int = 2654435761, prime: int = 1000003) -> DataFrame:
    """(sample_id, condition, fold): each class in a seeded order, dealt round-robin. The order is a multiplicative hash,
    of names a hash with the salt."""
    named = ped.schema["sample_id"].dataType.typeName() == "string"
    order = [F.xxhash64("sample_id", F.lit(salt)) if named else (F.col("sample_id") * salt) % prime, F.col("sample_id")]
    place = F.row_number().over(Window.partitionBy("condition").orderBy(*order)) - 1
    return ped.select("sample_id", "condition", (place % k).cast("long").alias("fold"))


def fold_masks(dealt: DataFrame, words: int | None = None) -> DataFrame:
    """A row a fold: training and testing masks of cases and controls, and the class totals."""
    words = words or n_words(dealt)
    dealt = with_bits(dealt)
    side = lambda cond, name: _mask(F.col("condition") == cond, name, words)
    whole = dealt.agg(*side(2, "cases"), *side(1, "controls"))
    test = dealt.groupBy("fold").agg(*side(2, "test_cases"), *side(1, "test_controls"))
    both = test.crossJoin(F.broadcast(whole))  # a row for each fold, one for the whole
    train = {word(f"train_{c}", w): F.expr(f"{word(c, w)} & ~{word(f'test_{c}', w)}") for c in ("cases", "controls") for w in range(words)}
    return both.withColumns(train)


def combinations(maps: DataFrame, order: int) -> DataFrame:
    """All combinations i < j < ... of variants with their bitmaps, by an inequality self-join: C(n, order) rows are the operator's result."""
    words = words_of(maps, "m0")
    parts = [maps.select(F.col("variant_id").alias(f"v{k}"), *[F.col(word(f"m{c}", w)).alias(word(f"m{k}_{c}", w)) for c in range(3) for w in range(words)]) for k in range(order)]
    out = parts[0]
    for k, p in enumerate(parts[1:], 1):
        out = out.join(p, F.col(f"v{k - 1}") < F.col(f"v{k}"))
    return out


def cells(order: int) -> list[tuple[int, ...]]:
    return list(product(range(3), repeat=order))


def total(name: str, words: int) -> Column:
    """Samples of a bitmap."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(word(name, w))).cast("long") for w in range(words)])


def count(cell: tuple[int, ...], side: str, words: int = 1) -> Column:
    """Samples of a side in a combination's cell."""
    masks = [[*(f"m{k}_{c}" for k, c in enumerate(cell)), side]] * words
    both = [reduce(lambda a, b: a.bitwiseAND(b), [F.col(word(n, w)) for n in names]) for w, names in enumerate(masks)]
    return reduce(lambda a, b: a + b, [F.bit_count(m).cast("long") for m in both])


def fold_counts(maps: DataFrame, masks: DataFrame, order: int) -> DataFrame:
    """(v0.., fold, cell, cases, controls) on training samples; one row for each cell."""
    words = words_of(maps, "m0")
    rows = combinations(maps, order).crossJoin(F.broadcast(masks))  # a row for each fold
    each = F.array(*[F.struct(F.lit("".join(map(str, c))).alias("cell"), count(c, "train_cases", words).alias("cases"), count(c, "train_controls", words).alias("controls")) for c in cells(order)])
    return rows.select(*[f"v{k}" for k in range(order)], "fold", F.inline(each))


def high_risk(cases: Column, controls: Column, n_cases: Column, n_controls: Column) -> Column:
    """A cell isn't empty and its share of cases is that of controls at least, in whole numbers."""
    return (cases + controls > 0) & (cases * n_controls >= controls * n_cases)


#: Evaluations of a confusion matrix, by name.
EVALUATIONS = {
    "CA": lambda tp, fn, fp, tn: div(tp + tn, tp + fn + fp + tn),
    "BA": lambda tp, fn, fp, tn: (F.coalesce(div(tp, tp + fn), F.lit(0.0)) + F.coalesce(div(tn, tn + fp), F.lit(0.0))) / 2,
    "GAMMA": lambda tp, fn, fp, tn: div(tp * tn - fp * fn, tp * tn + fp * fn),
    "TAU_B": lambda tp, fn, fp, tn: div(tp * tn - fp * fn, F.sqrt(((tp + fn) * (tn + fp) * (tp + fp) * (tn + fn)).cast("double"))),
}


def models(maps: DataFrame, masks: DataFrame, order: int, partition: str = "train") -> DataFrame:
    """Each combination and fold with its risky cells (on training samples) and confusion matrix on a partition.

    All 3^k cells are expressions of one row, so nothing is exploded."""
    rows = combinations(maps, order).crossJoin(F.broadcast(masks))  # a row for each fold
    return judged(rows, words_of(maps, "m0"), order, partition)


def judged(rows: DataFrame, words: int, order: int, partition: str = "train") -> DataFrame:
    """models() of given rows: combinations with their bitmaps and a fold's masks."""
    n1, n0 = total("cases", words), total("controls", words)
    risky, tp, fp = [], F.lit(0).cast("long"), F.lit(0).cast("long")
    for c in cells(order):
        risk = high_risk(count(c, "train_cases", words), count(c, "train_controls", words), n1, n0)
        risky.append(F.when(risk, "".join(map(str, c))))
        tp = tp + F.when(risk, count(c, f"{partition}_cases", words)).otherwise(0)
        fp = fp + F.when(risk, count(c, f"{partition}_controls", words)).otherwise(0)
    sizes = total(f"{partition}_cases", words).alias("n_cases"), total(f"{partition}_controls", words).alias("n_controls")
    out = rows.select(*[f"v{k}" for k in range(order)], "fold", F.array_join(F.array_compact(F.array(*risky)), ",").alias("risky"), tp.alias("tp"), fp.alias("fp"), *sizes)
    return out.withColumn("fn", F.col("n_cases") - F.col("tp")).withColumn("tn", F.col("n_controls") - F.col("fp")).drop("n_cases", "n_controls")


def evaluated(df: DataFrame, by: str = "BA") -> DataFrame:
    return df.withColumn("accuracy", F.round(EVALUATIONS[by](*(F.col(c) for c in ("tp", "fn", "fp", "tn"))), 6))


def ranked(df: DataFrame, order: int, k: int, top: int, by: str = "accuracy") -> DataFrame:
    """The top models of each fold merged: mean accuracy over all folds (in millionths), number of folds, and the risky cells in the
    first of these folds; by accuracy, or by count first."""
    ids = [f"v{j}" for j in range(order)]
    w = Window.partitionBy("fold").orderBy(F.col("accuracy").desc(), *ids)
    best = df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    merged = best.groupBy(*ids).agg((F.sum(F.round(F.col("accuracy") * 1e6).cast("long")) / (k * 1000000)).alias("cv_accuracy"), F.count("*").alias("cv_count"), F.min_by("risky", "fold").alias("risky"))
    keys = [F.col("cv_accuracy").desc(), *ids] if by == "accuracy" else [F.col("cv_count").desc(), F.col("cv_accuracy").desc(), *ids]
    return merged.orderBy(*keys).limit(top)


def cross_validations(calls: DataFrame, ped: DataFrame, order: int, k: int, top: int, repetitions: int, by: str = "accuracy", evaluation: str = "BA", partition: str = "train") -> list[DataFrame]:
    """ranked() of each repetition, a deal of the folds with a salt of its own."""
    words = n_words(ped)
    maps = bitmaps(calls, ped, words)
    deals = [fold_masks(folds(ped, k, 2654435761 + 7368787 * r), words) for r in range(repetitions)]
    if order == 2:
        from genoframe.operators import pairs

        return [ranked(pairs.best_models(maps, masks, top, evaluation, partition), order, k, top, by) for masks in deals]
    return [ranked(evaluated(models(maps, masks, order, partition), evaluation), order, k, top, by) for masks in deals]


def report(ranking: DataFrame, order: int, repetition: int = 0, by: str = "accuracy", partition: str = "train") -> list[str]:
    """Lines of a ranking's text report. The ranking has the top models alone."""
    lines = [
        f"#CROSS VALIDATION {repetition + 1}", f"#COMBINATIONS OF: {order} SNPs", f"#EVALUATION MODE: Cross-validation {'accuracy' if by == 'accuracy' else 'consistency'}",
        f"#EVALUATION PARTITION: {'Training' if partition == 'train' else 'Testing'}", "#POSITION\tSNPs\tGENOTYPES\tCV-C\tCV-A",
    ]
    for place, row in enumerate(ranking.collect(), 1):
        cells_ = "".join(f"({c[0]}-{', '.join(c[1:])}), " for c in row["risky"].split(",") if c)
        lines.append(f"{place}\t( {', '.join(str(row[f'v{j}']) for j in range(order))} )\t{cells_}{row['cv_count']}\t{row['cv_accuracy']:.3f}")
    return lines


def matrix(calls: DataFrame, ped: DataFrame, variants: list[int]) -> DataFrame:
    """Sample rows with a column for each of the chosen variants (missing 3) and the class, for other tools."""
    x = calls.where(F.col("variant_id").isin(variants)).withColumn("code", F.coalesce(code(F.col("a1"), F.col("a2")), F.lit(3)))
    wide = x.groupBy("sample_id").pivot("variant_id", variants).agg(F.first("code"))
    out = ped.select("sample_id", (F.col("condition") == 2).cast("int").alias("class")).join(wide, "sample_id", "left")
    return out.select("sample_id", *[F.coalesce(F.col(f"`{v}`"), F.lit(3)).cast("int").alias(f"v{v}") for v in variants], "class")
