"""All pairs of variants: counts, confusion matrices, risky cells and the best models over them, without a row a pair.

`pair_counts` takes one pass over the variants in order. The others compare classes of variants with equal bitmaps, in tiles of
two blocks of classes: a cell of a pair is the AND of two bitmaps, a table over all bitmaps of the samples has what such a cell
adds in several folds at once, and tiles are added up in NumPy arrays. All results cover all pairs i < j; the ranking passes over pairs
whose called samples alone show that they aren't among the best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoframe.llm.common import stored
from genoframe.operators import mdr

CODES = [(a, b) for a in range(3) for b in range(3)]
SCAN_ROWS = 4096


# ---- counts: one pass in order ----------------------------------------------------------------------------------
def _scan(words: int, names: list[str]):
    """A sorted partition's first and last variant, number of variants, and by sample: variants of each code, and pairs i < j of each two codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, within = np.zeros((3, 64 * words), np.int64), np.zeros((9, 64 * words), np.int64)
        n, first, last = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("variant_id")[:1] if first is None else first
            last, n = batch.column("variant_id")[-1:], n + batch.num_rows
            for at in range(0, batch.num_rows, SCAN_ROWS):
                part = batch.slice(at, SCAN_ROWS)
                bits = []
                for k in range(3):
                    masks = np.stack([part.column(mdr.word(f"m{k}", w)).to_numpy(zero_copy_only=False) for w in range(words)], axis=1).astype("<i8")
                    bits.append(np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little").astype(np.int64))
                for a in range(3):
                    upto = np.cumsum(bits[a], axis=0)
                    before = upto - bits[a] + seen[a]
                    for b in range(3):
                        within[3 * a + b] += np.einsum("ij,ij->j", before, bits[b])
                    seen[a] += upto[-1]
        if n:
            lists = [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (seen, within)]
            yield pa.RecordBatch.from_arrays([first, last, pa.array([n], pa.int64()), *lists], names=names)

    return run


def _joined(words: int):
    """The partitions' rows, in order, as one: a row a sample with the number of all pairs and those of each two codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pairs = np.zeros((3, 64 * words), np.int64), np.zeros((9, 64 * words), np.int64)
        n, before = 0, None
        for row in (r for batch in batches for r in batch.to_pylist()):
            if before is not None and not before < row["first"]:
                raise ValueError("partitions of variants overlap")
            own = np.array(row["seen"], np.int64).reshape(seen.shape)
            for k, (a, b) in enumerate(CODES):
                pairs[k] += seen[a] * own[b]
            pairs += np.array(row["within"], np.int64).reshape(pairs.shape)
            seen += own
            n, before = n + row["n"], row["last"]
        if n > 1:
            place = np.arange(64 * words)
            bit = np.left_shift(np.int64(1), place % 64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), n * (n - 1) // 2)), pa.array((place // 64).astype(np.int32)), pa.array(bit), *map(pa.array, pairs)], names=["n", "word", "bit", *(f"p{a}{b}" for a, b in CODES)]
            )

    return run


def pair_counts(maps: DataFrame, masks: DataFrame) -> DataFrame:
    """(fold, n, train_cases_00, train_controls_00, ...): all pairs of variants, and the samples in each of their cells, summed over the pairs.

    A sample is in a cell (a, b) of a pair if it has code a at the first and b at the second, so a sample's pairs come from running
    counts over the variants in order. Partitions are ranges of variants; each gives one row, and these are joined in one task."""
    words, kind = mdr.words_of(maps, "m0"), maps.schema["variant_id"].dataType.simpleString()
    ordered = maps.where("variant_id is not null").repartitionByRange("variant_id").sortWithinPartitions("variant_id")
    parts = ordered.mapInArrow(_scan(words, ["first", "last", "n", "seen", "within"]), f"first {kind}, last {kind}, n long, seen array<long>, within array<long>")
    samples = parts.repartition(1).sortWithinPartitions("first").mapInArrow(_joined(words), "n long, word int, bit long, " + ", ".join(f"p{a}{b} long" for a, b in CODES))
    rows = samples.crossJoin(F.broadcast(masks))  # a row for each sample and fold
    sums = []
    for a, b in CODES:
        for side in ("train_cases", "train_controls"):
            own = F.coalesce(*[F.when(F.col("word") == w, F.col(mdr.word(side, w)).bitwiseAND(F.col("bit"))) for w in range(words)]) != 0
            sums.append(F.sum(F.when(own, F.col(f"p{a}{b}")).otherwise(0)).cast("long").alias(f"{side[6:]}_{a}{b}"))
    return rows.groupBy("fold").agg(F.max("n").alias("n"), *sums)


# ---- tiles of classes -------------------------------------------------------------------------------------------
#: Samples (cases and controls) whose bitmaps have a table: of 2^24 words, 64 MB a worker.
TABLED = 24
BLOCKS, ROWS, COLUMNS, STRIP, SEGMENT = 24, 1 << 15, 1 << 14, 1 << 21, 96
PACKED = "block int, n long, m binary, w binary, first binary, ids binary, cls binary"


def tabled(maps: DataFrame, masks: DataFrame) -> list | None:
    """The folds' masks (a row a fold) if the tiles below take these variants: up to 24 cases and controls, whole numbers as variant_id."""
    if mdr.words_of(maps, "m0") > 1 or maps.schema["variant_id"].dataType.typeName() not in ("long", "integer"):
        return None
    rows = masks.orderBy("fold").collect()
    return rows if not rows or (rows[0]["cases"] | rows[0]["controls"]).bit_count() <= TABLED else None


def _dense(mask: int, whole: int) -> int:
    """A mask's bits at the places that whole has, moved together."""
    places = [k for k in range(64) if whole >> k & 1]
    return sum((mask >> p & 1) << k for k, p in enumerate(places))


def _groups(rows: list, kind: str, partition: str = "train") -> list[tuple]:
    """Specifications of tables: (bits, n1, n0, kind, lane, folds), each with as many folds as 32 bits have lanes for."""
    u64 = lambda x: x & 0xFFFFFFFFFFFFFFFF
    whole = u64(rows[0]["cases"] | rows[0]["controls"])
    n1, n0 = u64(rows[0]["cases"]).bit_count(), u64(rows[0]["controls"]).bit_count()
    folds = []
    for r in rows:
        side = [_dense(u64(r[f"{p}_{c}"]), whole) for p in ("train", partition) for c in ("cases", "controls")]
        folds.append((r["fold"], *side, side[3].bit_count().bit_length()))
    lane = 8 if kind == "confusion" and all(f[3].bit_count().bit_length() + f[5] <= 8 for f in folds) else 16
    step = 32 // lane
    return [(whole.bit_count(), n1, n0, kind, lane, tuple(folds[k : k + step])) for k in range(0, len(folds), step)]


_kept: dict = {}


def _table(spec: tuple) -> np.ndarray:
    """For each bitmap of samples what a cell with them adds: whether it is risky, or its cases and controls if it is; a lane a fold."""
    if spec not in _kept:
        _kept.clear()
        bits, n1, n0, kind, lane, folds = spec
        low = min(bits, 16)
        table = np.zeros(1 << bits, np.uint32)
        for k, (_, *sides, shift) in enumerate(folds):
            near = [np.bitwise_count(np.arange(1 << low) & s).astype(np.int64) for s in sides]
            far = [np.bitwise_count(np.arange(1 << bits - low) & (s >> low)).astype(np.int64) for s in sides]
            wide = sides[1].bit_count() + 1
            c, u = np.divmod(np.arange((sides[0].bit_count() + 1) * wide), wide)
            risk = ((c + u > 0) & (c * n0 >= u * n1)).astype(np.uint32)
            for h in range(1 << bits - low):
                value = risk[(near[0] + far[0][h]) * wide + near[1] + far[1][h]]
                if kind == "confusion":
                    value = value * ((near[2] + far[2][h] << shift) | (near[3] + far[3][h])).astype(np.uint32)
                table[h << low : h + 1 << low] |= value << np.uint32(lane * k)
        _kept[spec] = table
    return _kept[spec]


def _pack(places: list[int]):
    """A block's classes as one row: bitmaps with the given places moved together, sizes, first variants; of single variants also these, in order, and their classes."""

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        m = np.zeros((3, table.num_rows), np.int32)
        for k in range(3):
            for at, p in enumerate(places):
                m[k] |= ((col[f"m{k}"] >> p & 1) << at).astype(np.int32)
        ids = cls = np.zeros(0, np.int64)
        if "variant_id" in col:
            ids = col["variant_id"].astype(np.int64)
            order = np.lexsort((ids, *m))
            m, ids = m[:, order], ids[order]
            new = np.ones(len(ids), bool)
            new[1:] = (m[:, 1:] != m[:, :-1]).any(axis=0)
            cls, at = np.cumsum(new) - 1, np.flatnonzero(new)
            first, w, m = ids[at], np.diff(np.append(at, len(ids))), m[:, at]
            order = np.argsort(ids)
            ids, cls = ids[order], cls[order]
        else:
            order = np.argsort(col["first"])
            m, first, w = m[:, order], col["first"][order].astype(np.int64), col["w"][order]
        data = [np.ascontiguousarray(x).tobytes() for x in (m, w.astype(np.int64), first, ids, cls.astype(np.int64))]
        return pa.table([pa.array([col["block"][0]], pa.int32()), pa.array([m.shape[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in data)], names=[f.split()[0] for f in PACKED.split(", ")])

    return run


class _Block:
    def __init__(self, row: dict, side: str) -> None:
        get = lambda c, kind: np.frombuffer(row[f"{side}_{c}"], kind)
        self.n, self.m = row[f"{side}_n"], get("m", np.int32).reshape(3, -1).astype(np.int64)
        self.w, self.first, self.ids, self.cls = (get(c, np.int64) for c in ("w", "first", "ids", "cls"))

    def part(self, where: np.ndarray) -> _Block:
        """Some of the classes, without their members."""
        out = object.__new__(_Block)
        out.n, out.m, out.w, out.first = int(where.sum()), np.ascontiguousarray(self.m[:, where]), self.w[where], self.first[where]
        out.ids = out.cls = np.zeros(0, np.int64)
        return out


def _classes(maps: DataFrame, whole: int, members: bool) -> DataFrame:
    """Variants with their bitmaps over the cases and controls alone, in blocks by bitmap; or, without members, one row for those that are equal."""
    m = [f"m{k}" for k in range(3)]
    x = maps.where("variant_id is not null").select("variant_id", *[F.col(c).bitwiseAND(F.lit(whole)).alias(c) for c in m])
    if not members:
        x = x.groupBy(*m).agg(F.count("*").alias("w"), F.min("variant_id").alias("first"))
    return x.withColumn("block", F.pmod(F.xxhash64(*m), F.lit(BLOCKS)).cast("int"))


def _tiles(classes: DataFrame, rows: list, groups: int) -> DataFrame:
    """A row for each two blocks, and each block with itself, and each group of folds; the row has the blocks' classes."""
    whole = rows[0]["cases"] | rows[0]["controls"]
    blocks = classes.groupBy("block").applyInArrow(_pack([k for k in range(64) if whole >> k & 1]), PACKED)
    left, right = (blocks.select(*[F.col(c).alias(f"{side}_{c}") for c in blocks.columns]) for side in "lr")
    left = left.withColumn("other", F.explode(F.sequence("l_block", F.lit(BLOCKS - 1))))
    both = left.join(right, F.col("other") == F.col("r_block")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tasks = max(48, min(3 * classes.sparkSession.sparkContext.defaultParallelism, BLOCKS * (BLOCKS + 1) // 2))
    return both.repartition(tasks).sortWithinPartitions("grp")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Block, _Block, bool]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: v[0] for c, v in batch.slice(k, 1).to_pydict().items()}
            yield row["grp"], _Block(row, "l"), _Block(row, "r"), row["l_block"] == row["r_block"]


def _values(p: _Block, q: _Block, spec: tuple, r_from: int = 0, r_to: int | None = None) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(row from, row to, column from, column to, lanes) of a tile, piece by piece: what the nine cells of each two classes add up to."""
    table, risk = _table(spec), spec[3] == "risk"
    r_to = p.n if r_to is None else r_to
    for c0 in range(0, q.n, COLUMNS):
        c1 = min(c0 + COLUMNS, q.n)
        step = max(1, ROWS // (c1 - c0))
        for r0 in range(r_from, r_to, step):
            r1 = min(r0 + step, r_to)
            both, value, out = np.empty((r1 - r0, c1 - c0), np.int64), np.empty((r1 - r0, c1 - c0), np.uint32), np.zeros((r1 - r0, c1 - c0), np.uint32)
            for k, (a, b) in enumerate(CODES):
                np.bitwise_and(p.m[a, r0:r1, None], q.m[b, None, c0:c1], out=both)
                table.take(both, out=value, mode="clip")
                if risk:
                    np.left_shift(value, np.uint32(k), out=value)
                out += value
            yield r0, r1, c0, c1, out


def _equal_pairs(p: _Block, spec: tuple) -> np.ndarray:
    """Lanes of each class with itself."""
    table, out = _table(spec), np.zeros(p.n, np.uint32)
    for k, (a, b) in enumerate(CODES):
        value = table.take(p.m[a] & p.m[b])
        out += value << np.uint32(k) if spec[3] == "risk" else value
    return out


def _counted(codes: np.ndarray, weights: np.ndarray | None, size: int) -> np.ndarray:
    """Whole numbers by code; sums of weights are exact, as a tile's pairs are far below 2^53."""
    found = np.bincount(codes.ravel(), None if weights is None else weights.ravel(), size)
    return found if weights is None else np.rint(found).astype(np.int64)


def _confusions(groups: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for g, p, q, same in _read(batches):
            found = np.zeros((2, 1 << 16), np.int64)
            level = len(p.w) and len(q.w) and p.w.min() == p.w.max() and q.w.min() == q.w.max()
            for r0, r1, c0, c1, out in _values(p, q, groups[g]):
                weights = None if level else p.w[r0:r1, None] * q.w[None, c0:c1].astype(float)
                halves = out.view("<u2").reshape(r1 - r0, c1 - c0, 2)
                for h in range(2):
                    found[h] += _counted(halves[:, :, h], weights, 1 << 16) * (p.w[0] * q.w[0] if level else 1)
            if same:  # each pair of variants was met twice, and each variant with itself once
                alone = _equal_pairs(p, groups[g]).view("<u2").reshape(-1, 2)
                for h in range(2):
                    found[h] = (found[h] - _counted(alone[:, h], p.w.astype(float), 1 << 16)) // 2
            total[g] = total[g] + found if g in total else found
        rows: list[list[int]] = [[], [], [], []]
        for g, found in total.items():
            lane, folds = groups[g][4:]
            for k, fold in enumerate(folds):
                h, at = divmod(lane * k, 16)
                code = np.flatnonzero(found[h])
                n = np.zeros(1 << lane, np.int64)
                np.add.at(n, code >> at & (1 << lane) - 1, found[h][code])
                code = np.flatnonzero(n)
                for column, x in zip(rows, (np.full(len(code), fold[0]), code >> fold[5], code & (1 << fold[5]) - 1, n[code]), strict=True):
                    column.extend(x.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["fold", "tp", "fp", "n"])

    return run


def confusions(maps: DataFrame, masks: DataFrame, partition: str = "train") -> DataFrame:
    """(fold, tp, fn, fp, tn, n): how many pairs of variants have which confusion matrix."""
    rows = tabled(maps, masks)
    if rows is None:
        return mdr.models(maps, masks, 2, partition).groupBy("fold", "tp", "fn", "fp", "tn").agg(F.count("*").alias("n"))
    if not rows:
        return maps.sparkSession.createDataFrame([], "fold long, tp long, fn long, fp long, tn long, n long")
    groups = _groups(rows, "confusion", partition)
    found = _tiles(_classes(maps, rows[0]["cases"] | rows[0]["controls"], False), rows, len(groups)).mapInArrow(_confusions(groups), "fold long, tp long, fp long, n long").groupBy("fold", "tp", "fp").agg(F.sum("n").alias("n"))
    sizes = F.create_map(*[F.lit(x) for r in rows for x in (r["fold"], r[f"{partition}_cases"].bit_count())]), F.create_map(*[F.lit(x) for r in rows for x in (r["fold"], r[f"{partition}_controls"].bit_count())])
    fn, tn = ((s[F.col("fold")] - F.col(c)).cast("long") for s, c in zip(sizes, ("tp", "fp"), strict=True))
    return found.select("fold", "tp", fn.alias("fn"), "fp", tn.alias("tn"), "n")


# ---- risky cells ------------------------------------------------------------------------------------------------
class _Order:
    """How many pairs of variants of two classes have the first class's variant before the second's."""

    def __init__(self, p: _Block, q: _Block) -> None:
        self.p, self.q = p, q
        self.single = bool((p.w == 1).all() and (q.w == 1).all())
        if not self.single:
            self.kind = np.float32 if int(p.w.max()) * int(q.w.max()) < 1 << 24 else np.float64
            self.length = max(SEGMENT, -(-len(q.ids) * q.n // (4 * STRIP)))
            segment = np.arange(len(q.ids)) // self.length
            self.segments = -(-len(q.ids) // self.length)
            own = np.bincount(q.cls * self.segments + segment, minlength=q.n * self.segments).reshape(q.n, self.segments)
            self.later = (own.sum(axis=1, keepdims=True) - np.cumsum(own, axis=1)).astype(self.kind)
            self.at = np.searchsorted(q.ids, p.ids, "right")

    def counts(self, r0: int, r1: int) -> np.ndarray:
        """Of rows r0 to r1 with all columns: pairs over segments of q's variants by a product, those within one by listing them."""
        p, q = self.p, self.q
        if self.single:
            return p.first[r0:r1, None] < q.first[None, :]
        mine = np.flatnonzero((p.cls >= r0) & (p.cls < r1) & (self.at < len(q.ids)))
        row, at = p.cls[mine] - r0, self.at[mine]
        segment = at // self.length
        own = np.bincount(row * self.segments + segment, minlength=(r1 - r0) * self.segments).reshape(r1 - r0, self.segments)
        found = own.astype(self.kind) @ self.later.T
        for k in range(0, len(mine), max(1, STRIP // self.length)):
            part = slice(k, k + max(1, STRIP // self.length))
            size = np.minimum((segment[part] + 1) * self.length, len(q.ids)) - at[part]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[part], size)
            flat = np.repeat(row[part], size) * q.n + q.cls[place]
            found += np.bincount(flat, minlength=found.size).reshape(found.shape).astype(self.kind)
        return found


#: A pattern of risky cells (a bit a cell) with first and second variant changed over.
TURNED = np.array([sum((x >> (3 * b + a) & 1) << (3 * a + b) for a, b in CODES) for x in range(512)])


def _risks(groups: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for g, p, q, same in _read(batches):
            found = total.setdefault(g, np.zeros((2, 512), np.int64))
            order = _Order(p, q)
            strip = max(1, STRIP // max(1, q.n))
            for s0 in range(0, p.n, strip):
                s1 = min(s0 + strip, p.n)
                before = order.counts(s0, s1)
                for r0, r1, c0, c1, out in _values(p, q, groups[g], s0, s1):
                    ahead = before[r0 - s0 : r1 - s0, c0:c1]
                    halves = out.view("<u2").reshape(r1 - r0, c1 - c0, 2)
                    for h in range(len(groups[g][5])):
                        if order.single:
                            first = _counted(halves[:, :, h] | ahead.astype(np.uint16) << 9, None, 1024)
                            first, second = first[512:], first[:512]
                        else:
                            first = _counted(halves[:, :, h], ahead.astype(float), 512)
                            second = 0 if same else _counted(halves[:, :, h], p.w[r0:r1, None] * q.w[None, c0:c1].astype(float), 512) - first
                        found[h] += first
                        if not same:  # in a block with itself both orders are met
                            found[h] += second[TURNED]
        rows: list[list[int]] = [[], [], []]
        for g, found in total.items():
            for h, fold in enumerate(groups[g][5]):
                cells = np.flatnonzero(found[h])
                for column, x in zip(rows, (np.full(len(cells), fold[0]), cells, found[h][cells]), strict=True):
                    column.extend(x.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["fold", "cells", "n"])

    return run


def risky_cells(maps: DataFrame, masks: DataFrame) -> DataFrame:
    """(fold, risky, n): how many pairs of variants have which risky cells."""
    rows = tabled(maps, masks)
    if rows is None:
        return mdr.models(maps, masks, 2).groupBy("fold", "risky").agg(F.count("*").alias("n"))
    if not rows:
        return maps.sparkSession.createDataFrame([], "fold long, risky string, n long")
    groups = _groups(rows, "risk")
    found = _tiles(_classes(maps, rows[0]["cases"] | rows[0]["controls"], True), rows, len(groups)).mapInArrow(_risks(groups), "fold long, cells long, n long").groupBy("fold", "cells").agg(F.sum("n").alias("n"))
    names = [F.when(F.col("cells").bitwiseAND(F.lit(1 << k)) != 0, f"{a}{b}") for k, (a, b) in enumerate(CODES)]
    return found.select("fold", F.array_join(F.array_compact(F.array(*names)), ",").alias("risky"), "n")


# ---- best models ------------------------------------------------------------------------------------------------
def _frame(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of whole numbers that no Python worker makes."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))


def _levels(maps: DataFrame, rows: list, groups: list[tuple], evaluation: str, partition: str) -> list[list[np.ndarray]]:
    """For each group and fold the place of each lane's evaluation among all that can occur, best first; as Spark rounds and orders them."""
    cases = []
    for g, spec in enumerate(groups):
        for k, f in enumerate(spec[5]):
            n1, n0 = f[3].bit_count(), f[4].bit_count()
            cases += [(g, k, tp << f[5] | fp, tp, n1 - tp, fp, n0 - fp) for tp in range(n1 + 1) for fp in range(n0 + 1)]
    frame = _frame(maps.sparkSession, cases, ["g", "k", "code", "tp", "fn", "fp", "tn"])
    found = mdr.evaluated(frame, evaluation).select("g", "k", "code", "accuracy").collect()
    place = {x: n for n, x in enumerate(sorted({r["accuracy"] for r in found if r["accuracy"] is not None}, reverse=True))}
    out = [[np.full(1 << spec[4], len(place) + 1, np.int64) for _ in spec[5]] for spec in groups]
    for r in found:
        out[r["g"]][r["k"]][r["code"]] = place.get(r["accuracy"], len(place))
    return out


#: A place (level, first variant) behind all.
LAST = (1 << 40, 1 << 62)


def _bounds(groups: list[tuple], levels: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """For each group and fold, by called cases and controls of a variant: the best level that any pair with it can have, as a pair's
    true and false positives are called at both its variants."""
    out = []
    for spec, own in zip(groups, levels, strict=True):
        out.append([])
        for f, level in zip(spec[5], own, strict=True):
            tp, fp = np.arange(f[3].bit_count() + 1), np.arange(f[4].bit_count() + 1)
            out[-1].append(np.minimum.accumulate(np.minimum.accumulate(level[tp[:, None] << f[5] | fp], axis=0), axis=1))
    return out


class _Best:
    """The best `top` pairs of classes of a fold by (level, first variant, second variant); bar: a place behind which no pair counts."""

    def __init__(self, top: int, bar: tuple[int, int] = LAST) -> None:
        self.top, self.bar, self.rows = top, bar, np.zeros((3, 0), np.int64)

    def most(self) -> tuple[int, int]:
        """The (level, first variant) that a pair may have at most."""
        return min(self.bar, (int(self.rows[0, -1]), int(self.rows[1, -1]))) if self.rows.shape[1] == self.top else self.bar

    def add(self, level: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        new = np.stack([level, np.minimum(a, b), np.maximum(a, b)])
        last = self.most()
        new = new[:, (new[0] < last[0]) | (new[0] == last[0]) & (new[1] <= last[1])]
        if new.shape[1]:
            both = np.concatenate([self.rows, new], axis=1)
            self.rows = both[:, np.lexsort((both[2], both[1], both[0]))[: self.top]]


def _contenders(p: _Block, q: _Block, spec: tuple, bounds: list[np.ndarray], limits: list[tuple[int, int]]) -> list[tuple[_Block, _Block, list[int]]]:
    """Parts of a tile, and the folds for which they are compared: each pair that can be within a fold's limit is once in the fold's parts.

    Such a pair has both bounds before the limit's level, or none behind it and a variant not behind the limit's first. Where the folds' parts
    are more than the tile, the tile is compared once for all folds."""
    size, parts = 0, []
    for k, f in enumerate(spec[5]):
        sides = []
        for x in (p, q):
            called = x.m[0] | x.m[1] | x.m[2]
            bound = bounds[k][np.bitwise_count(called & f[3]), np.bitwise_count(called & f[4])]
            before, at, early = bound < limits[k][0], bound == limits[k][0], x.first <= limits[k][1]
            sides.append((before, at, before | at, early))
        (lb, la, ln, le), (rb, ra, rn, re) = sides
        for left, right in ((lb, rb), (lb & le, ra), (la & le, rn), (lb & ~le, ra & re), (la & ~le, rn & re)):
            if left.any() and right.any():
                size += int(left.sum()) * int(right.sum())
                parts.append((left, right, [k]))
    if size >= p.n * q.n:
        return [(p, q, list(range(len(spec[5]))))]
    return [(p.part(left), q.part(right), folds) for left, right, folds in parts]


def _bests(groups: list[tuple], levels: list[list[np.ndarray]], top: int, bars: dict[int, tuple[int, int]]):
    bounds = _bounds(groups, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, bool], _Best] = {}
        every = np.arange(1 << 16)
        for g, p, q, same in _read(batches):
            lane, folds = groups[g][4:]
            where = [divmod(lane * k, 16) for k in range(len(folds))]
            lists = [best.setdefault((g, k, False), _Best(top, bars.get(f[0], LAST))) for k, f in enumerate(folds)]
            twice = np.flatnonzero(p.w > 1)
            if same and len(twice):
                alone = _equal_pairs(p.part(p.w > 1), groups[g]).view("<u2").reshape(-1, 2)
                for k, (h, at) in enumerate(where):
                    level = levels[g][k][alone[:, h] >> at & (1 << lane) - 1]
                    best.setdefault((g, k, True), _Best(top, lists[k].bar)).add(level, p.first[twice], p.first[twice])
            for left, right, chosen in _contenders(p, q, groups[g], bounds[g], [x.most() for x in lists]):
                limits, wanted = None, None
                for r0, r1, c0, c1, out in _values(left, right, groups[g]):
                    now = [lists[k].most()[0] for k in chosen]
                    if now != limits:
                        limits, wanted = now, np.zeros((2, 1 << 16), bool)
                        for k, limit in zip(chosen, limits, strict=True):
                            wanted[where[k][0]] |= levels[g][k][every >> where[k][1] & (1 << lane) - 1] <= limit
                    halves = out.view("<u2").reshape(-1, 2)
                    for h in range(2):
                        if not wanted[h].any():
                            continue
                        found = np.flatnonzero(wanted[h].take(halves[:, h]))
                        a, b, code = left.first[r0 + found // (c1 - c0)], right.first[c0 + found % (c1 - c0)], halves[found, h]
                        for k, limit in zip(chosen, limits, strict=True):
                            if where[k][0] == h:
                                level = levels[g][k][code >> where[k][1] & (1 << lane) - 1]
                                keep = level <= limit
                                if same:
                                    keep &= a < b
                                lists[k].add(level[keep], a[keep], b[keep])
        for (g, k, alone_), x in best.items():
            n = x.rows.shape[1]
            columns = [np.full(n, groups[g][5][k][0], np.int64), np.full(n, alone_), *x.rows]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fold", "alone", "level", "a", "b"])

    return run


#: Variants whose pairs give the ranking's bars, all folds together.
SEEDS = 4096
FOUND = "fold long, alone boolean, level long, a long, b long"


def _one_block(variants: list[tuple], whole: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Tiles of variants (variant, m0, m1, m2), each a class, in one block."""
    names = ["first", "m0", "m1", "m2", "block", "w"]
    columns = zip(*((*v, 0, 1) for v in variants), strict=True)
    block = _pack([k for k in range(64) if whole >> k & 1])(pa.table([pa.array(c, pa.int64()) for c in columns], names=names))
    sides = {f"{side}_{c}": block.column(c) for side in "lr" for c in block.column_names}
    for g in range(groups):
        yield from pa.table(sides | {"grp": pa.array([g])}).to_batches()


def _bars(seeds: list[tuple], whole: int, groups: list[tuple], levels: list[list[np.ndarray]], top: int) -> dict[int, tuple[int, int]]:
    """The place of the last of each fold's `top` best pairs of seeds (variant, m0, m1, m2), of folds with so many; compared here, as seeds are few."""
    found: dict[int, list[tuple]] = {}
    for batch in _bests(groups, levels, top, {})(_one_block(seeds, whole, len(groups)) if seeds else ()):
        for r in batch.to_pylist():
            found.setdefault(r["fold"], []).append((r["level"], r["a"], r["b"]))
    _kept.clear()
    return {fold: sorted(x)[top - 1][:2] for fold, x in found.items() if len(x) >= top}


def _best_classes(maps: DataFrame, rows: list, groups: list[tuple], levels: list[list[np.ndarray]], top: int, partition: str) -> DataFrame:
    """FOUND: each task's best pairs of classes, those of a class with itself apart.

    First all pairs of a few variants, those of each fold with the best bounds, are compared: the last of a fold's `top` best pairs of these is its
    bar. Then the classes that can be in a pair as good as some fold's bar are compared in tiles; all of them where bounds exclude none."""
    m, whole = ["m0", "m1", "m2"], rows[0]["cases"] | rows[0]["controls"]
    called = F.col("m0").bitwiseOR(F.col("m1")).bitwiseOR(F.col("m2"))
    bounds = {}
    for r, table in zip(rows, (x for own in _bounds(groups, levels) for x in own), strict=True):
        cases, controls = (F.bit_count(called.bitwiseAND(F.lit(r[f"{partition}_{c}"]))) for c in ("cases", "controls"))
        bounds[r["fold"]] = F.element_at(F.lit(table.ravel().tolist()), cases * F.lit(table.shape[1]) + controls + 1)
    single = maps.where("variant_id is not null").select(F.col("variant_id").alias("first"), *[F.col(c).bitwiseAND(F.lit(whole)).alias(c) for c in m])
    seeds = reduce(DataFrame.unionAll, [single.orderBy(x, "first").limit(max(2, SEEDS // len(rows))) for x in bounds.values()]).collect()
    bars = _bars(sorted({tuple(r) for r in seeds}), whole, groups, levels, top)
    classes = _classes(maps, whole, False).where(reduce(lambda x, y: x | y, [x <= F.lit(bars.get(fold, LAST)[0]) for fold, x in bounds.items()]))
    return _tiles(classes, rows, len(groups)).mapInArrow(_bests(groups, levels, top, bars), FOUND)


def best_models(maps: DataFrame, masks: DataFrame, top: int, evaluation: str = "BA", partition: str = "train") -> DataFrame:
    """evaluated(models()) of pairs, of each fold at least the `top` best by (accuracy, v0, v1); all where no table is made.

    Tiles give the best pairs of classes, by their first variants; a class with itself goes apart, as its pair's second variant isn't known
    there. A pair of variants with a variant that has `top` others of its class before it, its partner apart, isn't among the best, so of each
    class the first top + 1 are paired. maps is read several times: it is stored."""
    rows = tabled(maps, masks)
    if not rows:
        return mdr.evaluated(mdr.models(maps, masks, 2, partition), evaluation)
    groups = _groups(rows, "confusion", partition)
    levels = _levels(maps, rows, groups, evaluation, partition)
    maps = stored(maps, "bitmaps")
    found = _best_classes(maps, rows, groups, levels, top, partition)
    chosen = _first(found, top, ["fold", "alone"], ["level", "a", "b"]).collect()  # at most 2 x top a fold
    spark = maps.sparkSession
    kept = _frame(spark, [tuple(map(int, r)) for r in chosen], ["fold", "alone", "level", "a", "b"]).withColumn("alone", F.col("alone") != 0)
    m, whole = ["m0", "m1", "m2"], rows[0]["cases"] | rows[0]["controls"]
    own = maps.where("variant_id is not null").select("variant_id", *[F.col(c).bitwiseAND(F.lit(whole)).alias(c) for c in m])
    firsts = _frame(spark, [(x,) for x in sorted({v for r in chosen for v in (r["a"], r["b"])})], ["class"])
    classes = own.join(F.broadcast(firsts), F.col("variant_id") == F.col("class")).select("class", *m)
    members = _first(own.join(F.broadcast(classes), m).select("class", "variant_id"), top + 1, ["class"], ["variant_id"])
    left, right = (members.select(F.col("class").alias(c), F.col("variant_id").cast("long").alias(f"{c}_id")) for c in "ab")
    both = kept.join(left, "a").join(right, "b").where("not alone or a_id < b_id")
    both = both.select("fold", "level", F.least("a_id", "b_id").alias("v0"), F.greatest("a_id", "b_id").alias("v1"))
    both = _first(both, top, ["fold"], ["level", "v0", "v1"]).select("fold", "v0", "v1")
    for k in range(2):
        both = both.join(maps.select(F.col("variant_id").alias(f"v{k}"), *[F.col(c).alias(f"m{k}_{c[1:]}") for c in m]), f"v{k}")
    return mdr.evaluated(mdr.judged(both.join(F.broadcast(masks), "fold"), 1, 2, partition), evaluation)


def _first(df: DataFrame, n: int, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n).drop("place")
