"""Near-duplicate search for sets of word shingles: MinHash bands, sequential Bayesian pruning, exact checks.

Items have an id, a whole text and a signature of minima. Items that agree in all rows of a band are
candidates. Comparing all pairs of a band's bucket would grow with the square of a group of copies, so:

1. twice, each item meets one hub (of its buckets' items that which comes first in a hashed order), if they
   aren't in one component yet: a group of copies is joined with one comparison for each item;
2. buckets whose items aren't all in one component are then compared exhaustively, blocks of BLOCK items against
   each other. A block pair is a group of its own, holds 2 * BLOCK items at most, skips pairs that are in
   one component and pairs that an earlier band has brought together, and gives back only links that join components.

No candidate goes unseen, so links are missed only by the banding and the pruning, at the miss probabilities chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoframe.llm import common
from genoframe.llm.components import components

SHINGLE, BLOCK, BATCH, SALTS = 5, 256, 16, 8
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words, from the words' hashes."""
    n = max(0, len(h) - width + 1)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mixed(total * PRIME + h[k : n + k])
    return total


def hashes_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all lists' words in a row, and the place behind each list's last."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    size = int(ends[-1]) if len(ends) else 0
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), np.uint64, size), ends


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of SHINGLE words; of the whole sequence where it is shorter."""
    h, _ = hashes_of([words])
    return np.unique(rolled(h, min(SHINGLE, len(words)))) if words else np.zeros(0, np.uint64)


def shingle_rows(h: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several sequences (none empty) of h in a row, repeats and all, and where each sequence's begin."""
    size = ends - begins
    n = np.maximum(size - SHINGLE + 1, 1)
    starts = np.cumsum(n) - n
    total = rolled(h, SHINGLE)
    where = np.arange(int(n.sum())) + np.repeat(begins - starts, n)
    out = total[np.minimum(where, len(total) - 1)] if len(total) else np.zeros(len(where), np.uint64)
    for i in np.flatnonzero(size < SHINGLE):
        out[starts[i]] = rolled(h[begins[i] : ends[i]], size[i])[0]
    return out, starts


@lru_cache(8)
def multipliers(hashes: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(rows: np.ndarray, starts: np.ndarray, hashes: int) -> np.ndarray:
    """A row of minima of hashes multiply-shift functions for each sequence of shingle_rows."""
    out = np.empty((len(starts), hashes), np.uint32)
    if len(starts):
        for k, a in enumerate(multipliers(hashes)):
            out[:, k] = np.minimum.reduceat((rows * a).view(np.uint32)[1::2], starts)  # high halves of little-endian numbers
    return out


def tuned(percent: int, miss: float = 1e-5, most: int = 24) -> tuple[int, int]:
    """Bands and rows: the most selective rows for which most bands miss a pair at the threshold with less than miss."""
    for rows in range(8, 0, -1):
        bands = next((b for b in range(1, most + 1) if (1 - (percent / 100) ** rows) ** b <= miss), None)
        if bands:
            return bands, rows
    return most, 1


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Signed 64-bit keys, a row of bands for each row of sig, different for different bands."""
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * PRIME, (len(sig), bands))
    for k in range(rows):
        total = mixed(total * PRIME + sig[:, k : bands * rows : rows])
    return total.view(np.int64)


@lru_cache(32)
def least_matches(percent: int, hashes: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(n, m): after n compared minima, fewer than m equal ones make the similarity reach the threshold with a posterior probability under miss.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the binomial probability of m or fewer hits in n + 1 draws at t."""
    t, out = percent / 100, []
    for n in range(BATCH, hashes + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Rows of a and b (signatures) that no batch rules out; each batch looks at the survivors of the one before."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int32)
    for n, m in least_matches(percent, a.shape[1], miss):
        equal[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1, dtype=np.int32)
        alive = alive[equal[alive] >= m]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def jaccard_at_least(percent: int) -> Callable[[str, str], bool]:
    """Exact check on the full shingle sets, in whole numbers."""

    @lru_cache(2 * BLOCK)
    def own(text: str) -> np.ndarray:
        return shingles(words_of(text))

    def check(x: str, y: str) -> bool:
        a, b = own(x), own(y)
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = len(a) + len(b) - len(np.union1d(a, b))
        return 100 * both >= percent * (len(a) + len(b) - both)

    return check


def sigs(column: pa.Array) -> np.ndarray:
    raw = column.cast(pa.binary()).to_pylist()
    return np.frombuffer(b"".join(raw), np.uint32).reshape(len(raw), -1) if raw else np.zeros((0, BATCH), np.uint32)


PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def verified(pairs: DataFrame, check: Callable[[], Callable[[str, str], bool]], percent: int, miss: float) -> DataFrame:
    """Links (a, b) among rows (a, b, sig_a, sig_b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = check()
        for x in batches:
            ok = plausible(sigs(x.column("sig_a")), sigs(x.column("sig_b")), percent, miss)
            x = x.filter(pa.array(ok, pa.bool_()))
            good = [test(p, q) for p, q in zip(x.column("text_a").to_pylist(), x.column("text_b").to_pylist(), strict=True)]
            x = x.filter(pa.array(good, pa.bool_()))
            yield common.batch(PAIR, a=x.column("a"), b=x.column("b"))

    return pairs.mapInArrow(run, "a binary, b binary")


def links(items: DataFrame, bodies: Callable[[DataFrame], DataFrame], percent: int, bands: int, rows: int, check: Callable[[], Callable[[str, str], bool]], miss: float = 1e-6) -> DataFrame:
    """(id, label) for the items that are linked with another: components of the links that were found and verified.

    items: id (binary), sig, any number of equal rows an id. bodies gives (id, text), at least one row for each id of a table of ids. check makes
    the exact test of two texts."""
    schema = pa.schema([("id", pa.binary()), ("band", pa.list_(pa.int64()))])

    def bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = band_keys(sigs(b.column("sig")), bands, rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(schema.field("band").type)], schema=schema)

    every = items.dropDuplicates(["id"]).mapInArrow(bands_of, "id binary, band array<long>").select("id", F.explode("band").alias("bucket"))
    every = common.stored(every, "bands")
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = common.stored(every.join(shared, "bucket"), "members")
    common.dropped(every)
    wanted = members.select("id").distinct()
    one = bodies(wanted).groupBy("id").agg(F.first("text").alias("text"))
    texts = common.stored(one.join(items.dropDuplicates(["id"]), "id").select("id", "text", "sig"), "candidates")
    first = common.stored(verified(_meet(members.withColumn("label", F.col("id")), texts, 0), check, percent, miss), "links")
    label = first.alias("x").join(first.alias("y"), F.col("x.b") == F.col("y.a"), "left").select(F.col("x.a").alias("id"), F.coalesce("y.b", "x.b").alias("label"))
    open_ = common.stored(_open(members, label), "open")
    second = common.stored(verified(_meet(open_, texts, 1), check, percent, miss), "links")
    moved = second.join(open_.select(F.col("id").alias("b"), "label").distinct(), "b").select(F.col("a").alias("id"), F.col("label").alias("to"))
    rest = common.stored(_unsettled(open_.join(moved, "id", "left").select("bucket", "id", F.coalesce("to", "label").alias("label"))), "open")
    last = _blocks(rest, texts, check, percent, bands, rows, miss)
    out = components(first.unionByName(second).unionByName(last))
    common.dropped(members, texts, open_, rest, first, second)
    return out


def salted(members: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """members joined with a row for each bucket; a large bucket's members go to SALTS tasks."""
    by_bucket = by_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(77)), F.lit(SALTS)).cast("int")).join(by_bucket, ["bucket", "salt"]).drop("salt")


def _unsettled(known: DataFrame) -> DataFrame:
    """Members of the buckets with more than one label. Equal labels mean linked items, unequal ones not the contrary."""
    many = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return salted(known, many)


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    return _unsettled(members.join(label, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")))


def _meet(open_: DataFrame, texts: DataFrame, turn: int) -> DataFrame:
    """One pair for each item: it and the first hub, in this turn's order, of its buckets; the hub precedes it in that order."""
    order = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("hub"), F.col("label").alias("hub_label"))
    hubs = open_.groupBy("bucket").agg(F.min(order).alias("hub"))
    pick = salted(open_, hubs).where("label <> hub.hub_label").groupBy("id").agg(F.min("hub").alias("hub")).select(F.col("id").alias("a"), F.col("hub.hub").alias("b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"), F.col("sig").alias("sig_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"), F.col("sig").alias("sig_b"))
    return pick.join(left, "a").join(right, "b")


def _blocks(open_: DataFrame, texts: DataFrame, check: Callable, percent: int, bands: int, rows: int, miss: float) -> DataFrame:
    """Links between the components that still share a bucket."""
    sizes = open_.groupBy("bucket").agg(F.count("*").alias("n"))
    dealt = salted(open_, sizes).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "label")
    full = copies.join(texts, "id").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "label")

    def linked(groups: list[list[tuple]], test: Callable[[str, str], bool]) -> Iterator[tuple[bytes, bytes]]:
        """Links that join components within each pair of blocks. Pairs of all groups are sifted together; groups of one batch, a large one alone."""
        flat = [r for g in groups for r in g]
        sig = np.stack([r[7] for r in flat])
        keys, bucket, own = band_keys(sig, bands, rows), np.array([r[0] for r in flat]), np.array([r[3] for r in flat])
        both = np.array([r[1] == r[2] for r in flat])  # p = q: all pairs of the block
        root = np.unique([b"%d " % k + r[5] for k, g in enumerate(groups) for r in g], return_inverse=True)[1]

        def tested(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
            ok = (root[i] != root[j]) & (both[i] | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            same = keys[i] == keys[j]
            ok = keys[i, same.argmax(1)] == bucket[i]  # else a band before this one has the pair
            i, j = i[ok], j[ok]
            ok = plausible(sig[i], sig[j], percent, miss)
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if root[x] != root[y] and test(flat[x][6], flat[y][6]):
                    root[root == root[y]] = root[x]
                    yield flat[x][4], flat[y][4]

        at, held, size = 0, [], 0
        for g in groups:
            later = np.arange(at, at + len(g))
            at += len(g)
            for a in range(0, len(g) - 1, step := max(1, 8192 // len(g))):
                i, j = np.nonzero(later[None, :] > later[a : a + step, None])
                held.append((i + later[a], j + later[0]))
                size += len(i)
                if size >= 8192:
                    yield from tested(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from tested(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, groups = check(), []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "p", "q", "own", "id", "label", "text")), sigs(b.column("sig")), strict=True):
                if groups and groups[-1][0][:3] == r[:3]:
                    groups[-1].append(r)
                else:
                    groups.append([r])
            done, groups = groups[:-1], groups[-1:]
            out = list(linked(done, test)) if done else []
            yield common.batch(PAIR, a=[x for x, _ in out], b=[x for _, x in out])
        out = list(linked(groups, test)) if groups else []
        yield common.batch(PAIR, a=[x for x, _ in out], b=[x for _, x in out])

    return full.mapInArrow(run, "a binary, b binary")
