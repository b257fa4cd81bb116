"""Operator 4, LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class). Classes are the end, the TOP most frequent words, and hashed
endings of all other words. The class model is log-linear over hashed n-gram features (word before, both
words before) and skip features (second and third word before) on top of the class shares. The word model is the smoothed share
within the class. Unseen words share one slot, whose probability is the share of words seen once (Good-Turing).
So all probabilities sum to one over the known words and that slot.

Training is distributed: every partition runs AdaGrad steps over all its tokens, and the weights are averaged by
tokens, block by block. Scoring multiplies sparse feature rows in numpy batches. Counts and statistics cover all
training documents. Words of the head (at most HEAD, by count) are known to each worker; those of
the tail are summed by document and get their counts in a join.

Null and empty texts are the end token alone; repeated rows are scored each; without training documents N = V = 0 and
the model scores each token by the base; null doc_ids count as training documents.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common

#: HEAD bounds what is broadcast: words known to each worker.
HEAD, TOP, ENDINGS, FEATURES, SLOTS, BLOCKS = 250_000, 31, 16, 4, 2048, 32
CLASSES = 1 + TOP + ENDINGS
STEP_TOKENS, RATE, FLUSH = 8192, 0.15, 300_000
LN10 = math.log(10)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def is_training() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, ending, n) over all texts, combined before the shuffle."""
    schema = pa.schema([("word", pa.string()), ("ending", pa.int32()), ("n", pa.int64())])

    def out(c: Counter) -> pa.RecordBatch:
        return common.batch(schema, word=pa.array(list(c), pa.binary()).cast(pa.string()), ending=[ending(w) for w in c], n=list(c.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for x in common.raw_texts(b.column("text")):
                c.update(x.lower().split())
            if len(c) > FLUSH:
                yield out(c)
                c = Counter()
        yield out(c)

    return docs.mapInArrow(run, "word string, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """word -> code. Codes: 0 end, then the head, then one for each ending of the tail, then what stands before a text."""

    def __init__(self, words: list[bytes], counts: np.ndarray, class_mass: np.ndarray, denominator: float) -> None:
        super().__init__(zip(words, range(1, len(words) + 1), strict=True))
        self.tail = len(words) + 1
        self.before = self.tail + ENDINGS
        kinds = [0, *range(1, 1 + min(TOP, len(words))), *(1 + TOP + ending(w) for w in words[TOP:]), *range(1 + TOP, CLASSES), 0]
        self.kind = np.array(kinds, np.int32)
        self.base = np.zeros(self.before + 1)
        self.inner = np.zeros(self.before + 1)
        self.base[: self.tail] = np.log10(counts + 0.5) - math.log10(denominator)
        self.inner[: self.tail] = np.log10(counts + 0.5) - np.log10(class_mass[self.kind[: self.tail]])
        r = np.array([xxhash.xxh64_intdigest(w) for w in (b"\0end", *words, *(b"\0tail%d" % k for k in range(ENDINGS)), b"\0before")], np.uint64)
        self.hash = r

    def __missing__(self, word: bytes) -> int:
        return self.tail + ending(word)

    def codes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Codes of the texts in a row, three of what stands before ahead of each; ends of texts; their words."""
        lead, parts, ends, words, at = [self.before] * 3, [], [], [], 0
        for x in raw:
            w = x.lower().split()
            words.append(w)
            parts += lead
            parts += map(self.__getitem__, w)
            parts.append(0)
            at += 4 + len(w)
            ends.append(at)
        return np.array(parts, np.int32), np.array(ends, np.int64), words

    def features(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of tokens, and their feature rows (one column a kind of feature)."""
        at = np.flatnonzero(codes != self.before)
        h = self.hash[codes]
        one, two, three = h[at - 1], h[at - 2], h[at - 3]
        pair = (one ^ two >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        shift = np.uint64(64 - 11)
        return at, np.stack([(x >> shift).astype(np.int32) + k * SLOTS for k, x in enumerate((one, pair, two, three))], 1)


def log_softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights[rows[:, 0]]
    for k in range(1, FEATURES):
        logits += weights[rows[:, k]]
    logits += bias
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return logits


def trained(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> None:
    """AdaGrad steps over the tokens, in place."""
    for k in range(0, len(kinds), STEP_TOKENS):
        some, y = rows[k : k + STEP_TOKENS], kinds[k : k + STEP_TOKENS]
        error = np.exp(log_softmax(weights, bias, some))
        error[np.arange(len(y)), y] -= 1
        for f in range(FEATURES):
            order = np.argsort(some[:, f].astype(np.int16), kind="stable")  # a radix sort
            slots = some[order, f]
            starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            grad = np.add.reduceat(error[order], starts)
            own = slots[starts]
            squares[own] += (grad * grad).mean(1)
            weights[own] -= RATE * grad / np.sqrt(squares[own])[:, None]


def fit(docs: DataFrame, vocabulary, bias: np.ndarray) -> np.ndarray:
    """Weights averaged over the partitions' runs. Both sums go block by block, first over 64 partitions at a time."""
    size = FEATURES * SLOTS // BLOCKS
    schema = pa.schema([("block", pa.int32()), ("part", pa.int64()), ("n", pa.float64()), ("w", pa.binary())])
    ddl = "block int, part long, n double, w binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        w, g, n = np.zeros((FEATURES * SLOTS, CLASSES), np.float32), np.full(FEATURES * SLOTS, 1e-3, np.float32), 0
        for b in batches:
            codes, _, _ = v.codes(common.raw_texts(b.column("text")))
            at, rows = v.features(codes)
            trained(w, g, bias, rows, v.kind[codes[at]])
            n += len(at)
        if n:
            own = TaskContext.get().partitionId()
            parts = w.astype(np.float16).reshape(BLOCKS, size, CLASSES)
            yield common.batch(schema, block=range(BLOCKS), part=[own // 64] * BLOCKS, n=[float(n)] * BLOCKS, w=[x.tobytes() for x in parts])

    def mean(key: tuple, table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist())
        total = np.zeros(size * CLASSES, np.float64)
        for share, x in zip(n / n.sum(), table.column("w").to_pylist(), strict=True):
            total += share * np.frombuffer(x, np.float16)
        return pa.table({"block": [key[0].as_py()], "part": [0], "n": [n.sum()], "w": [total.astype(np.float16).tobytes()]}, schema=schema)

    done = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, ddl).groupBy("block", "part").applyInArrow(mean, ddl).groupBy("block").applyInArrow(mean, ddl)
    out = np.zeros((BLOCKS, size * CLASSES), np.float32)
    for row in done.select("block", "w").collect():  # BLOCKS rows
        out[row["block"]] = np.frombuffer(row["w"], np.float16)
    return out.reshape(-1, CLASSES)


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = docs.where(is_training())
    counts = common.stored(word_counts(train), "counts")
    texts = train.count()
    sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()  # a row for each ending
    tokens, distinct = texts + sum(r["n"] for r in sums), (1 if texts else 0) + sum(r["v"] for r in sums)
    denominator = tokens + 0.5 * (distinct + 1)
    sizes = sorted(((r["k"], r["v"]) for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("k")).agg(F.count("*").alias("v")).collect()), reverse=True)
    least, room = None, head
    for k, v in sizes:
        if v > room:
            break
        least, room = k, room - v
    top = counts.where(F.floor(F.log2("n") * 8) >= least if least is not None else F.lit(False)).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])  # head rows at most
    words, n = top.column("word").cast(pa.binary()).to_pylist(), np.array(top.column("n").to_pylist(), float)
    mass = np.zeros(CLASSES)
    mass[0] = texts + 0.5
    for r in sums:
        mass[1 + TOP + r["ending"]] = r["n"] + 0.5 * r["v"]
    for k, (w, c) in enumerate(zip(words[:TOP], n[:TOP], strict=True)):
        mass[1 + k] = c + 0.5
        mass[1 + TOP + ending(w)] -= c + 0.5
    mass = np.maximum(mass, 1e-9)
    bias = np.log(mass / mass.sum()).astype(np.float32)
    once = sum(r["once"] for r in sums)
    unseen = min(0.5, max(once / tokens if tokens else 0.0, 0.5 / denominator))
    shared = spark.sparkContext.broadcast(Vocabulary(words, np.r_[texts, n], mass, denominator))  # at most head words
    weights = spark.sparkContext.broadcast(fit(train, shared, bias))
    known, new = math.log10(1 - unseen), math.log10(unseen)

    fields = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "tail": pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32()), ("lp", pa.float64())]))}
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = shared.value, weights.value
        for b in batches:
            codes, ends, words = v.codes(common.raw_texts(b.column("text")))
            at, rows = v.features(codes)
            kinds, lp = v.kind[codes[at]], np.empty(len(at))
            for k in range(0, len(at), 4 * STEP_TOKENS):
                part = slice(k, k + 4 * STEP_TOKENS)
                lp[part] = log_softmax(w, bias, rows[part])[np.arange(len(at[part])), kinds[part]] / LN10
            own = codes[at]
            seen = own < v.tail
            doc = np.searchsorted(ends, at, "right")
            size = len(ends)
            total = lambda x: np.bincount(doc, x, size)  # noqa: E731, B023
            base, inner = total(np.where(seen, v.base[own], 0.0)), total(np.where(seen, lp + v.inner[own] + known, 0.0))
            tails: list[dict] = [{} for _ in range(size)]
            first = np.r_[0, ends[:-1]] + 3
            for place, d, x in zip((at[~seen] - first[doc[~seen]]).tolist(), doc[~seen].tolist(), lp[~seen].tolist(), strict=True):
                word, mine = words[d][place], tails[d]
                had = mine.get(word)
                mine[word] = (had[0] + 1, had[1] + x) if had else (1, x)
            flat = [(k, *x) for t in tails for k, x in t.items()]
            items = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.binary()).cast(pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.float64())], ["word", "n", "lp"])
            tail = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in tails])].astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array([len(x) + 1 for x in words], pa.int64()), pa.array(total(seen & ((own > 0) | (texts > 0))).astype(np.int64)), pa.array(base), pa.array(inner), tail.cast(schema.field("tail").type)], schema=schema)

    rows = common.stored(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<word: string, n: int, lp: double>>"), "scores")
    rare = rows.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("times"), F.col("t.lp").alias("lp"))
    own = counts.where(F.floor(F.log2("n") * 8) < least) if least is not None else counts
    joined = rare.join(own, "word", "left")
    inside = F.element_at(F.array(*[F.lit(float(math.log10(x))) for x in mass[1 + TOP :]]), F.col("ending") + 1)
    base = F.col("times") * (F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5) - math.log10(denominator))
    model = F.when(F.col("n").isNull(), F.col("times") * F.lit(new)).otherwise(F.col("lp") + F.col("times") * (F.log10(F.col("n") + 0.5) - inside + F.lit(known)))
    late = joined.groupBy("row").agg(F.sum(base).alias("late_base"), F.sum(model).alias("late_score"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("late_known"))
    out = rows.drop("tail").join(late, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.col("score") + zero("late_score") if texts else F.col("base") + zero("late_base")
    return out.select(
        "doc_id", (~is_training()).alias("held_out"), "n_tokens", (F.col("n_known") + zero("late_known")).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("late_base")).alias("base_score"), total.alias("score"),
    )


def op4_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))
