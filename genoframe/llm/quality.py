"""Operator 8, quality classifier by co-training of two views.

The text view is a logistic model over hashed distinct words and a few bucketed text statistics; the metadata view
one over source, language, length and their pairs. Both start from labelled documents (good: quality 1 and not toxic). In each
round both views score all unlabelled texts; the ones each view is surest of, found by distributed top lists, get its label, and
the other view learns from them. Platt scaling on labelled documents held back calibrates each view; a logistic model over both
calibrated log-odds scores all documents. Features are computed once and stored; rounds and scoring read them back.

The labelled sample is bounded: LABELLED documents by hash order of doc_id, one row of each (that of the least text hash). All texts
none of whose rows has a label take part in the exchange, each text once; EXCHANGED of them a view, kind and round are taken.
Scoring covers every document and its whole text. Null and empty texts are scored on what they have; null metadata is a
value of its own; repeated rows are scored alike; without labels of both kinds everything is kept (score null);
without unlabelled texts there is nothing to exchange, and each view learns from the labels alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common

#: LABELLED: labelled documents of a fit at most. EXCHANGED: texts that a view labels for the other, of each kind in each round, of log-odds CONFIDENT at least.
LABELLED = 12_000
TEXT_BITS, META_BITS, ROUNDS, EXCHANGED, CONFIDENT = 18, 12, 3, 500, 3.0
#: Slots of the statistics come first, those of the words after them. A word has a say if the classes differ in it by SURE standard errors.
STATS, SURE = 2048, 4.5
STRIP = b".,;:!?\"'()[]{}<>|*#$%&"


@common.sole
def word_slots() -> common.Memo:
    class Slots(common.Memo):
        def __missing__(self, word: bytes) -> int:
            found = STATS + xxhash.xxh64_intdigest(word.strip(STRIP)) % ((1 << TEXT_BITS) - STATS)
            self.keep(word, found)
            return found

    return Slots(400_000)


def text_features(raw: bytes) -> np.ndarray:
    """Slots of the distinct words, and of the statistics' buckets, each once."""
    words = raw.split()
    low = raw.lower().split()
    n = max(len(words), 1)
    upper = sum(map(bytes.isupper, words)) / n
    signs = {s: raw.count(s) / n for s in (b"|", b"!!", b"%%%", b"###", b"$$$", b"***", b"&&&", b"http", b"@")}
    short = [f"upper{round(upper * 8)}", f"len{len(raw).bit_length()}", f"mean{min(20, len(raw) // n)}", f"distinct{round(8 * len(set(low)) / n)}", f"lines{raw.count(10).bit_length()}"]
    short += [f"{s!r}{min(9, round(v * 16))}" for s, v in signs.items()]
    slots = {xxhash.xxh64_intdigest(x) % STATS for x in short}
    slots.update(map(word_slots().__getitem__, low))
    return np.fromiter(slots, np.int32, len(slots))


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    size = "none" if n_chars is None else str(int(n_chars).bit_length())
    parts = [f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}", f"l{lang}n{size}"]
    return np.unique(np.array([xxhash.xxh64_intdigest(x) % (1 << META_BITS) for x in parts], np.int32))


class Linear:
    """Logistic regression over binary features, fitted by AdaGrad; of the slots from always on, only telling ones are used."""

    def __init__(self, bits: int) -> None:
        self.w, self.g, self.bias, self.gb = np.zeros(1 << bits, np.float32), np.full(1 << bits, 1e-6, np.float32), 0.0, 1e-6

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        size = np.array([len(x) for x in rows])
        flat = np.concatenate(rows) if size.sum() else np.zeros(0, np.int32)
        return np.bincount(np.repeat(np.arange(len(rows)), size), self.w[flat], len(rows)) + self.bias

    def fit(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, always: int, epochs: int = 8, rate: float = 0.3, batch: int = 128, seed: int = 0) -> None:
        size = np.array([len(x) for x in rows])
        flat = np.concatenate(rows)
        n1, n0 = (np.maximum(1.0, (y == c).sum()) for c in (1, 0))
        h1, h0 = (np.bincount(flat, np.repeat(y == c, size), len(self.w)) for c in (1, 0))
        p = (h1 + h0 + 1) / (n1 + n0 + 2)
        use = np.abs(h1 / n1 - h0 / n0) >= SURE * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        use[:always] = True
        rows = [x[use[x]] for x in rows]
        r = np.random.default_rng(seed)
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                some = [rows[i] for i in own]
                size = np.array([len(x) for x in some])
                error = (1 / (1 + np.exp(-np.clip(self.scores(some), -30, 30))) - y[own]) * weight[own]
                slots, back = np.unique(np.concatenate(some), return_inverse=True)
                grad = np.bincount(back, np.repeat(error, size), len(slots)).astype(np.float32)
                self.g[slots] += grad * grad
                self.w[slots] -= rate * grad / np.sqrt(self.g[slots])
                e = float(error.mean())
                self.gb += e * e
                self.bias -= rate * e / self.gb**0.5


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a small dense logistic regression with a last column of ones, by Newton steps with a weak ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def co_train(text: list[np.ndarray], meta: list[np.ndarray], y: np.ndarray, exchange: Callable[[dict[str, Linear], int], Iterator[tuple]]) -> dict:
    """Weights of both views, their calibrations and their combination; y: 1 good, 0 bad. Every fifth row is held back to calibrate.

    exchange(models, round) gives (view, text, its slots, label): what that view shall learn next."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), bool)
    fit = np.flatnonzero(~held)
    balance = lambda t: np.where(t > 0.5, len(t) / max(1, 2 * (t > 0.5).sum()), len(t) / max(1, 2 * (t <= 0.5).sum())) ** 0.5
    views = {"text": (text, TEXT_BITS), "meta": (meta, META_BITS)}
    given: dict[str, dict[int, tuple[np.ndarray, float]]] = {"text": {}, "meta": {}}  # pseudo-labelled texts that a view was given
    models: dict[str, Linear] = {}
    for turn in range(ROUNDS + 1):
        for name, (rows, bits) in views.items():
            models[name] = Linear(bits)
            more = [given[name][k] for k in sorted(given[name])]
            target = np.r_[y[fit], [t for _, t in more]]
            trust = np.r_[np.ones(len(fit)), np.full(len(more), 0.3)]
            models[name].fit([rows[i] for i in fit] + [x for x, _ in more], target, trust * balance(target), min(STATS, 1 << bits) if name == "text" else 1 << bits, seed=turn)
        if turn < ROUNDS:
            for name, key, slots, label in exchange(models, turn):
                given[name][key] = (slots, label)
    use = np.flatnonzero(held) if held.any() else fit
    out = {}
    logits = []
    for name, (rows, _) in views.items():
        s = models[name].scores([rows[i] for i in use])
        platt = logistic(np.c_[s, np.ones(len(s))], y[use])
        out[name] = (models[name].w, models[name].bias, platt)
        logits.append(s * platt[0] + platt[1])
    out["both"] = logistic(np.c_[logits[0], logits[1], np.ones(len(use))], y[use])
    return out


FEATURES = "doc_id long, text_hash long, text_slots array<int>, meta_slots array<int>"


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and both views' slots of every whole text."""
    slots = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_slots", slots), ("meta_slots", slots)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            meta = [meta_features(*x) for x in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]
            text = [text_features(x) for x in common.raw_texts(b.column("text"))]
            yield common.batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), text_slots=text, meta_slots=meta)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    return plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, FEATURES)


def view_scores(b: pa.RecordBatch, weights: dict[str, tuple[np.ndarray, float]]) -> dict[str, np.ndarray]:
    """Log-odds of a batch's rows in each view."""
    out = {}
    for name, (w, bias) in weights.items():
        column = b.column(f"{name}_slots")
        rows = np.repeat(np.arange(len(b)), column.value_lengths().to_numpy(zero_copy_only=False))
        out[name] = np.bincount(rows, w[column.flatten().to_numpy()], len(b)) + bias
    return out


def slots_of(table: pa.Table, column: str) -> list[np.ndarray]:
    return [np.array(x, np.int32) for x in table.column(column).to_numpy(zero_copy_only=False)]


def surest(table: DataFrame, own: DataFrame, models: dict[str, Linear], turn: int, each: int) -> Iterator[tuple]:
    """(view, text, slots, label) of the unlabelled texts that the other view is surest of. Scores of all texts are shuffled, their features aren't."""
    shared = table.sparkSession.sparkContext.broadcast({k: (m.w, m.bias) for k, m in models.items()})  # about 1 MB, of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text", pa.float64()), ("meta", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), **view_scores(b, shared.value))

    rows = table.mapInArrow(run, "doc_id long, text_hash long, text double, meta double")
    rows = rows.groupBy("doc_id", "text_hash").agg(F.min("text").alias("text"), F.min("meta").alias("meta"))
    # a text goes if any of its rows is labelled, else it counts by its row of least doc_id
    marked = rows.join(own, "doc_id", "left").groupBy("text_hash").agg(F.min(F.struct("doc_id", "text", "meta")).alias("r"), F.count("good").alias("n"))
    pool = common.stored(marked.where("n = 0").select("text_hash", "r.text", "r.meta"), "pool")
    tops = []
    for name, other in (("text", "meta"), ("meta", "text")):
        for label, sure, order in ((1.0, F.col(name) > CONFIDENT, F.col(name).desc()), (0.0, F.col(name) < -CONFIDENT, F.col(name).asc())):
            tops.append(pool.where(sure).orderBy(order, F.xxhash64("text_hash", F.lit(turn)), "text_hash").limit(each).select("text_hash", F.lit(other).alias("view"), F.lit(label).alias("label")))
    chosen = reduce(DataFrame.unionByName, tops)
    found = table.join(F.broadcast(chosen), "text_hash")  # 4 * each rows at most are broadcast, and come back
    some = found.groupBy("view", "text_hash", "label").agg(F.min(F.struct("doc_id", "meta_slots", "text_slots")).alias("r")).select("view", "text_hash", "label", "r.meta_slots", "r.text_slots").toArrow()
    common.dropped(pool)
    slots = {"text": slots_of(some, "text_slots"), "meta": slots_of(some, "meta_slots")}
    for k, (view, key, label) in enumerate(zip(*(some.column(c).to_pylist() for c in ("view", "text_hash", "label")), strict=True)):
        yield view, key, slots[view][k], label


def fitted(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, each: int = EXCHANGED) -> dict | None:
    """The model co-trained on a table of features, or None without labels of both kinds. Conflicting labels of a document count as bad."""
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good"))
    chosen = own.orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(labelled)  # labelled rows of two numbers: small enough to broadcast
    found = table.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("text_hash", "meta_slots", "text_slots")).alias("r"))
    rows = found.select("doc_id", "good", "r.meta_slots", "r.text_slots").toArrow().sort_by([("doc_id", "ascending")])
    y = np.array(rows.column("good").to_pylist(), float)
    if len(set(y)) < 2:
        return None
    order = np.argsort([xxhash.xxh64_intdigest(str(i)) for i in rows.column("doc_id").to_pylist()], kind="stable")
    text, meta = slots_of(rows, "text_slots"), slots_of(rows, "meta_slots")
    return co_train([text[i] for i in order], [meta[i] for i in order], y[order], lambda models, turn: surest(table, own, models, turn, each))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score (probability of a good document), keep, and a hash of the text."""
    spark = docs.sparkSession
    common.small_batches(spark)
    table = common.stored(features(docs), "quality")
    model = spark.sparkContext.broadcast(fitted(table, labels))  # about 1 MB, of fixed size
    names = {"doc_id": pa.int64(), "text_hash": pa.int64(), "p_text": pa.float64(), "p_meta": pa.float64(), "score": pa.float64(), "keep": pa.bool_()}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            none = [None] * len(b)
            if m is None:
                yield common.batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), p_text=none, p_meta=none, score=none, keep=[True] * len(b))
                continue
            raw = view_scores(b, {v: m[v][:2] for v in ("text", "meta")})
            logit = [raw[v] * m[v][2][0] + m[v][2][1] for v in ("text", "meta")]
            both = logit[0] * m["both"][0] + logit[1] * m["both"][1] + m["both"][2]
            p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*logit, both)]
            yield common.batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), p_text=p[0], p_meta=p[1], score=p[2], keep=p[2] >= threshold)

    return table.mapInArrow(run, "doc_id long, text_hash long, p_text double, p_meta double, score double, keep boolean")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rejected rows."""
    return common.without(docs, scored(docs, labels, threshold).where("not keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")).drop("text_hash")
