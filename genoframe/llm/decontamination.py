"""Operator 2, benchmark decontamination by template windows.

Texts become canonical tokens: numbers, units and names are typed placeholders (slots), other words their lower-case
letters. Windows of WINDOW tokens with at least LITERAL literal ones are hashed as templates, windows richer in slots by their words as they
are, and items shorter than a window (but of SHORTEST tokens or more) whole, by their words. The benchmark's meet
those of all documents in a hash join. A bitmap of the benchmark's hashes, of one fixed size however large
the benchmark, keeps most document windows from the shuffle; what passes it is joined exactly.
A document's windows that stand about where an item's would, allowing for WINDOW words put in or left out, are one occurrence. Within it each
slot value of the item must be replaced by one value throughout (two may get the same one): windows against the commoner choice don't count.
The largest share of the item's tokens that an occurrence covers decides. Equal slots make an exact leak, others a re-parameterised one.

Null and empty texts and items, and items of fewer than SHORTEST tokens, match nothing; a row is given for each leaking row of
documents and item; repeated items give a row each time under their own item_id; a window's slots count once, however often rows repeat.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common

WINDOW, LITERAL, SHORTEST, COVERED, BITS = 8, 5, 5, 0.5, 24
# Written numbers and units of measure.
NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = set("mm cm km kg mg lb lbs oz ml kb mb gb tb hz khz mhz ghz kw kwh meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres mile miles inch inches foot feet yard yards pound pounds ounce ounces second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split())
NUMERAL = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?[a-z]{0,3}")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


SIGNS = re.compile(r"[\W_]+")
IN_NUMBERS = re.compile(r"[^\w+\-$€£.,:/%]+|_+")
DIGIT = re.compile(r"\d")


def canonical(word: str) -> tuple[str, str, str, bool] | None:
    """Its form within a sentence and at its start, its lower-case letters, and whether it ends a sentence; None for no token."""
    if word.isalpha():
        core, ends = word, False
    else:
        core = IN_NUMBERS.sub("", word).strip("+-.,:/") if DIGIT.search(word) else SIGNS.sub("", word)
        if not core:
            return None
        ends = word.rstrip("\"')]»”").endswith((".", "!", "?", ":"))
    low = core.lower()
    kind = "<number>" if low in NUMBERS or NUMERAL.fullmatch(low) else "<unit>" if low in UNITS else low
    name = "<name>" if kind is low and core[0].isupper() and not (len(core) > 1 and core.isupper()) else kind
    return name, kind, low, ends


class Canon(dict):
    """word -> its row in the arrays: hash within a sentence, at its start, and of the letters; slot within (1), at the start (2), ends a sentence (4). Row 0: no token."""

    CAPACITY = 400_000

    def __init__(self) -> None:
        super().__init__()
        self.n = 1
        self.hash = np.zeros((1 << 19, 3), np.uint64)
        self.flags = np.zeros(1 << 19, np.uint8)

    def __missing__(self, word: str) -> int:
        found = canonical(word)
        if found is None:
            self[word] = 0
            return 0
        name, kind, low, ends = found
        if self.n == len(self.flags):
            self.hash, self.flags = np.r_[self.hash, np.zeros_like(self.hash)], np.r_[self.flags, np.zeros_like(self.flags)]
        h = xxhash.xxh64_intdigest(kind)
        self.hash[self.n] = (h if name is kind else xxhash.xxh64_intdigest(name), h, h if kind is low else xxhash.xxh64_intdigest(low))
        self.flags[self.n] = (name is not low) + 2 * (kind is not low) + 4 * ends
        self[word] = self.n
        self.n += 1
        return self.n - 1


@common.sole
def canon() -> Canon:
    return Canon()


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width tokens (width: 1 or more), put together from runs of powers of two."""
    power, size, out, done = h, 1, None, 0
    while True:
        if width & size:
            part = power[done:]
            out = part if out is None else mixed(out[: len(part)] * MULTIPLIER + part)
            done += size
        if 2 * size > width:
            return out
        power = mixed(power[: max(0, len(power) - size)] * MULTIPLIER + power[size:])
        size *= 2


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * MULTIPLIER


class Windows:
    """Hashes of a text's windows, their places and widths, and the tokens of a window. short: widths of whole short items to look for."""

    def __init__(self, text: str, short: tuple[int, ...] | None = None) -> None:
        memo = canon()
        if len(memo) > memo.CAPACITY:
            memo.clear()
            memo.n = 1
        words = text.split()
        code = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
        self.words, self.place = words, np.flatnonzero(code)
        code = code[self.place]
        self.tokens = n = len(code)
        flags = memo.flags[code]
        first = np.r_[True, flags[:-1] & 4 > 0][:n]
        self.slot = np.where(first, flags & 2, flags & 1) > 0
        if short is None:  # an item
            short = (n,) if SHORTEST <= n < WINDOW else ()
        plain = memo.hash[code, 2] + np.uint64(1)
        parts = []
        if n >= WINDOW:
            count = np.r_[0, np.cumsum(self.slot)]
            good = WINDOW - (count[WINDOW:] - count[:-WINDOW]) >= LITERAL
            total = rolled(np.where(first, memo.hash[code, 1], memo.hash[code, 0]), WINDOW)
            if not good.all():
                total = np.where(good, total, rolled(plain, WINDOW))
            parts.append((total, WINDOW))
        parts += [(rolled(plain, w) + np.uint64(w), w) for w in short if n >= w]
        self.hash = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.hash ^= self.hash >> np.uint64(31)
        self.at = np.concatenate([np.arange(len(x)) for x, _ in parts]) if parts else np.zeros(0, np.int64)
        self.width = np.repeat([w for _, w in parts], [len(x) for x, _ in parts])

    def slots(self, k: int, width: int) -> list[str | None]:
        return [canonical(self.words[self.place[j]])[2] if self.slot[j] else None for j in range(k, k + width)]


HITS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("hash", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.string())), ("n_tokens", pa.int32())])
HITS_DDL = "row long, id long, hash long, at int, slots array<string>, n_tokens int"


def window_rows(table: DataFrame, bitmap=None, short: tuple[int, ...] | None = None) -> DataFrame:
    """The windows of (row, id, text), or those whose hash the bitmap may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for b in batches:
            out = []
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), common.texts(b.column("text")), strict=True):
                w = Windows(text, short)
                use = np.arange(len(w.hash))
                if bits is not None:
                    place = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
                    use = np.flatnonzero((bits[place >> 3] >> (place & 7)) & 1)
                for h, k, width in zip(w.hash[use].view(np.int64).tolist(), w.at[use].tolist(), w.width[use].tolist(), strict=True):
                    out.append((row, doc, h, k, w.slots(k, width), w.tokens))
            yield common.batch(HITS, **dict(zip(HITS.names, zip(*out, strict=True) if out else [[]] * 6, strict=True)))

    return table.mapInArrow(run, HITS_DDL)


def judged(rows: list[dict]) -> tuple[float, bool, int, int, int] | None:
    """Coverage, exactness, windows, first and last token in the document: the best occurrence in one document's and item's windows."""
    rows = sorted(rows, key=lambda r: (r["at"] - r["item_at"], r["at"]))
    occurrences: list[list[dict]] = []
    for r in rows:
        if occurrences and r["at"] - r["item_at"] - (occurrences[-1][-1]["at"] - occurrences[-1][-1]["item_at"]) <= WINDOW:
            occurrences[-1].append(r)
        else:
            occurrences.append([r])
    found = [x for x in map(occurrence, occurrences) if x]
    return max(found, key=lambda x: (x[0], x[1], x[2], -x[3])) if found else None


def occurrence(rows: list[dict]) -> tuple[float, bool, int, int, int] | None:
    """What the windows of one occurrence cover, under one choice for each slot value of the item: the commonest, of equals the value itself, then the least."""
    pairs = [{(x, y) for x, y in zip(r["item_slots"], r["slots"], strict=True) if x is not None} for r in rows]
    votes: dict[str, Counter] = defaultdict(Counter)
    for own in pairs:
        for x, y in own:
            votes[x][y or x] += 1
    chosen = {x: min(c, key=lambda y, c=c, x=x: (-c[y], y != x, y)) for x, c in votes.items()}
    fit = [(r, own) for r, own in zip(rows, pairs, strict=True) if all(chosen[x] == (y or x) for x, y in own)]
    if not fit:
        return None
    covered = {k for r, _ in fit for k in range(r["item_at"], r["item_at"] + len(r["item_slots"]))}
    last = max(r["at"] + len(r["slots"]) for r, _ in fit) - 1
    return len(covered) / fit[0][0]["item_tokens"], all(x == (y or x) for _, own in fit for x, y in own), len(fit), min(r["at"] for r, _ in fit), last


def leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, kind (exact, reparameterised), coverage, n_windows, first_token, last_token, text_hash."""
    spark = docs.sparkSession
    common.small_batches(spark)
    items = common.stored(window_rows(benchmark.select(F.col("item_id").cast("long").alias("row"), F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))), "items")
    place = F.shiftrightunsigned("hash", 64 - BITS)
    words = items.groupBy(F.shiftright(place, 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(hash, 40) & 31 as int))")).alias("b")).collect()  # 2^19 rows at most
    bits = np.zeros(1 << (BITS - 5), "<u4")
    for w, b in words:
        bits[w] = b
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    own = docs.select(F.xxhash64("text").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    lengths = items.where(F.col("n_tokens") < WINDOW).select("n_tokens").distinct().collect()  # WINDOW rows at most
    hits = window_rows(own, bitmap, tuple(sorted(r[0] for r in lengths)))
    pairs = hits.join(items.select("hash", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), F.col("n_tokens").alias("item_tokens")), "hash")
    one = pairs.groupBy("id", "row", "item_id").agg(F.collect_set(F.struct("at", "item_at", "slots", "item_slots", "item_tokens")).alias("rows"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("coverage", pa.float64()), ("n_windows", pa.int64()), ("first_token", pa.int64()), ("last_token", pa.int64()), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                got = judged(r["rows"])
                if got and got[0] >= covered:
                    out.append((r["id"], r["item_id"], "exact" if got[1] else "reparameterised", got[0], *got[2:], r["row"]))
            yield common.batch(schema, **dict(zip(schema.names, zip(*out, strict=True) if out else [[]] * 8, strict=True)))

    return one.mapInArrow(run, "doc_id long, item_id long, kind string, coverage double, n_windows long, first_token long, last_token long, text_hash long")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that leak a benchmark item."""
    return common.without(docs, leaks(docs, benchmark))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).drop("text_hash")
