"""Operator 6, substring dedup: MinHash banding of paragraphs, exact checks, removals by component.

Documents of one word sequence are a class at once: all but the first are repeats as a whole. The first one's text goes
on in two kinds of paragraphs, which together cover all of it:

* Lines of at least min_words words. Lines of one word sequence are one item; items that agree in a band are compared on
  their full sets of five-word shingles (neardup.links, bands tuned for high recall). Of each component of links that occurs
  at two places the first stays.
* All runs of min_words words, over line ends and within longer lines (passages). A run's band key is the minimum
  of the hashes of its shingles of half its words: equal runs have equal minima, so none is missed, and neighbouring runs mostly
  share theirs, so few are kept. Runs whose minimum occurs at two places are compared whole, by a 64-bit hash; those that occur
  earlier too are removed, and a document's runs that overlap are given as one span. Spans within a line that is given
  already aren't given again.

Places go by (document, word); a document is a doc_id and text, in the order of (doc_id, nulls last; hash of the text). Repeats
within one document count if they don't overlap. min_words bounds what is removed: what is shorter stays. Null and
empty texts have no paragraphs; repeated rows count as one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common, neardup
from genoframe.llm.minhash import sequence_hash

MIN_WORDS = 50


class Marked:
    """Texts joined by line ends, with the places of words and lines."""

    def __init__(self, raw: list[bytes]) -> None:
        self.text = b"\n".join(raw)
        self.begins = np.cumsum([0, *(len(x) + 1 for x in raw)])  # of texts, in bytes
        signs = np.frombuffer(self.text, np.uint8)
        blank = (signs == 32) | (signs >= 9) & (signs <= 13)
        edge = np.diff(np.r_[True, blank, True].astype(np.int8))
        self.starts, self.ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        self.breaks = np.flatnonzero(signs == 10)
        self.words = neardup.words_of(self.text)
        self.first = np.searchsorted(self.starts, self.begins)  # word of each text
        self.h, _ = neardup.hashes_of([self.words])
        self.chars = None if self.text.isascii() else np.r_[0, np.cumsum(signs & 0xC0 != 0x80)]

    def char(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Characters from the text's beginning, of byte places in texts."""
        return at - self.begins[doc] if self.chars is None else self.chars[at] - self.chars[self.begins[doc]]

    def line_of(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Numbers of lines, of byte places in texts."""
        return np.searchsorted(self.breaks, at) - np.searchsorted(self.breaks, self.begins[doc])

    def lines(self, min_words: int) -> tuple[np.ndarray, ...]:
        """Text, first byte, last byte, first word, last word of the lines of min_words words or more."""
        starts, ends = np.r_[0, self.breaks + 1], np.r_[self.breaks, len(self.text)]
        one, two = np.searchsorted(self.starts, starts), np.searchsorted(self.starts, ends)
        long = np.flatnonzero(two - one >= min_words)
        return np.searchsorted(self.begins, starts[long], "right") - 1, starts[long], ends[long], one[long], two[long]

    def runs(self, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs of min_words words within one text: first word, and the least hash of the run's shingles of half its words."""
        half = (min_words + 1) // 2
        low, wide, size = neardup.mixed(grams(self.h, half)), min_words - half + 1, 1
        if len(low) < wide:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        while 2 * size <= wide:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = low if size == wide else np.minimum(low[: size - wide], low[wide - size :])
        inside = np.ones(len(low), bool)
        for end in self.first[1:]:
            inside[max(0, end - min_words + 1) : end] = False
        at = np.flatnonzero(inside)
        return at, low[at].view(np.int64)


def grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words, from those of runs of powers of two."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if width & size:
            part = power[done:]
            out = part if out is None else neardup.mixed(out[: len(part)] * neardup.PRIME + part)
            done += size
        if 2 * size > width:
            return out
        power = neardup.mixed(power[:-size] * neardup.PRIME + power[size:])
        size *= 2


LINE = {"para": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "n_words": pa.int32(), "id": pa.binary(), "sig": pa.binary()}
LINE_DDL = "para int, start_char int, end_char int, n_words int, id binary, sig binary"


def digests(docs: DataFrame, min_words: int, hashes: int) -> DataFrame:
    """A row each text of min_words words or more: its identity, hash of the word sequence, span of the words, long lines, and the distinct minima
    of its runs, each with whether it occurs at two places that may not overlap."""
    lows = pa.list_(pa.struct([("low", pa.int64()), ("twice", pa.bool_())]))
    schema = pa.schema([
        ("row_key", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("same", pa.binary()), ("n_words", pa.int32()), ("para", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()),
        ("lines", pa.list_(pa.struct(list(LINE.items())))), ("lows", lows),
    ])

    def lists(values: pa.Array, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = Marked(common.raw_texts(b.column("text")))
            n, size = len(b), np.diff(m.first)
            doc, start, end, one, two = m.lines(min_words)
            rows, begins = neardup.shingle_rows(m.h, one, two)
            sig = neardup.signatures(rows, begins, hashes)
            parts = [m.line_of(start, doc), m.char(start, doc), m.char(end, doc), two - one, [sequence_hash(m.words[i:j]) for i, j in zip(one.tolist(), two.tolist(), strict=True)], [x.tobytes() for x in sig]]
            lines = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, LINE.values(), strict=True)], list(LINE))
            at, low = m.runs(min_words)
            owner = np.searchsorted(m.first, at, "right") - 1
            new = np.flatnonzero(np.r_[True, (np.diff(low) != 0) | (np.diff(owner) != 0)][: len(at)])
            last = np.r_[new[1:], len(at)][: len(new)] - 1
            order = np.lexsort((new, low[new], owner[new]))
            low_, owner_, first, last = low[new][order], owner[new][order], at[new][order], at[last][order]
            heads = np.flatnonzero(np.r_[True, (np.diff(low_) != 0) | (np.diff(owner_) != 0)][: len(low_)])
            far = np.maximum.reduceat(last, heads) - first[heads] >= min_words if len(heads) else np.zeros(0, bool)
            own = pa.StructArray.from_arrays([pa.array(low_[heads]), pa.array(far, pa.bool_())], ["low", "twice"])
            full = np.flatnonzero(size >= min_words)
            from_, to = m.starts[m.first[full]], m.ends[m.first[full + 1] - 1]
            out = pa.RecordBatch.from_arrays([
                *(b.column(c).take(pa.array(full)) for c in ("row_key", "doc_id", "text_hash")), pa.array([sequence_hash(m.words[m.first[k] : m.first[k + 1]]) for k in full], pa.binary()),
                pa.array(size[full], pa.int32()), pa.array(m.line_of(from_, full), pa.int32()), pa.array(m.char(from_, full), pa.int32()), pa.array(m.char(to, full), pa.int32()),
                lists(lines, doc, n, schema.field("lines").type).take(pa.array(full)), lists(own, owner_[heads], n, lows).take(pa.array(full)),
            ], schema=schema)
            yield out

    return docs.mapInArrow(run, f"row_key long, doc_id long, text_hash long, same binary, n_words int, para int, start_char int, end_char int, lines array<struct<{LINE_DDL.replace(' ', ': ').replace(',:', ',')}>>, lows array<struct<low: long, twice: boolean>>")


RUNS = {"at": pa.int32(), "para": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "slot": pa.int32(), "run": pa.int64()}


def runs(docs: DataFrame, min_words: int) -> DataFrame:
    """For each row of docs (ord, text, lows) the runs whose minimum is among lows: place in words, line of the first word, characters from and
    to, and slot: the run's number among the row's distinct runs, whose hashes are in run."""
    schema = pa.schema([("ord", pa.int64()), *((c, pa.list_(t)) for c, t in RUNS.items())])

    def lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            ords = pa.array([last, *b.column("ord").to_pylist()])
            last = ords[-1].as_py()
            b = b.filter(pc.fill_null(pc.not_equal(ords[1:], ords[:-1]), True))  # equal rows come from the join one after another
            m, n, lows = Marked(common.raw_texts(b.column("text"))), len(b), b.column("lows")
            at, low = m.runs(min_words)
            owner = np.searchsorted(m.first, at, "right") - 1
            ends = np.searchsorted(owner, np.arange(n + 1))
            use = np.concatenate([np.zeros(0, bool), *(np.isin(low[ends[k] : ends[k + 1]], lows[k].values.to_numpy()) for k in range(n))])
            at, owner = at[use], owner[use]
            run_ = grams(m.h, min_words)[at].view(np.int64)
            order = np.lexsort((run_, owner))
            heads = np.r_[True, (np.diff(run_[order]) != 0) | (np.diff(owner[order]) != 0)][: len(order)]
            own, place_ = order[heads], np.cumsum(heads) - 1
            slot = np.empty(len(order), np.int64)
            slot[order] = place_ - np.searchsorted(owner[own], owner[order])
            starts, stops = m.starts[at], m.ends[at + min_words - 1]
            parts = [at - m.first[owner], m.line_of(starts, owner), m.char(starts, owner), m.char(stops, owner), slot]
            yield pa.RecordBatch.from_arrays([b.column("ord"), *(lists(x, owner, n, t) for x, t in zip(parts, RUNS.values(), strict=False)), lists(run_[own], owner[own], n, pa.int64())], schema=schema)

    return docs.mapInArrow(run, "ord long, at array<int>, para array<int>, start_char array<int>, end_char array<int>, slot array<int>, run array<long>")


SPAN = {"ord": pa.int64(), "para": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(), "n_words": pa.int32(), "class_ord": pa.int64(), "removed": pa.bool_()}


def place(*more: str) -> F.Column:
    """The order of places: documents by (doc_id, nulls last; text_hash), then more."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", *more)


def passages(docs: DataFrame, firsts: DataFrame, min_words: int) -> DataFrame:
    """Spans of a document's overlapping runs that stay, and of those that are removed; the class is that of a span's first run.

    firsts: row_key, doc_id, text_hash, lows. Documents with a shared minimum are numbered in their order (ord): numbers combine before shuffles."""
    lows = firsts.select("row_key", F.explode("lows").alias("x")).select("row_key", "x.*")
    shared = lows.groupBy("low").agg(F.min("row_key").alias("a"), F.max("row_key").alias("z"), F.max("twice").alias("twice")).where("a <> z or twice").select("low")
    wanted = lows.join(shared, "low").groupBy("row_key").agg(F.collect_set("low").alias("lows"))
    wanted = wanted.join(firsts.select("row_key", "doc_id", "text_hash").dropDuplicates(["row_key"]), "row_key").orderBy(F.col("doc_id").isNull(), "doc_id", "text_hash")
    wanted = common.stored(wanted.withColumn("ord", F.monotonically_increasing_id()), "wanted")
    found = common.stored(runs(docs.join(wanted.select("row_key", "ord", "lows").hint("merge"), "row_key").select("ord", "text", "lows"), min_words), "runs")
    each = found.select("ord", F.posexplode("run").alias("k", "run"))
    ends = each.groupBy("run").agg(F.min("ord").alias("stays"), F.max("ord").alias("last")).where("stays < last").select("run", "stays")
    marks = each.join(ends, "run").groupBy("ord").agg(F.collect_list(F.struct("k", "stays")).alias("marks"))
    schema = pa.schema(list(SPAN.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, doc in enumerate(b.column("ord").to_pylist()):
                at, para, start, end, slot = (b.column(c)[k].values.to_numpy() for c in list(RUNS)[:5])
                if not len(at):
                    continue
                stays, own = np.full(slot.max() + 1, -1, np.int64), b.column("marks")[k]
                if own.is_valid:
                    stays[own.values.field("k").to_numpy()] = own.values.field("stays").to_numpy()
                first = np.full(len(stays), -1, np.int64)
                first[slot[::-1]] = at[::-1]
                again = at - first[slot] >= min_words
                twice = np.zeros(len(stays), bool)
                twice[slot[again]] = True
                earlier = (stays[slot] >= 0) & (stays[slot] < doc)
                gone = earlier | again
                kept = ~gone & (at == first[slot]) & ((stays[slot] == doc) | twice[slot])
                for removed, those in ((False, kept), (True, gone)):
                    x = np.flatnonzero(those)
                    i = x[np.r_[True, np.diff(at[x]) > min_words][: len(x)]]
                    j = x[np.r_[np.diff(at[x]) > min_words, True][: len(x)]]
                    classes = np.where(earlier[i], stays[slot[i]], doc)
                    out += zip([doc] * len(i), para[i].tolist(), start[i].tolist(), end[j].tolist(), (at[j] - at[i] + min_words).tolist(), classes.tolist(), [removed] * len(i), strict=True)
            yield common.batch(schema, **dict(zip(schema.names, zip(*out, strict=True) if out else [[]] * 7, strict=True)))

    spans = found.drop("run").join(marks, "ord", "left").mapInArrow(run, "ord long, para int, start_char int, end_char int, n_words int, class_ord long, removed boolean")
    spans = spans.join(wanted.select("ord", "row_key", "doc_id", "text_hash"), "ord").join(wanted.select(F.col("ord").alias("class_ord"), F.col("doc_id").alias("class_doc_id")), "class_ord")
    out = common.stored(spans.select("row_key", "doc_id", "text_hash", "para", "start_char", "end_char", "n_words", "class_doc_id", "removed").distinct(), "spans")
    common.dropped(wanted, found)
    return out


def repeated(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_hash, para (line), start_char, end_char, n_words, class_doc_id (document of the place that stays), removed."""
    common.small_batches(docs.sparkSession)
    bands, rows = neardup.tuned(percent, miss=2e-5, most=16)  # unlike paragraphs share no shingles, so few rows do
    hashes = -(-bands * rows // neardup.BATCH) * neardup.BATCH
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text")).withColumn("row_key", F.xxhash64("doc_id", "text_hash"))
    found = common.stored(digests(docs, min_words, hashes), "digests")
    span = ["row_key", "doc_id", "text_hash", "para", "start_char", "end_char", "n_words"]

    # Whole documents
    whole = found.groupBy("same").agg(F.min(place("row_key")).alias("stays"), F.max(place("row_key")).alias("last")).where("stays.row_key <> last.row_key").select("same", "stays")
    copies = common.stored(found.select("same", *span).join(whole, "same").select(*span, F.col("stays.doc_id").alias("class_doc_id"), (F.col("row_key") != F.col("stays.row_key")).alias("removed")).distinct(), "copies")
    others = copies.where("removed").select("row_key")
    firsts = lambda *columns: found.select("row_key", "doc_id", "text_hash", *columns).join(others, "row_key", "left_anti")

    # Lines
    bare = F.expr("transform(lines, x -> struct(x.para, x.start_char, x.end_char, x.n_words, x.id)) as lines")
    places = firsts(bare).select("row_key", "doc_id", "text_hash", F.explode("lines").alias("line")).select("row_key", "doc_id", "text_hash", "line.*")
    items = found.select(F.explode("lines").alias("line")).select("line.id", "line.sig")
    label = neardup.links(items, lambda wanted: line_texts(docs, found, wanted), percent, bands, rows, lambda: neardup.jaccard_at_least(percent))
    places = common.stored(places.join(label, "id", "left").withColumn("label", F.coalesce("label", "id")).drop("id"), "places")
    order = place("para", "row_key")
    classes = places.groupBy("label").agg(F.min(order).alias("stays"), F.max(order).alias("last")).where("stays <> last").select("label", "stays")
    kept = F.expr("row_key = stays.row_key and para = stays.para")
    lines = common.stored(places.join(classes, "label").select(*span, F.col("stays.doc_id").alias("class_doc_id"), (~kept).alias("removed")).distinct(), "lines")
    common.dropped(places)

    # Passages
    given = lines.select("row_key", F.col("removed").alias("gone"), F.col("start_char").alias("line_start"), F.col("end_char").alias("line_end"))
    spans = passages(docs, firsts("lows"), min_words).alias("s")
    common.dropped(found)
    inside = F.expr("s.row_key = g.row_key and s.start_char >= g.line_start and s.end_char <= g.line_end and (g.gone or not s.removed)")
    spans = spans.join(given.alias("g"), inside, "left_anti")
    return copies.unionByName(lines).unionByName(spans).drop("row_key")


def line_texts(docs: DataFrame, found: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and text of the wanted lines, each from one place; a document's lines are cut out together."""
    lines = found.select("row_key", F.explode("lines").alias("x")).select("row_key", "x.id", "x.start_char", "x.end_char")
    one = lines.join(wanted, "id").groupBy("id").agg(F.min(F.struct("row_key", "start_char", "end_char")).alias("x"))
    cuts = one.groupBy("x.row_key").agg(F.collect_list(F.struct("id", "x.start_char", "x.end_char")).alias("cuts"))
    schema = pa.schema([("id", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [(x["id"], t[x["start_char"] : x["end_char"]]) for t, cuts in zip(common.texts(b.column("text")), b.column("cuts").to_pylist(), strict=True) for x in cuts]
            yield common.batch(schema, id=[x for x, _ in some], text=[x for _, x in some])

    return docs.join(cuts.hint("merge"), "row_key").select("text", "cuts").mapInArrow(run, "id binary, text string")


def without_repeats(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with removed lines and passages cut from text and n_chars counted anew; rows that had words and have none left go."""
    cuts = F.array_sort(F.collect_set(F.struct(F.col("start_char").cast("int").alias("s"), F.col("end_char").cast("int").alias("e"))))
    gone = repeated(docs, percent, min_words).where("removed").groupBy("doc_id", "text_hash").agg(cuts.alias("cuts"))
    # A cut of whole lines takes their line end along.
    ends = "x.e + if((x.s = 0 or substring(d.text, x.s, 1) = '\\n') and substring(d.text, x.e + 1, 1) = '\\n', 1, 0)"
    left = f"aggregate(g.cuts, struct('' as kept, 0 as at), (a, x) -> struct(concat(a.kept, substring(d.text, a.at + 1, greatest(x.s - a.at, 0))) as kept, greatest(a.at, {ends}) as at), a -> if(a.at >= length(d.text), regexp_replace(a.kept, '\\n$', ''), concat(a.kept, substring(d.text, a.at + 1))))"
    joined = docs.alias("d").join(gone.hint("merge").alias("g"), F.expr("d.doc_id <=> g.doc_id and xxhash64(d.text) = g.text_hash"), "left")
    text = F.expr(f"if(g.cuts is null, d.text, {left})")
    other = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    rows = joined.select(text.alias("text"), F.expr("g.cuts is null as whole"), F.col("d.n_chars").alias("n_chars"), F.struct(*other).alias("rest"))
    rows = rows.where("whole or text rlike '[^ \\t\\n\\r\\f\\x0B]'")
    size = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return rows.select(*({"text": F.col("text"), "n_chars": size.alias("n_chars")}.get(c, F.col(f"rest.`{c}`")) for c in docs.columns))


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(common.read(spark, sf_dir, "documents")).drop("text_hash")
