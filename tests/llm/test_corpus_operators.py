"""Operators over many documents against brute force, with odd rows."""

import math
import random
import zlib
from collections import Counter

import pytest

from genoframe.llm import components, decontamination, maxent, minhash, neardup, paragraphs, quality

DDL = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def words(r, n):
    return [f"w{r.randint(0, 3000)}" for _ in range(n)]


def rows_of(texts):
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t), "x") for i, t in enumerate(texts)]


def corpus(seed=1):
    r = random.Random(seed)
    base = words(r, 120)
    texts = [" ".join(words(r, r.randint(5, 90))) for _ in range(60)]
    for _ in range(40):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randint(0, 9))
        texts.append(" ".join(w))
    return [*texts, *texts[:5], None, "", "   ", "one two", "One  TWO", "a b c d e", None, " ".join(base * 40)]


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = corpus()
    want, sizes = brute_components(texts, percent)
    got = sorted(minhash.near_duplicates(spark.createDataFrame(rows_of(texts), DDL), percent).collect(), key=lambda r: r["doc_id"])
    assert [r["component_id"] for r in got] == want and [r["n_shingles"] for r in got] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_pruning_bounds_keep_similar_pairs():
    for n, m in neardup.least_matches(85, 96, 1e-6):
        tail = sum(math.comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(m))
        assert tail < 1e-5


def test_components(spark):
    r = random.Random(5)
    edges = [(f"{a:03}", f"{b:03}") for a, b in ((r.randint(0, 80), r.randint(0, 80)) for _ in range(60))] + [(f"{k}x", f"{k + 1}x") for k in range(9)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {x["id"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_repeated_paragraphs(spark):
    r = random.Random(2)
    shared = " ".join(words(r, 60))
    near = shared.split()
    near[30] = "changed"
    texts = [f"intro {k}\n" + " ".join(words(r, 55)) for k in range(5)] + [f"start\n{shared}\nend", f"{shared}", "\n".join(["other", " ".join(near)]), f"{'z ' * 52}\n{'z ' * 52}", None, ""]
    got = {(x["doc_id"], x["para"], x["removed"], x["class_doc_id"]) for x in paragraphs.repeated(spark.createDataFrame(rows_of(texts), DDL)).collect()}
    within = {(8, 0, False, 8), (8, 1, True, 8), (8, 0, True, 8)}  # a line that repeats in its document, and the run of its words beyond the first 50
    assert got == {(5, 1, False, 5), (6, 0, True, 5), (7, 1, True, 5)} | within
    left = {x["doc_id"]: x for x in paragraphs.without_repeats(spark.createDataFrame(rows_of(texts), DDL)).collect()}
    assert 6 not in left and left[7]["text"] == "other" and left[7]["n_chars"] == 5 and left[5]["text"] == texts[5] and left[8]["text"].split() == ["z"] * 50 and len(left) == len(texts) - 1


def test_leaks(spark):
    r = random.Random(4)
    item = "Tom has 12 apples and buys 30 more pears before he walks over 5 km to the old market near Boston. How many fruits does he carry there now?"
    other = item.replace("12", "77").replace("30", "41").replace("Tom", "Jim").replace("5 km", "9 km").replace("Boston", "Leeds")
    mixed = other.replace("41", "77", 1)
    clean = " ".join(words(r, 80))
    texts = [clean, f"{clean} {item} {clean}", f"{clean}. {other} {clean}", None, "", item[:40], mixed]
    bench = spark.createDataFrame([(3, item), (4, "too short"), (5, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["kind"]) for x in decontamination.leaks(spark.createDataFrame(rows_of(texts), DDL), bench).collect()}
    assert {(1, 3, "exact"), (2, 3, "reparameterised")} <= got and {x[0] for x in got} <= {1, 2, 6}
    kept = {x["doc_id"] for x in decontamination.without_leaks(spark.createDataFrame(rows_of(texts), DDL), bench).collect()}
    assert {0, 3, 4, 5} <= kept and not kept & {1, 2}
    assert decontamination.leaks(spark.createDataFrame(rows_of(texts), DDL), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_short_dense_and_repeated_items(spark):
    r = random.Random(14)
    filler = lambda n: " ".join(words(r, n))
    dense = "Sort 12, 7, 30, 5, 4, 18, 3, 2 and 9"
    rolls = "A baker makes 12 rolls each morning before the shop opens and sells 9 rolls to the school near the river every day"
    texts = [
        f"{filler(30)} {dense} {filler(30)}", f"{filler(20)}. {rolls.replace('12', '7').replace('9', '7')}. {filler(9)}", f"{filler(9)} who wrote the old song {filler(5)}",
        f"{rolls[:55]} {filler(300)} {rolls[55:]}", filler(50), f"{filler(4)}. {rolls}", f"{filler(4)}. {rolls}", None,
    ]
    bench = spark.createDataFrame([(1, dense), (2, rolls), (3, "Who wrote the old song"), (4, "Who wrote"), (2, rolls), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "en", "s", None, 1, 2, 3) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", None, 1, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long, text_hash long, bad_id long, id long")
    got = [(x["doc_id"], x["item_id"], x["kind"]) for x in decontamination.leaks(docs, bench).collect()]
    assert {x for x in got if x[0] != 3} == {(0, 1, "exact"), (1, 2, "reparameterised"), (2, 3, "exact"), (5, 2, "exact"), (6, 2, "exact")}
    assert all(x["coverage"] < 0.75 for x in decontamination.leaks(docs, bench).where("doc_id = 3").collect())
    assert {x["doc_id"] for x in decontamination.without_leaks(docs, bench).collect()} - {3} == {4, 7}


def test_maxent_base_and_normalisation(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["the", "cat", "dog", "runs", "far", f"x{r.randint(0, 400)}"]) for _ in range(r.randint(1, 60))) for _ in range(150)] + [None, "", "The CAT"]
    docs = spark.createDataFrame(rows_of(texts), DDL)
    for head in (20, 1000):
        got = sorted(maxent.score(docs, head).collect(), key=lambda x: x["doc_id"])
        tokens = [(t or "").encode().lower().split() + [0] for t in texts]
        held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
        c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
        n, v = sum(c.values()), len(c)
        for x, t, h in zip(got, tokens, held, strict=True):
            assert x["held_out"] == h and x["n_tokens"] == len(t) and x["n_known"] == sum(c[w] > 0 for w in t) and x["train_tokens"] == n
            assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert sum(x["score"] for x in got if x["held_out"]) > sum(x["base_score"] for x in got if x["held_out"])
    assert maxent.score(spark.createDataFrame([], DDL)).count() == 0


def test_quality_on_held_out_rows(spark):
    r = random.Random(6)
    good = [" ".join(words(r, 60)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in words(r, 60)) if k % 2 else " ".join([*words(r, 59), "insult"]) for k in range(200)]
    docs = spark.createDataFrame(rows_of([*good, *bad, None, ""]), DDL)
    labels = spark.createDataFrame([(i, int(i < 300 or i % 2 == 0), int(i >= 300 and i % 2 == 0)) for i in range(500) if i % 3], "doc_id long, quality long, toxic long")
    got = {x["doc_id"]: x["keep"] for x in quality.scored(docs, labels).collect()}
    held = [i for i in range(500) if i % 3 == 0]
    assert sum(got[i] == (i < 300) for i in held) >= 0.95 * len(held) and len(got) == 502
    assert quality.kept(docs, labels).columns == docs.columns
    none = quality.scored(docs, labels.where("false")).collect()
    assert all(x["keep"] for x in none)


def test_stages_return_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.toPandas(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "/root/testdata/sf0.001").where("not decoded_same").count() == 0


def test_repeated_passages_against_all_runs(spark):
    """Passages over several short lines and within longer ones, against every run of 50 words."""
    r = random.Random(12)
    shared = [words(r, 70), words(r, 51), words(r, 200)]
    over_lines = "\n".join(" ".join(shared[0][k : k + 9]) for k in range(0, 70, 9))
    texts = [
        "é intro\n" + over_lines + "\nend of it", " ".join([*words(r, 40), *shared[0], *words(r, 70)]), " ".join([*words(r, 30), *shared[1], *words(r, 90)]),
        " ".join(words(r, 80)) + "\n" + "\n".join(["ünd", *(w.upper() for w in shared[1]), "x y"]), " ".join(shared[2]), "\n".join([*words(r, 8), *shared[2][20:140]]), " ".join(words(r, 49)), " ".join(words(r, 49)), None, "",
    ]
    rows = [(3 * i if i else None, t, "en", "s", None, "x") for i, t in enumerate(texts)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    tokens = [(t or "").encode().lower().split() for t in texts]
    seen, want = set(), {}
    for i in order:
        mine = [tuple(tokens[i][k : k + 50]) for k in range(len(tokens[i]) - 49)]
        want[rows[i][0], texts[i]] = {j for k, x in enumerate(mine) if x in seen for j in range(k, k + 50)}
        seen.update(mine)
    docs = spark.createDataFrame(rows, DDL)
    got = {(d, t): set() for d, t, *_ in rows}
    text_of = {d: t for d, t, *_ in rows}
    for x in paragraphs.repeated(docs).where("removed").collect():
        t = text_of[x["doc_id"]]
        before = len(t[: x["start_char"]].encode().split())
        got[x["doc_id"], t] |= set(range(before, before + len(t[x["start_char"] : x["end_char"]].encode().split())))
    assert got == want and sum(map(bool, want.values())) == 3
    left = {x["doc_id"]: x["text"] for x in paragraphs.without_repeats(docs).collect()}
    assert left[None] == "é intro\nend of it" and left[3] == texts[1] and left[9].endswith("\nünd\nx y") and len(left) == len(rows)


def test_stages_with_clashing_columns_and_empty_tables(spark):
    """Extra columns of any name pass through all stages; empty tables stay empty; repeated rows without words stay."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(15)
    names = ["text_hash", "gone", "gone_id", "bad_id", "label", "id", "row_key", "many", "d", "m", "g", "cuts", "whole", "rest"]
    shared = " ".join(words(r, 90))
    texts = [f"{shared}\n" + " ".join(words(r, 60 + 90 * k)) for k in range(2)] + ["", "", None, " ".join(words(r, 40))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names)
    docs = spark.createDataFrame([(None if k in (2, 3) else k, t, "en", "s", 7, *range(len(names))) for k, t in enumerate(texts)], schema)
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, rows, "/root/testdata/sf0.001")
            assert got.columns == docs.columns
            left = got.count()
            assert left == 0 if rows is not docs else left >= 5
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == rows.count()


def test_stages_with_null_and_repeated_ids(spark):
    """A stage takes the copy alone, not the other rows of its doc_id, null or not."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    a, b, c, d, shared = (" ".join(words(r, 80)) for _ in range(5))
    near = b.replace(b.split()[40], "changed", 1)
    rows = [(1, a), (None, a), (None, "clean one"), (None, ""), (None, None), (None, b), (None, near), (7, c), (8, c), (8, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows], DDL)
    left = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sum(x in left for x in ((None, b), (None, near))) == 1
    assert {x for x in left if x[1] not in (b, near)} == {(1, a), (None, "clean one"), (None, ""), (None, None), (7, c), (8, d)} and len(left) == 7
    rows = [(1, f"x\n{shared}"), (2, f"one\n{shared}\nend"), (2, f"two\n{d}\nend"), (None, f"three\n{shared}"), (None, f"four\n{c}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], DDL)
    left = {(x["doc_id"], x["text"]) for x in corpus_pipeline.substring_stage(spark, docs, "").collect()}
    assert left == {rows[0], (2, "one\nend"), rows[2], (None, "three"), rows[4]}


def test_quality_with_odd_rows(spark):
    r = random.Random(8)
    texts = [" ".join(words(r, 40)) if i % 2 else " ".join(w.upper() + "!!" for w in words(r, 40)) for i in range(120)]
    rows = rows_of(texts)
    rows += [rows[3], rows[3], (None, texts[4], None, None, None, "x"), (None, None, None, None, None, "x"), (7, texts[8], "en", "s1", 5, "x"), (500, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, DDL).withColumnRenamed("extra", "text_hash").withColumnRenamed("source", "source")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (81, None, 1), (5, 0, 0), (9_999, 1, None)], "doc_id long, quality long, toxic long")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows)
    by_text = {}
    for x in got:
        by_text.setdefault((x["doc_id"], x["text_hash"]), set()).add(round(x["score"], 9))
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(x["keep"] == bool(x["doc_id"] % 2) for x in got if x["doc_id"] is not None and 80 <= x["doc_id"] < 120) >= 38
    assert quality.kept(docs, labels).columns == docs.columns
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_quality_exchange_covers_all_unlabelled_texts(spark):
    docs = spark.createDataFrame([(i, f"text{i % 50}", "en", "s", 5, "x") for i in range(400)], DDL)
    table = quality.features(docs)
    own = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, good int")
    models = {"text": quality.Linear(quality.TEXT_BITS), "meta": quality.Linear(quality.META_BITS)}
    models["text"].bias = 4.0
    found = list(quality.surest(table, own, models, 0, 1000))
    hashes = {x[0] for x in docs.selectExpr("xxhash64(text)").distinct().collect()}
    labelled = {x[0] for x in docs.where("doc_id < 10").selectExpr("xxhash64(text)").collect()}
    assert {(v, k, label) for v, k, _, label in found} == {("meta", k, 1.0) for k in hashes - labelled} and len(found) == 40
