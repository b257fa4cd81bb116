"""Operators on single texts against the libraries, brute force and exact round trips."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from genoframe.llm import html_extraction, nbest, token_counts, token_planes, transport_stream  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "  ", " ", "\n", "é", "语", "▁", "\0", "the", "ing", "<s>", "🙂", "aaaa", "\t", "x" * 40, "12", ".", "<|endoftext|>", "'s", "　", "\x1c"]


def odd_texts(n: int) -> list[str]:
    r = random.Random(7)
    return ["", " ", " " * 300, "▁" * 33, "ab " * 30000, "x" * 3000, *("".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n))]


def test_token_counts_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    machine = token_counts.transducer(PIECES)
    for x in odd_texts(600):
        assert machine.count(x) == len(library.encode(x)), x[:50]


def test_chunk_maps_compose_to_the_whole(monkeypatch):
    machine = token_counts.transducer(PIECES)
    texts = odd_texts(150)
    whole = [machine.count(x) for x in texts]
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 7)
    assert [machine.count(x[:4000]) for x in texts if len(x) <= 4000] == [n for x, n in zip(texts, whole, strict=True) if len(x) <= 4000]


@pytest.mark.parametrize("part", ["语文字", "ab", "x", "Zm9vYmFy", "▁", "é語"])
def test_long_texts_without_spaces_are_counted_in_linear_time(part):
    import time

    import sentencepiece

    machine, library = token_counts.CountTransducer(token_counts.PieceVocabulary(PIECES)), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = part * (300_000 // len(part))
    assert machine.count(text) == len(library.encode(text))
    began = time.time()
    machine.count(part * (3_000_000 // len(part)))
    assert time.time() - began < 30


def test_segment_ids_equal_the_library():
    memo = token_planes.segment_ids(public_tokenizers.path("byte_bpe_50k.json"))
    for x in odd_texts(600):
        assert memo.encode(x) == memo.ids(x), x[:50]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 9, 70000])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 50257, n).astype("<u4")
    width, ends, payload = token_planes.packed(ids, bits)
    assert (token_planes.unpacked(payload, ends, n, width, bits) == ids).all()


def test_token_files_spread_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(400)], "doc_id long, text string")
    rows = token_planes.chunks(docs, public_tokenizers.path("byte_bpe_50k.json")).select("shard", "doc_ids").collect()
    assert len({r.shard for r in rows}) > 1 and sum(len(r.doc_ids) for r in rows) == 400


def test_token_files_give_starts_and_crcs(spark):
    rows = [(5, "some text"), (2, None), (9, ""), (5, "some text"), (1, "other  words here"), (None, "x")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_planes.documents_of(token_planes.chunks(spark.createDataFrame(rows, "doc_id long, text string"), path)).collect()
    memo, at = token_planes.segment_ids(path), 0
    want = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.r_[np.frombuffer(memo.ids(text or ""), memo.kind).astype("<u4"), np.zeros(1, "<u4")].astype("<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_planes.documents_of(token_planes.chunks(spark.createDataFrame([], "doc_id long, text string"), path)).count() == 0


@pytest.mark.parametrize("n", [64, 128, 832, 11264, 16320, 16384, 16448, 70016])
def test_transport_stream_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    media = transport_stream.write_stream(payload)
    got = transport_stream.parse_stream(media)
    assert got["payload"] == payload and got["gaps"] == got["lost_sync"] == 0 and len(media) % 188 == 0
    assert got["streams"] == [(0x100, 6)] and len(got["pts"]) == got["units"] and got["random_access"][0] == 2
    damaged = transport_stream.parse_stream(media[: 188 * 4] + media[188 * 5 :] if n > 1000 else media[:-10])
    assert damaged["gaps"] + damaged["lost_sync"] > 0


def test_media_digest_of_odd_rows(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "héllo")]
    got = {r["doc_id"]: r for r in transport_stream.media_features(transport_stream.media_table(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for doc, text in rows:
        body = transport_stream.padded((text or "").encode())
        assert got[doc]["payload_sha256"] == hashlib.sha256(body).hexdigest() and got[doc]["tail_crc32"] == zlib.crc32(body[-64:])
    assert got[1]["media_sha256"] == got[4]["media_sha256"] and got[2]["payload_bytes"] == 64


def test_html_extraction():
    page = "<!DOCTYPE html><html><head><title>t</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title &amp; more</h1><p><b>First   part<br>of it.<p>Second &eacute;<!-- no -->.</p><div class=comments><p>Nice!</p></div></article><footer>&copy; me</footer>"
    assert html_extraction.extract(page) == "Title & more\n\nFirst part of it.\n\nSecond é."
    assert html_extraction.extract("") == html_extraction.extract("<p>") == html_extraction.extract("<script>unclosed") == ""


WORDS = " ".join(f"word{k}" for k in range(20))


@pytest.mark.parametrize(
    ("part", "stays"),
    [
        ("<p><a href=x>Read the earlier report</a></p><p>Here %s</p>", True),
        ("<section id='related-work'><p>Here %s</p></section>", True),
        ("<div class='ad-hoc-network'><p>Here %s</p></div>", True),
        ("<div id=share-price><p>Here %s</p></div>", True),
        ("<div class='section-header'><h2>Here</h2></div><p>%s</p>", True),
        ("<p>%s <math><mi>Here</mi></math></p>", True),
        ("<p title=it's>Here %s</p>", True),
        ("<p title='a > b'>Here %s</p>", True),
        ("<div class='related-posts'><p>Here %s</p></div>", False),
        ("<div class='box adBanner'><p>Here %s</p></div>", False),
        ("<div id=comments><p>Here %s</p></div>", False),
        ("<select><option>Here</select><p>%s</p>", False),
    ],
)
def test_html_extraction_of_parts(part, stays):
    page = f"<body><nav>Menu</nav><article><h1>Title</h1><p>First {WORDS}</p>{part % WORDS}</article><footer>End</footer>"
    assert ("Here" in html_extraction.extract(page)) is stays


@pytest.mark.parametrize("piece", ['<a x="', '<a x="><b" ', "<a ", "<! ", "</script ", '<script x="', "<", '<a = = "', "<!-"])
def test_html_extraction_takes_linear_time(piece):
    began = time.time()
    assert html_extraction.extract("<article><p>Some words</p></article>" + piece * 100_000).startswith("Some words")
    assert time.time() - began < 20  # by the square of the length this took hours


def test_html_extraction_of_tables(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", "<article><p>One two</p></article>", "x"), (None, None, None, None), (1, "u", "<article><p>One two</p></article>", "x"), (2, "v", "", "y")]
    got = html_extraction.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "One two", 7), (1, "One two", 7), (2, "", 0)]
    assert html_extraction.extract_pages(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("n", [1, 250, 5000])
def test_html_extraction_closes_at_any_depth(n):
    body = "<article><h1>The title</h1><p>First part of the text.</p></article><footer>nobody</footer>"
    want = "The title\n\nFirst part of the text."
    assert html_extraction.extract("<nav><ul>" + "<li><a href=x>Menu</a>" * n + "</ul></nav>" + body) == want
    assert html_extraction.extract("<nav>" + "<div>" * n + "Menu</nav>" + body) == want
    inner = html_extraction.blocks("<article><table>" + "<tr><td>one<td>two" * n + "</table></article><p>after</p>")
    assert [b[3] for b in inner] == [1] * (2 * n) + [0]
    nested = html_extraction.blocks("<ul><li class=menu>a<ul><li>b<li>c</ul>d<li>e</ul>f")
    assert [(b[0], b[4]) for b in nested] == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 0), ("f", 0)]


def brute(machine, text, n):
    text = token_counts.SPACE + text.replace(" ", token_counts.SPACE)
    out = []

    def walk(at, score):
        if at == len(text):
            out.append(score)
            return
        for end in range(at + 1, min(len(text), at + 16) + 1):
            e = machine.edges.get(text[at:end]) or (machine.edge(text[at]) if end == at + 1 else None)
            if e:
                walk(end, score + e[0])

    walk(0, 0.0)
    return sorted(out, reverse=True)[:n]


def test_nbest_against_all_paths():
    machine = nbest.segmenter(PIECES, 3)
    r = random.Random(3)
    for _ in range(150):
        x = "".join(r.choice(["a", "th", "e ", " ", "in", "é", "语", "ab", "🙂"]) for _ in range(r.randint(1, 6)))
        got = machine.nbest(x)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s in brute(machine, x, 3)] == [round(s, 6) for s in machine.encode(x)[1]]
        for _, ids in got:
            assert machine.decode(np.array(ids, "<u2").tobytes()) == x
    assert machine.encode("") == (b"", [0.0])


def test_segments_of_plain_words_go_past_the_pattern():
    """Words of letters and marks reach the model directly; everything must equal the library on the whole text."""
    import random

    import public_tokenizers

    from genoframe.llm import token_planes

    memo = token_planes.SegmentIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert memo.cuttable
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("ab z\u00c0\u00d7\u01bf\u024f.,'s'll!?-_`{}1\u00b2\u2167\n\t \u3000\u65e5\u00e9 ") for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(memo.encode(text), memo.kind).tolist() == memo.library.encode(text, add_special_tokens=False).ids
    other = token_planes.SegmentIds(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.cuttable
    assert np.frombuffer(other.encode("Ab c, d"), other.kind).tolist() == other.library.encode("Ab c, d", add_special_tokens=False).ids


def test_all_segmentations_are_given(spark):
    r = random.Random(13)
    texts = ["", None, "aaaa aaaa", "the end of it all", *("".join(r.choice(["a", "th", "e ", " ", "in", "é", "语", "ab", "🙂"]) for _ in range(r.randint(1, 9))) for _ in range(60))]
    machine = nbest.segmenter(PIECES, 3)
    got = nbest.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PIECES).collect()
    assert len(got) == len(texts) and all(x["decoded_same"] for x in got)
    for x in got:
        text = texts[x["doc_id"]] or ""
        ids = [bytes(y) for y in (x["ids"], *x["other_ids"])]
        assert len(set(ids)) == len(ids) == len(x["scores"]) == len(machine.nbest(text)) and {machine.decode(y) for y in ids} == {text}
        assert [np.frombuffer(y, "<u2").tolist() for y in ids] == [y for _, y in machine.nbest(text)]
        if text.isascii():
            assert x["scores"] == pytest.approx([sum(score_of(machine, i) for i in np.frombuffer(y, "<u2").tolist()) for y in ids])


def score_of(machine, i):
    return next(s for p, s in machine.v.scores.items() if machine.v.ids[p] == i)


def test_media_is_stored_and_read_back(spark):
    docs = spark.createDataFrame([(1, "héllo"), (2, None), (None, "x" * 500)], "doc_id long, text string")
    got = transport_stream.stored_features(docs)
    assert any("/media-" in x for x in got.inputFiles())
    assert sorted(map(str, got.collect())) == sorted(map(str, transport_stream.media_features(transport_stream.media_table(docs)).collect()))
