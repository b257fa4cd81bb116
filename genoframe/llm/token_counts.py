"""Operator 1, token counts: a byte-fallback BPE vocabulary compiled to a deterministic transducer.

States of the machine stand for "what the encoding of the text so far looks like, as far as it can
matter later": the longest suffix that some piece begins with, with the last token and the relative
token count at each of its positions. A transition on a character carries the number of tokens it adds
(it may be negative when pieces melt together). States are made when first reached and shared.
A sequence of pieces is the encoding of its text exactly if each adjacent pair is the encoding of the pair's text, so
the pairs decide every transition.

No piece spans a non-space followed by a space mark, nor two characters that stand side by side in no
piece: there every chunk of text resets the machine. So a chunk's state map is constant behind its
first reset and is kept as (open head, tokens between, open tail). Maps compose associatively; chunks of
a long text are mapped on their own and combined by a prefix scan of logarithmic depth.

Null and empty texts have 0 tokens; repeated rows each give a row; only the columns asked for are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import add

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
CHUNK_CHARS = 1 << 16
#: Memo sizes of a worker; they cost time and change no result.
MAX_WORDS, MAX_UNITS, MAX_STATES, MAX_PAIRS = 400_000, 400_000, 150_000, 400_000


def merged(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """Greedy merging by best score, leftmost first on ties."""
    n = len(symbols)
    text: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-scores[p], i, i + 1, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in scores]
    heapify(heap)
    while heap:
        _, i, j, p = heappop(heap)
        a, b = text[i], text[j] if j < n else None
        if a is None or b is None or after[i] != j or a + b != p:
            continue
        text[i], text[j] = p, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := p + text[k]) in scores:
                heappush(heap, (-scores[q], i, k, q))
        if (h := before[i]) >= 0 and (q := text[h] + p) in scores:
            heappush(heap, (-scores[q], h, i, q))
    return [x for x in text if x is not None]


class PieceVocabulary:
    """Pieces and scores of a sentencepiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in ids}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p))}

    def units(self, segment: str) -> list[str]:
        """Parts between which no piece can span."""
        inside = self.inside
        cuts = [k for k, pair in enumerate(map(add, segment, segment[1:]), 1) if pair not in inside]
        return [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)]


class CountTransducer(common.Memo):
    """Token counts of segments, as a memo keyed by the segment without its single space mark."""

    def __init__(self, vocabulary: PieceVocabulary) -> None:
        super().__init__(MAX_WORDS)
        self.v = vocabulary
        self.unit_counts = common.Memo(MAX_UNITS)
        self.pairs: dict[tuple[str, str], bool] = {}
        self._empty()

    def _empty(self) -> None:
        self.keys: list[tuple] = [("", (None,), (0,))]
        self.index = {self.keys[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def fits(self, a: str | None, b: str) -> bool:
        """Whether b may follow a (None: nothing) in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[(a, b)] = merged(list((a or "") + b), self.v.scores) == ([a, b] if a else [b])
        return known

    def move(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state on a character: next state, tokens added."""
        suffix, last, count = self.keys[state]
        text, scores = suffix + c, self.v.scores
        for j in range(len(text)):
            token = text[j:]
            if (token in scores or len(token) == 1) and last[j] != "" and self.fits(last[j], token):
                total = count[j] + (1 if token in scores else len(token.encode()))
                break
        else:
            raise ValueError(f"no encoding of {text!r}")
        lasts, counts = (*last, token), (*count, total)
        k = next((k for k in range(len(text)) if text[k:] in self.v.prefixes), len(text))
        key = (text[k:], lasts[k:], tuple(x - total for x in counts[k:]))
        nxt = self.index.get(key)
        if nxt is None:
            nxt = self.index[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        found = self.moves[state][c] = (nxt, total)
        return found

    def run(self, unit: str) -> int:
        if len(self.keys) > MAX_STATES:
            self._empty()
        state = total = 0
        moves = self.moves
        for c in unit:
            state, more = moves[state].get(c) or self.move(state, c)
            total += more
        return total

    def segment(self, segment: str) -> int:
        if len(segment) > 1 and segment[1] == SPACE:  # pieces of space marks only share one score: ties go by place
            n = len(segment) - len(segment.lstrip(SPACE))
            parts = self.v.units(segment[n - 1 :]) if len(segment) > n else [segment[n - 1 :]]
            head = merged([*(SPACE * (n - 1)), *parts[0]], self.v.scores)
            return sum(1 if x in self.v.scores else len(x.encode()) for x in head) + sum(map(self.unit, parts[1:]))
        return sum(map(self.unit, self.v.units(segment)))

    def unit(self, unit: str) -> int:
        found = self.unit_counts.get(unit)
        if found is None:
            found = self.run(unit)
            self.unit_counts.keep(unit, found)
        return found

    def __missing__(self, word: str) -> int:
        found = self.segment(SPACE + word)
        if len(word) < 64:
            self.keep(word, found)
        return found

    def segments(self, text: str) -> int:
        """Tokens of escaped text that begins and ends at a reset."""
        if text.startswith(SPACE) and SPACE * 2 not in text:
            return sum(map(self.__getitem__, text[1:].split(SPACE)))
        return sum(self.segment(x) if not x.startswith(SPACE) or x.startswith(SPACE * 2) else self[x[1:]] for x in SEGMENT.findall(text))

    def chunk(self, text: str) -> tuple[str, bool, int, str]:
        """State map of a chunk: (open head, has a reset, tokens between, open tail). Resets are where no piece can span, so heads and tails are short."""
        inside = self.v.inside
        start = next((k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inside), None)
        if start is None:
            return text, False, 0, ""
        end = next(k for k in range(len(text) - 1, 0, -1) if text[k - 1 : k + 1] not in inside)
        return text[:start], True, self.segments(text[start:end]) if end > start else 0, text[end:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if not a[1] and not b[1]:
            return a[0] + b[0], False, 0, ""
        if not a[1]:
            return a[0] + b[0], True, b[2], b[3]
        if not b[1]:
            return a[0], True, a[2], a[3] + b[0]
        return a[0], True, a[2] + self.segments(a[3] + b[0]) + b[2], b[3]

    def scan(self, maps: list[tuple]) -> list[tuple]:
        """Inclusive prefix compositions, in steps that double the reach; each step's compositions are independent.

        Chunks in a row without a reset are one open head, put together at once."""
        maps = [x for reset, group in groupby(maps, lambda x: x[1]) for x in (group if reset else [("".join(x[0] for x in group), False, 0, "")])]
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[k - step], x) if k >= step else x for k, x in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= CHUNK_CHARS:
            return self.segments(text)
        head, _, inner, tail = self.scan([self.chunk(text[k : k + CHUNK_CHARS]) for k in range(0, len(text), CHUNK_CHARS)])[-1]
        return self.segments(head) + inner + (self.segments(tail) if tail else 0)


@common.sole
def transducer(path: str) -> CountTransducer:
    return CountTransducer(PieceVocabulary(path))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. model: path of a sentencepiece BPE model."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in batches:
            n = [machine.count(x) for x in common.texts(b.column("text"))]
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield common.batch(schema, doc_id=b.column("doc_id"), n_bytes=size, n_tokens=n, over_limit=[x > limit for x in n])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
