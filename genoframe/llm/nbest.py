"""Operator 10, SentencePiece encoding and decoding: the N best segmentations of whole texts.

A text's piece lattice has an edge for each piece (with the model's score) and for each character that is no piece (its
UTF-8 bytes as byte pieces, under the worst piece's score). A forward Viterbi pass gives each place the best
score of a path up to it; backward A-star search from the end uses those scores as its estimates.
They are exact, so paths come out best first and no path is expanded in vain.

Where no piece spans a place, all paths pass it: the lattice falls into segments with N best paths of their
own, which a worker keeps by segment. The best paths of the text are those of the segments with the least loss,
found by the same best-first search over segments. Equal scores go by place, then by order found.
Decoding joins pieces and bytes, turns marks into spaces and drops the first.

Null and empty texts encode to no piece, with score 0 and one segmentation; repeated rows give a row each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoframe.llm import common
from genoframe.llm.token_counts import SEGMENT, SPACE, PieceVocabulary

N_BEST, MAX_WORDS, MAX_UNITS = 3, 300_000, 300_000
NEVER = -1e9
NOTHING, NONE = (None, False), float("-inf")


class Segmenter(common.Memo):
    """Best paths of segments, keyed by the segment without its single space mark.

    A value is (ids of the best path as bytes, its score, loss of the second); further paths are searched where they are wanted."""

    def __init__(self, vocabulary: PieceVocabulary, n: int) -> None:
        super().__init__(MAX_WORDS)
        self.v, self.n = vocabulary, n
        #: An id's type: 16 bits, or 32 where the vocabulary has more ids.
        self.kind = "<u2" if max([*vocabulary.ids.values(), *vocabulary.byte_ids]) < 1 << 16 else "<u4"
        usable = {p: s for p, s in vocabulary.scores.items() if s > NEVER}
        self.unknown = min(usable.values(), default=0.0) - 10
        self.edges = {p: (s, np.array([vocabulary.ids[p]], self.kind).tobytes()) for p, s in vocabulary.scores.items()}
        #: Of pieces and their beginnings: the edge, and whether a longer piece begins so.
        self.known = {p: (self.edges.get(p), p in vocabulary.prefixes) for p in (*vocabulary.prefixes, *self.edges)}
        #: The same by characters: each node's edge and the nodes that follow it.
        self.trie: dict = {}
        for piece, e in self.edges.items():
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(piece[-1], [None, {}])[0] = e
        self.units = common.Memo(MAX_UNITS)
        self.spelled = {i: p.replace(SPACE, " ").encode() for p, i in vocabulary.ids.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}

    def edge(self, c: str) -> tuple[float, bytes]:
        return self.unknown, np.array([self.v.byte_ids[b] for b in c.encode()], self.kind).tobytes()

    def forward(self, unit: str) -> tuple[list[float], list[list]]:
        """The best score up to each place, and the edges into it."""
        get, size = self.known.get, len(unit)
        best, into = [0.0] + [-np.inf] * size, [[] for _ in range(size + 1)]
        for start in range(size):
            so_far = best[start]
            for end in range(start + 1, size + 1):
                e, more = get(unit[start:end], NOTHING)
                if e is None and end == start + 1:
                    e = self.edge(unit[start])
                if e is not None:
                    into[end].append((start, e))
                    if so_far + e[0] > best[end]:
                        best[end] = so_far + e[0]
                if not more:
                    break
        return best, into

    def first(self, unit: str) -> tuple[bytes, float, float]:
        """Ids and score of the best path, and the loss of the second: it leaves the best path by one edge at one place.

        The forward pass keeps the best and the second score of the edges into each place."""
        if len(unit) == 1:
            score, ids = self.edges.get(unit) or self.edge(unit)
            return ids, score, np.inf
        size = len(unit)
        best, second, taken, came = [0.0] + [NONE] * size, [NONE] * (size + 1), [b""] * (size + 1), [0] * (size + 1)
        for start in range(size):
            so_far, node, end = best[start], self.trie, start
            for c in unit[start:]:
                end += 1
                e, node = node.get(c, NOTHING)
                if e is None and end == start + 1:
                    e = self.edge(c)
                if e is not None:
                    score, ids = e
                    score += so_far
                    if score > best[end]:
                        second[end], best[end], taken[end], came[end] = best[end], score, ids, start
                    elif score > second[end]:
                        second[end] = score
                if not node:
                    break
        at, parts, loss = size, [], np.inf
        while at:
            loss = min(loss, best[at] - second[at])
            parts.append(taken[at])
            at = came[at]
        return b"".join(parts[::-1]), best[-1], loss

    def search(self, unit: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids) of a unit, by backward A-star over exact forward scores."""
        if len(unit) == 1:
            return [self.edges.get(unit) or self.edge(unit)]
        best, into = self.forward(unit)
        # Entries stand for disjoint sets of paths, and each knows its best path's cost: as many as are still wanted suffice.
        out, front, made = [], [(-best[-1], 0, len(unit), 0.0, b"")], 0
        while front:
            cost, _, at, behind, ids = front.pop(0)
            if at == 0:
                out.append((-cost, ids))
                continue
            for start, e in into[at]:
                made += 1
                front.append((-(best[start] + behind + e[0]), made, start, behind + e[0], e[1] + ids))
            front.sort()
            del front[self.n - len(out) :]
        return out

    def unit(self, unit: str) -> tuple[bytes, float, float]:
        found = self.units.get(unit)
        if found is None:
            found = self.first(unit)
            if len(unit) < 64:
                self.units.keep(unit, found)
        return found

    def paths(self, segment: str) -> list[tuple[float, bytes]]:
        """The N best paths through a segment's units: best first over the units' losses."""
        lists = [self.search(x) for x in self.v.units(segment)]
        total = sum([x[0][0] for x in lists])
        ways = combos([(x[0][0] - x[r][0], k, r) for k, x in enumerate(lists) for r in range(1, len(x))], self.n)
        return [(total - loss, b"".join(x[way.get(k, 0)][1] for k, x in enumerate(lists))) for loss, way in ways]

    def __missing__(self, word: str) -> tuple:
        found = self.segment(SPACE + word)
        if len(word) < 64:
            self.keep(word, found)
        return found

    def segment(self, segment: str) -> tuple[bytes, float, float]:
        parts = [self.unit(x) for x in self.v.units(segment)]
        if len(parts) == 1:
            return parts[0]
        return b"".join([x[0] for x in parts]), sum([x[1] for x in parts]), min([x[2] for x in parts])

    def segments(self, text: str) -> tuple[list[str], list[tuple]]:
        if not text:
            return [], []
        text = SPACE + text.replace(" ", SPACE)
        if SPACE * 2 not in text:
            words = text[1:].split(SPACE)
            return words, list(map(self.__getitem__, words))
        found = SEGMENT.findall(text)
        return [x[1:] for x in found], [self.segment(x) if x.startswith(SPACE * 2) else self[x[1:]] for x in found]

    def ways(self, words: list[str], parts: list[tuple]) -> list[tuple[float, dict[int, bytes]]]:
        """Score and changed segments of the N best segmentations. Only the N - 1 segments of least loss can change."""
        near = nsmallest(self.n - 1, range(len(parts)), key=[x[2] for x in parts].__getitem__)
        paths = {k: self.paths(SPACE + words[k]) for k in near if parts[k][2] < np.inf}
        for k, found in paths.items():  # of equal scores the search may have put another path first
            if found[0][1] != parts[k][0]:
                paths[k] = [(found[0][0], parts[k][0]), *[x for x in found if x[1] != parts[k][0]]][: self.n]
        total = float(sum([x[1] for x in parts]))
        chosen = combos([(x[0][0] - x[r][0], k, r) for k, x in paths.items() for r in range(1, len(x))], self.n)
        return [(total - loss, {k: paths[k][r][1] for k, r in way.items()}) for loss, way in chosen]

    def encode(self, text: str) -> tuple[bytes, list[float]]:
        """Ids of the best segmentation as little-endian numbers, and the scores of the N best."""
        words, parts = self.segments(text)
        return b"".join([x[0] for x in parts]), [score for score, _ in self.ways(words, parts)]

    def every(self, text: str) -> tuple[list[bytes], list[float], bool]:
        """Ids and scores of the N best segmentations, and whether each decodes to the text (marks as spaces)."""
        words, parts = self.segments(text)
        best = [x[0] for x in parts]
        ids, ways, same = [b"".join(best)], self.ways(words, parts), True
        for _, way in ways[1:]:
            other = best.copy()
            for k, x in way.items():
                other[k] = x
                same = same and self.bytes_of(x) == self.bytes_of(best[k])  # decoding joins the bytes of the segments
            ids.append(b"".join(other))
        return ids, [score for score, _ in ways], same and self.decode(ids[0]) == text.replace(SPACE, " ")

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations, as (score, ids)."""
        words, parts = self.segments(text)
        return [(score, np.frombuffer(b"".join([way.get(k, x[0]) for k, x in enumerate(parts)]), self.kind).tolist()) for score, way in self.ways(words, parts)]

    def decode(self, ids: bytes) -> str:
        return self.bytes_of(ids).decode(errors="replace")[1:]

    def bytes_of(self, ids: bytes) -> bytes:
        return b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, self.kind).tolist()))


def combos(options: list[tuple[float, int, int]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n sets of options (loss, part, rank), one a part at most, with the least sums; the empty set first."""
    options = sorted(options)
    out: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    heap = [(loss, (j,)) for j, (loss, _, _) in enumerate(options) if loss < np.inf]
    heapify(heap)
    while heap and len(out) < n:
        loss, chosen = heappop(heap)
        out.append((loss, {options[j][1]: options[j][2] for j in chosen}))
        used = {options[j][1] for j in chosen}
        for j in range(chosen[-1] + 1, len(options)):
            if options[j][1] not in used and options[j][0] < np.inf:
                heappush(heap, (loss + options[j][0], (*chosen, j)))
    return out


@common.sole
def segmenter(path: str, n: int) -> Segmenter:
    return Segmenter(PieceVocabulary(path), n)


def encoded(docs: DataFrame, model: str, n: int = N_BEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id; n_pieces, ids (little-endian numbers of 16 bits, of 32 for a vocabulary over 65,536) and ids_crc32 of the best segmentation; other_ids of ranks 2 to N; scores (best first); decoded_same, of all N."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("other_ids", pa.list_(pa.binary())), ("scores", pa.list_(pa.float64())), ("decoded_same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = segmenter(model, n)
        for b in batches:
            got = [machine.every(x) for x in common.texts(b.column("text"))]
            best = [ids[0] for ids, _, _ in got]
            yield common.batch(schema, doc_id=b.column("doc_id"), n_pieces=[len(x) // int(machine.kind[2]) for x in best], ids=best, ids_crc32=[zlib.crc32(x) for x in best], other_ids=[ids[1:] for ids, _, _ in got], scores=[s for _, s, _ in got], decoded_same=[x for _, _, x in got])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids binary, ids_crc32 long, other_ids array<binary>, scores array<double>, decoded_same boolean")


def op10_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(common.read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
