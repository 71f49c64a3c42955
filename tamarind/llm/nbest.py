"""SentencePiece n-best segmentation and decoding.

Pieces come from a public SentencePiece model. A segmentation's score is the sum of its
pieces' scores, here ``-ln(2 + rank)`` with the rank that a BPE model stores as its score
(a Zipf prior: BPE models have no probabilities). A character without a piece falls back to
its UTF-8 bytes' pieces, at ``BYTE_SCORE`` each.

Best-first. A forward Viterbi pass over the lattice gives each position's best score from
the start; a backward A-star search from the end uses it as its heuristic. As it is exact,
complete segmentations leave the queue in order of their scores, best first. For the best
one alone the forward pass suffices: it follows its own way back, and the second best one
leaves that way at the position where the next best edge costs least.

A text is cut where no piece of the vocabulary can cross (read off the pieces: pairs of
character classes that no piece holds side by side). The units between cuts are segmented
one by one, and a worker keeps what it has found. The n best of a whole text differ from
the best in few units: only the n - 1 units whose second choice costs least can matter, and
their choices are merged.

Spaces become U+2581, one is put in front, and nothing else is normalised. A U+2581 in the
text itself goes by its bytes, so that decoding always gives the text back.

Nulls: a null text is empty and has one segmentation, without pieces. A null id is kept.
Repeated rows are kept; an empty table gives an empty result. Other columns are neither
read nor returned. Ties between segmentations are settled by the order of the search,
which depends on the text alone.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarind.llm.common import map_batches, small_batches

SPACE = "▁"
#: Stands for a U+2581 of the text itself until it goes by its bytes. Not a character that texts can hold.
MARK = "\ud800"
BYTE_SCORE = -12.0
#: A word with the spaces before it; pieces that go on over a following space rule it out.
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Words whose best segmentation a worker keeps: about 450 MB.
KEPT_UNITS = 1_400_000
#: Chunks whose n best segmentations a worker keeps: about 15 MB.
KEPT_CHOICES = 20_000
#: Score of what can't be reached.
NEVER = -1e300
NBEST = 4
LOSS = itemgetter(0)
#: Classes of characters, as regular expression sets; what is in none is a class of its own.
KINDS = {"space": SPACE, "letter": "A-Za-zÀ-ÖØ-öø-ɏ", "digit": "0-9", "mark": "!-/:-@\\[-`{-~", "control": "\x00-\x1f\x7f"}


def _le(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Pieces:
    """A vocabulary: pieces with scores, bytes, and where texts can be cut."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_at: list[int], surfaces: list[bytes]):
        self.bytes_at, self.surfaces = bytes_at, surfaces
        self.entry = {piece: (score, _le([number])) for piece, (number, score) in pieces.items()}
        self.trie: list = [0.0, 0, {}]  # a node is [score, a bit for its length if it is a piece, children by character]
        for piece, (score, _) in self.entry.items():
            node = self.trie
            for c in piece:
                node = node[2].setdefault(c, [0.0, 0, {}])
            node[:2] = score, 1 << len(piece)
        self.longest = max(map(len, pieces), default=1)
        self.units, self.plain = self._cut_rule(pieces)
        self.chunked = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.kept: dict[str, tuple[bytes, float, float]] = {}
        self.choices: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, bytes_at, surfaces = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                bytes_at[int(text[3:5], 16)] = i
                surfaces.append(bytes([int(text[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surfaces.append(b"")
            else:
                pieces[text] = (i, -float(np.log(2 - model.get_score(i))))
                surfaces.append(text.replace(SPACE, " ").encode())
        return cls(pieces, bytes_at, surfaces)

    @staticmethod
    def _cut_rule(pieces) -> tuple[Callable, Callable]:
        """Finds a text's units, in order, cut between classes that no piece holds side by side; and parts of one unit for sure."""
        sets = {k: re.compile(f"[{v}]") for k, v in KINDS.items()}

        def kind(c: str) -> str:
            return next((k for k, s in sets.items() if s.match(c)), "other")

        beside = {(kind(a), kind(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        of = {k: f"[{v}]" for k, v in KINDS.items()} | {"other": f"[^{''.join(KINDS.values())}]"}
        uncut = [f"(?<={of[a]}){of[b]}{'++' if a == b else ''}" for a in of for b in of if (a, b) in beside]
        sure = {("space", "letter"), ("letter", "letter")} <= beside
        units = re.compile(f"(?s:.)(?:{'|'.join(uncut)})*+" if uncut else "(?s:.)")
        return units.findall, re.compile(f"{SPACE}?[{KINDS['letter']}]*" if sure else "").fullmatch

    def forward(self, unit: str) -> tuple[list[float], list[int], list[float], list[int]]:
        """Viterbi: each position's best score from the start, a bit for the length of each edge that ends there,
        the score by the next best edge, and where the best edge starts, the longest one where they are equal."""
        n, top, longest = len(unit), self.trie[2], self.longest
        best, ends, second, back = [0.0] + [NEVER] * n, [0] * (n + 1), [NEVER] * (n + 1), [0] * (n + 1)
        start = 0
        for i, c in enumerate(unit, 1):
            here, node = best[start], top.get(c)
            if node is None or not node[1]:  # no piece for this character alone
                score, bit, children = self.spelt(c)[0], 2, node[2] if node else {}
            else:
                score, bit, children = node
            ends[i] |= bit
            if (score := here + score) > best[i]:
                second[i], best[i], back[i] = best[i], score, start
            elif score > second[i]:
                second[i] = score
            j = i
            for c in unit[i : i + longest]:
                node = children.get(c)
                if node is None:
                    break
                j += 1
                score, bit, children = node
                if bit:
                    ends[j] |= bit
                    if (score := here + score) > best[j]:
                        second[j], best[j], back[j] = best[j], score, start
                    elif score > second[j]:
                        second[j] = score
            start = i
        return best, ends, second, back

    def best(self, unit: str) -> tuple[bytes, float, float]:
        """ids and score of the best segmentation, and what the second one costs (infinite if there is none)."""
        best, _, second, back = self.forward(unit)
        at, ids, cost = len(unit), [], np.inf
        while at:
            start = back[at]
            if second[at] != NEVER and (loss := best[at] - second[at]) < cost:
                cost = loss
            ids.append((self.entry.get(unit[start:at]) or self.spelt(unit[start]))[1])
            at = start
        return b"".join(reversed(ids)), best[-1], cost

    def spelt(self, c: str) -> tuple[float, bytes]:
        """Score and ids of a character by its UTF-8 bytes."""
        raw = (SPACE if c == MARK else c).encode()
        return BYTE_SCORE * len(raw), _le([self.bytes_at[b] for b in raw])

    def edges(self, unit: str, at: int, best: list[float], lengths: int) -> list[tuple[float, int, bytes]]:
        """``(loss, start, ids)`` of the lattice's edges that end at a position, least loss first.

        The loss is what the best segmentation through the edge falls short of the best one.
        """
        out, goal = [], best[at]
        while lengths:
            start = at + 1 - lengths.bit_length()
            score, ids = self.entry.get(unit[start:at]) or self.spelt(unit[start])
            out.append((goal - (best[start] + score), start, ids))
            lengths ^= 1 << at - start
        if len(out) > 1:
            out.sort(key=LOSS)
        return out

    def search(self, unit: str, n: int) -> tuple[list[tuple[float, bytes]], float]:
        """The n best segmentations, and the loss of the next one (infinite if there is none).

        Backward A-star with the forward scores as heuristic. A queue entry is a path back to
        a position, to be continued by that position's k-th best edge; its key is the loss of
        the best segmentation that does so, exactly. A position's best edge costs nothing, so
        it is followed at once. The k-th path to arrive at a position is the k-th best one to
        it, so no position is left more than n times, however many segmentations tie.
        """
        (best, ends, *_), at, path, loss = self.forward(unit), len(unit), None, 0.0
        known: dict[int, list] = {}  # a position's edges, after the number of paths that have arrived there
        out: list[tuple[float, bytes]] = []
        queue: list = []
        tie = 0
        while True:
            while at:
                if (into := known.get(at)) is None:
                    into = known[at] = [0, *self.edges(unit, at, best, ends[at])]
                if into[0] > n:  # one more than n, for the next one's loss
                    break
                into[0] += 1
                if len(into) > 2:
                    tie -= 1  # of equal entries the latest, nearest to the start, comes first
                    heapq.heappush(queue, (loss + into[2][0], tie, at, 2, path))
                _, at, ids = into[1]
                path = (ids, path)
            if not at:
                ids, cell = [], path
                while cell:
                    ids.append(cell[0])
                    cell = cell[1]
                out.append((best[-1] - loss, b"".join(ids)))
                if len(out) == n:
                    return out, queue[0][0] if queue else np.inf
            if not queue:
                return out, np.inf
            loss, _, to, k, after = heapq.heappop(queue)
            into = known[to]
            if k + 1 < len(into):
                tie -= 1
                heapq.heappush(queue, (loss - into[k][0] + into[k + 1][0], tie, to, k + 1, after))
            _, at, ids = into[k]
            path = (ids, after)

    def _first(self, part: str, whole: bool = False) -> tuple[bytes, float, float]:
        """ids and score of the best segmentation of a chunk or unit, and what the second one costs."""
        units = [part] if whole or self.plain(part) else self.units(part)
        if len(units) > 1:
            found = [self.kept.get(u) or self._first(u, True) for u in units]
            made = (b"".join([f[0] for f in found]), sum(f[1] for f in found), min(f[2] for f in found))
        else:
            made = self.best(part)
        if len(part) <= 64:
            if len(self.kept) >= KEPT_UNITS:
                self.kept.clear()
            self.kept[part] = made
        return made

    def _choices(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a chunk."""
        if (made := self.choices.get((part, n))) is None:
            units = self.units(part)
            made = self.search(part, n)[0] if len(units) == 1 else self._merged(units, n, lambda u, m: self.search(u, m)[0])
            if len(part) <= 64:
                if len(self.choices) >= KEPT_CHOICES:
                    self.choices.clear()
                self.choices[part, n] = made
        return made

    def _merged(self, parts: list[str], n: int, choices_of) -> list[tuple[float, bytes]]:
        """The n best ways to choose a segmentation for every part."""
        get, first = self.kept.get, self._first
        found = [get(u) or first(u) for u in parts]
        ids, scores, costs = zip(*found, strict=True)
        total = float(np.sum(scores))
        out = [(total, b"".join(ids))]
        if n < 2:
            return out
        costs = np.array(costs)
        near = self._least(costs, n - 1) if len(costs) > n else np.argsort(costs, kind="stable")[: n - 1]
        merged: list[tuple[float, tuple]] = [(0.0, ())]
        for k in near.tolist():
            if costs[k] == np.inf:
                continue
            choices = choices_of(parts[k], n)
            both = [(loss + choices[0][0] - s, changes + ((k, x),) * (c > 0)) for loss, changes in merged for c, (s, x) in enumerate(choices)]
            merged = heapq.nsmallest(n, both, key=lambda m: m[0])
        for loss, changes in merged[1:]:
            changed = list(ids)
            for k, x in changes:
                changed[k] = x
            out.append((total - loss, b"".join(changed)))
        return out

    def encode(self, text: str, n: int = NBEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text: scores, and ids as little-endian 32-bit bytes."""
        if not text:
            return [(0.0, b"")]
        marked = SPACE + text.replace(SPACE, MARK).replace(" ", SPACE)
        return self._merged(CHUNK.findall(marked) if self.chunked else [marked], n, self._choices)

    @staticmethod
    def _least(costs: np.ndarray, n: int) -> np.ndarray:
        """Places of the n least costs, earlier ones first where they are equal."""
        bound = np.partition(costs, n - 1)[n - 1]
        near = np.flatnonzero(costs <= bound)
        return near[np.argsort(costs[near], kind="stable")][:n]

    def decode(self, ids: bytes) -> str:
        surface = self.surfaces.__getitem__
        return b"".join(map(surface, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """This worker's vocabulary; it is kept between tasks, and the garbage collector need not look at it again."""
    made = Pieces.load(path)
    gc.collect()
    gc.freeze()
    return made


def piece_model(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("piece_bpe_32k.model")


def segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, path: str | None = None, digests: bool = False) -> DataFrame:
    """The ``n`` best segmentations of each whole text, best first.

    ``(doc_id, scores array, ids array of arrays, round_trip)``; with ``digests`` the columns
    of ``op6_nbest_pieces`` instead of the ids.
    """
    small_batches(docs.sparkSession)
    path = piece_model(path)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = pieces(path), []
        for text in batch.column(1).to_pylist():
            found = own.encode(text or "", n)
            back = own.decode(found[0][1])
            scores = [round(s, 6) for s, _ in found]
            if digests:
                crc = [zlib.crc32(x) for _, x in found]
                rows.append((len(found[0][1]) // 4, scores[0], scores, crc, hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            else:
                rows.append((scores, [np.frombuffer(x, "<u4").tolist() for _, x in found], back == (text or "")))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], names)

    if digests:
        names = ["doc_id", "n_pieces", "score", "nbest_scores", "nbest_crc32", "decoded_sha256", "round_trip"]
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string(), pa.bool_()]
        schema = "doc_id long, n_pieces long, score double, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string, round_trip boolean"
    else:
        names = ["doc_id", "scores", "ids", "round_trip"]
        kinds = [pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64())), pa.bool_()]
        schema = "doc_id long, scores array<double>, ids array<array<long>>, round_trip boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, one, schema)


def op6_nbest_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, the best segmentation's pieces and score, all n scores and digests, and the text decoded again."""
    return segmentations(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
