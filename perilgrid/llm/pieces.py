"""Encoding and decoding with the pieces of a SentencePiece model, by N-best segmentation.

All segmentations of a text into pieces form a lattice; the score of one is the sum of its pieces'
scores. Forward Viterbi gives the best score of every prefix. These are exact heuristics for an A*
search that runs backward from the end, so it yields segmentations best first and expands no
hypothesis that isn't a suffix of the next best one.

Pieces hold the space mark only at their start, so the lattice falls apart before each run of space
marks that follows another character, and around characters that no piece holds. The parts are
segmented by themselves and kept in a bounded cache; the N best of a text are put together from the
N best of its parts. If a model has pieces with the mark inside, texts aren't cut.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, tidied

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
OWN_MARK = "\ud800"  # a lone surrogate: UTF-8 text has none
UNKNOWN_PENALTY = 10.0
CACHE_BYTES = 64 << 20  # of parts in a worker's cache; as many again that were used before these
_NEVER = -1e8  # pieces with lower scores are there for other uses than scoring


class Pieces:
    """The pieces of a model, and segmentations into them. Characters without a piece become their
    UTF-8 byte pieces, at the score of the worst piece less a penalty."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        # nodes are (children by character, [score, id] or [] if no piece ends here)
        self.trie: tuple[dict, list] = ({}, [])
        self.bytes: list[int] = [-1] * 256
        self.of: list[bytes] = []
        worst, letters, names = 0.0, set(), []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.of.append(b"")
            else:
                self.of.append(p.replace(MARK, " ").encode())
                score = sp.get_score(i)
                node = self.trie
                for c in p:
                    node = node[0].setdefault(c, ({}, []))
                node[1][:] = [score, i]
                letters.update(p)
                names.append(p)
                if score > _NEVER:
                    worst = min(worst, score)
        self.unknown = worst - UNKNOWN_PENALTY
        self.wide = len(self.of) > 65536
        words = {c for c in letters if c.isalpha()}
        marks = letters - words - {MARK}
        held, rest = ("".join(map(re.escape, sorted(x))) for x in (words, marks))
        joined = "\n".join(names)
        if re.search(f"[^{MARK}\n]{MARK}", joined):  # pieces hold the mark inside: nowhere to cut
            pattern = r"(?s).+"
        elif re.search(f"[{held}][{rest}]|[{rest}][{held}]", joined):
            pattern = f"{MARK}*[{held}{rest}]+|{MARK}+|[^{MARK}{held}{rest}]"
        else:  # nor does any piece hold letters beside other signs
            pattern = f"{MARK}*(?:[{held}]+|[{rest}]+)|{MARK}+|[^{MARK}{held}{rest}]"
        # a text's own space marks come as OWN_MARK, which no piece and no text holds
        self.parts = re.compile(pattern).findall
        self.cache = _Parts(self)

    def lattice(self, part: str) -> tuple[list[float], list[list[tuple[float, int, int | tuple[int, ...]]]]]:
        """The best score of each prefix, and the edges (score, start, piece or bytes) into each place."""
        n, root = len(part), self.trie[0]
        best = [0.0] + [float("-inf")] * n
        into: list[list] = [[] for _ in best]
        for i in range(n):
            b, j, node = best[i], i, root.get(part[i])
            if node is None or not node[1]:
                c = part[i]
                raw = (MARK if c == OWN_MARK else " " if c == MARK else c).encode()
                into[i + 1].append((self.unknown, i, tuple([self.bytes[x] for x in raw])))
                if b + self.unknown > best[i + 1]:
                    best[i + 1] = b + self.unknown
            while node is not None:
                j += 1
                children, end = node
                if end:
                    s, piece = end
                    into[j].append((s, i, piece))
                    if b + s > best[j]:
                        best[j] = b + s
                if j == n:
                    break
                node = children.get(part[j])
        return best, into

    def search(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a part, best first. Of equal scores, that whose later pieces
        start earlier comes first."""
        return self._search(part, n, n)[0]

    def _search(self, part: str, n: int, complete: int) -> tuple[list[tuple[float, list[int]]], float]:
        """A* from the part's end, as far as ``complete`` of the n best segmentations, and the score of
        the next (-inf: there is none).

        The heuristic is exact, so an open hypothesis stands for a segmentation of just its f: the
        open list needs no more than the n best, less those that are complete, and its first is the
        next segmentation's score."""
        best, into = self.lattice(part)
        open_: list[tuple] = [(-best[-1], 0, len(part), 0.0, None)]
        out, count = [], 0
        while open_ and len(out) < complete:
            f, _, at, score, tail = open_.pop(0)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0] if tail[0].__class__ is tuple else (tail[0],))
                    tail = tail[1]
                out.append((-f, ids))
                continue
            room = n - len(out) - len(open_)
            for s, start, piece in into[at]:
                count += 1
                g = score + s
                f = -(g + best[start])
                if room > 0:
                    room -= 1
                elif f < open_[-1][0]:
                    open_.pop()
                else:
                    continue
                insort(open_, (f, count, start, g, (piece, tail)))
        return out, -open_[0][0] if open_ else float("-inf")

    def pack(self, ids: list[int]) -> bytes:
        return array("I" if self.wide else "H", ids).tobytes()

    def part(self, part: str) -> tuple[bytes, float, float]:
        """Packed ids and score of the best segmentation, and how much the next best falls short (inf if
        there is none)."""
        ((best, ids),), second = self._search(part, 2, 1)
        return self.pack(ids), best, best - second

    def split(self, text: str) -> list[str]:
        """The parts of a text, with a space mark put before it."""
        return self.parts(MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[tuple[float, bytes]]:
        """Scores and packed ids of the two best segmentations of a text, or of the only one: the
        second differs from the best in the part whose next best falls least short, and only there is
        the search taken on to the second one's pieces."""
        parts = self.split(text or "")
        if not parts:
            return [(0.0, b"")]
        packed, scores, shorts = zip(*map(self.cache.__getitem__, parts))
        best, short = sum(scores), min(shorts)
        out = [(best, b"".join(packed))]
        if short != float("inf"):
            k = shorts.index(short)
            other = self.pack(self.search(parts[k], 2)[1][1])
            out.append((best - short, b"".join((*packed[:k], other, *packed[k + 1 :]))))
        return out

    def nbest(self, text: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text. Only the n-1 parts whose second best falls least
        short can differ from their best in any of them."""
        parts = self.split(text)
        found = [self.search(p, n) for p in parts]
        change = sorted((k for k, x in enumerate(found) if len(x) > 1), key=lambda k: found[k][0][0] - found[k][1][0])[: n - 1]
        total = sum(x[0][0] for x in found)
        combos: list[tuple[float, dict[int, int]]] = [(total, {})]
        for k in sorted(change):
            combos = sorted(((s - found[k][0][0] + x[0], c | {k: i}) for s, c in combos for i, x in enumerate(found[k])), key=lambda x: -x[0])[:n]
        return [(s, [i for k, x in enumerate(found) for i in x[c.get(k, 0)][1]]) for s, c in combos]

    def unpack(self, packed: bytes) -> array:
        return array("I" if self.wide else "H", packed)

    def decode(self, packed: bytes) -> str:
        of = self.of
        return b"".join([of[i] for i in self.unpack(packed)])[1:].decode("utf-8", "replace")


class _Parts(dict):
    """What Pieces.part gives for each part, kept within CACHE_BYTES; what was kept before that, too."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.older, self.held = pieces, {}, 0

    def __missing__(self, part: str) -> tuple[bytes, float, float]:
        value = self.older.get(part) or self.pieces.part(part)
        self.held += 250 + 2 * len(part) + len(value[0])
        if self.held > CACHE_BYTES:
            self.older, self.held = dict(self), 0
            self.clear()
        self[part] = value
        return value


@kept
@lru_cache(maxsize=2)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, best_score, second_score, pieces_sha256, n_decoded, round_trip, second_sha256,
    second_round_trip[, ids]) of every row: the two best segmentations of the whole text into the
    model's pieces, from the A* search, each decoded again.

    second_score, second_sha256, second_round_trip: of the second-best segmentation, null if there
    is no other. pieces_sha256 (and second_sha256): of the ids as little-endian numbers of two bytes (four for models of over 65536 pieces). n_decoded:
    code points of the decoded text; round_trip: it equals the text. Null text: as an empty one, no
    pieces, scores 0 and null, round_trip true. Null ids and repeated rows are rows like others;
    other columns aren't read; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        width = 4 if p.wide else 2
        on = gc.isenabled()
        gc.disable()  # the cache is large and holds no cycles
        try:
            yield from encoded(p, width, batches)
        finally:
            if on:
                gc.enable()

    def encoded(p: Pieces, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = []
                for t in part.column(1).to_pylist():
                    (best, packed), *others = p.encode(t)
                    back = p.decode(packed)
                    more = (None, None, None)
                    for score, other in others:
                        more = (score, hashlib.sha256(other).hexdigest(), p.decode(other) == t)
                    ids = (p.unpack(packed).tolist(),) if with_ids else ()
                    rows.append((len(packed) // width, best, more[0], hashlib.sha256(packed).hexdigest(), len(back), back == (t or ""), *more[1:], *ids))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    names = ["doc_id", "n_pieces", "best_score", "second_score", "pieces_sha256", "n_decoded", "round_trip", "second_sha256", "second_round_trip", "ids"][: 10 if with_ids else 9]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_pieces bigint, best_score double, second_score double, pieces_sha256 string, n_decoded bigint, round_trip boolean, second_sha256 string, second_round_trip boolean" + ", ids array<int>" * with_ids
    return d.mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            texts = [None if x is None else p.decode(p.pack(x)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
