"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi (operator 3).

The automaton reads a text byte by byte. At every position the output links list the
pieces that end there, longest first, and each relaxes the best score at that position
from the best score at its start. A character that no piece covers costs the lowest
score minus 10 and becomes byte pieces. Ties go to the longer last piece. The segmentation is the
one with the highest sum of the model's piece scores.

Normalisation is that of a model with identity rules: a blank in front, blanks as U+2581.
No piece goes on from another character into a blank, so texts fall apart exactly at such
places into units; equal units of a worker are segmented once (a table of bounded size).
Short units run through the automaton together, one numpy step per byte position; long
ones one by one.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from hubflow.llm.common import id_text, map_rows

BLANK = "▁".encode()
#: Units that a worker remembers, and the longest unit that runs together with others, in bytes.
REMEMBERED, LONG = 150_000, 64
_UNIT = re.compile(rb" *[^ ]+| +")
_MODELS: dict = {}


class PieceModel:
    """Pieces, scores and the automaton of a model file; ``remember`` keeps the units seen."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        own: list[int] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.encode().replace(BLANK, b" ")
                own.append(i)
        if any(b" " in self.bytes_of[i].lstrip(b" ") for i in own):
            raise ValueError("a piece goes on into a blank: units can't be split there")
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.length = np.array([len(b) for b in self.bytes_of], np.int32)
        self.unknown = float(self.score[own].min()) - 10
        self._build(own)
        self.remember: dict[bytes, bytes] = {}

    def _build(self, own: list[int]) -> None:
        children: list[dict[int, int]] = [{}]
        term = [-1]
        for i in own:
            at = 0
            for b in self.bytes_of[i]:
                nxt = children[at].get(b)
                if nxt is None:
                    nxt = children[at][b] = len(children)
                    children.append({})
                    term.append(-1)
                at = nxt
            term[at] = i
        size = len(children)
        self.term = np.array(term, np.int32)
        self.step = np.zeros((size, 256), np.int32)
        self.link = np.zeros(size, np.int32)  # the nearest shorter state that ends a piece, 0 for none
        fail = [0] * size
        queue = [0]
        for at in queue:
            if at:
                self.step[at] = self.step[fail[at]]
                f = fail[at]
                self.link[at] = f if term[f] >= 0 else self.link[f]
            for b, child in children[at].items():
                fail[child] = int(self.step[at, b]) if at else 0
                self.step[at, b] = child
                queue.append(child)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        units = [_UNIT.findall(b" " + t.replace(BLANK, b" ")) if t else [] for t in texts]
        new = {u for us in units for u in us if u not in self.remember}
        if len(self.remember) + len(new) > REMEMBERED:
            self.remember = {}
            new = {u for us in units for u in us}
        self._segment(sorted(new, key=len))
        return [b"".join(map(self.remember.__getitem__, us)) for us in units]

    def decode(self, ids: bytes) -> bytes:
        """The text of encoded ids: pieces joined, the blank in front taken away."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]

    def _segment(self, units: list[bytes]) -> None:
        short = [u for u in units if len(u) <= LONG]
        for at in range(0, len(short), 1 << 14):
            self._together(short[at:at + (1 << 14)])
        for u in units[len(short):]:
            self.remember[u] = self._alone(u)

    def _together(self, units: list[bytes]) -> None:
        n, sizes = len(units), np.array([len(u) for u in units])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.full((n, width + 1), -1, np.int32)
        state, char = np.zeros(n, np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        for j in range(width):
            rows = rows[np.searchsorted(sizes[rows], j, "right"):]  # sizes are ascending
            b = text[rows, j]
            char[rows[(b & 0xC0) != 0x80]] = j
            state[rows] = self.step[state[rows], b]
            v = state[rows]
            v = np.where(self.term[v] >= 0, v, self.link[v])
            at, single = rows, np.zeros(n, bool)
            while True:
                live = v > 0
                if not live.any():
                    break
                at, v = at[live], v[live]
                piece = self.term[v]
                start = j + 1 - self.length[piece]
                single[at[start == char[at]]] = True
                value = best[at, start] + self.score[piece]
                more = value > best[at, j + 1]
                best[at[more], j + 1] = value[more]
                back[at[more], j + 1] = piece[more]
                v = self.link[v]
            ends = (sizes[rows] == j + 1) | ((text[rows, min(j + 1, width - 1)] & 0xC0) != 0x80)
            unk = rows[ends & ~single[rows]]
            value = best[unk, char[unk]] + self.unknown
            more = value > best[unk, j + 1]
            best[unk[more], j + 1] = value[more]
            back[unk[more], j + 1] = -1
        ids = []
        at, live = sizes.copy(), np.arange(n)
        while live.size:
            piece = back[live, at[live]]
            raw = piece < 0
            step = np.full(n, -1, np.int32)
            step[live] = np.where(raw, self.byte_id[text[live, at[live] - 1]], piece)
            ids.append(step)
            at[live] -= np.where(raw, 1, self.length[piece])
            live = live[at[live] > 0]
        table = np.array(ids[::-1], np.int32).T
        used = table >= 0
        flat, ends = table[used].astype("<u4").tobytes(), used.sum(axis=1).cumsum().tolist()
        lo = 0
        for u, hi in zip(units, ends):
            self.remember[u] = flat[4 * lo:4 * hi]
            lo = hi

    def _alone(self, unit: bytes) -> bytes:
        step, term, link = self.step, self.term, self.link
        n, state, char = len(unit), 0, 0
        best, back = [0.0] + [-np.inf] * n, [-1] * (n + 1)
        for j, b in enumerate(unit):
            if b & 0xC0 != 0x80:
                char = j
            state = int(step[state, b])
            v = state if term[state] >= 0 else int(link[state])
            single = False
            while v:
                piece = int(term[v])
                start = j + 1 - int(self.length[piece])
                single |= start == char
                value = best[start] + float(self.score[piece])
                if value > best[j + 1]:
                    best[j + 1], back[j + 1] = value, piece
                v = int(link[v])
            if not single and (j + 1 == n or unit[j + 1] & 0xC0 != 0x80) and best[char] + self.unknown > best[j + 1]:
                best[j + 1], back[j + 1] = best[char] + self.unknown, -1
        out, at = [], n
        while at:
            piece = back[at]
            out.append(int(self.byte_id[unit[at - 1]]) if piece < 0 else piece)
            at -= 1 if piece < 0 else int(self.length[piece])
        return np.array(out[::-1], "<u4").tobytes()


def piece_model(path: str) -> PieceModel:
    """The model at ``path``, built once per worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): little-endian 32-bit piece ids of every row's whole text; null and empty texts have none. Other columns are ignored."""
    def rows(cols):
        model = piece_model(path)
        for at in range(0, len(cols["text"]), 64):
            texts = [t or b"" for t in cols["text"][at:at + 64]]
            yield from zip(cols["doc_id"][at:at + 64], model.encode(texts))

    return map_rows(id_text(docs), rows, "doc_id long, ids binary", rows=256)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); ids that aren't UTF-8 together give replacement characters. U+2581 in a text comes back as a blank."""
    def rows(cols):
        model = piece_model(path)
        for doc_id, ids in zip(cols["doc_id"], cols["ids"]):
            yield doc_id, model.decode(ids or b"").decode("utf-8", "replace")

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id long, text string", rows=256)


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_crc32 (of the 32-bit ids), score (sum of piece scores), round_trip (decoding gives the text back)."""
    def rows(cols):
        model = piece_model(path)
        for at in range(0, len(cols["text"]), 64):
            texts = [t or b"" for t in cols["text"][at:at + 64]]
            for doc_id, text, ids in zip(cols["doc_id"][at:at + 64], texts, model.encode(texts)):
                total = float(model.score[np.frombuffer(ids, "<u4")].sum())
                yield doc_id, len(ids) // 4, zlib.crc32(ids), total, model.decode(ids) == text.replace(BLANK, b" ")

    return map_rows(id_text(docs), rows, "doc_id long, n_pieces long, ids_crc32 long, score double, round_trip boolean", rows=20_000)
