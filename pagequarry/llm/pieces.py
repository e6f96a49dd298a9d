"""SentencePiece encoding and decoding by streaming Viterbi.

The best segmentation maximizes the sum of piece scores (integers, so sums are exact). The encoder
keeps a window of boundaries no longer than the longest piece; whenever the backpointer paths of all
boundaries in the window meet in one boundary, everything before it is final and its ids leave.
Between equal sums the path with the longer last piece wins.

White space is kept as it is: each space becomes U+2581, one more stands before the text, and a
U+2581 of the text itself goes out as bytes, so decoding gives every text back exactly. A piece with
U+2581 after its first place is a run of them, so all paths meet where a run follows another character:
whatever the scores, that boundary is final. ``PieceModel.stream`` reads one character after another and
finds the other meeting places as well; ``Lanes`` runs the streams of a whole batch of texts side by side
in numpy, each lane from one such boundary to another, one character of every lane at a step. Stretches
without such a boundary that are longer than ``LANE`` go through ``PieceModel.stream``.

Null texts encode to no ids and decode to empty text; empty texts have no ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagequarry.llm.common import slices, texts_of

MARK = "▁"
#: Characters of a lane at least, if the text goes on, and at most.
LANE_LEAST, LANE = 48, 512
#: Characters of the lanes that run together, and a score that no piece has.
CELLS, NO_SCORE = 300_000, -(1 << 60)
#: Added to the lowest score for a character that no piece has, and which goes out as bytes.
UNKNOWN_PENALTY = 10
#: Stands for a mark of the text itself, which no piece has: a code point that texts cannot hold.
LITERAL_CODE = 0xDFFF
LITERAL = chr(LITERAL_CODE)


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.out: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b] = i
                self.out.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.out.append(b"")
            else:
                self.out.append(piece.replace(MARK, " ").encode())
                self.score[piece], self.id[piece] = round(sp.get_score(i)), i
                if MARK in piece[1:] and piece.strip(MARK):
                    raise ValueError(f"piece {piece!r} has {MARK} after another character")
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.lanes = Lanes(self)

    def stream(self, chars: Iterable[str]) -> Iterator[int]:
        """Ids of a stream of characters; holds little more than the longest piece, or run of spaces."""
        longest, score = self.longest, self.score
        base, buf = 0, ""  # buf[k] is the character after boundary base + k
        best: dict[int, int] = {0: 0}
        back: dict[int, int] = {0: 0}
        at, wait = 0, 2 * longest
        for c in chars:
            buf += c
            at += 1
            top, start = None, at - 1
            for s in range(max(base, at - longest), at):
                piece = buf[s - base :]
                value = score.get(piece)
                if value is None:
                    if s != at - 1:
                        continue
                    value = self.unknown
                if s in best and (top is None or best[s] + value > top):
                    top, start = best[s] + value, s
            best[at], back[at] = top, start
            if at - base >= wait:
                fixed = self._meet(back, base, at, longest)
                wait = 2 * longest if fixed > base else 2 * (at - base)  # in a run of spaces paths meet at its start only
                if fixed > base:
                    yield from self._ids(buf, back, base, base, fixed)
                    buf = buf[fixed - base :]
                    for k in range(base, fixed):
                        del best[k], back[k]
                    base, low = fixed, best[fixed]
                    back[base] = base
                    best = {k: v - low for k, v in best.items()}
        yield from self._ids(buf, back, base, base, at)

    @staticmethod
    def _meet(back: dict[int, int], base: int, at: int, longest: int) -> int:
        """The last boundary on the paths of all boundaries that a later piece can start from."""
        live = set(range(max(base, at - longest + 1), at + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(back[top])
        return live.pop()

    def _ids(self, buf: str, back: dict[int, int] | list[int], base: int, lo: int, hi: int) -> list[int]:
        found: list[list[int]] = []
        while hi > lo:
            s = back[hi]
            piece = buf[s - base : hi - base]
            i = self.id.get(piece)
            found.append([i] if i is not None else [self.byte_id[b] for b in piece.replace(LITERAL, MARK).encode("utf-8", "surrogatepass")])
            hi = s
        return [i for ids in reversed(found) for i in ids]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        return self.lanes.encode([t.replace(" ", MARK) if MARK not in t else t.replace(MARK, LITERAL).replace(" ", MARK) for t in texts])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; the mark before the text goes.

        Null ids and ids outside the vocabulary stand for nothing; bytes that are no text become U+FFFD.
        """
        n = len(self.out)
        raw = b"".join([self.out[i] for i in ids if i is not None and 0 <= i < n])
        try:
            return raw.decode("utf-8", "surrogatepass").removeprefix(" ")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").removeprefix(" ")


class Lanes:
    """The streams of many texts at once: the best paths of all lanes grow by one character a step.

    Pieces are found from every place at once by a hash that grows with the piece, in an open table of all
    beginnings of pieces, so a place is dropped as soon as no piece goes on from it.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        rng = np.random.default_rng(5)
        self.odd = rng.integers(1 << 62, size=2, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        used = sorted({c for p in model.score for c in p})
        self.codes = np.zeros(0x110000, np.uint16)
        self.codes[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        self.mixed = rng.integers(1 << 62, size=len(used) + 1, dtype=np.int64).astype(np.uint64)
        # one character: its piece's id and score, or none
        self.id_of_one, self.score_of_one = np.full(len(used) + 1, -1, np.int32), np.full(len(used) + 1, model.unknown, np.int32)
        for c in used:
            if c in model.id:
                k = int(self.codes[ord(c)])
                self.id_of_one[k], self.score_of_one[k] = model.id[c], model.score[c]
        begun = {p[:n] for p in model.score for n in range(2, len(p) + 1)}
        nodes = sorted(begun, key=lambda p: (len(p), p))
        self.longest = len(nodes[-1])
        goes = {p[:-1] for p in nodes}
        self.goes = np.array([p in goes for p in nodes])
        self.id = np.array([model.id.get(p, -1) for p in nodes], np.int32)
        self.score = np.array([model.score.get(p, 0) for p in nodes], np.int32)
        keys = np.zeros(len(nodes), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(nodes):
                h = np.uint64(0)
                for ch in p:
                    h = h * self.odd[0] + self.mixed[self.codes[ord(ch)]]
                keys[k] = h
        bits = int(np.ceil(np.log2(len(nodes)))) + 2
        self.shift = np.uint64(64 - bits)
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, self.probes = np.arange(len(nodes)), 0
        while len(left):  # the slot after a taken one is next
            slot = self._slot(keys[left], self.probes)
            free = left[self.at[slot] < 0]
            slot, first = np.unique(self._slot(keys[free], self.probes), return_index=True)
            self.at[slot], self.keys[slot] = free[first], keys[free[first]]
            left = np.setdiff1d(left, free[first])
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * self.odd[1] >> self.shift).astype(np.int64) + probe) & (len(self.at) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the beginnings with these hashes, -1 for none."""
        slot = self._slot(keys, 0)
        found = self.at.take(slot)
        other = np.flatnonzero((self.keys.take(slot) != keys) & (found >= 0))
        for probe in range(1, self.probes):
            if not len(other):
                break
            slot = self._slot(keys[other], probe)
            here = self.at.take(slot)
            found[other] = here
            other = other[(here >= 0) & (self.keys.take(slot) != keys[other])]
        found[other] = -1
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose spaces are marks already; the mark before each text is put there here."""
        whole = [MARK + t if t else "" for t in texts]
        sizes = np.array([len(t) for t in whole], np.int64)
        flat = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(flat):
            return [np.zeros(0, np.int32) for _ in texts]
        text = np.repeat(np.arange(len(texts)), sizes)
        mark = flat == ord(MARK)
        bound = np.r_[True, (mark[1:] & ~mark[:-1]) | (text[1:] != text[:-1])]
        new = np.r_[True, text[1:] != text[:-1]]
        # lanes: from one final boundary to the first that is far enough, or to the text's end
        at = np.flatnonzero(bound)
        take, last = [], -LANE_LEAST
        for b, first in zip(at.tolist(), new[at].tolist(), strict=True):
            if first or b - last >= LANE_LEAST:
                take.append(b)
                last = b
        starts = np.array(take)
        ends = np.r_[starts[1:], len(flat)]
        made = np.empty(len(starts), object)
        short = np.flatnonzero(ends - starts <= LANE)
        for k in np.flatnonzero(ends - starts > LANE).tolist():
            made[k] = np.array(list(self.model.stream(flat[starts[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass"))), np.int32)
        order = short[np.argsort(ends[short] - starts[short], kind="stable")]
        a = 0
        while a < len(order):
            b = min(len(order), a + CELLS // int(ends[order[a]] - starts[order[a]] + 1) + 1)
            while b - a > 1 and (b - a) * int(ends[order[b - 1]] - starts[order[b - 1]]) > 2 * CELLS:
                b -= (b - a) // 2
            some = order[a:b]
            self._run(flat, starts[some], ends[some] - starts[some], made, some)
            a = b
        owner = text[starts]
        cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out = [np.zeros(0, np.int32) for _ in texts]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(starts)], strict=True):
            out[owner[a]] = np.concatenate(made[a:b])
        return out

    def _run(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, made: np.ndarray, names: np.ndarray) -> None:
        """Ids of lanes, sorted by size, into ``made``."""
        n, most = len(starts), int(sizes[-1])
        width = most + 1  # a lane ends with a code of no piece
        code = np.zeros((n, width), np.uint16)
        inside = np.arange(width) < sizes[:, None]
        code[inside] = self.codes.take(flat.take((starts[:, None] + np.arange(width))[inside]))
        code = code.ravel()
        mixed = self.mixed.take(code)
        # the score and the id of the piece of each length that ends at a place, 0 and NO_SCORE for none
        score = {1: np.ascontiguousarray(self.score_of_one.take(code).reshape(n, width).T)}
        ids = {1: self.id_of_one.take(code).reshape(n, width).T}
        live = np.flatnonzero(code)
        h = mixed.take(live)
        for length in range(2, self.longest + 1):
            with np.errstate(over="ignore"):
                h = h * self.odd[0] + mixed.take(live + (length - 1), mode="clip")
            node = self.find(h)
            some = np.flatnonzero(node >= 0)
            live, h, node = live.take(some), h.take(some), node.take(some)
            got = self.id.take(node)
            some = np.flatnonzero(got >= 0)
            if len(some):
                lane, place = np.divmod(live.take(some), width)
                score[length], ids[length] = np.full((width, n), NO_SCORE, np.int64), np.full((width, n), -1, np.int32)
                score[length][place + length - 1, lane] = self.score.take(node.take(some))
                ids[length][place + length - 1, lane] = got.take(some)
            some = np.flatnonzero(self.goes.take(node))
            live, h = live.take(some), h.take(some)
            if not len(live):
                break
        best = np.zeros((width, n), np.int64)
        back = np.ones((width, n), np.uint8)
        done = np.searchsorted(sizes, np.arange(width), "left")  # lanes before this have ended
        for t in range(1, width):
            lo = int(done[t])
            top, size = best[t - 1, lo:] + score[1][t - 1, lo:], back[t, lo:]
            for length, scores in score.items():
                if 1 < length <= t:
                    value = best[t - length, lo:] + scores[t - 1, lo:]
                    win = value >= top
                    np.copyto(top, value, where=win)
                    np.copyto(size, length, where=win)
            best[t, lo:] = top
        self._read(flat, starts, sizes, back, ids, made, names)

    def _read(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, back: np.ndarray, by_length: dict[int, np.ndarray], made: np.ndarray, names: np.ndarray) -> None:
        """The best paths of the lanes from their ends back, as ids."""
        n = len(sizes)
        at = sizes.copy()
        lanes, ids = [], []
        live = np.arange(n)
        while len(live):
            end = at[live]
            size = back[end, live]
            got = np.empty(len(live), np.int32)
            for length in np.flatnonzero(np.bincount(size)).tolist():
                some = np.flatnonzero(size == length)
                got[some] = by_length[length][end[some] - 1, live[some]]
            odd = np.flatnonzero(got < 0)
            if len(odd):  # a character that no piece has: its bytes, the last first
                raw = [chr(c).encode("utf-8", "surrogatepass") if c != LITERAL_CODE else MARK.encode() for c in flat[starts[live[odd]] + end[odd] - 1].tolist()]
                keep = np.ones(len(live), bool)
                keep[odd] = False
                lanes.append(live[keep])
                ids.append(got[keep])
                for k in range(max(map(len, raw))):
                    some = [j for j, r in enumerate(raw) if len(r) > k]
                    lanes.append(live[odd[some]])
                    ids.append(np.array([self.model.byte_id[raw[j][-1 - k]] for j in some], np.int32))
            else:
                lanes.append(live)
                ids.append(got)
            at[live] -= size
            live = live[at[live] > 0]
        lane, found = np.concatenate(lanes)[::-1], np.concatenate(ids)[::-1]
        order = np.argsort(lane, kind="stable")
        count = np.bincount(lane, minlength=n)
        for k, part in zip(names.tolist(), np.split(found[order], np.cumsum(count)[:-1]), strict=True):
            made[k] = part


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> of each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model_path)
        for batch in slices(batches, max_bytes=1_000_000):
            got = m.encode_all(texts_of(batch))
            offsets = np.r_[0, np.cumsum([len(g) for g in got])].astype(np.int32)
            flat = np.concatenate(got) if got else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of each row of ``df``; null ids give empty text, as in ``PieceModel.decode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model_path)
        for batch in slices(batches, "ids", 4_000_000):
            texts = [m.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    src = df.select(df[id_col].alias("id"), df[ids_col].alias("ids"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, text string")


def encode_digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_ids, ids_sha256 (little-endian 32-bit ids), roundtrip_ok: whether decoding gives the text back."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model_path)
        for batch in slices(batches, max_bytes=1_000_000):
            texts = texts_of(batch)
            got = m.encode_all(texts)
            n, sha = [len(g) for g in got], [hashlib.sha256(g.astype("<i4").tobytes()).hexdigest() for g in got]
            ok = [m.decode(g.tolist()) == t for g, t in zip(got, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(ok, pa.bool_())], names=[id_col, "n_ids", "ids_sha256", "roundtrip_ok"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, n_ids long, ids_sha256 string, roundtrip_ok boolean")
