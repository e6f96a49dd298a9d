"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one flat numpy array of symbol ids with sequence offsets. Every
round looks up all adjacent pairs at once, takes each sequence's lowest merge rank and merges that
pair at all its places from the left; what is left when no pair has a rank is counted.

Null texts count as empty. Special strings inside a text are one token each, found in the raw text.
Rows are never dropped; repeated rows are counted alike.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagequarry.llm.common import slices, texts_of

#: A worker forgets its known pre-tokens beyond this many.
CACHE_ENTRIES = 400_000
#: Letters whose lower case the library doesn't know.
YOUNG = regex.compile("([\uA7CB\uA7DC])")
NO_RANK = np.int64(1 << 40)


def _byte_names() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class RankMerger:
    """Counts BPE symbols of pre-tokens for a ``tokenizers`` file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        names = _byte_names()
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for name, b in names.items():
            self.inner[b], self.last[b] = vocab[name], vocab[name + end]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.known: dict[str, int] = {}

    def merge(self, pretokens: list[str]) -> np.ndarray:
        """Symbols left of each (non-empty) pre-token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pretokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        seq = np.repeat(np.arange(len(raw)), sizes)
        counts = np.ones(len(raw), np.int64)
        while ids.size:
            rank = np.full(ids.size, NO_RANK)
            key = ids[:-1] * self.width + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (seq[:-1] == seq[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.r_[starts, ids.size])
            counts[seq[starts]] = lens
            alive = low < NO_RANK
            place = np.flatnonzero((rank == np.repeat(low, lens)) & (rank < NO_RANK))
            if not place.size:
                break
            # of overlapping places (a pair of equal symbols) every second one merges, from the left
            new_run = np.r_[True, np.diff(place) != 1]
            first = place[new_run][np.cumsum(new_run) - 1]
            place = place[(place - first) % 2 == 0]
            ids[place] = self.made[np.minimum(np.searchsorted(self.keys, ids[place] * self.width + ids[place + 1]), len(self.keys) - 1)]
            keep = np.repeat(alive, lens)  # finished sequences leave the arrays
            keep[place + 1] = False
            ids, seq = ids[keep], seq[keep]
        return counts

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a whole text and how many special strings it has."""
        if "<|" not in text:
            return self._pieces(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self._pieces(part)], len(parts) - 1

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            # each capital sigma is lowered alone, not by its place in a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # capitals younger than the library's tables stay
        return self.pattern.findall(text.lower() if text.isascii() or not YOUNG.search(text) else "".join(p if YOUNG.match(p) else p.lower() for p in YOUNG.split(text)))

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        new = set().union(*(p for p, _ in split)).difference(self.known)
        if new:
            names = list(new)
            for at in range(0, len(names), 50_000):
                some = names[at : at + 50_000]
                self.known.update(zip(some, self.merge(some).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, p)) + extra for p, extra in split]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit. Other columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(tokenizer_path)
        for batch in slices(batches):
            texts = texts_of(batch)
            n = np.array(m.counts(texts), np.int64)
            size = np.array([len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
