"""Language-model scoring with a small causal self-attention model on subword ids.

A text is its words, A-Z lowered, and one end. Each word is cut into ids of a public byte-level
vocabulary. The network, one layer of causal self-attention and one of ReLU over embeddings of the ids,
gives the next id's class; corpus counts give the id in its class, given the class of the id before it. A
class has ids that start words or ids that go on, never both, so the network also tells where a word ends.
Given a word's first id, its rest as the network spells it is mixed with the corpus count of the whole
word; words never seen keep the share of the first id's distinct words (Witten and Bell's estimate). So a
text has one proper probability.
Windows of ``WINDOW`` ids overlap: every id is scored once, with at least ``OVERLAP`` ids before it or
all there are, and windows are masked and run in batches.

All counts, the classes and the weights are learned from all training texts. The texts are cut into blocks of
words; the weights are started on one part of the blocks and go on in tasks of about ``TRAINER_IDS`` each, every
block in one of them, whose changes are averaged.

The word unigram base needs a count for every word. Words with more than ``HEAD_SHARE`` of all tokens
are at most 1 / HEAD_SHARE by arithmetic and travel to every task; rarer words, which cannot be hot,
are looked up by a shuffle, and so are words of more than ``HEAD_BYTES`` bytes.

Null texts are empty: one end token. Null ids count as empty in the split into training and held-out
rows. With no training text all scores are those of an untrained model, and the base has no known token.
"""

from __future__ import annotations

import base64
import copy
import itertools
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import UPPER, crc_mod, discard, materialize, slices, sweep

WINDOW, OVERLAP = 40, 8
WIDTH, HIDDEN, CLASSES, OWN_CLASS = 16, 32, 96, 48
#: Windows that are scored at once; their arrays stay in a core's cache.
TOGETHER = 160
#: Words of a training block, many windows so that few are cut short at its end, and ids of a trainer.
BLOCK, TRAINER_IDS = 480, 1_500_000
#: Windows of a step, steps of a trainer at least, and the rates of the start and of the trainers.
BATCH, STEPS, START_RATE, RATE, SEED = 32, 1000, 0.02, 0.008, 3
#: Largest score that attention weighs as it is.
REACH = 16
#: Floats of a row in which trainers send their weights.
CHUNK = 8192
HEAD_SHARE, HEAD_BYTES = 1e-6, 64
CACHE_ENTRIES = 400_000
SMOOTH = 0.1
#: Weight of the counts of an id in its class against those given the class before it.
BACKOFF = 20.0
#: Contexts of an id on either side that classes are told from: the most frequent ids, and one for the others.
CONTEXTS = 128
_LOW = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def words_in(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOW).split() if text else []


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts one after another, as ``words_in`` gives them, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words gives one without characters
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    return words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()), sizes


class Subwords:
    """Ids of single words, each with the space before it; the id after the last is the end."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.starts = np.zeros(self.size, bool)  # a word's first id begins with its space, no other does
        self.starts[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.starts[self.end] = True
        self.forget("")

    def forget(self, owner: str) -> None:
        """Drop what is remembered of words; ``owner`` names the values that it will be remembered with."""
        self.owner = owner
        self.known = {b"": 0}  # stands for the end
        self.pool, self.at, self.size_of = np.array([self.end], np.uint16), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.value = np.full(1, -1, np.int64)

    def _one(self, word: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(" " + word.decode("utf-8", "replace")), np.uint16)

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word after another, and how many each has. All are cut in one go; a word starts where an id begins with its space."""
        ids = np.array(self.encoding.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")) if words else [], np.uint16)
        at = np.flatnonzero(self.starts[ids])
        if len(at) == len(words):
            return ids, np.diff(at, append=len(ids))
        parts = list(map(self._one, words))  # some word holds what reads as a space
        return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of a text and its end."""
        return self.pack(pa.array(words, pa.binary()), np.array([len(words)]))[0]

    def pack(self, words: pa.Array, n: np.ndarray, values: dict[bytes, int] | None = None, owner: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of texts, ``n`` of each, with an end after each text: all ids, how many each word has, and its value, -1 for none."""
        if owner != self.owner or len(self.known) > CACHE_ENTRIES:
            self.forget(owner)
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = list(map(self.known.get, distinct))
        new = [w for w, k in zip(distinct, places, strict=True) if k is None]
        if new:
            ids, sizes = self.each(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.at = np.append(self.at, len(self.pool) + np.cumsum(sizes) - sizes)
            self.size_of = np.append(self.size_of, sizes)
            self.pool = np.append(self.pool, ids)
            self.value = np.append(self.value, [values.get(w, -1) for w in new] if values else np.full(len(new), -1))
            places = list(map(self.known.__getitem__, distinct))
        is_word = np.ones(len(words) + len(n), bool)
        is_word[np.cumsum(n + 1) - 1] = False
        place = np.zeros(len(is_word), np.int64)  # that of the end
        place[is_word] = np.array(places, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size_of[place]
        first = np.cumsum(sizes) - sizes
        flat = self.pool[np.repeat(self.at[place] - first, sizes) + np.arange(int(sizes.sum()))]
        return flat, sizes, self.value[place]


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all whole texts; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return made

        for batch in slices(batches):
            found = words_of(batch.column("text"))[0].value_counts()
            for w, c in zip(found.field("values").to_numpy(zero_copy_only=False).tolist(), found.field("counts").to_pylist(), strict=True):
                seen[w] += c
            if len(seen) > 300_000:
                yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _cells(rows: DataFrame, run, shape: tuple[int, ...], kind: type = float) -> np.ndarray:
    """Sums over all partitions of a table of fixed size; ``run`` yields (i, c) of used cells."""
    found = np.zeros(int(np.prod(shape)), kind)
    sums = rows.mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    found[sums.column("i").to_numpy()] = sums.column("c").to_numpy()
    return found.reshape(shape)


def _used(total: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], names=["i", "c"])


def id_counts(words: DataFrame, path: str, cls: np.ndarray, n_texts: int) -> np.ndarray:
    """Corpus counts of every id, from the counts of words: a table of fixed size.

    Rows: by the class before an id that goes on; then the words, and the distinct words, that start with an id.
    """
    size, rows = len(cls), CLASSES + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        total = np.zeros(rows * size)
        for batch in batches:
            flat, sizes = sub.each(batch.column("word").to_pylist())
            if not len(flat):
                continue
            flat = flat.astype(np.int64)
            before = np.r_[0, cls[flat[:-1]]]
            before[sub.starts[flat]] = CLASSES
            total += np.bincount(before * size + flat, np.repeat(batch.column("c").to_numpy(), sizes), len(total))
            total += np.bincount((CLASSES + 1) * size + flat[sub.starts[flat]], minlength=len(total))
        yield _used(total)

    found = _cells(words, run, (rows, size))
    found[CLASSES, size - 1] = n_texts
    return found


def blocks_of(training: DataFrame, path: str) -> DataFrame:
    """(h, ids): the id before and the ids of each block of words of all texts, with a hash. A text's end is its last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path)
        for batch in slices(batches):
            words, n = words_of(batch.column("text"))
            ids, sizes, _ = sub.pack(words, n)
            many = n // BLOCK + 1
            owner = np.repeat(np.arange(len(n)), many)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            first = np.cumsum(n + 1) - n - 1  # word of each text, ends among them
            upto = np.r_[0, np.cumsum(sizes)]
            begin = upto[first[owner] + place * BLOCK]
            end = upto[np.minimum(first[owner] + (place + 1) * BLOCK, first[owner] + n[owner] + 1)]
            with np.errstate(over="ignore"):
                x = (batch.column("h").to_numpy().view(np.uint64)[owner] + place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(27)
            raw = np.append(np.uint16(sub.end), ids.astype(np.uint16)).tobytes()  # before a text's first id is the end of another
            made = [raw[2 * a : 2 * b + 2] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(made, pa.binary())], names=["h", "ids"])

    return training.select(F.xxhash64("id", "text", F.monotonically_increasing_id()).alias("h"), "text").mapInArrow(run, "h long, ids binary")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Neighbouring ids of blocks."""
    for batch in batches:
        parts = [np.frombuffer(x, np.uint16) for x in batch.column("ids").to_pylist()]
        if parts:
            yield np.concatenate([x[:-1] for x in parts]).astype(np.int64), np.concatenate([x[1:] for x in parts]).astype(np.int64)


def block_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """Counts of ids over the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for _, b in _pairs(batches):
            total += np.bincount(b, minlength=size)
        yield _used(total)

    return _cells(blocks, run, (size,))


def context_counts(blocks: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of ids by what is before and after them; ``frequent`` are the ids that are contexts of their own.

    Those are counted; the rest of what ``counts`` has of an id is beside the others. Each block begins after an
    end and each text ends with one, so an id is as often before another as after one.
    """
    size = len(counts)
    context = np.full(size, CONTEXTS - 1, np.int64)
    context[frequent[: CONTEXTS - 1]] = np.arange(len(frequent[: CONTEXTS - 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * 2 * CONTEXTS, np.int32)
        for a, b in _pairs(batches):
            for ids, beside, first in ((b, context.take(a), 0), (a, context.take(b), CONTEXTS)):
                some = np.flatnonzero(beside < CONTEXTS - 1)
                np.add.at(total, ids.take(some) * (2 * CONTEXTS) + beside.take(some) + first, 1)
        yield _used(total)

    found = _cells(blocks, run, (size, 2, CONTEXTS))
    found[:, :, -1] = counts[:, None] - found.sum(2)
    return found.reshape(size, -1).astype(np.float32)


def start_counts(blocks: DataFrame, cls: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Counts of ids that start words by the class before them, over the blocks."""
    size = len(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * size, np.int32)
        for a, b in _pairs(batches):
            some = starts[b]
            np.add.at(total, cls[a[some]] * size + b[some], 1)
        yield _used(total)

    return _cells(blocks, run, (CLASSES, size), np.float32)


def classes_of(counts: np.ndarray, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every id: frequent ids alone, others with ids of like neighbours (k-means on their contexts)."""
    size = len(starts)
    rank = np.argsort(-counts, kind="stable")
    cls = np.where(starts, CLASSES - 1, CLASSES - 2)
    alone = [size - 1, *[i for i in rank[:OWN_CLASS] if i != size - 1]][:OWN_CLASS]
    cls[alone] = np.arange(len(alone))
    first, k = OWN_CLASS, (CLASSES - OWN_CLASS - 2) // 2
    for kind in (True, False):
        used = np.flatnonzero((table.sum(1) > 0) & (starts == kind))
        used = used[~np.isin(used, alone)]
        if len(used) <= k:
            continue
        x = np.sqrt(table[used] / np.maximum(table[used].sum(1, keepdims=True), 1)).astype(np.float32)
        weight = np.sqrt(counts[used] + 1)
        centre = x[np.random.default_rng(SEED).choice(len(used), k, replace=False, p=weight / weight.sum())]
        for _ in range(12):
            near = np.argmax(x @ centre.T - (centre**2).sum(1) / 2, 1)
            for j in range(k):
                if (near == j).any():
                    centre[j] = np.average(x[near == j], axis=0, weights=weight[near == j])
        cls[used] = first + near
        first += k
    return cls


def squared(x: np.ndarray, times: int) -> np.ndarray:
    """x ** (2 ** times) in place. Of 1 + y / 2 ** times it is close to the exponential of y, positive, and several times faster."""
    for _ in range(times):
        np.multiply(x, x, out=x)
    return x


class Attention:
    """The network: embeddings of ids, one causal attention, one ReLU layer, a gate and class logits.

    The gate tells whether the next id starts a word; the logits are among the classes of that kind.
    Attention weighs by ``squared`` where others take the exponential. An id's embedding is that of its class and one of its own, which starts at zero, so ids that no block
    has are read as their class.
    """

    def __init__(self, cls: np.ndarray, starts: np.ndarray, attends: bool = True):
        rng = np.random.default_rng(SEED)
        d, h = WIDTH, HIDDEN
        shapes = {"e": (CLASSES, d), "i": (len(cls), d), "p": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "a": (d, h), "b": (h, d), "u": (d, CLASSES), "c": (1, CLASSES), "g": (d, 1), "s": (1, 1)}
        spread = {"e": 0.5, "p": 0.1, "i": 0, "c": 0, "s": 0}
        self.w = {n: rng.normal(0, spread.get(n, 1 / np.sqrt(s[0])), s).astype(np.float32) for n, s in shapes.items()}
        self.cls = cls.astype(np.int64)
        self.attends = attends  # without, what the model's attention is worth can be measured
        self.past = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.starts = np.zeros(CLASSES, bool)  # classes of ids that start words
        self.starts[self.cls[starts]] = True
        self.kinds = [np.flatnonzero(~self.starts), np.flatnonzero(self.starts)]
        self.place = np.zeros(CLASSES, np.int64)  # of a class among those of its kind
        for some in self.kinds:
            self.place[some] = np.arange(len(some))
        self.ready()

    def ready(self) -> None:
        """What scoring needs, from the weights: one table of embeddings, and the matrices of few large products."""
        self.table = self.w["e"][self.cls] + self.w["i"]
        self.qkv = self._qkv()
        self.out = [self._out(kind) for kind in range(2)]
        for out in self.out:  # what ``squared`` takes
            out *= np.float32(1 / 256)
            out[WIDTH] += np.float32(1)

    def _qkv(self) -> np.ndarray:
        """One product for queries, keys and values. Queries are such that theirs with keys is what ``squared`` takes; a column of ones follows each of the three."""
        w, d = self.w, WIDTH
        made = np.zeros((d + 1, 3 * d + 3), np.float32)
        made[:d, :d], made[:d, d + 1 : 2 * d + 1], made[:d, 2 * d + 2 : -1] = w["q"] * np.float32(1 / np.sqrt(d) / 32), w["k"], w["v"]
        made[d, [d, 2 * d + 1, 3 * d + 2]] = 1
        return made

    def _out(self, kind: int) -> np.ndarray:
        """One product for the logits of a kind's classes and, last, the gate."""
        w = self.w
        return np.concatenate([np.concatenate([w["u"], w["c"]]).take(self.kinds[kind], 1), np.concatenate([w["g"], w["s"]])], 1)

    def _attend(self, h: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
        """Of windows of inputs with a last column of ones: queries, keys and values; one more than scores / 32; what they weigh, up to a factor of each row, 0 for what is not past; the weighed sums, and last what they are shares of."""
        n, d = len(h), WIDTH
        qkv = (h.reshape(-1, d + 1) @ self.qkv).reshape(n, WINDOW, 3 * d + 3)
        q, k, v = qkv[:, :, : d + 1], qkv[:, :, d + 1 : 2 * d + 2], qkv[:, :, 2 * d + 2 :]
        base = q[:, skip:] @ k.transpose(0, 2, 1)
        reach = np.float32(REACH / 32)
        if base.max(initial=1) > 1 + reach or base.min(initial=1) < 1 - reach:
            np.clip(base, 1 - reach, 1 + reach, out=base)
        s = squared(base * base, 4)
        s *= self.past[skip:]
        return q, k, v, base, s, s @ v

    def log_prob(self, x: np.ndarray, y: np.ndarray, once: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural log probabilities after id windows ``x``, at the places ``once``, none of them among the first ``skip``.

        Of the classes ``y`` among those of their kind, of a word's start, and of its going on.
        """
        n, d = len(x), WIDTH
        flat = np.flatnonzero(once)
        h = np.ones((n, WINDOW, d + 1), np.float32)
        np.add(self.table.take(x, 0), self.w["p"], out=h[:, :, :d])
        z = self._attend(h, skip)[-1].reshape(-1, d + 1).take(np.flatnonzero(once[:, skip:]), 0)
        last = h.reshape(-1, d + 1).take(flat, 0)
        if self.attends:
            last[:, :d] += (z[:, :d] / z[:, d:]) @ self.w["o"]
        r = last[:, :d] @ self.w["a"]
        np.maximum(r, 0, out=r)
        last[:, :d] += r @ self.w["b"]
        cls = y.ravel().take(flat)
        kind, place = self.starts[cls], self.place[cls]
        given, gate = np.empty((2, len(flat)), np.float32)
        for some, out in zip((np.flatnonzero(~kind), np.flatnonzero(kind)), self.out, strict=True):
            logits = last.take(some, 0) @ out
            if logits.max(initial=1) > 1.5 or logits.min(initial=1) < 0.5:
                np.clip(logits, 0.5, 1.5, out=logits)
            gate[some] = logits[:, -1]
            squared(logits, 8)
            every = np.ones(logits.shape[1], np.float32)
            every[-1] = 0
            given[some] = logits.ravel().take(np.arange(len(some)) * len(every) + place.take(some)) / (logits @ every)
        gate -= np.float32(1)
        gate *= np.float32(256)
        gate = np.clip(gate, -60, 60)
        start = -np.log1p(np.exp(-gate))
        return np.log(np.maximum(given, np.float32(1e-30))), start, start - gate

    def gradients(self, x: np.ndarray, y: np.ndarray, counted: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean loss; those of the ids' own embeddings are rows for the ids that come second."""
        w, n, d = self.w, len(x), WIDTH
        self.qkv = self._qkv()
        h = np.ones((n, WINDOW, d + 1), np.float32)
        np.add(w["e"].take(self.cls.take(x), 0), w["i"].take(x, 0), out=h[:, :, :d])
        h[:, :, :d] += w["p"]
        q, k, v, base, s, z = self._attend(h)
        h0, z = h.reshape(-1, d + 1)[:, :d], z.reshape(-1, d + 1)
        under = np.float32(1) / z[:, d:]
        z = z[:, :d] * under
        h1 = z @ w["o"] if self.attends else np.zeros_like(z)
        h1 += h0
        r = h1 @ w["a"]
        np.maximum(r, 0, out=r)
        h2 = np.ones((len(h1), d + 1), np.float32)
        np.add(h1, r @ w["b"], out=h2[:, :d])
        aim, share, d2 = y.ravel(), np.float32(1 / max(counted.sum(), 1)), np.zeros_like(h1)
        each = counted.ravel() * share
        kind, told = self.starts.take(aim), each > 0
        g = {m: np.zeros_like(w[m]) for m in "ucgs"}
        for starts, some in enumerate(self.kinds):  # the other kind's classes have no share
            rows, out, one = np.flatnonzero(told & (kind if starts else ~kind)), self._out(starts), np.ones(len(some) + 1, np.float32)
            own, part = h2.take(rows, 0), each.take(rows)
            p, one[-1] = own @ out, 0
            if p.max(initial=0) > 64 or p.min(initial=0) < -64:
                p[:, :-1] -= p[:, :-1].max(1, keepdims=True)
                np.clip(p[:, -1], -60, 60, out=p[:, -1])
            np.exp(p, out=p)
            gate = p[:, -1] / (1 + p[:, -1])
            p *= (part / (p @ one))[:, None]
            p.reshape(-1)[np.arange(len(p)) * len(one) + self.place.take(aim.take(rows))] -= part
            p[:, -1] = (gate - np.float32(starts)) * part
            made = own.T @ p
            g["u"][:, some], g["c"][:, some] = made[:d, :-1], made[d:, :-1]
            g["g"] += made[:d, -1:]
            g["s"] += made[d:, -1:]
            d2[rows] = p @ out[:d].T
        dr = d2 @ w["b"].T
        dr *= (r > 0).astype(np.float32)
        g["b"], g["a"] = r.T @ d2, h1.T @ dr
        d0 = dr @ w["a"].T
        d0 += d2
        if self.attends:
            g["o"] = z.T @ d0
            dz = np.empty((len(z), d + 1), np.float32)
            np.multiply(d0 @ w["o"].T, under, out=dz[:, :d])
            np.negative(np.einsum("nd,nd->n", dz[:, :d], z), out=dz[:, d])  # the mean of the gradients of what places weigh
            dz = dz.reshape(n, WINDOW, d + 1)
            ds = dz @ v.transpose(0, 2, 1)
            ds *= s
            ds /= base
            back = np.empty((n, WINDOW, 3 * d), np.float32)
            np.matmul(ds, k[:, :, :d], out=back[:, :, :d])
            np.matmul(ds.transpose(0, 2, 1), q[:, :, :d], out=back[:, :, d : 2 * d])
            np.matmul(s.transpose(0, 2, 1), dz[:, :, :d], out=back[:, :, 2 * d :])
            back = back.reshape(-1, 3 * d)
            made, root = h0.T @ back, np.float32(1 / np.sqrt(d))
            g["q"], g["k"], g["v"] = made[:, :d] * root, made[:, d : 2 * d] * np.float32(32), made[:, 2 * d :]
            d0 += back @ np.concatenate([w["q"] * root, w["k"] * np.float32(32), w["v"]], 1).T
        g["p"] = d0.reshape(n, WINDOW, d).sum(0)
        flat = x.ravel().astype(np.uint16)  # as blocks hold them; sorted by digits
        order = np.argsort(flat, kind="stable")
        ids = flat.take(order)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids = ids.take(first).astype(np.int64)
        g["i"] = np.add.reduceat(d0.take(order, 0), first)
        of = np.zeros((len(ids), CLASSES), np.float32)
        of.reshape(-1)[np.arange(len(ids)) * CLASSES + self.cls.take(ids)] = 1
        g["e"] = of.T @ g["i"]
        return g, ids

    def train(self, blocks: list[np.ndarray], steps: int, rate: float, warm: int = 0) -> np.ndarray:
        """Adam over the windows of ``blocks`` (each the id before and its ids), in shuffled order; which ids it met."""
        met = np.zeros(len(self.cls), np.float32)
        n = np.array([max(0, -(-(len(b) - 1) // WINDOW)) for b in blocks], np.int64)
        total = int(n.sum())
        if not total or not steps:
            return met
        flat, lengths = np.concatenate(blocks), np.array(list(map(len, blocks)), np.int64)
        begin = np.repeat(np.cumsum(lengths) - lengths, n) + (np.arange(total) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        left = np.minimum(np.repeat(np.cumsum(lengths), n) - begin - 1, WINDOW)  # ids to tell in each window
        flat, span = np.append(flat, np.zeros(WINDOW, flat.dtype)), np.arange(WINDOW + 1)
        rng = np.random.default_rng(SEED)
        # all weights but the ids' own lie one after another, so that a step is one for all of them
        names = [name for name in self.w if name != "i"]
        at = np.cumsum([0, *[self.w[name].size for name in names]]).tolist()
        w = np.concatenate([self.w[name].ravel() for name in names])
        for name, a, b in zip(names, at, at[1:], strict=False):
            self.w[name] = w[a:b].reshape(self.w[name].shape)
        m, s = np.zeros_like(w), np.zeros_like(w)
        own_m, own_s = np.zeros_like(self.w["i"]), np.zeros_like(self.w["i"])
        order = np.zeros(0, np.int64)

        def stepped(m: np.ndarray, s: np.ndarray, step: int, speed: float) -> np.ndarray:
            return np.float32(speed / (1 - 0.9**step)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))

        for step in range(1, steps + 1):
            if len(order) < BATCH:
                order = np.concatenate([order, *[rng.permutation(total) for _ in range(-(-BATCH // total))]])
            now, order = order[:BATCH], order[BATCH:]
            inside = (span[:-1] < left.take(now)[:, None]).astype(np.float32)
            window = flat.take(begin.take(now)[:, None] + span)
            x, y = window[:, :-1].astype(np.int64), self.cls.take(window[:, 1:])
            speed = rate * min(1, step / max(warm, 1)) * (0.5 + 0.5 * np.cos(np.pi * step / steps)) + 1e-4
            grown, ids = self.gradients(x, y, inside)
            met[ids] = 1
            g = np.concatenate([grown[name].ravel() if name in grown else np.zeros(b - a, np.float32) for name, a, b in zip(names, at, at[1:], strict=False)])
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.99)
            s += np.float32(0.01) * g * g
            w -= stepped(m, s, step, speed)
            g = grown["i"]
            own_m[ids] = some_m = np.float32(0.9) * own_m.take(ids, 0) + np.float32(0.1) * g
            own_s[ids] = some_s = np.float32(0.99) * own_s.take(ids, 0) + np.float32(0.01) * g * g
            self.w["i"][ids] -= stepped(some_m, some_s, step, speed)
        return met

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in sorted(self.w)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in sorted(self.w):
            size = self.w[n].size
            self.w[n] = flat[at : at + size].reshape(self.w[n].shape).astype(np.float32)
            at += size


def average(net: Attention, blocks: DataFrame, trainers: int, epochs: float) -> None:
    """One round in tasks: each trains on its blocks from the weights of ``net``, which takes the mean of their changes.

    An id's own embedding takes the mean over the tasks that met it. Changes travel in chunks and are added
    as they stream in, so a task holds one chunk.
    """
    start, own = net.flat(), slice(0, 0)
    at = 0
    for n in sorted(net.w):
        if n == "i":
            own = slice(at, at + net.w[n].size)
        at += net.w[n].size
    shared = blocks.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, x) for batch in batches for h, x in zip(batch.column("h").to_pylist(), batch.column("ids").to_pylist(), strict=True))
        if not rows:
            return
        mine = copy.deepcopy(shared.value)
        found = [np.frombuffer(x, np.uint16) for _, x in rows]
        pieces = sum(-(-(len(x) - 1) // WINDOW) for x in found)
        met = mine.train(found, int(np.ceil(epochs * pieces / BATCH)), RATE)
        change = np.concatenate([mine.flat() - start, met, [1]]).astype(np.float32)
        parts = [change[k : k + CHUNK].tobytes() for k in range(0, len(change), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "v"])

        for batch in batches:
            for k, v in zip(batch.column("part").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if k != part:
                    if part is not None:
                        yield out()
                    part, total = k, np.zeros(len(v) // 4)
                total += np.frombuffer(v, np.float32)
        if part is not None:
            yield out()

    sent = blocks.repartition(trainers).mapInArrow(run, "part int, v binary")
    sums = sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, v binary").collect()
    if not sums:
        return
    total = np.concatenate([np.frombuffer(r["v"]) for r in sorted(sums, key=lambda r: r["part"])])
    change, met, n = total[: len(start)], total[len(start) : -1], total[-1]
    scale = np.full(len(start), 1 / n)
    scale[own] = np.repeat(1 / np.maximum(met, 1), WIDTH)
    net.load(start + change * scale)


class Scorer:
    """Scores id sequences; the parts that tasks need."""

    def __init__(self, counts: np.ndarray, across: np.ndarray, cls: np.ndarray, net: Attention, starts: np.ndarray):
        self.cls, self.net, self.end, self.starts = cls.astype(np.int64), net, len(cls) - 1, starts
        net.ready()
        self.first, self.types = counts[CLASSES], counts[CLASSES + 1]
        alone = counts[: CLASSES + 1].sum(0) + SMOOTH
        share = alone / np.bincount(cls, alone, CLASSES)[cls]
        self.inside = np.empty((CLASSES, len(cls)), np.float32)  # log10 probability of an id in its class, by the class before
        for p in range(CLASSES):
            row = np.where(starts, across[p], counts[p])
            self.inside[p] = np.log10((row + BACKOFF * share) / (np.bincount(cls, row, CLASSES)[cls] + BACKOFF))

    def score(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities of every word of texts, all ids one after another; each text ends with the end id, a word too.

        Of its first id, and of its rest as the network spells it; then the share of the spelling, and what one
        occurrence of the word in the corpus adds.
        """
        flat = flat.astype(np.int64)
        y = self.cls[flat]
        starts = np.cumsum(sizes) - sizes
        x = np.r_[self.end, flat[:-1]]
        x[starts] = self.end
        inside = self.inside[self.cls[x], flat].astype(float)
        step = WINDOW - OVERLAP
        n = np.maximum(1, -(-(sizes - OVERLAP) // step))
        owner = np.repeat(np.arange(len(sizes)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = (k * step)[:, None] + np.arange(WINDOW)
        once = (at < sizes[owner][:, None]) & ((np.arange(WINDOW) >= OVERLAP) | (k == 0)[:, None])
        place = np.minimum(at, sizes[owner][:, None] - 1) + starts[owner][:, None]
        out, begin, goes = np.zeros(len(flat)), np.zeros(len(flat)), np.zeros(len(flat))
        for skip, windows in ((0, np.flatnonzero(k == 0)), (OVERLAP, np.flatnonzero(k > 0))):
            for a in range(0, len(windows), TOGETHER):
                p, c = place[windows[a : a + TOGETHER]], once[windows[a : a + TOGETHER]]
                some = p[c]
                out[some], begin[some], goes[some] = self.net.log_prob(x.take(p), y.take(p), c, skip)
        out = out / np.log(10) + inside
        at = np.flatnonzero(self.starts[flat])
        first = out[at]
        ended = np.where(flat[at] == self.end, 0, np.append(begin[at[1:]], 0)) / np.log(10)
        out += goes / np.log(10)
        out[at] = 0
        spelt = np.add.reduceat(out, at) + ended
        ids = flat[at]
        under = self.first[ids] + self.types[ids] + 1
        return first, spelt, (self.types[ids] + 1) / under, 1 / under


def mixed(spelling: np.ndarray, share: np.ndarray, each: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log10 probability of words given their first id: spelling and count, added as logs."""
    with np.errstate(divide="ignore"):
        return np.logaddexp((spelling + np.log10(share)) * np.log(10), np.log(each * c)) / np.log(10)


def fit(training: DataFrame, words: DataFrame, path: str, n_texts: int, attends: bool = True) -> Scorer:
    """``training`` has id and text, ``words`` their counts."""
    sub = subwords(path)
    blocks = materialize(blocks_of(training, path))
    drawn = blocks.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 2
    trainers = max(1, -(-drawn // TRAINER_IDS))
    often = block_counts(blocks, sub.size)
    rank = np.argsort(-often, kind="stable")
    cls = classes_of(often, context_counts(blocks, rank[often[rank] > 0], often), sub.starts)
    net = Attention(cls, sub.starts, attends)
    # the blocks of one trainer start the weights, but for those with words of very many ids
    begun = blocks.where(F.pmod("h", F.lit(trainers)) == 0).where(F.length("ids") <= 64 * BLOCK)
    found = [np.frombuffer(x, np.uint16) for _, x in sorted((r["h"], bytes(r["ids"])) for r in begun.collect())]
    net.train(found, STEPS, START_RATE, 30)
    pieces = sum(-(-(len(x) - 1) // WINDOW) for x in found)
    average(net, blocks, trainers, max(1.0, STEPS * BATCH / max(pieces, 1)))
    made = Scorer(id_counts(words, path, cls, n_texts), start_counts(blocks, cls, sub.starts), cls, net, sub.starts)
    discard(blocks)
    return made


def score_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``df``."""
    spark = df.sparkSession
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    held = crc_mod(F.col("id"), 10) == 0
    training = docs.where(~held)
    words = materialize(word_counts(training))
    n_texts = training.count()
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = total + n_texts, distinct + (n_texts > 0)
    under = n + SMOOTH * (v + 1)
    least = max(1, int(np.ceil(HEAD_SHARE * n)))  # at most 1 / HEAD_SHARE words occur as often
    common = (F.col("c") >= least) & (F.length("word") <= HEAD_BYTES)
    head = {bytes(r["word"]): r["c"] for r in words.where(common).toLocalIterator()}
    owner = uuid.uuid4().hex
    sweep(spark)
    shared = spark.sparkContext.broadcast((head, fit(training, words, path, n_texts)))
    sweep(spark)
    end_base = float(np.log10((n_texts + SMOOTH) / under)) if under else 0.0
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scorer = shared.value
        sub = subwords(path)
        for batch in slices(batches, max_bytes=2_000_000):
            if not batch.num_rows:
                continue
            found, lengths = words_of(batch.column("text"))
            ids, sizes, c = sub.pack(found, lengths, counts, owner)
            ends = np.cumsum(lengths + 1) - 1
            upto = np.cumsum(sizes)[ends]
            first, spelling, share, each = scorer.score(ids, np.diff(upto, prepend=0))
            c = c.astype(float)
            c[ends] = 0  # the end is a class of its own, its spelling certain
            share[ends] = 1
            head, begins = c >= 0, np.r_[0, ends[:-1] + 1]
            word = np.where(head, first + mixed(spelling, share, each, np.maximum(c, 0)), first)
            scores = np.add.reduceat(word, begins)
            unigram = np.where(head, np.log10((np.maximum(c, 0) + SMOOTH) / under), 0)
            unigram[ends] = end_base
            base = np.add.reduceat(unigram, begins)
            known = np.add.reduceat(head.astype(np.int64), begins) - (n_texts == 0)
            head[ends] = True
            places = np.flatnonzero(~head)
            rows = batch.column("row")
            none = [pa.nulls(len(lengths), t) for t in rare_types]
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), pa.array(lengths + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), *none], names=names)
            if len(places):
                m, at = len(places), np.searchsorted(ends, places)
                rare, at = found.take(pa.array(places - at)).cast(pa.binary()), pa.array(at)
                some = [pa.array(x.astype(np.float32)) for x in (spelling[places] + np.log10(share[places]), each[places])]
                yield pa.RecordBatch.from_arrays([rows.take(at), pa.nulls(m, batch.column("id").type), *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], rare, *some], names=names)

    names = ["row", "id", "n_tokens", "n_known", "base", "score", "word", "spelt", "each"]
    rare_types = [pa.binary(), pa.float32(), pa.float32()]
    scored = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(run, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, word binary, spelt float, each float"))
    rare = scored.where("n_tokens is null").select("row", "word", "spelt", "each").join(words.where(~common), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    # spelling and count, added as logs
    spelt, counted = F.col("spelt").cast("double"), F.log10(F.col("each").cast("double") * c)
    top = F.greatest(spelt, counted)
    given = F.when(c == 0, spelt).otherwise(top + F.log10(F.pow(F.lit(10.0), spelt - top) + F.pow(F.lit(10.0), counted - top)))
    added = rare.groupBy("row").agg(F.sum(F.log10((c + SMOOTH) / F.lit(under))).alias("more"), F.sum(given).alias("given"), F.sum((c > 0).cast("long")).alias("found"))
    main = scored.where("n_tokens is not null").join(added, "row", "left")
    return main.select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("given", F.lit(0.0))).alias("score"),
    )
