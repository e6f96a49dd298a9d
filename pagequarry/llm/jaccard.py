"""N-gram Jaccard join with a count-vector R-tree.

The set of a text is its distinct shingles, as 64-bit hashes. Shingles are also hashed into ``GROUPS``
groups: the counts per group are a point, and two sets share at most the sum of the coordinates' minima.
A bulk-loaded R-tree over such points bounds whole nodes by the minima with a node's largest
coordinates; pairs that survive are verified on the sets.

Distribution. Equal sets are one key (a 64-bit sum over the set). A key goes to the blocks of its
prefix, its first n - ceil(0.8 n) + 1 shingles in one global order; sets that link share one of these.
The order puts shingles that a sketch of fixed size counts often last, so that passages which many
texts share do not make blocks. Keys alone in a block leave, and of blocks with the same keys one stays.
The R-trees of the blocks that are left are searched twice:

1. for the key whose prefix is shared most (the text that others were made from); verified pairs give
   components, and
2. for all keys, among those of other components, so every link between components is found. Pairs
   within a component are not made, which spares the square of a group of copies. A block too large for
   one tree is searched in pairs of slices.

``linked_pairs`` makes the pairs within components too, and counts links.

Counts are made again from the texts of keys with a block, found through a Bloom filter of fixed size, and
bound the pairs. Only texts of pairs that are left after that travel, and their sets are compared two at a time.

Null and blank texts have no shingles, link with nothing and are their own component; texts with fewer
words than a shingle have their words as one. Null ids are returned with a null component. Repeated
rows are one key and one component.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import UPPER, matched, materialize, slices, small
from pagequarry.llm.components import connected_components

WIDTH, PERCENT = 5, 80
#: Groups of the count vectors, children of an R-tree node, cells of the frequency sketch, rows of a tree.
GROUPS, FANOUT, CELLS, TREE_ROWS = 256, 16, 1 << 16, 4096
#: Least and most groups of the finer counts that pairs are bounded with, about two for a shingle.
FINE_LEAST, FINE_MOST = 256, 1 << 17
#: 64-bit words of the Bloom filter of candidates.
BLOOM_WORDS = 1 << 18
_LOW = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_in(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOW).split() if text else []


def shingle_sets(texts: list[list[bytes]], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of word lists; one array of words is hashed for all of them."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = list(itertools.chain.from_iterable(texts))
    h = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    n = max(len(h) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += _mix(h[k : k + n] * _ODD[k % 5] + np.uint64(k))
    rolled = _mix(rolled)
    found, at = [], 0
    for size in sizes.tolist():
        if size >= width:
            s = np.sort(rolled[at : at + size - width + 1])
            found.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif size:
            some = h[at : at + size]
            found.append(_mix(np.array([np.sum(_mix(some * _ODD[:size] + np.arange(size, dtype=np.uint64))) + np.uint64(size) * _ODD[4]], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
        at += size
    return found


def set_key(s: np.ndarray) -> int:
    return int(np.add.reduce(_mix(s + _ODD[1])).view(np.int64)) if len(s) else 0


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts in ``GROUPS`` groups, a byte each. With a count over 254 all are 255, which bounds nothing."""
    c = np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.full(GROUPS, 255, np.uint8) if c.max(initial=0) > 254 else c.astype(np.uint8)


def fine_counts(s: np.ndarray) -> bytes:
    """Counts in a power of two of groups, four bits each: the lower half of the groups in the low bits.

    With a count over 14 nothing is bounded, and there are no bytes.
    """
    g = min(max(FINE_LEAST, 1 << (2 * len(s)).bit_length()), FINE_MOST)
    c = np.bincount((s >> np.uint64(24)).astype(np.int64) & (g - 1), minlength=g)
    return b"" if c.max() > 14 else (c[: g // 2] | c[g // 2 :] << 4).astype(np.uint8).tobytes()


def fine_overlap(x: bytes, y: bytes) -> int | None:
    """The most that two sets can share; groups of the larger counts are folded to those of the smaller."""
    if not x or not y:
        return None
    if len(x) < len(y):
        x, y = y, x
    u, v = (np.frombuffer(z, np.uint8) for z in (x, y))
    u, v = np.concatenate([u & 15, u >> 4]), np.concatenate([v & 15, v >> 4])
    while len(u) > len(v):
        u = u[: len(u) // 2] + u[len(u) // 2 :]  # a size ratio of at most 5 : 4 folds once
    return int(np.minimum(u, v).sum())


def needed(n: np.ndarray, m: int, percent: int = PERCENT) -> np.ndarray:
    """Least intersection of linked sets of sizes n and m."""
    return -((-percent * (n + m)) // (100 + percent))


class Forest:
    """Bulk-loaded R-trees over count vectors, one for each block, searched for many points at once.

    Rows come sorted by block. A node knows the largest coordinates below it, the range of sizes and of
    roots; its children lie side by side. ``levels`` goes from rows to the trees' roots.
    """

    def __init__(self, block: np.ndarray, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        order = np.lexsort((points[:, 0], sizes, roots, block))
        self.order = order
        one = np.ones(len(order), np.int64)
        self.levels = [(block[order], points[order], sizes[order], sizes[order], roots[order], roots[order], np.arange(len(order)), one)]
        while True:
            of, high, least, most, lo, hi, _, _ = self.levels[-1]
            new = np.r_[True, of[1:] != of[:-1]]
            if new.all():
                break
            first = np.flatnonzero(new)
            within = np.arange(len(of)) - first[np.cumsum(new) - 1]
            starts = np.flatnonzero(within % FANOUT == 0)
            count = np.diff(np.r_[starts, len(of)])
            self.levels.append((of[starts], np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), starts, count))

    def search(self, block: np.ndarray, points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of one block and different roots whose sets may link."""
        top = self.levels[-1][0]
        node = np.minimum(np.searchsorted(top, block), len(top) - 1)
        query = np.flatnonzero(top[node] == block)
        node = node[query]
        for depth in range(len(self.levels) - 1, -1, -1):
            _, high, least, most, lo, hi, start, count = self.levels[depth]
            keep = []
            for at in range(0, len(query), 1 << 15):
                q, v = query[at : at + (1 << 15)], node[at : at + (1 << 15)]
                size = sizes[q]
                # a node's need is at least that of the smallest set in it that can link at all
                low = np.maximum(least[v], -(-percent * size // 100))
                fits = (least[v] * percent <= 100 * size) & (low <= most[v]) & ((lo[v] != hi[v]) | (lo[v] != roots[q]))
                some = np.flatnonzero(fits)
                fits[some] = np.minimum(high[v[some]], points[q[some]]).sum(1) >= np.minimum(needed(low[some], size[some], percent), 254 * GROUPS)
                keep.append(fits)
            kept = np.concatenate(keep) if keep else np.zeros(0, bool)
            query, node = query[kept], node[kept]
            if depth:
                n = count[node]
                first = np.cumsum(n) - n
                node = np.repeat(start[node], n) + np.arange(int(n.sum())) - np.repeat(first, n)
                query = np.repeat(query, n)
        return query, self.order[node]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, max_bytes=1_500_000):
        yield batch, shingle_sets([words_in(t) for t in batch.column("text").to_pylist()])


def profile(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, tag, n, key) of every row of ``docs`` (id, tag, text), and the cells of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["id", "tag", "n", "key", "cell", "times"]
        for batch, sets in _batches(batches):
            for s in sets:
                cells += np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(s) > CELLS // 8 else 0
            short = [s for s in sets if len(s) <= CELLS // 8]
            if short:
                cells += np.bincount((np.concatenate(short) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64())], names=names)
        used = np.flatnonzero(cells)
        k = len(used)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 4, pa.array(used.astype(np.int32)), pa.array(cells[used])], names=names)

    both = materialize(docs.mapInArrow(run, "id long, tag long, n long, key long, cell int, times long"))
    return both.where("cell is null").select("id", "tag", "n", "key"), both.where("cell is not null").select("cell", "times")


def prefixes(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """(token, key) for the prefix of every distinct set, once for each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in _batches(batches):
            tokens, keys, sizes = [], [], []
            for s in sets:
                key = set_key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                # hottest cells last; equal counts in order of the hash
                heat = often[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                p = prefix_length(len(s))
                tokens.append(s[np.lexsort((s, heat))[:p]])
                keys.append(key)
                sizes.append(p)
            if len(seen) > 300_000:
                seen.clear()
            if tokens:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(tokens)), pa.array(np.repeat(np.array(keys, np.int64), sizes))], names=["token", "key"])

    return docs.mapInArrow(run, "token long, key long")


def bloom_of(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of fixed size for a column of longs."""
    rows = keys.select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(column)), F.lit(BLOOM_WORDS * 64)) for k in (1, 2)])).alias("bit"))
    bits = rows.groupBy(F.shiftright("bit", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("v"))
    found = np.zeros(BLOOM_WORDS, np.int64)
    for r in bits.toLocalIterator():
        found[r["w"]] = r["v"]
    return found


def _made_of(docs: DataFrame, named: DataFrame, made: Callable[[list[list[bytes]], list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """A row of ``made`` (key and what is in ``schema``), from the text of that id and key, beside each of ``named`` (key, id)."""
    sieve = bloom_of(named.select(F.xxhash64("id").alias("h")), "h")  # an id may have several texts: the key decides
    names = ["key", *[c.split()[0] for c in schema.split(", ")]]
    marked = docs.withColumns({f"_b{k}": F.pmod(F.xxhash64(F.lit(k), F.xxhash64("id")), F.lit(BLOOM_WORDS * 64)) for k in (1, 2)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.ones(batch.num_rows, bool)
            for name in ("_b1", "_b2"):
                bit = batch.column(name).to_numpy()
                mask &= (sieve[bit >> 6] >> (bit & 63)) & 1 == 1
            for some in slices(iter([batch.select(["id", "text"]).filter(pa.array(mask))]), max_bytes=1_500_000):
                words = [w for w in map(words_in, some.column("text").to_pylist()) if w]
                sets = shingle_sets(words)
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), *made(words, sets)], names=names)

    texts = marked.mapInArrow(run, f"key long, {schema}").dropDuplicates(["key"])
    return materialize(texts.join(small(named.withColumnRenamed("id", "rep"), 500_000), "key"))


def candidate_counts(docs: DataFrame, reps: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, vector, fine, n, rep) of the sets named in ``keys`` (key), from one text of each, and its columns; counts are compressed."""

    def made(_: list[list[bytes]], sets: list[np.ndarray]) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(level=1).compress
        vectors = [count_vector(s).tobytes() for s in sets]
        return [pa.array(map(pack, vectors), pa.binary()), pa.array([pack(fine_counts(s)) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]

    named = materialize(reps.join(keys, "key").withColumnRenamed("rep", "id"))
    return _made_of(docs, named, made, "vector binary, fine binary, n long")


def packed_texts(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(key, packed, rep) of the sets in ``named`` (key, id): the words of one text of each, compressed."""

    def made(words: list[list[bytes]], _: list[np.ndarray]) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(level=1).compress
        return [pa.array([pack(b" ".join(w)) for w in words], pa.binary())]

    return _made_of(docs, named, made, "packed binary")


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of keys whose sets link. Pairs are first bounded by counts in many groups."""
    points = texts.select("key", "fine", "n")
    left, right = points.toDF("a", "fa", "na"), points.toDF("b", "fb", "nb")

    def bounded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for f in frames:
            need = needed(f["na"].to_numpy(), f["nb"].to_numpy(), percent).tolist()
            most = [fine_overlap(unpack(x), unpack(y)) for x, y in zip(f["fa"], f["fb"], strict=True)]
            yield f.loc[[m is None or m >= k for m, k in zip(most, need, strict=True)], ["a", "b"]]

    near = materialize(pairs.join(left, "a").join(right, "b").mapInPandas(bounded, "a long, b long"))
    asked = near.select(F.col("a").alias("key")).union(near.select("b")).distinct()
    packed = packed_texts(docs, materialize(texts.select("key", F.col("rep").alias("id")).join(asked, "key"))).select("key", "packed")
    both = near.join(packed.toDF("b", "pb"), "b").join(packed.toDF("a", "pa"), "a").select("a", "b", "pa", "pb")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, held_set = None, None
        for f in frames:
            keep = []
            for a, x, y in zip(f["a"], f["pa"], f["pb"], strict=True):
                if a != held:
                    held, held_set = a, shingle_sets([unpack(x).split()])[0]
                other = shingle_sets([unpack(y).split()])[0]
                same = len(np.intersect1d(held_set, other, assume_unique=True))
                keep.append(100 * same >= percent * (len(held_set) + len(other) - same))
            yield f.loc[keep, ["a", "b"]]

    return both.mapInPandas(check, "a long, b long")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows with the number of slices of ``TREE_ROWS`` that their block has, and their own."""
    counts = rows.groupBy("token").count().where(F.col("count") > TREE_ROWS).withColumn("parts", F.ceil(F.col("count") / TREE_ROWS).cast("int")).select("token", "parts")
    return rows.join(counts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def tree_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys of different roots in one block that the R-trees cannot rule out.

    ``rows`` has token, key, n, root, vector. Blocks larger than ``TREE_ROWS`` are cut into slices, and
    every pair of slices is a block of its own. A task holds a few blocks at a time.
    """
    groups = _cut(rows).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "n", "root", "vector")
    return _searched(groups)


def lead_pairs(rows: DataFrame, leads: DataFrame) -> DataFrame:
    """Pairs (a, b) of a block's lead and a key of the block that the R-trees cannot rule out.

    ``rows`` has token, key, n, vector and ``leads`` token and the row of the lead. Each slice of a large block
    is searched for the lead alone, so the work is linear in the block. Slices are numbered from 0, the lead is in -1.
    """
    cut = _cut(rows)
    members = cut.select("token", F.lit(-1).alias("i"), F.col("part").alias("j"), "part", "key", "n", F.col("key").alias("root"), "vector")
    slices_ = cut.select("token", "part").distinct().join(leads, "token")
    asked = slices_.select("token", F.lit(-1).alias("i"), F.col("part").alias("j"), F.lit(-1).alias("part"), "key", "n", F.col("key").alias("root"), "vector")
    return _searched(members.union(asked))


def _searched(groups: DataFrame) -> DataFrame:
    """Pairs of each (token, i, j): points of part i are looked for in the R-tree of those of part j."""
    dealt = groups.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def pairs_of(f: pd.DataFrame, block: np.ndarray) -> pd.DataFrame:
        x = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, f["vector"])), np.uint8).reshape(len(f), GROUPS)
        n, key, root, part = f["n"].to_numpy(np.int64), f["key"].to_numpy(), f["root"].to_numpy(), f["part"].to_numpy()
        inner, outer = np.flatnonzero(part == f["j"].to_numpy()), np.flatnonzero(part == f["i"].to_numpy())
        if not len(inner) or not len(outer):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        forest = Forest(block[inner], x[inner], n[inner], root[inner])
        found = []
        for at in range(0, len(outer), 1024):  # bounds the pairs under way
            some = outer[at : at + 1024]
            q, hit = forest.search(block[some], x[some], n[some], root[some])
            a, b = key[some[q]], key[inner[hit]]
            found.append(np.unique(np.c_[np.minimum(a, b), np.maximum(a, b)][a != b], axis=0))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in itertools.chain(frames, [None]):
            if f is not None:
                held.append(f)
                if sum(map(len, held)) < 4 * TREE_ROWS:
                    continue
            whole = pd.concat(held, ignore_index=True) if held else None
            if whole is None or not len(whole):
                continue
            new = np.r_[True, (whole[["token", "i", "j"]].to_numpy()[1:] != whole[["token", "i", "j"]].to_numpy()[:-1]).any(1)]
            end = len(whole) if f is None else int(np.flatnonzero(new)[-1])  # the last block may go on
            block = np.cumsum(new)
            held = [whole.iloc[end:]]
            if end:
                yield pairs_of(whole.iloc[:end], block[:end])

    return dealt.mapInPandas(run, "a long, b long").distinct()


def _blocks(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profiles, reps, rows of distinct blocks (token, key), counts of their keys) of ``docs`` (id, tag, text).

    The counts have ``times`` too, the number of tokens that a key shares with others.
    """
    profiles, cells = profile(docs)
    often = np.zeros(CELLS, np.int64)
    for r in cells.groupBy("cell").agg(F.sum("times").alias("times")).collect():
        often[r["cell"]] = r["times"]
    rough = np.floor(4 * np.log2(often + 1)).astype(np.int64)  # only how hot a cell is counts, the hash orders the rest
    reps = profiles.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"))
    tokens = prefixes(docs.where("id is not null"), rough)
    here = Window.partitionBy("token").orderBy("key")
    shared = materialize(tokens.select("*", F.lag("key").over(here).alias("_p"), F.lead("key").over(here).alias("_n")).where("(_p is not null and _p <> key) or (_n is not null and _n <> key)").select("token", "key").distinct())
    texts = candidate_counts(docs, reps, shared.groupBy("key").agg(F.count(F.lit(1)).alias("times")))
    return profiles, reps, materialize(shared.join(_distinct_blocks(shared.withColumn("root", F.col("key"))), "token")), texts


def _distinct_blocks(rows: DataFrame, only: str = "true") -> DataFrame:
    """(token) of the blocks of ``rows`` (token, key, root) for which ``only`` holds, one of those with the same keys."""
    blocks = rows.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("_c"), F.bit_xor(F.xxhash64("key")).alias("_x"), F.min("key").alias("_m")).where(only)
    return blocks.groupBy("_c", "_x", "_m").agg(F.min("token").alias("token")).select("token")


def _star_pairs(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of every block's lead and its other keys, found in the blocks' R-trees."""
    # the share of a prefix that others have: highest for the text that copies were made from
    share = F.col("times") / (F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100) + 1)
    rows = materialize(shared.join(texts.select("key", "n", share.alias("share"), "vector"), "key"))
    leads = rows.groupBy("token").agg(F.max_by(F.struct("key", "n", "vector"), F.struct("share", -F.col("key"))).alias("_l")).select("token", "_l.*")
    return lead_pairs(rows.select("token", "key", "n", "vector"), leads)


def link_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagged: bool = False) -> DataFrame:
    """id, n_shingles, component_id of each row of ``df``: the smallest id that links can reach.

    An id may have several texts: each row has the component of its own text. With ``tagged`` the rows also
    have ``tag``, the hash of their text, and ``root``, which names the component by one of its sets.
    """
    docs = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(df[text_col]).alias("tag"), df[text_col].alias("text"))
    profiles, reps, shared, texts = _blocks(docs)
    pairs = materialize(_star_pairs(shared, texts))
    edges = materialize(verified(pairs, texts, docs))
    roots = connected_components(edges)
    rooted = shared.join(small(roots, 500_000).withColumnRenamed("id", "key"), "key", "left").select("token", "key", F.coalesce("root", "key").alias("root")).repartition("token")
    # blocks of different roots
    rest = rooted.join(_distinct_blocks(rooted, "_lo <> _hi"), "token").join(texts.select("key", "n", "vector"), "key", "left")
    more = materialize(verified(materialize(tree_pairs(rest).join(pairs, ["a", "b"], "left_anti")), texts, docs))
    final = connected_components(edges.union(more))
    joined = reps.join(final.withColumnRenamed("id", "key"), "key", "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    named = materialize(joined.join(least, "root").select("key", "component", "root"))
    # empty sets link with nothing, whatever their key
    done = profiles.join(named.withColumnRenamed("key", "_k"), (F.col("key") == F.col("_k")) & (F.col("n") > 0), "left")
    return done.select(F.col("id").alias(id_col), *[F.col("tag"), F.col("root")] * tagged, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))


def linked_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (pairs, members). Pairs (a, b) are between different sets, named by their keys; members
    have id, key and n_links, the number of other rows that the row links with, equal ones included.

    No pair is left out, so a group of near copies gives the square of its distinct sets. Rows without
    words or an id have no key and no links.
    """
    docs = df.select(df[id_col].cast("long").alias("id"), F.xxhash64(df[text_col]).alias("tag"), df[text_col].alias("text"))
    profiles, _, shared, texts = _blocks(docs)
    rest = shared.withColumn("root", F.col("key")).join(texts.select("key", "n", "vector"), "key")
    pairs = materialize(verified(materialize(tree_pairs(rest)), texts, docs))
    held = profiles.where("n > 0 and id is not null")
    size = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("size")))
    both = pairs.union(pairs.select("b", "a"))
    near = both.join(size.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("size").alias("others"))
    links = size.join(near, "key", "left").select("key", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    keys = profiles.select("id", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("key")).alias("key"))
    return pairs, keys.join(links, "key", "left").select(F.col("id").alias(id_col), "key", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the row of the smallest (id, text hash) stays.

    Rows without words or without an id are copies of nothing and all stay. Columns are as they were.
    """
    found = link_groups(df, id_col, text_col, tagged=True).select(F.col(id_col).alias("id"), "tag", F.col("n_shingles").alias("n"), "root")
    rows = materialize(found.where("n > 0 and id is not null").groupBy("root", "id", "tag").agg(F.count(F.lit(1)).alias("c")))
    first = rows.groupBy("root").agg(F.min(F.struct("id", "tag")).alias("_f")).select(F.col("root").alias("_r"), "_f.*").toDF("_r", "_i", "_t")
    kept = rows.join(first, (F.col("root") == F.col("_r")) & (F.col("id") == F.col("_i")) & (F.col("tag") == F.col("_t")), "left")
    dropped = materialize(kept.where("_r is null").select("id", "tag"))
    again = materialize(kept.where("_r is not null and c > 1").select("id", "tag"))
    by = [df[id_col].cast("long"), F.xxhash64(df[text_col])]
    left = matched(df, by, dropped, "left_anti")
    if again.isEmpty():
        return left
    # rows of one id and text: one stays
    return matched(left, by, again, "left_anti").unionByName(matched(left, by, again, "left_semi").dropDuplicates([id_col, text_col]))
