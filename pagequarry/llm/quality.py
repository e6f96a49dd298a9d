"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each whole text becomes a short vector of document statistics. Standardized, it is mapped to random
Fourier features, whose inner products approximate a Gaussian kernel. Every partition of the labelled
rows sums its part of the normal equations; the sums are added up by matrix row in one shuffle, and
the driver solves a system of fixed size. Ridge scores of the labelled rows, counted in fixed bins,
are made monotone by pooling adjacent violators, which turns a score into a probability.

Null texts count as empty and get a score like any other. Null labels are not learned from. With no
labels every score is 0.5. Repeated rows get the same score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import crc_mod, materialize, slices, texts_of

FOURIER, GAMMA, RIDGE, SEED, BINS = 192, 0.08, 1.0, 7, 400
THRESHOLD = 0.3
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_MARKS = [ord(c) for c in ".,;:?'\"()-"]
N_STATS = 16


def stats_of(text: str) -> list[float]:
    """Document statistics; shares lie between 0 and 1, sizes are logarithms."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw.strip():
        return [0.0] * N_STATS
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    k = len(words)
    lengths = np.fromiter(map(len, words), np.int32, k)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:]))) if k > 2 else 0  # noqa: B905
    letters = h[_UPPER].sum() + h[_LOWER].sum() + h[128:].sum()
    return [
        float(x)
        for x in (
            np.log1p(k),
            np.log1p(len(lines)),
            h[_UPPER].sum() / max(letters, 1),
            h[_SYMBOLS].sum() / n,
            h[_MARKS].sum() / n,
            min(raw.count(b"!!") / k, 1),
            min(raw.count(b" | ") / k, 1),
            h[_DIGIT].sum() / n,
            h[128:].sum() / n,
            letters / n,
            lengths.mean() / 10,
            lengths.std() / 10,
            (lengths <= 3).mean(),
            len(set(words)) / k,
            triples / max(k - 2, 1),
            len(set(lines)) / len(lines),
        )
    ]


def document_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, stats array<double> of each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([stats_of(t) for t in texts_of(batch)], pa.list_(pa.float64()))], names=[id_col, "stats"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, stats array<double>")


class FourierMap:
    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (N_STATS, FOURIER))
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, stats: pd.Series) -> np.ndarray:
        x = np.array(stats.tolist(), float).reshape(-1, N_STATS)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b), np.ones(len(z))]


def _sums(rows: DataFrame, make, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all partitions of the matrices that ``make`` gives for their frames; only the sum, of a fixed size, reaches the driver."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for frame in frames:
            if len(frame):
                total += make(frame)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    found = np.zeros(shape)
    for r in rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        found[r["i"], r["j"]] = r["v"]
    return found


def pooled(counts: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Isotonic rates of consecutive bins by pooling adjacent violators; empty bins take a neighbour's rate."""
    blocks: list[list[float]] = []  # weight, hits, bins
    for c, h in zip(counts, hits, strict=True):
        blocks.append([c, h, 1])
        while len(blocks) > 1 and (blocks[-1][0] == 0 or blocks[-2][0] == 0 or blocks[-2][1] / blocks[-2][0] >= blocks[-1][1] / blocks[-1][0]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), h / c if c else 0.5) for c, h, n in blocks])


class QualityModel:
    """Fitted on the driver from sums of fixed size."""

    def __init__(self, stats: DataFrame):
        """``stats`` has columns stats and y (0 or 1)."""
        moments = _sums(stats, _moments, (2, N_STATS + 1))
        self.n = moments[0, 0]
        if not self.n:
            return
        mean = moments[0, 1:] / self.n
        self.map = FourierMap(mean, np.sqrt(np.maximum(moments[1, 1:] / self.n - mean**2, 0)))
        fourier = self.map

        def normal(frame: pd.DataFrame) -> np.ndarray:
            z = fourier(frame["stats"])
            return z.T @ np.c_[z, frame["y"].to_numpy(float)]

        m = _sums(stats, normal, (FOURIER + 1, FOURIER + 2))
        self.weights = np.linalg.solve(m[:, :-1] + RIDGE * np.eye(FOURIER + 1), m[:, -1])
        weights = self.weights

        def binned(frame: pd.DataFrame) -> np.ndarray:
            at = _bin(fourier(frame["stats"]) @ weights)
            return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, frame["y"].to_numpy(float), BINS)])

        counts, hits = _sums(stats, binned, (2, BINS))
        self.rates = pooled(counts, hits)

    def score(self, stats: pd.Series) -> np.ndarray:
        if not self.n:
            return np.full(len(stats), 0.5)
        raw = self.map(stats) @ self.weights
        # a sliver of the raw score keeps the order within a pooled block
        return np.clip(0.999 * self.rates[_bin(raw)] + 0.001 * np.clip(raw, 0, 1), 0, 1)


def _moments(frame: pd.DataFrame) -> np.ndarray:
    x = np.array(frame["stats"].tolist(), float).reshape(-1, N_STATS)
    return np.c_[[len(x), len(x)], [x.sum(0), (x**2).sum(0)]]


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of each row of ``df``; rows with crc32(id) mod 5 = 0 are not learned from."""
    stats = materialize(document_stats(df, id_col, text_col))
    held = crc_mod(F.col(id_col), 5) == 0
    marks = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("_id"), F.col("quality").cast("double").alias("y"))
    learned = materialize(stats.where(~held).join(marks, F.col(id_col) == F.col("_id")).select("stats", "y"))
    model = QualityModel(learned)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = model.score(frame["stats"])
            yield pd.DataFrame({id_col: frame[id_col], "held_out": frame["held_out"], "score": s, "predicted": (s >= THRESHOLD).astype("int32")})

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.withColumn("held_out", held).mapInPandas(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
