"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary made of training texts. A text is cut into
blocks, each block is compressed with every dictionary, and the language with the fewest bytes over all
blocks of the whole text wins. The score is a logistic of the relative margin to the next language;
``rejected`` marks texts whose margin is under ``min_margin``, that have no letter, or that are null.

Null and letterless texts get ``und`` and score 0. Ties go to the language of more training rows, then
to the first in alphabetical order.
With no training text every row gets ``und``. Repeated rows get the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import crc_mod, slices

UNKNOWN = "und"
#: Training texts of a language, bytes of its dictionary, and learned languages, at most.
TRAIN_TEXTS, DICTIONARY_BYTES, MAX_LANGUAGES = 60, 65_536, 256
BLOCK_BYTES = 4096
#: Bytes of a text that stay together in a dictionary.
PIECE_BYTES = 256
#: Matches of four bytes already count, as they are what tells languages apart.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY, "min_match": 4, "window_log": 17, "hash_log": 17, "chain_log": 16, "search_log": 3, "target_length": 16}
#: Relative margin below which a text is rejected, and the margin at which the score is about 0.88.
MIN_MARGIN, SCALE = 0.002, 0.02
_LETTER = regex.compile(r"\p{L}")


def learn(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary's content for each language of the rows where ``training`` holds.

    A language is learned from the ``TRAIN_TEXTS`` texts of lowest hash, and the ``MAX_LANGUAGES`` languages
    of most rows are (bounds of the classifier's sample). Of each text the dictionary holds pieces from
    its whole length; only as many bytes as a dictionary has leave a task. Texts without a letter teach nothing.
    """
    rows = df.where(training).select(df[id_col].alias("_id"), df[lang_col].alias("_lang")).where(F.col("_lang").isNotNull()).withColumn("_o", F.xxhash64("_id"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_o", "_id"))
    often = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_LANGUAGES).collect()}
    ids = {r["_id"] for r in rows.where(F.col("_lang").isin(list(often))).withColumn("_r", rank).where(F.col("_r") <= TRAIN_TEXTS).select("_id").distinct().collect()}
    if not ids:
        return {}
    texts = df.where(training).where(df[id_col].isin(list(ids))).select(F.xxhash64(df[id_col]).alias("h"), df[lang_col].alias("lang"), df[text_col].alias("text")).where(F.col("lang").isin(list(often)) & F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [spread(normal(t), DICTIONARY_BYTES) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(parts, pa.binary())], names=["h", "lang", "part"])

    found: dict[str, list[bytes]] = {}
    # an id that repeats has few different texts; a third text or more of one teaches nothing new
    pieces = texts.mapInArrow(cut, "h long, lang string, part binary").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang", "h").orderBy("part"))).where("k <= 2")
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["h"], bytes(r["part"]))):
        found.setdefault(r["lang"], []).append(bytes(r["part"]))
    return {lang: _fill(found[lang]) for lang in sorted(found, key=lambda x: (-often.get(x, 0), x))}


def spread(raw: bytes, size: int) -> bytes:
    """``size`` bytes of ``raw``, in pieces of equal distance over all of it; all where it has fewer."""
    if len(raw) <= size:
        return raw
    n = max(1, size // PIECE_BYTES)
    return b"".join(raw[k * len(raw) // n : k * len(raw) // n + size // n] for k in range(n))


def _fill(parts: list[bytes]) -> bytes:
    """Every text gives the same share of the dictionary; what short texts leave goes to longer ones."""
    content, room = b"", DICTIONARY_BYTES
    for k, part in enumerate(sorted(parts, key=lambda p: (len(p), p))):
        share = room // (len(parts) - k)
        taken = spread(part, share)
        content, room = content + taken, room - len(taken)
    return content


#: ASCII marks and digits become spaces, symbols go.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() or b in b"'-" else 32 for b in range(256))
_GONE = b"!#*$%&|<>"


def normal(text: str) -> bytes:
    """Letters in lower case and spaces, so that shouting and junk do not hide a language."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS_ONLY, _GONE)


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.compress = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(write_checksum=0, write_content_size=0, write_dict_id=0, **SEARCH)
            d.precompute_compress(compression_params=p)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = normal(text)
        blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum(len(f(b)) for b in blocks) for f in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for k, s in enumerate(sizes) if k != best]
        margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
        return self.langs[best], 1 / (1 + math.exp(-2 * min(margin / SCALE, 20))), margin < MIN_MARGIN


def identify(df: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected of each row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(contents)
        for batch in slices(batches):
            got = [classifier.predict(t) for t in batch.column("text").to_pylist()]
            langs, scores, out = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def training_rows(df: DataFrame, id_col: str = "doc_id") -> Column:
    return crc_mod(df[id_col], 3) != 1


def filter_known(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose language is not rejected, with their columns as they are.

    Rows are kept or dropped where they are read: the text is classified in the same pass.
    """
    contents = learn(df, training_rows(df, id_col), id_col)
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(contents)
        for batch in slices(batches):
            mask = [not classifier.predict(t)[2] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, schema)
