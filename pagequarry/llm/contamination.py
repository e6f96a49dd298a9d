"""Benchmark decontamination by size-partitioned MinHash containment search, native.

Items are dealt into partitions by their number of shingles (powers of two), as the smallest hashes of a
short item say little about a long document at one common signature length. A partition of up to u
shingles allows u - ceil(c u) of them to be missing; an item's signature is its K smallest hashed
shingles, K that many and ``extra`` more. The largest hash of the partition's signatures bounds the
document's signature: all its shingles whose hash is no larger, however long it is. A document that
holds a share c of an item with q shingles misses at most q - ceil(c q) of the K, so a pair whose
signatures meet in fewer than K less that number cannot match and none is lost; the pairs that do are
verified on the shingles themselves.

Items and texts of fewer words than a shingle count as one shingle of all their words; those without
words match nothing. Null ids take part like others. Repeated items and rows give repeated matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import materialize, small, words_of

WIDTH, CONTAINED = 5, 0.8
#: Signature rows (16 bytes each) and candidate pairs that may be broadcast at most.
MAX_BROADCAST_ROWS = 400_000


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of the shingles of a column of words, with repeats."""
    n = F.size(words)
    made = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(made, 1, F.greatest(n - (width - 1), F.lit(1))))


def shingle_texts(words: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves."""
    n = F.size(words)
    made = F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + k) for k in range(1, width)]))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.slice(made, 1, F.greatest(n - (width - 1), F.lit(1)))))


def extra(upper: Column) -> Column:
    """Signature places beyond those that may be missing, so that one shared passage makes no candidate of a large item."""
    return F.floor(upper / 16) + 1


def signatures(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """(item row, size partition, shingle hash, hits needed): the smallest hashes of each item, as many as its partition asks."""
    percent = round(contained * 100)
    q = F.size("_set")
    upper = F.pow(F.lit(2), F.ceil(F.log2(q))).cast("long")  # of the partition (upper/2, upper]
    missing = lambda n: n - F.floor((n * percent + 99) / 100)
    k = F.least(missing(F.col("_part")) + extra(F.col("_part")), q).cast("int")
    sets = items.withColumn("_set", F.array_sort(F.array_distinct(shingle_hashes(F.col("_iw"))))).where(q > 0).withColumn("_part", upper)
    return sets.select("_item", "_part", (k - missing(q)).cast("int").alias("_need"), F.explode(F.slice("_set", 1, k)).alias("_h"))


def find_contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """Pairs of a document and an item whose share of shingles in the document is at least ``contained``.

    Columns: doc_id, item_id, n_item_shingles, n_shared (long), containment (double).
    """
    percent = round(contained * 100)
    wordy = materialize(items.select(F.monotonically_increasing_id().alias("_item"), items[item_id].alias("_item_id"), words_of(items[item_text]).alias("_iw")))
    sought = materialize(signatures(wordy, contained))
    rows = docs.select(docs[doc_id].alias("_doc"), docs[text].alias("_text"))
    # the bound of each size partition, a few rows; the widest is that of the documents' signatures
    bounds = {r["_part"]: r["_most"] for r in sought.groupBy("_part").agg(F.max("_h").alias("_most")).collect()}
    keyed = rows.select("_doc", words_of(F.col("_text")).alias("_w")).select("_doc", shingle_hashes(F.col("_w")).alias("_s"))
    most = F.lit(max(bounds.values(), default=None)).cast("long")
    seen = keyed.select("_doc", F.explode(F.array_distinct(F.filter("_s", lambda h: h <= most))).alias("_h"))
    met = seen.join(small(sought, MAX_BROADCAST_ROWS), "_h").groupBy("_doc", "_item", "_need").agg(F.count(F.lit(1)).alias("_hits"))
    pairs = materialize(met.where(F.col("_hits") >= F.col("_need")).select("_doc", "_item"))
    texts = materialize(rows.join(small(pairs.select(F.col("_doc").alias("_d")).distinct(), MAX_BROADCAST_ROWS), F.col("_doc").eqNullSafe(F.col("_d")), "left_semi"))
    # words are a column of their own: inside a lambda an expression would be evaluated again for each word
    sets = texts.select("_doc", words_of(F.col("_text")).alias("_w")).select("_doc", shingle_texts(F.col("_w")).alias("_ds"))
    asked = materialize(wordy.select("_item", "_item_id", shingle_texts(F.col("_iw")).alias("_is")))
    # the sets are made before the join repeats a document for its items
    both = sets.join(pairs.withColumnRenamed("_doc", "_d"), F.col("_doc").eqNullSafe(F.col("_d"))).join(small(asked, 20_000, F.length(F.array_join("_is", " "))), "_item")
    shared = F.size(F.array_intersect("_is", "_ds")).cast("long")
    found = both.select(F.col("_doc").alias(doc_id), F.col("_item_id").alias(item_id), F.size("_is").cast("long").alias("n_item_shingles"), shared.alias("n_shared"))
    return found.where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent).withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
