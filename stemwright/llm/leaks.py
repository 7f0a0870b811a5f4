"""Held-out items inside a training corpus: MinHash containment search with exact verification.

A query is a passage: 13 successive words of an item, as a set of nine 5-word shingles. Documents are
split by size in the same way, into all their passages of that very size. With domains and queries of
one size the containment bound of a size partition is tight: a contained passage has Jaccard 1, one
MinHash value decides, and no leak can be missed. A bitmap of the items' MinHash values drops most
passages of the documents where they are read; those left meet the items on their MinHash value and are
verified by the hash of all their words in order in the same join, so a common shingle makes no candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemwright.llm.near_duplicates import _mix, shingle_hashes, word_hashes
from stemwright.session import cut

BITMAP = 1 << 27  # most bits of the filter


def passages(texts: list[str | None], words_in_passage: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minhash, hash of all words in order, text index) of all passages; texts with fewer words have none."""
    words, lengths = word_hashes(texts)
    code, doc = shingle_hashes(words, lengths, n)
    code = _mix(code ^ np.uint64(0xA5A5A5A55A5A5A5A))
    width = words_in_passage - n + 1
    if len(code) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    least, whole = code[: len(code) - width + 1].copy(), code[: len(code) - width + 1].copy()
    for i in range(1, width):
        part = code[i : len(code) - width + 1 + i]
        np.minimum(least, part, out=least)
        if i % n == 0 or i == width - 1:  # shingles that cover all words of the passage
            whole = _mix(whole * np.uint64(0xD6E8FEB86659FD93) + part)
    same = doc[: len(least)] == doc[width - 1 :]
    return least[same].view(np.int64), whole[same].view(np.int64), doc[: len(same)][same]


def passage_table(texts: DataFrame, words_in_passage: int, n: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """(id, minhash, whole) of rows (id long, text); with a bitmap only passages whose MinHash value is in it."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                least, whole, at = passages(batch.column("text").to_pylist(), words_in_passage, n)
                if bits is not None and len(least):
                    place = least.view(np.uint64) % np.uint64(64 * len(bits))
                    keep = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                    least, whole, at = least[keep], whole[keep], at[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(least), pa.array(whole)], names=["id", "minhash", "whole"])

    return texts.select("id", "text").filter("text is not null").mapInArrow(run, "id long, minhash long, whole long")


def leaked_items(docs: DataFrame, items: DataFrame, words_in_passage: int = 13, n: int = 5) -> DataFrame:
    """(doc_id, item_id, n_passages): pairs where the document holds a passage of the item word by word.

    docs, items: rows (id long unique, text). Texts with fewer words than a passage and NULL texts give nothing;
    copies of a document each give their rows. Two passages with equal 64-bit hashes of their words would count
    as one. n_passages counts the item's different leaked passages. The bitmap has 16 bits for each MinHash value
    of the items, BITMAP at most; a full one lets all passages through to the join.
    """
    held = cut(passage_table(items, words_in_passage, n).distinct(), "item-passages")
    count = held.select("minhash").distinct().count()
    bits = min(BITMAP, 1 << max(16, (16 * count).bit_length()))
    # Unsigned remainder of a power of two: its low bits.
    places = held.select(F.col("minhash").bitwiseAND(F.lit(bits - 1)).alias("p"))
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    for w, b in places.groupBy(F.expr("int(p div 64)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("b")).toLocalIterator():  # at most bits / 64 rows
        bitmap[w] = b
    found = passage_table(docs, words_in_passage, n, bitmap.view(np.uint64))
    met = found.withColumnRenamed("id", "doc_id").join(held.withColumnRenamed("id", "item_id"), ["minhash", "whole"])
    return met.groupBy("doc_id", "item_id").agg(F.count_distinct("whole").alias("n_passages"))
