"""Benchmark decontamination by pigeonhole edit matching over words (operator 10).

A benchmark item of m words may occur with up to k = m * errors words changed, inserted or deleted. Cut into k + 1 pieces,
at least one piece of such an occurrence is unchanged. Pieces are found exactly, by hashes of their first words; each hit
is verified by Myers' bit-parallel edit distance between the item and the words around the hit.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, as_bytes, chain, row_key, without_rows

#: bytes.translate table: A-Z lower-cased, ASCII other than letters and digits to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Words of a piece that its hash covers, and bytes of items that one pass over the documents looks for.
ANCHOR = 4
BLOCK_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, lower-cased (A-Z)."""
    return text.translate(WORD_BYTES).split()


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    """(start, end) of errors + 1 consecutive pieces of n words, of nearly equal lengths."""
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def myers(pattern: list, text: list) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of text, end of the first such stretch)."""
    m, full, top = len(pattern), (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    masks: dict = defaultdict(int)
    for i, x in enumerate(pattern):
        masks[x] |= 1 << i
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, x in enumerate(text):
        eq = masks.get(x, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best[0]:
            best = (score, j + 1)
    return best


class Index:
    """Pieces of a block of benchmark items, by the hash of their first words; items are known by their places in the block."""

    def __init__(self, items: list[bytes], errors: float):
        memo, entries = WordIds(), []
        self.items = {}
        for item, text in enumerate(items):
            found = words_of(text)
            if not found:
                continue
            ids, budget = memo.of(found), int(len(found) * errors + 1e-9)
            self.items[item] = (ids, budget)
            for s, e in pieces(len(ids), budget):
                size = min(ANCHOR, e - s)
                entries.append((size, int(chain(ids[s : s + size], size)[0]), item, s, e))
        self.tables = {}
        for size in sorted({x[0] for x in entries}):
            hits = defaultdict(list)
            for _, key, item, s, e in (x for x in entries if x[0] == size):
                hits[key].append((item, s, e))
            self.tables[size] = (np.array(sorted(hits), np.uint64), dict(hits))

    def matches(self, ids: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Least (distance, start, end) found for each item in a text of word ids."""
        found: dict[int, tuple[int, int, int]] = {}
        for size, (keys, hits) in self.tables.items():
            grams = chain(ids, size)
            if not len(grams):
                continue
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            for p in np.flatnonzero(keys[at] == grams):
                for item, s, e in hits[int(grams[p])]:
                    if item in found and found[item][0] == 0:
                        continue
                    own, budget = self.items[item]
                    if p + e - s > len(ids) or (ids[p : p + e - s] != own[s:e]).any():
                        continue
                    low = max(0, int(p) - s - budget)
                    window = ids[low : int(p) - s + len(own) + budget]
                    distance, end = myers(own.tolist(), window.tolist())
                    if distance <= budget and (item not in found or distance < found[item][0]):
                        start = low + end - myers(own[::-1].tolist(), window[:end][::-1].tolist())[1]
                        found[item] = (distance, start, low + end)
        return found


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, errors: float = 0.1) -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word) of each benchmark item that a whole text holds.

    An item (item_id, text) of m words is held where a stretch of the text is at most ``errors`` * m word edits away; words
    are lower-cased and punctuation is ignored. One row for each document row and item, of the least distance found from
    its unchanged pieces. Items of fewer than 1 / ``errors`` words must stand unchanged. Items are told apart by item_id and text:
    another text of the same item_id, or an item without one (reported with a null item_id), is an item of its own; repeated
    items count once. Items without words and null texts match nothing; rows without doc_id keep a null doc_id; repeated
    documents give repeated rows. The benchmark goes to the executors in blocks of about ``BLOCK_BYTES`` bytes of text, one
    pass over the documents for each. Empty tables give no rows.
    """
    return _hits(docs, benchmark, errors).drop("k1", "k2")


def _hits(docs: DataFrame, benchmark: DataFrame, errors: float) -> DataFrame:
    schema = "doc_id bigint, k1 bigint, k2 int, item_id bigint, distance int, first_word bigint, end_word bigint"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    items = benchmark.where("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        # a block is bounded: one job brings it, where an iterator would take one for each partition
        rows = sorted(((r["item_id"], r["text"].encode()) for r in part.collect()), key=lambda x: (x[0] is not None, x))
        index = docs.sparkSession.sparkContext.broadcast(([item for item, _ in rows], Index([text for _, text in rows], errors)))

        def scan(batches, index=index):
            memo, (names, own_index) = WordIds(), index.value
            for batch in batches:
                rows = []
                for *own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2")), as_bytes(batch.column("text"))):
                    for item, (distance, start, end) in sorted(own_index.matches(memo.of(words_of(text))).items()):
                        rows.append((*own, names[item], distance, start, end))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in schema.split(", ")])

        found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row_key(docs), "text").mapInArrow(scan, schema)
        out = found if out is None else out.union(found)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, errors: float = 0.1) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; rows without doc_id are known by their texts."""
    return without_rows(docs, _hits(docs, benchmark, errors).select("doc_id", "k1", "k2").distinct())
