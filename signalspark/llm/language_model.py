"""Language-model scores from a log-frequency Bloom filter of word pairs and triples (operator 3).

A pair or triple that occurs c times is inserted with each of the levels 1 .. 1 + floor(log2 c): those seen once take one
insertion, frequent ones few more. A query probes level 1, 2, ... until one is missing; the last level present gives the
count, rounded down to a power of two, g. The sum G of a history's g is kept exactly: of words beside their counts, of
pairs as the binary digits of G, one insertion each (a pair seen once has G = 1 and needs none). So the probabilities

    P(w | v) = (g(v, w) + PAIR * P(w)) / (G(v) + PAIR),  P(w | u, v) = (g(u, v, w) + TRIPLE * P(w | v)) / (G(u, v) + TRIPLE)

sum to one over all words and the unknown one, but for the filter's false positives. P(w) is smoothed over all tokens.

Counts are gathered by shuffle into segments by hash; a pair and the triples that begin with it share a segment. Segments
small enough for ``most_bytes`` in all are sent to every worker as one filter. Beyond it, documents are packed into blocks
of bounded size; each block asks every segment once for its distinct words, pairs and triples, segments answer as rows stream
by, and blocks are scored from the answers, with the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordIds, as_bytes, drop, mix, remainder, shuffle_parts, table

#: Ids of the end and the start of a text; no word has them, as words hold no white space.
END, START = WordIds()[b" end"], WordIds()[b" start"]
#: Weights of the shorter histories, in counts.
PAIR, TRIPLE = 100.0, 2.0
BITS_PER_ENTRY, PROBES, TOP_LEVEL = 12, 6, 41
STEP, DIGIT = 0xD6E8FEB86659FD93, np.uint64(0x5851F42D4C957F2D)
#: Tokens whose counts a task holds before it passes them on, tokens of a block, keys looked up in a filter at once.
FLUSH, BLOCK, SLICE = 2_000_000, 250_000, 1 << 16
WORD = np.uint64(0xFFFFFFFF)


def token_ids(text: bytes, memo: WordIds) -> np.ndarray:
    """Ids of the words of a lower-cased (A-Z) text and its end."""
    words = text.translate(ASCII_LOWER).split()
    return memo.of([*words, b" end"])


def key_of(history: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Keys of ids after a history (a word's id or a pair's key)."""
    return mix(mix(history * np.uint64(0x9E3779B97F4A7C15) + (ids & WORD)))


class Tokens:
    """Texts laid end to end: ids, the word before each, pair keys, and (of order 3) triple keys of all but first tokens."""

    def __init__(self, texts: list[np.ndarray], order: int):
        self.length = np.array([len(x) for x in texts])
        self.starts = np.cumsum(self.length) - self.length
        self.ids = np.concatenate(texts)
        self.before = np.concatenate([[np.uint64(START)], self.ids[:-1]])
        self.before[self.starts] = START
        self.pairs = key_of(self.before, self.ids)
        self.later = np.full(len(self.ids), order > 2)
        self.later[self.starts] = False
        self.past = self.pairs[np.flatnonzero(self.later) - 1]  # the pair before each token that isn't first
        self.triples = key_of(self.past, self.ids[self.later])


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) of a count; 0 of what doesn't occur."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1)) + 1e-12), 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(levels > 0, 2 ** np.maximum(levels - 1, 0), 0)


def digits_of(keys: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, level) of the binary digits of each total, one for each digit that is set: digit i has level i + 1."""
    found = [(keys[(totals >> i) & 1 == 1] ^ DIGIT, i + 1) for i in range(int(totals.max(initial=0)).bit_length())]
    return np.concatenate([k for k, _ in found] or [np.empty(0, np.uint64)]), np.concatenate([np.full(len(k), i) for k, i in found] or [np.empty(0, np.int64)])


def build(keys: np.ndarray, levels: np.ndarray, single: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Bits of a filter that holds each key at its levels 1 .. level, and the (key, level) of ``single`` at that level."""
    more, at = single if single is not None else (np.empty(0, np.uint64), np.empty(0, np.int64))
    size = 8 * (1 + (int(levels.sum()) + len(more)) * BITS_PER_ENTRY // 8)
    bits = np.zeros(size, bool)
    for level in range(1, 1 + max(int(levels.max(initial=0)), int(at.max(initial=0)))):
        for place in _places(np.concatenate([keys[levels >= level], more[at == level]]), level, size):
            bits[place] = True
    return np.packbits(bits)


def _places(keys: np.ndarray, level: int, size: int):
    """Bit places of keys at a level, one array for each probe."""
    first = mix(keys + np.uint64(level * STEP & (1 << 64) - 1))
    stride = (first >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (first + np.uint64(k) * stride) % np.uint64(size)


def held(bits: np.ndarray, base: np.ndarray, size: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    """Positions of the keys that the filter holds at a level, in segments of ``size`` bits that begin at byte ``base``."""
    left = np.arange(len(keys))
    first = mix(keys + np.uint64(level * STEP & (1 << 64) - 1))
    for k in range(PROBES):
        place = (first + np.uint64(k) * ((first >> np.uint64(32)) | np.uint64(1))) % size[left]
        kept = ((bits[base[left] + (place >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)
        left, first = left[kept], first[kept]
    return left


def probe(bits: np.ndarray, base: np.ndarray, size: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Level of each key."""
    levels = np.zeros(len(keys), np.int64)
    for start in range(0, len(keys), SLICE):  # bounds the arrays of a pass
        left = np.arange(start, min(len(keys), start + SLICE))
        for level in range(1, TOP_LEVEL):
            left = left[held(bits, base[left], size[left], keys[left], level)]
            if not len(left):
                break
            levels[left] = level
    return levels


def probe_total(bits: np.ndarray, base: np.ndarray, size: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The sum G of each pair key, which is below 2 ** level; 1 for pairs seen once."""
    total = (levels == 1).astype(np.int64)
    for start in range(0, len(keys), SLICE):
        at = start + np.flatnonzero(levels[start : start + SLICE] > 1)
        for digit in range(int(levels[at].max(initial=0))):
            some = at[levels[at] > digit]
            total[some[held(bits, base[some], size[some], keys[some] ^ DIGIT, digit + 1)]] += 1 << digit
    return total


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and the position of one row of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts, order[first]


def _packed(buckets: int, kind: int, keys: np.ndarray, *more: np.ndarray, by: np.ndarray | None = None) -> list[tuple]:
    """(bucket, kind, keys, ...) of arrays, cut by the bucket of ``by`` (the keys)."""
    bucket = bucket_of(keys if by is None else by, buckets)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    arrays = [x[order] for x in (keys, *more)]
    return [(b, kind, *(x[s:e].tobytes() for x in arrays)) for b, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
PACKED_SQL = "bucket int, kind int, keys binary, ids binary, counts binary"
SEGMENT = pa.schema([("bucket", pa.int32()), ("n_tokens", pa.int64()), ("n_types", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("totals", pa.binary()), ("bits", pa.binary())])
SEGMENT_SQL = "bucket int, n_tokens bigint, n_types bigint, words binary, counts binary, totals binary, bits binary"


def segments(train: DataFrame, order: int) -> DataFrame:
    """One row for each bucket of hashes: its exact word counts and sums G, and its filter of pairs and triples.

    Counts pass two shuffles: words, pairs (by their own hash) and triples (by that of their first two words) first, then the
    words with the partial sums G that each bucket of pairs has for them.
    """
    buckets = shuffle_parts(train.sparkSession)

    def gather(batches):
        memo, some, n = WordIds(), [], 0

        def flush():
            t = Tokens(some, order)
            some.clear()
            words, counts = np.unique(t.ids, return_counts=True)
            rows = _packed(buckets, 0, words, np.zeros(len(words), np.uint32), counts)
            _, at, counts = np.unique(t.pairs, return_index=True, return_counts=True)
            rows += _packed(buckets, 1, t.before[at], (t.ids[at] & WORD).astype(np.uint32), counts, by=t.pairs[at])
            _, at, counts = np.unique(t.triples, return_index=True, return_counts=True)
            return _rows(PACKED, rows + _packed(buckets, 2, t.past[at], (t.ids[t.later][at] & WORD).astype(np.uint32), counts))

        for batch in batches:
            for text in as_bytes(batch.column("text")):
                some.append(token_ids(text, memo))
                n += len(some[-1])
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    def collected(batches) -> dict[int, dict[int, list]]:
        found: dict[int, dict[int, list]] = {}
        for batch in batches:
            for bucket, kind, *arrays in zip(*(batch.column(c) for c in PACKED.names)):
                kinds = (np.uint64, np.uint32, np.int64)
                found.setdefault(bucket.as_py(), {}).setdefault(kind.as_py(), []).append([np.frombuffer(a.as_buffer(), k) for a, k in zip(arrays, kinds)])
        return found

    def joined(parts: list | None) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)]

    def merge(batches):
        found = collected(batches)
        for bucket in sorted(found):
            own = found.pop(bucket)
            before, ids, counts = joined(own.pop(1, None))
            pairs, times, at = _summed(key_of(before, ids.astype(np.uint64)), counts)
            level = level_of(times)
            history, sums, _ = _summed(before[at], count_of(level))
            past, ids, counts = joined(own.pop(2, None))
            triples, many, at = _summed(key_of(past, ids.astype(np.uint64)), counts)
            heads, totals, _ = _summed(past[at], count_of(level_of(many)))
            often = np.isin(heads, pairs[level > 1])  # others have G = 1
            bits = build(np.concatenate([pairs, triples]), np.concatenate([level, level_of(many)]), digits_of(heads[often], totals[often]))
            rows = [(bucket, 4, b"", b"", bits.tobytes())]
            rows += [(b, 3, *rest) for b, _, *rest in _packed(buckets, 3, history, np.zeros(len(history), np.uint32), sums)]
            rows += [(bucket, 0, *(x.tobytes() for x in part)) for part in own.get(0, [])]
            yield _rows(PACKED, rows)

    def finish(batches):
        found: dict[int, dict[int, list]] = {}
        for batch in batches:
            for bucket, kind, keys, _, counts in zip(*(batch.column(c).to_pylist() for c in PACKED.names)):
                found.setdefault(bucket, {}).setdefault(kind, []).append(counts if kind == 4 else (np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
        for bucket in sorted(found):
            own = found.pop(bucket)
            (words, counts, _), (history, sums, _) = (_summed(*(np.concatenate(x) for x in zip(*own.get(kind, [(np.empty(0, np.uint64), np.empty(0, np.int64))])))) for kind in (0, 3))
            names = np.union1d(words, history)  # START is a history and no word
            n, g = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)  # counts of words reach beyond 32 bits
            n[np.searchsorted(names, words)], g[np.searchsorted(names, history)] = counts, sums
            yield _rows(SEGMENT, [(bucket, int(counts.sum()), len(words), names.tobytes(), n.tobytes(), g.tobytes(), b"".join(own.get(4, [])))])

    packed = train.select("text").mapInArrow(gather, PACKED_SQL).repartition(buckets, "bucket").mapInArrow(merge, PACKED_SQL)
    return table(packed.repartition(buckets, "bucket").mapInArrow(finish, SEGMENT_SQL), "segments")


class Model:
    """Segments, in one worker's memory."""

    def __init__(self, rows: list, buckets: int):
        rows = sorted(rows, key=lambda r: r["bucket"])
        words, counts, totals = (np.concatenate([np.frombuffer(r[c], kind) for r in rows] or [np.empty(0, kind)]) for c, kind in (("words", np.uint64), ("counts", np.int64), ("totals", np.int64)))
        order = np.argsort(words)
        self.words, self.counts, self.totals = words[order], counts[order], totals[order]
        self.bits = np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in rows] + [np.zeros(1, np.uint8)])
        sizes = np.zeros(buckets, np.int64)
        for r in rows:
            sizes[r["bucket"]] = len(r["bits"])
        self.size = np.maximum(1, sizes * 8).astype(np.uint64)
        self.base = np.minimum(np.concatenate([[0], np.cumsum(sizes)[:-1]]), len(self.bits) - 1)
        self.buckets = buckets

    def of_words(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums G of words."""
        if not len(self.words):
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        order = np.argsort(ids)
        at = np.searchsorted(self.words, ids[order])
        at[at == len(self.words)] = 0
        known, out = self.words[at] == ids[order], np.empty((2, len(ids)), np.int64)
        out[:, order] = np.where(known, self.counts[at], 0), np.where(known, self.totals[at], 0)
        return out[0], out[1]

    def levels(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Levels of pairs or triples, in the buckets of the pair keys ``place``."""
        bucket = bucket_of(place, self.buckets)
        return probe(self.bits, self.base[bucket], self.size[bucket], keys)

    def sums(self, pairs: np.ndarray, levels: np.ndarray) -> np.ndarray:
        bucket = bucket_of(pairs, self.buckets)
        return probe_total(self.bits, self.base[bucket], self.size[bucket], pairs, levels)

    def known(self, t: Tokens) -> tuple[np.ndarray, ...]:
        """What ``log_scores`` needs of each token."""
        own, sums = self.of_words(t.ids)
        before = np.concatenate([[0], sums[:-1]])
        before[t.starts] = self.of_words(np.array([START], np.uint64))[1]
        pair = self.levels(t.pairs, t.pairs)
        at = np.flatnonzero(t.later)
        seen = np.flatnonzero(pair[at - 1] > 0)  # of what follows an unknown pair nothing is known
        total, triple = np.zeros(len(t.ids), np.int64), np.zeros(len(t.ids), np.int64)
        total[at[seen]] = self.sums(t.past[seen], pair[at[seen] - 1])
        triple[at[seen]] = self.levels(t.triples[seen], t.past[seen])
        return own, before, pair, total, triple


def log_scores(own, before, pair, total, triple, n: int, types: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token by the base and by the model: from its count, the sum G of the word before, the level
    of the pair, the sum G of the pair before, and the level of the triple."""
    single = (own + 0.5) / (n + 0.5 * (types + 1))
    two = (np.where(before > 0, count_of(pair), 0) + PAIR * single) / (before + PAIR)
    three = (np.where(total > 0, count_of(triple), 0) + TRIPLE * two) / (total + TRIPLE)
    return np.log10(single), np.log10(three)


OUT = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _texts(batches, some_tokens: int, order: int):
    """(rows, Tokens) of documents, as many at a time as reach ``some_tokens``; a row is what stands before the text."""
    memo = WordIds()
    for batch in batches:
        texts, got = as_bytes(batch.column("text")), 0
        while got < len(texts):
            some, size, first = [], 0, got
            while got < len(texts) and size < some_tokens:
                some.append(token_ids(texts[got], memo))
                size += len(some[-1])
                got += 1
            yield batch.column("doc_id").slice(first, len(some)), Tokens(some, order)


def _scored(ids: pa.Array, t: Tokens, known: tuple, n: int, types: int) -> pa.RecordBatch:
    base, score = log_scores(*known, n, types)
    sums = [np.add.reduceat(x, t.starts) for x in ((known[0] > 0).astype(np.int64), base, score)]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, (t.length.astype(np.int64), *sums))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _here(docs: DataFrame, model, n: int, types: int, order: int) -> DataFrame:
    """Scores of ``docs`` with the whole model on every worker."""

    def run(batches):
        for ids, t in _texts(batches, BLOCK, order):
            yield _scored(ids, t, model.value.known(t), n, types)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


BLOCKS = pa.schema([("block", pa.string()), ("docs", pa.binary()), ("named", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])
ASKED = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("past", pa.binary()), ("triples", pa.binary())])
ASKED_SQL = "block string, bucket int, words binary, pairs binary, past binary, triples binary"


def wanted(t: Tokens) -> tuple[np.ndarray, ...]:
    """Distinct words, pairs and triples (with the pair before) that a block asks for, each in order."""
    triples, at = np.unique(t.triples, return_index=True)
    return np.unique(np.append(t.ids, np.uint64(START))), np.unique(t.pairs), t.past[at], triples


def _there(docs: DataFrame, parts: DataFrame, n: int, types: int, order: int) -> DataFrame:
    """The same scores by questions of blocks to segments; a task holds one segment or one block and its answers."""
    import uuid

    buckets = shuffle_parts(docs.sparkSession)

    def pack(batches):
        for ids, t in _texts(batches, BLOCK, order):
            names = np.array([0 if d is None else d for d in ids.to_pylist()], np.int64)
            yield _rows(BLOCKS, [(uuid.uuid4().hex, names.tobytes(), (np.array(ids.is_valid())).tobytes(), t.length.astype(np.int64).tobytes(), t.ids.tobytes())])

    def unpacked(lengths: bytes, ids: bytes) -> Tokens:
        ends = np.cumsum(np.frombuffer(lengths, np.int64))
        return Tokens(np.split(np.frombuffer(ids, np.uint64), ends[:-1]), order)

    def ask(batches):
        for batch in batches:
            for block, lengths, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "lengths", "ids"))):
                words, pairs, past, triples = wanted(unpacked(lengths, ids))
                where = [bucket_of(x, buckets) for x in (words, pairs, past)]
                for b in np.unique(np.concatenate(where)):
                    w, p, h = (np.flatnonzero(x == b) for x in where)
                    yield _rows(ASKED, [(block, int(b), words[w].tobytes(), pairs[p].tobytes(), past[h].tobytes(), triples[h].tobytes())])

    answer_sql = "block string, bucket int, counts binary, totals binary, levels binary, sums binary, triples binary"
    answer_schema = pa.schema([("block", pa.string()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("counts", "totals", "levels", "sums", "triples")])

    def answer(batches):  # in each bucket its segment comes first
        model, at = None, None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in batch.schema.names)):
                r = dict(zip(batch.schema.names, row))
                bucket = r["bucket"].as_py()
                if r["block"].as_py() is None:
                    model, at = Model([{"bucket": 0, **{c: r[c].as_py() for c in ("words", "counts", "totals", "bits")}}], 1), bucket
                    continue
                words, pairs, past, triples = (np.frombuffer(r[c].as_buffer(), np.uint64) for c in ("words", "pairs", "past", "triples"))
                m = model if at == bucket else Model([], 1)
                counts, totals = m.of_words(words)
                levels = m.levels(pairs, pairs)
                found = counts, totals, levels.astype(np.int8), m.sums(pairs, levels), m.levels(triples, past).astype(np.int8)
                yield _rows(answer_schema, [(r["block"].as_py(), bucket, *(x.tobytes() for x in found))])

    def score(batches):  # of each block its texts come first, then the answers
        held: list = []

        def flush():
            first, rest = held[0], held[1:]
            t = unpacked(first["lengths"], first["ids"])
            words, pairs, past, triples = wanted(t)
            where = [bucket_of(x, buckets) for x in (words, pairs, past)]
            got = [np.zeros(len(x), np.int64) for x in (words, words, pairs, pairs, triples)]
            for r in rest:
                w, p, h = (np.flatnonzero(x == r["bucket"]) for x in where)
                for out, at, c, kind in zip(got, (w, w, p, p, h), ("counts", "totals", "levels", "sums", "triples"), (np.int64, np.int64, np.int8, np.int64, np.int8)):
                    out[at] = np.frombuffer(r[c], kind)
            word, pair = np.searchsorted(words, t.ids), np.searchsorted(pairs, t.pairs)
            before = got[1][np.searchsorted(words, t.before)]
            total, triple, later = np.zeros(len(t.ids), np.int64), np.zeros(len(t.ids), np.int64), np.flatnonzero(t.later)
            seen = got[2][pair[later - 1]] > 0
            total[later] = np.where(seen, got[3][pair[later - 1]], 0)
            triple[later] = np.where(seen, got[4][np.searchsorted(triples, t.triples)], 0)
            named = np.frombuffer(first["named"], bool)
            ids = pa.array(np.frombuffer(first["docs"], np.int64), mask=~named)
            return _scored(ids, t, (got[0][word], before, got[2][pair], total, triple), n, types)

        for batch in batches:
            for r in batch.to_pylist():
                if held and r["block"] != held[0]["block"]:
                    yield flush()
                    held = []
                held.append(r)
        if held:
            yield flush()

    blocks = table(docs.select("doc_id", "text").mapInArrow(pack, "block string, docs binary, named binary, lengths binary, ids binary"), "blocks")
    nothing = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    asked = blocks.mapInArrow(ask, ASKED_SQL).select("block", "bucket", "words", *nothing("counts", "totals", "bits"), "pairs", "past", "triples")
    filters = parts.select(F.lit(None).cast("string").alias("block"), "bucket", "words", "counts", "totals", "bits", *nothing("pairs", "past", "triples"))
    both = filters.union(asked).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("block").asc_nulls_first())
    answers = both.mapInArrow(answer, answer_sql)
    whole = blocks.select("block", F.lit(-1).alias("bucket"), *nothing("counts", "totals", "levels", "sums", "triples"), "docs", "named", "lengths", "ids")
    answered = answers.select("*", *nothing("docs", "named", "lengths", "ids"))
    return whole.union(answered).repartition(buckets, "block").sortWithinPartitions("block", "bucket").mapInArrow(score, OUT)


def lm_scores(docs: DataFrame, most_bytes: int = 192_000_000, order: int = 2) -> DataFrame:
    """One row for each document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model learns from rows whose crc32(doc_id) mod 5 isn't 1 (a null doc_id isn't held out). Null and empty texts have
    one token, the end. Repeated rows count as often as they occur and give repeated rows; other columns are ignored; an
    empty table gives no rows. ``most_bytes`` bounds what is sent to every worker; ``order`` is 2 (pairs) or 3 (and triples).
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False))
    parts = segments(docs.where(~held_out), order)
    size = F.sum(F.octet_length("words") + F.octet_length("counts") + F.octet_length("totals") + F.octet_length("bits"))
    n, types, total = parts.agg(*(F.coalesce(x, F.lit(0)) for x in (F.sum("n_tokens"), F.sum("n_types"), size))).first()
    if total <= most_bytes:
        model = Model(list(parts.toLocalIterator()), shuffle_parts(docs.sparkSession))
        out = _here(docs, docs.sparkSession.sparkContext.broadcast(model), n, types, order)
        drop(parts)
    else:
        out = _there(docs, parts, n, types, order)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
