"""Fill-in-the-middle transformation with succinct rank and select (operator 11).

Where tokens start in a text is a bitvector over its bytes, packed into words of 64 bits, with the number of ones before each
block in a directory. The total gives the number n of tokens, and select on the two drawn ranks gives the bytes where the text
is cut; a second bitvector, of the bytes that start characters, gives the lengths in characters by rank. No list of tokens
is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, row_schema, rows_kept

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those that stay plain come last, and of 100 others those of the form spm come first (fixed values).
PLAIN_FROM, SPM_BELOW = 90, 20
#: Words of 64 bits in a block of the directory, and bytes of texts whose bitvectors are built together.
BLOCK, PIECE = 8, 4 << 20

LETTER = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
#: Position of the k-th one in a byte (rows: bytes), and the ones of a byte.
PLACES = np.array([[p for p in range(8) if b >> p & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)], np.int64)
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class Bits:
    """Rank and select over a packed bitvector with a directory of blocks."""

    def __init__(self, flags: np.ndarray):
        packed = np.packbits(flags, bitorder="little")
        self.bytes = np.zeros(-(-len(packed) // (8 * BLOCK)) * 8 * BLOCK + 8 * BLOCK, np.uint8)  # whole blocks, and one more
        self.bytes[: len(packed)] = packed
        self.words = self.bytes.view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, BLOCK).astype(np.int64)
        self.blocks = np.concatenate([[0], np.cumsum(counts.sum(1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the positions ``at``."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        out = self.blocks[word // BLOCK]
        first = word // BLOCK * BLOCK
        for k in range(BLOCK - 1):
            out = out + np.where(first + k < word, np.bitwise_count(self.words[first + k]), 0)
        return out + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the ones that have ``k`` ones before them."""
        block = np.searchsorted(self.blocks, k, "right") - 1
        left, at = k - self.blocks[block], block * BLOCK
        for step in (BLOCK // 2, BLOCK // 4, BLOCK // 8):  # halves of what is left of the block
            ones = sum(np.bitwise_count(self.words[at + j]).astype(np.int64) for j in range(step))
            at, left = np.where(left >= ones, at + step, at), np.where(left >= ones, left - ones, left)
        at = at * 8
        for step in (4, 2, 1):  # bytes of the word
            ones = sum(ONES[self.bytes[at + j]] for j in range(step))
            at, left = np.where(left >= ones, at + step, at), np.where(left >= ones, left - ones, left)
        return at * 8 + PLACES[self.bytes[at], left]


def draws(key: bytes) -> list[int]:
    """h1 to h4 of a row: the first four groups of 8 hexadecimal digits of sha256 of ``1:`` and the decimal doc_id."""
    digest = hashlib.sha256(b"1:" + key).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def form_of(text: bytes, h: list[int]) -> str:
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= PLAIN_FROM:
        return "plain"
    return "spm" if h[3] % 100 < SPM_BELOW else "psm"


def restored(output: bytes, form: str) -> bytes:
    """The text, from an output and its form only. No text of these forms holds a mark, so the first one found is the mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transformed(keys: list[bytes], texts: list[bytes]) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    character = (flat & 0xC0) != 0x80
    letter = LETTER[flat]
    token = character.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    token[starts[starts < ends]] = True  # a text's first letter doesn't continue the text before
    tokens, characters = Bits(token), Bits(character)
    base = tokens.rank(starts)
    n = tokens.rank(ends) - base
    h = [draws(k) for k in keys]
    ranks = np.sort(np.array([x[:2] for x in h], np.int64).reshape(-1, 2) % (n[:, None] + 1), axis=1)
    cuts = np.where(ranks < n[:, None], tokens.select(np.minimum(base[:, None] + ranks, max(0, int(tokens.blocks[-1]) - 1))), ends[:, None]) if len(flat) else np.zeros((len(texts), 2), np.int64)
    lengths = np.diff(np.stack([characters.rank(starts), characters.rank(cuts[:, 0]), characters.rank(cuts[:, 1])], 1), axis=1)
    out = []
    for k, text in enumerate(texts):
        form = form_of(text, h[k])
        if form == "plain":
            out.append((int(n[k]), form, None, None, text))
            continue
        a, b = (cuts[k] - starts[k]).tolist()
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        parts = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
        out.append((int(n[k]), form, int(lengths[k, 0]), int(lengths[k, 1]), b"".join(parts)))
    return out


def fill_in_middle(docs: DataFrame, keep: bool = False, digests: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text), texts whole.

    A text has n tokens: runs of A-Z and a-z, and every other character. Its prefix ends after the lesser of two drawn numbers of
    tokens, its middle after the greater; the draws depend on doc_id alone, so reruns agree. Forms: ``plain`` (the text itself; for
    empty texts, texts with one of the marks, and a tenth of the others), ``psm`` and ``spm``. The lengths of prefix and middle
    are in characters, null if plain. Null texts count as empty; a null doc_id draws as an empty one; repeated rows come out
    alike; an empty table gives no rows. Other columns are ignored, or come along as struct ``row`` with ``keep``. With ``digests``,
    output_sha256 and restored_sha256 take the place of output: of the output, and of the text rebuilt from output and form.
    """
    results = "output_sha256 string, restored_sha256 string" if digests else "output string"
    schema = f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, {results}{row_schema(docs, keep)}"
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def scan(batches):
        for batch in batches:
            ids, texts, start = batch.column("doc_id"), as_bytes(batch.column("text")), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= PIECE):
                    size += len(texts[end])
                    end += 1
                own = ids.slice(start, end - start)
                found = transformed([b"" if x is None else str(x).encode() for x in own.to_pylist()], texts[start:end])
                n, form, prefix, middle, output = zip(*found)
                last = [pa.array([sha(x) for x in output]), pa.array([sha(restored(x, f)) for x, f in zip(output, form)])] if digests else [pa.array(output, pa.binary()).cast(pa.string())]
                columns = [own, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *last]
                yield pa.RecordBatch.from_arrays(columns + ([batch.column("row").slice(start, end - start)] if keep else []), NAMES[digests] + (["row"] if keep else []))
                start = end

    return rows_kept(docs, keep).withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(scan, schema)


NAMES = {False: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], True: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]}

#: DuckDB twin of the query.
MIDDLES_SQL = """with t as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
w as (select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as w from t),
h as (select *, len(w) as n, ('0x' || substr(s, 1, 8))::bigint as h1, ('0x' || substr(s, 9, 8))::bigint as h2, ('0x' || substr(s, 17, 8))::bigint as h3, ('0x' || substr(s, 25, 8))::bigint as h4 from w),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(w[1:a], '') as x, array_to_string(w[a + 1:b], '') as y, array_to_string(w[b + 1:n], '') as z from c),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end as o from p)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(x) end::bigint as prefix_chars, case when form <> 'plain' then length(y) end::bigint as middle_chars, sha256(o) as output_sha256, sha256(t) as restored_sha256 from o"""
