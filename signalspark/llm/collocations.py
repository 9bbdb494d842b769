"""Phrase collocation mining by merged count-min sketches and an exact second pass (operator 12).

The first pass adds every run of one to four words to a count-min sketch, one a task; sketches are merged in Spark. Their cells
are bytes that stop at 255: only whether a count may reach 30 is asked of them. They overestimate, so the second pass, which
aggregates exactly what passes the merged sketch, loses nothing frequent. Scores and subsumption follow from the exact counts.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_A, as_bytes, mix, shuffle_parts, table
from .graph import hot_bound, joined

#: A mark that ends a piece: a byte that UTF-8 doesn't have.
END = b"\xff"
#: bytes.translate table: A-Z lower-cased, tabs to spaces, what separates pieces to the mark (fixed values).
PIECES = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Occurrences that a phrase needs, words of the longest phrase, rows of the report for each language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: Tokens that are counted together, bytes of a text that are split together, words whose ids are held.
STRETCH, PART, WORDS = 1 << 18, 1 << 20, 200_000
#: Rows of a batch that are taken out of it together.
SLICE = 64
#: Rows of a sketch, bytes of text for each cell of a row, least and most cells of a row, and cells that are merged together.
ROWS, BYTES_EACH, CELLS, SEGMENT = 2, 64, (1 << 12, 1 << 28), 1 << 18
#: Cells of a row up to which a task holds a sketch; beyond, it sends what it counted after each RUN of phrases, by cell. Cells that
#: are merged together then, and those of which the place is a number of 16 bits.
DENSE, RUN, WIDE, NEAR = 1 << 25, 1 << 22, 1 << 20, 1 << 16
#: Tasks of either pass at least, and bytes of text of one at most; between them there are two for each core, as what they send
#: grows with their number.
LEAST_TASKS, MOST_BYTES = 12, 2 << 30
#: First dealing of a language's phrases, so that no task ranks all of them.
DEALS = 256


class Ids(dict):
    """Numbers of words (bytes) in order of appearance, and their 64-bit hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self[word] = len(self)
        return len(self) - 1


def split(text: bytes, size: int):
    """(tokens, carried): words and marks of a whole text, in parts of about ``size`` bytes. Each part begins with the last
    tokens of the one before, ``carried`` of them, so that runs over the border are seen; they end in one part only."""
    text, start, last = text.translate(PIECES).replace(END, b" " + END + b" "), 0, []
    while start < len(text):
        stop = len(text)
        if stop - start > size:
            at = text.rfind(b" ", start, start + size)
            at = at if at > start else text.find(b" ", start + size)
            stop = at if at >= 0 else stop
        tokens = last + text[start:stop].split()
        yield tokens, len(last)
        start, last = stop, tokens[1 - LONGEST :]


class Stretch:
    """Tokens of several texts: words with their languages, and how many words of the piece come up to each."""

    def __init__(self, tokens: list[bytes], langs: list[str], lengths: list[int], carried: list[int], ids: Ids):
        self.tokens, self.names = tokens, sorted(set(langs))
        self.word = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        self.hash = np.frombuffer(ids.hashes, np.uint64)[self.word]
        number = {x: k for k, x in enumerate(self.names)}
        self.lang = np.repeat(np.array([number[x] for x in langs], np.int64), lengths)
        at = np.arange(len(tokens))
        mark = self.word == ids[END]
        self.since = at - np.maximum.accumulate(np.where(mark, at, -1))
        starts = np.cumsum(lengths) - lengths
        self.fresh = ~mark & (at - np.repeat(starts, lengths) >= np.repeat(carried, lengths))
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in self.names], np.uint64)
        self.seed = seeds[self.lang] if len(tokens) else np.empty(0, np.uint64)

    def keys(self):
        """For each order from 1: hashes of the runs that end at each token; what isn't such a run has a meaningless one."""
        own = mix(self.hash + self.seed)
        yield own
        for _ in range(1, LONGEST):
            own = mix(np.concatenate([own[:1], own[:-1]]) * MIX_A + self.hash)
            yield own


def stretches(batches):
    """``Stretch`` after ``Stretch`` of Arrow batches of (lang, text)."""
    ids, tokens, langs, lengths, carried = Ids(), [], [], [], []
    for batch in (b.slice(k, SLICE) for b in batches for k in range(0, len(b), SLICE)):  # few texts at a time as Python's
        for lang, text in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text"))):
            for own, n in split(text, PART):
                tokens += own
                tokens.append(END)
                langs.append(lang)
                lengths.append(len(own) + 1)
                carried.append(n)
                if len(tokens) >= STRETCH:
                    yield Stretch(tokens, langs, lengths, carried, ids)
                    tokens, langs, lengths, carried = [], [], [], []
                    ids = ids if len(ids) < WORDS else Ids()
    if tokens:
        yield Stretch(tokens, langs, lengths, carried, ids)


def cells_of(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """Cell of each key in each row; ``width`` is a power of two."""
    bits = width.bit_length() - 1
    return [(keys >> np.uint64(64 - bits)).astype(np.int64), (keys & np.uint64(width - 1)).astype(np.int64)]


def raised(cells: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    cells[at] = np.minimum(cells[at].astype(np.int64) + counts, 255)


def bits_of(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def width_of(size: int) -> int:
    """Cells of a row for ``size`` bytes of text, a power of two."""
    return 1 << (min(max(size // BYTES_EACH, CELLS[0]), CELLS[1]) - 1).bit_length()


def counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different cells in rising order, and how often each is there."""
    cells.sort()
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
    return cells[first], np.diff(np.append(first, len(cells)))


def run_of(at: np.ndarray, counts: np.ndarray, part: int) -> bytes:
    """Cells ``at`` (rising, below ``part``) with their counts: how many lie in each NEAR, the steps between them, the counts."""
    many = np.bincount(at // NEAR, minlength=-(-part // NEAR)).astype(np.uint32)
    steps = np.diff(at.astype(np.uint16), prepend=np.uint16(0))  # modulo 2**16
    return pa.Codec("zstd", 1).compress(np.uint32(len(at)).tobytes() + many.tobytes() + steps.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes(), asbytes=True)


def added(cells: np.ndarray, packed: bytes) -> None:
    """Add what ``run_of`` packed."""
    raw = pa.CompressedInputStream(pa.BufferReader(packed), "zstd").read()
    n, groups = int(np.frombuffer(raw, np.uint32, 1)[0]), -(-len(cells) // NEAR)
    low = np.cumsum(np.frombuffer(raw, np.uint16, n, 4 + 4 * groups), dtype=np.uint16)
    at = np.repeat(np.arange(groups) * NEAR, np.frombuffer(raw, np.uint32, groups, 4)) + low
    raised(cells, at, np.frombuffer(raw, np.uint8, n, 4 + 4 * groups + 2 * n))


def sketched(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """What the merged count-min sketch of all runs of up to LONGEST words says: ROWS x width bits, one for each cell that reached
    ``least``. Each task sends the segments of its own sketch, compressed; a segment's parts are added one after another, so a
    task holds its merged segments only. Of a sketch of more than DENSE cells a row no task holds its own, either: it sends the
    cells of one run of phrases after another, which are added likewise."""
    dense = width <= DENSE
    part = min(width, SEGMENT if dense else WIDE)
    schema = pa.schema([("segment", pa.int32()), ("cells", pa.binary())])
    parts = shuffle_parts(texts.sparkSession)

    def sent(segment: int, cells: np.ndarray) -> pa.RecordBatch:
        packed = pa.Codec("zstd", 1).compress(cells.tobytes(), asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], schema=schema)

    def count(batches):
        sketch = np.zeros((ROWS, width), np.uint8)
        for s in stretches(batches):
            found = [keys[s.fresh & (s.since >= n)] for n, keys in enumerate(s.keys(), 1)]
            for row, cells in enumerate(cells_of(np.concatenate(found), width)):
                raised(sketch[row], *counted(cells))
        for k, cells in enumerate(sketch.reshape(-1, part)):
            if cells.any():
                yield sent(k, cells)

    def run(found: list[np.ndarray]):
        keys = np.concatenate(found)
        for row, cells in enumerate(cells_of(keys, width)):
            cells, counts = counted(cells)
            starts = np.searchsorted(cells, np.arange(0, width + 1, part))
            filled = np.flatnonzero(np.diff(starts)).tolist()
            runs = [run_of(cells[starts[k] : starts[k + 1]] - k * part, counts[starts[k] : starts[k + 1]], part) for k in filled]
            yield pa.RecordBatch.from_arrays([pa.array([row * (width // part) + k for k in filled], pa.int32()), pa.array(runs, pa.binary())], schema=schema)

    def count_runs(batches):
        found, n = [], 0
        for s in stretches(batches):
            for k, keys in enumerate(s.keys(), 1):
                found.append(keys[s.fresh & (s.since >= k)])
                n += len(found[-1])
            if n >= RUN:
                yield from run(found)
                found, n = [], 0
        if n:
            yield from run(found)

    def merge(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, cells in zip(batch.column("segment").to_pylist(), batch.column("cells")):
                if not dense:
                    added(own.setdefault(segment, np.zeros(part, np.uint8)), cells.as_buffer())
                    continue
                more = np.frombuffer(pa.Codec("zstd").decompress(cells.as_buffer(), part, asbytes=True), np.uint8)
                own[segment] = np.minimum(own[segment].astype(np.uint16) + more, 255).astype(np.uint8) if segment in own else more
        for segment, cells in own.items():
            yield sent(segment, np.packbits(cells >= min(least, 255), bitorder="little"))

    kind = "segment int, cells binary"
    merged = texts.mapInArrow(count if dense else count_runs, kind).repartition(parts, "segment").mapInArrow(merge, kind)
    out = np.zeros((ROWS * width // part, part // 8), np.uint8)
    for r in merged.collect():  # at most ROWS * CELLS bits, 64 MB, whatever the input
        out[r["segment"]] = np.frombuffer(pa.Codec("zstd").decompress(bytes(r["cells"]), part // 8, asbytes=True), np.uint8)
    return out.reshape(ROWS, width // 8)


def frequent(texts: DataFrame, sketch: np.ndarray, least: int) -> DataFrame:
    """(lang, words, phrase, f): exact counts of the runs that occur ``least`` times, and of all words as the empty phrase."""
    width = 8 * sketch.shape[1]
    shared = texts.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])

    def passing(keys: np.ndarray) -> np.ndarray:
        one, two = cells_of(keys, width)
        out = bits_of(shared.value[0], one)
        out[out] = bits_of(shared.value[1], two[out])
        return out

    def sent(s: Stretch, n: int, langs: np.ndarray, phrases: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        names = pa.array(s.names, pa.string()).take(pa.array(langs, pa.int64()))
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(langs), n, np.int32)), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], schema=schema)

    def aggregate(batches):
        for s in stretches(batches):
            number, alive = s.lang, np.ones(len(s.tokens), bool)
            totals = np.bincount(s.lang[s.fresh], minlength=len(s.names))
            yield sent(s, 0, np.flatnonzero(totals), [b""] * int((totals > 0).sum()), totals[totals > 0])
            for n, keys in enumerate(s.keys(), 1):
                at = np.flatnonzero((s.since >= n) & (alive if n == 1 else alive & np.concatenate([[False], alive[:-1]])))
                at = at[passing(keys[at])]  # a run passes only where both runs of one word fewer do
                before = number[at] if n == 1 else number[at - 1]
                _, first, which = np.unique(before << 32 | s.word[at], return_index=True, return_inverse=True)  # no hash: exact
                counts = np.bincount(which[s.fresh[at]], minlength=len(first))
                number, alive = np.zeros(len(s.tokens), np.int64), np.zeros(len(s.tokens), bool)
                number[at], alive[at] = which, True
                ends, counts = at[first[counts > 0]], counts[counts > 0]
                yield sent(s, n, s.lang[ends], [b" ".join(s.tokens[end - n + 1 : end + 1]) for end in ends.tolist()], counts)

    found = texts.mapInArrow(aggregate, "lang string, words int, phrase string, f bigint").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    return found.where((F.col("words") == 0) | (F.col("f") >= least))


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 * a / (left + right)) without overflow or rounding."""
    wide = lambda x: x.cast("decimal(19,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(left) + wide(right)).cast("bigint")


def _stretch(phrase: Column, start: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def scored(phrases: DataFrame, most: int) -> DataFrame:
    """(lang, phrase, words, a, score, l, r) of phrases of two words or more, at their lowest-scoring cuts."""
    cuts = [(n, k) for n in range(2, LONGEST + 1) for k in range(1, n)]
    part = lambda start, n: F.struct("lang", _stretch(F.col("phrase"), start, n).alias("phrase"))
    sides = F.array(*(F.when(F.col("words") == n, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), part(*run).alias("part"))) for n, k in cuts for side, run in (("l", (1, k)), ("r", (k + 1, n - k)))))
    long = phrases.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select("lang", "words", "phrase", "a", "s.*")
    known = phrases.where(F.col("words").between(1, LONGEST - 1)).select(F.struct("lang", "phrase").alias("part"), "f")
    asked = long.groupBy("part").agg(F.count("*").alias("n")).join(known, "part")
    long = joined(long, asked, "part", most)  # a frequent word is a part of many phrases
    at = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    wide = long.groupBy("lang", "words", "phrase", "a").agg(*(at(k, side).alias(f"{side}{k}") for k in range(1, LONGEST) for side in "lr"))
    options = [F.when(F.col("words") > k, F.struct(score_of(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    best = wide.withColumn("best", F.array_min(F.array(*options)))
    return best.select("lang", "phrase", "words", "a", "best.score", "best.l", "best.r")


def unsubsumed(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """``rows`` whose words don't lie in a longer phrase that occurs at least 80 % as often."""
    inside = [(n, start, m) for n in range(3, LONGEST + 1) for m in range(2, n) for start in range(1, n - m + 2)]
    parts = F.array(*(F.when(F.col("words") == n, _stretch(F.col("phrase"), start, m)) for n, start, m in inside))
    longer = phrases.where("words > 2").select("lang", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    return rows.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", 80))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    Whole texts of ``docs`` (lang, text) are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and these into words
    at spaces and tabs. A phrase stands within a piece and occurs ``least`` times or more, overlaps included: a times. Cut in
    two, its parts occur l and r times; it counts by its lowest score floor(2000000 a / (l + r)), the earliest of equal cuts.
    Phrases inside a longer one that occurs at least 80 % as often are left out. Ranks go by falling score, falling a and the phrase's
    bytes; n is the number of words of the language. Arithmetic is exact beyond 64 bits.

    A null lang counts as ``und``, together with texts of that lang; null and empty texts have no words; repeated rows count again;
    a language without such phrases and an empty table give no rows. Other columns are ignored. ``least`` may be at most 255, where
    cells of the sketch stop, to be told by the sketch; beyond, the exact count alone decides. A task's sketch has a byte for every
    32 bytes of text, up to 64 MB; beyond 2 GB of text it sends runs of cells instead of holding one. The merged one, a bit a cell, is
    sent to all workers (64 MB at most). What passes it without being frequent is only counted in vain: with more than 16 GB of
    text that is more and more.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width_of(size)
    tasks = max(LEAST_TASKS, 2 * docs.sparkSession.sparkContext.defaultParallelism, size // MOST_BYTES)
    texts = texts.coalesce(tasks)  # each task sends a sketch, and a row for each phrase
    phrases = table(frequent(texts, sketched(texts, width, least), least), "phrases")
    rows = unsubsumed(scored(phrases, hot_bound(phrases.count())), phrases)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALS))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", deal).orderBy(*order))).where(F.col("place") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB twin of the query.
COLLOCATIONS_SQL = r"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from d),
w as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from p),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase from w, (values (1), (2), (3), (4)) v(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= 30),
cuts as (select c.*, i, array_to_string(w[1:i], ' ') as x, array_to_string(w[i + 1:k], ' ') as y from c, (values (1), (2), (3)) v(i) where i < k),
s as (select cuts.*, l.f as l, r.f as r, (2000000::hugeint * a // (l.f + r.f))::bigint as score from cuts join f l on l.lang = cuts.lang and l.phrase = x join f r on r.lang = cuts.lang and r.phrase = y),
best as (select *, row_number() over (partition by lang, phrase order by score, i) as best from s),
longer as (select lang, array_to_string(w[b:b + m - 1], ' ') as phrase, max(a) as longer from c, (values (2), (3)) v(m), (values (1), (2), (3)) x(b) where m < k and b + m - 1 <= k group by all),
kept as (select b.*, n from best b left join longer using (lang, phrase) join n using (lang) where best = 1 and (longer is null or 100::hugeint * longer < 80::hugeint * a)),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept)
select * from ranked where rank <= 2000"""
