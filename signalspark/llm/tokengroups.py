"""N-gram Jaccard join by a token-group matrix, over shingle sets of whole texts (operator 8).

Exact: no link between different texts is lost, and none of the steps lists the pairs of a group.

1. *Order.* A count sketch of fixed size over all shingles of all texts orders tokens, rarest first. Two sets whose Jaccard
   similarity reaches t share a token among the first n - ceil(t * n) + 1 of each, in any common order; in this one, passages
   that many texts share come last and bring nobody together who has enough words of their own.
2. *Groups.* Sets meet at the tokens of those prefixes. Sets of like size (own band and the next) that share one are put into
   the group named after the least of them: a set joins a group once, however many tokens it shares with it. A set whose
   rare tokens nobody shares is in no group and its shingles go nowhere. Of many texts most groups are met by chance, so
   profiles meet before shingles do: how many of a set's shingles fall into each of a number of cells bounds what two sets can
   have in common, and who could reach t with nobody leaves the group.
3. *Matrix.* A group's sets come together once and are cut into runs of similar ones; the union of a run's tokens is its row
   of the matrix. A query set's overlap with that row bounds its similarity to all of the run: only rows that could still
   reach the threshold are opened, and only for members that the query isn't connected to yet.
4. Groups of many shingles are cut into parts. Each part is joined within itself and with the group's first set; what is not
   connected to the bulk of its group then is asked of the other parts as well.
5. Components of the verified links, spread to exact copies, which were one node all along.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WordIds, as_bytes, chain, drop, mix, row_key, rows_among, shuffle_parts, table, without_rows
from .graph import components, hot_bound, joined

#: Sets of one row of the matrix, and shingles of one part of a group.
GROUP_DOCS = 32
PART_SHINGLES = 1_000_000
#: Counters of the sketch (a byte each once they are summed), and the pieces that tasks send them in.
CELLS, PIECES = 1 << 22, 16
#: Sets that meet at one token before they are dealt to several meeting places.
MEETING = 1 << 20
#: Shingles for a cell of a profile, and sets of a group up to which profiles are compared (larger ones keep all).
PROFILE, COMPARED = 4, 2_000
#: Rows of a plan that is small enough to be sent to every executor.
FEW = 1_000_000


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; fewer words count as one run, none as no run."""
    if 0 < len(words) < n:
        return mix(chain(words, len(words)) + np.uint64(len(words)))
    return np.unique(chain(words, n))


def identity(found: np.ndarray) -> int:
    """Id of a shingle set, as a signed 64-bit number; 0 for the empty set."""
    if not len(found):
        return 0
    with np.errstate(over="ignore"):
        total = mix(found ^ np.uint64(0x27D4EB2F165667C5)).sum(dtype=np.uint64)
        return int(mix(np.array([total + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def profile_of(found: np.ndarray) -> bytes | None:
    """Number of shingles in each of a power of two of cells, a byte each; None if one doesn't fit."""
    cells = 1 << max(0, math.ceil(math.log2(max(1, len(found)) / PROFILE)))
    counts = np.bincount((found >> np.uint64(33)).astype(np.int64) & (cells - 1), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def could_link(profiles: list[bytes | None], percent: int) -> np.ndarray:
    """Which of the sets of these profiles could link with another one of them; a set without profile could with any."""
    if len(profiles) < 2:
        return np.zeros(len(profiles), bool)
    if len(profiles) > COMPARED or None in profiles:
        return np.ones(len(profiles), bool)
    cells = min(map(len, profiles))  # profiles of more cells are folded: their cells' numbers end in the same bits
    rows = np.stack([np.frombuffer(x, np.uint8).reshape(-1, cells).sum(0, dtype=np.int32) for x in profiles])
    size, out = rows.sum(1), np.zeros(len(rows), bool)
    for k in range(len(rows) - 1):
        both = np.minimum(rows[k], rows[k + 1 :]).sum(1)
        near = 100 * both >= percent * (size[k] + size[k + 1 :] - both)
        out[k] |= near.any()
        out[k + 1 :] |= near
    return out


def _sets(batch: pa.RecordBatch, memo: WordIds, n: int):
    for text in as_bytes(batch.column("text")):
        yield shingles(memo.of(text.translate(ASCII_LOWER).split()), n)


class Seen(set):
    """Ids of sets that a task has handled; emptied when it grows large (then some are handled again)."""

    def first(self, own: int) -> bool:
        if own in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(own)
        return True


def shingle_sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k1, k2, n, cls, piece, at, cells): one row for each row of ``docs`` with its key, its number of distinct
    shingles, the id of its set and, where a task meets a set first, its profile, and rows without n that hold a task's counts of
    the shingles of its different sets, by cell of the sketch (all cells of a piece, or those named in ``at``)."""
    names = ["doc_id", "k1", "k2", "n", "cls", "met", "profile", "piece", "at", "cells"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int32(), pa.binary(), pa.binary()])))

    def run(batches):
        memo, seen, cells = WordIds(), Seen(), np.zeros(CELLS, np.uint32)
        for batch in batches:
            sizes, ids, some, held, met, profiles = [], [], [], 0, [], []
            for found in _sets(batch, memo, words):
                sizes.append(len(found))
                ids.append(identity(found))
                met.append(bool(len(found)) and seen.first(ids[-1]))
                profiles.append(profile_of(found) if met[-1] else None)
                if met[-1]:
                    some.append(found)
                    held += len(found)
                if held > 500_000:
                    np.add.at(cells, cell_of(np.concatenate(some)), 1)
                    some, held = [], 0
            if some:
                np.add.at(cells, cell_of(np.concatenate(some)), 1)
            none = lambda kind: pa.nulls(batch.num_rows, kind)
            own = [batch.column(c) for c in names[:3]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(met, pa.bool_()), pa.array(profiles, pa.binary()), none(pa.int32()), none(pa.binary()), none(pa.binary())], schema=schema)
        if cells.any():
            for piece, dense in enumerate(np.minimum(cells, 65535).astype(np.uint16).reshape(PIECES, -1)):
                at = np.flatnonzero(dense).astype(np.uint32)
                few = 3 * len(at) < len(dense)
                values = [None] * 7 + [piece, at.tobytes() if few else None, (dense[at] if few else dense).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return keyed(docs).mapInArrow(run, "doc_id bigint, k1 bigint, k2 int, n bigint, cls bigint, met boolean, profile binary, piece int, at binary, cells binary")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_key(docs))


def cell_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(7)).astype(np.int64) & (CELLS - 1)


def summed(rows: DataFrame) -> np.ndarray:
    """The sketch: 4 * log2(1 + count) of each cell, as a byte; its size is fixed."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, at, cells in zip(*(batch.column(c) for c in ("piece", "at", "cells"))):
                total = held.setdefault(piece.as_py(), np.zeros(CELLS // PIECES, np.int64))
                got = np.frombuffer(cells.as_buffer(), np.uint16)
                total[np.frombuffer(at.as_buffer(), np.uint32) if at.is_valid else slice(None)] += got
        for piece, total in held.items():
            level = np.minimum(255, np.floor(4 * np.log2(1 + total))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["piece", "cells"])

    pieces = rows.where("piece is not null").select("piece", "at", "cells").repartition(PIECES, "piece").mapInArrow(add, "piece int, cells binary").collect()
    out = np.zeros((PIECES, CELLS // PIECES), np.uint8)
    for r in pieces:
        out[r["piece"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def band_of(n: np.ndarray, percent: int) -> np.ndarray:
    """Bands of sizes: two sets that can link are in the same band or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / math.log(100 / percent) + 1e-9).astype(np.int64) if percent < 100 else n.astype(np.int64)


def memberships(docs: DataFrame, words: int, percent: int, levels) -> DataFrame:
    """(grp, cls): the groups of every set that shares a rare token with another one of like size; repeats occur."""
    buckets = shuffle_parts(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary())])

    def cut(batches):
        memo, seen, level = WordIds(), Seen(), levels.value
        for batch in batches:
            keys, owners, sizes = [], [], []
            for found in _sets(batch, memo, words):
                n = len(found)
                if not n or not seen.first(own := identity(found)):
                    continue
                most = n + (-percent * n // 100) + 1  # n - ceil(t * n) + 1
                rank = level[cell_of(found)]
                first = np.lexsort((found, rank))[:most]
                key, at = mix(found[first] * np.uint64(0x9E3779B97F4A7C15)), rank[first]
                copies = np.ceil(2.0 ** (at / 4.0) / MEETING).astype(np.int64)
                if (copies > 1).any():  # a token of very many sets: its sets meet in pairs of parts
                    many = []
                    for k, c in zip(key, copies):
                        own_part = own % int(c)
                        for other in range(int(c)) if c > 1 else ():
                            code = min(own_part, other) * int(c) + max(own_part, other) + 1
                            many.append(mix(np.array([int(k) ^ (code * 0x165667B19E3779F9 & (1 << 64) - 1)], np.uint64)))
                    key = np.concatenate([key[copies == 1], *many])
                keys.append(key)
                owners.append(np.full(len(key), own, np.int64))
                sizes.append(np.full(len(key), n, np.int32))
            if not keys:
                continue
            keys, owners, sizes = map(np.concatenate, (keys, owners, sizes))
            bucket = (keys >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            keys, owners, sizes = keys[order], owners[order], sizes[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            got = [(k, keys[s:e].tobytes(), owners[s:e].tobytes(), sizes[s:e].tobytes()) for k, (s, e) in enumerate(zip(ends[:-1], ends[1:])) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], f.type) for k, f in enumerate(schema)], schema=schema)

    def meet(batches):
        keys, owners, sizes = [], [], []
        for batch in batches:
            keys += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("keys")]
            owners += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("owners")]
            sizes += [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column("sizes")]
        if not keys:
            return
        keys, owners, sizes = map(np.concatenate, (keys, owners, sizes))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # tokens of one set only meet nobody
        keys, owners, bands = keys[order], owners[order], band_of(sizes[order], percent)
        # each set stands under its own band and under the one below, so that sets of neighbouring bands meet
        keys, owners, bands = np.tile(keys, 2), np.tile(owners, 2), np.concatenate([bands, bands - 1])
        order = np.lexsort((owners, bands, keys))
        keys, owners, bands = keys[order], owners[order], bands[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (bands[1:] != bands[:-1])]) if len(keys) else np.zeros(0, bool)
        start = np.flatnonzero(fresh)
        if not len(start):
            return
        head = np.repeat(owners[start], np.diff(np.concatenate([start, [len(keys)]])))  # owners are sorted: the first is the least
        pairs = np.unique(np.stack([head, owners], 1)[owners != head], axis=0)
        for s in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[s : s + 50_000, 0]), pa.array(pairs[s : s + 50_000, 1])], ["grp", "cls"])

    return (
        docs.select("text").mapInArrow(cut, "bucket int, keys binary, owners binary, sizes binary")
        .repartition(buckets, "bucket").mapInArrow(meet, "grp bigint, cls bigint")
    )


def promising(placed: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(grp, cls, parts, part): rows of ``placed``, without the sets of groups of one part that by their profiles link with none of the group."""
    parts = shuffle_parts(placed.sparkSession)
    single = placed.where("parts = 1").select("grp", "cls")
    # a set's profile comes from each task that met it and is the same from all
    profiles = sizes.where("met").join(single.select(F.col("cls").alias("asked")).distinct(), F.col("cls") == F.col("asked"), "left_semi")
    profiles = profiles.groupBy("cls").agg(F.first("profile").alias("profile"))

    def run(batches):
        last, rows, kept = None, [], []

        def flush():
            kept.extend((last, rows[k][0]) for k in np.flatnonzero(could_link([x for _, x in rows], percent)))

        for batch in batches:
            for grp, cls, profile in zip(*(batch.column(c).to_pylist() for c in ("grp", "cls", "profile"))):
                if grp != last:
                    flush()
                    last, rows = grp, []
                rows.append((cls, profile))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], ["grp", "cls"])
            kept.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.int64()) for k in (0, 1)], ["grp", "cls"])

    near = single.join(profiles, "cls").repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(run, "grp bigint, cls bigint")
    return near.select("grp", "cls", F.lit(1).alias("parts"), F.lit(0).alias("part")).union(placed.where("parts > 1").select("grp", "cls", "parts", "part"))


class Linked:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        while True:
            new = self.up[self.up]
            if (new == self.up).all():
                return new
            self.up = new


def open_groups(sets: list[np.ndarray], sides: list[int], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of verified links that connect what links within ``sets`` connect.

    Where both sides 0 and 1 occur, only sets of different sides are compared. ``known``: equal numbers are connected already.
    """
    if len(sets) < 2 or all(sides):
        return []
    side, size = np.array(sides), np.array([len(s) for s in sets])
    crossed = len(np.unique(side)) > 1
    order = np.lexsort(([s[0] for s in sets], side))
    sets, side, size = [sets[i] for i in order], side[order], size[order]
    starts = np.concatenate([[0], np.cumsum(size)])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(token.max() + 1, bool)
    linked, links = Linked(len(sets)), []
    if known is not None:
        named = np.array(known)[order]
        _, first, which = np.unique(named, return_index=True, return_inverse=True)
        linked.up = first[which]
    members = np.flatnonzero(side == 1) if crossed else np.arange(len(sets))
    queries = np.flatnonzero(side == 0) if crossed else np.arange(len(sets))
    spans = lambda rows: np.concatenate([token[starts[r] : starts[r + 1]] for r in rows])

    def overlaps(rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mark[spans(rows)].astype(np.int64), np.concatenate([[0], np.cumsum(size[rows])[:-1]]))

    for g in range(0, len(members), GROUP_DOCS):
        group = members[g : g + GROUP_DOCS]
        roots = linked.roots()
        asked = queries if crossed else queries[queries < group[-1]]
        asked = asked[(100 * size[asked] >= percent * size[group].min()) & (100 * size[group].max() >= percent * size[asked])]
        if len(np.unique(roots[group])) == 1:  # one component: nothing to ask of those that are in it
            asked = asked[roots[asked] != roots[group[0]]]
        if not len(asked):
            continue
        union = spans(group)
        mark[union] = True
        asked = asked[100 * overlaps(asked) >= percent * size[asked]]
        mark[union] = False
        for d in group:
            roots = linked.roots()
            near = asked[(roots[asked] != roots[d]) & (asked != d) & (100 * size[asked] >= percent * size[d]) & (100 * size[d] >= percent * size[asked])]
            if not crossed:
                near = near[near < d]
            if not len(near):
                continue
            own = token[starts[d] : starts[d + 1]]
            mark[own] = True
            both = overlaps(near)
            mark[own] = False
            for q in near[100 * both >= percent * (size[near] + size[d] - both)]:
                if (a := linked.root(int(q))) != (b := linked.root(int(d))):
                    linked.up[max(a, b)] = min(a, b)
                    links.append((int(order[q]), int(order[d])))
    return links


def verified_links(docs: DataFrame, firsts: DataFrame, plan: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) set ids of links that hold, enough to connect what each unit connects.

    ``firsts``: (cls, doc_id, k1, k2) of one row of each set. ``plan``: (cls, unit, side, known): a set's shingles go to each of its
    units once; ``open_groups`` says what side and known mean.
    """
    parts = shuffle_parts(docs.sparkSession)
    unit = "array<struct<unit:bigint,side:int,known:bigint>>"
    by_set = plan.groupBy("cls").agg(F.collect_set(F.struct("unit", "side", "known")).alias("units"))
    wanted = table(by_set.join(firsts, "cls").select(F.col("doc_id").alias("wanted"), F.col("k1").alias("w1"), F.col("k2").alias("w2"), "cls", "units"), "wanted")
    n, units = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("units")), F.lit(0))).first()
    few = n <= FEW and units <= 4 * FEW  # then rows and units are small enough to be sent to every executor; else both sides are shuffled
    same = F.col("doc_id").eqNullSafe(F.col("wanted")) & (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))
    texts = keyed(docs).join(F.broadcast(wanted) if few else wanted, same)

    def load(batches):
        memo, seen = WordIds(), Seen()
        for batch in batches:
            want = batch.column("cls").to_pylist()
            found = [s.tobytes() if identity(s) == w and seen.first(w) else None for s, w in zip(_sets(batch, memo, words), want)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("units"), pa.array(found, pa.binary())], ["cls", "units", "found"])

    units = (
        texts.select("text", "cls", "units").mapInArrow(load, f"cls bigint, units {unit}, found binary")
        .where("found is not null").select("cls", F.explode("units").alias("u"), "found").select("u.unit", "u.side", "u.known", "cls", "found")
        .repartition(parts, "unit").sortWithinPartitions("unit")
    )

    def verify(batches):
        last, rows = None, {}

        def flush():
            names, held = list(rows), list(rows.values())
            known = [k for k, _ in held]
            out = open_groups([s for _, s in held], [side for _, side in names], percent, known if known[0] is not None else None)
            return pa.RecordBatch.from_arrays([pa.array([names[x[k]][0] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for unit_id, side, known, cls, found in zip(*(batch.column(c).to_pylist() for c in ("unit", "side", "known", "cls", "found"))):
                if unit_id != last and rows:
                    yield flush()
                    rows = {}
                last = unit_id
                rows[cls, side] = (known, np.frombuffer(found, np.uint64))  # a set that comes again is the same
        if rows:
            yield flush()

    return units.mapInArrow(verify, "a bigint, b bigint")


def group_links(docs: DataFrame, sizes: DataFrame, words: int, percent: int, part: int = PART_SHINGLES) -> DataFrame:
    """(node, root) of the components of all links between different sets."""
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(summed(sizes))
    own = sizes.where("n > 0")
    firsts = own.groupBy("cls").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("row"), F.min("n").alias("n")).select("cls", "row.*", "n")
    members = memberships(docs, words, percent, levels).distinct()
    members = table(members.union(members.select("grp", F.col("grp").alias("cls")).distinct()), "members")
    sized = members.join(firsts.select("cls", "n"), "cls")
    parts = sized.groupBy("grp").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"))
    placed = members.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("cls", "grp"), F.col("parts").cast("bigint")).cast("int"))
    met = table(placed, "met")
    placed = table(promising(met, sizes, percent), "placed")
    nothing = F.lit(None).cast("bigint")
    unit = lambda *extra: F.xxhash64("grp", *extra)
    large = placed.where("parts > 1")
    heads = large.where("cls = grp").select("grp", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    plan = placed.select("cls", unit("part").alias("unit"), F.lit(0).alias("side"), nothing.alias("known"))
    plan = plan.union(heads.select("cls", unit("part"), F.lit(0), nothing)).distinct()
    links = table(verified_links(docs, firsts, plan, words, percent), "links")
    roots = components(links)
    drop(members, met)
    if large.isEmpty():
        drop(placed, links)
        return roots
    # what isn't connected to the bulk of its large group is asked of the group's other parts
    named = large.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("grp", "cls", "parts", "part", F.coalesce("root", "cls").alias("known"))
    named = table(named, "named")
    bulk = named.groupBy("grp", "known").count().groupBy("grp").agg(F.max_by("known", F.struct("count", "known")).alias("bulk"))
    left = table(named.join(bulk, "grp").where("known <> bulk").select("grp", "cls", "parts", "known"), "left")
    if left.isEmpty():
        drop(placed, links, named, left)
        return roots
    blocks = left.join(firsts.select("cls", "n"), "cls").groupBy("grp").agg(F.ceil(F.sum("n") / part).cast("int").alias("blocks"))
    asking = left.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks").cast("bigint")).cast("int"))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = named.join(blocks, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    again = asking.select("cls", unit("part", "block").alias("unit"), F.lit(0).alias("side"), "known").union(asked.select("cls", unit("part", "block"), F.lit(1), "known"))
    out = components(links.union(verified_links(docs, firsts, again, words, percent)))
    drop(placed, links, named, left)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, part: int = PART_SHINGLES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, ...): doc_id, n_shingles, component_id (least doc_id reachable by links).

    Texts are lower-cased (A-Z) and split at white space; a text's set has its distinct runs of ``words`` words (fewer
    words: one run). Two sets link when 100 * intersection >= percent * union. Null and empty texts have no shingles and
    link with nothing. Repeated rows give repeated rows. Rows without doc_id take part in links, but name no component: their
    component_id is the least doc_id that they reach, or null. Other columns are ignored. An empty table gives no rows.
    """
    sizes = table(shingle_sizes(docs, words), "sizes")
    return spread(sizes, group_links(docs, sizes, words, percent, part))


def spread(sizes: DataFrame, roots: DataFrame) -> DataFrame:
    nodes = sizes.where("n > 0").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "cls").alias("root"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows"))
    out = joined(nodes, least.withColumnRenamed("n_rows", "n"), "root", hot_bound(sizes.count())).select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return out.union(sizes.where("n = 0").select("doc_id", "n", "doc_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` but for near duplicates: of each component one row stays, that of the least doc_id.

    Rows without doc_id come last in that order and are known by their texts: the least text hash stays where a component
    has no other rows. A row that occurs again, in doc_id and text, stays once. Rows of null or empty texts all stay.
    """
    sizes = table(shingle_sizes(docs, words), "sizes")
    roots = group_links(docs, sizes, words, percent).withColumnRenamed("node", "cls")
    nodes = sizes.where("n > 0").join(roots, "cls", "left").select(F.coalesce("root", "cls").alias("root"), "doc_id", "k1", "k2")
    nodes = table(nodes.groupBy("root", "doc_id", "k1", "k2").agg(F.count("*").alias("times")), "nodes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    best = nodes.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    marked = joined(nodes, best, "root", hot_bound(nodes.count())).select("doc_id", "k1", "k2", "times", (order == F.col("best")).alias("kept"))
    kept = without_rows(docs, marked.where("not kept").select("doc_id", "k1", "k2"))
    again = table(marked.where("kept and times > 1").select("doc_id", "k1", "k2"), "again")
    drop(sizes)
    if again.isEmpty():
        return kept
    return without_rows(kept, again).union(rows_among(kept, again).dropDuplicates(["_doc", "_k1", "_k2"]).select(*docs.columns))
