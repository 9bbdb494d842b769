"""Sets of bits compared block by block: similar pairs, their links as packed numbers, and the nearest row of another fold.

Rows are dealt to blocks, a block is packed into one row, and each pair of blocks is one task's. What is shuffled is each block
once for every other one; a pair of rows never is. A task holds two blocks and a stretch of their table of common bits. That is
a comparison of all pairs, quadratic by nature; it takes a nanosecond or two a pair of up to 64 bits, and ten to twenty of wide sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import cut, shared_folder

#: Rows of a block at most, rows and number of blocks that are enough to share the work of fewer, cells of a table of common bits.
BLOCK, FEW, SHARES, CELLS, STRETCH = 1 << 15, 1 << 10, 8, 1 << 17, 1 << 23
#: 64-bit words up to which sets are compared by word; share of rows from which a bit of wider sets is multiplied, not looked up.
NARROW, COMMON = 4, 1 / 8
#: Rows that are sent together.
SENT = 1 << 16


def blocks_of(rows: int) -> int:
    return max(1, -(-rows // BLOCK), min(SHARES, -(-rows // FEW)))


def packed(rows: DataFrame, block: Column, blocks: int) -> DataFrame:
    """(block, payload): the other columns of each block's rows, as one Arrow stream."""

    def pack(batches):
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            of = batch.column("block").to_numpy(zero_copy_only=False)
            rest = batch.select([c for c in batch.schema.names if c != "block"])
            for b in np.unique(of).tolist():
                held.setdefault(b, []).append(rest.take(pa.array(np.flatnonzero(of == b))))
        for b, parts in held.items():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(parts).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    return cut(rows.withColumn("block", block.cast("int")).repartition(blocks, "block").mapInArrow(pack, "block int, payload binary"))


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    """The column as one array, without what null or sliced chunks leave behind."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def met(blocks: DataFrame, count: int, work: Callable[[int, pa.Table, int, pa.Table], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """What ``work(i, block, j, block)`` yields for all i <= j."""

    def run(batches):
        waiting = None
        for batch in batches:
            for pair, block, payload in zip(*(batch.column(c).to_pylist() for c in ("pair", "block", "payload"))):
                if pair // count == pair % count:
                    own = unpacked(payload)
                    yield from work(block, own, block, own)
                elif waiting is None:
                    waiting = block, payload
                else:
                    yield from work(waiting[0], unpacked(waiting[1]), block, unpacked(payload))
                    waiting = None

    other = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    pair = F.least("block", "other").cast("bigint") * count + F.greatest("block", "other")
    copies = blocks.withColumn("other", other).select(pair.alias("pair"), "block", "payload")
    return copies.repartition(min(count * (count + 1) // 2, 4_000), "pair").sortWithinPartitions("pair", "block").mapInArrow(run, kind)


class Narrow:
    """Sets of few words, by rising size; ``order`` are their rows in the block."""

    def __init__(self, column: pa.Array):
        lengths = np.diff(column.offsets.to_numpy())
        values = column.values.to_numpy(zero_copy_only=False).astype(np.uint64)
        at = np.arange(len(values)) - np.repeat(column.offsets.to_numpy()[:-1], lengths)
        half = np.zeros((len(lengths), 2 * (-(-int(lengths.max(initial=0)) // 2) or 1)), np.uint64)
        half[np.repeat(np.arange(len(lengths)), lengths), at] = values
        words = half[:, ::2] | half[:, 1::2] << np.uint64(32)
        size = np.bitwise_count(words).sum(1, dtype=np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size, self.words = size[self.order], np.ascontiguousarray(words[self.order].T)
        self.both, self.counts = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def sorted_by(self, more: np.ndarray) -> None:
        """Rows of one size by ``more``, given by row of the block."""
        again = np.lexsort((more[self.order], self.size))
        self.order, self.words = self.order[again], np.ascontiguousarray(self.words[:, again])

    def common(self, own: slice, other: Narrow, beside: slice) -> np.ndarray:
        """Numbers of common bits of rows ``own`` of this block and ``beside`` of the other."""
        shape = own.stop - own.start, beside.stop - beside.start
        cells = shape[0] * shape[1]
        if cells > len(self.both):
            self.both, self.counts = np.empty(cells, np.uint64), np.empty(cells, np.uint8)
        both, counts, total = self.both[:cells].reshape(shape), self.counts[:cells].reshape(shape), None
        for x, y in zip(self.words, other.words):  # bits that one has no words for are in common with nothing
            np.bitwise_count(np.bitwise_and(x[own, None], y[None, beside], out=both), out=counts)
            total = counts if len(self.words) == 1 else counts.astype(np.int32) if total is None else np.add(total, counts, out=total)
        return total

    def groups(self) -> Iterator[tuple[int, int, int]]:
        """(size, start, stop) of the rows of each size, without empty sets."""
        sizes, starts = np.unique(self.size, return_index=True)
        for n, lo, hi in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(self.size)]):
            if n:
                yield n, lo, hi

    def similar(self, other: Narrow, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of this block, rows of the other, similarity), stretch after stretch."""
        for n, lo, hi in self.groups():
            a, b = np.searchsorted(other.size, [max(1, int(np.ceil(n * least - 1e-9))), n / least + 1e-9])
            b = np.searchsorted(other.size, n / least + 1e-9, "right")
            if a >= b:
                continue
            m = other.size[a:b]
            needed = np.ceil((n + m) * (least / (1 + least)) - 1e-9).astype(np.int32)
            needed = needed.astype(np.uint8) if needed.max() < 256 and len(self.words) == 1 else needed
            step = max(1, CELLS // (b - a))
            for k in range(lo, hi, step):
                both = self.common(slice(k, min(k + step, hi)), other, slice(a, b))
                x, y = np.divmod(np.flatnonzero(both >= needed), b - a)
                if len(x):
                    common = both[x, y].astype(np.float64)
                    found = common / (n + m[y] - common)
                    keep = found >= least
                    yield self.order[k + x[keep]], other.order[a + y[keep]], found[keep]

    def nearest(self, folds: np.ndarray, other: Narrow, other_folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest similarity of each row of this block to rows of other folds in the other one, and how many sizes were looked
        at; both sides are sorted by fold within a size. Sizes come by rising difference until none could be nearer."""
        best, opened = np.zeros(len(self.size)), np.zeros(len(self.size), np.int32)
        own, beside = folds[self.order], other_folds[other.order]
        sizes = list(other.groups())
        for n, lo, hi in self.groups():
            for m, a, b in sorted(sizes, key=lambda g: -min(g[0], n) / max(g[0], n)):
                if min(m, n) / max(m, n) <= best[lo:hi].min():
                    break
                opened[lo:hi] += 1
                step = max(1, CELLS // (hi - lo))
                for k in range(a, b, step):
                    fold = beside[k : min(k + step, b)]
                    starts = np.flatnonzero(np.concatenate([[True], fold[1:] != fold[:-1]]))
                    most = np.maximum.reduceat(other.common(slice(k, k + len(fold)), self, slice(lo, hi)), starts, axis=0)
                    most[fold[starts][:, None] == own[None, lo:hi]] = 0
                    both = most.max(axis=0).astype(np.float64)
                    np.maximum(best[lo:hi], both / (n + m - both), out=best[lo:hi])
        out, looked = np.empty_like(best), np.empty_like(opened)
        out[self.order], looked[self.order] = best, opened
        return out, looked


class Wide:
    """Sets by their bits. Bits that many rows have are multiplied as a matrix, the others counted where rows share them."""

    def __init__(self, column: pa.Array):
        self.size = np.diff(column.offsets.to_numpy()).astype(np.int64)
        self.bits = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.size)), self.size)

    def _matrix(self, place: np.ndarray, width: int, bound: np.ndarray, ones: tuple[int, int]) -> np.ndarray:
        out = np.zeros((len(self.size), width + 2), np.float32)
        at = place[self.bits] >= 0
        out[self.row[at], place[self.bits[at]]] = 1
        out[:, width + ones[0]], out[:, width + ones[1]] = 1, -bound
        return out

    def similar(self, other: Wide, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        dims = 1 + int(max(self.bits.max(initial=0), other.bits.max(initial=0)))
        many, beside = np.bincount(self.bits, minlength=dims), np.bincount(other.bits, minlength=dims)
        common = np.flatnonzero(many * beside > len(self.size) * len(other.size) * COMMON**2)
        place = np.full(dims, -1)
        place[common] = np.arange(len(common))
        bound = lambda of: of.size * (least / (1 + least)) - 5e-3
        x = self._matrix(place, len(common), bound(self), (0, 1))  # common bits less what is needed, in one product
        y = np.ascontiguousarray(other._matrix(place, len(common), bound(other), (1, 0)).T)
        rare = (many > 0) & (beside > 0) & (place < 0)
        at = np.flatnonzero(rare[other.bits])
        at = at[np.argsort(other.bits[at], kind="stable")]
        rows, ends = other.row[at], np.cumsum(np.where(rare, beside, 0))
        filled = other.size > 0
        step = max(1, STRETCH // max(1, len(other.size)))
        for lo in range(0, len(self.size), step):
            over = x[lo : lo + step] @ y
            first, last = np.searchsorted(self.row, [lo, lo + step])
            own = first + np.flatnonzero(rare[self.bits[first:last]])
            own = own[np.argsort(self.bits[own], kind="stable")]
            bits, starts = np.unique(self.bits[own], return_index=True)
            flat, mine = over.reshape(-1), (self.row[own] - lo) * over.shape[1]
            for d, a, b in zip(bits.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)]):
                flat[(mine[a:b, None] + rows[ends[d] - beside[d] : ends[d]]).reshape(-1)] += 1
            p, q = np.divmod(np.flatnonzero(flat >= 0), over.shape[1])
            keep = (self.size[lo + p] > 0) & filled[q]
            p, q = p[keep], q[keep]
            both = np.rint(over[p, q] + bound(self)[lo + p] + bound(other)[q])
            found = both / (self.size[lo + p] + other.size[q] - both)
            keep = found >= least
            yield lo + p[keep], q[keep], found[keep]


def _distinct(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different sets of a block, and the place among them of each row's."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    known: dict[bytes, int] = {}
    first, of = [], np.empty(len(column), np.int64)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = values[a:b].tobytes()
        if own not in known:
            known[own] = len(known)
            first.append(k)
        of[k] = known[own]
    return column.take(pa.array(first, pa.int64())), of


def _whole(column: pa.Array) -> pa.Array:
    """A list column that begins at its first value."""
    return column if column.offset == 0 and (not len(column) or column.offsets[0].as_py() == 0) else pa.concat_arrays([column.slice(0, 0), column.take(pa.array(np.arange(len(column))))])


def sides(column: pa.Array, narrow: bool) -> Narrow | Wide:
    return Narrow(_whole(column)) if narrow else Wide(_whole(column))


def pairs(rows: DataFrame, key: str, sets: str, least: float, narrow: bool, blocks: int) -> DataFrame:
    """(a, b, similarity) of rows a < b of similarity ``least`` or more. ``sets`` holds packed numbers of 32 bits, if ``narrow``,
    else bits. Equal sets of a block are compared as one."""
    kind = rows.schema[key].dataType.simpleString()
    own = packed(rows.select(F.col(key).alias("key"), F.col(sets).alias("set")), F.pmod(F.xxhash64("key"), F.lit(blocks)), blocks)

    def work(i, left, j, right):
        keys, beside = _column(left, "key"), _column(right, "key")
        (x, of), (y, at) = (_distinct(_whole(_column(t, "set"))) for t in (left, right))
        by, starts = np.argsort(of, kind="stable"), np.searchsorted(np.sort(of), np.arange(len(x) + 1))
        by2, starts2 = (by, starts) if i == j else (np.argsort(at, kind="stable"), np.searchsorted(np.sort(at), np.arange(len(y) + 1)))
        counts, counts2 = np.diff(starts), np.diff(starts2)
        for u, v, found in sides(x, narrow).similar(sides(y, narrow), least):
            whole = counts[u] * counts2[v]
            upto = np.cumsum(whole)
            for lo in range(0, int(upto[-1]) if len(upto) else 0, SENT):  # so many pairs of members at a time
                n = np.arange(lo, min(lo + SENT, int(upto[-1])))
                of_pair = np.searchsorted(upto, n, "right")
                inside = n - (upto[of_pair] - whole[of_pair])
                p = by[starts[u[of_pair]] + inside // counts2[v[of_pair]]]
                q = by2[starts2[v[of_pair]] + inside % counts2[v[of_pair]]]
                if i == j:
                    keep = p < q  # each pair of a block comes twice, a row with itself once
                    p, q, of_pair = p[keep], q[keep], of_pair[keep]
                a, b = keys.take(pa.array(p)), beside.take(pa.array(q))
                first = pc.less(a, b)
                yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(found[of_pair])], names=["a", "b", "similarity"])

    return met(own, blocks, work, f"a {kind}, b {kind}, similarity double").where("a < b")


def nearest(rows: DataFrame, key: str, sets: str, fold: str, blocks: int) -> DataFrame:
    """(key, found, opened): largest similarity of each row to rows of other folds, and the most sizes looked at in a block."""
    kind = rows.schema[key].dataType.simpleString()
    own = packed(rows.select(F.col(key).alias("key"), F.col(sets).alias("set"), F.xxhash64(fold).alias("fold")), F.pmod(F.xxhash64("key"), F.lit(blocks)), blocks)

    def work(i, left, j, right):
        both = []
        for t in (left, right) if i != j else (left,):
            folds, side = _column(t, "fold").to_numpy(), sides(_column(t, "set"), True)
            side.sorted_by(folds)
            both.append((_column(t, "key"), folds, side))
        for (keys, folds, x), (_, others, y) in zip(both, both[::-1]):
            best, opened = x.nearest(folds, y, others)
            yield pa.RecordBatch.from_arrays([keys, pa.array(best), pa.array(opened)], names=["key", "found", "opened"])

    out = met(own, blocks, work, f"key {kind}, found double, opened int")
    return out.groupBy("key").agg(F.max("found").alias("found"), F.max("opened").alias("opened"))


#: Links that are packed together, links that one task may finish, and rows of nodes of which a node's number has one.
PACKED, LAST, NUMBERS = 1 << 20, 1_000_000, (1 << 32) - 1
LINKS = "i int, j int, links bigint, payload binary"
STATE = ("weight", "rank", "one", "lead", "head")


def _links(i: int, j: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """One packed row of links from rows ``u`` of block i to rows ``v`` of block j."""
    u, v = np.divmod(np.sort(u.astype(np.int64) << 32 | v), 1 << 32)
    rows, counts = np.unique(u, return_counts=True)
    steps = np.diff(v.astype(np.uint16), prepend=np.uint16(0))  # as numbers modulo 2**16, so they add up again
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out:
        out.write(np.array([len(rows)], np.int64).tobytes() + rows.astype(np.uint16).tobytes() + counts.astype(np.int32).tobytes() + steps.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([len(v)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["i", "j", "links", "payload"])


def _linked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of block i, their numbers of links, rows of block j)."""
    raw = pa.CompressedInputStream(pa.BufferReader(payload), "zstd").read()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    rows, counts = np.frombuffer(raw, np.uint16, n, 8), np.frombuffer(raw, np.int32, n, 8 + 2 * n)
    return rows.astype(np.int64), counts, np.cumsum(np.frombuffer(raw, np.uint16, offset=8 + 6 * n), dtype=np.uint16).astype(np.int64)


def _gathered(i: int, j: int, found) -> Iterator[pa.RecordBatch]:
    """Packed rows of what ``found`` yields of (u, v)."""
    us, vs, n = [], [], 0
    for u, v in found:
        us.append(u)
        vs.append(v)
        n += len(u)
        if n >= PACKED:
            yield _links(i, j, np.concatenate(us), np.concatenate(vs))
            us, vs, n = [], [], 0
    if n:
        yield _links(i, j, np.concatenate(us), np.concatenate(vs))


def _batches(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(len(batch)):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _spread(links: DataFrame, state: DataFrame, of: str, add: bool, size: int, blocks: int, update) -> DataFrame:
    """``state`` after each node has got the sum, or the largest, of its neighbours' numbers ``of``; ``update`` takes a block's
    arrays, what they got, and the first node's number. The state, eight bytes a node, is what is sent to all tasks.
    It is read back as a file, as the size that Spark expects of a checkpointed join is a product, longer by each round."""
    change = np.add if add else np.maximum

    def send(batches):
        held: dict[int, np.ndarray] = {}
        for r in _batches(batches):
            x, y = _numbers(r["x"]), _numbers(r["y"])
            rows, counts, v = _linked(r["payload"])
            to_i, to_j = (held.setdefault(r[b], np.zeros(size, np.int64)) for b in "ij")
            to_i[rows] = change(to_i[rows], change.reduceat(y[v], np.cumsum(counts) - counts))
            change.at(to_j, v, np.repeat(x[rows], counts))
        for b, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["block", "got"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for r in _batches(batches):
            held[r["block"]] = change(held[r["block"]], _numbers(r["got"])) if r["block"] in held else _numbers(r["got"])
        for b, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["block", "got"])

    def step(batches):
        for r in _batches(batches):
            got = _numbers(r["got"]) if r["got"] is not None else np.zeros(size, np.int64)
            out, total = update({c: _numbers(r[c]) for c in STATE}, got, r["block"] * size)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int32()), pa.array([total], pa.int64()), *(pa.array([out[c].astype(np.int64).tobytes()], pa.binary()) for c in STATE)], names=["block", "total", *STATE])

    side = lambda b, name: F.broadcast(state.select(F.col("block").alias(b), F.col(of).alias(name)))
    sent = links.join(side("i", "x"), "i").join(side("j", "y"), "j").select("i", "j", "x", "y", "payload").mapInArrow(send, "block int, got binary")
    merged = sent.repartition(blocks, "block").mapInArrow(merge, "block int, got binary")
    out = stored(state.drop("total").join(merged, "block", "left").mapInArrow(step, "block int, total bigint, " + ", ".join(f"{c} binary" for c in STATE)), "state")
    dropped(state)
    return out


def _ranked(s, got, first):
    """Nodes by how many they would take, lowest number first among equals."""
    alive = s["weight"] > 0
    degree = np.where(alive, s["weight"] - 1 + got, 0)
    rank = np.where(degree > 0, degree << 32 | NUMBERS - first - np.arange(len(degree)), 0)
    return s | {"rank": rank}, int(got[alive].sum())


def _one(s, got, first):
    return s | {"one": np.where(s["weight"] > 0, np.maximum(s["rank"], got), 0)}, 0


def _lead(s, got, first):
    return s | {"lead": np.where((s["rank"] > 0) & (np.maximum(s["one"], got) == s["rank"]), s["rank"], 0)}, 0


def _taken(s, got, first):
    head = np.where(s["weight"] > 0, np.maximum(s["lead"], got), 0)
    return s | {"head": np.maximum(s["head"], head), "weight": np.where(head > 0, 0, s["weight"])}, 0


def _alive(links: DataFrame, state: DataFrame, work, kind: str) -> DataFrame:
    """What ``work(i, j, u, v, weights, weights)`` yields for each row of links between nodes that are left."""

    def run(batches):
        for r in _batches(batches):
            x, y = _numbers(r["x"]), _numbers(r["y"])
            rows, counts, v = _linked(r["payload"])
            u = np.repeat(rows, counts)
            keep = (x[u] > 0) & (y[v] > 0)
            yield from work(r["i"], r["j"], u[keep], v[keep], x, y)

    side = lambda b, name: F.broadcast(state.select(F.col("block").alias(b), F.col("weight").alias(name)))
    return links.join(side("i", "x"), "i").join(side("j", "y"), "j").select("i", "j", "x", "y", "payload").mapInArrow(run, kind)


def _finished(batches):
    """The sequential order over a bounded rest of links (u, v, weights): (node, head, taken by it)."""
    import heapq

    near: dict[int, set[int]] = {}
    weight: dict[int, int] = {}
    for batch in batches:
        for u, v, p, q in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "p", "q"))):
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
            weight[u], weight[v] = p, q
    degree = {k: weight[k] - 1 + sum(weight[x] for x in own) for k, own in near.items()}
    heap = [(-n, k) for k, n in degree.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        n, k = heapq.heappop(heap)
        if k not in degree or -n != degree[k] or not n:
            continue  # taken, or there again with what it has now
        group = [k, *(x for x in near[k] if x in degree)]
        out += [(x, k, -n) for x in group]
        for x in group:
            del degree[x]
        fallen = set()
        for x in group:
            for y in near[x]:
                if y in degree:
                    degree[y] -= weight[x]
                    fallen.add(y)
        for y in fallen:
            heapq.heappush(heap, (-degree[y], y))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["node", "head", "n"])


def clusters(classes: DataFrame, sets: str, least: float, narrow: bool, count: int, last: int = LAST) -> DataFrame:
    """(node, head, n) of the nodes that some node takes, itself included: of ``classes`` (node, weight, sets), numbered from 0,
    the node with most weight beside it (lowest number on ties) takes what is like it; n is what it took besides one.

    Links are packed once, a byte or two for each, and rounds over them pass numbers of nodes only. Every node that comes before
    all others within two steps takes its neighbours at once, which gives the sequential order. Links between nodes that are
    left are packed anew when they are fewer than half; the last million is one task's.
    """
    blocks = blocks_of(count)
    size = -(-count // blocks)
    block = F.floor(F.col("node") / size).cast("int")
    own = packed(classes.select("node", F.col(sets).alias("set")), block, blocks)

    def compare(i, left, j, right):
        order, beside = (np.argsort(_column(t, "node").to_numpy()) for t in (left, right))
        x, y = (sides(_column(t, "set").take(pa.array(at)), narrow) for t, at in ((left, order), (right, beside)))
        yield from _gathered(i, j, ((u, v) if i != j else (u[u < v], v[u < v]) for u, v, _ in x.similar(y, least)))

    def start(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            node, weight = (batch.column(c).to_numpy() for c in ("node", "weight"))
            for b in np.unique(node // size).tolist():
                at = node // size == b
                held.setdefault(b, np.zeros(size, np.int64))[node[at] % size] = weight[at]
        for b, weight in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int64()), *(pa.array([(weight if c == "weight" else np.zeros_like(weight)).tobytes()], pa.binary()) for c in STATE)], names=["block", "total", *STATE])

    repack = lambda i, j, u, v, x, y: _gathered(i, j, [(u, v)])
    links = stored(met(own, blocks, compare, LINKS), "links")
    held = links.agg(F.sum("links")).first()[0] or 0
    state = stored(classes.select("node", "weight").repartition(blocks, block).mapInArrow(start, "block int, total bigint, " + ", ".join(f"{c} binary" for c in STATE)), "state")
    while held > last:
        state = _spread(links, state, "weight", True, size, blocks, _ranked)
        left = state.agg(F.sum("total")).first()[0] // 2  # links left, each counted by the weights it joins
        if left < held // 2:
            before, links = links, stored(_alive(links, state, repack, LINKS), "links")
            dropped(before)
            held = links.agg(F.sum("links")).first()[0] or 0
        if held <= last:
            break
        for of, update in (("rank", _one), ("one", _lead), ("lead", _taken)):
            state = _spread(links, state, of, False, size, blocks, update)

    def named(i, j, u, v, x, y):
        yield pa.RecordBatch.from_arrays([pa.array(u + i * size), pa.array(v + j * size), pa.array(x[u]), pa.array(y[v])], names=["u", "v", "p", "q"])

    def told(batches):
        for r in _batches(batches):
            weight, head = _numbers(r["weight"]), _numbers(r["head"])
            at = np.flatnonzero((weight > 0) | (head > 0))
            yield pa.RecordBatch.from_arrays([pa.array(at + r["block"] * size), pa.array(weight[at]), pa.array(NUMBERS - (head[at] & NUMBERS)), pa.array(head[at] >> 32)], names=["node", "weight", "head", "n"])

    rest = stored(_alive(links, state, named, "u bigint, v bigint, p bigint, q bigint").repartition(1).mapInArrow(_finished, "node bigint, head bigint, n bigint"), "taken")
    known = stored(state.mapInArrow(told, "node bigint, weight bigint, head bigint, n bigint"), "taken")
    dropped(links)
    dropped(state)
    alone = known.where("n = 0 and weight > 1").join(rest, "node", "left_anti").select("node", F.col("node").alias("head"), (F.col("weight") - 1).alias("n"))
    return known.where("n > 0").select("node", "head", "n").union(rest).union(alone)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, to be read often and dropped."""
    path = f"{shared_folder(df.sparkSession, 'signalspark-shared')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def dropped(df: DataFrame) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
