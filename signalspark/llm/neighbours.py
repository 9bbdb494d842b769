"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search (operator 1).

The tree is fitted on a bounded sample; every vector is stored in a leaf, and leaves that get many vectors are split by
k-means again, each by a bounded sample of its own, so that leaves stay small as tables grow. A query walks the tree with a
priority queue, the most similar centroid first, and visits leaves in the order in which they come out. How many leaves it
visits is calibrated: a fixed number of held queries is compared with every vector, and visits widen until the walks reach
the leaves of their true neighbours.

Parallel vectors are one entry with their smallest ids, so that their ties are exact; leaves are stored in blocks of bounded
size, and queries meet the blocks of the leaves that they visit in a join.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, shuffle_parts, table

#: Vectors that the tree is fitted on, its fan-out, sampled vectors of a leaf, vectors of a stored block.
SAMPLE, FANOUT, LEAF, BLOCK = 20_000, 8, 64, 2048
#: Vectors of a leaf beyond which it is split, by a sample of as many; bytes of centroids at which splitting ends.
SPLIT, TREE_BYTES = 4096, 128_000_000
#: Calibration: held queries, and the share of their neighbours whose leaves the walks must reach.
HELD, RECALL = 200, 0.97
#: Scores that agree to so many decimals are ties.
DECIMALS = 12


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cluster(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Cluster of each row, by k-means on unit vectors; empty clusters stay empty."""
    centre = x[rng.choice(len(x), k, replace=False)]
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), centre)
    return own


class Tree:
    """Centroids and children of every node; leaves are numbered apart."""

    def __init__(self, x: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF, seed: int = 7):
        rng, x = np.random.default_rng(seed), unit(x)
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        centres, todo, self.leaves = [x.mean(0)], [(0, np.arange(len(x)))], 0
        while todo:
            node, rows = todo.pop()
            own = cluster(x[rows], min(fanout, len(rows)), rng) if len(rows) > leaf else np.zeros(len(rows), int)
            groups = [rows[own == c] for c in np.unique(own)]
            if len(groups) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for group in groups:
                total = x[group].sum(0)
                centres.append(total / max(np.linalg.norm(total), 1e-12))
                self.children.append([])
                self.leaf.append(-1)
                self.children[node].append(len(centres) - 1)
                todo.append((len(centres) - 1, group))
        self.centre = np.array(centres)
        self.visits = self.leaves

    def attach(self, leaf: int, other: Tree) -> None:
        """Puts another tree in a leaf's place; its first leaf takes over the leaf's number."""
        node, shift = self.leaf.index(leaf), len(self.leaf)
        place = lambda k: node if k == 0 else shift + k - 1
        number = [leaf, *range(self.leaves, self.leaves + other.leaves - 1)]
        self.children[node], self.leaf[node] = [place(k) for k in other.children[0]], number[other.leaf[0]] if other.leaf[0] >= 0 else -1
        self.children += [[place(k) for k in kids] for kids in other.children[1:]]
        self.leaf += [number[k] if k >= 0 else -1 for k in other.leaf[1:]]
        self.centre = np.vstack([self.centre, other.centre[1:]])
        self.leaves += other.leaves - 1
        self.visits = self.leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit vector, by the nearest child at every node."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = np.array(self.children[node])
                own = (x[rows] @ self.centre[kids].T).argmax(1)
                todo += [(int(kid), rows[own == c]) for c, kid in enumerate(kids)]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of a best-bin-first walk, at most ``most``."""
        near, queue, out = self.centre @ q, [(-1.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            for kid in self.children[node]:
                heapq.heappush(queue, (-float(near[kid]), kid))
        return out

    def calibrate(self, queries: np.ndarray, near: list[list[int]], recall: float = RECALL) -> None:
        """Sets ``visits``: as few leaves as reach ``recall`` of the leaves ``near`` of the queries' true neighbours."""
        depth = []
        for q, leaves in zip(unit(queries), near):
            place = {leaf: n + 1 for n, leaf in enumerate(self.visit(q, self.leaves))}
            depth += [place[leaf] for leaf in leaves]
        if depth:
            self.visits = int(np.quantile(depth, recall, method="higher"))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of the commonest length whose components are finite and not all zero."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (length["n"] if length else -1))


def _pieces(tree, columns: list[str], entries: DataFrame) -> DataFrame:
    """``columns`` of entries with their leaf."""

    def assign(batches):
        for batch in batches:
            leaf = tree.value.assign(unit(_vectors(batch.column("v")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(leaf, pa.int64())], [*columns, "leaf"])

    kinds = dict(entries.dtypes)
    return entries.mapInArrow(assign, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", leaf bigint")


def grown(entries: DataFrame, n: int, sample: int, split: int) -> Tree:
    """The tree over all ``n`` entries (c1, c2, v), leaves of more than ``split`` entries being split again and again."""
    spark = entries.sparkSession
    share = int(min(1.0, sample / n) * (1 << 20))
    some = entries.where(F.pmod(F.xxhash64("c1"), F.lit(1 << 20)) < share) if n > sample else entries
    tree = Tree(np.array([r["v"] for r in some.orderBy("c1", "c2").select("v").collect()], float).reshape(-1, len(entries.first()["v"])))

    def fit(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows.column("c2").to_numpy(), rows.column("c1").to_numpy()))
        below = Tree(_vectors(rows.column("v").combine_chunks())[order])
        return pa.table({"leaf": rows.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(below)], pa.binary())})

    while n > split and tree.centre.nbytes < TREE_BYTES:
        placed = _pieces(spark.sparkContext.broadcast(tree), ["c1", "c2", "v"], entries)
        sizes = placed.groupBy("leaf").count().where(F.col("count") > split)  # fewer than n / split rows
        room = int((TREE_BYTES - tree.centre.nbytes) / (tree.centre[0].nbytes * 2.5 * split / LEAF)) + 1
        large = table(sizes.orderBy(F.desc("count"), "leaf").limit(room), "large")  # the largest leaves, as far as there is room
        chosen = placed.join(F.broadcast(large), "leaf").where(F.pmod(F.xxhash64("c2", "c1"), F.lit(1 << 20)) < F.lit(split << 20) / F.col("count"))
        below = chosen.select("leaf", "c1", "c2", "v").groupBy("leaf").applyInArrow(fit, "leaf bigint, tree binary").collect()
        drop(large)
        before = tree.leaves
        for r in sorted(below, key=lambda r: r["leaf"]):
            tree.attach(r["leaf"], pickle.loads(r["tree"]))
        if tree.leaves == before:
            break
    return tree


def true_leaves(entries: DataFrame, stored: DataFrame, k: int, held: int) -> tuple[np.ndarray, list[list[int]]]:
    """``held`` of the entries, and the leaves of the ``k`` nearest other entries of each, by comparison with every entry."""
    rows = entries.orderBy(F.xxhash64("c2", "c1"), "c1", "c2").limit(held).select("c1", "c2", "v").collect()
    asked = np.array([r["v"] for r in rows], float)
    shared = entries.sparkSession.sparkContext.broadcast((unit(asked), {(r["c1"], r["c2"]): n for n, r in enumerate(rows)}))

    def compare(batches):
        queries, own = shared.value
        best = np.full((len(queries), k), -2.0)
        leaves = np.zeros((len(queries), k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            near = queries @ unit(_vectors(batch.column("v"))).T
            for at, key in enumerate(zip(batch.column("c1").to_pylist(), batch.column("c2").to_pylist())):
                if key in own:
                    near[own[key], at] = -2.0
            both = np.hstack([best, near])
            names = np.hstack([leaves, np.tile(batch.column("leaf").to_numpy(), (len(queries), 1))])
            top = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, leaves = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        at = np.repeat(np.arange(len(queries)), k)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best.ravel()), pa.array(leaves.ravel())], ["query", "score", "leaf"])

    found = stored.select("c1", "c2", "leaf", "v").mapInArrow(compare, "query bigint, score double, leaf bigint").where("score > -1.5")
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "leaf"))).where(F.col("n") <= k)
    near: list[list[int]] = [[] for _ in rows]
    for r in found.select("query", "leaf").collect():
        near[r["query"]].append(r["leaf"])
    return asked, near


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, split: int = SPLIT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose vec_id is divisible by ``every``.

    ``vectors`` has vec_id and embedding; nearness is the cosine in double precision, ties (to 12 decimals) go to the smaller
    vec_id, however many there are. A row isn't its own neighbour, equal vectors of other rows are. Vectors that are null,
    zero, of another length than the commonest or hold null or non-finite components take no part, nor do rows without id; a
    repeated (vec_id, vector) counts once. Other columns are ignored. The tree is fitted on at most about ``sample`` different
    vectors, and on about ``split`` more in each leaf that holds more. Empty tables give no rows.
    """
    spark, parts = vectors.sparkSession, shuffle_parts(vectors.sparkSession)
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    most = F.array_max(F.transform("v", lambda x: F.abs(x).cast("double")))
    direction = F.transform("v", lambda x: F.floor(x.cast("double") / F.col("most") * 10.0**DECIMALS + 0.5))
    marked = usable(vectors).withColumn("most", most).withColumn("way", direction).select("vec_id", "v", F.xxhash64("way").alias("c1"), F.xxhash64(F.lit(1), "way").alias("c2"))
    marked = table(marked.distinct(), "vectors")
    # the smallest ids of each direction, from salted groups first
    few = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("vec_id")) <= k + 1
    ids = marked.select("c1", "c2", "vec_id", F.pmod("vec_id", F.lit(64)).alias("salt")).distinct().withColumn("kept", few("c1", "c2", "salt")).where("kept")
    ids = table(ids.withColumn("kept", few("c1", "c2")).where("kept").select("c1", "c2", "vec_id"), "ids")
    firsts = ids.groupBy("c1", "c2").agg(F.min("vec_id").alias("vec_id"))
    entries = table(marked.join(firsts, ["c1", "c2", "vec_id"]).groupBy("c1", "c2", "vec_id").agg(F.min("v").alias("v")), "entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    tree = grown(entries, n, sample, split)
    stored = table(_pieces(spark.sparkContext.broadcast(tree), ["c1", "c2", "vec_id", "v"], entries), "leaves")
    tree.calibrate(*true_leaves(entries, stored, min(k, n - 1), HELD) if n > 1 else (np.zeros((0, 1)), []))
    shared = spark.sparkContext.broadcast(tree)
    columns = ["c1", "c2", "vec_id", "leaf", "v"]

    def walk(batches):
        for batch in batches:
            x = unit(_vectors(batch.column("v"))) if batch.num_rows else np.zeros((0, 1))
            found = [shared.value.visit(q, shared.value.visits) for q in x]
            take = pa.array(np.repeat(np.arange(len(x)), [len(f) for f in found]), pa.int64())
            leaves = pa.array([leaf for f in found for leaf in f], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in columns[:3]), leaves, batch.column("v").take(take)], columns)

    def pack(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            x = _vectors(batch.column("v")) if batch.num_rows else None
            rows = zip(*(batch.column(c).to_pylist() for c in ("leaf", "chunk", "c1", "c2", "vec_id")))
            for r, (leaf, chunk, *own) in enumerate(rows):
                held.setdefault((leaf, chunk), []).append((own, x[r]))
        for (leaf, chunk), got in held.items():
            got.sort(key=lambda g: g[0])
            own = np.array([g[0] for g in got], np.int64)
            block = np.array([g[1] for g in got], float)
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([own.tobytes()], pa.binary()), pa.array([block.tobytes()], pa.binary())], ["leaf", "own", "block"])

    def blocks(df: DataFrame, size: int) -> DataFrame:
        """Rows of each leaf, in chunks of about ``size`` rows, as one row a chunk."""
        chunks = df.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("chunks"))  # one row a leaf
        cut = df.join(F.broadcast(chunks), "leaf").withColumn("chunk", F.pmod(F.xxhash64("c1", "c2"), "chunks"))
        return cut.select("leaf", "chunk", "c1", "c2", "vec_id", "v").repartition(parts, "leaf", "chunk").mapInArrow(pack, "leaf bigint, own binary, block binary")

    queries = marked.where(F.col("vec_id") % every == 0)
    asked = queries.groupBy("c1", "c2").agg(F.min("vec_id").alias("vec_id"), F.min("v").alias("v")).repartition(parts, "c1", "c2")
    kinds = dict(entries.dtypes)
    walked = table(asked.mapInArrow(walk, f"c1 bigint, c2 bigint, vec_id bigint, leaf bigint, v {kinds['v']}"), "walks")
    right = blocks(walked, BLOCK // 8).select("leaf", F.col("own").alias("asked"), F.col("block").alias("q"))

    def compare(batches):
        for batch in batches:
            for own, block, asked_by, q in zip(*(batch.column(c).to_pylist() for c in ("own", "block", "asked", "q"))):
                keys, ask = (np.frombuffer(b, np.int64).reshape(-1, 3) for b in (own, asked_by))
                x, y = (np.frombuffer(b, float).reshape(len(i), -1) for b, i in ((block, keys), (q, ask)))
                size, length = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                near = (y / length[:, None]) @ (x / size[:, None]).T
                some = min(k + 1, len(x))
                least = np.partition(near, len(x) - some, axis=1)[:, len(x) - some]
                at, of = np.nonzero(near >= least[:, None] - 2 * 10.0**-DECIMALS)  # with all ties of the last one
                score = np.clip((y[at] * x[of]).sum(1) / (length[at] * size[of]), -1, 1)
                order = np.lexsort((keys[of, 2], -np.round(score, DECIMALS), at))
                place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
                kept = order[place < some]
                at, of = at[kept], of[kept]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ask[at, 0], ask[at, 1], keys[of, 0], keys[of, 1], keys[of, 2], score[kept])], ["q1", "q2", "c1", "c2", "first", "score"])

    pairs = blocks(stored, BLOCK).join(right, "leaf").select("own", "block", "asked", "q").mapInArrow(compare, "q1 bigint, q2 bigint, c1 bigint, c2 bigint, first bigint, score double")
    tied = F.round("score", DECIMALS)
    best = Window.partitionBy("q1", "q2").orderBy(tied.desc(), "first")
    pairs = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n", "first")
    found = pairs.join(ids, ["c1", "c2"]).withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(tied.desc(), "vec_id"))).where(F.col("n") <= k + 1)
    out = queries.select(F.col("vec_id").alias("query_id"), F.col("c1").alias("q1"), F.col("c2").alias("q2")).distinct().join(found, ["q1", "q2"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(tied.desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
