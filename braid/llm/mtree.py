"""Exact top-k by inner product with M-trees.

Integer vectors are lifted by one component to a common length, after which a larger
inner product with a query is a smaller Euclidean distance, and a metric tree applies.
Candidates are dealt by a hash of their id to trees of bounded size, so copies of one
vector spread over all trees. A tree's pages are metric nodes: routing object, covering
radius, and the distance of each entry to its parent's routing object. The search goes
best first; a stored parent distance rules out entries by the triangle inequality
before their own distance is computed. Each query starts from the bound that a bounded
sample of candidates gives it. Queries come in chunks; every chunk meets every tree.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braid.llm.common import materialize

PAGE, FANOUT, TREE, CHUNK, BLOCK = 128, 32, 8192, 1024, 256
#: Candidates whose scores give each query its first bound.
BOUND_SAMPLE = 1024


def integer_vectors(df: DataFrame, factor: int = 64) -> DataFrame:
    """vec_id and v, floor(factor * component) as long; vectors null, empty or with null or non-finite components are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))).alias("v"))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as they are: int64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _exactly(v: np.ndarray, top: float) -> np.ndarray:
    """Integers in a float type that holds their inner products: double below 2**53, else the 64-bit mantissa of the long double."""
    return v.astype(np.float64 if top < 2.0**53 else np.longdouble)


def _whole(score: np.ndarray) -> np.ndarray:
    """Scores as longs; beyond their range, the nearest."""
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in score], np.int64) if score.dtype == np.longdouble else score.astype(np.int64)


class Node:
    """A page: members of a leaf, or child nodes; ``far`` is the distance of each to this node's routing object."""

    __slots__ = ("pivot", "radius", "far", "children", "members")

    def __init__(self, pivot: np.ndarray) -> None:
        self.pivot, self.radius, self.far, self.children, self.members = pivot, 0.0, np.zeros(0), [], np.zeros(0, np.int64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def build(points: np.ndarray, rng: np.random.Generator, members: np.ndarray | None = None, pivot: np.ndarray | None = None) -> Node:
    """M-tree over lifted points: objects go to the nearest of sampled routing objects until a page holds them."""
    members = np.arange(len(points)) if members is None else members
    node = Node(points[members[0]] if pivot is None else pivot)
    far = _distance(points[members], node.pivot[None])[:, 0]
    node.radius = float(far.max(initial=0))
    if len(members) <= PAGE:
        node.members, node.far = members, far
        return node
    ways = min(FANOUT, -(-len(members) // PAGE))
    chosen = points[rng.choice(members, ways, replace=False)]
    nearest = _distance(points[members], chosen).argmin(1)
    if np.bincount(nearest, minlength=ways).max() > 0.9 * len(members):  # copies: any split is as good
        nearest = np.arange(len(members)) % ways
    for i in range(ways):
        if (nearest == i).any():
            node.children.append(build(points, rng, members[nearest == i], chosen[i]))
    node.far = _distance(np.stack([c.pivot for c in node.children]), node.pivot[None])[:, 0]
    return node


def pages(root: Node, ids: np.ndarray, vectors: np.ndarray):
    """(page, parent, pivot, radius, parent distance, ids, vectors, distances) of each node, parents first."""
    waiting, number = [(root, -1, 0.0)], 0
    while waiting:
        node, parent, away = waiting.pop(0)
        yield number, parent, node.pivot, node.radius, away, ids[node.members], vectors[node.members], node.far if not node.children else np.zeros(0)
        waiting += [(c, number, float(d)) for c, d in zip(node.children, node.far)]
        number += 1


def search(tree: list[dict], exact: np.ndarray, own: np.ndarray, k: int, top: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Best k (scores, ids) in the tree for a block of queries (``_exactly``); -inf fills what is missing. Also the distances computed.

    ``bound``: scores below it can't be among a query's k best; ``top``: squared length of all lifted candidates.
    """
    n, queries = len(exact), exact.astype(np.float64)
    square = (queries * queries).sum(1) + top
    scores, ids = np.full((n, k), -np.inf, exact.dtype), np.full((n, k), np.iinfo(np.int64).max)
    bound = bound.copy()
    slack = 1e-6 * np.sqrt(square)
    computed = 0

    def reach() -> np.ndarray:
        """Distance at which a candidate with the bound's score lies, and a little more."""
        return np.where(np.isfinite(bound), np.sqrt(np.maximum(square - 2 * np.where(np.isfinite(bound), bound, 0), 0)) + slack, np.inf)

    def away(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        nonlocal computed
        computed += len(rows) * len(pivots)
        return np.sqrt(np.maximum(square[rows][:, None] - 2 * queries[rows] @ pivots[:, :-1].T, 0))

    every = np.arange(n)
    d = away(every, tree[0]["pivot"][None])[:, 0]
    heap, turn = [(0.0, 0, 0, every, d)], 0
    while heap:
        _, _, number, rows, d = heapq.heappop(heap)
        page, most = tree[number], reach()
        near = d - page["radius"] <= most[rows]
        rows, d = rows[near], d[near]
        if not len(rows):
            continue
        if page["children"]:
            # parent distances first: |d(q, parent) - d(child, parent)| - radius is a lower bound
            maybe = np.abs(d[:, None] - page["far"][None]) - page["radii"][None] <= most[rows][:, None]
            for j in np.flatnonzero(maybe.any(0)):
                here = rows[maybe[:, j]]
                dj = away(here, tree[page["children"][j]]["pivot"][None])[:, 0]
                turn += 1
                heapq.heappush(heap, (float((dj - page["radii"][j]).min()), turn, page["children"][j], here, dj))
            continue
        maybe = np.abs(d[:, None] - page["far"][None]) <= most[rows][:, None]
        able, cols = maybe.any(1), maybe.any(0)
        rows = rows[able]
        if not len(rows):
            continue
        computed += len(rows) * int(cols.sum())
        s, who = exact[rows] @ page["vectors"][cols].T, page["ids"][cols]
        s[own[rows][:, None] == who[None]] = -np.inf
        better = (s >= np.maximum(bound[rows], scores[rows, -1])[:, None]) & np.isfinite(s)
        some = better.any(1)
        rows, s = rows[some], np.where(better[some], s[some], -np.inf)
        if not len(rows):
            continue
        both = np.hstack([scores[rows], s])
        names = np.hstack([ids[rows], np.broadcast_to(who, s.shape)])
        names[np.isneginf(both)] = np.iinfo(np.int64).max
        order = np.lexsort((names, -both), axis=-1)[:, :k]
        scores[rows], ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        bound[rows] = np.maximum(bound[rows], scores[rows, -1])
    return scores, ids, computed


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products with all other rows of ``vectors``.

    Both have vec_id and v (long arrays, see ``integer_vectors``); ties go to the
    smaller vec_id; a query has fewer rows if fewer candidates exist. A query is not
    its own candidate, by vec_id. Vectors of different lengths don't meet. A repeated
    query row is one query; repeated candidate rows are candidates each.
    Inner products are exact as far as they fit into a long; beyond, the score is the
    nearest long.
    """
    vectors = materialize(vectors.withColumn("dim", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), "vectors")
    facts = vectors.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()  # one row for each length
    if not facts:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    tops, n = {r["dim"]: float(r["top"]) for r in facts}, sum(r["n"] for r in facts)
    trees = max(1, -(-n // TREE))
    asked = queries.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"))
    most = asked.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    chunks = max(1, -(-most[0] // CHUNK))
    wide = {d: max(top, float(np.sqrt(top) * np.sqrt(most[1] or 0.0))) for d, top in tops.items()}  # no inner product is larger
    sample = vectors.where(F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(1)), 11) / F.lit(float(1 << 53)) < BOUND_SAMPLE / n).limit(2 * BOUND_SAMPLE).collect()  # bounded; any rows do
    seen = {d: (np.array([r["v"] for r in sample if r["dim"] == d], np.int64), np.array([r["vec_id"] for r in sample if r["dim"] == d])) for d in tops}

    def plant(table: pa.Table) -> pa.Table:
        whole, ids = _rows(table.column("v")), table.column("vec_id").to_numpy()
        dim, tree = table.column("dim")[0].as_py(), table.column("tree")[0].as_py()
        v = whole.astype(np.float64)
        lifted = np.hstack([v, np.sqrt(np.maximum(tops[dim] - (v * v).sum(1), 0))[:, None]])
        out = list(pages(build(lifted, np.random.default_rng(tree)), ids, whole))
        blob = [pa.array([p[c].tobytes() for p in out], pa.binary()) for c in (2, 5, 6, 7)]
        return pa.table(
            [pa.array([dim] * len(out), pa.int32()), pa.array([tree] * len(out), pa.int32()), pa.array([p[0] for p in out], pa.int32()), pa.array([p[1] for p in out], pa.int32()),
             blob[0], pa.array([p[3] for p in out]), pa.array([p[4] for p in out]), *blob[1:]],
            names=["dim", "tree", "page", "parent", "pivot", "radius", "away", "ids", "vectors", "far"],
        )

    dealt = vectors.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int").alias("tree"))
    schema = "dim int, tree int, page int, parent int, pivot binary, radius double, away double, ids binary, vectors binary, far binary"
    nodes = materialize(dealt.groupBy("dim", "tree").applyInArrow(plant, schema), "mtree-pages")

    def find(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and held.num_rows:
            rows = sorted(held.to_pylist(), key=lambda r: r["page"])
            dim, tree = rows[0]["dim"], []
            for r in rows:
                tree.append({"pivot": np.frombuffer(r["pivot"]), "radius": r["radius"], "ids": np.frombuffer(r["ids"], np.int64), "vectors": _exactly(np.frombuffer(r["vectors"], np.int64).reshape(-1, dim), wide[dim]), "far": np.frombuffer(r["far"]), "children": []})
                if r["parent"] >= 0:
                    tree[r["parent"]]["children"].append(r["page"])
            for r, node in zip(rows, tree):
                if node["children"]:
                    node["far"] = np.array([rows[c]["away"] for c in node["children"]])
                    node["radii"] = np.array([rows[c]["radius"] for c in node["children"]])
            q, names = _exactly(_rows(asked.column("v")), wide[dim]), asked.column("query_id").to_numpy()
            known, who = seen[dim]
            for a in range(0, len(q), BLOCK):
                part, own = q[a : a + BLOCK], names[a : a + BLOCK]
                bound = np.full(len(part), -np.inf)
                if len(known) > k:
                    s = part @ known.astype(part.dtype).T
                    s[own[:, None] == who[None]] = -np.inf
                    bound = np.partition(s, -k, 1)[:, -k].astype(np.float64)
                    if q.dtype == np.longdouble:  # rounded down
                        bound -= 1e-12 * np.sqrt((part * part).sum(1).astype(np.float64) * tops[dim])
                scores, ids, _ = search(tree, part, own, k, tops[dim], bound)
                real = np.isfinite(scores)
                out["query_id"].append(np.broadcast_to(own[:, None], scores.shape)[real])
                out["vec_id"].append(ids[real])
                out["score"].append(_whole(scores[real]))
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for c, x in out.items()})

    by_chunk = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    for_each = nodes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    keys = ["dim", "tree", "chunk"]
    found = by_chunk.groupBy(*keys).cogroup(for_each.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
