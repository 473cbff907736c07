"""Operator 7: approximate nearest neighbours by one navigable small-world graph per shard.

Equal vectors are one node. Nodes are dealt to shards of about ``SHARD`` by hash; each shard builds a hierarchical
graph, kept as flat arrays of neighbours, inserting points by the batch and searching for all of a batch in step. All
queries, in blocks of ``BLOCK``, search all shards; the shards' results are merged and nodes become rows again.

The inner product is made a distance by one more component, ``sqrt(longest^2 - |x|^2)``, which queries have as 0.

Defined results: vectors that are null, zero or empty or hold a null or non-finite component take no part, nor do rows
with a null id; vectors are compared with those of their own dimension; a repeated (id, vector) row counts once, and
several vectors of one id are candidates each by itself; ties go to the smaller id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import durable, read_table

SHARD, BLOCK, LINKS, BREADTH = 8192, 8192, 16, 96
_CHUNK = 512


class Graph:
    """``links[l]``: neighbours at level l of each node, filled up with -1; ``entry``: where a search starts."""

    def __init__(self, points: np.ndarray, links: list[np.ndarray], entry: int):
        self.points, self.links, self.entry = points, links, entry

    def search(self, queries: np.ndarray, breadth: int, level: int, start: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For all queries in step, the ``breadth`` nodes of most inner product found at ``level``, best first.

        ``start`` has a node for each query. Ids are -1 where fewer are found.
        """
        q, n = len(queries), limit or len(self.points)
        ids = np.full((q, breadth), -1, np.int32)
        near = np.full((q, breadth), -np.inf, np.float32)
        open_ = np.zeros((q, breadth), bool)
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)
        ids[:, 0], near[:, 0], open_[:, 0] = start, np.einsum("qd,qd->q", queries, self.points[start]), True
        seen[rows, start] = True
        links = self.links[level]
        active = rows
        while len(active):
            best = np.where(open_[active], near[active], -np.inf)
            i = best.argmax(1)
            top = best[np.arange(len(active)), i]
            # Done where nothing is open; the beam holds only the best, so an open node is never worse than it.
            going = top > -np.inf
            active, i = active[going], i[going]
            if not len(active):
                break
            open_[active, i] = False
            new = links[ids[active, i]]
            fresh = (new >= 0) & ~seen[active[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], new[r, c]] = True
            score = np.full(new.shape, -np.inf, np.float32)
            score[r, c] = np.einsum("nd,nd->n", queries[active[r]], self.points[new[r, c]])
            all_near = np.concatenate([near[active], score], 1)
            all_ids = np.concatenate([ids[active], np.where(fresh, new, -1)], 1)
            all_open = np.concatenate([open_[active], fresh], 1)
            keep = np.argpartition(-all_near, breadth - 1, axis=1)[:, :breadth]
            at = np.arange(len(active))[:, None]
            near[active], ids[active], open_[active] = all_near[at, keep], all_ids[at, keep], all_open[at, keep]
        order = np.argsort(-near, axis=1, kind="stable")
        return ids[rows[:, None], order], near[rows[:, None], order]

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        start = np.full(len(queries), self.entry)
        for level in range(len(self.links) - 1, down_to, -1):
            start = self.search(queries, 1, level, start)[0][:, 0]
        return start

    def nearest(self, queries: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search(queries, min(breadth, len(self.points)), 0, self.descend(queries, 0))


def _varied(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1 for none), up to ``most`` that are nearer to it than to one chosen before; then the best of the rest."""
    n, width = candidates.shape
    own = points[np.maximum(candidates, 0)]
    between = own @ own.transpose(0, 2, 1)
    chosen = np.zeros((n, width), bool)
    left = candidates >= 0
    for i in range(width):
        closer = (np.where(chosen, between[:, :, i], -np.inf) > near[:, i, None]).any(1)
        chosen[:, i] = left[:, i] & ~closer & (chosen.sum(1) < most)
    # The chosen come first, then the others, each in their order.
    order = np.argsort(np.where(chosen, 0, np.where(left, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(candidates, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def build(points: np.ndarray, links: int = LINKS, breadth: int = 64, seed: int = 7) -> Graph:
    """The graph of ``points`` (equal lengths, so that the inner product orders as the distance does)."""
    n = len(points)
    levels = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 6)
    order = np.argsort(-levels, kind="stable")  # higher levels first, as the batches of an upper level are then whole
    graph = Graph(points, [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level in range(levels.max(initial=0) + 1)], int(order[0]) if n else 0)
    done = 1
    while done < n:
        batch = order[done : done + min(done, 256)]
        own = points[batch]
        start = np.full(len(batch), graph.entry)
        for level in range(len(graph.links) - 1, -1, -1):
            here = np.flatnonzero(levels[batch] >= level)
            if not len(here):
                start = graph.search(own, 1, level, start)[0][:, 0]
                continue
            ids, near = graph.search(own, breadth, level, start)
            start = ids[:, 0]
            # Points of one batch are candidates of each other.
            mates = own[here] @ own[here].T
            np.fill_diagonal(mates, -np.inf)
            width = min(links, len(here) - 1)
            pick = np.argsort(-mates, axis=1, kind="stable")[:, :width]
            ids = np.concatenate([ids[here], batch[here][pick]], 1)
            near = np.concatenate([near[here], np.take_along_axis(mates, pick, 1)], 1)
            best = np.argsort(-near, axis=1, kind="stable")
            ids, near = np.take_along_axis(ids, best, 1), np.take_along_axis(near, best, 1)
            new = _varied(points, batch[here], ids, near, links)
            table = graph.links[level]
            table[batch[here], :links] = new
            _link_back(points, table, np.repeat(batch[here], links), new.ravel())
        done += len(batch)
    return graph


def _link_back(points: np.ndarray, table: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Adds each source to its target's neighbours; where there are too many, a varied choice stays."""
    real = targets >= 0
    sources, targets = sources[real], targets[real]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    nodes, first, count = np.unique(targets, return_index=True, return_counts=True)
    for at in range(0, len(nodes), 1024):
        some, f, c = nodes[at : at + 1024], first[at : at + 1024], count[at : at + 1024]
        extra = np.full((len(some), c.max()), -1, np.int32)
        i = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        extra[np.repeat(np.arange(len(some)), c), i] = sources[np.repeat(f, c) + i]
        extra[(extra[:, :, None] == table[some][:, None, :]).any(2)] = -1
        both = np.concatenate([table[some], extra], 1)
        near = np.where(both >= 0, np.einsum("nkd,nd->nk", points[np.maximum(both, 0)], points[some]), -np.inf)
        best = np.argsort(-near, axis=1, kind="stable")
        both, near = np.take_along_axis(both, best, 1), np.take_along_axis(near, best, 1)
        most = table.shape[1]
        over = (both >= 0).sum(1) > most
        table[some] = both[:, :most]
        if over.any():
            table[some[over]] = _varied(points, some[over], both[over], near[over], most)


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double), h, h2 (hashes of it) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(finite.isNotNull())
    out = out.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return out.withColumns({"h": F.xxhash64("v"), "h2": F.hash("v")})


def _packed(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(r, np.float64) for r in rows])


def search(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, breadth: int = BREADTH) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its ``k`` nearest others."""
    rows = durable(_valid(df, id_col, vector_col), "vectors")
    nodes = durable(rows.groupBy("h", "h2", F.size("v").alias("dim")).agg(F.min("vec_id").alias("node"), F.min("v").alias("v"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks")), "nodes")
    count = {r[0]: r for r in nodes.groupBy("dim").agg(F.count(F.lit(1)), F.sum("asks")).collect()}  # one row per dimension
    shards = F.create_map(*(F.lit(x) for d, r in count.items() for x in (d, -(-r[1] // shard)))) if count else F.create_map().cast("map<int,int>")
    blocks = F.create_map(*(F.lit(x) for d, r in count.items() for x in (d, max(1, -(-r[2] // BLOCK))))) if count else shards
    of = lambda m, seed: F.pmod(F.xxhash64("h", "h2", F.lit(seed)), F.element_at(m, F.col("dim")).cast("long")).cast("int")
    dealt = nodes.withColumn("shard", of(shards, "shard"))

    def make(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        v = _packed(pdf["v"])
        square = (v**2).sum(1)
        points = np.concatenate([v, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)
        points /= max(np.sqrt(square.max()), 1e-30)
        g = build(points)
        flat = np.concatenate([x.ravel() for x in g.links])
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "entry": [g.entry], "ids": [pdf["node"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()], "points": [points.tobytes()], "levels": [len(g.links)], "links": [flat.tobytes()]})

    graphs = durable(dealt.select("dim", "shard", "node", "v").groupBy("dim", "shard").applyInPandas(make, "dim int, shard int, entry int, ids binary, vectors binary, points binary, levels int, links binary"), "graphs")
    asks = nodes.where("asks = 1").select("dim", of(blocks, "block").alias("block"), "node", "v", F.explode(F.sequence(F.lit(0), (F.element_at(shards, F.col("dim")) - 1).cast("int"))).alias("shard"))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), (F.element_at(blocks, F.col("dim")) - 1).cast("int"))))
    wanted = k + 1

    def ask(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(queries):
            (row,) = graph.itertuples(index=False)
            ids = np.frombuffer(row.ids, np.int64)
            n = len(ids)
            vectors = np.frombuffer(row.vectors, np.float64).reshape(n, -1)
            flat, links, at = np.frombuffer(row.links, np.int32), [], 0
            for level in range(row.levels):
                width = LINKS * (2 if level == 0 else 1)
                links.append(flat[at : at + n * width].reshape(n, width))
                at += n * width
            g = Graph(np.frombuffer(row.points, np.float32).reshape(n, -1), links, row.entry)
            for start in range(0, len(queries), _CHUNK):
                part = queries.iloc[start : start + _CHUNK]
                q = _packed(part["v"])
                scaled = q / np.abs(q).max(1, keepdims=True)
                found, _ = g.nearest(np.concatenate([scaled, np.zeros((len(q), 1))], 1).astype(np.float32), max(breadth, wanted))
                r, c = np.nonzero(found >= 0)
                hit = found[r, c]
                score = np.einsum("nd,nd->n", q[r], vectors[hit])
                order = np.lexsort((ids[hit], -score, r))
                r, hit, score = r[order], hit[order], score[order]
                first = np.searchsorted(r, np.arange(len(q)))
                top = np.arange(len(r)) - first[r] < wanted
                out.append(pd.DataFrame({"asker": part["node"].to_numpy()[r[top]], "node": ids[hit[top]], "score": score[top], "dim": key[0]}))
        return pd.concat(out) if out else pd.DataFrame({"asker": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "dim": pd.Series(dtype="int32")})

    found = spread.groupBy("dim", "shard", "block").cogroup(asks.groupBy("dim", "shard", "block")).applyInPandas(ask, "asker long, node long, score double, dim int")
    best = Window.partitionBy("dim", "asker").orderBy(F.desc("score"), "node")
    found = found.withColumn("_r", F.row_number().over(best)).where(f"_r <= {wanted}").drop("_r")
    # Rows of a node: no more of them than a result can hold are needed, those of least id.
    members = rows.select("vec_id", "h", "h2", F.size("v").alias("dim")).distinct().join(nodes.select("h", "h2", "dim", "node"), ["h", "h2", "dim"]).select("dim", "node", "vec_id")
    few = members.withColumn("_r", F.row_number().over(Window.partitionBy("dim", "node").orderBy("vec_id"))).where(f"_r <= {wanted}").drop("_r")
    # Askers of one node share its results; each leaves itself out.
    lists = found.join(few, ["dim", "node"]).withColumn("_r", F.row_number().over(Window.partitionBy("dim", "asker").orderBy(F.desc("score"), "vec_id"))).where(f"_r <= {wanted}")
    lists = lists.groupBy("dim", "asker").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("list"))
    queries = members.where(F.col("vec_id") % every == 0).select("dim", F.col("node").alias("asker"), F.col("vec_id").alias("query_id"))
    own = queries.join(lists, ["dim", "asker"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return own.select("query_id", F.posexplode("list").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 20 nearest: query_id, rank, vec_id, score."""
    return search(read_table(spark, sf_dir, "embeddings"))
