"""The most similar vectors of every vector, by randomly rotated one-bit codes in cells.

Centroids are fitted on a bounded sample; every vector is indexed in the cell
of its nearest centroid as the packed signs of its rotated residual, with the
scalars that correct the estimate: the residual's length and how well the code
keeps its direction. A query looks into the cells nearest to it and into every
cell whose centre is close enough for a neighbour at the required similarity.
Inner products are estimated from the packed bits, unpacked to signs for one
matrix product a block of queries, and the scalars; error bounds choose the
vectors that are reranked in double precision.

The cells' number follows the number of vectors, so a cell holds about
``cell_rows`` whatever the density; queries of a busy cell are split over salts
that each read the cell's codes. Equal vectors are indexed once and handed back
to their nodes afterwards. The centroids are at most ``max_cells`` rows, which
bounds what is sent to every executor.

Defined cases: null vectors, those of another length, with a value that is not
finite or all zero are left out; repeated rows of a node count once; ties in
similarity go to the lesser node id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora import workspace

_EPSILON = 2.2  # width of the error bounds, in deviations of the estimate


def usable(vectors: DataFrame, dim: int, node: str = "node_id", vector: str = "vector") -> DataFrame:
    """(node_id, vector) once for each node with a usable vector."""
    v = F.col(vector)
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        vectors.where(F.col(node).isNotNull() & F.coalesce(fine, F.lit(False)))
        .select(F.col(node).alias("node_id"), v.cast("array<float>").alias("vector"))
        .groupBy("node_id")
        .agg(F.min("vector").alias("vector"))
    )


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, cells: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(sample, len(sample) // 4096 + 1)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 1e-9, sums / np.maximum(n, 1e-9), c)
    return c


class Codes:
    """One-bit codes of unit vectors about a centre, and the estimates they allow."""

    def __init__(self, points: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.centre, self.turn, self.dim = centre, turn, points.shape[1]
        rest = points - centre
        self.length = np.linalg.norm(rest, axis=1).astype(np.float32)
        unit = (rest / np.maximum(self.length, 1e-12)[:, None]) @ turn
        self.words = np.packbits(unit >= 0, axis=1, bitorder="little")
        kept = np.maximum(np.abs(unit).sum(1) / np.sqrt(self.dim), 1e-6)  # <code, unit residual>
        self.fix = (self.length / kept).astype(np.float32)
        self.along = (points @ centre - centre @ centre).astype(np.float32)  # <point - centre, centre>
        spread = np.sqrt(np.maximum(1 - kept**2, 0)) / kept / np.sqrt(self.dim - 1)
        self.wide = (_EPSILON * spread * self.length).astype(np.float32)

    def signs(self) -> np.ndarray:
        """The packed bits as +-1 / sqrt(dim), for a matrix product with whole blocks of queries."""
        bits = np.unpackbits(self.words, axis=1, count=self.dim, bitorder="little").astype(np.float32)
        return (2 * bits - 1) / np.float32(np.sqrt(self.dim))

    def bounds(self, queries: np.ndarray, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products with all points, and half-widths of their bounds."""
        rest = queries - self.centre
        length = np.linalg.norm(rest, axis=1).astype(np.float32)
        est = (rest @ self.turn).astype(np.float32) @ (self.signs() if signs is None else signs).T
        est *= self.fix[None, :]
        est += (queries @ self.centre).astype(np.float32)[:, None]
        est += self.along[None, :]
        return est, length[:, None] * self.wide[None, :] + np.float32(1e-6)


def search_cell(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, qs: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, least: float, block: int = 4_000_000) -> pd.DataFrame:
    """The k most similar points (ids, unit vectors) of a cell for each query, of those of at least ``least``."""
    out = []
    codes = Codes(x, centre, turn)
    signs = codes.signs()
    own = {key: j for j, key in enumerate(ids)}
    step = max(1, block // max(1, len(x)))
    for a in range(0, len(qs), step):
        q, qid = qs[a : a + step], qids[a : a + step]
        est, width = codes.bounds(q, signs)
        row, col = np.nonzero(est + width >= least)
        same = np.array([own.get(key, -1) for key in qid])
        other = same[row] != col
        row, col = row[other], col[other]
        # of a query's candidates those that can be among its k best: not under the k-th best lower bound
        low = est[row, col] - width[row, col]
        order = np.lexsort((-low, row))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = np.full(len(q), -np.inf)
        at = place == k - 1
        kth[row[order][at]] = low[order][at]
        fit = est[row, col] + width[row, col] >= kth[row] - 1e-6
        row, col = row[fit], col[fit]
        sims = np.concatenate([np.einsum("ij,ij->i", q[row[s : s + 200_000]], x[col[s : s + 200_000]]) for s in range(0, len(row), 200_000)]) if len(row) else np.zeros(0)
        good = sims >= least - 1e-12
        row, col, sims = row[good], col[good], sims[good]
        order = np.lexsort((ids[col], -sims, row))
        row, col, sims = row[order], col[order], sims[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((qid[row[top]], ids[col[top]], sims[top]))
    key, other, sim = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
    # plain objects: frames of strings put together are in pieces, which Arrow does not take for a column
    return pd.DataFrame({"key": pd.Series(key, dtype=object), "other": pd.Series(other, dtype=object), "sim": sim})


def nearest(
    nodes: DataFrame, *, k: int = 5, least: float = 0.8, cell_rows: int = 512, probes: int = 12, reach: float | None = None,
    max_cells: int = 8192, sample_rows: int = 20_000, queries_per_task: int = 20_000, block: int = 4_000_000,
) -> DataFrame:
    """(key, other, sim): for each row of (key string, vector array<float>) its k most similar others of at least ``least``.

    ``reach`` is the similarity of a query to a cell's centre from which the
    cell is looked into besides the ``probes`` nearest; ``sample_rows`` bounds
    the sample the centroids are fitted on.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    schema = "key string, other string, sim double"
    if not total:
        return spark.createDataFrame([], schema)
    reach = 0.75 * least if reach is None else reach
    share = min(1.0, sample_rows / total)
    chosen = nodes.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1_000_000)) < share * 1_000_000).select("vector").limit(2 * sample_rows)
    sample = np.array([r.vector for r in chosen.collect()] or [nodes.first().vector], np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    cells = int(min(max_cells, max(1, total // cell_rows)))
    centre = centroids(sample, cells)
    turn = rotation(sample.shape[1])
    held = spark.sparkContext.broadcast((centre.astype(np.float32), turn))
    probes = min(probes, len(centre))
    # rows handled at once: some thirty for each cell, within a matrix of eight million similarities
    chunk = max(256, min(max(512, 24 * len(centre) // probes), 8_000_000 // len(centre)))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value[0].astype(np.float64)
        for b in batches:
            if not len(b):
                continue
            m, keys = np.array(b.vector.tolist(), np.float32), b.key.to_numpy(object)
            for a in range(0, len(b), chunk):
                part = m[a : a + chunk]
                sims = _unit(part) @ c.T
                floor = np.partition(sims, -probes, axis=1)[:, -probes]
                row, cell = np.nonzero(sims >= np.minimum(floor, reach)[:, None])
                point = sims.argmax(1)[row] == cell
                order = np.argsort(cell, kind="stable")
                row, cell, point = row[order], cell[order], point[order]
                edge = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
                spans = list(zip(edge[:-1], edge[1:]))
                # one row a cell holds all that look into it: their keys, whether they are at home in it, their vectors
                yield pd.DataFrame(
                    {
                        "cell": cell[edge[:-1]].astype(np.int32),
                        "n": np.diff(edge),
                        "keys": [keys[a + row[i:j]] for i, j in spans],
                        "points": [point[i:j].astype(np.uint8).tobytes() for i, j in spans],
                        "vectors": [part[row[i:j]].tobytes() for i, j in spans],
                    }
                )

    looked = nodes.select("key", "vector").mapInPandas(assign, "cell int, n bigint, keys array<string>, points binary, vectors binary")
    # how many look into each cell, by the sample; it decides how a busy cell is split, not what is found
    asks = np.zeros(len(centre))
    for some in np.array_split(sample, len(sample) // 4096 + 1):
        sims = some @ centre.T
        asks += (sims >= np.minimum(np.partition(sims, -probes, axis=1)[:, -probes], reach)[:, None]).sum(0)
    asks *= total / max(1, len(sample))
    busy = {int(c): int(-(-asks[c] // queries_per_task)) for c in np.flatnonzero(asks > queries_per_task)}
    salts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in busy.items() for x in kv)), F.col("cell")), F.lit(1)) if busy else F.lit(1)
    # a row asks in one part of its cell only; its points are needed in every part
    parts = looked.withColumn("own", F.pmod(F.xxhash64(F.element_at("keys", 1)), salts).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    parts = parts.select("cell", "salt", (F.col("own") == F.col("salt")).alias("asks"), "keys", "points", "vectors")

    def search(cell_salt: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c, t = held.value
        keys = np.concatenate([np.asarray(x, object) for x in rows["keys"]])
        point = np.frombuffer(b"".join(rows["points"]), np.uint8).astype(bool)
        asks = np.repeat(rows["asks"].to_numpy(bool), [len(x) for x in rows["keys"]])
        x = np.frombuffer(b"".join(rows["vectors"]), np.float32).reshape(len(keys), -1)
        if not point.any() or not asks.any():
            return pd.DataFrame({"key": pd.Series([], dtype=object), "other": pd.Series([], dtype=object), "sim": np.zeros(0)})
        return search_cell(keys[point], _unit(x[point]), keys[asks], _unit(x[asks]), c[cell_salt[0]].astype(np.float64), t, k, least, block)

    found = parts.groupBy("cell", "salt").applyInPandas(search, schema)
    best = Window.partitionBy("key").orderBy(F.desc("sim"), "other")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def neighbour_pairs(vectors: DataFrame, *, dim: int = 64, k: int = 5, least: float = 0.8, salts: int = 16, **how) -> DataFrame:
    """(node_a, node_b) with node_a < node_b where one is among the k most similar of the other and they are similar enough."""
    nodes = workspace.materialise(usable(vectors, dim).withColumn("hash", F.xxhash64("vector")), "nodes")
    place = F.row_number().over(Window.partitionBy("hash").orderBy("node_id"))
    # of a group of equal vectors no more than k + 1 nodes can be anyone's neighbours
    head = nodes.select("hash", "node_id").withColumn("place", place).where(F.col("place") <= k + 1)
    heads = workspace.materialise(head.groupBy("hash").agg(F.min("node_id").alias("key"), F.sort_array(F.collect_list("node_id")).alias("nodes")), "heads")
    ones = nodes.join(heads.select("hash", F.col("key").alias("node_id")), ["hash", "node_id"]).select(F.col("node_id").alias("key"), "vector")
    found = nearest(ones, k=k, least=least, **how)
    groups = heads.select("key", "nodes")
    # a lone node's neighbours: those of its vector, each group giving its first nodes
    near = found.join(groups.select(F.col("key").alias("other"), "nodes"), "other").select("key", "sim", F.explode("nodes").alias("node_b"))
    own = groups.where(F.size("nodes") > 1).select("key", F.lit(1.0).alias("sim"), F.explode("nodes").alias("node_b"))
    lists = near.unionByName(own).groupBy("key").agg(F.collect_list(F.struct((-F.col("sim")).alias("d"), "node_b")).alias("near"))
    # members of a group read its list; a large group is spread over salts
    lists = heads.select("hash", "key").join(lists, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    members = nodes.select("hash", "node_id", F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int").alias("salt"))
    first = F.slice(F.array_sort(F.filter("near", lambda x: x["node_b"] != F.col("node_id"))), 1, k)
    pairs = members.join(lists, ["hash", "salt"]).select("node_id", F.explode(first).alias("n")).select("node_id", F.col("n.node_b").alias("node_b"))
    return pairs.select(F.least("node_id", "node_b").alias("node_a"), F.greatest("node_id", "node_b").alias("node_b")).distinct()
