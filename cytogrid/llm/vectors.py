"""Near-duplicate vectors by randomly rotated binary codes with correction factors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytogrid.llm.blocks import pairs_in_groups
from cytogrid.llm.common import components, map_batches
from cytogrid.session import cut_lineage

COSINE = 0.9
#: Vectors of a bucket, on average over a table, and the chance that a pair at the threshold shares none.
BUCKET, MISS = 32, 5e-4
#: Width of confidence bounds, in standard deviations.
SIGMAS = 4.5


def plan(count: int, dimension: int) -> tuple[int, int, int]:
    """(bits of a key, tables, rotations) for so many vectors.

    Keys grow with the logarithm of the count, so buckets stay small; tables follow from ``MISS``.
    """
    bits = max(4, math.ceil(math.log2(max(count, 1) / BUCKET)))
    equal = (1 - math.acos(COSINE) / math.pi) ** bits
    tables = math.ceil(math.log(MISS) / math.log1p(-equal))
    return bits, tables, math.ceil(bits * tables / dimension)


@lru_cache(maxsize=8)
def rotations(dimension: int, count: int) -> np.ndarray:
    """Random orthogonal matrices, the same in every task."""
    rng = np.random.default_rng(20_011)
    out = np.empty((count, dimension, dimension))
    for i in range(count):
        q, r = np.linalg.qr(rng.normal(size=(dimension, dimension)))
        out[i] = q * np.sign(np.diag(r))
    return out


def encode(unit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(signs, factors) of unit vectors under each rotation.

    A code stands for the corner of a cube closest to the rotated vector; its factor is
    their inner product, the sum of absolute values over the root of the dimension.
    """
    turned = np.einsum("rij,nj->nri", rotations(unit.shape[1], count), unit, optimize=True)
    return turned > 0, np.abs(turned).sum(2) / np.sqrt(unit.shape[1])


def keys_of(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each table's key: the next ``bits`` of all rotations' signs in turn."""
    flat = signs.reshape(len(signs), -1)[:, : bits * tables].reshape(len(signs), tables, bits)
    return flat.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def coded(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(row, id, node, dimension, vector) of every row; node is null where nothing can link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, raw = [], [], []
            for values in batch.column(2).to_pylist():
                x = None if values is None or None in values else np.array(values, "<f8")
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    nodes.append(None)
                    sizes.append(None)
                    raw.append(None)
                    continue
                data = x.tobytes()
                nodes.append(hashlib.blake2b(data, digest_size=16).digest())
                sizes.append(len(x))
                raw.append(data)
            columns = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "id", "node", "dimension", "vector"])

    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    return map_batches(rows, work, "row long, id long, node binary, dimension int, vector binary", rows=1024)


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_shared(keys: np.ndarray, left: np.ndarray, right: np.ndarray, table: int) -> np.ndarray:
    """Whether a pair of rows shares no bucket of an earlier table; every pair counts once."""
    if not table:
        return np.ones(len(left), bool)
    return ~(keys[left, :table] == keys[right, :table]).any(1)


def block_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    own = table["own"].to_numpy()
    first, second = table["first"][0].as_py(), table["second"][0].as_py()
    left = np.flatnonzero(own == first)
    return left, left if first == second else np.flatnonzero(own == second), first == second


def upper_pairs(close: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        close &= np.tri(len(left), k=-1, dtype=bool).T
    a, b = np.nonzero(close)
    return left[a], right[b]


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are one node with a weight. A node's sign codes under several rotations are cut
    into keys of hash tables. Inside a bucket, first the codes alone (angles by equal signs,
    with a confidence bound) single out rows that may have a partner; these get their vectors, every pair
    gets the unbiased estimate of its inner product from codes, stored factors and the
    other vector, and pairs whose upper bound reaches the threshold are computed in double precision. A
    pair is judged in the first table that it shares. Blocks return numbers of links and a spanning
    forest, never the pairs.

    A link at the threshold is missed with probability ``MISS``, a closer one less. Vectors of different
    lengths never link. Null, empty or zero vectors, and those with null or non-finite components, link with
    nothing: they are their own component. ``n_links`` counts other rows, copies included. The component's
    id is its smallest id (null last); rows that repeat an id are all kept if it is that.
    """
    base = cut_lineage(coded(vectors, id_column, vector_column))
    nodes = cut_lineage(
        base.where("node IS NOT NULL")
        .groupBy("node", "dimension")
        .agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.min("vector").alias("vector"))
    )
    sizes = {r["dimension"]: r["n"] for r in nodes.groupBy("dimension").agg(F.count("*").alias("n")).collect()}
    plans = {d: plan(n, d) for d, n in sizes.items()}

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in sorted(set(batch.column(1).to_pylist())):
                part = batch.filter(pc.equal(batch.column(1), d))
                bits, tables, turns = plans[d]
                signs, _ = encode(unit_rows(part.column(2).to_pylist()), turns)
                codes = np.packbits(signs.reshape(len(signs), -1), axis=1)
                keys = keys_of(signs, bits, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f"{d}:{t}:{k}" for k in keys[:, t]]),
                            part.column(0),
                            pa.array([row.tobytes() for row in codes], pa.binary()),
                        ],
                        ["bucket", "node", "codes"],
                    )

    def of_bucket(table: pa.Table) -> tuple[int, int]:
        return tuple(int(x) for x in table["bucket"][0].as_py().split(":")[:2])

    def may_link(table: pa.Table) -> pa.RecordBatch | None:
        """Rows with a partner that their codes cannot rule out."""
        d, t = of_bucket(table)
        bits, tables, turns = plans[d]
        left, right, same = block_rows(table)
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        signs = np.unpackbits(codes, axis=1)[:, : turns * d]
        keys = keys_of(signs, bits, tables)
        pm = signs.astype(np.float32) * 2 - 1
        share = math.acos(COSINE) / math.pi  # of signs that differ, at the threshold
        most = share + SIGMAS * math.sqrt(share * (1 - share) / (turns * d))
        a, b = upper_pairs(pm[left] @ pm[right].T >= turns * d * (1 - 2 * most), left, right, same)
        new = first_shared(keys, a, b, t)
        chosen = np.union1d(a[new], b[new])
        if not len(chosen):
            return None
        return table.select(["bucket", "node"]).take(chosen).combine_chunks().to_batches()[0]

    def link(table: pa.Table) -> pa.RecordBatch | None:
        """(node, weight of its links here, root of its tree here)."""
        d, t = of_bucket(table)
        bits, tables, turns = plans[d]
        left, right, same = block_rows(table)
        unit = unit_rows(table["vector"].to_pylist())
        signs, factors = encode(unit, turns)
        turned = np.einsum("rij,nj->nri", rotations(d, turns), unit, optimize=True)
        corners = (signs * 2.0 - 1) / math.sqrt(d)
        estimate = np.zeros((len(left), len(right)))
        error = np.zeros(len(left))
        for r in range(turns):  # the mean over rotations narrows the bound
            f = factors[left, r]
            estimate += (corners[left, r] @ turned[right, r].T) / f[:, None] / turns
            error += (1 - f**2) / (f**2 * max(1, d - 1)) / turns**2
        close = estimate + SIGMAS * np.sqrt(error)[:, None] >= COSINE
        a, b = upper_pairs(close, left, right, same)
        keep = first_shared(keys_of(signs, bits, tables), a, b, t)
        a, b = a[keep], b[keep]
        exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= COSINE
        a, b = a[exact], b[exact]
        if not len(a):
            return None
        weight = table["weight"].to_numpy()
        links = np.bincount(a, weight[b], table.num_rows) + np.bincount(b, weight[a], table.num_rows)
        root = np.arange(table.num_rows)
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        chosen = np.flatnonzero(links)
        name = table["node"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [name.take(pa.array(chosen)), pa.array(links[chosen].astype(np.int64)), name.take(pa.array(root[chosen]))],
            ["node", "links", "root"],
        )

    buckets = map_batches(nodes.select("node", "dimension", "vector"), explode, "bucket string, node binary, codes binary", rows=1024)
    chosen = cut_lineage(pairs_in_groups(buckets, "bucket", "node", may_link, "bucket string, node binary").distinct())
    whole = chosen.join(nodes.select("node", "vector", "weight"), "node").select("bucket", "node", "vector", "weight")
    found = cut_lineage(pairs_in_groups(whole, "bucket", "node", link, "node binary, links long, root binary"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = (
        nodes.select("node", "weight", "least")
        .join(links, "node", "left")
        .join(classes.withColumnRenamed("root", "class"), "node", "left")
        .select("node", "least", F.coalesce("class", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    smallest = member.groupBy("class").agg(F.min("least").alias("component_id"))
    placed = member.join(smallest, "class").select("node", "n_links", "component_id")
    return (
        base.select("id", "node")
        .join(placed, "node", "left")
        .select(
            F.col("id").alias(id_column),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
    )
