"""Nearest neighbours by randomly rotated one-bit codes.

A vector, less a centre and scaled to length 1, is turned by a random rotation into ``bits`` dimensions; its code is the signs there, its
correction scalars its length and how far the code's direction agrees with it. A query is turned likewise and its coordinates
quantised to four bits, so that its inner product with a code is a few ANDs and bit counts of packed words; divided by the agreement this
is an unbiased estimate of the inner product, with an error bound that holds with high probability.

A first scan of the codes keeps each query's best estimates; their exact distances give a threshold. A second scan keeps every code
whose distance less its error bound is within the threshold; exact distances of those decide. Scans are a grid of cells: a cell has a
bounded number of codes and of queries, and every vector is in the index. Vectors move only where they are compared exactly.

Equal vectors are one entry of the index, with the smallest ids among them, so that many copies never meet each other in pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.staging import discard, shuffle_width, stage

PLANES = 4  # bits of a query's coordinate


@functools.lru_cache(maxsize=4)
def rotation(dims: int, bits: int, seed: int) -> np.ndarray:
    """A random orthonormal map from ``dims`` dimensions into ``bits``, or more where there are more dimensions (whole 64-bit words)."""
    width = max(bits, -(-dims // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((width, dims)))
    return q * np.sign(np.diag(r))


def turned(x: np.ndarray, centre: np.ndarray | None, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions from the centre after the rotation, and lengths."""
    x = x - centre if centre is not None else x
    length = np.sqrt((x * x).sum(1))
    return (x / np.where(length > 0, length, 1.0)[:, None]) @ rotation(x.shape[1], bits, seed).T, length


def coded(x: np.ndarray, centre: np.ndarray | None, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (rows of 64-bit words), lengths, and agreement of each code with its vector."""
    y, length = turned(x, centre, bits, seed)
    agreement = np.abs(y).sum(1) / np.sqrt(y.shape[1])
    return np.packbits(y > 0, axis=1).view(np.uint64), length, np.where(length > 0, agreement, 1.0)


def quantised(x: np.ndarray, centre: np.ndarray | None, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes (query, plane, word) of coordinates in 2^PLANES steps, and scalars (query, 4): least coordinate, step, sum of steps, length."""
    y, length = turned(x, centre, bits, seed)
    low = y.min(1)
    step = (y.max(1) - low) / (2**PLANES - 1)
    level = np.rint((y - low[:, None]) / np.where(step > 0, step, 1.0)[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits(level >> j & 1, axis=1).view(np.uint64) for j in range(PLANES)], axis=1)
    return planes, np.stack([low, step, level.sum(1, dtype=np.int64).astype(float), length], axis=1)


def estimates(codes: np.ndarray, ones: np.ndarray, length: np.ndarray, agreement: np.ndarray, planes: np.ndarray, scalars: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of one query to each code as estimated, and how much less it may be."""
    low, step, total, own = scalars
    width = codes.shape[1] * 64
    common = np.zeros(len(codes), np.int64)
    for j in range(PLANES):
        common += np.bitwise_count(codes & planes[j]).sum(1, dtype=np.int64) << j
    inner = (2 * step * common + 2 * low * ones - step * total - low * width) / np.sqrt(width) / agreement
    error = sure / agreement * np.sqrt(np.maximum(0.0, 1 - agreement**2) / (width - 1) + step**2 / 12)
    scale = 2 * length * own
    return length**2 + own**2 - scale * inner, scale * error


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    size = data[0].nbytes if len(data) else 0
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(0, (len(data) + 1) * size or 1, size or 1, np.int32)[: len(data) + 1]), pa.py_buffer(data.tobytes())])


def nearest(vectors: DataFrame, is_query: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, bits: int = 512, sure: float = 1.9, sample: int = 4096, seed: int = 7, codes_a_cell: int = 1 << 16, queries_a_cell: int = 1 << 14) -> DataFrame:
    """The ``k`` nearest rows found for every row where the condition ``is_query`` holds: query_id, rank (from 1), vec_id, score (distance).

    Nearness is Euclidean distance in double precision, ties go to the smaller id (null first). A row's candidates are all other rows
    whose vector has the same number of components; with fewer than ``k`` it gets all. Vectors that are null, empty, zero, or hold a null or
    non-finite component take no part. Rows that repeat are rows of their own, candidates of each other at distance 0; query rows that
    repeat get their own results each. An empty table gives an empty result. Other columns are read only by ``is_query``.

    ``sample`` rows, the least by a hash of their vector, give the centre; every row is in the index. ``sure`` is the error bound in standard
    deviations: larger finds more and compares more exactly.
    """
    spark = vectors.sparkSession
    vec = F.col(vec_col).cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = stage(vectors.where(sound).select(F.col(id_col).alias("id"), vec.alias("vec"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "vectors")

    # Entries of the index: each distinct vector, with the k + 1 smallest ids that have it (as many as a result can need).
    by_id = Window.partitionBy("vec").orderBy(F.asc_nulls_first("id"), "row")
    kept = rows.select("id", "row", "vec", F.row_number().over(by_id).alias("place")).where(F.col("place") <= k + 1)
    members = stage(kept.withColumn("entry", F.first("row").over(by_id)).withColumn("vec", F.when(F.col("place") == 1, F.col("vec"))), "members")
    index = members.where("place = 1").select("entry", "vec", F.col("id").alias("least_id"))
    asking = stage(rows.where("asks").select("id", "row", "vec").join(index, "vec").select("id", "row", "entry"), "asking")

    drawn = index.select("vec").orderBy(F.xxhash64("vec")).limit(sample).collect()
    centres = {}
    for d in {len(r[0]) for r in drawn}:
        centre = np.array([r[0] for r in drawn if len(r[0]) == d]).mean(0)
        centres[d] = centre if np.isfinite(centre).all() else None

    def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
        for batch in batches:
            sizes = batch["vec"].value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                yield part["entry"], part["vec"].flatten().to_numpy().reshape(-1, d), d

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry, x, d in by_size(batches):
            codes, length, agreement = coded(x, centres.get(d), bits, seed)
            yield pa.RecordBatch.from_arrays([entry, pa.array(np.full(len(x), d, np.int32)), _binary(codes), pa.array(length), pa.array(agreement)], names=["entry", "dims", "code", "length", "agreement"])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry, x, d in by_size(batches):
            planes, scalars = quantised(x, centres.get(d), bits, seed)
            yield pa.RecordBatch.from_arrays([entry, pa.array(np.full(len(x), d, np.int32)), _binary(planes.reshape(len(x), -1)), _binary(scalars)], names=["entry", "dims", "planes", "scalars"])

    codes = stage(index.mapInArrow(encode, "entry long, dims int, code binary, length double, agreement double"), "codes")
    wanted = stage(index.join(asking.select("entry").distinct(), "entry").mapInArrow(quantise, "entry long, dims int, planes binary, scalars binary"), "queries")
    n_codes, n_queries = codes.count(), wanted.count()
    across = max(-(-n_codes // codes_a_cell), min(shuffle_width(spark), -(-n_codes // 1024)), 1)
    down = max(1, -(-n_queries // queries_a_cell))

    def scan(queries: DataFrame, keep, schema: str) -> DataFrame:
        """Every query against every code, in cells; ``keep`` chooses from a query's estimates and their errors."""

        def cell(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            if len(left) and len(right):
                packed = _matrix(left["code"], np.uint64)
                ones = np.bitwise_count(packed).sum(1, dtype=np.int64)
                length, agreement, entry = (left[c].to_numpy() for c in ("length", "agreement", "entry"))
                planes = _matrix(right["planes"], np.uint64).reshape(len(right), PLANES, -1)
                scalars, asked = _matrix(right["scalars"], np.float64), right["entry"].to_numpy()
                limits = right["within"].to_numpy() if "within" in right.column_names else np.zeros(len(right))
                for i in range(len(right)):
                    distance, error = estimates(packed, ones, length, agreement, planes[i], scalars[i], sure)
                    at = keep(distance, error, entry != asked[i], limits[i])
                    found.append((np.full(len(at), asked[i]), entry[at], distance[at]))
            return pa.table(dict(zip(("query", "entry", "estimate"), map(np.concatenate, zip(*found)))))

        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = codes.withColumn("a", F.pmod(F.xxhash64("entry"), F.lit(across))).withColumn("b", every(down))
        right = queries.withColumn("b", F.pmod(F.xxhash64("entry"), F.lit(down))).withColumn("a", every(across))
        return left.groupBy("dims", "a", "b").cogroup(right.groupBy("dims", "a", "b")).applyInArrow(cell, schema)

    def best(distance: np.ndarray, error: np.ndarray, other: np.ndarray, limit: float) -> np.ndarray:
        at = np.flatnonzero(other)
        return at if len(at) <= k else at[np.argpartition(distance[at], k)[:k]]

    def within(distance: np.ndarray, error: np.ndarray, other: np.ndarray, limit: float) -> np.ndarray:
        return np.flatnonzero(other & ~(distance - error > limit))

    apart = F.sqrt(F.aggregate(F.zip_with("vec", "own", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    def exact(pairs: DataFrame) -> DataFrame:
        own = index.select(F.col("entry").alias("query"), F.col("vec").alias("own"))
        return pairs.select("query", "entry").join(index, "entry").join(own, "query").select("query", "entry", apart.alias("score"))

    schema = "query long, entry long, estimate double"
    first = scan(wanted, best, schema)
    nearest_first = Window.partitionBy("query").orderBy("estimate", "entry")
    few = first.withColumn("place", F.row_number().over(nearest_first)).where(F.col("place") <= k)
    limit = exact(few).groupBy("query").agg(F.when(F.count(F.lit(1)) < k, float("inf")).otherwise(F.max("score")).alias("worst"))
    # A little more than the squared distance, for rounding.
    limited = wanted.join(limit.select(F.col("query").alias("entry"), (F.col("worst") * F.col("worst") * (1 + 1e-9)).alias("within")), "entry", "left").withColumn("within", F.coalesce("within", F.lit(float("inf"))))
    near = exact(scan(limited, within, schema)).join(index.select("entry", "least_id"), "entry")
    # A result's entry has its smallest id before it, so k entries in the order of distance and smallest id hold the k nearest rows.
    entries = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", F.asc_nulls_first("least_id"), "entry"))).where(F.col("place") <= k)
    others = entries.select("query", "score", "entry").join(members.select("entry", "id", "row"), "entry").select("query", "score", "id", "row")
    copies = asking.select("entry").distinct().join(members, "entry").select(F.col("entry").alias("query"), F.lit(0.0).alias("score"), "id", "row")
    order = ["score", F.asc_nulls_first("id"), "row"]
    found = others.unionByName(copies).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k + 1).drop("rank")
    paired = asking.select(F.col("id").alias("query_id"), F.col("row").alias("own"), F.col("entry").alias("query")).join(found, "query").where("own <> row")
    out = stage(paired.withColumn("rank", F.row_number().over(Window.partitionBy("own").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score"), "nearest")
    discard(rows, members, asking, codes, wanted)
    return out
