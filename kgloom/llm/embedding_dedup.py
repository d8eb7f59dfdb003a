"""Embedding near-dedup by spherical-cap filters.

Random product codes give many directions: the rotated vector is cut into four
blocks, each block has its own random unit codewords, and every choice of
one word per block is a direction. A vector goes to all directions whose
inner product with it exceeds a threshold, found by list decoding (partial
sums that can't reach it any more are dropped); a vector that exceeds it for too few goes to its
nearest ones, so none is left uncompared. Vectors that share a direction are compared
in full. The number of directions grows with the number of vectors, so the number
that share one does not, and codes are added until sample pairs at the least
cosine meet often enough.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, discard, stage, table, tidy

LEAST = 0.95
BLOCKS = 4
#: Independent codes, at least; pairs that one keeps apart another brings together.
CODES = 4
#: Share of SAMPLE random pairs at the least cosine that have to meet, whatever the number of vectors.
RECALL, SAMPLE = 0.95, 400
#: Directions per vector and code, and vectors per direction, that the threshold aims at.
PER_VECTOR, PER_FILTER = 12, 24
#: Directions per vector and code at least: its nearest, where fewer exceed the threshold.
LEAST_DIRECTIONS = 4
SEED = 5
#: A direction with more vectors is compared block against block, in as many tasks.
BLOCK_ROWS = 1000


def cap_quantile(dim: int, p: float) -> float:
    """The inner product that a random unit vector of this length has with a fixed one, or more, with probability p."""
    if dim < 2:
        return 1.0
    angle = np.linspace(0, np.pi / 2, 200_001)
    density = np.sin(angle) ** (dim - 2)
    mass = np.append(0.0, np.cumsum(density[1:] + density[:-1]))
    return float(np.cos(np.interp(p, mass / (2 * mass[-1]), angle)))


class Code:
    """One product code for vectors of one length, over a random rotation. Depends only on the arguments."""

    def __init__(self, dim: int, n: int, number: int, seed: int = SEED):
        p = min(0.25, PER_FILTER / max(n, 1))
        self.words = max(2, round((PER_VECTOR / p) ** (1 / BLOCKS)))
        self.least = cap_quantile(dim, p)
        rng = np.random.default_rng([seed, dim, number])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks, self.codes = np.array_split(np.arange(dim), BLOCKS), []
        for block in self.blocks:
            c = rng.standard_normal((self.words, len(block)))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) / BLOCKS**0.5)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row the sorted numbers of all directions that exceed the threshold, and of the nearest LEAST_DIRECTIONS."""
        unit = unit @ self.rotation
        dots = [unit[:, b] @ c.T for b, c in zip(self.blocks, self.codes, strict=True)]
        best = np.cumsum([d.max(1) for d in dots[::-1]], axis=0)[::-1]  # most that blocks from k on can add
        out = []
        for i in range(len(unit)):
            sums, ids = np.zeros(1), np.zeros(1, np.int64)
            for k, d in enumerate(dots):
                rest = best[k + 1][i] if k + 1 < BLOCKS else 0.0
                grown = sums[:, None] + d[i][None, :]
                keep = grown + rest >= self.least
                ids = (ids[:, None] * self.words + np.arange(self.words)[None, :])[keep]
                sums = grown[keep]
            out.append(np.sort(ids))
        few = [i for i, ids in enumerate(out) if len(ids) < LEAST_DIRECTIONS]
        if few:
            for i, ids in zip(few, self._nearest([d[few] for d in dots]), strict=True):
                out[i] = np.union1d(out[i], ids)
        return out

    def _nearest(self, dots: list[np.ndarray]) -> np.ndarray:
        """The numbers of each row's nearest LEAST_DIRECTIONS directions; the best sums consist of the best partial sums."""

        def best(values: np.ndarray) -> np.ndarray:
            return np.argsort(-values, axis=1, kind="stable")[:, :LEAST_DIRECTIONS]

        n = len(dots[0])
        sums, ids = np.zeros((n, 1)), np.zeros((n, 1), np.int64)
        for d in dots:
            own = best(d)
            grown = (sums[:, :, None] + np.take_along_axis(d, own, 1)[:, None, :]).reshape(n, -1)
            numbers = (ids[:, :, None] * self.words + own[:, None, :]).reshape(n, -1)
            top = best(grown)
            sums, ids = np.take_along_axis(grown, top, 1), np.take_along_axis(numbers, top, 1)
        return ids


def sample_pairs(dim: int, cosine: float, size: int = SAMPLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors and for each a partner at this cosine."""
    a, b = np.random.default_rng([seed, dim, size]).standard_normal((2, size, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    return a, cosine * a + (1 - cosine**2) ** 0.5 * b


def meeting(codes: list[Code], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of a shares a direction with the same row of b in any of the codes."""
    met = np.zeros(len(a), bool)
    for code in codes:
        met |= [bool(np.isin(x, y).any()) for x, y in zip(code.decode(a), code.decode(b), strict=True)]
    return met


def codes_needed(dim: int, n: int, least: float = LEAST, seed: int = SEED) -> int:
    """How many codes bring RECALL of the sample pairs at cosine least together; the random rotation makes every pair a random one."""
    a, b = sample_pairs(dim, least)
    met, number = np.zeros(len(a), bool), 0
    while number < CODES or met.mean() < RECALL:
        met |= meeting([Code(dim, n, number, seed)], a, b)
        number += 1
    return number


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for null, zero, empty and non-finite ones."""
    lens = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten().cast(pa.float64())
    flat = flat.fill_null(np.nan).to_numpy()
    at = np.concatenate([[0], np.cumsum(lens)])
    out: list = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        v = flat[a:b]
        top = np.abs(v).max() if b > a else 0.0
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        v = v / top  # no overflow or underflow in the norm
        out.append(v / np.linalg.norm(v))
    return out


def _compare(group: list[tuple], least: float, out: list):
    """Links between the rows of one direction that no smaller direction shares; adds (fp, root, links).

    Rows are (fp, weight, side, unit, directions); side 0 meets side 1, or side 2 itself.
    """
    group.sort(key=lambda r: r[0])
    fps = np.array([r[0] for r in group])
    weight = np.array([r[1] for r in group])
    side = np.array([r[2] for r in group])
    unit = np.stack([r[3] for r in group])
    linked = unit @ unit.T >= least
    np.fill_diagonal(linked, False)
    linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    if not linked.any():
        return
    smaller = [r[4] for r in group]
    flat = np.concatenate(smaller)
    if len(flat):
        names, index, n = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(group)), [len(s) for s in smaller])
        shared = n[index] > 1
        number = np.cumsum(n > 1) - 1
        has = np.zeros((len(group), max(int((n > 1).sum()), 1)), np.float32)
        has[row[shared], number[index[shared]]] = 1
        linked &= has @ has.T == 0
    hit = linked.any(1)
    if not hit.any():
        return
    root = np.arange(len(group))
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], len(group)).min(1))
        if (low == root).all():
            break
        root = low
    links = linked.astype(float) @ weight
    for i in np.flatnonzero(hit):
        out.append((int(fps[i]), int(fps[root[i]]), int(links[i])))


def near_duplicates(vectors: DataFrame, least: float = LEAST, seed: int = SEED) -> DataFrame:
    """vectors' columns but embedding, plus n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite parts
    link with nothing; vectors of different lengths neither. Equal vectors are one
    node with a weight, so copies are never paired. Repeated ids are rows of their own;
    a null vec_id never names a component unless all ids in it are null. An
    empty table stays empty. Columns named n_links, component_id or kept are replaced; any other passes through, whatever its name.
    """
    plain = [c for c in vectors.columns if c not in ("embedding", "n_links", "component_id", "kept")]
    vectors = vectors.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("ed_row"), "embedding")
    schema = T.StructType([vectors.schema["ed_row"], T.StructField("ed_fp", T.LongType()), T.StructField("ed_unit", T.BinaryType())])

    def name(batches):
        for b in batches:
            units = _units(b.column("embedding"))
            fps = [None if u is None else int.from_bytes(blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True) for u in units]
            out = b.select(["ed_row"]).append_column("ed_fp", pa.array(fps, pa.int64()))
            yield out.append_column("ed_unit", pa.array([None if u is None else u.tobytes() for u in units], pa.binary()))

    rows = stage(vectors.mapInArrow(tidy(name), schema), "vectors")
    nodes = rows.where("ed_fp IS NOT NULL").groupBy("ed_fp").agg(F.count(F.lit(1)).alias("weight"), F.first("ed_unit").alias("unit"))
    nodes = stage(nodes, "nodes")
    lengths = {r["dim"]: r["n"] for r in nodes.groupBy((F.octet_length("unit") / 8).cast("int").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}

    needed = {dim: codes_needed(dim, n, least, seed) for dim, n in lengths.items()}

    def spread(batches):
        codes = {}
        for b in batches:
            units = [np.frombuffer(u.as_py()) for u in b.column("unit")]
            found: list = [None] * len(units)
            dims = np.array([len(u) for u in units])
            for dim in np.unique(dims):
                if dim not in codes:
                    codes[dim] = [Code(int(dim), lengths[int(dim)], k, seed) for k in range(needed[int(dim)])]
                at = np.flatnonzero(dims == dim)
                own = np.stack([units[i] for i in at])
                decoded = [[ids * len(codes[dim]) + k for ids in code.decode(own)] for k, code in enumerate(codes[dim])]
                for i, ids in zip(at, zip(*decoded, strict=True), strict=True):
                    found[i] = np.concatenate(ids) * 4096 + dim % 4096
            lens = np.cumsum([0] + [len(f) for f in found]).astype(np.int32)
            yield b.append_column("filters", pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))))

    filtered = stage(nodes.mapInArrow(tidy(spread), "ed_fp bigint, weight bigint, unit binary, filters array<bigint>"), "filters")
    big = filtered.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS)
    big = stage(big.select("filter", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("n_blocks")), "big")
    each = filtered.select("ed_fp", "weight", "unit", "filters", F.explode("filters").alias("filter")).join(big, "filter", "left")
    n_blocks = F.coalesce("n_blocks", F.lit(1))
    block = F.pmod(F.xxhash64("ed_fp"), n_blocks).cast("int")
    each = each.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    each = each.select(
        "filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "ed_fp", "weight",
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "unit",
        F.filter("filters", lambda f: f < F.col("filter")).alias("smaller"),
    )

    def compare(batches):
        key, group, out = None, [], []

        def batch():
            a, b, n = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

        for b in batches:
            filters, i, j = (b.column(c).to_numpy() for c in ("filter", "i", "j"))
            fps, weights, sides = (b.column(c).to_numpy() for c in ("ed_fp", "weight", "side"))
            units, smaller = b.column("unit"), b.column("smaller")
            at = smaller.offsets.to_numpy()
            flat = smaller.values.to_numpy()
            for r in range(b.num_rows):
                now = (filters[r], i[r], j[r])
                if now != key:
                    if len(group) > 1:
                        _compare(group, least, out)
                    key, group = now, []
                group.append((fps[r], weights[r], sides[r], np.frombuffer(units[r].as_py()), flat[at[r] : at[r + 1]].copy()))
            if out:
                yield batch()
                out.clear()
        if len(group) > 1:
            _compare(group, least, out)
        if out:
            yield batch()

    found = stage(each.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j").mapInArrow(tidy(compare), "a bigint, b bigint, n bigint"), "links")
    degree = found.groupBy(F.col("a").alias("ed_fp")).agg(F.sum("n").alias("ed_links"))
    label = components(found).select(F.col("node").alias("ed_fp"), F.col("component").alias("ed_label"))
    known = nodes.select("ed_fp", "weight").join(degree, "ed_fp", "left").join(label, "ed_fp", "left")
    of = rows.drop("ed_unit").join(known, "ed_fp", "left").withColumn("ed_label", F.coalesce("ed_label", "ed_fp"))
    of = stage(of, "labelled")
    smallest = of.where("ed_label IS NOT NULL").groupBy("ed_label").agg(F.min("ed_row.vec_id").alias("ed_least"))
    out = of.join(smallest, "ed_label", "left").withColumn("ed_least", F.coalesce("ed_least", "ed_row.vec_id"))
    links = F.coalesce(F.coalesce("ed_links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long")
    for df in (filtered, big):
        discard(df)
    return out.select("ed_row.*", links.alias("n_links"), F.col("ed_least").alias("component_id"), F.coalesce(F.col("ed_row.vec_id") == F.col("ed_least"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
