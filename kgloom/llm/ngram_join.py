"""N-gram Jaccard self-join by universe partitioning.

Two sets of sizes l <= s with Jaccard similarity of at least t differ in at
most H = (1 - t) / (1 + t) * (l + s) members. Sets are put in size bands; in
a band the universe of hashed shingles is cut into segments by hash
range, enough of them that similar sets must agree on one. Each set is indexed
under its segments' contents (its own band's cut, and the band's below when
smaller partners may sit there), some segments also under their
one-deletion neighbourhoods, which count double against H. How many
segments take neighbourhoods is decided by cost; there are so many more segments than
similar sets need that the contents all sets have, of empty segments, can be
left out. Candidates are verified on whole sets.

Shingles are 64-bit hashes, and equal sets are told apart from others by a
64-bit digest: copies are one node, so no copies are ever paired.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORD, components, discard, let, stage, table, tidy
from .textcols import chain, mix64, text_chunks, tokens

BAND_RATIO = 1.5
#: A candidate pair, with both sets' bitmaps, costs as many bytes as so many index entries.
VERIFY_COST = 20
#: The chance that two shingles of different texts are equal, for the cost model.
SAME = 1e-7
BLOOM_BITS = 26
MAX_SIZE = 1 << 40
#: Longs of a set's parity bitmap, at least; it has as many bits as the set has members. Two sets differ in at least as many members as their bitmaps do in bits.
PARITY = 16


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    exact: int  # segments that must agree
    near: int  # segments that may differ by one deletion on either side


def most_different(small: int, large: int, num: int, den: int) -> int:
    """The largest symmetric difference of sets of these sizes whose Jaccard similarity is num / den or more."""
    overlap = -(-num * (small + large) // (num + den))
    return small + large - 2 * overlap


def _worst(size: int, num: int, den: int) -> int:
    """Over all partners of at least this size."""
    return (den - num) * (size + size * den // num) // (den + num)


def _with_spare(need: int, near: int, size: float) -> tuple[int, float, float]:
    """(exact segments, members a segment, empty segments two sets share beyond the spare ones) for `near` neighbourhoods.

    Besides what similar sets need there are spare segments for the
    empty ones to be left out; with neighbourhoods, one half for either kind.
    """
    base, spare = max(need - 2 * near, 0), 1
    for _ in range(4):
        k = size / (base + spare + near)
        empty, small = (base + spare) * exp(-k), near * exp(-k) * (1 + k)
        spare = min(1 + ceil(1.5 * max(empty, 4 * small) * (2 if near else 1)), need)
    k = size / (base + spare + near)
    half = spare / 2 if near else spare
    left = max((base + spare) * exp(-k) - half, 0) * exp(-k) + max(2 * near * exp(-k) * (1 + k) - half, 0) * exp(-k) * (1 + k)
    return base + spare, k, left


def bands(num: int, den: int, counts: dict[int, int] | None = None) -> list[Band]:
    """All size bands with their allocation of segments. counts: sets by band, as measured."""
    out, low = [], 1
    while low < MAX_SIZE:
        high = max(low, int(low * BAND_RATIO) - 1, low * den // num)
        need = _worst(high, num, den) + 1
        n = (counts or {}).get(len(out), 1)

        size = (low + high) / 2

        def cost(near: int, need=need, n=n, size=size) -> float:
            exact, k, left = _with_spare(need, near, size)
            # pairs that agree on one-member segments by chance, and on empty ones that can't be left out
            false = exact * (k * exp(-k)) ** 2 * SAME + near * (k * k / 2 * exp(-k)) ** 2 * 4 * SAME + left
            return n * (exact + near * (k + 1)) + VERIFY_COST * n * n / 2 * false

        tries = range(0, (need + 1) // 2 + 1, max(1, need // 64))
        near = 0 if need == 1 else min(tries, key=cost)
        out.append(Band(low, high, _with_spare(need, near, size)[0] if need > 1 else 0, near))
        low = high + 1
    return out


def band_of(sizes: np.ndarray, all_bands: list[Band]) -> np.ndarray:
    return np.searchsorted([b.high for b in all_bands], sizes)


def signatures(shingles: np.ndarray, band: int, all_bands: list[Band], num: int, den: int) -> np.ndarray:
    """Index entries of one set under a band's cut. shingles: sorted, distinct."""
    b = all_bands[band]
    m = b.exact + b.near
    if not m:
        return np.zeros(0, np.uint64)
    seg = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    at = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
    spread = mix64(shingles + np.uint64(band + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
    total = sums[at[1:]] - sums[at[:-1]]
    size = np.diff(at)
    salt = mix64(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    # Equal segments have equal sizes, so skipping the smallest ones, as many as the own worst case leaves over,
    # skips the same matches on both sides. Neighbourhoods only leave out the empty content, which costs
    # double where a segment has one member or none; either kind has half of the spare ones to itself, as one set of a pair
    # may skip more of the one kind and its partner more of the other.
    n = len(shingles)
    spare = b.exact + 2 * b.near - (max(_worst(n, num, den), most_different(n, n, num, den)) + 1)
    own_spare = spare // 2 if b.near else spare
    keep = np.ones(b.exact, bool)
    if own_spare > 0 and b.exact:
        counts = np.cumsum(np.bincount(size[: b.exact]))
        keep = size[: b.exact] > int(np.searchsorted(counts, own_spare, "right")) - 1  # all sizes up to this fit into the spare segments
    exact = mix64(total[: b.exact][keep] ^ salt[: b.exact][keep])
    if not b.near:
        return exact
    lone = size[b.exact :] <= 1
    with_empty = 2 * int(lone.sum()) > own_spare
    whole = np.flatnonzero((size[b.exact :] > 0) | with_empty) + b.exact
    inside = np.repeat(np.arange(b.exact, m), size[b.exact :])
    less_one = (total[inside] - spread[at[b.exact] :]) ^ salt[inside]
    less_one = less_one if with_empty else less_one[size[inside] > 1]
    return np.concatenate([exact, mix64(total[whole] ^ salt[whole]), mix64(less_one)])


def shingle_sets(column: pa.Array, width: int):
    """For each text its sorted distinct shingle hashes; a shorter text is one shingle, one without words has none."""
    for at, end, buf, offsets in text_chunks(column):
        words, bounds = tokens(buf, offsets)
        for i in range(end - at):
            own = words[bounds[i] : bounds[i + 1]]
            yield np.unique(chain(own, width)) if len(own) >= width else mix64(chain(own, len(own)) + np.uint64(len(own))) if len(own) else own


def parity(shingles: np.ndarray) -> np.ndarray:
    """A power of two of longs; folded in halves it is the shorter bitmap."""
    bits = max(64 * PARITY, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _may_be_similar(num: int, den: int):
    """A condition on a_size, b_size, a_bits, b_bits that every similar pair meets. Bitmaps of sizes that fit are of one length or of twice that."""
    sa, sb, a, b = F.col("a_size"), F.col("b_size"), F.col("a_bits"), F.col("b_bits")
    least = F.ceil((sa + sb) * num / (num + den) - 1e-9)
    n = F.least(F.size(a), F.size(b))

    def xor(x, y):
        return F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(x):
        return F.when(F.size(x) > n, xor(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n))).otherwise(x)

    apart = F.aggregate(xor(folded(a), folded(b)), F.lit(0), lambda total, x: total + F.bit_count(x))
    fits = den * F.least(sa, sb) >= num * F.greatest(sa, sb)
    return F.when(fits, (F.greatest(F.size(a), F.size(b)) > 2 * n) | (apart <= sa + sb - 2 * least)).otherwise(False)


def digest(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bloom(values: DataFrame):
    """A broadcast bitmap of 2 ** BLOOM_BITS slots, a fixed size, over the only column of values (longs)."""
    (name,) = values.columns
    slot = F.pmod(name, F.lit(1 << BLOOM_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))
    words = values.groupBy(F.floor(slot / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bloom = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    bloom[words["word"].to_numpy()] = words["bits"].to_numpy()
    return values.sparkSession.sparkContext.broadcast(bloom)


def _maybe_in(values: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    at = values & ((1 << BLOOM_BITS) - 1)
    return (bloom[at >> 6] >> (at & 63)) & 1 == 1


def _shared_entries(indexed: DataFrame) -> DataFrame:
    """(sig, fp) of all index entries that more than one set has, staged.

    Counted with map-side combining first; a bitmap of the shared entries then keeps most
    others from being dealt out again, and the join splits frequent ones.
    """
    span = indexed.select(F.explode("nd_sigs").alias("sig"), F.col("nd_fp").alias("fp")).groupBy("sig").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
    wanted = stage(span.where("low <> high").select("sig"), "shared")
    shared = _bloom(wanted)

    def pick(batches):
        bloom = shared.value
        for b in batches:
            sigs = b.column("nd_sigs")
            flat, fps = sigs.flatten().to_numpy(), b.column("nd_fp").to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(b.num_rows), sigs.value_lengths().fill_null(0).to_numpy())
            keep = np.flatnonzero(_maybe_in(flat, bloom))
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(fps[own[keep]].astype(np.int64))], ["sig", "fp"])

    maybe = indexed.where("nd_sigs IS NOT NULL").select("nd_sigs", "nd_fp").mapInArrow(tidy(pick), "sig bigint, fp bigint")
    # copies in different tasks make equal entries
    out = stage(maybe.join(wanted, "sig").select("sig", "fp").distinct(), "members")
    discard(wanted)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of set digests whose sets are similar enough, staged."""
    shared = _bloom(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")))

    def fetch(batches):
        bloom = shared.value
        done = set()
        for b in batches:
            fps, sets = [], []
            for s in shingle_sets(b.column("text"), width):
                if len(s):
                    fp = digest(s)
                    at = fp % (1 << BLOOM_BITS)
                    if (int(bloom[at >> 6]) >> (at & 63)) & 1 and fp not in done:
                        done.add(fp)
                        fps.append(fp)
                        sets.append(s.view(np.int64))
            if fps:
                lens = np.cumsum([0] + [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.ListArray.from_arrays(pa.array(lens.astype(np.int32)), pa.array(np.concatenate(sets)))], ["fp", "own"])

    sets = docs.select("text").mapInArrow(tidy(fetch), "fp bigint, own array<bigint>")
    sets = stage(sets, "sets")
    left = pairs.join(sets.select(F.col("fp").alias("b"), F.col("own").alias("own_b")), "b")
    both = left.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("own_a")), "a")
    common = F.size(F.array_intersect("own_a", "own_b"))
    union = F.size("own_a") + F.size("own_b") - common
    small, large = F.least(F.size("own_a"), F.size("own_b")), F.greatest(F.size("own_a"), F.size("own_b"))
    good = stage(both.where((den * small >= num * large) & (den * common >= num * union)).select("a", "b").distinct(), "links")
    discard(sets)
    return good


def near_duplicates(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """docs' columns but text, plus n_shingles and component_id: the smallest doc_id reachable by links.

    Null and blank texts have no shingles and link with nothing: they are
    their own component. Repeated rows and equal texts are one node. A
    null doc_id never becomes a component_id unless all ids in it are null.
    An empty table stays empty. Columns of docs named n_shingles or component_id are replaced;
    any other column passes through, whatever its name.
    """
    plain = [c for c in docs.columns if c not in ("text", "n_shingles", "component_id")]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in plain]).alias("nd_row"), "text")
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SPACE_WORD))
    edges = [b.high for b in bands(num, den)]
    upto = F.array(*[F.lit(e).cast("long") for e in edges])
    # bound once: inside the inner lambda the words would be counted for every edge
    rough = let(F.greatest(n_words - (width - 1), F.lit(1)).cast("long"), lambda n: F.size(F.filter(upto, lambda e: e < n)))
    measured = {r["band"]: r["n"] for r in docs.groupBy(rough.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = bands(num, den, measured)
    highs = np.array([b.high for b in cut])

    def index(batches):
        done = set()
        for b in batches:
            sizes, fps, sigs, bits = [], [], [], []
            for s in shingle_sets(b.column("text"), width):
                sizes.append(len(s))
                fp = digest(s) if len(s) else None
                fps.append(fp)
                if fp is None or fp in done:
                    sigs.append(None)
                    bits.append(None)
                    continue
                done.add(fp)
                own = int(np.searchsorted(highs, len(s)))
                found = [signatures(s, own, cut, num, den)]
                if own and -(-num * len(s) // den) <= cut[own - 1].high:
                    found.append(signatures(s, own - 1, cut, num, den))
                sigs.append(np.unique(np.concatenate(found)).view(np.int64))
                bits.append(parity(s))
            out = b.select(["nd_row"])
            out = out.append_column("nd_size", pa.array(sizes, pa.int64())).append_column("nd_fp", pa.array(fps, pa.int64()))
            yield out.append_column("nd_bits", pa.array(bits, pa.list_(pa.int64()))).append_column("nd_sigs", pa.array(sigs, pa.list_(pa.int64())))

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["nd_row"], T.StructField("nd_size", long), T.StructField("nd_fp", long), T.StructField("nd_bits", longs), T.StructField("nd_sigs", longs)])
    indexed = stage(docs.mapInArrow(tidy(index), schema), "indexed")
    shared = _shared_entries(indexed)
    # every member against the bucket's most widely shared set, which is what copies have in common: linear, whatever the bucket
    width_of = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    spread = shared.join(width_of, "sig").groupBy("fp").agg(F.sum("n").alias("spread"))
    hubs = shared.join(spread, "fp").groupBy("sig").agg(F.max(F.struct("spread", "fp")).alias("top")).select("sig", F.col("top.fp").alias("hub"))
    members = stage(shared.join(hubs, "sig").where("fp <> hub"), "hubs")
    discard(shared)
    pairs = members.select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")).distinct()
    nodes = stage(indexed.where("nd_bits IS NOT NULL").groupBy("nd_fp").agg(F.first("nd_size").alias("nd_size"), F.first("nd_bits").alias("nd_bits")), "nodes")
    na, nb = (nodes.select(F.col("nd_fp").alias(x), F.col("nd_size").alias(f"{x}_size"), F.col("nd_bits").alias(f"{x}_bits")) for x in "ab")
    close = _may_be_similar(num, den)
    pairs = stage(pairs.join(na, "a").join(nb, "b").where(close).select("a", "b"), "pairs")
    links = _verified(docs, pairs, width, num, den)
    discard(pairs)
    label = components(links)
    # buckets whose members are not yet all connected: only pairs across components are left to try
    la, lb = label.select(F.col("node").alias("fp"), F.col("component").alias("c")), label.select(F.col("node").alias("hub"), F.col("component").alias("hc"))
    marked = members.join(la, "fp", "left").join(lb, "hub", "left").select("sig", "fp", "hub", F.coalesce("c", "fp").alias("c"), F.coalesce("hc", "hub").alias("hc"))
    marked = stage(marked, "marked")
    discard(members)
    mixed = marked.where("c <> hc").select("sig").distinct()
    rest = marked.join(mixed, "sig", "left_semi")  # without the hubs, whose pairs were tried
    rest = rest.join(nodes.select(F.col("nd_fp").alias("fp"), F.col("nd_size").alias("size"), F.col("nd_bits").alias("bits")), "fp")
    left, right = (rest.select("sig", F.col("fp").alias(x), F.col("c").alias(f"c{x}"), F.col("size").alias(f"{x}_size"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    more = left.join(right, "sig").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close).select("a", "b").distinct()
    more = stage(more, "more")
    discard(marked)
    discard(nodes)
    if not more.isEmpty():
        label = components(links.union(_verified(docs, more, width, num, den)))
    discard(more)
    of = indexed.drop("nd_sigs", "nd_bits").join(label.select(F.col("node").alias("nd_fp"), F.col("component").alias("nd_label")), "nd_fp", "left").withColumn("nd_label", F.coalesce("nd_label", "nd_fp"))
    of = stage(of, "labelled")
    discard(indexed)
    least = of.where("nd_label IS NOT NULL").groupBy("nd_label").agg(F.min("nd_row.doc_id").alias("nd_least"))
    out = of.join(least, "nd_label", "left")
    return out.select("nd_row.*", F.col("nd_size").alias("n_shingles"), F.coalesce("nd_least", "nd_row.doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
