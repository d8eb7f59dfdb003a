"""Context-triggered piecewise hashing: fingerprints of texts that stay alike when a text is edited.

A rolling hash of the last seven bytes decides, wherever it stands, whether a chunk ends: at
block size 2 ** i where the hash ends in i zero bits. So boundaries move with
the text, and those of a block size are among those of half that size. A text's block size is the
smallest one with at most 64 boundaries; its fingerprint is "block size:signature:signature at twice the block size",
a signature one character of 6 bits for each chunk's hash. Fingerprints of equal block sizes, or of one twice
the other, are compared by the edit distance of the signatures that belong together.

Next documents are found without a window over the table: the ids are cut into ranges at
percentiles, each range is sorted by itself, and the first document of a range is also sent to the end of the range before.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, tidy
from .textcols import mix64

WINDOW = 7
#: Boundaries of a signature, at most.
MOST = 64
#: Signatures are alike only if they share a run of so many characters, or of half the shorter one.
SHARED = 5
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Bytes hashed at once, so that memory stays bounded whatever the text.
BLOCK = 1 << 16
#: Ranges of ids, at most: their ends are a small broadcast whatever the table.
MOST_RANGES = 1 << 16

_MASK = (1 << 64) - 1
_ROLL, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ROLLS = [np.uint64(pow(_ROLL, j + 1, 1 << 64)) for j in range(WINDOW)]
_POWERS = np.multiply.accumulate(np.append(np.uint64(1), np.full(BLOCK - 1, _BASE, np.uint64)))
_INVERSE = pow(_BASE, -1, 1 << 64)


def _boundaries(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, hashes at them, sums of the bytes before them) of the chunks at a level; the last sum is the whole text's."""
    mask = np.uint64((1 << level) - 1)
    ends, rolls, sums = [], [], []
    total = 0
    for at in range(0, len(data), BLOCK):
        lead = min(at, WINDOW - 1)
        part = data[at - lead : at + BLOCK].astype(np.uint64) + np.uint64(1)
        roll = part * _ROLLS[0]
        for j in range(1, min(WINDOW, len(part))):
            roll[j:] += part[:-j] * _ROLLS[j]
        roll, part = mix64(roll[lead:]), part[lead:]
        part *= _POWERS[: len(part)]
        part *= np.uint64(pow(_BASE, at, 1 << 64))
        sum_ = np.cumsum(part, out=part) + np.uint64(total)
        hit = np.flatnonzero((roll & mask) == 0)
        ends.append(hit + at + 1)
        rolls.append(roll[hit])
        sums.append(sum_[hit])
        total = int(sum_[-1])
    return np.concatenate(ends), np.concatenate(rolls), np.append(np.concatenate(sums), np.uint64(total))


def _signature(n: int, ends: np.ndarray, sums: np.ndarray) -> str:
    """One character for each chunk; what follows the last boundary is a chunk as well."""
    total, sums = sums[-1:], sums[:-1]
    if not len(ends) or ends[-1] < n:
        ends, sums = np.append(ends, n), np.append(sums, total)
    before = np.append(np.uint64(0), sums[:-1])
    back = np.array([pow(_INVERSE, int(s), 1 << 64) for s in np.append(0, ends[:-1])], np.uint64)
    lens = np.diff(ends, prepend=0).astype(np.uint64)
    return ALPHABET[(mix64((sums - before) * back + lens) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """"block size:signature:signature at twice the block size"; the empty text's is "1::"."""
    n = len(text)
    if not n:
        return "1::"
    data = np.frombuffer(text, np.uint8)
    level = max(0, (n // MOST).bit_length() - 3)
    while True:
        ends, rolls, sums = _boundaries(data, level)
        if len(ends) > MOST or level == 0:
            break
        level = max(0, level - 4)  # a text that repeats itself has few different hashes

    def at_least(low: int):
        ok = (rolls & np.uint64((1 << low) - 1)) == 0
        return ends[ok], np.append(sums[:-1][ok], sums[-1])

    while len(at_least(level)[0]) > MOST:
        level += 1
    return f"{1 << level}:{_signature(n, *at_least(level))}:{_signature(n, *at_least(level + 1))}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u) | (v - u)
    return len(a) - (v & full).bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(SHARED, -(-min(len(a), len(b)) // 2))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))  # one less the characters put in and taken out, of all


def likeness(a: str, b: str) -> float:
    """0 to 1: by the edit distance (insertions and deletions) of signatures of one block size, the better of two; equal fingerprints 1, without a common block size 0."""
    if a == b:
        return 1.0
    (sa, a1, a2), (sb, b1, b2) = a.split(":"), b.split(":")
    sa, sb = int(sa), int(sb)
    if sa == sb:
        return max(_alike(a1, b1), _alike(a2, b2))
    if sb == 2 * sa:
        return _alike(a2, b1)
    if sa == 2 * sb:
        return _alike(a1, b2)
    return 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' columns but text, plus fingerprint. Null texts count as empty; equal texts have equal fingerprints; a column of that name is replaced."""
    plain = [c for c in docs.columns if c not in ("text", "fingerprint")]
    rows = docs.select(F.struct(F.lit(0).alias("fp_none"), *[F.col(f"`{c}`") for c in plain]).alias("fp_row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("fp_row"), pa.array([fingerprint(t.as_buffer().to_pybytes()) for t in b.column("text")], pa.string())], ["fp_row", "fingerprint"])

    from pyspark.sql import types as T

    made = rows.mapInArrow(tidy(run), T.StructType([rows.schema["fp_row"], T.StructField("fingerprint", T.StringType())]))
    return made.select(*[F.col(f"fp_row.`{c}`") for c in plain], "fingerprint")


def _range_of(doc_id: Column, cuts: list, kind: str) -> Column:
    """How many cuts are less than doc_id (null: none), looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    constant = lambda values, of: F.from_json(F.lit(json.dumps(values)), of)
    ends, members = constant([g[-1] for g in groups], f"array<{kind}>"), constant(groups, f"array<array<{kind}>>")
    whole = F.size(F.filter(ends, lambda c: c < doc_id))
    inside = F.size(F.filter(F.coalesce(F.get(members, whole), F.array().cast(f"array<{kind}>")), lambda c: c < doc_id))
    return F.when(doc_id.isNull(), 0).otherwise(whole * step + inside)


def in_ranges(docs: DataFrame, range_rows: int = 8192) -> DataFrame:
    """doc_id and text in sorted ranges of ids: columns fp_range, and fp_helper, true for a copy of what comes next.

    Order is by doc_id (numbers), null first, ties by text, null texts counting as empty. At most MOST_RANGES ranges of about range_rows rows each, or wider ones where there are more rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    k = min(MOST_RANGES, -(-n // range_rows))
    cuts = []
    if k > 1:
        got = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)], F.lit(10 * k)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(got or []))
    of = _range_of(F.col("doc_id"), cuts, docs.schema["doc_id"].dataType.simpleString())
    # the first row of each range, by number: at most MOST_RANGES rows
    heads = docs.select("doc_id", of.alias("r")).groupBy("r").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head")).orderBy("r").collect()
    to = spark.createDataFrame([(h["head"], heads[i - 1]["r"], i == 0) for i, h in enumerate(heads)], f"head {docs.schema['doc_id'].dataType.simpleString()}, fp_before int, fp_wraps boolean")
    own = docs.withColumn("fp_range", of.cast("int"))
    met = own.join(F.broadcast(to), own["doc_id"].eqNullSafe(to["head"]), "left").drop("head")
    twice = F.array(F.struct(F.col("fp_range").alias("r"), F.lit(False).alias("h")), F.struct(F.col("fp_before").alias("r"), F.lit(True).alias("h")))
    once = F.array(F.struct(F.col("fp_range").alias("r"), F.lit(False).alias("h")))
    out = met.withColumn("fp_to", F.explode(F.when(F.col("fp_before").isNotNull(), twice).otherwise(once)))
    out = out.select("doc_id", "text", F.col("fp_to.r").alias("fp_range"), F.col("fp_to.h").alias("fp_helper"))
    return out.repartitionById(max(k, 1), F.col("fp_range")).sortWithinPartitions("fp_range", "fp_helper", "doc_id", "text")


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points of text, text with its last quarter replaced by as much of what follows)."""
    own = text.decode()
    n = len(own)
    m = n // 4
    # no code point is longer than four bytes
    return n, (own[: n - m] + following[: 4 * m].decode(errors="ignore")[:m]).encode()


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document of the last one is the first; of a single one it is itself. Null texts count as empty. Rows that repeat a
    doc_id follow each other by text. An empty table gives no rows; other columns are not looked at.
    """

    def pairs(batches) -> Iterator[tuple]:
        last = None
        for b in batches:
            for doc_id, text, of, helper in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("fp_range").to_pylist(), b.column("fp_helper").to_pylist(), strict=True):
                if last is not None and last[3]:
                    if of == last[2]:
                        continue  # rows that tie with the helper
                    last = None
                text = text.as_buffer().to_pybytes()
                here = (doc_id, text, of, helper, fingerprint(text))
                if last is not None:
                    yield last, here
                last = here

    def run(batches):
        out = []

        def made():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]], *[pa.array(c, pa.float64()) for c in cols[5:]]], names)

        for (doc_id, text, _, _, fp), (_, following, _, _, next_fp) in pairs(batches):
            n, changed = edited(text, following)
            changed_fp = fingerprint(changed)
            out.append((doc_id, n, hashlib.sha256(changed).hexdigest(), fp, changed_fp, likeness(fp, changed_fp), likeness(fp, next_fp)))
            if len(out) == 1024:
                yield made()
                out = []
        if out:
            yield made()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(docs).mapInArrow(tidy(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
