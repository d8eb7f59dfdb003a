"""Runs (maximal repetitions) of words by Crochemore's partition refinement.

Positions of a text are in one class of level l when the l words that start there are
equal. Level l + 1 is made from level l by the smaller half: of the classes
that a class was split into all but the largest split their left neighbours' classes,
so a position is touched a logarithmic number of times. Each class is a linked
list by position; neighbours at a distance equal to the level are a
square of primitive root, and consecutive squares of one root length are a run.
All texts of a chunk are refined together, level by level, with array operations.

Positions whose factor would pass the end of their text stay in their class but no longer
count in it: they come last in it, so they never stand between two others, and squares
that would pass the end are not given out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORD, crc_mod, let, table, tidy
from .textcols import text_chunks, word_hashes, word_spans

LEAST_WORDS = 12
#: Texts refined together, in bytes; a longer text alone.
CHUNK_BYTES = 2 << 20
#: Remainders of up to so many members are walked along their lists, larger ones found by a scan of the chunk.
WALK = 64

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def squares(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, root length) of every square with a primitive root. words: equal numbers for equal words; bounds: first word of each text, and the end."""
    n = len(words)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < 2:
        return none
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    first, end = bounds[:-1][text], bounds[1:][text]
    order = np.lexsort((words, text))
    new = np.ones(n, bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    label = np.empty(n, np.int64)
    label[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    n_classes = len(heads)
    # classes only ever split, so there are never more than positions
    size, head = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
    size[:n_classes] = np.diff(heads, append=n)
    head[:n_classes] = order[heads]
    nxt, prv, since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
    inner = np.flatnonzero(~new[1:])
    nxt[order[inner]], prv[order[inner + 1]] = order[inner + 1], order[inner]

    found: list[tuple[np.ndarray, np.ndarray]] = []

    def give(at: np.ndarray, level: int) -> None:
        """The squares among positions whose next neighbour has been the same up to this level."""
        gap = nxt[at] - at
        ok = (nxt[at] >= 0) & (since[at] <= gap) & (gap <= level) & (at + 2 * gap <= end[at])
        if ok.any():
            found.append((at[ok], gap[ok]))

    def largest_left_out(family: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """False for one largest class of each family."""
        by = np.lexsort((sizes, family))
        keep = np.ones(len(family), bool)
        keep[by[np.flatnonzero(np.append(family[by[1:]] != family[by[:-1]], True))]] = False
        return keep

    small = largest_left_out(text[order[heads]], size[:n_classes])
    splitters = np.flatnonzero(small[label])
    moved_flag = np.zeros(n, bool)
    level, top = 1, int(np.diff(bounds).max()) // 2
    starts, ends_of = bounds[:-1], bounds[1:]
    while len(splitters) and level < top:
        goes_on = ends_of - starts >= level
        starts, ends_of = starts[goes_on], ends_of[goes_on]
        np.subtract.at(size, label[ends_of - level], 1)  # no factor of the next length starts here
        left = splitters[splitters > first[splitters]] - 1
        left = np.sort(left[(size[label[left]] > 1) & (left + level < end[left])])
        if not len(left):
            break
        key = label[left] * (n + 1) + label[left + 1]
        by = np.argsort(key, kind="stable")
        left, key = left[by], key[by]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # where each group starts
        of, count = label[left[at]], np.diff(at, append=len(left))
        family = np.cumsum(np.append(True, of[1:] != of[:-1])) - 1
        parents = of[np.flatnonzero(np.append(True, of[1:] != of[:-1]))]
        rest = size[parents] - np.bincount(family, count).astype(np.int64)
        # where nothing is left over, the largest group stays what its class was
        stays = ~largest_left_out(family, count) & (rest[family] == 0)
        inside = np.repeat(~stays, count)
        moved, groups = left[inside], np.flatnonzero(~stays)
        level += 1
        if not len(moved):
            break
        give(moved, level - 1)
        moved_flag[moved] = True
        in_order = moved[np.lexsort((moved, label[moved]))]
        before, after = prv[in_order], nxt[in_order]
        lefts = before[(before < 0) | ~moved_flag[before]]
        right_of = (after < 0) | ~moved_flag[after]
        rights, owners = after[right_of], label[in_order[right_of]]
        moved_flag[moved] = False
        has = lefts >= 0
        give(lefts[has], level - 1)
        nxt[lefts[has]] = rights[has]
        since[lefts[has]] = level
        prv[rights[rights >= 0]] = lefts[rights >= 0]
        head[owners[~has]] = rights[~has]
        # the groups become classes
        sizes = count[groups]
        names = n_classes + np.arange(len(groups))
        n_classes += len(groups)
        if n_classes > len(size):
            size, head = (np.append(a, np.zeros(max(n, len(groups)), np.int64)) for a in (size, head))
        size[names] = sizes
        np.subtract.at(size, of[groups], sizes)
        label[moved] = np.repeat(names, sizes)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        head[names] = moved[begin]
        nxt[moved[:-1]], prv[moved[1:]] = moved[1:], moved[:-1]
        nxt[moved[ends - 1]], prv[moved[begin]] = -1, -1
        since[moved] = level
        # all but the largest class of each family split on
        kept = np.flatnonzero(np.bincount(family[groups], minlength=len(parents)) > 0)
        use = largest_left_out(np.concatenate([family[groups], kept]), np.concatenate([sizes, size[parents[kept]]]))
        splitters = moved[np.repeat(use[: len(groups)], sizes)]
        rest = parents[kept[use[len(groups) :]]]
        if len(rest):
            if size[rest].max() > WALK:
                wanted = np.zeros(n_classes, bool)
                wanted[rest] = True
                others = np.flatnonzero(wanted[label])
                splitters = np.concatenate([splitters, others[others + level <= end[others]]])
            else:
                parts, walk = [splitters], head[rest]
                while len(walk := walk[(walk >= 0) & (walk + level <= end[walk])]):
                    parts.append(walk)
                    walk = nxt[walk]
                splitters = np.concatenate(parts)
    give(np.flatnonzero(nxt >= 0), n)
    if not found:
        return none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of at least so many words, by start, then period. Starts count through all texts."""
    at, root = squares(words, bounds)
    if not len(at):
        return at, at, at
    by = np.lexsort((at, root))
    at, root = at[by], root[by]
    begin = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (at[1:] != at[:-1] + 1)))
    count = np.diff(begin, append=len(at))
    start, period = at[begin], root[begin]
    length = count - 1 + 2 * period
    keep = np.flatnonzero(length >= least)
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], length[keep], period[keep]


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by single blanks."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[keep]
    starts, lens = starts[keep], (ends - starts)[keep]
    between = np.append(text[1:] == text[:-1], False) if len(text) else np.zeros(0, bool)
    lens = lens + between
    cum = np.cumsum(lens)
    total = int(cum[-1]) if len(cum) else 0
    out = np.append(buf, np.uint8(32))[np.repeat(starts - cum + lens, lens) + np.arange(total)]
    out[cum[between] - 1] = 32
    offsets = np.append(0, cum)[np.searchsorted(text, np.arange(len(bounds)))]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs' columns but text, plus runs and collapsed, the text without what runs repeat.

    runs: (start, length, period) of every maximal stretch of at least `least` words, and of two periods, with that smallest period,
    by start, then period; words are told apart by 64-bit hashes. collapsed: the words that are in no run after its first
    period, joined by one blank. Null, empty and blank texts have no runs and an empty
    collapsed text. Repeated rows and null ids are rows like others; an empty table stays empty. Columns of docs
    named runs or collapsed are replaced, any other passes through.
    """
    plain = [c for c in docs.columns if c not in ("text", "runs", "collapsed")]
    rows = docs.select(F.struct(F.lit(0).alias("pr_none"), *[F.col(f"`{c}`") for c in plain]).alias("pr_row"), "text")

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            for at, to, buf, offsets in text_chunks(b.column("text"), CHUNK_BYTES):
                starts, ends = word_spans(buf, offsets)
                bounds = np.searchsorted(starts, offsets)
                start, length, period = runs(word_hashes(buf, starts, ends, lower=False), bounds, least)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.subtract.at(edge, start + length, 1)
                collapsed = _joined(buf, starts, ends, np.cumsum(edge[:-1]) == 0, bounds)
                own = np.searchsorted(start, bounds)
                text = np.repeat(np.arange(to - at), np.diff(own))
                values = pa.StructArray.from_arrays([pa.array(start - bounds[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                found = pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), values).cast(kind)
                yield pa.RecordBatch.from_arrays([b.column("pr_row").slice(at, to - at), found, collapsed], ["pr_row", "runs", "collapsed"])

    schema = T.StructType([rows.schema["pr_row"], *T._parse_datatype_string(f"runs {RUN}, collapsed string").fields])
    return rows.mapInArrow(tidy(run), schema).select(*[F.col(f"pr_row.`{c}`") for c in plain], "runs", "collapsed")


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with the words of every tenth text, by crc32 of doc_id (null: of nothing), made periodic from some word on."""
    draw = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(draw / 10).cast("long")

    def altered(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        places = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")).otherwise("")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({SPACE_WORD})"), F.lit(1))
    return docs.withColumn("text", F.when(crc_mod(F.col("doc_id"), 10) == 0, let(words, altered)).otherwise(F.col("text")))


def digest(found: DataFrame) -> DataFrame:
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("pr_top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("pr_top.start")).alias("start"), F.col("pr_top.length").alias("length"), (-F.col("pr_top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("pr_top.length") / -F.col("pr_top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find_runs(with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))))
