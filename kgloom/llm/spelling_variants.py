"""Grouping of spelling variants: all pairs of words one edit apart, by range reporting.

For an edit at one position two words have the same characters before it and the same
after it. Words in forward order put equal beginnings into one interval, words in
reverse order equal endings; the words that have both are the points of a rectangle, which a
wavelet tree over the permutation between the two orders reports.

Spark deals the work out by what must agree. Words of m characters (points) meet
words of m (one replaced) and of m - 1 (one inserted) in frame m, for the edit
positions of a window [a, b): the first a and the last m - b characters are equal, which is the key.
At first a frame has two windows, its halves. A key with too many entries
is split into the two halves of its window, over and over; a window of
one position holds fewer words than there are characters, so every group ends up small.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage, table, tidy

LEAST_CHARS, LEAST_COUNT = 7, 2
#: A word's form is so many times as frequent.
RATIO = 10
#: A key with more entries is split.
GROUP = 1 << 15
#: Groups of one window handled together, in characters.
BLOCK_CHARS = 1 << 23
#: Distinct words that a task counts before it gives them out.
HELD = 1 << 18

_PIECES = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)


def vocabulary(docs: DataFrame, planted: int = 31) -> DataFrame:
    """(word, n): runs of Latin letters with A-Z lower-cased, of at least 7 characters, that occur twice or more.

    A run for which `planted` divides the crc32 of "doc_id:run" loses one character first, at that number modulo its length; 0: none does.
    Null texts have no words; a null doc_id counts as the empty text. Repeated rows count as often as they stand there.
    """

    def count(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])
            held.clear()
            return got

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                if not text.is_valid:
                    continue
                prefix = zlib.crc32(f"{doc_id.as_py()}:".encode() if doc_id.is_valid else b":")
                own = Counter(_PIECES.findall(text.as_buffer().to_pybytes().lower().decode()))  # bytes.lower() only knows A-Z
                for word, n in own.items():
                    if planted:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % planted == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_CHARS:
                                continue
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(count), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _entries(words: DataFrame, windows) -> DataFrame:
    """A row for each of a word's windows (m, a, b), with its key. windows: array column of them."""
    out = words.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.*")
    return out.withColumn("key", F.xxhash64("m", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, m - b)")))


def _halves(m, a, b):
    """The two halves of a window."""
    middle = F.floor((a + b) / 2).cast("int")
    return [F.struct(m.alias("m"), x.alias("a"), y.alias("b")) for x, y in ((a, middle), (middle, b))]


def _dealt(words: DataFrame, group: int) -> DataFrame:
    """All entries whose key others have too, staged: in groups of at most `group` entries, but for windows of one position."""
    size = F.char_length("word")
    zero = F.lit(0)
    todo, done = _entries(words, F.array(*[w for m in (size, size + 1) for w in _halves(m, zero, m)])), []
    while True:
        todo = stage(todo, "windows")
        sizes = todo.groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.max(F.col("b") - F.col("a")).alias("wide"))
        sizes = stage(sizes.where("entries > 1").select("key", ((F.col("entries") > group) & (F.col("wide") > 1)).alias("hot")), "sizes")
        # the sizes deal with far fewer keys than there are entries; keys of one entry are met by nothing
        marked = todo.join(sizes, "key")
        done.append(stage(marked.where("NOT hot").drop("hot"), "entries"))
        hot = marked.where("hot")
        if sizes.where("hot").isEmpty():
            discard(todo)
            discard(sizes)
            break
        smaller = stage(_entries(hot.select("word", "n", F.struct("m", "a", "b").alias("old")), F.array(*_halves(F.col("old.m"), F.col("old.a"), F.col("old.b")))).drop("old"), "halves")
        discard(todo)
        discard(sizes)
        todo = smaller
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


class WaveletTree:
    """Over a sequence of numbers below 2 ** bits: for each level, from the highest bit, how many zeros stand before each place."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            values = np.concatenate([values[one == 0], values[one == 1]])
        self.values = values

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for every value in [low, high) at a place in [left, right), of many rectangles at once."""
        query, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            l0, r0 = zeros[left], zeros[right]
            n_zeros = zeros[-1]
            parts = []
            for side, (l, r, base) in enumerate(((l0, r0, node), (left - l0 + n_zeros, right - r0 + n_zeros, node + half))):
                ok = (l < r) & (base < high[query]) & (base + half > low[query])
                parts.append((query[ok], l[ok], r[ok], base[ok]))
            query, left, right, node = (np.concatenate(p) for p in zip(*parts, strict=True))
        # the values are a permutation, so one place is left of each
        return query, node


def _spans(rows: np.ndarray, is_point: np.ndarray):
    """Order of the rows, common start of each with the one before, and points before each."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, np.append(-1, common), np.append(0, np.cumsum(is_point[order]))


def _interval(order: np.ndarray, common: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the points that share its first k characters, as an interval of their order."""
    begin = np.flatnonzero(common < k)
    block = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(order)))
    left, right = points[begin], points[np.append(begin[1:], len(order))]
    out = np.empty((2, len(order)), np.int64)
    out[0, order], out[1, order] = left[block], right[block]
    return out[0], out[1]


def near_in_frame(words: list[bytes], m: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places in words: word j, of m characters, is word i with one character in [a, b) replaced, or inserted there.

    words: of m and m - 1 characters of one byte each. Replacements come in both directions. Of the equal characters of a
    run, which give the same word, the first counts as the one inserted.
    """
    is_point = np.array([len(w) == m for w in words])
    forward = np.array(words, f"S{m}").view(np.uint8).reshape(len(words), m)
    backward = np.array([w[::-1] for w in words], f"S{m}").view(np.uint8).reshape(len(words), m)
    fo, fc, fp = _spans(forward, is_point)
    ro, rc, rp = _spans(backward, is_point)
    by_forward, by_reverse = fo[is_point[fo]], ro[is_point[ro]]
    place = np.empty(len(words), np.int64)
    place[by_reverse] = np.arange(len(by_reverse))
    tree = WaveletTree(place[by_forward]) if len(by_forward) else None
    found = []
    for k in range(a, b):
        if tree is None:
            break
        left, right = _interval(fo, fc, fp, k)
        low, high = _interval(ro, rc, rp, m - 1 - k)
        least = np.where(is_point, 2, 1)  # a word of m characters is in its own rectangle
        ask = np.flatnonzero((right - left >= least) & (high - low >= least))
        query, value = tree.report(left[ask], right[ask], low[ask], high[ask])
        i, j = ask[query], by_reverse[value]
        first = forward[j, k - 1] != forward[j, k] if k else np.ones(len(j), bool)
        ok = (i != j) & (is_point[i] | first)
        found.append((i[ok], j[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, near, near_n): every two words that differ by one inserted, deleted or replaced character, in both directions.

    words: distinct (word, n), of characters below U+0100. An empty table gives no rows.
    """

    def find(batches):
        held: list = []  # (m, a, b), words, counts of whole keys
        chars = 0

        def out():
            m, a, b = held[0][0]
            text, n = [w for _, _, w, _ in held], np.array([c for _, _, _, c in held])
            i, j = near_in_frame([w.encode("latin-1") for w in text], m, a, b)
            # an insertion was found from the shorter word only
            grown = np.flatnonzero(np.array([len(w) for w in text])[i] < m)
            i, j = np.concatenate([i, j[grown]]), np.concatenate([j, i[grown]])
            col = pa.array(text, pa.string())
            return pa.RecordBatch.from_arrays([col.take(pa.array(i)), pa.array(n[i]), col.take(pa.array(j)), pa.array(n[j])], ["word", "n", "near", "near_n"])

        for batch in batches:
            m, a, b, key = (batch.column(c).to_pylist() for c in ("m", "a", "b", "key"))
            for x in zip(zip(m, a, b, strict=True), key, batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if held and (x[0] != held[-1][0] or (chars >= BLOCK_CHARS and x[1] != held[-1][1])):
                    yield out()
                    held, chars = [], 0
                held.append(x)
                chars += x[0][0]
        if held:
            yield out()

    dealt = _dealt(words, group)
    return dealt.repartition("key").sortWithinPartitions("m", "a", "b", "key").mapInArrow(tidy(find), "word string, n bigint, near string, near_n bigint")


def variants(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of words, distinct (word, n).

    form: the most frequent near word (ties: the first in code-point order), if it is `ratio` times as frequent or
    more; root: where forms of forms end, the word itself without any. Words only reach
    more frequent ones, so there are no circles.
    """
    words = stage(words.select("word", "n"), "words")
    best = near_words(words, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("top"))
    joined = words.join(best, "word", "left")
    has = -F.col("top.minus") >= ratio * F.col("n")
    out = stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("top.form")).alias("form"), F.when(has, -F.col("top.minus")).alias("form_n")), "forms")
    discard(words)
    up = stage(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles how far a word looks; every step is `ratio` times as frequent
        far = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = stage(up.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(up)
        up = nxt
        if up.where("moved").isEmpty():
            break
    return out.join(up.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
