"""Packing by lexical retrieval: each seed's window is filled with its BM25 neighbours.

Term statistics are counted over all documents. Documents are dealt to
partitions by their rarest term that others have too, and each partition, in the order of these terms, is cut
into shards of a bounded number of tokens, each a BM25 index; so documents that share rare
terms meet in one shard wherever they are stored. Terms with more documents than a partition's
share are spread over all of them. A seed document is laid out, and the room left in its
last window goes to its best unused neighbours; a neighbour that does not
fit is cut and becomes the next seed. Copies of a document that is in the open window
wait for another one. Windows stay open between shards, and
what is left at the end of a task is cut at powers of two, so
nothing is padded.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, tidy
from .textcols import mix64, text_chunks, tokens

LENGTH = 1024
END = 0
TERM_BITS = 18
K1, B = 1.2, 0.75
#: A shard's index ends with the document that reaches either bound.
SHARD_TOKENS, SHARD_DOCS = 1 << 21, 2048
#: Words of a partition that documents are dealt to, about.
PARTITION_WORDS = 1 << 22
#: A term that more than one in so many of a shard's documents have is held as a row over all of them.
DENSE = 16
SEEDS = 256
CACHE_WORDS = 1 << 18
#: Texts encoded together, in bytes.
ENCODE_BYTES = 2 << 20
#: Two white-space characters of Unicode in a row, for RE2.
_RUN = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"


class ByteBpe:
    """An encoder for a byte-level BPE vocabulary that splits before single blanks.

    Where no two white-space characters meet, a blank always starts
    a piece of its own, so texts are cut there, each different word of a
    batch is looked up once, and words are remembered.
    Strings in `added` have an id of their own; what lies between them is encoded by itself.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = added
        self.own = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(piece) for piece in ranks]
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        if self.own is None:
            return self._ids(text)
        parts, at = [], 0
        for m in self.own.finditer(text):
            parts += [self._ids(text[at : m.start()]), np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*parts, self._ids(text[at:])])

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a blank. New words are encoded in one go; no piece crosses the blank between two of them."""
        known = self.known
        out = list(map(known.get, words))
        places = [i for i, ids in enumerate(out) if ids is None]
        if places:
            new = [words[i] for i in places]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in new])
            cuts = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
            flat, at = ids.tobytes(), 0
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
            for i, word, to in zip(places, new, cuts, strict=True):
                out[i] = known[word] = flat[at:to]
                at = to
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text]), ())[0]

    def batch(self, texts: pa.Array, tail: tuple[int, ...]) -> list[np.ndarray]:
        """The ids of each text and then those of tail; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, _RUN)
        for name in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = odd.to_numpy(zero_copy_only=False)
        end = np.array(tail, "<u4").tobytes()
        out: list = [np.frombuffer(self._whole(t.as_py()) + end, "<u4") if o else None for t, o in zip(texts, odd, strict=True)] if odd.any() else [None] * len(texts)
        rows = np.flatnonzero(~odd)
        if not len(rows):
            return out
        parts = pc.split_pattern(texts.take(rows) if odd.any() else texts, " ")
        words = parts.flatten()
        at = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
        coded = words.dictionary_encode()
        # a text's first word stands after no blank
        table = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        units = coded.indices.to_numpy().astype(np.int64)
        units[at[:-1]] = len(table) + np.arange(len(rows))
        table += map(self._ids, words.take(at[:-1]).to_pylist())
        units = np.insert(units, at[1:], len(table))
        table.append(end)
        lens = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, starts, n = np.frombuffer(b"".join(table), "<u4"), np.cumsum(lens) - lens, lens[units]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[units] - ends + n, n)]
        cuts = np.concatenate([[0], ends[at[1:] + np.arange(len(rows))]])
        for r, a, b in zip(rows.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[r] = ids[a:b]
        return out


@cache
def public_encoder(name: str = "byte_bpe_50k") -> ByteBpe:
    """One encoder for each worker process, so what it remembers lasts from task to task."""
    import public_tokenizers as P

    with open(P.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return ByteBpe(P.path(f"{name}.tiktoken"), P.PATTERN, added)


def _slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _terms(column: pa.Array):
    """For each text its distinct term slots, their counts and its number of words."""
    for at, end, buf, offsets in text_chunks(column):
        words, bounds = tokens(buf, offsets)
        n_words = np.diff(bounds)
        both = np.sort((np.repeat(np.arange(end - at), n_words) << TERM_BITS) | _slots(words))
        first = np.flatnonzero(np.diff(both, prepend=-1))
        tf = np.diff(first, append=len(both))
        both = both[first]
        cuts = np.searchsorted(both, np.arange(end - at + 1) << TERM_BITS)
        slot = (both & ((1 << TERM_BITS) - 1)).astype(np.int32)
        for i in range(end - at):
            own = slice(cuts[i], cuts[i + 1])
            yield slot[own], tf[own], int(n_words[i])


class Statistics:
    """Document frequency of each term slot, numbers of documents and words: of fixed size."""

    def __init__(self, df: np.ndarray, n_docs: int, n_words: int):
        self.df, self.n_docs, self.n_words = df, n_docs, n_words
        self.mean_words = max(1.0, n_words / max(n_docs, 1))
        self.idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        #: From rare to frequent; slots of one document only come last, as nothing is found by them.
        self.order = np.empty(len(df), np.int64)
        self.order[np.argsort(np.where(df < 2, np.inf, df), kind="stable")] = np.arange(len(df))


def statistics(docs: DataFrame) -> Statistics:
    def count(batches):
        df, words, n = np.zeros(1 << TERM_BITS, np.int64), 0, 0
        for b in batches:
            for slot, _, w in _terms(b.column("text")):
                df[slot] += 1
                words += w
                n += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(df[seen], [words, n]))], ["slot", "n"])

    got = docs.select("text").mapInArrow(tidy(count), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(1 << TERM_BITS)
    df[slot[slot >= 0]] = n[slot >= 0]
    return Statistics(df, int(n[slot == -2].sum()), int(n[slot == -1].sum()))


def _rarest(column: pa.Array, order: np.ndarray) -> np.ndarray:
    """For each text a number made of its two rarest terms; texts without words come last."""
    out = []
    for at, end, buf, offsets in text_chunks(column):
        words, bounds = tokens(buf, offsets)
        last = len(order)
        rank = np.append(order[_slots(words)], last)
        has = np.diff(bounds) > 0
        first = np.full(end - at, last)
        second = first.copy()
        if has.any():
            at_words = bounds[:-1][has]
            first[has] = np.minimum.reduceat(rank[:-1], at_words)
            rank[:-1][rank[:-1] == np.repeat(first, np.diff(bounds))] = last
            second[has] = np.minimum.reduceat(rank[:-1], at_words)
        out.append((first << (TERM_BITS + 1)) | second)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _dealt(docs: DataFrame, stats: Statistics) -> DataFrame:
    """doc_id and text, in as many partitions as the words need, each in the order of the documents' rarest terms.

    A term goes to one partition with the documents that it is the rarest of. Where it is in more documents than a partition's
    share, these are dealt over all partitions, row by row, in no lexical order.
    """
    spark = docs.sparkSession
    shift = TERM_BITS + 1
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stats.n_words // PARTITION_WORDS), 1)
    part = np.empty((1 << TERM_BITS) + 1, np.int32)
    part[stats.order] = np.where(stats.df * n_parts > stats.n_docs, -1, mix64(np.arange(len(stats.df)).astype(np.uint64)) % np.uint64(n_parts))
    part[-1] = -1  # texts without words
    order, parts = spark.sparkContext.broadcast(stats.order), spark.sparkContext.broadcast(part)

    def deal(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for b in batches:
            key = _rarest(b.column("text"), order.value)
            part = parts.value[key >> shift]
            spread = mix64(np.arange(row, row + b.num_rows).astype(np.uint64))
            row += b.num_rows
            hot = part < 0
            part = np.where(hot, (spread % np.uint64(n_parts)).astype(np.int32), part)
            key = np.where(hot, (spread >> np.uint64(64 - 2 * shift)).astype(np.int64), key)
            yield b.append_column("pack_part", pa.array(part.astype(np.int32))).append_column("pack_key", pa.array(key))

    schema = T.StructType([*docs.select("doc_id", "text").schema.fields, T.StructField("pack_part", T.IntegerType()), T.StructField("pack_key", T.LongType())])
    dealt = docs.select("doc_id", "text").mapInArrow(tidy(deal), schema).repartitionById(n_parts, F.col("pack_part"))
    return dealt.sortWithinPartitions("pack_key", "doc_id").select("doc_id", "text")


class Shard:
    """A BM25 index over some documents that hands out each of them once.

    names: equal for equal documents, which are kept out of one window.
    """

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray, int]], stats: Statistics, names: list[int]):
        self.names, n = names, len(terms)
        doc = np.repeat(np.arange(n), [len(s) for s, _, _ in terms])
        slot = np.concatenate([s for s, _, _ in terms])
        tf = np.concatenate([t for _, t, _ in terms])
        norm = K1 * (1 - B + B * np.array([w for _, _, w in terms]) / stats.mean_words)
        order = np.argsort(slot, kind="stable")
        self.doc = doc[order]
        self.weight = (stats.idf[slot] * tf * (K1 + 1) / (tf + norm[doc]))[order]
        self.slots, self.at, place = np.unique(slot[order], return_index=True, return_inverse=True)
        self.at = np.append(self.at, len(order))
        back = np.empty(len(order), np.int64)
        back[order] = place
        self.own = np.split(back, np.cumsum([len(s) for s, _, _ in terms])[:-1])  # each document's places in slots
        self.df = np.diff(self.at)
        frequent = np.flatnonzero(self.df * DENSE > n)
        self.row = np.full(len(self.slots), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), n), np.float32)
        for row, k in zip(self.dense, frequent, strict=True):
            row[self.doc[self.at[k] : self.at[k + 1]]] = self.weight[self.at[k] : self.at[k + 1]]
        self.blocks: dict[int, np.ndarray] = {}
        self.copies: dict[int, list[int]] = {}
        for i, name in enumerate(names):
            self.copies.setdefault(name, []).append(i)
        self.free = np.ones(n, bool)
        self.next = 0

    def take(self, i: int) -> int:
        self.free[i] = False
        return i

    def seed(self, held: set[int]) -> int | None:
        """The next unused document, if there is one that isn't a copy of one held: such a one."""
        while self.next < len(self.free) and not self.free[self.next]:
            self.next += 1
        if self.next == len(self.free):
            return None
        if self.names[self.next] in held:
            for i in np.flatnonzero(self.free[self.next :]) + self.next:
                if self.names[i] not in held:
                    return self.take(int(i))
        return self.take(self.next)

    def _frequent(self, i: int) -> np.ndarray:
        """What the frequent terms add to the scores, a block of seeds at a time."""
        block = i // SEEDS
        if block not in self.blocks:
            own = self.own[block * SEEDS : (block + 1) * SEEDS]
            has = np.zeros((len(own), len(self.dense)), np.float32)
            for r, places in zip(has, own, strict=True):
                k = self.row[places]
                r[k[k >= 0]] = 1
            self.blocks[block] = has @ self.dense
        return self.blocks[block][i % SEEDS]

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document for all terms of document i."""
        k = self.own[i]
        k = k[(self.df[k] > 1) & (self.row[k] < 0)]  # terms that no other document has find nothing
        score = self._frequent(i).astype(float)
        if len(k):
            n = self.df[k]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(self.at[k] - ends + n, n)
            score += np.bincount(self.doc[at], self.weight[at], len(score))
        return score

    def neighbours(self, i: int, held: set[int]) -> Iterator[int]:
        """Unused documents that share any terms with document i, best first, without copies of those held; each is taken as it is given out."""
        score = self.scores(i)
        score[~self.free] = 0
        for name in held:
            if name in self.copies:
                score[self.copies[name]] = 0
        while True:
            best = int(np.argmax(score))
            if score[best] <= 0:
                return
            score[self.copies[self.names[best]]] = 0
            yield self.take(best)


class Packer:
    """Lays documents into windows; pieces are (row, start, ids, sequence, offset)."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.window: list[tuple[object, int, np.ndarray]] = []
        self.used = 0
        self.held: set[int] = set()  # names of the documents in the window

    def _close(self, parts: list[int]):
        """Gives out the open window as sequences of these lengths."""
        todo = list(self.window)
        for size in parts:
            offset = 0
            while offset < size:
                row, start, ids = todo.pop(0)
                cut = min(len(ids), size - offset)
                yield row, start, ids[:cut], self.sequence, offset
                offset += cut
                if cut < len(ids):
                    todo.insert(0, (row, start + cut, ids[cut:]))
            self.sequence += 1
        self.window, self.used, self.held = [], 0, set()

    def put(self, row, ids: np.ndarray, name: int):
        start = 0
        while start < len(ids):
            cut = min(len(ids) - start, self.length - self.used)
            self.window.append((row, start, ids[start : start + cut]))
            self.held.add(name)
            start += cut
            self.used += cut
            if self.used == self.length:
                yield from self._close([self.length])

    def finish(self):
        """Cuts what is left at powers of two."""
        yield from self._close([1 << k for k in range(self.used.bit_length() - 1, -1, -1) if self.used >> k & 1])

    def pack(self, rows: list, ids: list[np.ndarray], shard: Shard):
        seed = shard.seed(self.held)
        while seed is not None:
            yield from self.put(rows[seed], ids[seed], shard.names[seed])
            nxt = None
            if self.used:
                for other in shard.neighbours(seed, self.held):
                    fits = self.used + len(ids[other]) < self.length
                    if not fits:  # it closes this window; its rest opens the next one
                        nxt = other
                        break
                    yield from self.put(rows[other], ids[other], shard.names[other])
            seed = nxt if nxt is not None else shard.seed(self.held)


def pack(docs: DataFrame, stats: Statistics | None = None, length: int = LENGTH, encoder: Callable[[], ByteBpe] = public_encoder) -> DataFrame:
    """Pieces: doc_id, start, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are just their end id. Rows are packed one by one:
    repeated rows and null ids are documents of their own, other columns
    are not looked at, an empty table gives no pieces. A window holds two copies of one text
    only where its shard has nothing else left. Sequence numbers hold the
    task's partition in their upper bits.
    """
    small_batches(docs.sparkSession)
    stats = stats or statistics(docs)
    shared = docs.sparkSession.sparkContext.broadcast(stats)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, stats = encoder(), shared.value
        packer = Packer(length, TaskContext.get().partitionId() << 40)
        rows, ids, terms, names, held = [], [], [], [], 0

        def out(pieces):
            part, size = [], 0
            for p in pieces:
                part.append(p)
                size += 1
                if size == 4096:
                    yield batch(part)
                    part, size = [], 0
            if part:
                yield batch(part)

        def batch(part):
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0][0] for p in part], id_arrow), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2].tobytes() for p in part], pa.binary()),
                 pa.array([p[0][1] for p in part], pa.int64()), pa.array([p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())],
                ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        id_arrow = None
        for b in batches:
            id_arrow = b.schema.field("doc_id").type
            encoded = (own for from_, to, _, _ in text_chunks(b.column("text"), ENCODE_BYTES) for own in encode.batch(b.column("text").slice(from_, to - from_), (END,)))
            for doc_id, own, term in zip(b.column("doc_id").to_pylist(), encoded, _terms(b.column("text")), strict=True):
                rows.append((doc_id, len(own)))
                ids.append(own)
                terms.append(term)
                names.append(hash(own.tobytes()))
                held += len(own)
                if held >= SHARD_TOKENS or len(rows) == SHARD_DOCS:
                    yield from out(packer.pack(rows, ids, Shard(terms, stats, names)))
                    rows, ids, terms, names, held = [], [], [], [], 0
        if rows:
            yield from out(packer.pack(rows, ids, Shard(terms, stats, names)))
        yield from out(packer.finish())

    return _dealt(docs, stats).mapInArrow(tidy(run), f"doc_id {id_type}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
