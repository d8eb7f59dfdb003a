"""Line dedup (native): an exact set-similarity self-join over the corpus' lines.

A line is the set of its lower-cased words, ordered from rare to
frequent. Lines match when the Jaccard similarity of their sets reaches 0.8; a line
is removed when an earlier one (by document id, then line number) matches
it. Equal sets are joined as one. Families of similar lines are met first: each set is
compared with the most repeated and with the earliest set that share one of its rarest words, which takes
as many comparisons as there are sets, however large the family. What found no match there is
joined on the whole prefix; prefix, length and positional filters and a parity bitmap of the
words leave few pairs to verify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, let, stage, table

NUM, DEN = 8, 10
BUCKET_BITS = 16
BLOOM_WORDS = 1 << 16
#: Sets of more words have a parity bitmap of 128 bits, others of 64.
NARROW = 48
#: So many numbers of sets are sent to every executor at most; more are joined by exchange.
BROADCAST_SIDS = 1 << 19
#: Added to the place of words of sets that have found a match.
DONE = 1 << 30


def _table(spark, values: list[int], name: str) -> Column:
    """An array of fixed size as a written one-row table, read once by each plan: plans don't hold its values."""
    text = F.lit(",".join(map(str, values)))
    return stage(spark.range(1).select(F.split(text, ",").cast("array<bigint>").alias("v")), name).scalar()


def _hashes(line: Column) -> Column:
    """Hashes of a line's distinct lower-cased words. Other white space becomes blanks first, where there is any: splitting at one character is several times faster than at a pattern."""
    low = F.lower(line)
    plain, odd = low, F.lit(False)
    for mark in "\t\r\x0b\x0c":
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
        odd = odd | F.contains(line, F.lit(mark))
    words = F.split(F.when(odd, plain).otherwise(low), " ", -1)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS)


def rarity(docs: DataFrame) -> Column:
    """An array by bucket of word hashes: what turns the bucket into its rank from rare to frequent. Counted over all texts; of fixed size."""
    words = docs.select(F.explode(F.split(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")), " ", -1)).alias("w"))
    counted = {r["b"]: r["n"] for r in words.groupBy(_bucket(F.xxhash64("w")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    size = 1 << BUCKET_BITS
    rank = [0] * size
    for i, b in enumerate(sorted(range(size), key=lambda b: (counted.get(b, 0), b))):
        # exchanges a hash's upper bits, the bucket, for the rank when it is xored to it
        moved = ((i - size // 2) << (64 - BUCKET_BITS)) ^ (b << (64 - BUCKET_BITS))
        rank[b] = (moved + (1 << 63)) % (1 << 64) - (1 << 63)
    return _table(docs.sparkSession, rank, "rarity")


def _token_set(line: Column, rank: Column) -> Column:
    """Sorted distinct words as numbers: the bucket's rank above the other bits of the hash, so rare words come first."""
    return let(rank, lambda r: F.sort_array(F.transform(_hashes(line), lambda h: F.get(r, _bucket(h).cast("int")).bitwiseXOR(h))))


def _ceil(n: Column, num: int, den: int) -> Column:
    return F.floor((n * num + (den - 1)) / den).cast("int")


def _later(doc: Column, other: Column, or_same: bool) -> Column:
    """Whether a document comes after the other; null ids come first."""
    after = other.isNull() & doc.isNotNull() | (other < doc)
    return F.coalesce((after | doc.eqNullSafe(other)) if or_same else after, F.lit(False))


def _may_match(a, b, num: int, den: int) -> Column:
    """Length and positional filters and the parity bitmap, for two entries that share a word: every matching pair passes."""
    least = _ceil(a("size") + b("size"), num, num + den)
    low, high = a("low").bitwiseXOR(b("low")), a("high").bitwiseXOR(b("high"))
    # folded together, both halves are the narrow bitmap
    apart = F.when((a("size") > NARROW) & (b("size") > NARROW), F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))
    return (
        (den * F.least(a("size"), b("size")) >= num * F.greatest(a("size"), b("size")))
        & (F.least(a("size") - a("at"), b("size") - b("at")) >= least)
        & (apart <= a("size") + b("size") - 2 * least)
    )


def removals(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, text_key, line, n_chars of every line that an earlier one matches.

    Rows with equal doc_id and text are one document, so repeated rows lose the
    same lines. Null ids come first; null texts have no lines; lines without
    words stay. Other columns are not looked at.
    An empty table has no removals.
    """
    rank = rarity(docs)

    def described(t: Column) -> Column:
        size = F.size(t)
        zero = F.lit(0).cast("long")

        def bit(h: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))

        def part(k: int) -> Column:
            return F.aggregate(t, zero, lambda a, h: F.when(h.bitwiseAND(F.lit(64)) == 64 * k, a.bitwiseXOR(bit(h))).otherwise(a))

        wide = size > NARROW
        low = F.when(wide, part(0)).otherwise(F.aggregate(t, zero, lambda a, h: a.bitwiseXOR(bit(h))))
        high = F.when(wide, part(1)).otherwise(zero)
        # half of a word's number is enough to meet; candidates are verified on whole sets
        prefix = F.transform(F.slice(t, F.lit(1), size - _ceil(size, num, den) + 1), lambda h: h.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
        return F.struct(F.xxhash64(t).alias("sid"), size.alias("size"), low.alias("low"), high.alias("high"), prefix.alias("prefix"))

    made = _lines(docs).withColumn("rarity", rank).select("doc_id", "text_key", "line", F.length("text").cast("int").alias("n_chars"), let(_token_set(F.col("text"), F.col("rarity")), described).alias("set"))
    staged = stage(made, "lines")
    lines = staged.where("set.size > 0").select("doc_id", "text_key", "line", "n_chars", "set.*")
    pos = F.struct("doc_id", "text_key", "line")
    sets = stage(lines.groupBy("sid", "size", "low", "high").agg(F.min(pos).alias("first"), F.count(F.lit(1)).alias("n"), F.first("prefix").alias("prefix")), "sets")

    def entries(of: DataFrame, words: Column, *more: str) -> DataFrame:
        return of.select("sid", "size", "low", "high", F.col("first.doc_id").alias("doc"), *more, F.posexplode(words).alias("at", "token"))

    upto = (Window.unboundedPreceding, Window.currentRow)
    place = [F.col("doc").asc_nulls_first(), "sid"]
    hub = F.first(F.struct("sid", "size", "low", "high", "doc", "at"))
    # two matching sets of one size share one of these words at least
    met = entries(sets, F.slice("prefix", F.lit(1), F.col("size") - _ceil(2 * F.col("size"), num, num + den) + 1), "n")
    met = met.withColumn("common", hub.over(Window.partitionBy("token").orderBy(F.desc("n"), *place).rowsBetween(*upto)))
    met = met.withColumn("early", hub.over(Window.partitionBy("token").orderBy(*place).rowsBetween(*upto)))

    def passes(name: str) -> Column:
        return _later(F.col("doc"), F.col(f"{name}.doc"), or_same=False) & _may_match(F.col, lambda c: F.col(f"{name}.{c}"), num, den)

    near = met.select(F.col("sid").alias("a"), F.explode(F.array_compact(F.array(*[F.when(passes(x), F.col(f"{x}.sid")) for x in ("common", "early")]))).alias("b"))
    near = stage(near.distinct(), "near")
    found = _verified(near, docs, rank, sets, num, den)
    done = stage(found.select(F.col("a").alias("sid")).distinct(), "done")
    discard(near)

    # sets that are done still count as earlier ones. Their mark is in the place of the word, so that both sides of the join are one exchange
    open_ = entries(sets.join(_small(done.withColumn("done", F.lit(True)), done), "sid", "left"), F.col("prefix"), "done").withColumn("at", F.col("at") + F.when(F.col("done"), DONE).otherwise(0)).drop("done")
    a, b = (open_.select("token", *[F.col(c).alias(f"{x}_{c}") for c in ("sid", "size", "low", "high", "doc", "at")]) for x in "ab")
    pairs = a.join(b, "token").where(
        (F.col("a_sid") != F.col("b_sid")) & _later(F.col("a_doc"), F.col("b_doc"), or_same=True)
        & _may_match(lambda c: F.col(f"a_{c}"), lambda c: F.col("b_at") % DONE if c == "at" else F.col(f"b_{c}"), num, den)
    )
    # all that a pair shares up to its last common word, and what both still have after it
    shared = pairs.groupBy(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.max("a_size").alias("na"), F.max("b_size").alias("nb"), F.max("a_at").alias("a_at"), F.max(F.col("b_at") % DONE).alias("b_at"))
    most = F.col("n") + F.least(F.col("na") - F.col("a_at"), F.col("nb") - F.col("b_at")) - 1
    pairs = stage(shared.where(most >= _ceil(F.col("na") + F.col("nb"), num, num + den)).select("a", "b"), "pairs")
    checked = _verified(pairs, docs, rank, sets, num, den)
    discard(pairs)
    # sets of one document can be in either order
    firsts = sets.select("sid", "first")
    more = _small(checked, checked).join(firsts.withColumnsRenamed({"sid": "a", "first": "at"}), "a")
    more = _small(more, checked).join(firsts.withColumnsRenamed({"sid": "b", "first": "before"}), "b").where("before < at")
    gone = stage(done.select("sid").union(more.select("a")).distinct(), "gone")
    repeated = sets.join(_small(gone.withColumn("gone", F.lit(True)), gone), "sid", "left").where("n > 1 OR gone").select("sid", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    out = stage(lines.select("doc_id", "text_key", "line", "n_chars", "sid").join(repeated, "sid").where(F.col("gone") | (pos > F.col("first"))).select("doc_id", "text_key", "line", "n_chars").distinct(), "removed")
    for df in (staged, sets, found, done, gone, checked):
        discard(df)
    return out


def _small(df: DataFrame, counted: DataFrame) -> DataFrame:
    """df for a broadcast, if counted, a written table with as many rows or more, is small."""
    return F.broadcast(df) if counted.count() <= BROADCAST_SIDS else df


def _bloom(values: DataFrame):
    """A bitmap of fixed size over a column of longs: a test for columns."""
    (name,) = values.columns

    def bit(value: Column) -> tuple[Column, Column]:
        slot = F.pmod(value, F.lit(64 * BLOOM_WORDS))
        return F.floor(slot / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))

    word, one = bit(F.col(name))
    words = {r["word"]: r["bits"] for r in values.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).collect()}
    table = _table(values.sparkSession, [words.get(i, 0) for i in range(BLOOM_WORDS)], "bloom")

    def maybe(value: Column) -> Column:
        word, one = bit(value)
        return F.get(table, word).bitwiseAND(one) != 0

    return maybe


def _lines(docs: DataFrame) -> DataFrame:
    # hashed before, so that no line carries its whole text along
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    return keyed.select("doc_id", "text_key", F.posexplode("lines").alias("line", "text"))


def _verified(pairs: DataFrame, docs: DataFrame, rank: Column, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole token sets are similar enough, staged. Only lines that stand for a set in a pair are read into words again."""
    sids = stage(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "sids")
    places = sets.join(_small(sids, sids), "sid", "left_semi").select("sid", F.xxhash64("first.doc_id", "first.text_key").alias("doc"), F.xxhash64("first.doc_id", "first.text_key", "first.line").alias("place"))
    places = stage(places, "places")
    in_docs, in_places = _bloom(places.select("doc")), _bloom(places.select("place"))
    here = F.xxhash64("doc_id", "text_key", "line")
    read = _lines(docs.where(in_docs(F.xxhash64("doc_id", F.xxhash64("text"))))).withColumn("here", here).where(in_places(F.col("here")))
    wanted = read.withColumn("rarity", rank).select("here", _token_set(F.col("text"), F.col("rarity")).alias("tokens")).withColumn("sid", F.xxhash64("tokens"))
    whole = wanted.join(places, "sid").where("here = place").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    whole = stage(whole, "whole")
    both = pairs.join(whole.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a").join(whole.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    out = stage(both.where(den * common >= num * (F.size("ta") + F.size("tb") - common)).select("a", "b"), "links")
    for df in (whole, places, sids):
        discard(df)
    return out


def _per_document(removed: DataFrame) -> DataFrame:
    return removed.groupBy(F.col("doc_id").alias("r_doc_id"), F.col("text_key").alias("r_text_key")).agg(
        F.sort_array(F.collect_list("line")).alias("removed"), F.sum(F.col("n_chars") + 1).alias("removed_chars"))


def dedup(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """docs with the removed lines taken out of text; n_chars, where it exists, follows. No row is dropped; other columns pass through, whatever their names."""
    found = _per_document(removals(docs.select("doc_id", "text"), num, den))
    keyed = docs.select(F.struct("*").alias("r_row"), F.xxhash64("text").alias("r_key"))
    out = keyed.join(found, F.col("r_row.doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("r_key") == F.col("r_text_key")), "left")

    def without(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda i: F.get(lines, i)), "\n")

    out = out.withColumn("r_text", F.when(F.col("removed").isNotNull(), let(F.split("r_row.text", "\n", -1), without)).otherwise(F.col("r_row.text")))
    n_chars = F.when(F.col("removed").isNotNull(), F.length("r_text")).otherwise(F.col("r_row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("r_text"), "n_chars": n_chars}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"r_row.`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _per_document(removals(docs))
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    base = base.withColumn("n_lines", F.greatest("n_lines", F.lit(0).cast("long")))
    out = base.join(found, base["doc_id"].eqNullSafe(found["r_doc_id"]) & (base["text_key"] == found["r_text_key"]), "left")
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    n = F.when(F.col("removed").isNull(), F.lit(0).cast("long")).otherwise(n)
    # the last line has no line end of its own
    kept = F.greatest(F.col("chars") - F.coalesce("removed_chars", F.lit(0)) + F.when((n > 0) & (n == F.col("n_lines")), 1).otherwise(0), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_removed"), F.array_join(F.coalesce("removed", F.array().cast("array<int>")).cast("array<string>"), ",").alias("removed_lines"), kept.alias("kept_chars"))


def _removed_ctes(docs: str, prefix: str = "ld_") -> str:
    """WITH entries that end in {prefix}removed(doc_id, line, n_chars): prefix filtering by exact word counts."""
    p = prefix
    return f"""{p}lines AS (
  SELECT doc_id, line - 1 AS line, length(t) AS n_chars, list_distinct(list_filter(string_split_regex(lower(t), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS own
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM {docs} WHERE text IS NOT NULL)
), {p}kept AS (SELECT doc_id, line, n_chars, list_sort(own) AS own FROM {p}lines WHERE len(own) > 0
), {p}sets AS (
  SELECT *, row_number() OVER (ORDER BY own) AS sid FROM (SELECT own, len(own) AS size, min((doc_id, line)) AS first FROM {p}kept GROUP BY own)
), {p}words AS (SELECT sid, size, unnest(own) AS w FROM {p}sets
), {p}counts AS (SELECT w, count(*) AS n FROM {p}words GROUP BY w
), {p}ranked AS (
  SELECT sid, size, w, row_number() OVER (PARTITION BY sid ORDER BY n, w) AS place FROM {p}words JOIN {p}counts USING (w)
), {p}prefix AS (SELECT sid, size, w FROM {p}ranked WHERE place <= size - ({NUM} * size + {DEN} - 1) // {DEN} + 1
), {p}pairs AS (
  SELECT DISTINCT a.sid AS a, b.sid AS b FROM {p}prefix a JOIN {p}prefix b ON a.w = b.w AND a.sid < b.sid AND {DEN} * least(a.size, b.size) >= {NUM} * greatest(a.size, b.size)
), {p}links AS (
  SELECT a, b FROM (SELECT p.a, p.b, x.size + y.size AS total, len(list_intersect(x.own, y.own)) AS common FROM {p}pairs p JOIN {p}sets x ON x.sid = p.a JOIN {p}sets y ON y.sid = p.b)
  WHERE {DEN} * common >= {NUM} * (total - common)
), {p}near AS (
  SELECT sid, min(first) AS near FROM (SELECT l.a AS sid, s.first FROM {p}links l JOIN {p}sets s ON s.sid = l.b UNION ALL SELECT l.b, s.first FROM {p}links l JOIN {p}sets s ON s.sid = l.a) GROUP BY sid
), {p}removed AS (
  SELECT k.doc_id, k.line, k.n_chars FROM {p}kept k JOIN {p}sets s USING (own) LEFT JOIN {p}near n USING (sid) WHERE (k.doc_id, k.line) > least(s.first, coalesce(n.near, s.first))
)"""


def sql() -> str:
    return f"""
WITH {_removed_ctes("documents")},
per_doc AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines, sum(n_chars + 1)::BIGINT AS chars FROM ld_removed GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(lines, '') AS removed_lines,
  greatest(coalesce(length(text), 0) - coalesce(chars, 0) + CASE WHEN n = len(string_split(text, chr(10))) THEN 1 ELSE 0 END, 0)::BIGINT AS kept_chars
FROM documents LEFT JOIN per_doc USING (doc_id)"""
