"""Periodic runs, spelling variants and fingerprints against brute force, with nulls, empties, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kgloom.llm import fingerprints, periodic_runs, spelling_variants

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(words, least):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            sub = words[i : j + q]
            if j - i >= q and len(sub) >= least and not any(sub[d:] == sub[:-d] for d in range(1, q)):
                out.append((i, len(sub), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_small_alphabets(seed):
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        n, k = r.randint(0, 60), r.randint(1, 4)
        own = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.5:
            a, p = r.randrange(n), r.randint(1, 9)
            own = [own[i] if i < a else own[min(n - 1, a + (i - a) % p)] for i in range(n)]
        texts.append(own)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    got = list(zip(*(x.tolist() for x in periodic_runs.runs(np.array(sum(texts, []), np.uint64), bounds, 2)), strict=True))
    assert got == [(int(bounds[i]) + s, n, q) for i, t in enumerate(texts) for s, n, q in brute_runs(t, 2)]


def test_large_remainders_are_scanned(monkeypatch):
    words = np.random.default_rng(3).integers(0, 3, 4000).astype(np.uint64)
    want = [x.tolist() for x in periodic_runs.runs(words, np.array([0, 4000]), 4)]
    monkeypatch.setattr(periodic_runs, "WALK", 0)
    assert [x.tolist() for x in periodic_runs.runs(words, np.array([0, 4000]), 4)] == want and len(want[0]) > 100


def altered(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def test_periodic_runs_query(spark, corpus, empty):
    extra = spark.createDataFrame([(9000 + i, "x y z " * i + " ".join(map(str, range(i))), "clash") for i in range(40)] + [(9100, "é ü\tß\x0bq " * 9, None)], "doc_id bigint, text string, runs string")
    docs = corpus.unionByName(extra, allowMissingColumns=True)
    rows = docs.collect()
    got = Counter(map(tuple, periodic_runs.digest(periodic_runs.find_runs(periodic_runs.with_periods(docs))).collect()))
    want, n_altered = Counter(), 0
    for r in rows:
        words = WORD.findall(r.text or "")
        n_altered += altered(r.doc_id, words) != words
        words = altered(r.doc_id, words)
        found = brute_runs(words, 12)
        top = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(w for i, w in enumerate(words) if i not in gone))]
        want[(r.doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digests)] += 1
    assert got == want and n_altered > 3 and any(k[1] for k in want)
    found = periodic_runs.find_runs(docs)
    assert found.columns == [c for c in docs.columns if c not in ("text", "runs")] + ["runs", "collapsed"]
    assert periodic_runs.find_runs(periodic_runs.with_periods(empty)).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts, ratio=10):
    form = {}
    n_near = {}
    for w, n in counts.items():
        around = [v for v in counts if v != w and near(v, w)]
        n_near[w] = len(around)
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (n, n_near[w], form[w], counts.get(form[w]), root(w)) for w, n in counts.items()}


@pytest.mark.parametrize("group", [3, spelling_variants.GROUP])
def test_variants(spark, group):
    r = random.Random(5)
    counts = {"".join(r.choices("abÿ", k=r.randint(1, 6))): r.choice((1, 2, 15, 15, 200, 3000)) for _ in range(400)}
    counts |= {"q" * 3000: 5, "q" * 2999: 70, "q" * 1500 + "w" + "q" * 1499: 5, "q" * 1499 + "w": 1}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants.variants(words, group=group).collect()}
    assert got == brute_variants(counts)
    assert any(v[4] != v[2] for v in got.values() if v[2])
    links = {(r.word, r.near) for r in spelling_variants.near_words(words, group).collect()}
    assert len(links) == sum(v[1] for v in got.values())


def test_variants_of_texts(spark, corpus, empty):
    r = random.Random(2)
    some = ["mañanas", "strasse×", "SENTENCE", "sentence", "sentences", "Sentance", "ÀÉÎÕÜß÷", "accommodate", "acommodate", "İstanbuls"]
    rows = [(i, " ".join(r.choices(some, k=50)) + "; under_score co-operate's") for i in range(60)] + [(None, "accommodate"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(corpus, allowMissingColumns=True)
    counts = Counter()
    for d in docs.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if d.doc_id is None else d.doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    words = spelling_variants.vocabulary(docs)
    assert {r.word: r.n for r in words.collect()} == counts and "acommodate" in counts
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling_variants.variants(words).collect()}
    assert got == brute_variants(counts)
    assert spelling_variants.variants(spelling_variants.vocabulary(empty)).count() == 0


def test_vocabulary_is_given_out_in_parts(spark, corpus, monkeypatch):
    want = sorted(map(tuple, spelling_variants.vocabulary(corpus, 0).collect()))
    assert sorted(map(tuple, spelling_variants.vocabulary(corpus.repartition(3), 0).collect())) == want


def brute_fingerprint(text):
    """Byte by byte, from the definition."""

    def mix(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 % 2**64
        h ^= h >> 27
        h = h * 0x94D049BB133111EB % 2**64
        return h ^ h >> 31

    rolls = [mix(sum((text[i - j] + 1) * pow(fingerprints._ROLL, j + 1, 2**64) for j in range(7) if i >= j) % 2**64) for i in range(len(text))]

    def chunks(level):
        ends = [i + 1 for i, h in enumerate(rolls) if h % 2**level == 0]
        return ends if len(ends) <= 64 else None

    def signature(level):
        ends = chunks(level)
        ends = ends if not text or (ends and ends[-1] == len(text)) else [*ends, len(text)]
        out = ""
        for s, e in zip([0, *ends], ends):
            h = mix((sum((b + 1) * pow(fingerprints._BASE, i, 2**64) for i, b in enumerate(text[s:e])) + e - s) % 2**64)
            out += chr(fingerprints.ALPHABET[h >> 58])
        return out

    level = next(i for i in range(65) if chunks(i) is not None)
    return f"{2**level}:{signature(level)}:{signature(level + 1)}"


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(diagonal if x == y else diagonal + 2, row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_fingerprint_kernels(monkeypatch):
    r = random.Random(4)
    texts = [b"", b"a", b"a" * 5000, b"ab" * 900, bytes(r.randrange(256) for _ in range(3000)), " ".join(r.choices(["naïve", "one", "two", "☃"], k=700)).encode(), bytes(r.choices(b"abc", k=64)), bytes(r.choices(b"abc", k=65))]
    for t in texts:
        assert fingerprints.fingerprint(t) == brute_fingerprint(t)
    want = list(map(fingerprints.fingerprint, texts))
    monkeypatch.setattr(fingerprints, "BLOCK", 100)
    assert list(map(fingerprints.fingerprint, texts)) == want
    for _ in range(300):
        a, b = ("".join(r.choices("abcd", k=r.randint(0, 30))) for _ in range(2))
        assert fingerprints._common(a, b) == (len(a) + len(b) - edit_distance(a, b)) / 2
        assert fingerprints.likeness(f"4:{a}:{b}", f"4:{a}:{b}") == 1 and 0 <= fingerprints.likeness(f"4:{a}:{b}", f"8:{b}:{a}") <= 1
    assert fingerprints.likeness("4:abcdefgh:abcd", "16:abcdefgh:abcd") == 0


@pytest.mark.parametrize("range_rows", [2, 7, 10_000])
def test_fingerprints_query(spark, corpus, empty, monkeypatch, range_rows):
    in_ranges = fingerprints.in_ranges
    monkeypatch.setattr(fingerprints, "in_ranges", lambda docs: in_ranges(docs, range_rows))
    rows = sorted(((r.doc_id, r.text or "") for r in corpus.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    want = Counter()
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        m = len(text) // 4
        changed = (text[: len(text) - m] + following[:m]).encode()
        fp, other, after = (fingerprints.fingerprint(t) for t in (text.encode(), changed, following.encode()))
        want[(doc_id, len(text), hashlib.sha256(changed).hexdigest(), fp, other, fingerprints.likeness(fp, other), fingerprints.likeness(fp, after))] += 1
    assert Counter(map(tuple, fingerprints.compare_with_edits(corpus).collect())) == want
    assert fingerprints.compare_with_edits(empty).count() == 0
    one = fingerprints.compare_with_edits(corpus.where("doc_id = 2")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_fingerprints_keep_columns(spark, corpus):
    docs = corpus.selectExpr("*", "'old' AS fingerprint", "'kept' AS fp_row")
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == docs.count() and {r.fp_row for r in got} == {"kept"} and "old" not in {r.fingerprint for r in got}


def test_near_copies_are_alike_and_others_are_not():
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(400)]
    texts = [" ".join(r.choices(vocab, k=r.randint(30, 900))) for _ in range(60)]
    marks = [fingerprints.fingerprint(t.encode()) for t in texts]
    for t, m in zip(texts, marks, strict=True):
        words = t.split(" ")
        words[len(words) // 3 : len(words) // 3 + 2] = ["put", "in", "here"]
        assert fingerprints.likeness(m, fingerprints.fingerprint(" ".join(words).encode())) > 0.75
    assert max(fingerprints.likeness(a, b) for i, a in enumerate(marks) for b in marks[:i]) < 0.5


def test_very_long_texts(spark):
    long = " ".join(f"word{i % 40_000} many{i % 997}" for i in range(400_000))
    docs = spark.createDataFrame([(0, long), (1, long + " more"), (2, "a b c"), (3, "é" * 3_000_000)], "doc_id bigint, text string")
    got = {r.doc_id: (len(r.runs), r.collapsed) for r in periodic_runs.find_runs(docs).collect()}
    assert got[2] == (0, "a b c") and got[3][1] == "é" * 3_000_000
    marks = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert fingerprints.likeness(marks[0], marks[1]) > 0.9
    assert spelling_variants.vocabulary(docs).count() == 0
