"""Each operator against a brute-force version, with nulls, empties, ties, repeated rows and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import chat, context_tree, embedding_dedup, license_scan, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules
from kgloom.llm.common import components


def words(t):
    return (t or "").encode().lower().split()


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (50, 50), (None, 3), (42, 40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 41: 40, 42: 40}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_license_scan(spark, corpus, empty):
    wrapped = "Some Tool\n\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation\n# files (the Software), to deal"
    extra = spark.createDataFrame([(900, wrapped, "Kelvin \u212a"), (901, "under a long text " + "x " * 60 + "released the mit " + "y " * 9 + "license", ""), (902, "Licensed under CC BY-NC 4.0.", "")], "doc_id bigint, text string, lang string")
    docs = corpus.unionByName(extra, allowMissingColumns=True).withColumns({"body": F.col("text"), "license": F.lit("clash"), "ls_row": F.lit("kept")})
    got = license_scan.scan(docs).collect()
    assert len(got) == docs.count() and license_scan.scan(empty).count() == 0
    labels = defaultdict(set)
    for r in got:
        w = re.findall(license_scan.WORD, "".join(c.lower() if c.isascii() else c for c in r.body or ""))
        places = sorted((label, i) for label, p in license_scan.PHRASES for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        assert sorted((p.label, p.start) for p in r.license.places) == places and r.license.n_words == len(w) and r.ls_row == "kept"
        blocks = set()
        for label, t in license_scan.TEMPLATES:
            own = set(t.split())
            n = -(-5 * len(t.split()) // 4)
            blocks |= {(i, label) for i in range(len(w)) if w[i] in own and 10 * len(own & set(w[i : i + n])) >= 9 * len(own)}
        assert {(b.start, b.label) for b in r.license.blocks} == blocks
        labels[r.doc_id] |= {b.label for b in r.license.blocks}
    assert (labels[900], labels[901], labels[902]) == ({"mit"}, set(), {"cc-by-nc"})


def test_quality_classifier(spark, corpus, empty):
    rows = [(i, f"good plain words number {i % 7} here" if i % 2 else f"bad!! *** junk!! {i % 7}") for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, None), (1000, ""), (1000, "")], "doc_id bigint, text string").withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None), (7, 9)], "doc_id bigint, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.classify(docs, model).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.quality_score >= 0.5) == bool(r.doc_id % 2) for r in held]) > 0.97
    assert len(got) == 403 and all(0 <= r.quality_score <= 1 for r in got)
    assert quality_classifier.classify(empty, model).count() == 0
    again = docs.select("doc_id", "text").union(docs.where("doc_id < 50").select("doc_id", F.concat("text", F.lit(" z")))).union(docs.where("doc_id < 50").select("doc_id", "text"))
    assert np.array_equal(quality_classifier.train(again, labels).weights, model.weights)
    none = quality_classifier.train(empty, labels.where("false"))
    assert {r.quality_score for r in quality_classifier.classify(docs, none).collect()} == {0.5}


def plain_grams(text):
    """Log counts of word 1- and 2-grams as a unit vector; each ASCII mark is a word."""
    own = re.findall(r"[!-/:-@\[-`{-~]|[^\x20\x09-\x0d!-/:-@\[-`{-~]+", text or "")
    count = Counter([(w,) for w in own] + list(zip(own, own[1:])))
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values()))
    return {g: math.log1p(n) / norm for g, n in count.items()}


def test_quality_classifier_against_plain_updates(spark):
    rng = np.random.default_rng(8)
    vocab = ["good", "plain", "words", "junk", "***", "buy!!", "now", "été", "x,y", "read"]
    rows = [(i, " ".join(rng.choice(vocab[i % 2 * 3 :], size=rng.integers(0, 12)))) for i in range(150)] + [(150, None), (151, ""), (None, "good")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 152)], "doc_id bigint, quality int")
    order = [r.doc_id for r in docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    texts = dict(rows)
    alpha, beta, l1, l2 = (getattr(quality_classifier, n) for n in ("ALPHA", "BETA", "L1", "L2"))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def chance(x):
        return 1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items())))

    for _ in range(quality_classifier.EPOCHS):
        for doc_id in order:
            x = plain_grams(texts[doc_id]) | {"bias": 1.0}
            p, held = chance(x), {k: weight(k) for k in x}
            for k, v in x.items():
                g = (p - doc_id % 2) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * held[k]
                n[k] += g * g
    got = quality_classifier.classify(docs, quality_classifier.train(docs, labels)).collect()
    assert len(got) == len(rows) and max(abs(r.quality_score - chance(plain_grams(r.text) | {"bias": 1.0})) for r in got) < 1e-4


def test_mixing(spark, corpus, empty):
    got = mixing.with_copies(corpus).collect()
    assert len(got) == corpus.count() and mixing.with_copies(empty).count() == 0
    size = defaultdict(int)
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        size[r.source] += r.mix_size
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:  # reshares by weight until no target is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    for r in got:
        assert math.isclose(r.mix_target, target[r.source]) and r.mix_copies <= 2
    assert mixing.mix(corpus).count() == sum(r.mix_copies for r in got)
    assert mixing.mix(corpus).columns == corpus.columns


@pytest.mark.parametrize("sources", [1, 4])
def test_mixing_comes_near_its_targets(spark, sources):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % sources).cast("string").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"))
    per = mixing.with_copies(docs).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in per)


CLASHES = ("row", "mix_size", "source_size", "rate", "salt", "quality", "quality_signals", "votes", "lm", "lm_of", "lm_row", "key", "n", "ed_row", "weight", "unit", "kept", "component_id", "filters", "license", "ls_row", "hits")


def test_clashing_names_pass_through_or_are_replaced(spark, corpus):
    docs = corpus.where("doc_id < 12 OR doc_id IS NULL").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    for out, own in ((mixing.with_copies(docs), {"mix_size"}), (mixing.mix(docs), set()), (quality_rules.judge(docs), {"quality"}), (context_tree.score(docs, context_tree.train(docs)), {"lm"}), (license_scan.scan(docs), {"license"})):
        rows = out.collect()
        assert rows and all(set(map(str, (r[c] for c in CLASHES if c not in own))) == {"x"} for r in rows)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>").select("*", *[F.lit("x").alias(c) for c in CLASHES])
    got = {r.vec_id: (r.component_id, r.kept, r.weight, r.ed_row) for r in embedding_dedup.near_duplicates(vectors).collect()}
    assert got == {1: (1, True, "x", "x"), 2: (1, False, "x", "x"), 3: (3, True, "x", "x")}


def test_long_turns_take_little_memory():
    import tracemalloc

    text = 'plain words of a turn \\ with <marks> and "quotes"\n' * 1_000_000  # 50 MB
    assert len(text) > 48_000_000
    whole = chat.render("assistant", text)[0]
    tracemalloc.start()
    (got,) = chat.parse(whole)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == ("assistant", text) and peak < 500_000_000


def test_parse_refuses_what_was_not_rendered():
    good = chat.render("user", "a")[0]
    for bad in (good[:-1], good + "x", "x" + good, good.replace("a\n", "\\x\n"), good.replace('">', '"'), good.replace("user", "us<er"), good.replace("</turn>", "</turns>")):
        with pytest.raises(ValueError):
            chat.parse(bad)
    assert chat.parse("") == [] and chat.parse(good + good) == [("user", "a")] * 2


def test_very_long_texts(spark):
    """One text of some MB between short ones, for every operator on texts."""
    long = "\n".join(f"word{i} of{i % 97} many{i % 1009} lines here {i}" for i in range(60_000))
    docs = spark.createDataFrame([(0, long, "s"), (1, long + " more", "s"), (2, "a b c", "s")], "doc_id bigint, text string, source string")
    near = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, 3, 90, 100).collect()}
    assert near == {0: 0, 1: 0, 2: 2}
    pieces = packing.pack(docs).collect()
    assert sum(len(p.ids) // 4 for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert line_dedup.dedup(docs).where("doc_id = 1 AND text = ''").count() == 1
    model = context_tree.train(docs)
    assert context_tree.score(docs, model).where("doc_id = 0").first().lm.n_tokens == 6 * 60_000 + 1
    assert {r.doc_id: r.mix_size for r in mixing.with_copies(docs).collect()}[0] == 6 * 60_000
    assert license_scan.scan(docs).where("doc_id = 0").first().license.n_words == 6 * 60_000
    assert quality_rules.judge(docs).where("doc_id = 0").first().quality.n_words == 6 * 60_000


def test_chat(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "Good "), (1, 1, 7, "delta", None, "day"),
        (1, 0, 3, "edit", None, "hi <there>"), (2, 0, 0, "message", None, None), (2, 1, 1, "message", "assistant", chat.TRAP), (2, 1, 1, "message", "assistant", chat.TRAP), (None, None, None, None, "user", "x\\l\"y"),
    ]
    events = spark.createDataFrame(rows, "conv_id bigint, message bigint, seq bigint, kind string, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(events)
    by = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.conv_id or -1, r.message or 0, r.part)):
        by[r.conv_id] += chat.parse(r.formatted)
        assert chat.unescape(r.formatted[r.loss_start : r.loss_end]) == (chat.parse(r.formatted)[0][1] if chat.parse(r.formatted)[0][0] == "assistant" else "")
    assert by == {1: [("user", "hi <there>"), ("assistant", "Good day")], 2: [("", ""), ("assistant", chat.TRAP), ("assistant", chat.TRAP)], None: [("user", "x\\l\"y")]}
    digests = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert digests[2].loss_sha256 == hashlib.sha256((chat.TRAP * 2).encode()).hexdigest() and digests[2].n_turns == 3
    assert chat.read_back(chat.format_chats(events.where("false"))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("plain")


def test_chat_escape_round_trip():
    from hypothesis import given
    from hypothesis import strategies as st

    @given(st.lists(st.tuples(st.text(), st.text())))
    def check(turns):
        assert chat.parse("".join(chat.render(r, t)[0] for r, t in turns)) == turns

    check()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 32))
    near = base[:60] + 0.05 * rng.standard_normal((60, 32))
    hot = base[0] + 0.02 * rng.standard_normal((80, 32))
    vectors = np.concatenate([base, near, hot, base[5:6], base[5:6]])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [float("nan")] * 32), (9005, [1.0, None]), (9006, [1e300, 1e300]), (9007, [3e300, 3e300])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links_note", F.lit(0))
    old, embedding_dedup.BLOCK_ROWS = embedding_dedup.BLOCK_ROWS, 16  # so that large directions are split
    try:
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    finally:
        embedding_dedup.BLOCK_ROWS = old
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    found = sum(got[i].n_links for i in range(len(u)))
    assert all(got[i].n_links <= links[i].sum() for i in range(len(u))) and found >= 0.97 * links.sum()
    assert got[400].component_id == 0 and not got[400].kept and got[0].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9006))
    assert got[9006].n_links == 1 and got[9007].component_id == 9006
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [5_000, 100_000, 1_000_000, 10_000_000])
def test_embedding_directions_meet_whatever_the_number_of_vectors(n):
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, 200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(len(a), bool)
    for k in range(embedding_dedup.CODES):
        code = embedding_dedup.Code(64, n, k)
        own, other = code.decode(a), code.decode(b)
        assert min(map(len, own)) > 0
        met |= [len(np.intersect1d(x, y)) > 0 for x, y in zip(own, other, strict=True)]
    assert met.mean() >= 0.9


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, corpus, empty, width, num):
    rows = corpus.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    sets = {}
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups(ids, linked)
    got = ngram_join.near_duplicates(corpus, width, num, 100).collect()
    assert len(got) == corpus.count() and len(linked) > 5
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    assert [r.component_id for r in got if r.doc_id is None] == [want[5]]
    clash = corpus.select("*", *[F.lit("x").alias(c) for c in ("component_id", "n_shingles", "nd_row", "nd_fp", "sig", "node")])
    if width == 3:
        again = ngram_join.near_duplicates(clash, width, num, 100)
        assert sorted((str(r.doc_id), r.component_id, r.n_shingles, r.node) for r in again.collect()) == sorted((str(r.doc_id), r.component_id, r.n_shingles, "x") for r in got)
    assert ngram_join.near_duplicates(empty, width, num, 100).count() == 0


@pytest.mark.parametrize(("num", "counts"), [(90, None), (90, 10**9), (80, None), (80, 10**13), (50, 10**12)])
def test_ngram_signatures_meet(num, counts):
    """Any two sets that are similar enough share an index entry, in every band and near its edges; entries stay fewer than members from 0.8 on."""
    rng = np.random.default_rng(1)
    cut = ngram_join.bands(num, 100, counts and {k: counts for k in range(80)})
    highs = np.array([b.high for b in cut])

    def entries(s):
        own = int(np.searchsorted(highs, len(s)))
        found = [ngram_join.signatures(s, own, cut, num, 100)]
        if own and -(-num * len(s) // 100) <= cut[own - 1].high:
            found.append(ngram_join.signatures(s, own - 1, cut, num, 100))
        return np.unique(np.concatenate(found))

    tried = 0
    for _ in range(1500):
        n = int(rng.integers(9, 600) if rng.random() < 0.5 else rng.integers(2, 40))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        most = int(n * (100 - num) / num)
        drop, add = (int(rng.integers(0, most + 1)) for _ in range(2))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, add).astype(np.uint64) * np.uint64(2)]))
        both = len(np.intersect1d(a, b))
        if not both or 100 * both < num * (len(a) + len(b) - both):
            continue
        tried += 1
        x, y = entries(a), entries(b)
        assert len(np.intersect1d(x, y)) or len(a) == len(b) == both
        if num >= 80 and counts is None and len(a) > 100:
            assert len(x) < 0.75 * len(a)
    assert tried > 300


def test_ngram_bitmaps_bound_the_difference(spark):
    """No pair that is similar enough is lost; different large sets are told apart."""
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in (30, 900, 1020, 1100, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for drop, add in ((0, 0), (n // 20, 0), (0, n // 20), (n // 12, n // 12), (n // 9, n // 9), (n, n)):
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            want.append((100 * both >= 80 * (len(a) + len(b) - both), drop == n))
            rows.append((len(rows), len(a), len(b), ngram_join.parity(a).tolist(), ngram_join.parity(b).tolist()))
    got = spark.createDataFrame(rows, "i int, a_size bigint, b_size bigint, a_bits array<bigint>, b_bits array<bigint>").select("i", ngram_join._may_be_similar(80, 100).alias("ok")).collect()
    ok = {r.i: r.ok for r in got}
    assert all(ok[i] for i, (similar, _) in enumerate(want) if similar) and not any(ok[i] for i, (_, other) in enumerate(want) if other)


def test_quality_rules(spark, corpus, empty):
    got = quality_rules.judge(corpus).collect()
    assert len(got) == corpus.count() and quality_rules.judge(empty).count() == 0
    for r in got:
        t, q = r.text or "", r.quality
        w = words(r.text) if r.text and r.text.isascii() else t.replace(" ", "_").split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (q.n_words, q.n_repeat_words, q.n_dup_lines) == (len(w), len(inside), len(lines) - len(set(lines)))
        own = re.findall("[^\x20\x09-\x0d]+", t)
        assert q.n_symbols == sum(c in "#*$%&|<>" for c in t) and q.word_chars == sum(map(len, own)) and q.n_short == sum(len(x) <= 3 for x in own)
        assert q.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and (not q.kept or not q.base_failed)


def test_quality_rules_have_no_vote_twice(spark, corpus):
    """No two rules vote alike by their arithmetic: each pair of rules disagrees on some text."""
    texts = ["a b c " * 20, "### " * 30, "word " * 9 + "#$% " * 9, "Hello! " * 40, "HELLO WORLD " * 30, "abcdefghijklmnopqrst " * 30, "of an in at by longer " * 20, "\n".join(["same line of text here"] * 9), " ".join(f"word{i} of | it" for i in range(30)), "one two", ""]
    docs = corpus.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    votes = [tuple(r.quality.votes) for r in quality_rules.judge(docs).collect()]
    columns = list(zip(*votes, strict=True))
    assert len(set(columns)) == len(quality_rules.RULES)


def test_quality_rules_learn_which_rule_is_poor(spark):
    """Planted kinds of bad documents that two rules see each, and a rule that votes against one document in ten at random."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(4000):
        kind = rng.choice([0, 1, 2], p=[0.85, 0.08, 0.07])
        v = [-1 if rng.random() < (0.95 if kind == k else 0.005) else 1 for k in (1, 1, 2, 2)]
        rows.append((v + [-1 if rng.random() < 0.1 else 1],))
    prior, good, bad = quality_rules.fit(spark.createDataFrame(rows, "v array<int>"), rules=range(5))

    def posterior(*v):
        odds = math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if x == 1 else math.log((1 - g) / b) for x, g, b in zip(v, good, bad, strict=True))
        return 1 / (1 + math.exp(-odds))

    assert abs(good[4] - 0.9) < 0.03 and min(good[:4]) > 0.97 and abs(prior - 0.85) < 0.06
    assert posterior(1, 1, 1, 1, -1) > 0.9 and max(posterior(-1, -1, 1, 1, 1), posterior(1, 1, -1, -1, 1)) < 0.1


def test_context_tree_is_a_distribution_and_learns(spark, corpus, empty):
    keys = context_tree.gram_keys(np.frombuffer(b"abracadabra abracadabra", np.uint8), np.array([0, 12, 23]))
    k, n = np.unique(keys, return_counts=True)
    table = context_tree.fit_tree(k, n).reshape(-1, 256)
    assert np.allclose((10.0 ** table.astype(float)).sum(1), 1, atol=1e-4)
    assert 10.0 ** table.ravel()[keys].mean() > 3 / 256


def test_context_tree_against_plain_recursion():
    """The mixture along a path equals the ratio of weighted probabilities of the tree with and without one more symbol."""
    data = b"the cat the dog the cat"
    keys = context_tree.gram_keys(np.frombuffer(data, np.uint8), np.array([0, len(data)]))

    def weighted(symbols):
        node = defaultdict(lambda: [0, 0])
        for ctx, byte in symbols:
            for d in range(context_tree.DEPTH + 1):
                own = ctx & ((1 << (5 * d)) - 1)
                for bit in range(8):
                    node[d, own, (1 << bit) | (byte >> (8 - bit))][(byte >> (7 - bit)) & 1] += 1

        def kt(a, b):
            return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

        kids = defaultdict(set)
        for d, own, x in node:
            if d:
                kids[d - 1, own & ((1 << (5 * (d - 1))) - 1), x].add((d, own, x))

        def log_w(key):
            own = kt(*node[key])
            if key[0] == context_tree.DEPTH:
                return own
            below = sum(log_w(c) for c in kids[key])
            return np.logaddexp(own, below) - math.log(2)

        return sum(log_w(key) for key in list(node) if key[0] == 0)

    train = [(int(k) >> 8, int(k) & 255) for k in keys]
    k, n = np.unique(keys, return_counts=True)
    table = context_tree.fit_tree(k, n)
    for ctx, byte in train[:6] + [(train[3][0], ord("z"))]:
        want = (weighted(train + [(ctx, byte)]) - weighted(train)) / math.log(10)
        # unseen contexts at depth have no node yet; their estimate of one half is what the tree adds
        assert abs(table[(ctx << 8) | byte] - want) < 1e-3


def test_lm_scoring(spark, corpus, empty):
    rows = corpus.collect()
    model = context_tree.train(corpus.where("doc_id % 2 = 0"))
    counted = Counter(w for r in rows if r.doc_id is not None and r.doc_id % 2 == 0 for w in [*words(r.text), None])
    total, distinct = sum(counted.values()), len(counted)
    old, model.hot = model.hot, tuple(x[:20] for x in model.hot)  # so that most words go through the join
    got = context_tree.score(corpus, model).collect()
    model.hot = old
    assert len(got) == len(rows) and model.total == total and model.distinct == distinct
    key = lambda r: (r.doc_id is None, r.doc_id, r.source or "")
    for r, g in zip(sorted(rows, key=key), sorted(got, key=key), strict=True):
        own = [*words(r.text), None]
        base = sum(math.log10((counted[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (g.lm.n_tokens, g.lm.n_known) == (len(own), sum(counted[w] > 0 for w in own)) and math.isclose(g.lm.base_score, base, rel_tol=1e-9)
        data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode())
        of_byte = model.tree[context_tree.gram_keys(np.frombuffer(data, np.uint8), np.array([0, len(data)]))].astype(float) if data else np.zeros(0)
        want = of_byte.sum()
        for m in re.finditer(rb"[^\x20\x09-\x0D]+", data):
            tree, seen = of_byte[m.start() : m.end()].sum(), counted[m[0]] / (total + 0.5 * (distinct + 1))
            want += (math.log10(0.5 * 10**tree + 0.5 * seen) if seen or tree > -300 else tree + math.log10(0.5)) - tree
        assert math.isclose(g.lm.score, want, rel_tol=1e-6, abs_tol=1e-6)
    assert context_tree.score(empty, model).count() == 0
    blank = context_tree.train(empty)
    assert all(r.lm.n_known == 0 and r.lm.train_tokens == 0 for r in context_tree.score(corpus, blank).collect())


def test_line_dedup(spark, corpus, empty):
    rows = sorted({(r.doc_id, r.text) for r in corpus.collect() if r.text is not None}, key=lambda x: (x[0] is not None, x[0]))
    lines = [((i, k), line, set(line.lower().split())) for i, (_, t) in enumerate(rows) for k, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = {a for a, _, sa in lines for b, _, sb in lines if b < a and 10 * len(sa & sb) >= 8 * len(sa | sb)}
    got = {(r.doc_id, r.text_key, r.line) for r in line_dedup.removals(corpus).collect()}
    keys = {(r.doc_id, r.text): r.k for r in corpus.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    assert got == {(rows[i][0], keys[rows[i]], k) for i, k in gone} and len(gone) > 10
    out = line_dedup.dedup(corpus)
    assert out.columns == corpus.columns and out.count() == corpus.count() and line_dedup.dedup(empty).count() == 0
    index = {r: i for i, r in enumerate(rows)}
    want = Counter((r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (index[r.doc_id, r.text], k) not in gone)) for r in corpus.collect())
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    clash = corpus.select("*", *[F.lit("x").alias(c) for c in ("removed", "r_row", "sid", "tokens", "line", "text_key", "done")])
    got = line_dedup.dedup(clash)
    assert got.columns == clash.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want and {(r.removed, r.r_row) for r in got.collect()} == {("x", "x")}


def test_packing(spark, corpus, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = corpus.collect()
    pieces = packing.pack(corpus, length=64).collect()
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 0]
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append(p)
    for own in by.values():
        own.sort(key=lambda p: p.offset)
        ends = np.cumsum([len(p.ids) // 4 for p in own])
        assert [p.offset for p in own] == [0, *ends[:-1]] and ends[-1] <= 64 and ends[-1] & (ends[-1] - 1) == 0
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += len(ids(r.text))
    got = Counter()
    for p in pieces:
        got[p.doc_id] += len(p.ids) // 4
    assert whole == got
    texts = {r.doc_id: ids(r.text) for r in rows}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == texts[p.doc_id][p.start : p.start + len(p.ids) // 4] and p.doc_tokens == len(texts[p.doc_id])
    assert packing.pack(empty).count() == 0


def test_packing_asks_with_all_terms():
    """The best neighbour shares only words that are more frequent than many of the seed's own."""
    own, shared, common = np.arange(40), np.arange(100, 110), np.arange(200, 205)
    sets = [np.concatenate([own, shared, common]), np.concatenate([own + 1000, common]), np.concatenate([own + 2000, shared, common]), own + 3000, own + 4000]
    terms = [(s, np.ones(len(s), np.int64), len(s)) for s in sets]
    df = np.zeros(1 << packing.TERM_BITS)
    for s in sets:
        df[s] += 1
    stats = packing.Statistics(df, len(sets), sum(w for _, _, w in terms))
    shard = packing.Shard(terms, stats, list(range(len(sets))))
    assert shard.seed(set()) == 0 and list(shard.neighbours(0, {0})) == [2, 1]


def test_packing_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(2)
    texts = [rng.zipf(1.4, int(rng.integers(1, 60))) % 400 for _ in range(700)]
    texts[10] = texts[20] = texts[30]
    terms = [(*np.unique(t, return_counts=True), len(t)) for t in texts]
    df = np.zeros(1 << packing.TERM_BITS)
    for s, _, _ in terms:
        df[s] += 1
    mean = np.mean([len(t) for t in texts])
    names = [hash(t.tobytes()) for t in texts]
    shard = packing.Shard(terms, packing.Statistics(df, len(texts), sum(map(len, texts))), names)
    tf = [dict(zip(s.tolist(), c.tolist(), strict=True)) for s, c, _ in terms]

    def bm25(q, d):
        return sum(
            math.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * tf[d][t] * (packing.K1 + 1) / (tf[d][t] + packing.K1 * (1 - packing.B + packing.B * len(texts[d]) / mean))
            for t in tf[q] if t in tf[d]
        )

    for q in (0, 30, 300, 699):
        want = np.array([bm25(q, d) for d in range(len(texts))])
        got = shard.scores(q)
        assert np.allclose(np.where(want > 0, got, 0), want, rtol=1e-4, atol=1e-4)
    used = {shard.take(30)}
    given = list(shard.neighbours(30, {names[30]}))
    assert not {10, 20, 30} & set(given) and len(set(given)) == len(given)
    want = np.array([bm25(30, d) for d in given])
    assert (np.diff(want) < 1e-3).all() and used == {30}


def test_packing_meets_wherever_documents_are_stored(spark):
    """Two halves of a corpus, stored apart, hold the same rare terms; each text's partner ends up in its partition, and many copies are spread."""
    rows = [(100 * h + i, f"rare{i} seldom{i} " + "filler " * 20 + f"more{h} words{i}") for h in (0, 1) for i in range(60)] + [(1000 + i, "the same text again and again " * 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2, "doc_id")
    pieces = packing.pack(docs, length=128).collect()
    where = {p.doc_id: p.sequence_id >> 40 for p in pieces}
    assert sum(where[i] == where[100 + i] for i in range(60)) > 50
    assert len({where[1000 + i] for i in range(60)}) > 1

def test_packing_encoder_matches_the_tokenizer():
    import public_tokenizers as P
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.public_encoder()

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("ab1 .,'!\n\t é☃sI"))) | st.text())
    def check(t):
        assert encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids

    check()
