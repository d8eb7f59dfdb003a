"""Whole mechanisms against plain versions: overlapping chunks, page text, chunks with context, fetch rounds, trees, seeds, streams, identity."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kgloom.functions import text, urls
from kgloom.operators import applying, documents, fetching, identity, overlap, resolution, seeds, trees
from kgloom.plans import ontology
from kgloom.sources import paged, pieces
from kgloom.streaming import sources

ENTITY, FACT = "source_id bigint, ref string, n int, class_type string, chunk int", "source_id bigint, fact_ord int, ref string, predicate string, value string, locators array<string>"
RELATION, LINE = "source_id bigint, subject_ref string, predicate string, object_ref string", "source_id bigint, locator string"


def roots(spark, entities, facts, relations=(), lines=("a", "b", "c")):
    """Of one source. entities: (number, class, chunk); facts: (number, predicate, value, locators); relations: (number, number)."""
    e = spark.createDataFrame([(1, f"e{n}", n, c, chunk) for n, c, chunk in entities], ENTITY)
    f = spark.createDataFrame([(1, i, f"e{n}", p, v, list(locators)) for i, (n, p, v, locators) in enumerate(facts)], FACT)
    r = spark.createDataFrame([(1, f"e{a}", "atOrganization", f"e{b}") for a, b in relations], RELATION)
    got = overlap.overlap_roots(e, f, r, spark.createDataFrame([(1, x) for x in lines], LINE)).collect()
    return {int(x.ref[1:]): int(x.root[1:]) for x in got}


def test_overlap_joins_what_one_line_names(spark):
    two = [(1, "Work", 0), (2, "Work", 1)]
    same = [(1, "title", "Shop", "a"), (2, "title", "Shop", "a")]
    assert roots(spark, two, same) == {1: 1, 2: 1}
    assert roots(spark, two, [same[0], (2, "title", "Shop", "b")]) == {1: 1, 2: 2}  # another line
    assert roots(spark, two, [same[0], (2, "title", "Shop", "ax")]) == {1: 1, 2: 2}  # one of its lines isn't in the source
    assert roots(spark, two, [(1, "kind", "project", "a"), (2, "kind", "project", "a")]) == {1: 1, 2: 2}  # tells nothing
    assert roots(spark, [(1, "Work", 0), (2, "Work", 0)], same) == {1: 1, 2: 2}  # one chunk
    assert roots(spark, [*two, (3, "Work", 1)], [*same, (3, "title", "Shop", "a")]) == {1: 1, 2: 2, 3: 3}  # a chunk has two of them


def test_overlap_vetoes(spark):
    two, same = [(1, "Work", 0), (2, "Work", 1)], [(1, "title", "Shop", "a"), (2, "title", "Shop", "a")]
    assert roots(spark, two, [*same, (1, "kind", "project", "b"), (2, "kind", "publication", "b")]) == {1: 1, 2: 2}
    assert roots(spark, two, [*same, (1, "url", "u", "b"), (2, "url", "v", "b")]) == {1: 1, 2: 1}  # of several values
    four = [*two, (3, "Organization", 0), (4, "Organization", 1)]
    assert roots(spark, four, same, [(1, 3), (2, 4)]) == {1: 1, 2: 2, 3: 3, 4: 4}
    orgs = [(3, "name", "Lab", "b"), (4, "name", "Lab", "b")]
    assert roots(spark, four, same + orgs, [(1, 3), (2, 4)]) == {1: 1, 2: 1, 3: 3, 4: 3}  # organisations are joined first
    assert roots(spark, four, same, [(1, 3)]) == {1: 1, 2: 1, 3: 3, 4: 4}
    # 1 and 3 share a line, and 2 and 3 another; but 1 and 2 are of one chunk, so the second union is vetoed
    three = [(1, "Skill", 0), (2, "Skill", 0), (3, "Skill", 1)]
    assert roots(spark, three, [(1, "name", "x", "a"), (3, "name", "x", "a"), (2, "name", "y", "b"), (3, "name", "y", "b")]) == {1: 1, 2: 2, 3: 3}  # and names differ
    many = [(1, "Education", 0), (2, "Education", 0), (3, "Education", 1)]
    assert roots(spark, many, [(1, "major", "x", "a"), (3, "major", "x", "a"), (2, "major", "y", "b"), (3, "major", "y", "b")]) == {1: 1, 2: 2, 3: 1}
    assert roots(spark, [(1, "Work", 0), (1, "Work", 1)], [(1, "title", "Shop", "a")]) == {1: 1}


def brute_roots(entities, facts, relations, lines):
    """The rules one after the other, on plain rows of one source."""
    known = {e[1]: e for e in entities}
    if len(known) < len(entities):
        return {r: r for r in known}
    met = defaultdict(dict)
    for _, at, ref, predicate, value, locators in sorted(facts, key=lambda f: f[1]):
        if ref in known and predicate in overlap.ANCHORS.get(known[ref][3], ()) and set(locators) <= lines:
            for where in sorted(set(locators)):
                met[known[ref][3], predicate, value, where].setdefault(ref, at)
    component = {r: {r} for r in known}
    todo = sorted(((c != "Organization", min(refs.values()), where, c, list(refs)) for (c, _, _, where), refs in met.items()), key=lambda x: x[:3])
    label = {r: r for r in known}
    for _, _, _, c, refs in todo:
        chunks = [known[r][4] for r in refs]
        if len(set(chunks)) < len(chunks):
            continue
        refs = sorted(refs, key=lambda r: (known[r][4], known[r][2]))
        for other in refs[1:]:
            a, b = label[refs[0]], label[other]
            if a == b or {known[r][4] for r in component[a]} & {known[r][4] for r in component[b]}:
                continue
            held = [defaultdict(set), defaultdict(set)]
            for side, x in enumerate((a, b)):
                for _, _, ref, predicate, value, _ in facts:
                    if ref in component[x]:
                        held[side][predicate].add(value)
            if any((c, p) not in ontology.MULTI_VALUED and held[0][p] != held[1][p] for p in set(held[0]) & set(held[1])):
                continue
            at = [{label.get(o, o) for _, s, _, o in relations if s in component[x]} for x in (a, b)]
            if all(at) and at[0] != at[1]:
                continue
            component[a] |= component.pop(b)
            label |= {r: a for r in component[a]}
    return label


def test_overlap_against_plain_rules(spark):
    r = random.Random(11)
    es, fs, rs, ls, want = [], [], [], [], {}
    for source in range(150):
        entities = [(source, f"e{n}", n, r.choice(("Work", "Organization", "Education")), r.randrange(3)) for n in range(1, r.randint(3, 9))]
        facts = []
        for e in entities:
            for p in {"Work": ("title", "kind", "url"), "Organization": ("name",), "Education": ("major", "degree")}[e[3]]:
                if r.random() < 0.8:
                    facts.append((source, len(facts), e[1], p, r.choice("xy"), r.choices("abz", weights=(5, 3, 1), k=r.randint(1, 2))))
        orgs = [e[1] for e in entities if e[3] == "Organization"]
        relations = [(source, e[1], "atOrganization", r.choice(orgs)) for e in entities if e[3] != "Organization" and orgs and r.random() < 0.5]
        want |= {(source, k): v for k, v in brute_roots(entities, facts, relations, {"a", "b"}).items()}
        es, fs, rs, ls = es + entities, fs + facts, rs + relations, ls + [(source, "a"), (source, "b")]
    frames = [spark.createDataFrame(rows, kind) for rows, kind in ((es, ENTITY), (fs, FACT), (rs, RELATION), (ls, LINE))]
    got = {(x.source_id, x.ref): x.root for x in overlap.overlap_roots(*frames).collect()}
    assert got == want and sum(k[1] != v for k, v in want.items()) > 30
    merged = overlap.merge_overlaps(*frames)
    assert merged["entities"].count() == len(set(want.items())) - sum(k[1] != v for k, v in want.items())
    assert {(x.source_id, x.ref) for x in merged["facts"].collect()} <= {(k[0], v) for k, v in want.items()}


PAGE = "doc_id int, page int, ord int, text string, size double, x0 double, x1 double, top double, bottom double, height double, links array<string>"


def plain_page_text(lines):
    """The locator, path, level and text of one document's lines, in order."""
    pages = {x["page"] for x in lines}

    def margin(x):
        return "top" if x["top"] < 0.08 * x["height"] else "bottom" if x["bottom"] > 0.92 * x["height"] else None

    def key(x):
        t = x["text"]
        return margin(x), "page:0" if re.fullmatch(documents.BARE_PAGE_NUMBER.strip("^$"), t) else re.sub(documents.PAGE_NUMBER, lambda m: (m[1] or "") + "0", t)

    on = defaultdict(set)
    for x in lines:
        if margin(x):
            on[key(x)].add(x["page"])
    least = max(2, (len(pages) + 1) // 2)
    lines = [x for x in lines if not margin(x) or len(on[key(x)]) < least]
    weight = defaultdict(int)
    for x in lines:
        weight[x["size"]] += len(x["text"])
    body = max(weight, key=lambda s: weight[s])
    heads = sorted({s for s in weight if s >= body * 1.1 and all(len(x["text"]) <= 40 and not re.match(documents.BULLET, x["text"]) for x in lines if x["size"] == s)}, reverse=True)
    title = next((x for x in lines if heads and x["size"] == heads[0]), None) if heads and sum(x["size"] == heads[0] for x in lines) == 1 else None
    levels = {s: i + 1 for i, s in enumerate(heads[1:] if title else heads)}
    merged = []
    for x in lines:
        last = merged[-1] if merged else None
        if last and last["page"] == x["page"] and not {last["size"], x["size"]} & set(heads) and not re.match(documents.BULLET, x["text"]) and x["x0"] > last["x0"] + 3 and 0 <= x["top"] - last["bottom"] < 0.8 * x["size"]:
            last |= {"text": last["text"] + " " + x["text"], "bottom": x["bottom"], "links": last["links"] + [u for u in x["links"] if u not in last["links"]]}
        else:
            merged.append(dict(x))
    out, open_, count = [], [], defaultdict(int)
    for x in merged:
        shown = x["text"] + "".join(f" (링크: {u})" for u in x["links"])
        if title and x["ord"] == title["ord"]:
            out.append((x["ord"], "pdf.title", None, f"# {shown}"))
            continue
        count[x["page"]] += 1
        level = levels.get(x["size"])
        if level:
            open_ = [(k, t) for k, t in open_ if k < level] + [(level, x["text"])]
        path = " > ".join(t for _, t in open_)
        out.append((x["ord"], f"pdf.page:{x['page']}:{count[x['page']]}" + (f";section_path={path}" if path else ""), level, "#" * min(level + 1, 6) + f" {shown}" if level else f"[PDF section path: {path}] {shown}" if path else shown))
    return out


def test_page_text_against_plain_rules(spark):
    r = random.Random(3)
    docs, rows = {}, []
    for d in range(25):
        lines = []
        for p in range(1, r.randint(2, 5)):
            for i in range(r.randint(4, 14)):
                top = 10.0 + 14 * i + r.choice((0, 0, 0, 7))
                text = r.choice((f"Page {p}", str(p), f"{p} 쪽", "Running head")) if i in (0, 1) else r.choice(("- point", "plain words", "more and more of the words in a line", "Skills", "Work"))
                size = r.choice((10.0, 10.0, 10.0, 12.0, 14.0)) if len(text) < 20 else 10.0
                x0 = 40.0 + r.choice((0, 3, 5, 9))
                lines.append({"doc_id": d, "page": p, "ord": len(lines), "text": text, "size": size, "x0": x0, "x1": x0 + 90, "top": top, "bottom": top + 10, "height": 230.0, "links": r.choice(([], [], ["http://a"], ["http://a", "http://b"]))})
        lines.append({**lines[-1], "ord": len(lines), "text": "Name", "size": 20.0}) if d % 2 else None
        docs[d] = plain_page_text([dict(x) for x in lines])
        rows += [tuple(x.values()) for x in lines]
    got = defaultdict(list)
    for x in documents.page_text(spark.createDataFrame(rows, PAGE)).orderBy("doc_id", "ord").collect():
        got[x.doc_id].append((x.ord, x.locator, x.level, x.shown))
    assert got == docs


def test_links_meet_only_lines_of_their_stripe(spark):
    r = random.Random(4)
    lines = [(d, p, i, r.uniform(0, 50), r.uniform(50, 300), 14.0 * i, 14.0 * i + r.choice((10.0, 90.0))) for d in range(3) for p in range(2) for i in range(30)]
    links = [(d, p, i, r.uniform(0, 300), y, y + 8) for d in range(3) for p in range(2) for i in range(40) for y in [r.uniform(-10, 450)]]
    want = {}
    for d, p, k, x, top, bottom in links:
        y = (top + bottom) / 2
        near = [(abs((a + b) / 2 - y), i) for dd, pp, i, x0, x1, a, b in lines if (dd, pp) == (d, p) and x0 - 3 <= x <= x1 + 3 and a - 3 <= y <= b + 3]
        if near:
            want[d, p, k] = min(near)[1]
    a = spark.createDataFrame(links, "doc_id int, page int, link int, x0 double, top double, bottom double")
    b = spark.createDataFrame(lines, "doc_id int, page int, ord int, x0 double, x1 double, top double, bottom double")
    assert {(x.doc_id, x.page, x.link): x.ord for x in documents.nearest_line(a, b).collect()} == want


def test_one_chunk_has_no_context(spark):
    rows = [(1, i, i % 3 == 0, None, False) for i in range(30)] + [(2, i, i in (0, 25), 1 if i == 25 else None, i == 40) for i in range(60)]
    got = documents.file_chunks(spark.createDataFrame(rows, "doc_id int, ord int, starts boolean, heading_level int, is_title boolean"), "doc_id", "ord").collect()
    assert {x.role for x in got if x.doc_id == 1} == {"own"}
    context = {(x.chunk, x.ord) for x in got if x.doc_id == 2 and x.role == "context"}
    # the second chunk begins with a heading that starts an item; the third goes on inside that item
    assert {x.ord for x in got if x.doc_id == 2 and x.chunk == 0 and x.role == "own"} == set(range(25)) and not [c for c in context if c[0] == 1]
    assert {o for c, o in context if c == 2} == {25, 51, 52, 53, 54, 55} - {x.ord for x in got if x.doc_id == 2 and x.chunk == 2 and x.role == "own"}
    assert {(x.chunk, x.ord) for x in got if x.role == "title"} == {(c, 40) for c in {x.chunk for x in got if x.doc_id == 2}}


BLOCK = "page int, id string, kind string, children array<string>"


def test_fetch_rounds(spark):
    store = spark.createDataFrame([(1, "b", "text", ["d", "e"]), (1, "d", "page", ["x"]), (1, "e", "text", ["b", "f", "none"]), (1, "f", "text", []), (1, "x", "text", [])], BLOCK)
    held = spark.createDataFrame([(1, "r", "page", ["a", "b", "c"]), (1, "a", "text", ["b"])], BLOCK)
    roots_ = spark.createDataFrame([(1, "r")], "page int, id string")
    asked = []

    def answer(requests):
        asked.append(sorted((x.id, x.round, x.batch) for x in requests.collect()))
        return store.join(requests.select("page", "id"), ["page", "id"], "left_semi")

    blocks, requests = fetching.fetch_missing(held, roots_, answer, batch=1)
    assert asked == [[("b", 1, 0), ("c", 1, 1)], [("d", 2, 0), ("e", 2, 1)], [("f", 3, 0), ("none", 3, 1)]]  # a child page isn't entered
    assert {x.id for x in blocks.collect()} == {"r", "a", "b", "d", "e", "f"} and requests.count() == 6
    with pytest.raises(RuntimeError):
        fetching.fetch_missing(held, roots_, answer, rounds=1)
    none = fetching.fetch_missing(held.where("id = 'a'"), roots_, answer)
    assert none[1].count() == 0


def test_trees_refuse_what_is_none(spark):
    def tree(entities, facts, relations):
        e = spark.createDataFrame([(1, *x) for x in entities], "graph_id int, entity_id string, class_type string")
        f = spark.createDataFrame([(1, *x) for x in facts], "graph_id int, entity_id string, predicate string, value_str string")
        r = spark.createDataFrame([(1, *x) for x in relations], "graph_id int, subject_id string, predicate string, object_id string")
        return trees.canonical_trees(e, f, r).first().tree

    base = [("p", "Person"), ("w", "Work"), ("s", "Skill"), ("t", "Skill")]
    facts, edges = [("s", "name", "a"), ("t", "name", "b"), ("p", "name", "x")], [("p", "participatedIn", "w"), ("w", "usesSkill", "s"), ("w", "usesSkill", "t")]
    one = tree(base, facts, edges)
    other = {"p": "1", "w": "9", "s": "3", "t": "2"}
    assert one and one == tree([(other[i], c) for i, c in reversed(base)], [(other[i], p, v) for i, p, v in reversed(facts)], [(other[a], p, other[b]) for a, p, b in reversed(edges)])
    assert one != tree(base, [*facts[:2], ("p", "name", "y")], edges) and one != tree(base, facts, [edges[0], edges[1], ("p", "hasSkill", "t")])
    assert tree(base, facts, [*edges, ("p", "hasSkill", "s")]) is None  # shared
    assert tree(base, facts, edges[:2]) is None  # unconnected
    assert tree([*base, ("q", "Person")], facts, edges) is None and tree(base[1:], facts, edges[1:]) is None
    assert tree([*base, ("c", "Work"), ("d", "Work")], facts, [*edges, ("c", "partOf", "d"), ("d", "partOf", "c")]) is None  # a circle apart
    assert tree(base, facts, [*edges, ("w", "usesSkill", "gone")]) is None


def seed(spark, entities, facts, relations, **extra):
    e = spark.createDataFrame([(1, *x) for x in entities], "graph_id int, entity_id string, class_type string")
    f = spark.createDataFrame([(1, f"f{i}" if extra else f"g{i}", *x) for i, x in enumerate(facts)], "graph_id int, fact_id string, entity_id string, predicate string, value_str string")
    r = spark.createDataFrame([(1, f"r{i}" if extra else f"q{i}", *x) for i, x in enumerate(relations)], "graph_id int, relation_id string, subject_id string, predicate string, object_id string")
    out = {"entities": e, "facts": f, "relations": r}
    return {n: df.withColumns({k: F.lit(v) for k, v in extra.items() if n != "entities" or k != "locked"}) for n, df in out.items()}


def test_seed_updates_keep_what_stays(spark):
    old = seed(spark, [("p", "Person"), ("c", "Channel"), ("d", "Channel")], [("p", "name", "A"), ("c", "kind", "email"), ("c", "value", "a@b"), ("d", "kind", "phone")], [("p", "hasChannel", "c"), ("p", "hasChannel", "d")], updated=1, locked=True)
    graphs, none = spark.createDataFrame([(1, 4, 1)], "graph_id int, version int, updated int"), spark.createDataFrame([], "graph_id int, entity_id string")
    new = seed(spark, [("x", "Person"), ("y", "Channel")], [("x", "name", "B"), ("y", "kind", "email"), ("y", "value", "a@b")], [("x", "hasChannel", "y")])
    got = {n: df.collect() for n, df in seeds.update_seeds(graphs, old, new, none, 2).items()}
    assert [tuple(r) for r in got["graphs"]] == [(1, 5, 2)] and not got["refused"]
    assert {(r.entity_id, r.updated) for r in got["entities"]} == {("p", 2), ("c", 1)}
    assert {(r.fact_id, r.entity_id, r.value_str, r.locked, r.updated) for r in got["facts"]} == {("f0", "p", "B", True, 2), ("f1", "c", "email", True, 1), ("f2", "c", "a@b", True, 1)}
    assert [(r.relation_id, r.locked, r.updated) for r in got["relations"]] == [("r0", True, 1)]
    held = spark.createDataFrame([(1, "d")], "graph_id int, entity_id string")
    assert {r.entity_id for r in seeds.update_seeds(graphs, old, new, held, 2)["entities"].collect()} == {"p", "c", "d"}
    same = seed(spark, [("x", "Person"), ("y", "Channel"), ("z", "Channel")], [("x", "name", "A"), ("y", "kind", "email"), ("y", "value", "a@b"), ("z", "kind", "phone")], [("x", "hasChannel", "y"), ("x", "hasChannel", "z")])
    assert [tuple(r) for r in seeds.update_seeds(graphs, old, same, none, 2)["graphs"].collect()] == [(1, 4, 1)]
    twice = seed(spark, [("x", "Person"), ("y", "Channel"), ("z", "Channel")], [("y", "kind", "email"), ("z", "kind", "email")], [])
    kept = seeds.update_seeds(graphs, old, twice, none, 2)
    assert kept["refused"].count() == 1 and kept["facts"].count() == 4 and [tuple(r) for r in kept["graphs"].collect()] == [(1, 4, 1)]


VERSION = "graph_id bigint, source_key string, event_id bigint, fetched timestamp, content_hash string"


def versions(spark):
    rows = [(1, "a", 1, 0, "x"), (1, "b", 2, 1, "y"), (1, "a", 3, 2, "x"), (1, "a", 4, 3, None), (1, "b", 5, 4, "z"), (2, "a", 6, 5, None), (1, "b", 7, 6, "z"), (1, "a", 8, 7, "w"), (1, "a", 9, 8, "x")]
    return spark.createDataFrame(rows, "graph_id bigint, source_key string, event_id bigint, at int, content_hash string").selectExpr("graph_id", "source_key", "event_id", "timestamp_seconds(at) AS fetched", "content_hash")


def test_failed_batches_stay_pending_and_run_again(spark):
    calls = []

    def apply(fresh):
        calls.append(sorted((r.graph_id, r.source_key, r.content_hash) for r in fresh.collect()))
        if len(calls) in (2, 4):
            raise RuntimeError("injected")
        return fresh.select("graph_id", "source_key", "event_id", F.lit("row").alias("what"))

    out, took = sources.replay(versions(spark), apply, files=3)
    assert took == 3 and calls[1] == calls[2] and calls[3] == calls[4] and len(calls) == 5
    assert {(r.graph_id, r.source_key, r.content_hash) for r in out.collect()} == {(1, "a", "x"), (1, "b", "z")} and out.count() == 2
    applied = [x for i, c in enumerate(calls) if i not in (1, 3) for x in c]
    assert applied.count((1, "b", "z")) == 1  # the same version later is nothing new


def test_last_failure_is_raised(spark):
    def apply(fresh):
        raise RuntimeError("always")

    with pytest.raises(Exception, match="always"):
        sources.replay(versions(spark), apply, files=1, attempts=2)


def test_changes_are_counted_across_batches(spark):
    want = {(1, "a", "x", 3), (1, "b", "z", 2), (2, "a", None, 0)}
    for files in (1, 4):
        assert {tuple(r) for r in sources.replay_changes(versions(spark), files).collect()} == want


@pytest.mark.parametrize(("url", "label"), [
    ("https://www.github.com/a", "GitHub"), ("https://gist.github.com/a", "Link"), ("https://docs.google.com/presentation/d/1", "PPT"), ("https://docs.google.com/document/d/1", "Link"), ("http://x.example/Talk.PPTX", "PPT"), ("https://speakerdeck.com/x", "PPT"),
    ("https://dl.acm.org/doi/1", "Paper"), ("https://www.riss.kr/x", "Paper"), ("https://m.youtube.com/x", "Video"), ("https://me.notion.site/x", "Notion"), ("https://me.github.io/x", "Demo"), ("https://huggingface.co/spaces/a/b", "Demo"), ("https://huggingface.co/a/b", "Link"),
    ("https://evilarxiv.org/x", "Link"), ("mailto:a@b", None), ("ftp://arxiv.org/x", None), (None, None),
])
def test_link_labels(spark, url, label):
    assert spark.createDataFrame([(url,)], "u string").select(urls.label(F.col("u")).alias("l")).first().l == label


def test_title_pairs_against_every_pair(spark):
    words = ["red", "blue", "shop", "2", "3", "쇼핑", "redshop", "shops", "app"]
    r = random.Random(6)
    titles = [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(70)] + ["Red Shop", "RED  shop", "", "!!"]
    items = spark.createDataFrame([(1, f"i{n:02}", t) for n, t in enumerate(titles)], "g int, id string, title string")
    got = resolution.similar_title_pairs(items, ["g"], "id", "title").collect()
    head = {x.b: x.a for x in got if x.equal}
    near = {frozenset((x.a, x.b)) for x in got if not x.equal}
    fold = lambda c: text.nfkc_fold(F.col(c))
    pairs = items.select(F.col("id").alias("a"), F.col("title").alias("ta")).join(items.select(F.col("id").alias("b"), F.col("title").alias("tb")), F.col("a") < F.col("b"))
    for x in pairs.select("a", "b", text.similar_title(fold("ta"), fold("tb")).alias("alike")).collect():
        a, b = head.get(x.a, x.a), head.get(x.b, x.b)
        assert x.alike == ((a == b) or frozenset((a, b)) in near), x
    assert len(near) > 20 and len(head) > 3


def test_whole_sources_are_applied_or_left(spark):
    frame = spark.createDataFrame
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {1: "Shop\nGo", 2: "Shop two", 3: "gone", 4: "old"}
    docs = frame([(7, f"s{i}", i, h(t) if i == 4 else None, ontology.VERSION if i == 4 else None, t) for i, t in texts.items()], "graph_id bigint, source_key string, source_id bigint, processed_hash string, processed_ontology string, text string")
    snaps = frame([(7, f"s{i}", h(t) if i != 3 else None, "success" if i != 3 else "error") for i, t in texts.items()], "graph_id bigint, source_key string, content_hash string, fetch_status string")
    lines = frame([(i, "l0", t.split("\n")[0]) for i, t in texts.items()] + [(1, "l1", "Go"), (2, "l1", "not in the text")], "source_id bigint, locator string, snippet string")
    entities = frame([(1, "e1", "Work", 10), (1, "e2", "Skill", 11), (2, "e1", "Work", 20), (3, "e1", "Work", 30)], "source_id bigint, ref string, class_type string, ord bigint")
    fact = lambda s, ref, n, c, p, v, claim: (s, ref, n, c, p, v, 0.9, claim)
    facts = frame(
        [fact(1, "e1", 1, "Work", "title", "Shop", "a"), fact(1, "e1", 2, "Work", "kind", "project", "a"), fact(1, "e1", 3, "Work", "kind", "publication", "b"), fact(1, "e2", 4, "Skill", "name", "Go", "b"), fact(2, "e1", 5, "Work", "title", "shop", "a"), fact(2, "e1", 6, "Work", "role", "lead", "b"), fact(3, "e1", 7, "Work", "title", "x", "a")],
        "source_id bigint, ref string, ord bigint, class_type string, predicate string, value_str string, confidence double, claim string",
    )
    relations = frame([(1, 1, "e1", "usesSkill", "e2", 0.9, "b")], "source_id bigint, ord bigint, subject_ref string, predicate string, object_ref string, confidence double, claim string")
    claims = frame([(i, c, "l0" if c == "a" else "l1") for i in texts for c in "ab"], "source_id bigint, claim string, locator string")
    graph = frame([(7, "P", "Person", "active")], "graph_id bigint, entity_id string, class_type string, status string")
    held = frame([], "graph_id bigint, fact_id string, entity_id string, predicate string, value_str string, status string, provenance string, blocks boolean")
    edges = frame([], "graph_id bigint, subject_id string, predicate string, object_id string, status string, blocks boolean")
    keys = frame([], "graph_id bigint, entity_id string, key_type string, key_value string, is_strong boolean")
    stored = {"pool": identity.resolution_pool(graph, held, edges, keys), "facts": held, "relations": edges, "stale_facts": held.select("graph_id", "entity_id", "predicate"), "stale_relations": edges.select("graph_id", "subject_id", "predicate")}
    out = applying.apply_whole(frame([(7, 3)], "graph_id bigint, version bigint"), docs, snaps, {"entities": entities, "facts": facts, "relations": relations, "claims": claims}, lines, stored)
    # both sources name one work; a conflict stays undecided, and what no line says is left out
    assert {(r.entity_id, r.predicate, r.value_str, r.decision) for r in out["facts"].collect()} == {
        ("1:e1", "title", "Shop", "active"), ("1:e1", "title", "shop", "active"), ("1:e1", "kind", "project", "candidate"), ("1:e1", "kind", "publication", "candidate"), ("1:e2", "name", "Go", "active"),
    }
    assert {tuple(r) for r in out["relations"].collect()} == {(7, "P", "participatedIn", "1:e1", "active"), (7, "1:e1", "usesSkill", "1:e2", "active")}
    assert {(r.source_key, r.processed_hash) for r in out["documents"].collect()} == {("s1", h(texts[1])), ("s2", h(texts[2])), ("s3", None), ("s4", h(texts[4]))}
    assert [tuple(r) for r in out["graphs"].collect()] == [(7, 5)]
    assert sorted(tuple(r) for r in out["issues"].collect()) == [(1, "CONFLICTING_VALUES"), (2, "UNSUPPORTED_EVIDENCE"), (3, "NOT_STORED"), (4, "ALREADY_PROCESSED")]


def test_paged_source(spark, tmp_path):
    items = spark.createDataFrame([(o, n, f'{{"n":{n}}}') for o in ("a", "b") for n in range(5)], "owner string, ord int, item string")
    folder = f"file://{tmp_path}/pages"
    paged.save(items, folder, 2)
    df = paged.read(spark, folder)
    assert sorted((r.owner, r.page, r.position, r.item) for r in df.collect()) == [(o, n // 2, n % 2, f'{{"n": {n}}}') for o in ("a", "b") for n in range(5)]
    one = df.where("owner = 'b'")
    assert one.count() == 5 and one.rdd.getNumPartitions() == 1
    (tmp_path / "pages" / "owner=a" / "page=1").rename(tmp_path / "pages" / "owner=a" / "page=9")
    with pytest.raises(Exception, match="page=1"):
        df.collect()


def test_pieces_of_files(spark):
    runs = "array<struct<text:string,url:string>>"
    rows = [([("See ", None), ("the  site", "https://a.example"), ("\tend", None)],), ([("https://a.example/x", "https://a.example")],), ([(" ", "http://b")],), ([("mail", "mailto:a@b")],), ([],)]
    got = [r.t for r in spark.createDataFrame(rows, f"r {runs}").select(pieces.run_text(F.col("r")).alias("t")).collect()]
    assert got == ["See the site (https://a.example) end", "https://a.example/x", "http://b", "mail", ""]
    cells = spark.createDataFrame([(1, 0, 0, "c1", "same"), (1, 0, 1, "c1", "same"), (1, 0, 2, "c2", "same"), (1, 0, 3, "c3", ""), (1, 1, 0, "c4", "")], "t int, row int, position int, cell string, text string")
    assert [tuple(r) for r in pieces.table_lines(cells, ["t"]).collect()] == [(1, 0, "same | same")]
    none = (None, None, None, None)
    styles = spark.createDataFrame([(1, "a", "b", 1.0, None, None, None), (1, "b", "c", 9.0, 2.0, None, None), (1, "c", "a", None, None, 3.0, None), (1, "d", None, *none), (1, "e", "gone", None, 5.0, None, True)], "f int, style string, based_on string, left_indent double, space_before double, space_after double, keep_with_next boolean")
    paragraphs = spark.createDataFrame([(1, 0, "a", *none), (1, 1, "a", 7.0, None, None, False), (1, 2, "d", *none), (1, 3, None, *none), (1, 4, "e", *none)], "f int, o int, style string, left_indent double, space_before double, space_after double, keep_with_next boolean")
    got = {r.o: (r.left_indent, r.space_before, r.space_after, r.keep_with_next) for r in pieces.inherited_settings(paragraphs, styles, ["f"]).collect()}
    assert got == {0: (1.0, 2.0, 3.0, None), 1: (7.0, 2.0, 3.0, False), 2: none, 3: none, 4: (None, 5.0, None, True)}
    with pytest.raises(RuntimeError):
        pieces.inherited_settings(paragraphs, styles, ["f"], most=1)


def test_long_chain_of_styles(spark):
    """A chain of 200 styles that ends in a circle: longer than the 64 steps that once were the most."""
    row = lambda i, above, left=None, before=None: ("f", i, above, left, before, None, None)
    styles = spark.createDataFrame([row(i, i - 1) for i in range(2, 201)] + [row(1, 2, left=4.0), row(0, 1, before=1.0)], "f string, style int, based_on int, left_indent double, space_before double, space_after double, keep_with_next boolean")
    paragraphs = spark.createDataFrame([("f", o, o, None, None, None, None) for o in (200, 3, 0)], "f string, o int, style int, left_indent double, space_before double, space_after double, keep_with_next boolean")
    got = {r.o: (r.left_indent, r.space_before, r.space_after, r.keep_with_next) for r in pieces.inherited_settings(paragraphs, styles, ["f"]).collect()}
    assert got == {200: (4.0, None, None, None), 3: (4.0, None, None, None), 0: (4.0, 1.0, None, None)}
