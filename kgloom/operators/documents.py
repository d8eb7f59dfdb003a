"""Documents as ordered lines: section paths, margins, item runs and chunks."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kgloom.operators.folds import fold_by

LEVELS = 9
CHUNK, OVERLAP = 30, 5


def section_path(df: DataFrame, keys: list[str], order: str, level: str, text: str) -> DataFrame:
    """Adds section_path: the open headings above each line, joined by ` > `. level is null on ordinary lines.

    A heading closes those of its own or a deeper level; so level k is open
    where its last heading is later than any of a smaller level.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(text).alias("t"))), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)]
    df = df.withColumn("_open", F.array(*at))
    parts = []
    for k in range(LEVELS):
        own = F.col("_open")[k]
        closed = F.exists(F.slice("_open", 1, k), lambda x: F.coalesce(x["o"] > own["o"], F.lit(False))) if k else F.lit(False)
        parts.append(F.when(own.isNotNull() & ~closed, own["t"]))
    return df.withColumn("section_path", F.concat_ws(" > ", *parts)).drop("_open")


def repeated_margins(lines: DataFrame, doc: str = "doc_id", page: str = "page", key: str = "key") -> DataFrame:
    """(doc, key) of margin lines on at least half of a document's pages, and on two."""
    pages = lines.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    on = lines.groupBy(doc, key).agg(F.countDistinct(page).alias("n"))
    return on.join(pages, doc).where(F.col("n") >= F.greatest(F.lit(2), F.floor((F.col("pages") + 1) / 2))).select(doc, key, "n")


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The value with most weight by key; the smallest of equals."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*keys).agg(F.max_by(value, F.struct("w", -F.col(value))).alias(value), F.max("w").alias("weight"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds run: numbers stretches of consecutive rows with one value."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def chunks(df: DataFrame, source: str, order: str, section: str, most: int = CHUNK) -> DataFrame:
    """Adds chunk: whole runs of one section are packed greedily into chunks of at most `most` rows; a longer run is split."""
    numbered = runs(df, [source], order, section)

    def fold(rows: list[dict]) -> list[tuple]:
        out, chunk, used = [], 0, 0
        for _, run in groupby(rows, key=lambda r: r["run"]):
            own = list(run)
            if used and used + len(own) > most:
                chunk, used = chunk + 1, 0
            for row in own:
                if used == most:
                    chunk, used = chunk + 1, 0
                out.append((*row.values(), chunk))
                used += 1
        return out

    return fold_by(numbered, source, [order], fold, T.StructType([*numbered.schema.fields, T.StructField("chunk", T.IntegerType())]))


def overlap(chunked: DataFrame, source: str, order: str, n: int = OVERLAP) -> DataFrame:
    """(source, chunk, order) with each chunk's own rows and the n before its first."""
    first = chunked.groupBy(source, "chunk").agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    return chunked.drop("chunk").join(first, source).where((F.col(order) >= F.col("lo") - n) & (F.col(order) <= F.col("hi"))).select(source, "chunk", order)


#: Bullets, page numbers in a running head, and a line that is only a page number.
BULLET = r"^[•·▪◦‣∙●○■□\-–*]\s*"
PAGE_NUMBER = r"(?i)(\bpage\s*)\d+|\d+(?=\s*(?:쪽|페이지))"
BARE_PAGE_NUMBER = r"^\s*\d{1,2}(?:\s*/\s*\d{1,2})?\s*$"
#: How much larger than the body a heading is and how long it may be; the part of a page that is margin; where a wrapped line goes on.
HEADING_RATIO, HEADING_CHARS, MARGIN = 1.1, 40, 0.08
INDENT, WRAP_GAP, LINK_SLACK = 3.0, 0.8, 3.0


def is_bullet(text: Column) -> Column:
    return text.rlike(BULLET)


def merge_wrapped(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Joins wrapped lines of a page (keys): the next line is no heading or bullet, starts further right than the merged one, and close below it.

    lines: keys, order, text, size, x0, top, bottom, is_heading, links (array). A merged line has the first one's place, the last one's bottom and all links once.
    """
    bullet = re.compile(BULLET)

    def known(value) -> float:
        return float("nan") if value is None else value

    def fold(rows: list[dict]) -> list[tuple]:
        out: list[dict] = []
        for row in rows:
            last = out[-1] if out else None
            apart = last is None or last["is_heading"] or row["is_heading"] or row["text"] is None or bullet.match(row["text"]) or known(row["x0"]) <= known(last["x0"]) + INDENT
            if apart or not 0 <= known(row["top"]) - known(last["bottom"]) < WRAP_GAP * known(row["size"]):
                out.append(row)
            else:
                last.update(text=f"{last['text']} {row['text']}", bottom=row["bottom"], links=list(dict.fromkeys(last["links"] + row["links"])))
        return [tuple(r.values()) for r in out]

    return fold_by(lines, keys, [order], fold, lines.schema)


#: Height of the stripes of a page in which links meet lines.
STRIPE = 24.0


def nearest_line(links: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, page, link, ord): for each link the line that it starts in, of those that hold its middle the one whose own middle is nearest, the first of equals.

    links: doc_id, page, link, x0, top, bottom; lines: doc_id, page, ord, x0, x1, top, bottom. A line is in every stripe of the page that it reaches, a link
    in that of its middle, so they meet on equal stripes, not page by page.
    """
    def stripe(y: Column) -> Column:
        return F.floor(y / STRIPE)

    reach = lines.select("doc_id", "page", "ord", "x0", "x1", "top", "bottom", F.explode(F.sequence(stripe(F.col("top") - LINK_SLACK), stripe(F.col("bottom") + LINK_SLACK))).alias("stripe"))
    middle = links.select("doc_id", "page", "link", F.col("x0").alias("_x"), ((F.col("top") + F.col("bottom")) / 2).alias("_y")).withColumn("stripe", stripe(F.col("_y")))
    holds = F.col("_x").between(F.col("x0") - LINK_SLACK, F.col("x1") + LINK_SLACK) & F.col("_y").between(F.col("top") - LINK_SLACK, F.col("bottom") + LINK_SLACK)
    away = F.abs((F.col("top") + F.col("bottom")) / 2 - F.col("_y"))
    return middle.join(reach, ["doc_id", "page", "stripe"]).where(holds).groupBy("doc_id", "page", "link").agg(F.min_by("ord", F.struct(away, "ord")).alias("ord"))


def without_margins(lines: DataFrame) -> DataFrame:
    """lines without those at the top or bottom of a page that half of the document's pages, and two of them, have there. Page numbers are told alike.

    lines: doc_id, page, text, top, bottom, height (of the page) and others.
    """
    edge = MARGIN * F.col("height")
    margin = F.when(F.col("top") < edge, "top").when(F.col("bottom") > F.col("height") - edge, "bottom")
    key = F.when(F.col("text").rlike(BARE_PAGE_NUMBER), "page:0").otherwise(F.regexp_replace("text", PAGE_NUMBER, "$10"))
    df = lines.withColumn("_margin", margin).withColumn("_key", F.when(F.col("_margin").isNotNull(), F.concat_ws(":", "_margin", key)))
    bad = repeated_margins(df.select("doc_id", "page", "_key"), "doc_id", "page", "_key").where("_key IS NOT NULL").select("doc_id", "_key")
    return df.join(bad, ["doc_id", "_key"], "left_anti").drop("_margin", "_key")


def with_headings(lines: DataFrame) -> DataFrame:
    """Adds level (of a heading, from 1; null on other lines), is_heading and is_title.

    The body's size is the one with most characters (the first of equals); heading sizes are a tenth larger or more, with short lines only and no bullets.
    If only one line has the largest of them, it is the title and no level.
    """
    sizes = lines.groupBy("doc_id", "size").agg(
        F.sum(F.length("text")).alias("w"), F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"), F.bool_and((F.length("text") <= HEADING_CHARS) & ~is_bullet(F.col("text"))).alias("short")
    )
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("first"))).alias("body"))
    heads = sizes.join(body, "doc_id").where(F.col("short") & (F.col("size") >= F.col("body") * HEADING_RATIO))
    w = Window.partitionBy("doc_id").orderBy(F.desc("size"))
    rank, titled = F.row_number().over(w), F.first("n").over(w) == 1
    ranked = heads.select("doc_id", "size", "n", rank.alias("rank"), titled.alias("titled"))
    level = F.col("rank") - F.col("titled").cast("int")
    ranked = ranked.select("doc_id", "size", F.lit(True).alias("is_heading"), (level == 0).alias("is_title"), F.when(level > 0, F.least(level, F.lit(LEVELS))).alias("level"))
    out = lines.join(ranked, ["doc_id", "size"], "left")
    return out.withColumns({"is_heading": F.coalesce("is_heading", F.lit(False)), "is_title": F.coalesce("is_title", F.lit(False))})


def page_text(lines: DataFrame) -> DataFrame:
    """A document's lines as they are cited: doc_id, ord, page, locator, section_path, level, snippet, shown, gap_before, indent, size, is_list, is_title.

    lines: doc_id, page, ord, text, size, x0, x1, top, bottom, height, links (array). In one plan: running heads go, headings and the title are found by size,
    wrapped lines are joined, and every line is under the headings open above it. shown is the line of the whole text.
    """
    marked = with_headings(without_margins(lines))
    merged = merge_wrapped(marked, ["doc_id", "page"], "ord")
    outline = section_path(merged.where("NOT is_title"), ["doc_id"], "ord", "level", "text").unionByName(merged.where("is_title").withColumn("section_path", F.lit("")))
    w = Window.partitionBy("doc_id", "page").orderBy("ord")
    number = F.sum((~F.col("is_title")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the title is left out before gaps are taken
    gap = F.col("top") - F.last(F.when(~F.col("is_title"), F.col("bottom")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    linked = F.concat(F.col("text"), F.array_join(F.transform("links", lambda u: F.concat(F.lit(" (링크: "), u, F.lit(")"))), ""))
    path = F.col("section_path")
    df = outline.withColumns({"_n": number, "gap_before": gap, "snippet": linked})
    locator = F.when(F.col("is_title"), "pdf.title").otherwise(F.concat(F.lit("pdf.page:"), "page", F.lit(":"), "_n", F.when(path != "", F.concat(F.lit(";section_path="), path)).otherwise("")))
    shown = (
        F.when(F.col("is_title"), F.concat(F.lit("# "), "snippet")).when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6))), F.lit(" "), "snippet"))
        .when(path != "", F.concat(F.lit("[PDF section path: "), path, F.lit("] "), "snippet")).otherwise(F.col("snippet"))
    )
    return df.select("doc_id", "ord", "page", locator.alias("locator"), "section_path", "level", "snippet", shown.alias("shown"), F.when(~F.col("is_title"), F.col("gap_before")).alias("gap_before"), F.col("x0").alias("indent"), "size", is_bullet(F.col("text")).alias("is_list"), "is_title")


def file_chunks(lines: DataFrame, source: str, order: str, most: int = CHUNK, before: int = OVERLAP) -> DataFrame:
    """(source, chunk, order, role): the lines of each chunk of a file, its own, those it needs as context, and the titles.

    lines: source, order, starts (an item begins there), heading_level, is_title. Items stay whole in chunks of up to `most` lines; a longer item is cut. Context
    of a chunk are the headings open at its first line, the start of the item that it goes on, and the `before` lines of the
    chunk before, unless it begins with a heading that starts an item. A file of one chunk has no context.
    """
    w = Window.partitionBy(source).orderBy(order)
    body = lines.where("NOT is_title")
    body = body.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_new", F.when(F.col("_pos") == 0, True).otherwise(F.coalesce("starts", F.lit(False))))
    body = body.withColumn("_item", F.sum(F.col("_new").cast("int")).over(w)).withColumn("_start", F.last(F.when(F.col("_new"), F.struct(F.col("_pos").alias("p"), F.col(order).alias("o"))), ignorenulls=True).over(w))
    body = body.withColumn("_part", F.floor((F.col("_pos") - F.col("_start.p")) / most))
    parts = body.groupBy(source, "_item", "_part").agg(F.count(F.lit(1)).alias("_n"))

    # a row for each file, with the parts of its items, not its lines
    listed = parts.groupBy(source).agg(F.sort_array(F.collect_list(F.struct("_item", "_part", "_n"))).alias("parts"))

    def pack(batches):
        for pdf in batches:
            out = []
            for of, own in zip(pdf[source], pdf["parts"], strict=True):
                chunk, used = 0, 0
                for p in own:
                    if used and used + p["_n"] > most:
                        chunk, used = chunk + 1, 0
                    used += p["_n"]
                    out.append((of, p["_item"], p["_part"], chunk))
            yield pd.DataFrame(out, columns=[source, "_item", "_part", "chunk"])

    kind = T.StructType([*parts.drop("_n").schema.fields, T.StructField("chunk", T.IntegerType())])
    packed = listed.mapInPandas(pack, kind)
    body = body.join(packed, [source, "_item", "_part"])
    open_ = [F.last(F.when(F.col("heading_level") == k, F.col(order)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in range(1, LEVELS + 1)]
    body = body.withColumn("_open", F.array(*open_))

    def alive(k: int) -> Column:
        own = F.col("_open")[k]
        closed = F.exists(F.slice("_open", 1, k), lambda x: F.coalesce(x > own, F.lit(False))) if k else F.lit(False)
        return F.when(own.isNotNull() & ~closed, own)

    body = body.withColumn("_parents", F.filter(F.array(*[alive(k) for k in range(LEVELS)]), lambda x: x.isNotNull()))
    first = body.groupBy(source, "chunk").agg(F.min_by(F.struct("_pos", order, "_start", "_parents", "heading_level"), "_pos").alias("f"), F.max("_pos").alias("_last"))
    clear = (F.col("f._pos") == F.col("f._start.p")) & F.col("f.heading_level").isNotNull()
    back = F.when((F.col("chunk") > 0) & ~clear, F.lit(before)).otherwise(0)
    size = F.col("_last") - F.lag("_last", 1, -1).over(Window.partitionBy(source).orderBy("chunk"))
    first = first.withColumn("_size", size).withColumn("_reach", F.least(back, F.coalesce(F.lag("_size").over(Window.partitionBy(source).orderBy("chunk")), F.lit(0))))
    far = F.array_append(F.col("f._parents"), F.col("f._start.o"))
    named = first.select(source, "chunk", F.explode(F.filter(far, lambda o: o < F.col(f"f.{order}"))).alias(order))
    # the lines just before a chunk, by their positions: an equi-join on each of them
    near = first.where("_reach > 0").select(source, "chunk", F.explode(F.sequence(F.col("f._pos") - F.col("_reach"), F.col("f._pos") - 1)).alias("_pos")).join(body.select(source, "_pos", order), [source, "_pos"]).select(source, "chunk", order)
    own = body.select(source, "chunk", order, F.lit("own").alias("role"))
    context = named.union(near).distinct().withColumn("role", F.lit("context"))
    titles = first.select(source, "chunk").join(lines.where("is_title").select(source, order), source).withColumn("role", F.lit("title"))
    return own.unionByName(context).unionByName(titles)


def readable_ratio(text: Column) -> Column:
    seen = F.length(F.regexp_replace(text, r"\s+", ""))
    return F.when(seen > 0, F.regexp_count(text, F.lit(r"[\p{L}\p{N}]")) / seen).otherwise(0.0)


def quality_gate(text: Column) -> Column:
    return F.when(F.length(F.regexp_replace(text, r"\s+", "")) < 20, "no_text").when(readable_ratio(text) < 0.6, "unreadable")


def dense_refs(df: DataFrame, keys: list[str], value: list[str], order: str) -> DataFrame:
    """Distinct values by key with references e1, e2, ... in the order in which they first occur."""
    first = df.groupBy(*keys, *value).agg(F.min(order).alias("first"))
    return first.withColumn("ref", F.concat(F.lit("e"), F.row_number().over(Window.partitionBy(*keys).orderBy("first", *value))))


def ref_offsets(sizes: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Adds offset: the sum of the sizes before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def line_gaps(lines: DataFrame, keys: list[str], page: str, order: str) -> DataFrame:
    """Adds gap: the space between a line's top and the bottom of the one before on its page."""
    return lines.withColumn("gap", F.col("top") - F.lag("bottom").over(Window.partitionBy(*keys, page).orderBy(order)))


#: Least space before an item where lines have no pages.
ITEM_GAP = 12.0
#: How much further left, and how far below, a line begins an item on a page.
OUTDENT = 6.0


def item_starts(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds starts: whether a line begins an item, from its layout and that of the line before.

    lines: heading_level, table, is_list, blank_before, keep_with_next and gap_before; where they also have page, indent and size, a page's end is
    no boundary, large letters need a larger gap, and a line further left a smaller one.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    paged = {"page", "indent", "size"} <= set(lines.columns)
    before = F.lag(F.struct("heading_level", "table", "keep_with_next", *(["page", "indent"] if paged else []))).over(w)
    df = lines.withColumn("_before", before)
    b = F.col("_before")
    wide = F.coalesce(F.col("gap_before") >= ITEM_GAP, F.lit(False))
    if paged:
        gap = F.col("gap_before")
        enough = (gap >= F.greatest(F.lit(ITEM_GAP), 1.2 * F.coalesce("size", F.lit(10.0)))) | ((b["indent"] - F.col("indent") >= OUTDENT) & (gap >= OUTDENT))
        wide = F.when(F.col("page").isNull(), wide).otherwise(F.coalesce((b["page"] == F.col("page")) & enough, F.lit(False)))
    starts = (
        F.when(F.coalesce(b["keep_with_next"], F.lit(False)), False)
        .when(F.col("heading_level").isNotNull(), ~F.coalesce(b["heading_level"] < F.col("heading_level"), F.lit(False)))
        .when(b["heading_level"].isNotNull(), False)
        .when(F.col("table").isNotNull(), ~F.coalesce(b["table"] == F.col("table"), F.lit(False)))
        .when(b["table"].isNotNull(), True).when(F.col("is_list"), False).when(F.col("blank_before"), True).otherwise(wide)
    )
    return df.withColumn("starts", starts).drop("_before")


def top_section(locator: Column) -> Column:
    """The first part of a locator's section path."""
    path = F.regexp_extract(locator, r";section_path=(.*)$", 1)
    return F.nullif(F.get(F.split(path, " > "), F.lit(0)), F.lit(""))


def extraction_index(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, held): map of predicate to values in their order. rows: keys, predicate, value_str, ord."""
    per = rows.groupBy(*keys, "predicate").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value_str"))), lambda x: x["value_str"]).alias("v"))
    return per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("predicate", "v"))).alias("held"))
