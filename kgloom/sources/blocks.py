"""Block pages, tables, payload fields and binary documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_MEMBERS, MOST_UNZIPPED, MOST_ATTACHMENT = 1000, 50 * 1024 * 1024, 10 * 1024 * 1024
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def row_text(cells: Column, order: Column) -> Column:
    """Cells of a map in column order joined by ` | `; blank ones stay, an all-blank row is null."""
    values = F.transform(order, lambda c: F.coalesce(F.trim(F.element_at(cells, c)), F.lit("")))
    return F.when(F.exists(values, lambda v: v != ""), F.array_join(values, " | "))


def rich_text(fragments: Column) -> Column:
    """array<struct<text,url>>: texts in a row, each linked one followed by its address."""
    return F.array_join(F.transform(fragments, lambda f: F.concat(f["text"], F.when(f["url"].isNotNull(), F.concat(F.lit(" ("), f["url"], F.lit(")"))).otherwise(""))), "")


def line_of(kind: Column, text: Column) -> Column:
    """A block as a line of markdown."""
    return (
        F.when(text == "", None).when(kind == "header", F.concat(F.lit("# "), text)).when(kind == "sub_header", F.concat(F.lit("## "), text)).when(kind == "sub_sub_header", F.concat(F.lit("### "), text))
        .when(kind.isin("bulleted_list", "toggle"), F.concat(F.lit("- "), text)).when(kind == "numbered_list", F.concat(F.lit("1. "), text)).when(kind == "quote", F.concat(F.lit("> "), text)).otherwise(text)
    )


def typed_fields(payload: Column) -> Column:
    """Checks a repository payload: a positive id, a name, text or nothing, topics that are non-blank."""
    p = F.from_json(payload, "id bigint, name string, description string, topics array<string>, private boolean")
    issue = F.when(p.isNull() | ~(p["id"] > 0) | p["id"].isNull(), "bad_id").when(F.coalesce(F.trim(p["name"]), F.lit("")) == "", "bad_name").when(F.coalesce(p["private"], F.lit(False)), "private").when(F.exists(p["topics"], lambda t: F.trim(t) == ""), "bad_topics")
    return F.struct(p["id"].alias("id"), p["name"].alias("name"), p["description"].alias("description"), p["topics"].alias("topics"), issue.alias("issue"))


def tree_kind(mode: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for x in ("blob", "file", "tree", "folder", "commit", "submodule")])
    return F.element_at(kinds, mode)


def docx_lines(files: DataFrame) -> DataFrame:
    """path, ord, kind, text, issue of paragraphs and table rows. files: path, content, as the binaryFile source gives them.

    An archive with too many members or too large when unzipped is one row with an issue, and is not unzipped.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        if len(z.infolist()) > MOST_MEMBERS or sum(i.file_size for i in z.infolist()) > MOST_UNZIPPED:
                            out.append((path, 0, None, None, "too_large"))
                            continue
                        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    out.append((path, 0, None, None, "unreadable"))
                    continue
                for n, block in enumerate(body if body is not None else []):
                    if block.tag == f"{W}p":
                        style = block.find(f"{W}pPr/{W}pStyle")
                        name = style.get(f"{W}val", "") if style is not None else ""
                        kind = "heading" if name.startswith("Heading") else "list" if block.find(f"{W}pPr/{W}numPr") is not None else "paragraph"
                        text = "".join(t.text or "" for t in block.iter(f"{W}t"))
                        if text.strip():
                            out.append((path, n * 1000, kind, text, None))
                    elif block.tag == f"{W}tbl":
                        for m, row in enumerate(block.iter(f"{W}tr")):
                            cells = ["".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in row.findall(f"{W}tc")]
                            if any(cells):
                                out.append((path, n * 1000 + m, "row", " | ".join(cells), None))
            yield pd.DataFrame(out, columns=["path", "ord", "kind", "text", "issue"])

    return files.select("path", "content").mapInPandas(read, "path string, ord bigint, kind string, text string, issue string")


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Binary documents of a folder that are small enough; larger ones are never read."""
    return spark.read.format("binaryFile").load(folder).where(F.col("length") <= MOST_ATTACHMENT)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Saved API answers, one JSON file or array each, as (file, ord, payload); stands in for a collector that calls the API.

    Read through Spark's own readers, so that the path can be in any store that they know.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    parts = F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return files.select("file", F.posexplode(parts).alias("ord", "payload"))
