"""URL predicates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def is_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^\s/?#]+[^\s]*$"), F.lit(False))


def is_repository(url: Column) -> Column:
    """https, the hosting site, exactly owner and name, nothing more."""
    return F.coalesce(url.rlike(r"^https://(?:www\.)?github\.com/[^/?#\s]+/[^/?#\s]+/?$"), F.lit(False))


def route(url: Column) -> Column:
    """Which collector takes a source."""
    h = F.coalesce(host(url), F.lit(""))
    notion = F.endswith(h, F.lit("notion.site")) | h.isin("notion.so", "www.notion.so", "app.notion.com")
    return F.when(~is_http_url(url), "invalid").when(h.isin("github.com", "www.github.com"), "github").when(notion, "notion").otherwise("unsupported")


def _under(h: Column, *domains: str) -> Column:
    hit = F.lit(False)
    for d in domains:
        hit = hit | (h == d) | F.endswith(h, F.lit("." + d))
    return hit


#: Hosts of slides, papers, videos, notes and demonstrations.
SLIDES = ("slideshare.net", "speakerdeck.com", "canva.com", "miricanvas.com", "figma.com")
PAPERS = ("arxiv.org", "doi.org", "dl.acm.org", "ieeexplore.ieee.org", "openreview.net", "aclanthology.org", "semanticscholar.org", "dbpia.co.kr", "riss.kr", "kci.go.kr")
VIDEOS = ("youtube.com", "youtu.be", "vimeo.com")
NOTES = ("notion.so", "notion.site")
DEMOS = ("vercel.app", "netlify.app", "github.io", "pages.dev", "streamlit.app", "herokuapp.com")


def label(url: Column) -> Column:
    """What a link shows; the first rule that fits. Only http and https links have a label; papers, videos, notes and demonstrations also under subdomains."""
    h, p = F.regexp_replace(F.coalesce(host(url), F.lit("")), r"^www\.", ""), F.lower(path(url))
    slides = p.rlike(r"\.pptx?$") | h.isin(*SLIDES) | ((h == "docs.google.com") & F.startswith(p, F.lit("/presentation/")))
    demo = _under(h, *DEMOS) | ((h == "huggingface.co") & F.startswith(p, F.lit("/spaces/")))
    return (
        F.when(~is_http_url(url), None).when(h == "github.com", "GitHub").when(slides, "PPT").when(_under(h, *PAPERS), "Paper").when(_under(h, *VIDEOS), "Video")
        .when(_under(h, *NOTES), "Notion").when(demo, "Demo").otherwise("Link")
    )


#: Fixed value: what a page's id looks like at the end of a path.
PAGE_ID = r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"


def public_page(url: Column) -> Column:
    """struct<page_id, source_url> of a public page's address over https: its id in lower case without hyphens, and the address without query, fragment and last slash; null elsewhere."""
    h = host(url)
    p = F.regexp_replace(path(url), "/+$", "")
    found = F.regexp_extract(p, PAGE_ID, 0)
    known = h.isin("notion.so", "www.notion.so", "notion.site", "www.notion.site") | F.endswith(h, F.lit(".notion.site"))
    ok = F.coalesce(F.lower(url).startswith("https://") & known & (found != ""), F.lit(False))
    return F.when(ok, F.struct(page_id(found).alias("page_id"), F.concat(F.lit("https://"), h, p).alias("source_url")))


def page_id(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("-")))


def attachment_ok(url: Column, mime: Column) -> Column:
    """The suffix says what the type says, and the host is a storage host over https."""
    suffix = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.when(suffix == "pdf", "application/pdf").when(suffix == "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    return F.coalesce(F.startswith(url, F.lit("https://")) & host(url).rlike(r"(^|\.)s3[.-][a-z0-9.-]*amazonaws\.com$") & (kinds == mime), F.lit(False))
