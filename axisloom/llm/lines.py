"""Line dedup: lines that a large part of their site's pages have are dropped.

DataFrame expressions only.  A page's text is its html with tags cut into lines; each
distinct line of a page counts once.  Pages per (host, line) are divided by the pages
of the host; lines beyond a ratio are boilerplate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: a line on at least this share of a host's pages is boilerplate
MAX_RATIO = 0.1
#: ... if at least so many pages have it
MIN_PAGES = 3

# Markup whose content is no text, and tags that end a line.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
_BREAK = r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|body|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
_TAG = r"<[^>]*>"
_BLANKS = r"[ \t\r\f\x0B]+"


def host(url):
    """Lower-case host of a URL without user and port; '' when there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


def page_lines(html):
    """Lines of visible text, trimmed, empty ones left out, in order."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, _BREAK, "\n"), _TAG, "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, _BLANKS, " ")))
    return F.filter(lines, lambda x: x != "")


def boilerplate_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, key, pages``: keys (digests) of lines that too many pages of their host have."""
    lined = pages.select(host(F.col("url")).alias("host"), F.array_distinct(page_lines(F.col("html"))).alias("lines"))
    totals = lined.groupBy("host").agg(F.count("*").alias("of"))
    keys = lined.select("host", F.explode(F.transform("lines", lambda x: F.md5(x.cast("binary")))).alias("key"))
    # most lines stand on one page: they never meet the totals
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    return counts.join(totals, "host").filter(F.col("pages") >= F.col("of") * max_ratio).select("host", "key", "pages")


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, host, n_lines, n_dropped, text`` per row of pages (page_id, url, html).

    ``text`` has the kept lines in order, joined by line feeds.  A line that a page
    repeats counts once for its host, and all its copies go or stay.  A null html has
    no lines; a null or hostless url belongs to the host ''.  Equal rows count each.
    A page meets its host's boilerplate as one list; since each line of the list is on
    ``max_ratio`` of the pages, it has at most (mean lines of a page) / ``max_ratio`` entries.
    """
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
    drop = boilerplate_lines(pages, max_ratio, min_pages).groupBy("host").agg(F.collect_set("key").alias("drop"))
    joined = own.join(drop, "host", "left")
    bad = F.coalesce("drop", F.array().cast("array<string>"))
    kept = F.filter("lines", lambda x: ~F.array_contains(bad, F.md5(x.cast("binary"))))
    return joined.select("page_id", "url", "host", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept")).select(
        "page_id",
        "url",
        "host",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"),
    )
