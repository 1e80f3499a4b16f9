"""HTML extraction with site template removal.

Every block element's subtree of every page is hashed; Spark counts per host on
how many pages with different main text a hash occurs; subtrees recurring across many
pages of their host are deleted: containers (lists, tables, sections, boxes) from ``min_pages`` pages on, paragraphs
and headings, which pages may quote, from ``min_text_pages`` on.  Both are numbers of pages, whatever the host's
size, so more pages of a host never bring a subtree back.  Elements whose name, role or class names
boilerplate go on any page, also on hosts of one page.  In a marked article
(``article``, ``main``) recurrence removes containers; its paragraphs and
headings stay, because other pages may quote them.

Defined results: a null or empty html gives the empty text; a null url has the host ''; repeated
rows give equal rows and count as one page; an empty table gives an empty table;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm.common import bounded_batches, cut, with_column
from hydroseries.llm.pagetree import BLOCK, TEXT_BLOCK, Page


def host_of(url="url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subtrees(pages: DataFrame) -> DataFrame:
    """Distinct block subtrees of each page: host, k1, k2 (page), main (hash of its
    main text), hash, open (whether recurrence would remove it), words (whether as a text block)."""
    def run(batches):
        for pdf in batches:
            out = []
            for host, k1, k2, html in zip(pdf["host"], pdf["k1"], pdf["k2"], pdf["html"]):
                page = Page(html)
                hs = page.hashes()
                main = hash_text(page.text())
                got = {}
                for i in range(1, len(hs)):
                    if page.tag[i] in BLOCK and page.tag[i] not in ("html", "body", "head"):
                        got[hs[i]] = (got.get(hs[i], (False,))[0] or (page.open_to_count(i) and not page.dropped[i]), page.tag[i] in TEXT_BLOCK)
                out.extend((host, k1, k2, main, h, *o) for h, o in got.items())
            yield pd.DataFrame(out, columns=["host", "k1", "k2", "main", "hash", "open", "words"])

    return pages.select("host", "k1", "k2", "html").mapInPandas(run, "host string, k1 long, k2 long, main long, hash long, open boolean, words boolean")


def recurring(found: DataFrame, min_pages: int, min_text_pages: int) -> DataFrame:
    """host, hash of the subtrees on enough pages with different main text."""
    pairs = found.groupBy("host", "hash", "main").agg(F.max("open").alias("open"), F.max("words").alias("words"))
    counts = pairs.groupBy("host", "hash").agg(F.count("*").alias("pages"), F.max("open").alias("open"), F.max("words").alias("words"))
    enough = F.col("pages") >= F.when(F.col("words"), F.lit(min_text_pages)).otherwise(F.lit(min_pages))
    return counts.where(F.col("open") & enough).select("host", "hash")


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def extract(pages: DataFrame, min_pages: int = 3, min_text_pages: int = 10, max_broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, text, n_chars per row of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    # the key of a page is its content, so a recomputed partition gives the same keys
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("host", host_of())
    p = p.withColumn("k1", F.xxhash64("url", "html")).withColumn("k2", F.xxhash64(F.lit(1), "html", "url"))
    found = cut(subtrees(p))
    lists = (found.where("open").join(recurring(found, min_pages, min_text_pages), ["host", "hash"], "left_semi")
             .groupBy("k1", "k2").agg(F.collect_set("hash").alias("removed")))  # at most the elements of one page
    lists = cut(lists)
    n = lists.agg(F.sum(F.size("removed"))).collect()[0][0] or 0
    joined = p.join(F.broadcast(lists) if n <= max_broadcast_rows else lists, ["k1", "k2"], "left")

    def start():
        def text(html, removed):
            page = Page(html)
            return page.text(frozenset(removed), page.hashes()) if removed else page.text()
        return lambda htmls, lists: [text(h, x) for h, x in zip(htmls, lists)]

    got = with_column(joined, "text", T.StringType(), start, ["html", "removed"], ["page_id", "url"])
    return got.withColumn("n_chars", F.length("text").cast("long"))
