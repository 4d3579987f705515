"""Web pages → download links and HTML tables (sanctions discovery).

Works over a ``pages(page_id, url, html)`` table: every page is one row,
so per-page work is a set of array expressions on that row, and the
"best candidate per page" is a partial aggregation (``min(struct)``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from html import entities

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bidlens.functions.common import spread
from bidlens.functions.text import keyword_score

# Link suffixes and ranking keywords of a debarment page.
XL_EXTS = (".xlsx", ".xls")
KEYWORDS = ("debar", "ineligible", "firms", "sanction")
# Header words that mark a sanctions table.
TABLE_HEADERS = ("Firm", "Firm Name", "Name", "Entity")

HREF_RE = r"""(?i)href=["']([^"']+)["']"""
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path with a stack."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"), lambda acc, s: (
        F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
         .when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))))
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolutize(href: Column, base: Column) -> Column:
    """``urljoin(base, href)`` unless ``href`` already has a host (SRC-13).

    '//' → base scheme; '/' → base origin; '?'/'#' → base without
    query/fragment; relative → base directory.  In the path, '.' segments
    are removed and '..' takes back the segment before it, at any depth;
    above the root it is dropped."""
    origin = F.regexp_extract(base, ORIGIN_RE, 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    no_frag = F.regexp_replace(base, "#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    base_path = F.substring(no_query, F.length(origin) + 1, 1 << 30)
    base_dir = F.concat(origin, F.regexp_replace(
        F.when(base_path == "", F.lit("/")).otherwise(base_path), r"/[^/]*$", "/"))
    joined = (F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
               .when(href.startswith("/"), F.concat(origin, href))
               .when(href.startswith("?"), F.concat(no_query, href))
               .when(href.startswith("#"), F.concat(no_frag, href))
               .otherwise(F.concat(base_dir, href)))
    j_origin = F.regexp_extract(joined, ORIGIN_RE, 1)
    rest = F.substring(joined, F.length(j_origin) + 1, 1 << 30)
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    tail = F.substring(rest, F.length(path) + 1, 1 << 30)
    path = F.when(path.contains("/."), _without_dots(path)).otherwise(path)
    fixed = F.concat(j_origin, F.when((path == "") & (j_origin != ""), F.lit("/")).otherwise(path), tail)
    has_host = F.regexp_extract(href, ORIGIN_RE, 1) != ""
    return F.when(has_host, href).when(href.startswith("//"), joined).otherwise(fixed)


def link_candidates(pages: DataFrame, suffixes: Sequence[str] = XL_EXTS,
                    keywords: Sequence[str] = KEYWORDS, partitions: int | None = None) -> DataFrame:
    """Every href of every page whose lower-case text ends with one of the
    suffixes: (page_id, href, score, url)."""
    hrefs = spread(pages, partitions).select("page_id", F.col("url").alias("__base"),
                         F.explode(F.regexp_extract_all("html", F.lit(HREF_RE), 1)).alias("href"))
    low = F.lower(F.col("href"))
    ok = F.lit(False)
    for s in suffixes:
        ok = ok | low.endswith(s.lower())
    return hrefs.filter(ok).select(
        "page_id", "href", keyword_score(F.col("href"), list(keywords)).alias("score"),
        absolutize(F.col("href"), F.col("__base")).alias("url"))


def page_links(pages: DataFrame, suffixes: Sequence[str] = XL_EXTS,
               keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """SRC-11: the best download link per page — highest keyword score,
    then smallest URL (pages without a candidate are absent)."""
    c = link_candidates(pages, suffixes, keywords)
    best = c.groupBy("page_id").agg(F.min(F.struct((-F.col("score")).alias("neg"), "url")).alias("b"))
    return best.select("page_id", F.col("b.url").alias("url"), (-F.col("b.neg")).alias("score"))


def redirect_target(pages: DataFrame, suffixes: Sequence[str] = XL_EXTS) -> DataFrame:
    """SRC-12: first href ending with a suffix, made absolute (a redirector
    page pointing at the real file)."""
    alts = "|".join(s.lstrip(".").replace(".", r"\.") for s in suffixes)
    first = F.regexp_extract("html", r"""(?i)href=["']([^"']+\.(?:""" + alts + r"""))["']""", 1)
    return pages.select("page_id", F.when(first != "", absolutize(first, F.col("url"))).alias("url"))


def _strip_tags(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    t = F.regexp_replace(t, "&nbsp;", " ")
    t = F.regexp_replace(t, "&amp;", "&")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^ | $", "")


def decode_entities(text: Column) -> Column:
    """HTML entities of a text (named, decimal, hexadecimal) as characters, in
    one pass; what is no known entity stays."""
    names = F.create_map(*[F.lit(x) for n, c in sorted(entities.name2codepoint.items()) for x in (f"&{n};", chr(c))])

    def code(hexadecimal: Column) -> Column:
        return F.decode(F.unhex(F.lpad(hexadecimal, 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        return (F.when(~p.startswith("&"), p)
                .when(p.rlike("^&#[xX][0-9a-fA-F]{1,5};$"), code(F.regexp_extract(p, "([0-9a-fA-F]+);", 1)))
                .when(p.rlike("^&#[0-9]{1,6};$"), code(F.conv(F.regexp_extract(p, "([0-9]+);", 1), 10, 16)))
                .otherwise(F.coalesce(F.try_element_at(names, p), p)))
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#?[0-9A-Za-z]+;|[^&]+|&"), 0)
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def table_cells(pages: DataFrame) -> DataFrame:
    """Cells of all tables, nested ones apart: (page_id, table_no, row_no,
    cell_no, text, rows, cols), table_no in the order in which tables open.

    The tags of a page are events in order: a running count of opened and
    closed tables gives every event its depth and the table it belongs to (the
    last one opened at that depth), and counts inside a table its row and cell.
    A cell ends with the next cell, its row or its table, closed or not; text
    outside cells is left out; a nested table's text is its own, not its outer
    cell's.  Windows are per page, a page being one value anyway."""
    token = (r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|[^<]+|<")
    t = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(token), 0)).alias("pos", "tok"))
    t = t.withColumn("kind", F.lower(F.regexp_extract("tok", r"(?i)^<(/?(?:table|tr|td|th))\b", 1)))
    page = W.partitionBy("page_id").orderBy("pos")
    opens = F.col("kind") == "table"
    t = t.withColumn("sum", F.sum(F.when(opens, 1).when(F.col("kind") == "/table", -1).otherwise(0)).over(page))
    # a closing tag without its table counts for nothing
    t = t.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(page)))
    t = t.withColumn("level", F.col("depth") + (F.col("kind") == "/table").cast("int"))
    t = t.withColumn("no", F.when(opens, F.sum(opens.cast("int")).over(page) - 1))
    t = t.withColumn("table_no", F.max("no").over(W.partitionBy("page_id", "level").orderBy("pos"))).where("level > 0")
    own = W.partitionBy("page_id", "table_no").orderBy("pos")
    cell = F.col("kind").isin("td", "th")
    t = t.withColumn("row_no", F.greatest(F.sum((F.col("kind") == "tr").cast("int")).over(own) - 1, F.lit(0)))
    t = t.withColumn("cell", F.sum(cell.cast("int")).over(own))
    t = t.withColumn("inside", F.last(F.when(cell, True).when(F.col("kind") != "", False), ignorenulls=True).over(own))

    def span(name: str) -> Column:
        n = F.regexp_extract("tok", rf"(?i)\b{name}\s*=\s*[\"']?\s*(\d{{1,4}})", 1).try_cast("int")
        return F.max(F.when(cell, F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))))
    texts = F.array_sort(F.collect_list(F.when((F.col("kind") == "") & ~F.col("tok").rlike("^<[^<]"), F.struct("pos", "tok"))))
    c = t.where("inside").groupBy("page_id", "table_no", "row_no", "cell").agg(
        F.array_join(F.transform(texts, lambda x: x["tok"]), "").alias("raw"), span("rowspan").alias("rows"), span("colspan").alias("cols"))
    first = W.partitionBy("page_id", "table_no", "row_no").orderBy("cell")
    plain = F.regexp_replace(F.regexp_replace(decode_entities(F.col("raw")), r"[\s\u00a0]+", " "), r"^ | $", "")
    return c.select("page_id", "table_no", "row_no", (F.row_number().over(first) - 1).alias("cell_no"), plain.alias("text"), "rows", "cols")


def table_grid(pages: DataFrame) -> DataFrame:
    """Tables as grids: (page_id, table_no, row_no, col_no, text), where a cell
    stands at every place that its rowspan and colspan cover.  Tables are
    placed one by one (a page's table is a bounded group); rows below the last
    one are not made up."""
    cells = table_cells(pages).groupBy("page_id", "table_no").agg(F.to_json(F.array_sort(F.collect_list(
        F.struct("row_no", "cell_no", "text", "rows", "cols")))).alias("cells"))

    @F.pandas_udf("string")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tables in batches:
            out = []
            for text in tables:
                rows: dict[int, list] = {}
                for c in json.loads(text):
                    rows.setdefault(c["row_no"], []).append(c)
                taken, found, last = {}, [], max(rows)
                for r in range(last + 1):
                    col = 0
                    for c in rows.get(r, []):
                        while (r, col) in taken:
                            col += 1
                        for i in range(r, min(r + c["rows"], last + 1)):
                            for j in range(col, col + c["cols"]):
                                if (i, j) not in taken:
                                    taken[i, j] = True
                                    found.append({"row_no": i, "col_no": j, "text": c["text"]})
                        col += c["cols"]
                out.append(json.dumps(found))
            yield pd.Series(out)

    grid = F.from_json(place("cells"), "array<struct<row_no: int, col_no: int, text: string>>")
    return cells.select("page_id", "table_no", F.explode(grid).alias("g")).select("page_id", "table_no", "g.*")


def html_cells(pages: DataFrame, tags: Sequence[str] = ("table", "tr", "t[hd]")) -> DataFrame:
    """Every table cell: (page_id, table_no, row_no, col_no, text).  ``tags``
    names the table, row and cell elements, so that other lists (ul, li, a)
    can be read as tables too, up to the first closing tag; real tables are
    read as grids, nested ones apart."""
    if tuple(tags) == ("table", "tr", "t[hd]"):
        return table_grid(pages)
    table, row, cell = tags
    t = pages.select("page_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(rf"(?is)<{table}\b.*?</{table}>"), 0)).alias("table_no", "t"))
    r = t.select("page_id", "table_no", F.posexplode(
        F.regexp_extract_all("t", F.lit(rf"(?is)<{row}\b.*?</{row}>"), 0)).alias("row_no", "r"))
    c = r.select("page_id", "table_no", "row_no", F.posexplode(
        F.regexp_extract_all("r", F.lit(rf"(?is)<{cell}\b[^>]*>(.*?)</{cell}>"), 1)).alias("col_no", "raw"))
    return c.select("page_id", "table_no", "row_no", "col_no", _strip_tags(F.col("raw")).alias("text"))


def html_tables(pages: DataFrame, headers: Sequence[str] = TABLE_HEADERS,
                tags: Sequence[str] = ("table", "tr", "t[hd]")) -> DataFrame:
    """SRC-10: cells of the first table per page whose header row has a
    cell containing any of ``headers``."""
    cells = html_cells(pages, tags)
    hit = F.lit(False)
    for h in headers:
        hit = hit | F.col("text").contains(h)
    first = (cells.filter((F.col("row_no") == 0) & hit).groupBy("page_id")
                  .agg(F.min("table_no").alias("table_no")))
    return cells.join(first, ["page_id", "table_no"])


def table_sheet(cells: DataFrame, columns: int = 24) -> DataFrame:
    """The cells of ``html_tables`` as a sheet for ``normalize_sanctions``:
    one row per table row, columns named by the table's header row.  Tables
    differ in their headers, so the distinct header names (at most
    ``columns``, else an error) become the sheet's columns."""
    head = cells.filter("row_no = 0").select("page_id", "table_no", "col_no", F.col("text").alias("__name"))
    names = [r[0] for r in head.select("__name").distinct().orderBy("__name").limit(columns + 1).collect()]
    if len(names) > columns:
        raise ValueError(f"the tables have more than {columns} different headers")
    body = cells.filter("row_no > 0").join(head, ["page_id", "table_no", "col_no"])
    rows = body.groupBy("page_id", "table_no", "row_no").agg(
        *[F.min(F.when(F.col("__name") == n, F.col("text"))).alias(n) for n in names])
    return rows.withColumn("__row_order", F.struct("page_id", "table_no", "row_no")).drop("page_id", "table_no", "row_no")
