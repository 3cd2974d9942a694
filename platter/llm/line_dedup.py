"""Line dedup by site: lines that a large share of a host's pages carry are boilerplate.

For each host the pages with a line are counted (a page counts once, however often it
has the line) and divided by the pages of the host. Lines at or over ``ratio`` go, in
hosts of ``min_pages`` pages or more and if ``min_repeats`` pages or more have them.

Only (host, 64-bit line hash) is shuffled and partial counts are made before that, so a
host with a third of all pages costs each task one row per line. The lines of a host
that go are at most (mean number of different lines of its pages) / ratio, which bounds
the array that a host is joined with. The table of those arrays is written first, so
that Spark broadcasts it only if its known size allows and splits a hot host otherwise.

With ``once``, for corpora with groups of copies, pages of a host with the same lines count as one page in both
numbers, so only lines that stand in different pages can go, and each line stays in the page with the least hash of
all that have it: near copies, which share most lines, lose none of them altogether. The pages are
brought to one row per host and content before lines are dealt out, and partial counts come first there as well.

Defined results: a null text has no lines; a row without a host keeps all its lines;
blank lines are never counted and never dropped; repeated rows count as pages of their
own unless ``once`` is given; an empty table gives an empty result. All columns of the input stay; the columns
the operator adds are named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import free_name, let
from platter.session import stored

RATIO = 0.1
MIN_PAGES = 5
MIN_REPEATS = 3

_BLANKS = "".join(map(chr, range(0x21))) + "\xa0"
_BLANK = r"^[\x00-\x20 ]+|[\x00-\x20 ]+$"
_BLOCK = (
    r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|article|section|nav|table|tr|td|th|title|head|body|html"
    r"|header|footer|main|aside|pre|blockquote|form|option)(?:[\s/][^>]*)?>"
)
_HIDDEN = r"(?is)<(?:script(?:\s[^>]*)?>.*?</script\s*>|style(?:\s[^>]*)?>.*?</style\s*>|!--.*?-->)"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))
    return F.when(host != "", host)


def _bare(line: Column) -> Column:
    """A line without the blanks around it."""
    return F.btrim(line, F.lit(_BLANKS))


def html_lines(html: Column) -> Column:
    """Visible lines of a page: block elements end a line, other tags, scripts and comments go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, _BLOCK, "\n"), r"<[^>]*>", "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), _bare), lambda x: x != "")


def parsed_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", lines: str = "lines") -> DataFrame:
    """``pages`` with ``host`` and their visible ``lines`` in place of URL and HTML, written: each page is parsed once, however often its lines are read."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (url_col, html_col)]
    parsed = pages.select(*rest, host_of(F.col(url_col)).alias("host"), html_lines(F.col(html_col)).alias(lines))
    return stored(parsed, "parsed-pages")


def text_lines(text: Column) -> Column:
    """Lines of a plain text; a null text has none."""
    return F.when(text.isNotNull(), F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def _key(line: Column) -> Column:
    """64-bit hash of a line without the blanks around it; null for a blank line."""
    bare = _bare(line)
    return F.when(bare != "", F.xxhash64(bare))


def _keys(lines: Column | str) -> Column:
    """The hashes of the lines that are not blank, in order."""
    return F.filter(F.transform(lines, _key), lambda k: k.isNotNull())


def content_of(lines: Column | str) -> Column:
    """64-bit hash of the lines of a page that are not blank, in order."""
    return F.xxhash64(_keys(lines))


def boilerplate(
    pages: DataFrame,
    host: Column,
    lines: Column,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    min_repeats: int = MIN_REPEATS,
    once: bool = False,
) -> DataFrame:
    """(host, keys): the hashes of each host's boilerplate lines; hosts without any have no row.

    With ``once`` also ``pages_of``, by line the content hash of the page where it stays.
    """
    sites = pages.select(host.alias("host"), lines.alias("lines")).where(F.col("host").isNotNull())
    keys = F.array_distinct(_keys("lines"))
    if once:
        #: Equal contents have equal keys, so any row stands for all of them.
        sites = sites.select("host", content_of("lines").alias("page"), keys.alias("found"))
        sites = sites.groupBy("host", "page").agg(F.first("found").alias("found"))
        keys, page = F.col("found"), F.col("page")
    else:
        page = F.lit(0).cast("long")
    #: A page also counts under the null key, which gives the host's total.
    each = sites.select("host", page.alias("page"), F.explode(F.concat(keys, F.array(F.lit(None).cast("long")))).alias("key"))
    counts = each.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page"))
    counts = stored(counts.where((F.col("n") >= min_repeats) | F.col("key").isNull()), "line-counts")
    totals = counts.where(F.col("key").isNull() & (F.col("n") >= min_pages)).select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("key").isNotNull()).join(totals, "host").where(F.col("n") >= ratio * F.col("pages"))
    if not once:
        return often.groupBy("host").agg(F.collect_list("key").alias("keys"))
    both = often.groupBy("host").agg(F.collect_list(F.struct("key", "page")).alias("both"))
    return both.select("host", F.col("both.key").alias("keys"), F.col("both.page").alias("pages_of"))


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    lines: Column,
    kept: str = "kept_lines",
    before: str = "n_lines",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    min_repeats: int = MIN_REPEATS,
    once: bool = False,
) -> DataFrame:
    """``pages`` with ``kept``, the lines that stay, and ``before``, how many there were."""
    bad = stored(boilerplate(pages, host, lines, ratio, min_pages, min_repeats, once), "boilerplate")
    of_page, split, site, keys, owners = (free_name(pages, n) for n in ("_host", "_lines", "_site", "_keys", "_owners"))
    owner = F.col("pages_of" if once else "keys").alias(owners)
    bad = bad.select(F.col("host").alias(site), F.col("keys").alias(keys), *[owner] * once)
    joined = pages.withColumns({of_page: host, split: lines}).join(bad, F.col(of_page) == F.col(site), "left")
    if once:
        gone = let(content_of(split), lambda own: F.filter(F.transform(keys, lambda k, i: F.when(F.get(owners, i) != own, k)), lambda k: k.isNotNull()))
        joined = joined.withColumn(keys, F.when(F.col(keys).isNotNull(), gone))
    stays = F.when(F.col(keys).isNull(), F.col(split)).otherwise(
        F.filter(split, lambda x: ~F.coalesce(F.array_contains(F.col(keys), _key(x)), F.lit(False)))
    )
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], stays.alias(kept), F.size(split).alias(before))
