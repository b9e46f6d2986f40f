"""Lines that a site repeats on its pages.

Pages are grouped by host; a line that stands on more than ``RATIO`` of a host's pages is boilerplate there.  Only
hashes of lines are shuffled, counted per host and line before they are; texts stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyforest.llm.common import text_of
from replyforest.session import passing_folder, stage

RATIO = 0.1
ADDED = ("host", "kept_lines", "n_dropped")
LEAST_PAGES = 2  # a line on one page is no boilerplate, however few pages its host has
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
UNSEEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
SCRIPT_END = r"(?i)</(?:script|style)>"
SCRIPT = r"(?i)<(?=script|style)"
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|nav|article|section|header|footer|title|head|body|html|table|tr|td|th|h[1-6])(?:\s[^>]*)?/?>"
TAGS = r"<[^>]*>"
MARK = "\x01"  # in texts followed by "e" while openers are marked


def host_of(url: Column) -> Column:
    """The host of an address in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(text_of(url), HOST, 1))


def _once(value: Column, use) -> Column:
    """``use(value)`` for a value that is named several times but worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _split_at(text: Column, rest: Column, before, after) -> Column:
    """``before`` of ``text`` without its last ``rest`` characters, and ``after`` of these."""
    cut = F.length(text) - rest
    return _once(cut, lambda n: F.concat(before(F.substr(text, F.lit(1), n)), after(F.substr(text, F.greatest(n, F.lit(0)) + 1))))


def _after_last(text: Column, end: str) -> Column:
    """How many characters follow the last ``end``; all, if there is none."""
    return F.length(F.substring_index(text, end, -1))


def _after_tags(text: Column) -> Column:
    """How many characters follow the last ``>`` in which a tag of a closed script may end."""
    tail = F.length(F.element_at(F.split(text, SCRIPT_END), -1))
    return _once(tail, lambda n: n + 1 + _after_last(F.substr(text, F.lit(1), F.length(text) - n - 1), ">"))


def _open_at_end(text: Column) -> Column:
    """Whether a script, style or comment may begin that nothing closes."""
    comment = F.contains(F.substring_index(text, "-->", -1), F.lit("<!--"))
    # A tag of a script must be whole before the end that closes it.
    cut_short = lambda parts: F.contains(F.substring_index(F.get(parts, F.size(parts) - 2), ">", -1), F.lit("<"))
    script = lambda parts: F.element_at(parts, -1).rlike(SCRIPT) | F.coalesce(cut_short(parts), F.lit(False))
    return comment | _once(F.split(text, SCRIPT_END), script)


def _marked(text: Column) -> Column:
    """``text`` with a mark in every opener beyond the last end of its kind; ``MARK`` itself is followed by "e"."""
    same = lambda part: part
    no_scripts = lambda rest: F.regexp_replace(rest, SCRIPT, f"<{MARK}m")
    no_comments = lambda rest: F.replace(rest, F.lit("<!--"), F.lit(f"<{MARK}m!--"))
    escaped = F.replace(text, F.lit(MARK), F.lit(MARK + "e"))
    scripts = _once(escaped, lambda t: _split_at(t, _after_tags(t), same, no_scripts))
    return _once(scripts, lambda t: _split_at(t, _after_last(t, "-->"), same, no_comments))


def _without_unseen(text: Column) -> Column:
    """``text`` without scripts, styles and comments that are closed.

    An opener that nothing closes would be followed to the end of the text, each anew.  So these are first broken by a
    mark, which is taken out again; any other opener is closed, and read over once.
    """
    unmarked = lambda t: F.replace(F.replace(t, F.lit(MARK + "m"), F.lit("")), F.lit(MARK + "e"), F.lit(MARK))
    broken = lambda t: unmarked(F.regexp_replace(_marked(t), UNSEEN, ""))
    return _once(text, lambda t: F.when(_open_at_end(t), broken(t)).otherwise(F.regexp_replace(t, UNSEEN, "")))


def _tags_replaced(text: Column, tags: str, by: str) -> Column:
    """``text`` with ``tags`` replaced; what is open after the last ``>`` never ends, and is not searched."""
    replaced = lambda part: F.regexp_replace(part, tags, by)
    is_open = lambda t: F.contains(F.substring_index(t, ">", -1), F.lit("<"))
    ended = lambda t: _split_at(t, _after_last(t, ">"), replaced, lambda rest: rest)
    return _once(text, lambda t: F.when(is_open(t), ended(t)).otherwise(replaced(t)))


def lines_of_html(html: Column) -> Column:
    """What a reader sees, a line for each block: trimmed of blanks, without empty lines.

    Closed scripts, styles and comments go, then tags of blocks become line breaks, then all other tags go; openers
    that nothing closes are text.  Every step takes time in proportion to the text.
    """
    seen = _tags_replaced(_tags_replaced(_without_unseen(text_of(html)), BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(seen, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def lines_of_text(text: Column) -> Column:
    return F.split(text_of(text), "\n")


def without_boilerplate(
    pages: DataFrame, lines: Column, url: str = "url", ratio: float = RATIO, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """``pages`` with ``host``, ``kept_lines`` and ``n_dropped``.

    A line of a page is dropped if it stands on more than ``ratio``, and on at least ``least_pages``, of the pages of
    its host; a page counts once however often it holds the line.  Pages without a host form one group.  Null and
    empty texts have no lines, or one empty one, as ``lines`` says; repeated rows are pages each;
    columns of the names it adds are replaced.  An empty table
    stays empty.
    """
    with passing_folder(pages.sparkSession, "lines") as steps:
        rest = [c for c in pages.columns if c not in ADDED]
        held = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("own"), host_of(F.col(f"`{url}`")).alias("host"), lines.alias("_lines"))
        keys = F.transform("_lines", lambda x: F.xxhash64(x))
        narrow = held.select("host", F.array_distinct(keys).alias("keys"))
        totals = narrow.groupBy("host").agg(F.count("*").alias("pages"))
        # A plain explode would be preceded by a filter on the size of the array, for which all lines are made once more.
        single = narrow.select("host", F.explode_outer("keys").alias("key")).where(F.col("key").isNotNull())
        counts = single.groupBy("host", "key").agg(F.count("*").alias("on"))
        often = counts.where(F.col("on") >= least_pages).join(totals, "host").where(F.col("on") > F.col("pages") * ratio)
        # A host has at most the lines of an average page, divided by the ratio, that are on so many of its pages.
        # Written first, so that a table known to be small is not shuffled for.
        known = stage(often.groupBy("host").agg(F.collect_set("key").alias("_known")), "known", folder=steps)
        joined = held.join(known, "host", "left")
        stays = lambda x: F.col("_known").isNull() | ~F.array_contains(F.col("_known"), F.xxhash64(x))
        found = joined.withColumn("kept_lines", F.filter("_lines", stays))
        found = found.withColumn("n_dropped", (F.size("_lines") - F.size("kept_lines")).cast("bigint"))
        return stage(found.select(*[F.col("own")[c].alias(c) for c in rest], *ADDED), "lines")


def site_lines(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, host, n_lines, n_dropped, kept_sha256`` of every page, whose lines are those of its blocks."""
    plain = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    seen = plain.select("page_id", "url", lines_of_html(F.col("html")).alias("all_lines"))
    found = without_boilerplate(seen, F.col("all_lines"))
    return found.select(
        "page_id",
        "host",
        F.size("all_lines").cast("bigint").alias("n_lines"),
        "n_dropped",
        F.sha2(F.array_join("kept_lines", "\n").cast("binary"), 256).alias("kept_sha256"),
    )
