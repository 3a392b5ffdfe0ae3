"""Articles of an encyclopedia bundle, links between them, highlights, and queries from a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.documents import UDFS

#: Characters that are embedded at once, least length of an article, size under which a page may be a redirect.
CHARS, LEAST, REDIRECT = 1500, 200, 800
#: Name spaces whose pages are no articles.
_SPACES = ("mediawiki:", "module:", "template:", "wikipedia:", "file:")
#: Phrases that are taken out of a question, wherever they are.
CHAT_PHRASES = (
    r"(?i)what (have i|did i|do i have) (written?|noted?|said?) (about|on|regarding)\s*",
    r"(?i)tell me (about|what i (wrote|know|noted) about)\s*",
    r"(?i)what (are|is) my (notes?|thoughts?) (on|about)\s*",
    r"(?i)show me (my notes? on|what i wrote about)\s*",
)


def articles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, path, title, content`` of the pages that are articles, with their whole text; cheap tests come before the parse."""
    path = F.regexp_replace("url", r"^https?://[^/]+/", "")
    low = F.lower("path")
    rows = pages.withColumn("path", path).where(~(F.col("path").startswith(".") & ~F.col("path").startswith("./")) & ~F.col("path").startswith("-/"))
    for s in _SPACES:
        rows = rows.where(~low.contains(s))
    rows = rows.where(~is_redirect(F.col("html")))
    # one parse for title and text; not deterministic in name, so that no filter is moved below it with a second one
    rows = rows.withColumn("parsed", UDFS["html_article"](F.col("html"))).withColumn("title", F.col("parsed.title")).withColumn("content", F.col("parsed.flat"))
    rows = rows.where(F.length("content") >= least)
    return rows.where(~F.coalesce(F.lower("title").endswith("(disambiguation)"), F.lit(False)) & ~low.contains("_(disambiguation)")).select("page_id", "path", "title", "content")


def article_chunks(found: DataFrame, chars: int = CHARS) -> DataFrame:
    """``page_id, path, chunk_index, title, content, text``: the whole text of each article in pieces of at most ``chars`` characters; ``text`` is what is embedded.

    Pieces end at blanks; a word that is longer than a piece is split.
    """
    parts = F.regexp_extract_all("content", F.lit(rf"(?s)\S(?:.{{0,{chars - 2}}}\S)?(?!\S)|\S{{{chars}}}"), F.lit(0))
    rows = found.select("page_id", "path", "title", F.posexplode(parts).alias("chunk_index", "content"))
    return rows.withColumn("text", F.concat_ws("\n", F.concat(F.lit("search_document: "), F.col("title")), "content"))


def is_redirect(html: Column) -> Column:
    """Whether a page only sends its reader on."""
    return (F.octet_length(html) < REDIRECT) & F.lower(html).contains("http-equiv") & F.lower(html).contains("refresh")


def scan_window(pages: DataFrame, start: int, size: int) -> DataFrame:
    """The HTML entries of an archive, by ``page_id``, in a window of ``size`` entries; redirects are left out."""
    return pages.where((F.col("page_id") >= start) & (F.col("page_id") < start + size)).where(~F.coalesce(is_redirect(F.col("html")), F.lit(True)))


def scan_windows(pages: DataFrame, size: int) -> DataFrame:
    """All entries with the ``window`` that reads each, as :func:`scan_window` does one by one."""
    return pages.withColumn("window", F.floor(F.col("page_id") / size).cast("long")).where(~F.coalesce(is_redirect(F.col("html")), F.lit(True)))


def read_articles(wanted: DataFrame, pages: DataFrame, hops: int = 3) -> DataFrame:
    """``wanted(wanted)`` with ``path, html``: the page of that path, with or without ``A/``, after up to ``hops`` redirects.

    What is a redirect still, or one to a page that is not there, is no article and has no row.
    """
    named = pages.select(F.col("url").alias("path"), "html")
    target = tx.wiki_path(F.regexp_replace(F.regexp_extract("html", r"(?is)http-equiv\s*=\s*[\"']?refresh.*?url\s*=\s*[\"']?([^\"'>\s]+)", 1), "#.*$", ""))

    def step(asked: DataFrame) -> DataFrame:
        tries = asked.select("wanted", F.posexplode(tx.path_candidates(F.col("at"))).alias("_try", "path")).join(named, "path")
        first = F.row_number().over(W.partitionBy("wanted").orderBy("_try"))
        return tries.withColumn("_p", first).where("_p = 1").select("wanted", "path", "html")

    found = step(wanted.select("wanted", F.col("wanted").alias("at")).distinct())
    for _ in range(hops):
        on = found.where(is_redirect(F.col("html")) & (target != ""))
        found = found.join(on.select("wanted"), "wanted", "left_anti").unionByName(step(on.select("wanted", target.alias("at"))))
    return found.where(~(is_redirect(F.col("html")) & (target != "")))


def suggestions(titles: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return titles.where(F.lower("title").startswith(prefix.strip().lower())).orderBy("title").limit(limit)


def resolved_links(wanted: DataFrame, key: str, bundles: DataFrame, current: str | None = None) -> DataFrame:
    """For each ``wanted`` path the first article of any bundle, the current one first: with or without ``A/``."""
    tries = wanted.select(key, F.posexplode(tx.path_candidates(tx.wiki_path(F.regexp_replace("wanted", "#.*$", "")))).alias("_try", "path"))
    found = tries.join(bundles, "path")
    order = [F.when(F.col("bundle_id") == current, 0).otherwise(1)] if current else []
    place = F.row_number().over(W.partitionBy(key).orderBy(*order, F.coalesce("title", "bundle_id"), "_try", "path"))
    return found.withColumn("_p", place).where("_p = 1").drop("_p", "_try")


def anchored(text: Column, needle: Column, before: Column, after: Column) -> Column:
    """Whether a highlight is found: with its context, if it has one."""
    bare = (F.coalesce(before, F.lit("")) == "") & (F.coalesce(after, F.lit("")) == "")
    return F.when(bare, F.contains(text, needle)).otherwise(F.contains(text, F.concat(before, needle, after)) | F.contains(text, F.concat(needle, before, after)))


def orphaned(highlights: DataFrame, gone: str) -> DataFrame:
    """Highlights after a bundle went: its own stay without bundle, as orphans."""
    own = F.col("bundle_id") == gone
    return highlights.withColumn("status", F.when(own, "orphaned").otherwise(F.col("status"))).withColumn("bundle_id", F.when(~own, F.col("bundle_id")))


def chat_queries(turns: DataFrame, last: int = 2) -> DataFrame:
    """``conv_id, query``: the last two user turns without conversational phrases; where nothing is left, as they were."""
    users = turns.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    raw = F.array_join(F.transform(F.slice("t", -F.least(F.size("t"), F.lit(last)), F.lit(last)), lambda x: x["text"]), " ")
    clean = raw
    for phrase in CHAT_PHRASES:
        clean = F.regexp_replace(clean, phrase, "")
    clean = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return users.select("conv_id", F.when(clean == "", raw).otherwise(clean).alias("query"))


def turns_text(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, context``: the turns of each conversation, a line each, in order."""
    return turns.groupBy(key).agg(F.expr("listagg(role || ': ' || text, '\\n') WITHIN GROUP (ORDER BY turn)").alias("context"))


def not_blank(chunks: DataFrame, column: str = "text") -> DataFrame:
    """Chunks that hold more than blanks."""
    return chunks.where(F.trim(column) != "")


def context(sections: list[tuple[str, DataFrame]], cap: int = 50) -> DataFrame:
    """``section, body``: titled blocks in the order of the sections, each title once, at most ``cap`` rows of a section and the number left out."""
    every = None
    for i, (name, df) in enumerate(sections):
        rows = df.select(F.lit(i).alias("o"), F.lit(name).alias("section"), "rank", "title", "body")
        every = rows if every is None else every.unionByName(rows)
    once = every.withColumn("_t", F.row_number().over(W.partitionBy("title").orderBy("o", "rank"))).where("_t = 1")
    placed = once.withColumn("_p", F.row_number().over(W.partitionBy("section").orderBy("rank")))
    parts = F.array_sort(F.collect_list(F.when(F.col("_p") <= cap, F.struct("_p", F.concat_ws("\n", F.concat(F.lit("## "), F.col("title")), "body").alias("x")))))
    more = F.when(F.count("*") > cap, F.concat(F.lit("\n… "), (F.count("*") - cap).cast("string"), F.lit(" more"))).otherwise("")
    return placed.groupBy("o", "section").agg(F.concat(F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n"), more).alias("body")).orderBy("o").select("section", "body")
