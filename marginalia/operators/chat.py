"""The context of chat turns: what a model is given beside the conversation, for many conversations at once.

Sections come in the order of their standing: the open note, the view, notes, articles, files. Each is one relation
of the conversation's key, so the work is grouping by that key; only views can be large, and their rows are cut to those shown
before anything is joined to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a view that are shown, what stands for a note without text, headings of sections and of their entries.
ROWS, EMPTY = 50, "(empty note)"
OPEN, OPEN_ENTRY = "## Note the user currently has open", "### %s"
HEADS = {"notes": "USER NOTES:", "articles": "WIKIPEDIA ARTICLES:", "files": "SCANNED FILES:"}
ENTRIES = {"notes": '[Note: "%s"]', "articles": '[Wikipedia: "%s"]', "files": '[File: "%s" (%s)]'}


def _joined(items: Column, between: str) -> Column:
    """The texts of an array of structs, ordered by the fields before ``x``."""
    return F.array_join(F.transform(F.array_sort(items), lambda i: i["x"]), between)


def note_queries(queries: DataFrame, days: DataFrame, key: str) -> DataFrame:
    """``key, query``: search texts with the title of the day that was asked for behind them, where ``days(key, day_title)`` has one."""
    day = F.when(F.col("day_title").isNotNull(), F.regexp_replace(F.concat_ws(" ", "query", "day_title"), r"^\s+|\s+$", "")).otherwise(F.col("query"))
    return queries.join(days.select(key, "day_title"), key, "left").select(key, day.alias("query"))


def note_entries(matches: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """``key, place, title, text``: excerpts of the notes found, those of one title together, behind the note that is pinned.

    ``matches(key, rank, title, excerpts)``, ``pinned(key, title, content, locked)`` with one row of a key at most. A locked note is
    not pinned; in either case no match of its title is shown, since it is whole already or must not be read.
    """
    pin = pinned.select(key, F.col("title").alias("_pin"))
    found = matches.join(pin, key, "left").where(F.col("_pin").isNull() | (F.col("title") != F.col("_pin")))
    by_title = found.groupBy(key, "title").agg(F.min("rank").alias("place"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("excerpts").alias("x")))), lambda i: i["x"])).alias("t"))
    first = pinned.where(~F.coalesce("locked", F.lit(False))).select(key, F.lit(-1).cast(matches.schema["rank"].dataType).alias("place"), "title", F.when(F.trim(F.coalesce("content", F.lit(""))) == "", EMPTY).otherwise(F.col("content")).alias("text"))
    return first.unionByName(by_title.select(key, "place", "title", F.array_join("t", "\n").alias("text")))


def section(entries: DataFrame, kind: str, key: str) -> DataFrame:
    """``key, body, titles``: the entries ``(key, place, title, text)``, files with ``path``, below the heading of their kind."""
    named = F.format_string(ENTRIES[kind], *([F.col("title"), F.col("path")] if kind == "files" else [F.col("title")]))
    rows = entries.select(key, F.struct("place", "title", F.concat_ws("\n", named, "text").alias("x")).alias("e"))
    every = F.collect_list("e")
    return rows.groupBy(key).agg(F.concat(F.lit(HEADS[kind] + "\n"), _joined(every, "\n\n")).alias("body"), F.transform(F.array_sort(every), lambda i: i["title"]).alias("titles"))


def found_entries(matches: DataFrame, key: str) -> DataFrame:
    """Articles or files that were found, ``(key, rank, title, excerpts)`` with further columns, as entries."""
    return matches.withColumns({"place": F.col("rank"), "text": F.array_join("excerpts", "\n")}).drop("rank", "excerpts")


def open_note(notes: DataFrame, key: str) -> DataFrame:
    """``key, body``: the note that is open, ``(key, title, content)``."""
    return notes.select(key, F.concat_ws("\n", F.lit(OPEN), F.format_string(OPEN_ENTRY, F.trim("title")), F.coalesce("content", F.lit(""))).alias("body"))


def _definitions(defs: DataFrame) -> DataFrame:
    """``folder_id, head``: a line for each property, with the options of a choice."""
    options = F.when((F.col("type") == "select") & F.col("options").isNotNull(), F.concat(F.lit(" — options: "), F.array_join("options", ", "))).otherwise("")
    line = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), options)
    return defs.groupBy("folder_id").agg(_joined(F.collect_list(F.struct("position", "def_id", line.alias("x"))), "\n").alias("head"))


def _shown(rows: DataFrame, cells: DataFrame, defs: DataFrame) -> DataFrame:
    """``rows`` with ``props``: their cells as ``name: value``, without blank ones, in the order of the properties."""
    named = rows.select("note_id").join(cells.where(F.trim("value") != ""), "note_id").join(defs.select("def_id", "name", "position"), "def_id")
    props = named.groupBy("note_id").agg(_joined(F.collect_list(F.struct("position", "def_id", F.concat_ws(": ", "name", "value").alias("x"))), ", ").alias("props"))
    return rows.join(props, "note_id", "left").withColumn("props", F.coalesce("props", F.lit("")))


def table_view(folders: DataFrame, notes: DataFrame, cells: DataFrame, defs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``folder_id, body``: the properties and the first rows of each folder of ``folders(folder_id, label)``, and how many more there are.

    ``notes(folder_id, note_id, title)`` are in the order of their ids; ``cells(note_id, def_id, value)``; ``defs(folder_id, def_id, name, type, options, position)``.
    """
    here = notes.join(folders.select("folder_id"), "folder_id")
    first = here.withColumn("_p", F.row_number().over(W.partitionBy("folder_id").orderBy("note_id"))).where(F.col("_p") <= rows)
    line = F.concat(F.lit("- **"), F.col("title"), F.lit("**"), F.when(F.col("props") != "", F.concat(F.lit(" — "), F.col("props"))).otherwise(""))
    lines = _shown(first, cells, defs).groupBy("folder_id").agg(_joined(F.collect_list(F.struct("_p", line.alias("x"))), "\n").alias("lines"))
    sizes = here.groupBy("folder_id").agg((F.count("*") - rows).alias("more"))
    return _view(folders, defs, lines, sizes, "rows")


def board_view(folders: DataFrame, notes: DataFrame, cells: DataFrame, defs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``folder_id, body``: as :func:`table_view`, the rows in columns by the folder's first choice.

    Columns are its options in their order, that of rows without a value, then values that are no option. Each has its number of rows; a column begins
    only while rows may be shown.
    """
    choice = defs.where("type = 'select'").withColumn("_p", F.row_number().over(W.partitionBy("folder_id").orderBy("position", "def_id"))).where("_p = 1").select("folder_id", "def_id", "options")
    options = folders.join(choice, "folder_id").select("folder_id", F.posexplode("options").alias("o", "value")).unionByName(folders.join(choice, "folder_id").select("folder_id", F.size(F.coalesce("options", F.array())).alias("o"), F.lit("").alias("value")))
    options = options.groupBy("folder_id", "value").agg(F.min("o").alias("o"))
    valued = notes.join(folders.join(choice, "folder_id").select("folder_id", "def_id"), "folder_id").join(cells, ["note_id", "def_id"], "left")
    valued = valued.select("folder_id", "note_id", "title", F.trim(F.coalesce("value", F.lit(""))).alias("value"))
    counted = valued.groupBy("folder_id", "value").agg(F.count("*").alias("n"), F.min("note_id").alias("first"))
    columns = options.join(counted, ["folder_id", "value"], "full").withColumns({"n": F.coalesce("n", F.lit(0)), "o": F.coalesce("o", F.lit(1 << 30))})
    order = W.partitionBy("folder_id").orderBy("o", "first", "value")
    columns = columns.withColumns({"_c": F.row_number().over(order), "before": F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    begun = columns.where(F.col("before") < rows)
    # the first of each column, which tasks keep before they are shuffled; then what room is left
    first = valued.withColumn("_p", F.row_number().over(W.partitionBy("folder_id", "value").orderBy("note_id"))).where(F.col("_p") <= rows)
    first = first.join(begun.select("folder_id", "value", "before"), ["folder_id", "value"]).where(F.col("before") + F.col("_p") <= rows)
    line = F.concat(F.lit("- "), F.col("title"), F.when(F.col("props") != "", F.concat(F.lit(" ["), F.col("props"), F.lit("]"))).otherwise(""))
    lines = _shown(first, cells, defs).groupBy("folder_id", "value").agg(_joined(F.collect_list(F.struct("_p", line.alias("x"))), "\n").alias("lines"))
    head = F.concat(F.lit("\n### "), F.when(F.col("value") == "", "Unset").otherwise(F.col("value")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    blocks = begun.join(lines, ["folder_id", "value"], "left").groupBy("folder_id").agg(_joined(F.collect_list(F.struct("_c", F.concat_ws("\n", head, "lines").alias("x"))), "\n").alias("lines"))
    return _view(folders, defs, blocks, columns.groupBy("folder_id").agg((F.sum("n") - rows).alias("more")), "cards")


def _view(folders: DataFrame, defs: DataFrame, lines: DataFrame, sizes: DataFrame, what: str) -> DataFrame:
    more = F.when(F.col("more") > 0, F.concat(F.lit("\n... and "), F.col("more").cast("string"), F.lit(f" more {what} not shown")))
    parts = folders.join(_definitions(defs), "folder_id", "left").join(lines, "folder_id", "left").join(sizes, "folder_id", "left")
    return parts.select("folder_id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("label")), F.lit("Property definitions:"), "head", "lines", more).alias("body"))


def assembled(turns: DataFrame, key: str, opened: DataFrame | None = None, view: DataFrame | None = None, notes: DataFrame | None = None, articles: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """``key, context, sources, note_titles, article_titles`` of each conversation of ``turns``; a section that is not wanted is left out.

    ``opened`` and ``view`` have ``key, body``; the others come from :func:`section`. ``sources`` names what was found, first what is to be trusted first. Without any
    section the context is null.
    """
    out = turns.select(key).distinct()
    given = [("opened", opened), ("view", view), ("notes", notes), ("articles", articles), ("files", files)]
    for name, rows in given:
        if rows is None:
            out = out.withColumns({name: F.lit(None).cast("string"), f"{name}_titles": F.lit(None).cast("array<string>")})
        else:
            titles = F.col("titles") if "titles" in rows.columns else F.lit(None).cast("array<string>")
            out = out.join(rows.select(key, F.col("body").alias(name), titles.alias(f"{name}_titles")), key, "left")
    names = [name for name, _ in given]
    context = F.when(F.coalesce(*names).isNotNull(), F.concat_ws("\n\n", *names))
    sources = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in HEADS]))
    none = F.array().cast("array<string>")
    return out.select(key, context.alias("context"), sources.alias("sources"), F.coalesce("notes_titles", none).alias("note_titles"), F.coalesce("articles_titles", none).alias("article_titles"))


def messages(turns: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """``key, turn, role, text``: the turns ``(key, turn, role, text)`` behind a system turn that holds the context, where there is one."""
    first = turns.groupBy(key).agg((F.min("turn") - 1).alias("turn"))
    system = contexts.where("context IS NOT NULL").join(first, key).select(key, "turn", F.lit("system").alias("role"), F.col("context").alias("text"))
    return turns.select(key, "turn", "role", "text").unionByName(system)
