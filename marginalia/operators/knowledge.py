"""Relations of a note collection: access, tags, links, folders, properties, calendar, audit, versions, upserts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions.documents import UDFS

from .storage import persisted

#: The actions of the log by group.
ACTION_GROUPS = {
    "notes": ["note_open", "note_create", "note_update", "note_delete", "note_export"],
    "folders": ["folder_create", "folder_rename", "folder_delete"],
    "search": ["search_fts", "search_semantic", "search_combined"],
    "llm": ["llm_chat", "llm_improve"],
    "file_scanner": ["file_scan", "file_import"],
    "wikipedia": ["wikipedia_read"],
}
KEEP_VERSIONS, UNSET = 20, "__unset__"


# --- access ---------------------------------------------------------------------------------------


def blocked_folders(folders: DataFrame, unlocked: list[int] | None = None) -> DataFrame:
    """Locked folders without a session key; a lock does not reach the folders below."""
    locked = folders.where("locked").select(F.col("id").alias("folder_id"))
    return locked.where(~F.col("folder_id").isin(unlocked)) if unlocked else locked


def accessible(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows outside blocked folders; those in no folder always."""
    return rows.join(blocked, "folder_id", "left_anti")


def masked(notes: DataFrame, blocked: DataFrame) -> DataFrame:
    """All notes; those in blocked folders as stubs without title and content."""
    flagged = notes.join(blocked.withColumn("_b", F.lit(True)), "folder_id", "left").withColumn("locked", F.coalesce("_b", F.lit(False)))
    stub = lambda c: F.when(F.col("locked"), "").otherwise(F.col(c)).alias(c)
    return flagged.select("note_id", stub("title"), stub("content"), "folder_id", "locked")


# --- tags and links -------------------------------------------------------------------------------


def note_tags(notes: DataFrame) -> DataFrame:
    return notes.select("note_id", F.explode(tx.parse_tags(F.col("content"))).alias("tag"))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def notes_by_tag(notes: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return notes.join(tags.where(F.col("tag") == tag.lower().lstrip("#")).select("note_id"), "note_id", "left_semi")


def filtered_tags(counts: DataFrame, typed: str, otherwise: int = 3) -> DataFrame:
    """Tags that contain what is typed (without a leading #); nothing typed: the first few."""
    needle = typed.strip().lower().lstrip("#")
    return counts.where(F.lower("tag").contains(needle)).orderBy("tag") if needle else counts.orderBy("tag").limit(otherwise)


def first_by_title(notes: DataFrame) -> DataFrame:
    """``title, target_id``: of notes with equal titles the one updated last (then the smallest id)."""
    place = F.row_number().over(W.partitionBy("title").orderBy(F.desc("updated_at"), "note_id"))
    return notes.select("title", "note_id", "updated_at").withColumn("_p", place).where("_p = 1").select("title", F.col("note_id").alias("target_id"))


def note_links(notes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``source_id, target_id`` of the links whose title exists; links to oneself go."""
    found = notes.select(F.col("note_id").alias("source_id"), F.explode(tx.parse_wiki_links(F.col("content"))).alias("title"))
    return found.join(first_by_title(targets if targets is not None else notes), "title").where("source_id != target_id").select("source_id", "target_id").distinct()


def backlinks(notes: DataFrame, links: DataFrame, note_id: int) -> DataFrame:
    return links.where(F.col("target_id") == note_id).join(notes, F.col("source_id") == notes["note_id"]).select("note_id", "title").orderBy("title", "note_id")


def outgoing(notes: DataFrame, links: DataFrame, note_id: int) -> DataFrame:
    return links.where(F.col("source_id") == note_id).join(notes, F.col("target_id") == notes["note_id"]).select("note_id", "title").orderBy("title", "note_id")


def graph_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both ends of which are among the nodes."""
    a, b = nodes.select(F.col("note_id").alias("source_id")), nodes.select(F.col("note_id").alias("target_id"))
    return links.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi")


def unlinked_mentions(notes: DataFrame, links: DataFrame, note_id: int, title: str) -> DataFrame:
    """Other notes that hold the title outside of ``[[title]]`` and do not link to the note."""
    plain = F.replace("content", F.lit(f"[[{title}]]"), F.lit(""))
    rows = notes.where((F.col("note_id") != note_id) & plain.contains(title))
    linked = links.where(F.col("target_id") == note_id).select(F.col("source_id").alias("note_id"))
    return rows.join(linked, "note_id", "left_anti").select("note_id", "title")


#: A word of a text or title, and what parts words for comparing whole ones.
_WORD, _NO_WORD = r"[\p{L}\p{M}\p{N}_-]+", r"[^\p{L}\p{M}\p{N}_-]+"


def _in_words(text: Column) -> Column:
    """The words of a text with one blank around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, _NO_WORD, " ")), F.lit(" "))


def all_unlinked_mentions(notes: DataFrame, links: DataFrame) -> DataFrame:
    """``note_id, mentions_id`` for every title that other notes hold as whole words outside of ``[[title]]``.

    An equi-join on each title's longest word finds the notes that can hold it, and only titles of several words are
    then looked for in their texts; no title is compared with all notes. Titles without a word are never mentioned.
    """
    titles = first_by_title(notes).withColumn("parts", F.regexp_extract_all("title", F.lit(_WORD), F.lit(0))).where(F.size("parts") > 0)
    longest = F.array_sort("parts", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    titles = titles.select("title", "target_id", longest[0].alias("word"), F.size("parts").alias("n"))
    words = notes.select("note_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_WORD), F.lit(0)))).alias("word"))
    pairs = words.join(titles, "word").where("note_id != target_id").join(notes.select("note_id", "content"), "note_id")
    plain = F.replace("content", F.concat(F.lit("[["), "title", F.lit("]]")), F.lit(" | "))
    found = pairs.where(F.when((F.col("n") == 1) & ~F.col("content").contains("[["), True).otherwise(F.contains(_in_words(plain), _in_words(F.col("title")))))
    linked = links.select(F.col("source_id").alias("note_id"), F.col("target_id").alias("mentions_id"))
    return found.select("note_id", F.col("target_id").alias("mentions_id")).join(linked, ["note_id", "mentions_id"], "left_anti")


def mention_linked(notes: DataFrame, links: DataFrame, note_id: int, title: str) -> tuple[DataFrame, DataFrame]:
    """Notes after the first plain mention of a title in one of them became a link, and the links then."""
    new = F.when(F.col("note_id") == note_id, UDFS["link_first_mention"](F.col("content"), F.lit(title))).otherwise(F.col("content"))
    changed = notes.withColumn("content", new)
    own = note_links(changed.where(F.col("note_id") == note_id), changed)
    return changed, links.where(F.col("source_id") != note_id).unionByName(own)


# --- folders --------------------------------------------------------------------------------------


def closure(folders: DataFrame) -> DataFrame:
    """``ancestor, id, depth`` of every folder and all below it; cycles end where they meet themselves.

    Each round doubles the reach, so rounds grow with the logarithm of the depth. There are as many rows as pairs;
    :func:`marginalia.operators.trees.labelled` has one for each folder.
    """
    steps = folders.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("ancestor"), "id", F.lit(1).alias("depth"))
    reach = folders.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("depth")).unionByName(steps)
    span = 1
    while True:
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.id") == F.col("b.ancestor")).select("a.ancestor", "b.id", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        reach = persisted(longer.groupBy("ancestor", "id").agg(F.min("depth").alias("depth")), "closure")
        if reach.where(F.col("depth") > span).isEmpty():
            return reach
        span *= 2


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """``id, depth`` of a folder and all below it, however deep; a cycle ends where it meets the folder.

    One row for each folder, which looks twice as far up in each round; what is on a cycle elsewhere is given up
    once it has looked as far as there are folders.
    """
    at = F.col("id") == root
    now = folders.select("id", F.when(~at, F.col("parent_id")).alias("up"), F.when(at, 0).alias("depth"))
    span, most = 1, folders.count()
    while True:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("there"))
        now = now.join(above, "up", "left").select("id", F.col("next").alias("up"), F.coalesce("depth", F.col("there") + span).alias("depth"))
        now, span = persisted(now, "subtree"), span * 2
        if span > most or now.where("up IS NOT NULL AND depth IS NULL").isEmpty():
            return now.where("depth IS NOT NULL").select("id", "depth")


def folder_tree(folders: DataFrame, root: int | None = None) -> list[dict]:
    """The nested tree ``{id, name, children}`` below a folder, or of all: for display, so on the driver."""
    rows = folders.select("id", "name", "parent_id").orderBy("id").collect()
    below: dict = {}
    for r in rows:
        below.setdefault(r.parent_id, []).append(r)
    make = lambda parent, seen: [{"id": r.id, "name": r.name, "children": make(r.id, seen | {r.id})} for r in below.get(parent, []) if r.id not in seen]
    return make(root, frozenset())


def is_within(folders: DataFrame, folder: int, ancestor: int) -> bool:
    """Whether a folder is another one or below it."""
    return not subtree(folders, ancestor).where(F.col("id") == folder).isEmpty()


def can_move(folders: DataFrame, folder: int, to: int | None) -> bool:
    """Whether a folder may go there: not into itself or below."""
    return to is None or not is_within(folders, to, folder)


def folder_paths(folders: DataFrame, sep: str = "/") -> DataFrame:
    """``id, path`` of cleaned names from the root down; missing parents are roots."""
    name = F.when(F.coalesce("name", F.lit("")) == "", F.concat(F.lit("folder_"), "id")).otherwise(F.col("name"))
    named = folders.select("id", tx.path_component(name).alias("part"))
    up = closure(folders).join(named.withColumnRenamed("id", "ancestor"), "ancestor")
    parts = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("o"), "part")))
    return up.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), sep).alias("path"))


def export_paths(notes: DataFrame, folders: DataFrame) -> DataFrame:
    """``note_id, path`` of the files a tree export writes; equal names in a folder get ``_id``."""
    named = notes.join(folder_paths(folders).withColumnRenamed("id", "folder_id"), "folder_id", "left").withColumn("name", tx.path_component(F.col("title")))
    copies = F.count("*").over(W.partitionBy("folder_id", "name"))
    file = F.concat(F.col("name"), F.when(copies > 1, F.concat(F.lit("_"), F.col("note_id"))).otherwise(""), F.lit(".md"))
    return named.select("note_id", F.concat_ws("/", "path", file).alias("path"))


# --- properties -----------------------------------------------------------------------------------


def table_view(notes: DataFrame, defs: DataFrame, cells: DataFrame) -> DataFrame:
    """``note_id, def_id, name, type, position, value``: every definition of the note's folder, set or not."""
    grid = notes.select("note_id", "folder_id").join(defs, "folder_id")
    return grid.join(cells, ["note_id", "def_id"], "left").select("note_id", "def_id", "name", "type", "position", "value")


def pivoted(view: DataFrame, names: list[str]) -> DataFrame:
    return view.groupBy("note_id").pivot("name", names).agg(F.first("value", True))


def _number(c: Column) -> Column:
    """The number that a text begins with; none: null."""
    return F.regexp_extract(F.trim(c), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")


def property_filter(kind: str, op: str, value: object = None) -> Column | None:
    """Predicate on a cell ``value``, or None where the filter is not active. A number is what a text begins with; what has none passes no test of numbers."""
    v = F.col("value")
    filled = v.isNotNull() & (v != "")
    if op == "is_empty":
        return ~F.coalesce(filled, F.lit(False))
    if op == "is_not_empty":
        return F.coalesce(filled, F.lit(False))
    if op in ("is_true", "is_false"):
        yes = F.coalesce(v == "true", F.lit(False))
        return yes if op == "is_true" else ~yes
    values = list(value) if isinstance(value, (list, tuple)) else [value]
    if not op or all(x in (None, "") for x in values):
        return None
    if kind == "text":
        low = F.lower(v)
        test = low.contains(str(value).lower()) if op == "contains" else low == str(value).lower()
    elif kind == "number":
        typed = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", str(value))
        if not typed:
            return F.lit(False)
        n, x = _number(v), float(typed[0])
        test = {"=": n == x, "!=": n != x, ">": n > x, "<": n < x, ">=": n >= x, "<=": n <= x}[op]
    elif kind == "date":
        test = filled & {"on": lambda: v == values[0], "before": lambda: v < values[0], "after": lambda: v > values[0], "between": lambda: (v >= values[0]) & (v <= values[1])}[op]()
    else:
        inside = F.coalesce(v, F.lit("")).isin([x or "" for x in values])
        test = inside if op == "any_of" else ~inside
    return F.coalesce(test, F.lit(False))


def filtered_notes(view: DataFrame, filters: list[tuple[str, str, str, object]]) -> DataFrame:
    """``note_id`` of the notes that pass all active filters ``(name, kind, op, value)`` in one pass over the cells."""
    tests = []
    for name, kind, op, value in filters:
        test = property_filter(kind, op, value)
        if test is not None:
            tests.append(F.bool_and(F.when(F.col("name") == name, test).otherwise(True)))
    if not tests:
        return view.select("note_id").distinct()
    return view.groupBy("note_id").agg(reduce(Column.__and__, tests).alias("_ok")).where("_ok").select("note_id")


def board(view: DataFrame, name: str, options: list[str], unknown: bool = False) -> DataFrame:
    """``column, place, n, note_ids``: blank values first, then the options in order, empty ones too.

    ``unknown`` lists values that are no option as well and puts the blank column last.
    """
    key = F.when(F.trim(F.coalesce("value", F.lit(""))) == "", UNSET).otherwise(F.col("value"))
    groups = view.where(F.col("name") == name).groupBy(key.alias("column")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("note_id")).alias("note_ids"))
    order = [*options, UNSET] if unknown else [UNSET, *options]
    known = view.sparkSession.createDataFrame([(c, i) for i, c in enumerate(order)], "column string, place int")
    joined = known.join(groups, "column", "full_outer" if unknown else "left")
    last = F.coalesce(F.col("place"), F.lit(len(order)))
    return joined.select("column", last.alias("place"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("note_ids", F.array().cast("array<long>")).alias("note_ids"))


def board_counts(view: DataFrame, name: str, cap: int = 50) -> DataFrame:
    """``value, n, more``: cards of each value, and those beyond the ones shown."""
    return view.where((F.col("name") == name) & F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n")).withColumn("more", F.greatest(F.col("n") - cap, F.lit(0)))


def definitions(defs: DataFrame) -> DataFrame:
    """Definitions by folder, in order."""
    return defs.orderBy("folder_id", "position", "def_id")


def folder_ids(notes: DataFrame) -> DataFrame:
    """The folders that notes are in, none among them."""
    return notes.select("folder_id").distinct()


def moved(defs: DataFrame, def_id: int, to: int) -> DataFrame:
    """Definitions of a folder after one moves to a position; those between shift by one."""
    at = defs.where(F.col("def_id") == def_id).select("folder_id", F.col("position").alias("_at"))
    p = F.col("position")
    new = F.when(F.col("def_id") == def_id, to).when((p > F.col("_at")) & (p <= to), p - 1).when((p < F.col("_at")) & (p >= to), p + 1).otherwise(p)
    return defs.join(F.broadcast(at), "folder_id").select("def_id", "folder_id", "name", new.cast("int").alias("position"))


def seeded_cells(notes: DataFrame, defs: DataFrame, cells: DataFrame) -> DataFrame:
    """The empty cells that a template adds: of its folder's notes, for definitions they lack."""
    grid = notes.select("note_id", "folder_id").join(defs.select("def_id", "folder_id"), "folder_id").select("note_id", "def_id")
    return grid.join(cells, ["note_id", "def_id"], "left_anti").withColumn("value", F.lit(""))


def next_position(defs: DataFrame) -> DataFrame:
    return defs.groupBy("folder_id").agg((F.max("position") + 1).alias("next_position"))


def properties_suffix(view: DataFrame) -> DataFrame:
    """``note_id, suffix``: the filled cells as ``Properties: name=value, …`` in order."""
    parts = F.array_sort(F.collect_list(F.struct("position", "def_id", F.concat_ws("=", "name", "value").alias("part"))))
    return view.where("trim(value) != ''").groupBy("note_id").agg(F.concat(F.lit("\nProperties: "), F.array_join(F.transform(parts, lambda p: p["part"]), ", ")).alias("suffix"))


# --- calendar -------------------------------------------------------------------------------------


def heatmap(notes: DataFrame, as_of: int, days: int = 365) -> DataFrame:
    """``date, created, modified``: notes by UTC day; changes on the day of creation are no changes."""
    since = as_of - days * 86_400
    made, changed = tx.utc_day(F.col("created_at")), tx.utc_day(F.col("updated_at"))
    flags = F.array(F.struct(made.alias("date"), F.lit(1).alias("c"), F.lit(0).alias("m"), (F.col("created_at") >= since).alias("ok")), F.struct(changed.alias("date"), F.lit(0).alias("c"), F.lit(1).alias("m"), ((F.col("updated_at") >= since) & (changed != made)).alias("ok")))
    return notes.select(F.inline(flags)).where("ok").groupBy("date").agg(F.sum("c").alias("created"), F.sum("m").alias("modified"))


def heat_grid(activity: DataFrame, today: str, weeks: int = 53) -> DataFrame:
    """``date, week, weekday, total, level``: Monday-first weeks that end with this one; days to come are null."""
    spark = activity.sparkSession
    end = F.date_add(F.date_trunc("week", F.lit(today).cast("date")).cast("date"), 6)
    grid = spark.range(weeks * 7).select((F.col("id") / 7).cast("int").alias("week"), (F.col("id") % 7).cast("int").alias("weekday"), F.date_add(end, (F.col("id") - weeks * 7 + 1).cast("int")).alias("date"))
    joined = grid.join(activity.select("date", (F.col("created") + F.col("modified")).alias("t")), "date", "left")
    total = F.when(F.col("date") <= F.lit(today).cast("date"), F.coalesce("t", F.lit(0)))
    sized = joined.select("date", "week", "weekday", total.alias("total"))
    most = sized.agg(F.greatest(F.max("total"), F.lit(1)).alias("most"))
    return sized.join(F.broadcast(most)).select("date", "week", "weekday", "total", F.when(F.col("total").isNotNull(), tx.heat_level(F.col("total"), F.col("most"))).alias("level"))


def notes_of_day(notes: DataFrame, day: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return notes.where((tx.utc_day(F.col("created_at")) == d) | (tx.utc_day(F.col("updated_at")) == d))


def free_title(notes: DataFrame, title: str) -> str:
    """The title, or the first of `` (2)``, `` (3)`` … that is free."""
    taken = {r.title for r in notes.where((F.col("title") == title) | F.col("title").rlike("^" + "".join(f"\\x{{{ord(c):x}}}" for c in title) + r" \(\d+\)$")).select("title").distinct().collect()}
    return next(t for n in range(1, len(taken) + 2) if (t := title if n == 1 else f"{title} ({n})") not in taken)


def first_matches(notes: DataFrame, day: str, columns: tuple[str, ...] = ("created_at", "updated_at")) -> DataFrame:
    """``note_id, first_at``: notes of which one of the stamps is of a day, each once, with the first such stamp."""
    stamps = F.filter(F.array(*columns), lambda t: tx.utc_day(t) == F.lit(day).cast("date"))
    return notes.select("note_id", F.array_min(stamps).alias("first_at")).where("first_at IS NOT NULL")


def daily_note_asked(asked: DataFrame, daily: DataFrame, key: str, form: str = "DMY") -> DataFrame:
    """``key, iso, note_id``: the first date in each question of ``asked(key, query)`` that has a daily note of ``daily(note_id, title)``; without one the first date."""
    notes = daily.select("note_id", tx.title_to_iso(F.col("title"), form).alias("iso"))
    found = asked.select(key, F.posexplode(UDFS["dates_in_text"](F.col("query"), form)).alias("pos", "iso")).join(notes, "iso", "left")
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("note_id").isNull(), "pos", "note_id"))
    return found.withColumn("_p", place).where("_p = 1").select(key, "iso", "note_id")


# --- audit ----------------------------------------------------------------------------------------


def actions_of(group: str | None) -> list[str]:
    """Actions of a group; an unknown group: all."""
    return ACTION_GROUPS.get(group or "", [a for g in ACTION_GROUPS.values() for a in g])


def visible_log(log: DataFrame, notes: DataFrame, blocked: DataFrame) -> DataFrame:
    """Without the rows of existing notes in blocked folders; those of deleted notes stay."""
    hidden = notes.join(blocked, "folder_id", "left_semi").select(F.col("note_id").alias("resource_id"), F.lit("note").alias("_kind"))
    return log.withColumn("_kind", F.lower("resource_type")).join(hidden, ["resource_id", "_kind"], "left_anti").drop("_kind")


def searched_log(log: DataFrame, actions: list[str] | None = None, search: str | None = None) -> DataFrame:
    """Rows of the actions whose name or detail holds the text; ``%`` and ``_`` in it are wildcards."""
    rows = log.where(F.col("action").isin(actions)) if actions else log
    needle = (search or "").strip()
    return rows.where(F.col("resource_name").ilike(f"%{needle}%") | F.col("detail").ilike(f"%{needle}%")) if needle else rows


def log_page(log: DataFrame, page: int = 1, size: int = 25) -> DataFrame:
    size = min(100, max(1, size))
    return log.orderBy(F.desc("created_at"), F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def expired(log: DataFrame, days: int, as_of: int) -> DataFrame:
    """Rows older than so many days; none for 0 days."""
    if days < 0:
        raise ValueError("days must not be negative")
    return log.where(F.col("created_at") < as_of - days * 86_400) if days else log.limit(0)


def pruned(log: DataFrame, days: int, as_of: int) -> DataFrame:
    if days < 0:
        raise ValueError("days must not be negative")
    return log.where(F.col("created_at") >= as_of - days * 86_400) if days else log


def action_counts(log: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """``action, n`` of the rows of some actions."""
    return (log.where(F.col("action").isin(actions)) if actions else log).groupBy("action").agg(F.count("*").alias("n"))


def export_counts(log: DataFrame, notes: DataFrame, blocked: DataFrame) -> DataFrame:
    """``exported, skipped_locked``: rows that an export writes, and those it keeps back."""
    shown = visible_log(log, notes, blocked).agg(F.count("*").alias("exported"))
    return log.agg(F.count("*").alias("n")).join(F.broadcast(shown)).select("exported", (F.col("n") - F.col("exported")).alias("skipped_locked"))


def rates(rows: DataFrame, stamp: str, by: str) -> DataFrame:
    """``by, n, per_s``: rows, and rows in a second between the first and the last; null for one moment."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {stamp})")
    span = (F.max("_us") - F.min("_us")) / 1e6
    return rows.withColumn("_us", micros).groupBy(by).agg(F.count("*").alias("n"), (F.count("*") / F.nullif(span, F.lit(0.0))).alias("per_s"))


# --- versions and changes -------------------------------------------------------------------------


def newest(versions: DataFrame, key: list[str], order: list[Column], keep: int = KEEP_VERSIONS) -> DataFrame:
    return versions.withColumn("_p", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("_p") <= keep).drop("_p")


def prunable(versions: DataFrame, key: str, order: list[Column], keep: int = KEEP_VERSIONS) -> DataFrame:
    """``key, pruned``: how many versions beyond the newest ``keep`` each has."""
    return versions.withColumn("_p", F.row_number().over(W.partitionBy(key).orderBy(*order))).groupBy(key).agg(F.count_if(F.col("_p") > keep).alias("pruned"))


def median_by_length(notes: DataFrame, column: str = "content") -> DataFrame:
    """``median_chars, most``: the length in the middle (the lower of two) and the longest."""
    return notes.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY length({column}))").cast("long").alias("median_chars"), F.max(F.length(column)).cast("long").alias("most"))


def list_difference(a: DataFrame, b: DataFrame, place: str = "pos") -> DataFrame:
    """``place, a, b``: where two ordered lists ``(place, id)`` differ; none: the same ids in the same order."""
    one, two = a.select(place, F.col("id").alias("a")), b.select(place, F.col("id").alias("b"))
    return one.join(two, place, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def same_list(a: DataFrame, b: DataFrame, place: str = "pos") -> bool:
    return list_difference(a, b, place).isEmpty()


def stale(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there any more."""
    return rows.join(there.select(key), key, "left_anti")


def missing_counts(rows: DataFrame, there: DataFrame, key: str, by: str | None = None) -> DataFrame:
    """``[by,] missing, files``: rows without a counterpart, and all."""
    flagged = rows.join(there.select(key).distinct().withColumn("_there", F.lit(True)), key, "left")
    grouped = flagged.groupBy(by) if by else flagged.groupBy()
    return grouped.agg(F.count_if(F.col("_there").isNull()).alias("missing"), F.count("*").alias("files"))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are in both."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def pinned_first(pinned: DataFrame, found: DataFrame, key: str = "title") -> DataFrame:
    """The pinned rows and the found ones whose title is not among them."""
    return pinned.unionByName(found.select(pinned.columns).join(pinned.select(key), key, "left_anti").select(pinned.columns))


def version_list(versions: DataFrame) -> DataFrame:
    """Versions with titles of up to 60 characters and the first line's first 80."""
    return versions.select("note_id", "version_id", tx.excerpt(F.col("title"), 60).alias("title"), tx.preview(F.col("content"), 80).alias("preview"))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with the same key, the others as they were."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def inserted_or_ignored(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(key), key, "left_anti").select(old.columns))


def without_keys(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(key), key, "left_anti").select(old.columns)


def without_prefix(old: DataFrame, column: str, prefix: str) -> DataFrame:
    return old.where(~F.col(column).startswith(prefix))
