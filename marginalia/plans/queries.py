"""The retrieval engine's operators as queries over the benchmark tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions import vectors as vx
from marginalia.functions.documents import UDFS
from marginalia.operators import articles as ar
from marginalia.operators import knowledge as kn
from marginalia.operators import lexical as lx
from marginalia.operators import notes as ns
from marginalia.operators import search as se
from marginalia.operators.storage import spread
from marginalia.operators.vault import one_line_base64

from . import domain as d
from .domain import EPOCH, NOW, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Texts that the search queries look for.
WORDS, PHRASE = "the erb", "the"


# --- scans, filters, projections ------------------------------------------------------------------


@query(with_("notes", "folders") + "SELECT note_id, title, n.folder_id, coalesce(f.locked, false) AS locked FROM notes n LEFT JOIN folders f ON f.id = n.folder_id WHERE note_id = 7")
def src1_point_lookup(s, p):
    return ns.by_id(d.notes(s, p), d.folders(s, p), 7).select("note_id", "title", "folder_id", "locked")


@query(with_("notes") + "SELECT note_id, title, updated_at FROM notes ORDER BY updated_at DESC, note_id")
def src2_ordered_scan(s, p):
    return ns.listed(d.notes(s, p)).select("note_id", "title", "updated_at")


@query(with_("notes") + "SELECT note_id, title FROM notes WHERE folder_id IS NULL")
def src3_unfiled_notes(s, p):
    return ns.in_folder(d.notes(s, p), None).select("note_id", "title")


@query()
def src6_html_structured(s, p):
    return d.spread_table(s, p, "pages").select("page_id", UDFS["html_structured"](F.col("html")).alias("content"))


@query()
def src7_html_flat(s, p):
    return d.spread_table(s, p, "pages").select("page_id", UDFS["html_title"](F.col("html")).alias("title"), UDFS["html_flat"](F.col("html")).alias("content"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) AS ext, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'txt' THEN 'text/plain' WHEN 'log' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'pdf' THEN 'application/pdf' WHEN 'csv' THEN 'text/csv' WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'odt' THEN 'application/vnd.oasis.opendocument.text' ELSE 'application/octet-stream' END AS mime FROM pages")
def src11_mime_map(s, p):
    from marginalia.sources.files import extension, mime_type

    return d.table(s, p, "pages").select("page_id", extension(F.col("url")).alias("ext"), mime_type(F.col("url")).alias("mime"))


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '/fr/') AND NOT regexp_matches(url, '#top$')")
def src13_glob_excludes(s, p):
    from marginalia.sources.files import excluded

    return d.table(s, p, "pages").where(~excluded(F.col("url"), ["fr/", "# a comment", "**/*#top"])).select("page_id", "url")


@query("SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS uri FROM pages")
def src16_data_uri(s, p):
    return d.table(s, p, "pages").select("page_id", F.concat(F.lit("data:text/html;base64,"), one_line_base64(F.col("html").cast("binary"))).alias("uri"))


@query("SELECT vec_id, label FROM embeddings WHERE label = 3")
def src19_vector_scan(s, p):
    return se.scanned(d.table(s, p, "embeddings"), F.col("label") == 3, ["vec_id", "label"])


@query(with_("notes", "folders", "blocked") + "SELECT note_id, folder_id FROM notes WHERE folder_id IS NULL OR folder_id NOT IN (SELECT folder_id FROM blocked)")
def flt1_access_filter(s, p):
    return kn.accessible(d.notes(s, p), kn.blocked_folders(d.folders(s, p))).select("note_id", "folder_id")


@query(with_("notes", "folders", "blocked") + "SELECT note_id, CASE WHEN b.folder_id IS NOT NULL THEN '' ELSE title END AS title, CASE WHEN b.folder_id IS NOT NULL THEN '' ELSE content END AS content, n.folder_id, b.folder_id IS NOT NULL AS locked FROM notes n LEFT JOIN blocked b ON b.folder_id = n.folder_id")
def flt2_column_masking(s, p):
    return kn.masked(d.notes(s, p), kn.blocked_folders(d.folders(s, p)))


@query(with_("folders") + "SELECT id, CASE WHEN locked THEN '<locked>' ELSE name END AS name FROM folders")
def flt3_folder_name_masking(s, p):
    return ns.masked_folders(d.folders(s, p)).select("id", "name")


FILTERS = [("status", "select", "any_of", ["O", "P"]), ("total", "number", ">", 100_000), ("date", "date", "between", ["1995-01-01", "1997-12-31"]), ("priority", "text", "contains", "urgent"), ("priority", "text", "equals", "")]


@query(with_("defs", "order_notes", "cells", "view") + """SELECT note_id FROM view GROUP BY note_id HAVING
  bool_and(name <> 'status' OR coalesce(value, '') IN ('O', 'P')) AND bool_and(name <> 'total' OR coalesce(try_cast(value AS DOUBLE) > 100000, false))
  AND bool_and(name <> 'date' OR coalesce(value BETWEEN '1995-01-01' AND '1997-12-31', false)) AND bool_and(name <> 'priority' OR coalesce(lower(value) LIKE '%urgent%', false))""")
def flt4_property_filters(s, p):
    return kn.filtered_notes(kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p)), FILTERS)


def _filter_query(name, kind, op, value, test):
    @query(with_("defs", "order_notes", "cells", "view") + f"SELECT note_id FROM view WHERE name = '{name}' AND coalesce({test}, false)")
    def f(s, p):
        view = kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))
        return view.where((F.col("name") == name) & kn.property_filter(kind, op, value)).select("note_id")

    key = f"flt4_{kind}_{op}".replace("!=", "ne").replace(">=", "ge").replace("<=", "le").replace("<", "lt").replace(">", "gt").replace("=", "eq")
    QUERIES[key], SQL[key] = QUERIES.pop("f"), SQL.pop("f")


for _args in (
    ("priority", "text", "contains", "high", "lower(value) LIKE '%high%'"), ("priority", "text", "equals", "2-HIGH", "lower(value) = '2-high'"),
    ("priority", "text", "is_empty", None, "value IS NULL OR value = ''"), ("priority", "text", "is_not_empty", None, "value <> ''"),
    *[("total", "number", op, 150_000, f"try_cast(value AS DOUBLE) {'<>' if op == '!=' else op} 150000") for op in ("=", "!=", ">", "<", ">=", "<=")],
    ("date", "date", "on", "1996-01-02", "value = '1996-01-02'"), ("date", "date", "before", "1994-06-01", "value < '1994-06-01'"), ("date", "date", "after", "1997-06-01", "value > '1997-06-01'"),
    ("priority", "boolean", "is_true", None, "value = 'true'"), ("priority", "boolean", "is_false", None, "value IS NULL OR value <> 'true'"),
    ("priority", "select", "any_of", ["1-URGENT", ""], "coalesce(value, '') IN ('1-URGENT', '')"), ("priority", "select", "none_of", ["1-URGENT", "5-LOW"], "coalesce(value, '') NOT IN ('1-URGENT', '5-LOW')"),
):
    _filter_query(*_args)


@query(with_("log") + "SELECT id, action, resource_name FROM log WHERE action IN ('note_open', 'note_create', 'note_update', 'note_delete', 'note_export') AND (resource_name ILIKE '%user-1%' OR detail ILIKE '%user-1%')")
def flt6_action_and_substring(s, p):
    return kn.searched_log(d.audit_log(s, p), kn.actions_of("notes"), " user-1 ").select("id", "action", "resource_name")


@query("SELECT page_id, replace(replace(replace(replace(url, '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '''', '''''') AS escaped FROM pages")
def flt8_like_escape(s, p):
    return d.table(s, p, "pages").select("page_id", tx.like_escape(F.col("url")).alias("escaped"))


@query("SELECT page_id, replace(html, '''', '''''') AS quoted FROM pages")
def flt9_quote_escape(s, p):
    return d.table(s, p, "pages").select("page_id", tx.sql_quote(F.col("html")).alias("quoted"))


_NEAR_SPREAD = """, kept AS (SELECT query_id, chunk_id, distance, min(distance) OVER (PARTITION BY query_id) AS best FROM ranked WHERE rank <= 40)
SELECT query_id, chunk_id, round(distance, 6) AS distance FROM kept WHERE best <= 2.0 AND distance <= best * 1.3"""


def _near(s, p, k=100):
    return se.knn_join(d.chunks(s, p), d.vector_queries(s, p), k, exclude_self="chunk_id")


@query(with_("near") + _NEAR_SPREAD)
def flt10_ceiling_and_spread(s, p):
    from pyspark.sql import Window as W

    best = F.min("distance").over(W.partitionBy("query_id"))
    return _near(s, p, 40).withColumn("best", best).where("best <= 2.0 AND distance <= best * 1.3").select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query()
def flt11_article_filters(s, p):
    from marginalia.operators.articles import articles

    return articles(d.table(s, p, "pages")).select("page_id", "path", "title", F.length("content").alias("chars"))


@query("SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> ''")
def flt12_blank_chunks(s, p):
    return ar.not_blank(d.table(s, p, "conversations")).select("conv_id", "turn", "text")


@query("SELECT page_id, url FROM pages p WHERE EXISTS (SELECT 1 FROM (VALUES ('https://'), ('http://tionsh.example.net/')) v(path) WHERE starts_with(p.url, v.path))")
def flt13_enabled_paths(s, p):
    from marginalia.sources.files import under_enabled

    return under_enabled(d.table(s, p, "pages"), "url", ["https:", "http://tionsh.example.net"]).select("page_id", "url")


@query(with_("notes") + f"SELECT note_id, updated_at FROM notes WHERE updated_at <> {EPOCH} + note_id * 3600")
def flt15_changed_since(s, p):
    from marginalia.sources.files import changed

    state = d.notes(s, p).select("note_id", F.col("created_at").alias("mtime"))
    now = d.notes(s, p).select("note_id", F.col("updated_at").alias("mtime"))
    return changed(now, state, "note_id").select("note_id", F.col("mtime").alias("updated_at"))


@query(with_("notes") + "SELECT note_id, title FROM notes WHERE to_timestamp(created_at)::TIMESTAMP::DATE = DATE '2024-01-03' OR to_timestamp(updated_at)::TIMESTAMP::DATE = DATE '2024-01-03'".replace("to_timestamp(created_at)::TIMESTAMP::DATE", "(DATE '1970-01-01' + (created_at // 86400)::INT)").replace("to_timestamp(updated_at)::TIMESTAMP::DATE", "(DATE '1970-01-01' + (updated_at // 86400)::INT)"))
def flt16_notes_of_day(s, p):
    return kn.notes_of_day(d.notes(s, p), "2024-01-03").select("note_id", "title")


@query(with_("notes", "folders", "blocked") + "SELECT note_id, title FROM notes WHERE lower(title) LIKE '%c-1%' AND (folder_id IS NULL OR folder_id NOT IN (SELECT folder_id FROM blocked)) ORDER BY updated_at DESC, note_id LIMIT 20")
def flt17_quick_switcher(s, p):
    rows = kn.accessible(d.notes(s, p), kn.blocked_folders(d.folders(s, p))).where(F.lower("title").contains("c-1"))
    return rows.orderBy(F.desc("updated_at"), "note_id").limit(20).select("note_id", "title")


@query(with_("marked", "tags") + "SELECT tag, count(*) AS n FROM tags WHERE tag LIKE '%src1%' GROUP BY tag")
def flt18_sidebar_tags(s, p):
    return kn.filtered_tags(kn.tag_counts(kn.note_tags(d.notes(s, p, True))), " #SRC1 ")


@query(with_("notes") + "SELECT title FROM notes WHERE starts_with(lower(title), 'doc-12') ORDER BY title LIMIT 10")
def flt19_autocomplete(s, p):
    from marginalia.operators.articles import suggestions

    return suggestions(d.notes(s, p).select("title"), "DOC-12").select("title")


@query(with_("log") + f"SELECT count(*) AS n FROM log WHERE created_at < {EPOCH + 30 * 86400} - 10 * 86400")
def flt20_retention_preview(s, p):
    return kn.expired(d.audit_log(s, p), 10, EPOCH + 30 * 86_400).agg(F.count("*").alias("n"))


@query(with_("folders") + "SELECT id, coalesce(name, '') AS name FROM folders ORDER BY CASE WHEN parent_id = 2 THEN 0 ELSE 1 END, coalesce(name, ''), id")
def prj1_conditional_sort(s, p):
    return ns.folders_near(d.folders(s, p), 2).select("id", "name")


@query("""SELECT doc_id AS note_id, CASE WHEN length(line) > 80 THEN substr(line, 1, 80) || '…' ELSE line END AS preview FROM (
  SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM documents)""")
def prj2_previews(s, p):
    return d.notes(s, p).select("note_id", tx.preview(F.col("content"), 80).alias("preview"))


@query(with_("defs", "order_notes", "cells", "view") + "SELECT note_id, chr(10) || 'Properties: ' || string_agg(name || '=' || value, ', ' ORDER BY position, def_id) AS suffix FROM view WHERE trim(value) <> '' GROUP BY note_id")
def prj3_properties_suffix(s, p):
    return kn.properties_suffix(kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p)))


@query("SELECT conv_id, turn, CASE WHEN length(trim(text)) > 80 THEN substr(trim(text), 1, 80) || '…' ELSE trim(text) END AS shown FROM conversations")
def prj4_display_title(s, p):
    return d.table(s, p, "conversations").select("conv_id", "turn", tx.batch_title(F.col("text")).alias("shown"))


# --- joins ----------------------------------------------------------------------------------------


@query(with_("marked", "tags") + "SELECT m.note_id, title FROM marked m JOIN tags t USING (note_id) WHERE tag = 'fr'")
def jn2_notes_by_tag(s, p):
    n = d.notes(s, p, True)
    return kn.notes_by_tag(n, kn.note_tags(n), "#FR").select("note_id", "title")


@query(with_("marked", "links") + "SELECT source_id, target_id FROM links")
def jn7_note_links(s, p):
    return kn.note_links(d.notes(s, p, True))


@query(with_("marked", "links") + "SELECT m.note_id, m.title FROM links l JOIN marked m ON m.note_id = l.source_id WHERE l.target_id = 70 ORDER BY title, note_id")
def jn4_backlinks(s, p):
    n = d.notes(s, p, True)
    return kn.backlinks(n, kn.note_links(n), 70)


@query(with_("marked", "links") + "SELECT m.note_id, m.title FROM links l JOIN marked m ON m.note_id = l.target_id WHERE l.source_id = 11 ORDER BY title, note_id")
def jn4_outgoing_links(s, p):
    n = d.notes(s, p, True)
    return kn.outgoing(n, kn.note_links(n), 11)


@query(with_("notes", "folders", "blocked", "marked", "links") + ", ok AS (SELECT note_id FROM notes WHERE folder_id IS NULL OR folder_id NOT IN (SELECT folder_id FROM blocked)) SELECT source_id, target_id FROM links WHERE source_id IN (SELECT note_id FROM ok) AND target_id IN (SELECT note_id FROM ok)")
def jn5_graph_edges(s, p):
    n = d.notes(s, p, True)
    return kn.graph_edges(kn.note_links(n), kn.accessible(n, kn.blocked_folders(d.folders(s, p))).select("note_id"))


_MENTION = "SELECT note_id, title FROM marked WHERE note_id <> 70 AND contains(replace(content, '[[the]]', ''), 'the') AND note_id NOT IN (SELECT source_id FROM links WHERE target_id = 70)"


@query(with_("marked", "links") + _MENTION)
def jn6_unlinked_mentions(s, p):
    n = d.notes(s, p, True)
    return kn.unlinked_mentions(n, kn.note_links(n), 70, "the")


@query(with_("defs", "order_notes", "cells", "view") + "SELECT note_id, def_id, name, type, position, value FROM view")
def jn8_table_view(s, p):
    return kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))


@query(with_("defs", "cells") + "SELECT c.note_id, d.name, c.value FROM cells c JOIN defs d USING (def_id) WHERE c.value IS NOT NULL")
def jn9_note_properties(s, p):
    return ns.named_values(d.property_cells(s, p), d.property_defs(s))


@query(with_("defs", "order_notes") + "SELECT note_id, def_id FROM order_notes n JOIN defs d ON d.folder_id = n.folder_id WHERE d.name = 'status'")
def jn10_settable_cells(s, p):
    return ns.settable(d.order_notes(s, p), d.property_defs(s), "status")


@query(with_("notes", "folders") + "SELECT note_id, f.name AS folder FROM notes n LEFT JOIN folders f ON f.id = n.folder_id WHERE f.locked IS NULL OR NOT f.locked")
def jn11_unlocked_left_join(s, p):
    return ns.with_folder(d.notes(s, p), d.folders(s, p)).where("NOT locked").select("note_id", "folder")


@query(with_("notes", "folders", "blocked", "log") + "SELECT id, action FROM log l WHERE NOT (lower(resource_type) = 'note' AND EXISTS (SELECT 1 FROM notes n JOIN blocked b USING (folder_id) WHERE n.note_id = l.resource_id))")
def jn12_visible_audit_log(s, p):
    return kn.visible_log(d.audit_log(s, p), d.notes(s, p), kn.blocked_folders(d.folders(s, p))).select("id", "action")


@query(with_("defs", "order_notes", "cells") + "SELECT n.note_id, d.def_id, '' AS value FROM order_notes n JOIN defs d USING (folder_id) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.note_id = n.note_id AND c.def_id = d.def_id AND c.value IS NOT NULL)")
def jn13_seeded_cells(s, p):
    return kn.seeded_cells(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))


@query(with_("notes", "log") + ", marks AS (SELECT resource_id AS note_id, min(created_at) AS added_at FROM log WHERE action = 'note_create' GROUP BY resource_id) SELECT m.note_id, n.title, m.added_at FROM marks m JOIN notes n USING (note_id) ORDER BY added_at, note_id")
def jn14_bookmarks(s, p):
    marks = d.audit_log(s, p).where("action = 'note_create'").groupBy(F.col("resource_id").alias("note_id")).agg(F.min("created_at").alias("added_at"))
    return ns.bookmarks(marks, d.notes(s, p))


@query(with_("folders", "tree") + "SELECT ancestor, id, depth FROM tree")
def jn15_folder_closure(s, p):
    return kn.closure(d.folders(s, p)).select("ancestor", "id", F.col("depth").cast("int").alias("depth"))


@query(with_("near", "notes") + "SELECT query_id, chunk_id, n.title FROM ranked r JOIN notes n USING (note_id) WHERE rank <= 10")
def jn16_title_refresh(s, p):
    return _near(s, p, 10).drop("title").join(d.notes(s, p).select("note_id", "title"), "note_id").select("query_id", "chunk_id", "title")


@query("SELECT vec_id AS pos, vec_id AS a, CASE WHEN vec_id % 100 = 0 THEN vec_id + 1 ELSE vec_id END AS b FROM embeddings WHERE vec_id % 100 = 0")
def jn19_queue_difference(s, p):
    queue = d.table(s, p, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").alias("id"))
    return kn.list_difference(queue, queue.withColumn("id", F.when(F.col("pos") % 100 == 0, F.col("id") + 1).otherwise(F.col("id"))))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn20_stale_rows(s, p):
    return kn.stale(d.table(s, p, "documents").select("doc_id"), d.table(s, p, "labels"), "doc_id")


@query(with_("notes") + ", wanted AS (SELECT DISTINCT 'doc-' || (conv_id * 3) AS title FROM conversations) SELECT w.title, n.note_id IS NOT NULL AS found, n.note_id AS id FROM wanted w LEFT JOIN notes n USING (title)")
def jn21_resolve_embeds(s, p):
    wanted = d.table(s, p, "conversations").selectExpr("'doc-' || (conv_id * 3) AS title").distinct()
    return wanted.join(kn.first_by_title(d.notes(s, p)), "title", "left").select("title", F.col("target_id").isNotNull().alias("found"), F.col("target_id").alias("id"))


@query(with_("near") + "SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 20")
def jn23_knn_join(s, p):
    return _near(s, p, 20).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


# --- aggregates, windows, sets --------------------------------------------------------------------


@query(with_("marked", "tags") + "SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY tag")
def ag1_tag_counts(s, p):
    return kn.tag_counts(kn.note_tags(d.notes(s, p, True)))


_DAY = "(DATE '1970-01-01' + ({} // 86400)::INT)"
_HEAT = f"""heat AS (SELECT date, sum(c)::BIGINT AS created, sum(m)::BIGINT AS modified FROM (
  SELECT {_DAY.format('created_at')} AS date, 1 AS c, 0 AS m FROM notes WHERE created_at >= {NOW} - 365 * 86400
  UNION ALL SELECT {_DAY.format('updated_at')}, 0, 1 FROM notes WHERE updated_at >= {NOW} - 365 * 86400 AND {_DAY.format('updated_at')} <> {_DAY.format('created_at')}) GROUP BY date)"""


@query(with_("notes") + f", {_HEAT} SELECT date, created, modified FROM heat")
def ag2_activity_heatmap(s, p):
    return kn.heatmap(d.notes(s, p), NOW)


@query(with_("log") + "SELECT action, count(*) AS n FROM log WHERE action IN ('note_open', 'page_error') GROUP BY action")
def ag4_filtered_count(s, p):
    return kn.action_counts(d.audit_log(s, p), ["note_open", "page_error"])


@query(with_("defs") + "SELECT folder_id, max(position) + 1 AS next_position FROM defs GROUP BY folder_id")
def ag5_next_position(s, p):
    return kn.next_position(d.property_defs(s))


@query(with_("near") + "SELECT query_id, note_id, round(min(distance), 6) AS distance FROM ranked WHERE rank <= 100 GROUP BY query_id, note_id")
def ag6_best_distance_by_source(s, p):
    return se.best_by_source(_near(s, p), ["query_id", "note_id"]).withColumn("distance", F.round("distance", 6))


@query(with_("defs", "order_notes", "cells", "view") + """, opts AS (SELECT unnest(['__unset__', '1-URGENT', '2-HIGH', '3-MEDIUM', '9-NONE']) AS col, unnest(range(5)) AS place),
  g AS (SELECT CASE WHEN trim(coalesce(value, '')) = '' THEN '__unset__' ELSE value END AS col, count(*) AS n, list_sort(list(note_id)) AS ids FROM view WHERE name = 'priority' GROUP BY 1)
  SELECT o.col AS "column", o.place::INT AS place, coalesce(g.n, 0)::BIGINT AS n, coalesce(g.ids, []::BIGINT[]) AS note_ids FROM opts o LEFT JOIN g USING (col)""")
def ag10_kanban_board(s, p):
    view = kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))
    return kn.board(view, "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "9-NONE"])


@query(with_("notes", "folders", "blocked", "log") + ", f AS (SELECT lower(resource_type) = 'note' AND resource_id IN (SELECT note_id FROM notes JOIN blocked USING (folder_id)) AS hidden FROM log) SELECT count(*) FILTER (WHERE NOT hidden) AS exported, count(*) FILTER (WHERE hidden) AS skipped_locked FROM f")
def ag12_export_counts(s, p):
    return kn.export_counts(d.audit_log(s, p), d.notes(s, p), kn.blocked_folders(d.folders(s, p)))


@query("SELECT l.quality, count(*) FILTER (WHERE d.doc_id IS NULL) AS missing FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = 'en' GROUP BY l.quality")
def ag13_missing_count(s, p):
    return kn.missing_counts(d.table(s, p, "labels"), d.table(s, p, "documents").where("lang = 'en'"), "doc_id", "quality").drop("files")


@query(with_("notes") + "SELECT DISTINCT folder_id FROM notes")
def ag15_distinct_folders(s, p):
    return kn.folder_ids(d.notes(s, p))


@query("SELECT quantile_disc(length(text), 0.5) AS median_chars, max(length(text)) AS most FROM documents")
def ag16_median_length(s, p):
    return kn.median_by_length(d.notes(s, p))


_TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


@query(f"WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents), c AS (SELECT term, doc_id, count(*) AS n FROM t GROUP BY term, doc_id) SELECT term, sum(n)::BIGINT AS tf, count(*) AS df FROM c GROUP BY term")
def ag18_term_statistics(s, p):
    return lx.term_stats(d.text_index(s, p).postings().where("col = 1"), one_column=True)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def ag19_context_blocks(s, p):
    return ar.turns_text(d.table(s, p, "conversations"))


_VERSIONS = "SELECT note_id, l_shipdate, l_linenumber, l_partkey, l_suppkey FROM (SELECT l_orderkey AS note_id, l_shipdate, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3"


@query(_VERSIONS)
def wn3_newest_versions(s, p):
    return kn.newest(d.versions(s, p), ["note_id"], [F.desc("l_shipdate"), F.desc("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], keep=3)


@query(with_("notes") + ", t AS (SELECT 'doc-' || (note_id % 100) AS title, note_id, updated_at FROM notes) SELECT title, note_id AS target_id FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY updated_at DESC, note_id) AS r FROM t) WHERE r = 1")
def wn4_first_by_title(s, p):
    return kn.first_by_title(d.notes(s, p).withColumn("title", F.concat(F.lit("doc-"), F.col("note_id") % 100)))


@query(with_("defs") + "SELECT def_id, folder_id, name, (CASE WHEN def_id = 21 THEN 2 WHEN folder_id = 2 AND position BETWEEN 1 AND 2 THEN position - 1 ELSE position END)::INT AS position FROM defs WHERE folder_id = 2")
def wn6_reorder(s, p):
    return kn.moved(d.property_defs(s), 21, 2)


_CHUNK_SQL = """WITH b AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN [''] WHEN len(l) <= 3 THEN [array_to_string(l, ' ')] ELSE list_transform(range(0, (ceil((len(l) - 3) / 2.0) * 2 + 1)::BIGINT, 2), lambda i: array_to_string(l[i + 1:i + 3], ' ')) END AS chunks FROM b"""


@query(_CHUNK_SQL)
def wn8_chunk_windows(s, p):
    parts = F.filter(F.transform(F.split("text", "[.]"), lambda x: F.trim(x)), lambda x: x != "")
    return d.table(s, p, "conversations").select("conv_id", "turn", tx.chunks(parts, 3, 1).alias("chunks"))


@query("""WITH r AS (SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: {'done': []::VARCHAR[], 'open': x}),
  lambda a, x: CASE WHEN octet_length(encode(a.open)) + 1 + octet_length(encode(x.open)) <= 400 THEN {'done': a.done, 'open': a.open || chr(10) || x.open} ELSE {'done': list_append(a.done, a.open), 'open': x.open} END) AS r FROM documents),
b AS (SELECT doc_id, list_append(r.done, r.open) AS l FROM r) SELECT doc_id, unnest(range(len(l)))::INT AS block, unnest(l) AS content FROM b""")
def wn9_row_blocks(s, p):
    return d.table(s, p, "documents").select("doc_id", F.posexplode(tx.row_blocks(F.split("text", "\n"), 400)).alias("block", "content"))


@query(with_("log") + "SELECT id, action, created_at FROM log ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50")
def sr2_audit_page(s, p):
    return kn.log_page(d.audit_log(s, p), page=3).select("id", "action", "created_at")


@query(with_("defs") + "SELECT def_id, folder_id, name FROM defs ORDER BY folder_id, position, def_id")
def sr3_multi_key_sort(s, p):
    return kn.definitions(d.property_defs(s)).select("def_id", "folder_id", "name")


@query(with_("notes") + "SELECT note_id, title, row_number() OVER (ORDER BY lower(title), note_id)::INT AS by_name, row_number() OVER (ORDER BY created_at DESC, note_id)::INT AS by_created, row_number() OVER (ORDER BY updated_at DESC, note_id)::INT AS by_modified FROM notes")
def sr4_note_list_sort(s, p):
    out = d.notes(s, p).select("note_id", "title")
    for sort in ("name", "created", "modified"):
        placed = ns.places(ns.listed(d.notes(s, p), sort), "note_id", f"by_{sort}")
        out = out.join(placed.withColumn(f"by_{sort}", F.col(f"by_{sort}").cast("int")), "note_id")
    return out


@query("SELECT vec_id AS chunk_id, round(d, 6) AS distance FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10")
def sr6_top_k(s, p):
    c = d.chunks(s, p)
    one = c.where("chunk_id = 3").select(F.col("vector").alias("target"))
    return se.knn(c.join(F.broadcast(one)), F.col("target"), 10).select("chunk_id", F.round("distance", 6).alias("distance"))


@query(with_("defs", "order_notes", "cells", "view") + "SELECT value, count(*) AS n, greatest(count(*) - 50, 0)::BIGINT AS more FROM view WHERE name = 'priority' AND value IS NOT NULL GROUP BY value")
def sr7_board_cap(s, p):
    view = kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))
    return kn.board_counts(view, "priority")


@query(with_("folders") + "SELECT id FROM folders WHERE locked EXCEPT SELECT unnest([0, 105])")
def st4_locked_minus_unlocked(s, p):
    return kn.blocked_folders(d.folders(s, p), [0, 105]).select(F.col("folder_id").alias("id"))


@query("SELECT DISTINCT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def st5_intersection(s, p):
    return kn.in_both(d.table(s, p, "documents"), d.table(s, p, "labels").where("toxic = 1"), "doc_id")


@query("SELECT r_name AS name, 'built-in' AS kind FROM region UNION ALL SELECT DISTINCT o_orderpriority, 'user' FROM orders")
def st3_template_union(s, p):
    return ns.all_templates(d.table(s, p, "region").selectExpr("r_name AS name"), d.table(s, p, "orders").selectExpr("o_orderpriority AS name"))


# --- scalar functions -----------------------------------------------------------------------------


@query(with_("marked", "tags") + "SELECT note_id, tag FROM tags")
def fn1_parse_tags(s, p):
    return kn.note_tags(d.notes(s, p, True))


@query(with_("marked") + "SELECT note_id, regexp_extract_all(content, '\\[\\[(.*?)\\]\\]', 1) AS links FROM marked")
def fn2_parse_wiki_links(s, p):
    return d.notes(s, p, True).select("note_id", tx.parse_wiki_links(F.col("content")).alias("links"))


@query("SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN substr(text, 1, strpos(text, 'the') - 1) || '[[the]]' || substr(text, strpos(text, 'the') + 3) ELSE text END AS content FROM documents")
def fn3_link_first_mention(s, p):
    return d.table(s, p, "documents").select("doc_id", UDFS["link_first_mention"](F.col("text"), F.lit("the")).alias("content"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS excerpt FROM documents")
def fn6_excerpts(s, p):
    return d.table(s, p, "documents").select("doc_id", tx.excerpt(F.col("text"), 200).alias("excerpt"))


@query("SELECT event_id, left(props, 12) AS detail FROM events")
def fn7_truncate(s, p):
    return d.table(s, p, "events").select("event_id", tx.truncated(F.col("props"), 12).alias("detail"))


#: White space and sentences of a text as tx.sentences has them: lines, the long ones cut after full stops.
_WS = r"[\x09-\x0D\x20]"
_SENTENCES = rf"""list_filter(list_transform(flatten(list_transform(list_filter(list_transform(string_split({{0}}, chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> ''),
  lambda x: CASE WHEN len(regexp_split_to_array(x, '{_WS}+')) > 30 THEN string_split(regexp_replace(x, '([.!?])[ \t](\p{{{{Lu}}}})', '\1' || chr(1) || '\2', 'g'), chr(1)) ELSE [x] END)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '')"""


@query(f"WITH s AS (SELECT doc_id, {_SENTENCES.format('text')} AS l FROM documents) SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS sentence FROM s")
def fn8_sentences(s, p):
    return d.spread_table(s, p, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('./A/' || url, '^(\\./)+', ''), '^(\\.\\./A/)+', ''), '^(\\.\\./)+', ''), '^(/wiki/)+', ''), '^(A/)+', '') AS path FROM pages")
def fn13_wiki_paths(s, p):
    return d.table(s, p, "pages").select("page_id", tx.wiki_path(F.concat(F.lit("./A/"), F.col("url"))).alias("path"))


@query()
def fn14_rewrite_hrefs(s, p):
    return d.spread_table(s, p, "pages").select("page_id", UDFS["rewrite_hrefs"](F.col("html")).alias("html"))


@query("SELECT page_id, unnest([url, 'A/' || url]) AS candidate FROM pages")
def fn15_path_candidates(s, p):
    return d.table(s, p, "pages").select("page_id", F.explode(tx.path_candidates(F.col("url"))).alias("candidate"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS dmy, strftime(o_orderdate, '%m-%d-%Y') AS mdy FROM orders")
def fn16_display_dates(s, p):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return d.table(s, p, "orders").select("o_orderkey", tx.display_date(iso).alias("dmy"), tx.display_date(iso, "MDY").alias("mdy"))


@query("SELECT o_orderkey, [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d')] AS dates FROM orders")
def fn17_dates_in_text(s, p):
    text = F.concat(F.lit("from "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" to "), F.expr("date_format(o_orderdate + INTERVAL 40 DAY, 'dd-MM-yyyy')"), F.lit("."))
    return d.table(s, p, "orders").select("o_orderkey", UDFS["dates_in_text"](text).alias("dates"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at_iso_utc FROM events")
def fn19_iso_utc(s, p):
    return d.audit_log(s, p).select(F.col("id").alias("event_id"), tx.iso_utc(F.col("created_at")).alias("created_at_iso_utc"))


@query(with_("notes") + f""", {_HEAT}, g AS (SELECT i // 7 AS week, i % 7 AS weekday, DATE '2024-06-16' - 370 + i::INT AS date FROM range(371) t(i)),
  t AS (SELECT g.*, CASE WHEN g.date <= DATE '2024-06-12' THEN coalesce(created + modified, 0) END AS total FROM g LEFT JOIN heat USING (date)), m AS (SELECT greatest(max(total), 1) AS most FROM t)
  SELECT date, week::INT AS week, weekday::INT AS weekday, total::BIGINT AS total, (CASE WHEN total IS NULL THEN NULL WHEN total <= 0 THEN 0 WHEN total / most <= 0.25 THEN 1 WHEN total / most <= 0.5 THEN 2 WHEN total / most <= 0.75 THEN 3 ELSE 4 END)::INT AS level FROM t CROSS JOIN m""")
def fn21_heat_grid(s, p):
    return kn.heat_grid(kn.heatmap(d.notes(s, p), NOW), "2024-06-12")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%d-%m') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS month_first FROM orders")
def fn22_title_to_iso(s, p):
    form = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("Trip")
    return d.table(s, p, "orders").select("o_orderkey", tx.title_to_iso(form).alias("iso"), tx.title_to_iso(form, "MDY").alias("month_first"))


_READABLE = r"regexp_extract_all(regexp_replace(regexp_replace(content, '([\p{L}\p{M}])[''’.·](\p{N})', '\1 \2', 'g'), '(\p{N})[''’.,;](\p{L})', '\1 \2', 'g'), '_*[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}_]|[''’.·][\p{L}]|[''’.,;]\p{N})*')"


#: Marks around a note's text, and what is seen of them.
_MARKED = ("# Head of ", "\n\n> - [x] *one* **two _three_** ~~four~~\n\n", "\n\n```py\ncode [[x]] **y**\n```\n\n====\nin `[[a|b]] *c*` [label](http://u.rl/(x)) ![[Page|shown here]] [[Other Page]] ![pic](p.png) <!-- hid\nden --> <span>seen</span> <style>p {}</style> [r][k]\n[k]: http://u.rl")
_SEEN = ("Head of ", " one two three four ", " code [[x]] **y** in [[a|b]] *c* label shown here Other Page pic seen r")


def _sql_text(parts, own=("source", "text")):
    quoted = ["'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in parts]
    return f"{quoted[0]} || {own[0]} || {quoted[1]} || {own[1]} || {quoted[2]}"


@query(f"WITH seen AS (SELECT doc_id AS note_id, trim(regexp_replace({_sql_text(_SEEN)}, '\\s+', ' ', 'g')) AS content FROM documents), w AS (SELECT note_id, content, len({_READABLE}) AS words FROM seen) SELECT note_id, content AS shown, words::INT AS words, CASE WHEN words <= 0 THEN 0 ELSE ceil(words / 200.0) END::BIGINT AS minutes FROM w")
def fn23_readable_text(s, p):
    text = F.concat(F.lit(_MARKED[0]), "source", F.lit(_MARKED[1]), "text", F.lit(_MARKED[2]))
    rows = d.spread_table(s, p, "documents").select(F.col("doc_id").alias("note_id"), UDFS["readable"](text).alias("shown"))
    return rows.withColumn("words", tx.readable_words(F.col("shown"))).withColumn("minutes", tx.reading_minutes(F.col("words")))


@query()
def fn24_line_diff(s, p):
    edited = F.concat(F.regexp_replace("text", r"\bof\b", "OF"), F.lit("\nend"))
    return d.spread_table(s, p, "documents").select("doc_id", UDFS["coalesced"](F.col("text"), edited).alias("hunks"))


@query(with_("marked") + "SELECT note_id, content AS lead, title FROM marked")
def fn25_embed_segments(s, p):
    text = F.concat(F.col("content"), F.lit("![["), F.col("title"), F.lit("]]"))
    parts = UDFS["embed_segments"](text)
    return d.notes(s, p, True).withColumn("parts", parts).select("note_id", F.expr("array_join(transform(filter(parts, x -> x.kind = 'text'), x -> x.value), '')").alias("lead"), F.expr("filter(parts, x -> x.kind = 'embed')[0].value").alias("title"))


@query(with_("folders") + "SELECT f.id, CASE WHEN f.parent_id IS NULL THEN f.name ELSE p.name || '/' || f.name END AS path FROM folders f LEFT JOIN folders p ON p.id = f.parent_id")
def fn27_folder_paths(s, p):
    return kn.folder_paths(d.folders(s, p))


@query("SELECT p_partkey, (p_size % 3 > p_size % 4) OR (p_size % 3 = p_size % 4 AND p_size % 7 > p_size % 5) AS newer FROM part")
def fn28_semver(s, p):
    part = d.table(s, p, "part")
    return part.select("p_partkey", UDFS["is_newer"](F.expr("'v' || p_size % 3 || '.' || p_size % 7 || '.0'"), F.expr("p_size % 4 || '.' || p_size % 5 || '.0'")).alias("newer"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def fn30_query_value(s, p):
    return d.table(s, p, "pages").select("page_id", tx.query_value(F.col("url")).alias("encoded"))


_ASKED = ["What have I written about ", "tell me what i know about ", "what are my thoughts on ", "Show me my notes on ", ""]


@query(r"""WITH u AS (SELECT conv_id, turn, [""" + ", ".join(f"'{a}'" for a in _ASKED) + r"""][(conv_id + turn) % 5 + 1] || text AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS raw FROM u WHERE r <= 2 GROUP BY conv_id),
c AS (SELECT conv_id, raw, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, 'what (have i|did i|do i have) (written?|noted?|said?) (about|on|regarding)\s*', '', 'gi'), 'tell me (about|what i (wrote|know|noted) about)\s*', '', 'gi'),
  'what (are|is) my (notes?|thoughts?) (on|about)\s*', '', 'gi'), 'show me (my notes? on|what i wrote about)\s*', '', 'gi')) AS clean FROM q)
SELECT conv_id, CASE WHEN clean = '' THEN raw ELSE clean END AS query FROM c""".replace("\\\\", "\\"))
def fn31_chat_query(s, p):
    from marginalia.operators.articles import chat_queries

    opening = F.element_at(F.array(*map(F.lit, _ASKED)), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return chat_queries(d.table(s, p, "conversations").withColumn("text", F.concat(opening, "text")))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3 * x * 3)), 6) AS sq, 1.0::DOUBLE AS unit FROM embeddings")
def fn33_normalise(s, p):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    n = F.transform(vx.normalised(v), lambda x: x)
    return d.table(s, p, "embeddings").select("vec_id", F.round(vx.norm(v) * vx.norm(v), 6).alias("sq"), F.round(vx.norm(n), 9).alias("unit"))


@query("SELECT doc_id, text AS plain, (ceil((octet_length(encode(text)) + 28) / 3.0) * 4)::BIGINT AS chars FROM documents")
def fn35_encryption_round_trip(s, p):
    from marginalia.operators.vault import decrypted, encrypted

    key = F.lit(b"0123456789abcdef0123456789abcdef")
    blob = d.table(s, p, "documents").withColumn("blob", encrypted(F.col("text"), key))
    return blob.select("doc_id", decrypted(F.col("blob"), key).alias("plain"), F.length("blob").cast("long").alias("chars"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['a', event_type] ELSE []::VARCHAR[] END AS options FROM events""")
def fn37_json_fields(s, p):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN to_json(array('a', event_type)) WHEN 1 THEN '[\"a\", ' END")
    return d.table(s, p, "events").select("event_id", tx.json_strings(text).alias("options"))


@query("SELECT doc_id FROM documents WHERE contains(text, ' of the ')")
def fn38_highlight_anchor(s, p):
    from marginalia.operators.articles import anchored

    return d.table(s, p, "documents").where(anchored(F.col("text"), F.lit(" of"), F.lit(" "), F.lit("the "))).select("doc_id")


@query()
def fn39_html_outline(s, p):
    return d.spread_table(s, p, "pages").select("page_id", F.posexplode(UDFS["html_outline"](F.col("html"))).alias("pos", "h")).select("page_id", "pos", "h.level", "h.text")


@query(with_("notes") + "SELECT 'doc-1 (2)' AS title")
def fn43_free_title(s, p):
    return s.createDataFrame([(kn.free_title(d.notes(s, p), "doc-1"),)], "title string")


@query("SELECT page_id, '<b>' || page_id || '</b>x' AS snippet FROM pages")
def fn44_sanitised_snippet(s, p):
    return d.table(s, p, "pages").select("page_id", tx.sanitised_snippet(F.concat(F.lit('<b class="q">'), F.col("page_id"), F.lit("</b><script src=x>x</script>"))).alias("snippet"))


# --- composite operators --------------------------------------------------------------------------


def _bm25_sql(prefixes: list[str], columns: str) -> str:
    n = range(len(prefixes))
    hits = ", ".join(f"len(list_filter(t, lambda x: starts_with(x, '{w}'))) AS f{i}" for i, w in enumerate(prefixes))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in n)
    term = " + ".join(f"greatest_idf(n, d{i}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / avgdl))" for i in n)
    for i in n:
        idf = f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
        term = term.replace(f"greatest_idf(n, d{i})", f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END)")
    return f"""tok AS (SELECT {columns}, list_concat({_TOKENS.format('title')}, {_TOKENS.format('content')}) AS t FROM notes),
cnt AS (SELECT *, len(t) AS len, {hits} FROM tok), st AS (SELECT count(*) AS n, avg(len) AS avgdl, {stats} FROM cnt),
scored AS (SELECT {columns}, -({term}) AS score FROM cnt CROSS JOIN st WHERE {' AND '.join(f'f{i} > 0' for i in n)})"""


_FTS = with_("notes", "folders", "blocked") + ", " + _bm25_sql(["the", "erb"], "note_id, title, folder_id")


@query(_FTS + ", best AS (SELECT * FROM scored ORDER BY score, note_id LIMIT 36) SELECT note_id, title, folder_id, round(score, 6) AS score FROM best WHERE folder_id IS NULL OR folder_id NOT IN (SELECT folder_id FROM blocked) ORDER BY best.score, note_id LIMIT 12")
def opr1_fts_search(s, p):
    found = lx.fts_search(d.text_index(s, p), d.notes(s, p), WORDS, kn.blocked_folders(d.folders(s, p)), snippets=False)
    return found.select("note_id", "title", "folder_id", F.round("score", 6).alias("score"))


@query()
def opr1_fts_snippets(s, p):
    return lx.fts_search(d.text_index(s, p), d.notes(s, p), WORDS, kn.blocked_folders(d.folders(s, p)), prefilter=True)


def _best(s, p, k):
    """The ``k`` best notes of the search with their titles."""
    found = d.text_index(s, p).search(WORDS).withColumnRenamed("id", "note_id").orderBy("score", "note_id").limit(k)
    return d.notes(s, p).select("note_id", "title").join(F.broadcast(found), "note_id")


@query(_FTS + " SELECT note_id, title, round(score, 6) AS score FROM scored ORDER BY scored.score, note_id LIMIT 40")
def opr2_wiki_fts_search(s, p):
    return _best(s, p, 40).select("note_id", "title", F.round("score", 6).alias("score"))


def _closer(near):
    """Distances as of vectors half as far apart and less for some queries, so that the ceiling keeps some and drops others."""
    return near.withColumn("distance", F.col("distance") * (0.3 + F.col("query_id") % 100 / 200))


def _sources_sql(fetch, keep, ceiling, spread):
    return with_("near") + f""", g AS (SELECT query_id, note_id, min(distance) * (0.3 + query_id % 100 / 200) AS distance, list_transform(list_sort(list({{'i': chunk_index, 'c': content}})), lambda x: x.c) AS excerpts, any_value(title) AS title FROM ranked WHERE rank <= {fetch} GROUP BY query_id, note_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, note_id) AS place, min(distance) OVER (PARTITION BY query_id) AS best FROM g)
SELECT query_id, note_id, title, excerpts, round(distance, 6) AS distance FROM r WHERE place <= {keep} AND best <= {ceiling} AND distance <= best * {spread}"""


@query(_sources_sql(100, 5, 0.9, 1.15))
def opr3_semantic_notes(s, p):
    return se.by_source(_closer(_near(s, p)), "note_id", **se.NOTES).withColumn("distance", F.round("distance", 6))


@query(_sources_sql(60, 3, 0.9, 1.15))
def opr5_semantic_files(s, p):
    return se.by_source(_closer(_near(s, p, 60)), "note_id", **se.FILES).withColumn("distance", F.round("distance", 6))


@query(with_("near") + ", k AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS best FROM ranked WHERE rank <= 40) SELECT query_id, chunk_id, title, round(distance, 6) AS distance FROM k WHERE best <= 1.2 AND distance <= best * 1.3")
def opr4_semantic_articles(s, p):
    near = _near(s, p, 40)
    return se.by_source(near, "chunk_id", **se.ARTICLES).select("query_id", "chunk_id", "title", F.round("distance", 6).alias("distance"))


@query(with_("near") + "SELECT query_id, chunk_id, title, content AS excerpt, round(distance, 6) AS distance FROM ranked WHERE rank <= 10")
def opr8_raw_search(s, p):
    return se.raw_search(_near(s, p, 10)).withColumn("distance", F.round("distance", 6))


_RANKED_LISTS = """, lex AS (SELECT note_id, title, row_number() OVER (ORDER BY score, note_id) AS rank FROM scored ORDER BY score, note_id LIMIT {k}),
sem AS (SELECT vec_id AS note_id, row_number() OVER (ORDER BY d, vec_id) AS rank, d FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM embeddings) ORDER BY d, vec_id LIMIT {k})"""


def _lists(s, p, k):
    lexical = _best(s, p, k).withColumn("rank", F.row_number().over(W.orderBy("score", "note_id")))
    c = d.chunks(s, p)
    one = c.where("chunk_id = 3").select(F.col("vector").alias("target"))
    semantic = se.knn(c.join(F.broadcast(one)), F.col("target"), k).withColumn("rank", F.row_number().over(W.orderBy("distance", "chunk_id")))
    return lexical, semantic.withColumn("note_id", F.col("chunk_id"))


@query(_FTS + _RANKED_LISTS.format(k=40) + """, j AS (SELECT coalesce(l.note_id, s.note_id) AS article_id, coalesce(l.title, 'vec-' || (s.note_id // 5)) AS title, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score, coalesce(s.d, 0) AS distance,
    CASE WHEN l.note_id IS NULL OR l.note_id % 2 = 0 THEN '' ELSE 'chunk ' || (l.note_id - l.note_id % 3) END AS snippet, CASE WHEN s.note_id IS NULL THEN []::VARCHAR[] ELSE ['chunk ' || s.note_id] END AS known FROM lex l FULL JOIN sem s ON s.note_id = l.note_id)
  SELECT article_id, title, CASE WHEN snippet = '' AND len(known) = 0 THEN [''] WHEN snippet = '' OR list_contains(known, snippet) THEN known ELSE [snippet] || known END AS excerpts, round(score, 9) AS score, round(distance, 6) AS distance FROM j ORDER BY j.score DESC, article_id LIMIT 5""")
def opr6_hybrid_articles(s, p):
    lexical, semantic = _lists(s, p, 40)
    snippet = F.when(F.col("note_id") % 2 == 0, "").otherwise(F.concat(F.lit("chunk "), F.col("note_id") - F.col("note_id") % 3))
    a = lexical.select(F.col("note_id").alias("article_id"), "title", snippet.alias("snippet"), "rank")
    b = semantic.select(F.col("note_id").alias("article_id"), "title", F.array("content").alias("excerpts"), "distance", "rank")
    return se.hybrid_articles(a, b).withColumns({"score": F.round("score", 9), "distance": F.round("distance", 6)})


@query(_FTS + _RANKED_LISTS.format(k=12) + """, u AS (SELECT note_id, 1.0 / (60 + rank) AS c, 'fts' AS l FROM lex UNION ALL SELECT note_id, 1.0 / (60 + rank), 'semantic' FROM sem)
  SELECT note_id, round(sum(c), 9) AS score, CASE WHEN count(*) = 2 THEN 'both' ELSE min(l) END AS matched_by FROM u GROUP BY note_id ORDER BY sum(c) DESC, note_id LIMIT 12""")
def opr7_hybrid_notes(s, p):
    lexical, semantic = _lists(s, p, 12)
    return se.fused([("fts", lexical), ("semantic", semantic)], "note_id", 12).withColumn("score", F.round("score", 9))


@query(with_("notes") + f", s AS (SELECT note_id, title, {_SENTENCES.format('content')} AS l FROM notes) SELECT note_id, unnest(range(len(l)))::INT AS chunk_index, title, unnest(l) AS content, 'search_document: ' || title || chr(10) || unnest(l) AS text FROM s")
def opr9_note_chunks(s, p):
    from marginalia.operators.ingest import note_chunks

    return note_chunks(spread(d.notes(s, p)))


@query()
def opr12_index_articles(s, p):
    from marginalia.operators.articles import article_chunks, articles
    from marginalia.operators.ingest import embedded

    rows = article_chunks(articles(d.spread_table(s, p, "pages")))
    return embedded(rows, "text").select("path", "chunk_index", "title", F.size("vector").alias("dims"))


@query(with_("marked", "links") + "SELECT note_id, title, (SELECT count(*) FROM links l WHERE l.source_id = m.note_id) AS degree_out FROM marked m")
def opr15_graph_nodes(s, p):
    n = d.notes(s, p, True)
    degree = kn.note_links(n).groupBy(F.col("source_id").alias("note_id")).agg(F.count("*").alias("degree_out"))
    return n.select("note_id", "title").join(degree, "note_id", "left").fillna({"degree_out": 0})


@query(with_("folders", "tree") + "SELECT id, depth FROM tree WHERE ancestor = 1")
def opr17_subtree(s, p):
    return kn.subtree(d.folders(s, p), 1).select("id", F.col("depth").cast("int").alias("depth"))


@query(with_("defs", "order_notes", "cells", "view") + "SELECT note_id, max(value) FILTER (WHERE name = 'status') AS status, max(value) FILTER (WHERE name = 'priority') AS priority, max(value) FILTER (WHERE name = 'total') AS total, max(value) FILTER (WHERE name = 'date') AS date FROM view GROUP BY note_id")
def opr18_notes_with_properties(s, p):
    view = kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))
    return kn.pivoted(view, ["status", "priority", "total", "date"])


@query(with_("log") + f"SELECT count(*) AS kept, min(created_at) AS oldest FROM log WHERE created_at >= {EPOCH + 30 * 86400} - 10 * 86400")
def opr23_audit_prune(s, p):
    return kn.pruned(d.audit_log(s, p), 10, EPOCH + 30 * 86_400).agg(F.count("*").alias("kept"), F.min("created_at").alias("oldest"))


@query(with_("notes") + "SELECT note_id, title || ' (copy)' AS title, folder_id FROM notes WHERE note_id % 10 = 0 UNION ALL SELECT note_id, title, folder_id FROM notes WHERE note_id % 10 <> 0")
def opr25_change_set(s, p):
    n = d.notes(s, p).select("note_id", "title", "folder_id")
    new = n.where("note_id % 10 = 0").withColumn("title", F.concat("title", F.lit(" (copy)")))
    return kn.upserted(n, new, ["note_id"])


@query("SELECT p.page_id, q.url AS path FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages) p JOIN (SELECT DISTINCT url FROM pages) q ON q.url = p.u")
def opr28_link_resolution(s, p):
    from marginalia.operators.articles import resolved_links

    pages = d.table(s, p, "pages").select(F.lit("b1").alias("bundle_id"), F.col("url").alias("path"), F.lit("t").alias("title"), "page_id")
    wanted = d.table(s, p, "pages").select("page_id", F.concat(F.lit("A/"), F.col("url")).alias("wanted"))
    return resolved_links(wanted, "page_id", pages.drop("page_id")).select("page_id", "path")


_EVAL = with_("near") + ", cases AS (SELECT q.vec_id AS query_id, e.vec_id AS item FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.label = q.label AND e.vec_id <> q.vec_id), f AS (SELECT query_id, min(rank) AS rank FROM ranked JOIN cases c USING (query_id) WHERE rank <= 5 AND chunk_id = item GROUP BY query_id), a AS (SELECT DISTINCT query_id FROM cases) "


def _cases(s, p):
    e = d.table(s, p, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return q.join(e.select(F.col("vec_id").alias("item"), "label"), "label").where("item != query_id").select("query_id", "item")


@query(_EVAL + "SELECT count(*) AS total_cases, round(avg((f.rank IS NOT NULL)::INT), 9) AS recall_at_k, round(avg(coalesce(1.0 / f.rank, 0)), 9) AS mrr_at_k, count(f.rank) AS hits_at_k FROM a LEFT JOIN f USING (query_id)")
def opr30_evaluation(s, p):
    summary, _ = se.evaluation(_near(s, p, 5).withColumnRenamed("chunk_id", "item"), _cases(s, p))
    return summary.withColumns({c: F.round(c, 9) for c in ("recall_at_k", "mrr_at_k")})


@query(_EVAL + "SELECT query_id, f.rank IS NOT NULL AS hit, round(coalesce(1.0 / f.rank, 0), 9) AS reciprocal_rank FROM a LEFT JOIN f USING (query_id)")
def wn5_reciprocal_ranks(s, p):
    _, each = se.evaluation(_near(s, p, 5).withColumnRenamed("chunk_id", "item"), _cases(s, p))
    return each.select("query_id", "hit", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


@query()
def opr37_synthetic_vault(s, p):
    from marginalia.operators.vault import synthesised

    # a note in place of each document
    docs = d.table(s, p, "documents")
    return synthesised(docs.select(F.col("doc_id").alias("id")), 500, 12, seed=42)


@query(with_("notes", "folders") + "SELECT n.note_id, CASE WHEN f.id IS NULL THEN n.title || '.md' ELSE CASE WHEN p.id IS NULL THEN f.name ELSE p.name || '/' || f.name END || '/' || n.title || '.md' END AS path FROM notes n LEFT JOIN folders f ON f.id = n.folder_id LEFT JOIN folders p ON p.id = f.parent_id")
def opr38_export_paths(s, p):
    return kn.export_paths(d.notes(s, p), d.folders(s, p))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 3 = 0")
def snk1_keyed_upsert(s, p):
    o = d.table(s, p, "orders").select("o_orderkey", "o_orderstatus")
    return kn.upserted(o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'https://')")
def snk3_delete_by_prefix(s, p):
    return kn.without_prefix(d.table(s, p, "pages"), "url", "https://").select("page_id", "url")


@query("SELECT DISTINCT c_mktsegment AS name FROM customer UNION SELECT 'NEW'")
def snk13_insert_or_ignore(s, p):
    old = d.table(s, p, "customer").selectExpr("c_mktsegment AS name").distinct()
    return kn.inserted_or_ignored(old, s.createDataFrame([("NEW",), ("BUILDING",), ("NEW",)], "name string"), ["name"])
