"""Further operators of the retrieval engine as queries: sources, sinks, sets, settings, and the smaller composites."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.functions import vectors as vx
from marginalia.functions.documents import UDFS
from marginalia.operators import articles as ar
from marginalia.operators import chat as ch
from marginalia.operators import ingest as ing
from marginalia.operators import knowledge as kn
from marginalia.operators import lexical as lx
from marginalia.operators import notes as ns
from marginalia.operators import search as se
from marginalia.operators import vault
from marginalia.operators.storage import KeyedTable, new_path, persisted, spread
from marginalia.sources import files as fi
from marginalia.streaming.ingest import known_actions

from . import domain as d
from .domain import NOW, with_
from .queries import _DAY, _FTS, _HEAT, _SENTENCES, _lists, _near, query


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def src4_charset_detection(s, p):
    docs = d.table(s, p, "documents").where("text <> ''")
    data = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
    return docs.select("doc_id", UDFS["decode_text"](data).alias("text"))


@query("SELECT p_partkey, p_name || ' a,b' || chr(9) || p_brand || chr(10) || p_type || chr(9) || p_size AS content FROM part")
def src5_csv_rows(s, p):
    raw = F.concat(F.lit('"'), F.col("p_name"), F.lit('\na,b" , '), F.col("p_brand"), F.lit("\n\n"), F.col("p_type"), F.lit(","), F.col("p_size"))
    return d.table(s, p, "part").select("p_partkey", UDFS["csv_text"](raw).alias("content"))


@query("SELECT page_id // 16 AS \"window\", page_id, url FROM pages WHERE NOT (octet_length(encode(html)) < 800 AND contains(lower(html), 'http-equiv') AND contains(lower(html), 'refresh'))")
def src14_archive_window(s, p):
    return ar.scan_windows(d.table(s, p, "pages"), 16).select("window", "page_id", "url")


@query("SELECT 'A/' || url AS wanted, url AS path, octet_length(encode(arg_min(html, page_id)))::INT AS bytes FROM pages GROUP BY url")
def src15_single_article(s, p):
    pages = d.table(s, p, "pages")
    first = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    return ar.read_articles(first.select(F.concat(F.lit("A/"), "url").alias("wanted")), first).select("wanted", "path", F.octet_length("html").alias("bytes"))


@query("SELECT item_id::VARCHAR AS id, text AS body FROM benchmark")
def src20_json_cases(s, p):
    files = d.table(s, p, "benchmark").select(F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("body"))).alias("cases"))).alias("json"))
    return files.select(F.explode(fi.cases(F.col("json"))).alias("c")).select("c.id", "c.body")


@query("SELECT vec_id, CASE WHEN vec_id IN (1, 2, 3) THEN -1 ELSE label END AS label, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0.5 AS kept FROM embeddings WHERE vec_id <> 4")
def snk2_vector_bulk_upsert(s, p):
    table = KeyedTable(s, new_path(s, "vectors"), ["vec_id"])
    old = d.table(s, p, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    ing.store_vectors(table, old, 0, 64)
    ing.store_vectors(table, old.where("vec_id IN (1, 2, 3)").withColumn("label", F.lit(-1).cast(old.schema["label"].dataType)), 1, 64, s.createDataFrame([(k,) for k in (1, 2, 3, 4)], "vec_id long"))
    return table.read().select("vec_id", "label", (vx.norm(F.transform("vector", lambda x: x.cast("double"))) > 0.5).alias("kept"))


_TOK = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


@query(f"WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id = 3 THEN 'fresh words' ELSE text END AS c FROM documents WHERE doc_id <> 4), t AS (SELECT id, unnest({_TOK.format('c')}) AS term FROM r) SELECT id, count(*) AS n FROM t GROUP BY id")
def snk5_fts_upsert(s, p):
    n = d.notes(s, p)
    index = lx.indexed(s, n, ("content",))
    kept = index.refresh(n.where("note_id = 3").withColumn("content", F.lit("fresh words")), n.where("note_id = 4"))
    return kept.postings().groupBy("id").agg(F.sum("tf").alias("n"))


@query(with_("notes", "folders") + f", ok AS (SELECT n.* FROM notes n LEFT JOIN folders f ON f.id = n.folder_id WHERE f.locked IS NULL OR NOT f.locked) SELECT count(*) AS rows, sum(len({_TOK.format('content')}))::BIGINT AS tokens FROM ok")
def snk7_initial_fts_sync(s, p):
    rows = kn.accessible(d.notes(s, p), kn.blocked_folders(d.folders(s, p)))
    return lx.indexed(s, rows, ("content",)).rows().agg(F.count("*").alias("rows"), F.sum("len").alias("tokens"))


@query("SELECT c_custkey AS key, CASE WHEN c_custkey <= 10 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def snk12_settings_upsert(s, p):
    old = d.table(s, p, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    new = old.where("key <= 10").withColumn("value", F.lit("new"))
    return kn.upserted(old, kn.newest(new.unionByName(new), ["key"], [F.col("value")], 1), ["key"])


@query(with_("log") + """SELECT id, action IN ('note_open', 'note_create', 'note_update', 'note_delete', 'note_export', 'folder_create', 'folder_rename', 'folder_delete', 'search_fts', 'search_semantic',
  'search_combined', 'llm_chat', 'llm_improve', 'file_scan', 'file_import', 'wikipedia_read') AS known FROM log""")
def snk14_audit_append_domain(s, p):
    known, other = known_actions(d.audit_log(s, p))
    return known.select("id", F.lit(True).alias("known")).unionByName(other.select("id", F.lit(False).alias("known")))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL AS bad FROM events")
def snk15_salvaged_rows(s, p):
    number = F.get_json_object("props", "$.k").try_cast("bigint")
    good, bad = fi.salvaged(d.table(s, p, "events"), {"no number": number.isNotNull()})
    return good.select("event_id", F.lit(False).alias("bad")).unionByName(bad.select("event_id", F.lit(True).alias("bad")))


@query("SELECT note_id FROM (SELECT o_orderkey AS note_id FROM orders)")
def flt5_blank_filters(s, p):
    view = kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))
    return kn.filtered_notes(view, [("priority", "text", "contains", ""), ("status", "select", "any_of", ["", None])])


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%1_%' OR p_type ILIKE '%1_%'")
def flt7_substring_wildcards(s, p):
    log = d.table(s, p, "part").select("p_partkey", F.col("p_name").alias("resource_name"), F.col("p_type").alias("detail"), F.lit("a").alias("action"))
    return kn.searched_log(log, None, "1_").select("p_partkey")


@query("SELECT page_id FROM pages WHERE url = 'https://blog.tionble.example.com/en' OR starts_with(url, 'https://blog.tionble.example.com/en/') OR starts_with('https://blog.tionble.example.com/en', url || '/')")
def flt14_path_overlap(s, p):
    return d.table(s, p, "pages").where(fi.overlaps(F.col("url"), F.lit("https://blog.tionble.example.com/en"))).select("page_id")


@query(_FTS + ", h AS (SELECT note_id, score FROM scored ORDER BY score, note_id LIMIT 40) SELECT h.note_id, n.folder_id FROM h JOIN notes n USING (note_id)")
def jn1_hits_with_notes(s, p):
    hits = d.text_index(s, p).search("the erb").withColumnRenamed("id", "note_id").orderBy("score", "note_id").limit(40)
    return d.notes(s, p).join(F.broadcast(hits), "note_id").select("note_id", "folder_id")


@query(with_("marked", "tags") + "SELECT tag, count(DISTINCT note_id) AS notes FROM tags GROUP BY tag HAVING count(*) > 10")
def jn3_tags_with_notes(s, p):
    return kn.note_tags(d.notes(s, p, True)).groupBy("tag").agg(F.count_distinct("note_id").alias("notes")).where("notes > 10")


def _place(rows):
    return rows.select("doc_id", (F.col("doc_id") % 40 + 1).alias("rank"))


@query("SELECT doc_id, CASE WHEN d.doc_id IS NOT NULL THEN doc_id % 40 + 1 END AS rank_a, CASE WHEN l.doc_id IS NOT NULL THEN doc_id % 40 + 1 END AS rank_b, round(((d.doc_id IS NOT NULL)::INT + (l.doc_id IS NOT NULL)::INT) * 1.0 / (61 + doc_id % 40), 12) AS score FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def jn17_full_outer(s, p):
    return se.merged_lists(_place(d.table(s, p, "documents")), _place(d.table(s, p, "labels").select("doc_id").distinct()), "doc_id").withColumn("score", F.round("score", 12))


@query(with_("notes") + ", x AS (SELECT note_id, title FROM notes WHERE folder_id = 1), y AS (SELECT note_id, title FROM notes WHERE folder_id IN (1, 2)) SELECT note_id, title FROM x UNION ALL SELECT note_id, title FROM y WHERE title NOT IN (SELECT title FROM x)")
def jn22_pinned_and_matches(s, p):
    n = d.notes(s, p).select("note_id", "title", "folder_id")
    return kn.pinned_first(n.where("folder_id = 1").drop("folder_id"), n.where("folder_id IN (1, 2)"))


@query(with_("notes") + f"SELECT {_DAY.format('updated_at')} AS date, count(*) AS modified FROM notes WHERE updated_at >= {NOW} - 365 * 86400 AND {_DAY.format('updated_at')} <> {_DAY.format('created_at')} GROUP BY 1")
def ag3_modified_by_day(s, p):
    return kn.heatmap(d.notes(s, p), NOW).where("modified > 0").select("date", "modified")


@query(with_("near") + "SELECT query_id, note_id, list_sort(list(DISTINCT chunk_index)) AS chunks FROM ranked WHERE rank <= 100 GROUP BY query_id, note_id")
def ag7_chunks_by_source(s, p):
    return se.chunks_by_source(_near(s, p), ["query_id", "note_id"])


@query(with_("near") + "SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ranked WHERE rank <= 20 GROUP BY chunk_id")
def ag8_rrf_sums(s, p):
    return se.rrf_sums(_near(s, p, 20), "chunk_id").withColumn("score", F.round("score", 9))


@query(with_("notes") + f", {_HEAT} SELECT max(created + modified)::BIGINT AS most FROM heat")
def ag11_heat_maximum(s, p):
    return kn.heatmap(d.notes(s, p), NOW).agg(F.max(F.col("created") + F.col("modified")).alias("most"))


@query(with_("defs", "order_notes", "cells") + "SELECT count(*) AS seeded FROM order_notes n JOIN defs d USING (folder_id) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.note_id = n.note_id AND c.def_id = d.def_id)")
def ag14_seeded_pairs(s, p):
    return kn.seeded_cells(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p)).agg(F.count("*").alias("seeded"))


@query("SELECT event_type, count(*) AS n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) AS per_s FROM events GROUP BY event_type")
def ag17_throughput(s, p):
    return kn.rates(d.table(s, p, "events"), "ts", "event_type").withColumn("per_s", F.round("per_s", 9))


@query(with_("near") + "SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 15")
def wn1_rank_positions(s, p):
    return se.ranked(_near(s, p, 15).drop("rank"), ["query_id"], ["distance", "chunk_id"]).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(with_("near") + ", g AS (SELECT query_id, note_id, min(distance) AS d FROM ranked WHERE rank <= 100 GROUP BY ALL) SELECT query_id, note_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, note_id) AS r FROM g) WHERE r <= 5")
def wn2_top_sources(s, p):
    return se.top_sources(_near(s, p), "query_id", "note_id").select("query_id", "note_id")


@query(with_("near") + "SELECT q.vec_id AS query_id, coalesce(bool_or(e.label = q.label), false) AS gold_in_top3 FROM embeddings q LEFT JOIN ranked r ON r.query_id = q.vec_id AND r.rank <= 3 LEFT JOIN embeddings e ON e.vec_id = r.chunk_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id")
def wn7_gold_in_top3(s, p):
    e = d.table(s, p, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    gold = asked.join(e.select(F.col("vec_id").alias("chunk_id"), "label"), "label")
    return se.gold_in_top(_near(s, p, 3), gold).withColumnRenamed("found", "gold_in_top3")


@query(with_("notes") + f", ids AS (SELECT note_id, created_at AS stamp FROM notes WHERE {_DAY.format('created_at')} = DATE '2024-01-02' UNION ALL SELECT note_id, updated_at FROM notes WHERE {_DAY.format('updated_at')} = DATE '2024-01-02') SELECT note_id, min(stamp) AS first_at FROM ids GROUP BY note_id")
def st2_union_of_matches(s, p):
    return kn.first_matches(d.notes(s, p), "2024-01-02")


@query("SELECT l_orderkey AS note_id, count(*) - least(count(*), 3) AS pruned FROM lineitem GROUP BY l_orderkey")
def st6_versions_to_prune(s, p):
    return kn.prunable(d.versions(s, p), "note_id", [F.desc("l_shipdate"), F.desc("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3)


@query("SELECT label, count(*) AS differ FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7, vec_id) AS j FROM embeddings) WHERE i <> j GROUP BY label")
def st7_ordered_equality(s, p):
    e = d.table(s, p, "embeddings").select("vec_id", "label")
    # the same ids in two orders, in lists by label
    listed = lambda *order: se.ranked(e, ["label"], [*order], "place").select(F.struct("label", "place").alias("pos"), F.col("vec_id").alias("id"))
    return kn.list_difference(listed("vec_id"), listed(F.col("vec_id") % 7, "vec_id")).groupBy("pos.label").agg(F.count("*").alias("differ"))


@query("""SELECT page_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(url || ' "' || page_id || '" ', '\\s+'), lambda x: replace(x, '"', '')), lambda x: x <> ''), lambda x: '"' || x || '"*'), ' ') AS expression FROM pages""")
def fn4_match_expression(s, p):
    typed = F.concat("url", F.lit(' "'), "page_id", F.lit('" '))
    return d.table(s, p, "pages").select("page_id", tx.match_expression(typed).alias("expression"))


@query()
def fn5_snippets(s, p):
    return d.spread_table(s, p, "documents").select("doc_id", UDFS["best_snippet"](F.col("text"), ["the", "der"]).alias("snippet"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def fn12_flattened_chunks(s, p):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return d.table(s, p, "conversations").groupBy("conv_id").agg(tx.flattened(parts).alias("content"))


@query("SELECT o_orderkey, CASE WHEN t <= 0 THEN 0 WHEN t / 50.0 <= 0.25 THEN 1 WHEN t / 50.0 <= 0.5 THEN 2 WHEN t / 50.0 <= 0.75 THEN 3 ELSE 4 END::INT AS level FROM (SELECT o_orderkey, o_orderkey % 51 AS t FROM orders)")
def fn20_heat_levels(s, p):
    return d.table(s, p, "orders").select("o_orderkey", tx.heat_level(F.col("o_orderkey") % 51, F.lit(50)).alias("level"))


@query(with_("folders", "tree") + "SELECT f.id, list_sort(list(t.id) FILTER (WHERE t.id <> f.id)) AS below FROM folders f JOIN tree t ON t.ancestor = f.id GROUP BY f.id")
def fn26_folder_tree(s, p):
    below = F.sort_array(F.collect_list(F.when(F.col("id") != F.col("ancestor"), F.col("id"))))
    return kn.closure(d.folders(s, p)).groupBy(F.col("ancestor").alias("root")).agg(F.when(F.size(below) > 0, below).alias("below")).select(F.col("root").alias("id"), "below")


@query("SELECT p_partkey, p_brand = 'Brand#1' OR split_part(p_brand, ':', 1) = 'Brand#1' AS matches FROM part")
def fn29_model_match(s, p):
    return d.table(s, p, "part").select("p_partkey", tx.model_matches(F.col("p_brand"), F.lit("Brand#1")).alias("matches"))


@query("SELECT vec_id, rank, round(1.0 / (60 + rank), 12)::DOUBLE AS score FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings)")
def fn32_rrf_scores(s, p):
    listed = se.ranked(d.table(s, p, "embeddings").select("vec_id", "label"), ["label"], ["vec_id"])
    return listed.select("vec_id", F.col("rank").cast("long").alias("rank"), F.round(1.0 / (se.RRF_K + F.col("rank")), 12).alias("score"))


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 9)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d FROM embeddings")
def fn34_squared_distance(s, p):
    e = d.table(s, p, "embeddings")
    one = e.where("vec_id = 9").select(F.col("embedding").alias("t"))
    return e.join(F.broadcast(one)).select("vec_id", F.round(vx.squared_l2(F.col("embedding"), F.col("t")), 6).alias("d"))


@query(with_("notes", "folders", "tree") + f", s AS (SELECT note_id, {_SENTENCES.format('content')} AS l FROM notes WHERE folder_id IN (SELECT id FROM tree WHERE ancestor = 1)) SELECT note_id, unnest(range(len(l)))::INT AS chunk_index, unnest(l) AS content FROM s")
def opr11_unlock_reindex(s, p):
    below = kn.subtree(d.folders(s, p), 1).select(F.col("id").alias("folder_id"))
    return ing.note_chunks(d.notes(s, p).join(below, "folder_id", "left_semi")).select("note_id", "chunk_index", "content")


@query(with_("marked", "tags") + "SELECT note_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY note_id")
def opr14_note_tags(s, p):
    return kn.note_tags(d.notes(s, p, True)).groupBy("note_id").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("tags"))


_NAMED = {1: "of", 2: "the", 3: "la", 4: "the the", 5: "of the", 6: "attion to"}


@query(r"WITH w AS (SELECT doc_id AS note_id, ' ' || array_to_string(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_-]+'), ' ') || ' ' AS words FROM documents), t AS (SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{t}')" for k, t in _NAMED.items()) + ") t(target, title)) SELECT note_id, target AS mentions_id FROM w JOIN t ON contains(words, ' ' || title || ' ') AND note_id <> target")
def opr16_all_mentions(s, p):
    title = F.element_at(F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair]), F.col("note_id").cast("int"))
    named = spread(d.notes(s, p)).withColumn("title", F.coalesce(title, "title"))
    return kn.all_unlinked_mentions(named, s.createDataFrame([], "source_id long, target_id long"))


@query(with_("defs", "order_notes", "cells", "view") + "SELECT value AS \"column\", list_sort(list(note_id)) AS note_ids FROM view WHERE name = 'status' GROUP BY value")
def opr19_kanban_cards(s, p):
    view = kn.table_view(d.order_notes(s, p), d.property_defs(s), d.property_cells(s, p))
    return kn.board(view, "status", ["O", "F", "P"]).where("n > 0").select("column", "note_ids")


@query(with_("defs", "order_notes", "cells") + "SELECT note_id, def_id, value FROM cells WHERE value IS NOT NULL UNION ALL SELECT n.note_id, d.def_id, '' FROM order_notes n JOIN defs d USING (folder_id) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.note_id = n.note_id AND c.def_id = d.def_id)")
def opr20_template_sync(s, p):
    cells = d.property_cells(s, p)
    return cells.unionByName(kn.seeded_cells(d.order_notes(s, p), d.property_defs(s), cells))


@query(with_("notes") + ", q AS (SELECT conv_id, DATE '2024-01-01' + (conv_id % 30)::INT AS day FROM conversations WHERE turn = 0), t AS (SELECT note_id, DATE '2024-01-01' + note_id::INT AS day FROM notes) SELECT conv_id, strftime(q.day, '%Y-%m-%d') AS iso, t.note_id FROM q LEFT JOIN t USING (day)")
def opr22_daily_note_of_query(s, p):
    daily = d.notes(s, p).select("note_id", F.expr("date_format(date_add(DATE'2024-01-01', CAST(note_id AS INT)), 'dd-MM-yyyy')").alias("title"))
    asked = d.table(s, p, "conversations").where("turn = 0").select("conv_id", F.concat(F.lit("what about "), F.expr("date_format(date_add(DATE'2024-01-01', CAST(conv_id % 30 AS INT)), 'dd-MM-yyyy')"), F.lit("?")).alias("query"))
    return kn.daily_note_asked(asked, daily, "conv_id")


@query("SELECT l_orderkey AS note_id, l_linenumber::BIGINT AS version_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title, 'line ' || l_partkey AS preview FROM (SELECT *, repeat('title ' || l_suppkey || ' ', 9) AS t FROM lineitem)")
def opr24_version_list(s, p):
    v = d.versions(s, p).select("note_id", F.col("l_linenumber").alias("version_id"), F.expr("repeat('title ' || l_suppkey || ' ', 9)").alias("title"), F.expr("'\n \n line ' || l_partkey || '\nmore'").alias("content"))
    return kn.version_list(v)


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'b' || (page_id % 3) END AS bundle_id, CASE WHEN page_id % 3 = 0 THEN 'orphaned' ELSE 'active' END AS status FROM pages")
def opr27_orphaned_highlights(s, p):
    h = d.table(s, p, "pages").select("page_id", F.concat(F.lit("b"), F.col("page_id") % 3).alias("bundle_id"), F.lit("active").alias("status"))
    return ar.orphaned(h, "b0").select("page_id", "bundle_id", "status")


@query("WITH u AS (SELECT r_name AS title, 1 AS o FROM region UNION ALL SELECT n_name, 2 FROM nation) SELECT o::INT AS part, string_agg('## ' || title || chr(10) || lower(title), chr(10) || chr(10) ORDER BY title) AS body FROM u GROUP BY o")
def opr31_rag_context(s, p):
    section = lambda t, name: d.table(s, p, t).select(F.row_number().over(W.orderBy(name)).alias("rank"), F.col(name).alias("title"), F.lower(name).alias("body"))
    made = ar.context([("1", section("region", "r_name")), ("2", section("nation", "n_name"))])
    return made.select(F.col("section").cast("int").alias("part"), "body")


_BOARD_HEAD = "chr(10) || 'Property definitions:' || chr(10) || '- status (select) — options: P, F' || chr(10) || '- priority (select)' || chr(10) || '- total (number)' || chr(10) || '- date (date)'"


@query(with_("near") + """, g AS (SELECT query_id // 50 AS conv_id, note_id, min(distance) AS d, any_value(title) AS title, string_agg(content, chr(10) ORDER BY chunk_index) AS text FROM ranked WHERE rank <= 10 GROUP BY query_id, note_id),
pin AS (SELECT DISTINCT conv_id, 'vec-' || (conv_id * 10) AS title, CASE WHEN conv_id % 6 = 0 THEN '(empty note)' ELSE 'day ' || conv_id END AS text, conv_id % 4 = 0 AS locked FROM conversations WHERE conv_id % 2 = 0),
e AS (SELECT conv_id, -1 AS o, 0 AS i, title, text FROM pin WHERE NOT locked UNION ALL SELECT g.conv_id, d, g.note_id, g.title, g.text FROM g LEFT JOIN pin USING (conv_id) WHERE g.title IS DISTINCT FROM pin.title),
n AS (SELECT conv_id, 'USER NOTES:' || chr(10) || string_agg('[Note: "' || title || '"]' || chr(10) || text, chr(10) || chr(10) ORDER BY o, i) AS body, list(title ORDER BY o, i) AS titles FROM e GROUP BY conv_id),
a AS (SELECT page_id // 2 AS conv_id, 'WIKIPEDIA ARTICLES:' || chr(10) || string_agg('[Wikipedia: "' || url || '"]' || chr(10) || 'p' || page_id || chr(10) || html, chr(10) || chr(10) ORDER BY page_id) AS body, list(url ORDER BY page_id) AS titles FROM pages GROUP BY page_id // 2),
f AS (SELECT p_partkey // 7 AS conv_id, 'SCANNED FILES:' || chr(10) || '[File: "' || p_name || '" (/f/' || p_partkey || ')]' || chr(10) || p_type AS body FROM part WHERE p_partkey % 7 = 0),
o AS (SELECT doc_id AS conv_id, '## Note the user currently has open' || chr(10) || '### doc-' || doc_id || chr(10) || text AS body FROM documents WHERE doc_id % 5 = 0)
SELECT c.conv_id, nullif(concat_ws(chr(10) || chr(10), o.body, n.body, a.body, f.body), '') AS context, list_filter([CASE WHEN n.body IS NOT NULL THEN 'notes' END, CASE WHEN a.body IS NOT NULL THEN 'articles' END, CASE WHEN f.body IS NOT NULL THEN 'files' END], lambda x: x IS NOT NULL) AS sources,
  coalesce(n.titles, []) AS note_titles, coalesce(a.titles, []) AS article_titles
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) LEFT JOIN a USING (conv_id) LEFT JOIN f USING (conv_id) LEFT JOIN o USING (conv_id)""")
def opr31_chat_context(s, p):
    turns, conv = d.table(s, p, "conversations"), F.expr("query_id DIV 50").alias("conv_id")
    near = se.ranked(se.by_source(_near(s, p, 10), "note_id", 10, None, 1e9, 1e9), ["query_id"], ["distance", "note_id"])
    pinned = turns.where("conv_id % 2 = 0").select("conv_id").distinct().selectExpr("conv_id", "'vec-' || (conv_id * 10) AS title", "CASE WHEN conv_id % 6 <> 0 THEN 'day ' || conv_id END AS content", "conv_id % 4 = 0 AS locked")
    articles = d.table(s, p, "pages").selectExpr("page_id DIV 2 AS conv_id", "page_id AS rank", "url AS title", "array('p' || page_id, html) AS excerpts")
    files = d.table(s, p, "part").where("p_partkey % 7 = 0").selectExpr("p_partkey DIV 7 AS conv_id", "p_partkey AS rank", "p_name AS title", "'/f/' || p_partkey AS path", "array(p_type) AS excerpts")
    opened = d.notes(s, p).where("note_id % 5 = 0").selectExpr("note_id AS conv_id", "title", "content")
    notes = ch.note_entries(near.select(conv, "rank", "title", "excerpts"), pinned, "conv_id")
    return ch.assembled(turns, "conv_id", ch.open_note(opened, "conv_id"), None, ch.section(notes, "notes", "conv_id"), *[ch.section(ch.found_entries(rows, "conv_id"), kind, "conv_id") for kind, rows in (("articles", articles), ("files", files))])


@query(with_("order_notes", "cells", "defs") + """, v AS (SELECT n.folder_id, n.note_id, c.value FROM order_notes n JOIN cells c ON c.note_id = n.note_id AND c.def_id = n.folder_id * 10 + 1),
shelf AS (SELECT unnest(range(5)) AS folder_id), opts AS (SELECT folder_id, value, o FROM shelf CROSS JOIN (VALUES ('P', 0), ('F', 1), ('', 2)) t(value, o)),
c AS (SELECT folder_id, value, coalesce(o, 3) AS o, coalesce(n, 0) AS n FROM opts FULL JOIN (SELECT folder_id, value, count(*) AS n FROM v GROUP BY folder_id, value) USING (folder_id, value)),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY folder_id ORDER BY o, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY folder_id, value ORDER BY note_id) AS i FROM v),
t AS (SELECT r.folder_id, r.value, r.i, '- order-' || r.note_id || ' [' || string_agg(defs.name || ': ' || x.value, ', ' ORDER BY defs.position) || ']' AS line FROM r JOIN b USING (folder_id, value) JOIN cells x ON x.note_id = r.note_id JOIN defs ON defs.def_id = x.def_id WHERE before + i <= 50 GROUP BY r.folder_id, r.value, r.i, r.note_id),
l AS (SELECT folder_id, value, string_agg(line, chr(10) ORDER BY i) AS lines FROM t GROUP BY folder_id, value),
k AS (SELECT folder_id, string_agg(concat_ws(chr(10), chr(10) || '### ' || CASE value WHEN '' THEN 'Unset' ELSE value END || ' (' || n || ')', lines), chr(10) ORDER BY o, value) AS body FROM b LEFT JOIN l USING (folder_id, value) WHERE before < 50 GROUP BY folder_id)
SELECT folder_id, concat_ws(chr(10), '## Folder ' || folder_id || """ + _BOARD_HEAD + """, body, CASE WHEN total > 50 THEN chr(10) || '... and ' || (total - 50) || ' more cards not shown' END) AS body FROM k JOIN (SELECT folder_id, sum(n)::BIGINT AS total FROM c GROUP BY folder_id) USING (folder_id)""")
def opr31_board_view(s, p):
    notes = d.order_notes(s, p).withColumn("title", F.concat(F.lit("order-"), "note_id"))
    defs = d.property_defs(s).withColumn("options", F.when(F.col("name") == "status", F.array(F.lit("P"), F.lit("F"))))
    folders = s.range(5).selectExpr("id AS folder_id", "'Folder ' || id AS label")
    return ch.board_view(folders, notes, d.property_cells(s, p), defs)


@query("SELECT DISTINCT 'doc-' || (doc_id * 7 % 997) AS title, n.id IS NOT NULL AS found, n.id FROM documents d LEFT JOIN (SELECT doc_id AS id FROM documents) n ON n.id = d.doc_id * 7 % 997")
def opr32_transclusion_targets(s, p):
    n = d.notes(s, p)
    wanted = n.select(F.concat(F.lit("doc-"), F.col("note_id") * 7 % 997).alias("title")).distinct()
    return wanted.join(kn.first_by_title(n), "title", "left").select("title", F.col("target_id").isNotNull().alias("found"), F.col("target_id").alias("id"))


@query("""WITH RECURSIVE d AS (SELECT doc_id, text, doc_id % 3 AS k, doc_id * 7 % 997 AS t FROM documents),
w AS (SELECT doc_id AS root, 0 AS level, text AS shown, k, t, [doc_id] AS trail FROM d
  UNION ALL SELECT w.root, w.level + 1, w.shown || b.text, b.k, b.t, list_append(w.trail, b.doc_id) FROM w JOIN d b ON b.doc_id = w.t WHERE w.k <> 0 AND w.level < 5 AND NOT list_contains(w.trail, w.t)),
l AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY level DESC) AS r FROM w)
SELECT root AS note_id, shown || CASE WHEN k = 0 THEN '' ELSE CASE WHEN list_contains(trail, t) THEN '[circular' WHEN t NOT IN (SELECT doc_id FROM d) THEN '[missing' ELSE '[too deep' END || ': doc-' || t || ']' END || repeat(' end', level + 1) AS text FROM l WHERE r = 1""")
def opr32_expanded_embeds(s, p):
    from marginalia.operators.embeds import expanded

    # whole texts with an embed at the end, but for every third: chains of any length, circles, and notes that are not there
    embed = F.concat(F.lit("![[doc-"), F.col("note_id") * 7 % 997, F.lit("]]"))
    n = spread(d.notes(s, p)).withColumn("content", F.concat("content", F.when(F.col("note_id") % 3 == 0, "").otherwise(embed), F.lit(" end")))
    return expanded(n).select("note_id", "text")


@query(with_("notes", "folders", "tree") + ", f AS (SELECT DISTINCT id FROM tree WHERE ancestor = 1) SELECT note_id, CASE WHEN f.id IS NULL THEN content END AS shown, f.id IS NOT NULL AS hidden, CASE WHEN f.id IS NOT NULL THEN (ceil((octet_length(encode(content)) + 28) / 3.0) * 4)::INT END AS stored, content AS opened, f.id IS NULL AS indexed FROM notes n LEFT JOIN f ON f.id = n.folder_id")
def opr33_reencrypted_subtree(s, p):
    n, key = d.notes(s, p), F.lit(b"k" * 32)
    folders, shut, rest = ns.locked(d.folders(s, p), n, 1, key, {"rows": n.select("note_id")})
    _, plain, _ = ns.unlocked(folders, persisted(shut, "locked"), 1, key)
    own = kn.subtree(d.folders(s, p), 1).select(F.col("id").alias("folder_id"), F.lit(True).alias("h"))
    seen = shut.join(own, "folder_id", "left").select("note_id", F.when(F.col("h").isNull(), F.col("content")).alias("shown"), F.col("h").isNotNull().alias("hidden"), F.when(F.col("h"), F.length("content")).alias("stored"))
    opened = plain.select("note_id", F.col("content").alias("opened"))
    return seen.join(opened, "note_id").join(rest["rows"].withColumn("i", F.lit(True)), "note_id", "left").withColumn("indexed", F.col("i").isNotNull()).drop("i")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) AS files FROM documents d LEFT JOIN labels l USING (doc_id)")
def opr34_stale_summary(s, p):
    return kn.missing_counts(d.table(s, p, "documents"), d.table(s, p, "labels"), "doc_id")


@query("SELECT least(10, (SELECT max(n_nationkey) FROM nation))::INT AS retries, (SELECT count(*) FROM region) <> 5 AS audit_enabled, least(600, greatest(50, (SELECT count(*) FROM region)))::INT AS reading_wpm, (SELECT min(c_mktsegment) FROM customer) AS date_format")
def opr36_settings(s, p):
    # settings whose values the tables give: one is set twice, and two lie beyond their bounds
    of = lambda key, table, value: d.table(s, p, table).agg(F.lit(key).alias("key"), value.cast("string").alias("value")).select("key", "value")
    stored = KeyedTable(s, new_path(s, "settings"), ["key"])
    first = of("retries", "nation", F.min("n_nationkey")).unionByName(of("audit_enabled", "region", F.when(F.count("*") == 5, "false").otherwise("true")))
    vault.set_settings(stored, first.unionByName(of("reading_wpm", "region", F.count("*"))), 0)
    got = vault.set_settings(stored, of("retries", "nation", F.max("n_nationkey")).unionByName(of("date_format", "customer", F.min("c_mktsegment"))), 1)
    return s.createDataFrame([(got.retries, got.audit_enabled, got.reading_wpm, got.date_format)], "retries int, audit_enabled boolean, reading_wpm int, date_format string")


@query(with_("notes") + "SELECT title FROM notes WHERE starts_with(lower(title), 'doc-9') ORDER BY title LIMIT 10")
def opr29_autocomplete(s, p):
    return ar.suggestions(d.notes(s, p).select("title"), " Doc-9").select("title")


@query(with_("log") + "SELECT id, action, created_at, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS created_at_iso_utc FROM log")
def snk8_audit_export_rows(s, p):
    return d.audit_log(s, p).select("id", "action", "created_at", tx.iso_utc(F.col("created_at")).alias("created_at_iso_utc"))


@query(_FTS + " SELECT note_id, round(score, 6) AS score FROM scored ORDER BY scored.score, note_id LIMIT 25")
def sr1_ranked_by_bm25(s, p):
    lexical, _ = _lists(s, p, 25)
    return lexical.select("note_id", F.round("score", 6).alias("score"))
