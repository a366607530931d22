"""DuckDB SQL that the query set is held against."""

COSINE = "list_cosine_{}(e.embedding::DOUBLE[], q.qe::DOUBLE[])"
SIMILARITY, DISTANCE = COSINE.format("similarity"), COSINE.format("distance")
QUERY = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0)"
STRIPPED = "trim(replace({}, chr(10), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
CUT = "(SELECT doc_id, text, unnest(range(0, length(text), {})) AS st FROM documents)"
PAGES = f"pg AS (SELECT doc_id, CAST(st // 500 AS BIGINT) + 1 AS page_no, substring(text, st + 1, 500) AS page_text FROM {CUT.format(500)})"

SQL: dict[str, str] = {
    "match_documents_topk": f"""
WITH {QUERY} SELECT e.vec_id AS id, d.text AS content, round({SIMILARITY}, 6) AS similarity
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id CROSS JOIN q ORDER BY {DISTANCE}, e.vec_id LIMIT 5""",
    "match_documents_filtered": f"""
WITH {QUERY} SELECT e.vec_id AS id, d.lang, round({SIMILARITY}, 6) AS similarity
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id CROSS JOIN q WHERE d.lang = 'en' AND d.source = 'src1' ORDER BY {DISTANCE}, e.vec_id LIMIT 5""",
    "match_documents_nolimit": f"WITH {QUERY} SELECT e.vec_id AS id, round({SIMILARITY}, 6) AS similarity FROM embeddings e, q",
    "inner_product_topk": f"""
WITH {QUERY} SELECT e.vec_id AS id, round(list_inner_product(e.embedding::DOUBLE[], q.qe::DOUBLE[]), 6) AS similarity
FROM embeddings e, q ORDER BY list_inner_product(e.embedding::DOUBLE[], q.qe::DOUBLE[]) DESC, e.vec_id LIMIT 5""",
    "knn_batch": f"""
SELECT q_id, vec_id, rk FROM (SELECT q.vec_id AS q_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE}, e.vec_id) AS rk
FROM embeddings e, (SELECT vec_id, embedding AS qe FROM embeddings) q) WHERE rk <= 5""",
    "json_containment": "SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 69",
    "chunk_documents": f"SELECT doc_id, CAST(st // 896 AS BIGINT) AS chunk_index, substring(text, st + 1, 1024) AS content FROM {CUT.format(896)}",
    "chunk_counts": "SELECT source, CAST(sum(CAST(ceil(length(text) / 896.0) AS BIGINT)) AS BIGINT) AS n_chunks FROM documents GROUP BY source",
    "chunk_metadata": """
SELECT doc_id, CAST(st // 896 AS BIGINT) AS chunk_index, '{"source":"' || source || '","chunk_index":' || CAST(st // 896 AS BIGINT) || '}' AS metadata
FROM (SELECT doc_id, source, unnest(range(0, length(text), 896)) AS st FROM documents)""",
    "chunk_ids": "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n_ids FROM (SELECT CAST(ceil(length(text) / 896.0) AS BIGINT) AS n FROM documents)",
    "page_concat": "SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id",
    "catalog_project": "SELECT p_partkey AS primary_di, p_brand AS brand_name, p_name AS description, p_type AS catalog_number FROM part",
    "catalog_search": "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%WIDGET%' AND p_type <> '' ORDER BY p_partkey LIMIT 5",
    "catalog_upsert": """
SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "load_batches": """
SELECT batch_no, n, CAST(sum(n) OVER (ORDER BY batch_no) AS BIGINT) AS total_inserted
FROM (SELECT (rn - 1) // 1000 AS batch_no, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1)""",
    "rag_context": f"""
WITH {QUERY}, r AS (SELECT d.source, d.text, row_number() OVER (ORDER BY {DISTANCE}, e.vec_id) AS i FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id CROSS JOIN q)
SELECT string_agg('Source [' || i || '] (File: ' || coalesce(source, 'Unknown') || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS context FROM r WHERE i <= 5""",
    "empty_result_fallback": "SELECT CASE WHEN count(*) = 0 THEN 'No relevant IFU sections found.' ELSE 'found' END AS answer FROM documents WHERE lang = 'xx'",
    "search_term": f"SELECT doc_id, {STRIPPED.format('substring(text, 1, 40)')} AS term FROM documents",
    "locate_first_page": f"""
WITH {PAGES}, c AS (SELECT doc_id, CAST(st // 896 AS BIGINT) AS chunk_index, {STRIPPED.format('substring(substring(text, st + 1, 1024), 1, 40)')} AS term FROM {CUT.format(896)})
SELECT c.doc_id, c.chunk_index, min(pg.page_no) AS found_page, coalesce(min(pg.page_no), 1) AS ui_page
FROM c LEFT JOIN pg ON pg.doc_id = c.doc_id AND c.term <> '' AND contains(lower(pg.page_text), lower(c.term)) GROUP BY c.doc_id, c.chunk_index""",
    "locate_all_pages": f"""
WITH {PAGES}, t AS (SELECT doc_id, {STRIPPED.format('substring(text, 1, 50)')} AS term FROM documents)
SELECT pg.doc_id, pg.page_no FROM t JOIN pg ON pg.doc_id = t.doc_id AND t.term <> '' AND contains(lower(pg.page_text), lower(t.term))""",
    "skip_existing": "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "safe_file_name": "SELECT page_id, page_id || '_' || replace(url, '/', '_') || '.pdf' AS file_name FROM pages",
    "display_name": """
SELECT page_id, CASE WHEN length(n) > 40 THEN substring(n, 1, 40) || '...' ELSE n END AS display_name
FROM (SELECT page_id, replace(replace(url, '.html', ''), '_', ' ') AS n FROM pages)""",
    "query_templates": """
SELECT p_partkey, CAST(t.template_no AS BIGINT) AS template_no, CASE t.template_no
  WHEN 1 THEN trim(split_part(p_brand, ',', 1)) || ' ' || p_type || ' "Instructions for use" filetype:pdf'
  WHEN 2 THEN trim(split_part(p_brand, ',', 1)) || ' ' || p_name || ' ' || p_type || ' IFU filetype:pdf'
  ELSE trim(split_part(p_brand, ',', 1)) || ' ' || p_type || ' manual filetype:pdf' END AS q FROM part CROSS JOIN (VALUES (1), (2), (3)) t(template_no)""",
    "first_url": "SELECT split_part(url, '/', 3) AS host, arg_min(url, page_id) AS url FROM pages WHERE contains(lower(url), '.html') GROUP BY 1",
    "hits_per_host": """
SELECT host, page_id, rank FROM (SELECT split_part(url, '/', 3) AS host, page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS rank FROM pages) WHERE rank <= 3""",
    "limit_then_filter": "SELECT p_partkey, p_name FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 20) WHERE p_type <> 'ECONOMY'",
    "nested_documents": "SELECT conv_id, turn, role FROM conversations WHERE lower(coalesce(role, 'user')) = 'user' AND contains(lower(text), 'the')",
    "paging": "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5 OFFSET 10",
    "suffix_filter": "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html'",
    "progress_position": "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS idx, count(*) OVER () AS total FROM part",
    "base64_text": "SELECT p_partkey, base64(encode(p_name)) AS b64 FROM part",
    "outcomes": "SELECT CAST(count(*) FILTER (quality = 1) AS BIGINT) AS successes, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id)",
    "stream_ingest": "SELECT source, CAST(sum(CAST(ceil(length(text) / 896.0) AS BIGINT)) AS BIGINT) AS n_chunks FROM documents GROUP BY source",
}
