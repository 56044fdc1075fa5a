"""The same results in DuckDB's SQL, written on its own."""

from __future__ import annotations

from . import files

_PAGES = r"""
pages AS (
  SELECT conv_id AS doc_id, turn + 1 AS page_number,
         CASE WHEN turn = 0 THEN '# Conversation ' || conv_id || chr(10) || chr(10) ELSE '' END || '## ' || role || ' ' || turn || chr(10) || text AS md
  FROM conversations
)"""

_CONVERSATIONS = _PAGES + r""",
docs AS (
  SELECT doc_id, string_agg(chr(10) || '<!-- page_number: ' || page_number || ' -->' || chr(10) || chr(10) || md, chr(10) ORDER BY page_number) AS content
  FROM pages GROUP BY doc_id
)"""

_CHUNKS = r""",
split AS (SELECT doc_id, string_split(regexp_replace(content, '(?m)^(##{0,5})\s+([^\n]+)$', chr(57344) || '\0', 'g'), chr(57344)) AS parts FROM docs),
sections AS (
  SELECT doc_id, unnest(generate_series(1, len(parts))) - 1 AS sec, unnest(parts) AS raw, len(parts) AS n FROM split
),
parsed AS (
  SELECT doc_id, sec, raw, n,
         CASE WHEN sec = 0 THEN 0 ELSE length(regexp_extract(raw, '^(#{1,6})\s', 1)) END AS lvl,
         CASE WHEN sec = 0 THEN NULL ELSE trim(regexp_extract(raw, '^#{1,6}\s+([^\n]+)', 1), ' ' || chr(9) || chr(10) || chr(13)) END AS title,
         regexp_extract_all(raw, '<!--[\s]*page_number:[\s]*([0-9]+)[\s]*-->', 1)::int[] AS marks
  FROM sections
),
placed AS (
  SELECT *, coalesce(last_value(marks[-1] IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS page FROM parsed
),
paths AS (
  SELECT s.doc_id, s.sec, string_agg(a.title, ' > ' ORDER BY a.sec) AS path
  FROM parsed s JOIN parsed a ON a.doc_id = s.doc_id AND a.sec <= s.sec AND a.lvl > 0 AND s.lvl > 0
  WHERE NOT EXISTS (SELECT 1 FROM parsed b WHERE b.doc_id = s.doc_id AND b.sec > a.sec AND b.sec <= s.sec AND b.lvl <= a.lvl)
  GROUP BY s.doc_id, s.sec
),
chunks AS (
  SELECT p.doc_id, (row_number() OVER (PARTITION BY p.doc_id ORDER BY p.sec) - 1)::int AS chunk_index,
         trim(regexp_replace(raw, '<!--[\s]*page_number:[\s]*[0-9]+[\s]*-->', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS content,
         title AS header, lvl::int AS header_level, coalesce(path, '') AS header_path,
         list_sort(list_distinct(list_prepend(page, marks))) AS page_list
  FROM placed p LEFT JOIN paths q ON q.doc_id = p.doc_id AND q.sec = p.sec
  WHERE p.sec > 0 OR n = 1 OR trim(raw, ' ' || chr(9) || chr(10) || chr(13)) <> ''
)"""

_OUT = " SELECT doc_id, chunk_index, content, header, header_level, header_path, array_to_string(page_list, ',') AS page_numbers FROM chunks"

_TABLES = r"""
made AS (
  SELECT doc_id, source, lang,
         text || repeat(chr(10) || chr(10) || '| a | b |' || chr(10) || '| --- | :---: |' || chr(10) || '| 1 | 2 |', (doc_id % 3)::int)
         || chr(10) || chr(10) || '| A |' || chr(10) || '| --- |' || chr(10) || '| 1 |' AS content
  FROM documents
),
counted AS (
  SELECT doc_id, content, len(list_filter(regexp_split_to_array(content, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E]|\x{85}|\x{2028}|\x{2029}'),
         lambda x: regexp_matches(x, '^[\s]*[|]?[\s]*:?---+:?[\s]*([|][\s]*:?---+:?[\s]*)+[|]?[\s]*$'))) AS table_count
  FROM made
)"""

_CHECKED = _TABLES + r""",
measured AS (
  SELECT c.doc_id, length(content) AS chars, table_count, doc_id % 5 = 0 AS ocr, CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 ELSE 0 END AS ocr_chars,
         doc_id % 2 = 0 AS multi, doc_id % 3 AS warned, doc_id % 4 AS removed
  FROM counted c
),
checked AS (
  SELECT m.*, quality, toxic, list_filter([
    CASE WHEN quality = 1 AND chars < 1000 THEN 'min_chars' END,
    CASE WHEN table_count < 1 THEN 'min_tables' END,
    CASE WHEN toxic = 1 AND table_count <= 0 THEN 'require_table_markdown' END,
    CASE WHEN quality = 0 AND ocr_chars <= 0 THEN 'require_ocr_text' END,
    CASE WHEN NOT multi AND warned <= 0 THEN 'require_multi_column_check' END], lambda x: x IS NOT NULL) AS failures,
    CASE WHEN toxic = 1 AND removed = 0 THEN 'header_footer_filter_not_applied' ELSE '' END AS warnings
  FROM measured m JOIN labels USING (doc_id)
)"""

SQL: dict[str, str] = {
    "conversation_chunks": "WITH" + _CONVERSATIONS + _CHUNKS + _OUT,
    "catalog_chunks_nested": r"""WITH
segments AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
per_nation AS (SELECT c_nationkey, string_agg(chr(10) || '#### ' || c_mktsegment || chr(10) || n || ' customers', '' ORDER BY c_mktsegment) AS s FROM segments GROUP BY ALL),
per_region AS (
  SELECT n_regionkey, string_agg(chr(10) || '## ' || n_name || chr(10) || '<!-- page_number: ' || (n_nationkey + 2) || ' -->' || chr(10) || 'Key ' || n_nationkey || coalesce(s, ''), '' ORDER BY n_name) AS b
  FROM nation LEFT JOIN per_nation ON c_nationkey = n_nationkey GROUP BY ALL
),
docs AS (SELECT r_regionkey AS doc_id, 'Preface' || chr(10) || '# ' || r_name || coalesce(b, '') AS content FROM region LEFT JOIN per_region ON n_regionkey = r_regionkey)""" + _CHUNKS + _OUT,
    "table_markdown": r"""
SELECT n_regionkey, '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10)
       || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown
FROM nation GROUP BY n_regionkey""",
    "sheet_document": r"""WITH s AS (
  SELECT 1 AS p, '### Sheet: region' || chr(10) || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10)
         || string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) AS md FROM region
  UNION ALL
  SELECT 2, '### Sheet: nation' || chr(10) || chr(10) || '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10)
         || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) FROM nation
  UNION ALL
  SELECT 3, '### Sheet: supplier' || chr(10) || chr(10) || '| s_suppkey | s_name | s_nationkey |' || chr(10) || '| --- | --- | --- |' || chr(10)
         || string_agg('| ' || s_suppkey || ' | ' || s_name || ' | ' || s_nationkey || ' |', chr(10) ORDER BY s_suppkey) FROM supplier
)
SELECT 'workbook' AS doc, string_agg(chr(10) || '<!-- page_number: ' || p || ' -->' || chr(10) || chr(10) || md, chr(10) ORDER BY p) AS content, count(*) AS page_count FROM s""",
    "block_markdown": r"""
SELECT p_brand AS doc_id, string_agg(['# ', '# ', '## ', '### ', '- ', '', ''][p_partkey % 7 + 1] || trim(p_name) || chr(10), chr(10) ORDER BY p_partkey) AS markdown, count(*) AS blocks
FROM part WHERE p_partkey % 11 <> 0 GROUP BY p_brand""",
    "table_count": "WITH" + _TABLES + " SELECT doc_id, table_count::bigint AS table_count FROM counted",
    "doc_metrics": "WITH" + _PAGES + r""", d AS (SELECT doc_id, count(*) AS page_count, string_agg(md, chr(10) ORDER BY page_number) AS md FROM pages GROUP BY doc_id)
SELECT doc_id, page_count, strlen(md) AS output_bytes, length(md) AS markdown_chars, 0::bigint AS table_count, 0::bigint AS image_count, 0::bigint AS caption_count FROM d""",
    "chunk_stats": "WITH" + _CONVERSATIONS + _CHUNKS + r"""
SELECT doc_id, count(*) AS n_chunks, max(header_level)::bigint AS max_level, sum(len(page_list))::bigint AS page_refs,
       count(*) FILTER (WHERE len(page_list) > 1) AS spanning_chunks, sum(length(content))::bigint AS content_chars
FROM chunks GROUP BY doc_id""",
    "error_classes": r"""
SELECT ['file_not_found', 'dependency_missing', 'unsupported_format', 'engine_unavailable', 'engine_unavailable', 'engine_timeout', 'ocr_unavailable', 'table_extraction_failed', 'parse_failed'][event_id % 9 + 1] AS error_type,
       event_type, count(*) AS n
FROM events GROUP BY ALL""",
    "quality_checks": "WITH" + _CHECKED + " SELECT doc_id, len(failures) = 0 AS passed, array_to_string(failures, ',') AS failures, warnings FROM checked",
    "batch_summary": r"""WITH items AS (
  SELECT source || '/' || lpad(doc_id::varchar, 12, '0') || '.pdf' AS source, n_chars,
         CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'skipped' ELSE 'success' END AS status
  FROM documents LEFT JOIN labels USING (doc_id)
)
SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'failed') AS failed_count,
       count(*) FILTER (WHERE status = 'skipped') AS skipped_count, sum(ceil(n_chars / 1000)) FILTER (WHERE status = 'success')::bigint AS total_pages,
       round(round(sum(ceil(n_chars / 1000)) FILTER (WHERE status = 'success') / sum(n_chars / 1024) FILTER (WHERE status = 'success'), 4), 3) AS average_pages_per_second,
       string_agg(source, ',' ORDER BY source) FILTER (WHERE status = 'failed') AS failed_sources
FROM items""",
    "benchmark_summary": "WITH" + _CHECKED + r""", r AS (SELECT *, lpad(doc_id::varchar, 12, '0') AS id, toxic = 1 AS bad FROM checked)
SELECT count(*) AS total_samples, count(*) FILTER (WHERE NOT bad) AS success_count, count(*) FILTER (WHERE bad) AS failed_count,
       count(*) FILTER (WHERE NOT bad AND len(failures) = 0) AS quality_passed_count, count(*) FILTER (WHERE NOT bad AND len(failures) > 0) AS quality_failed_count,
       coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE bad), '') AS failed_samples,
       coalesce(string_agg(id, ',' ORDER BY id) FILTER (WHERE NOT bad AND len(failures) > 0), '') AS quality_failed_samples,
       sum(table_count) FILTER (WHERE NOT bad)::bigint AS total_tables, 0::bigint AS total_images, count(*) FILTER (WHERE NOT bad AND ocr) AS ocr_applied_count,
       sum(warned) FILTER (WHERE NOT bad)::bigint AS reading_order_warning_count, sum(removed) FILTER (WHERE NOT bad)::bigint AS header_footer_removed_count
FROM r""",
    "skip_existing": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'skipped' ELSE 'success' END AS status FROM documents",
    "element_pages": r"""WITH e AS (
  SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber > 5 THEN 0 ELSE l_linenumber % 3 END AS page_idx, l_linenumber::bigint * 1000000000000 + l_partkey * 10000 + l_suppkey AS pos,
         CASE WHEN l_linestatus = 'O' THEN 'title' ELSE 'text' END AS kind, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE l_returnflag || ' ' || l_partkey END AS text
  FROM lineitem
), p AS (
  SELECT doc_id, page_idx, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE text <> ''), '') AS plain_text, string_agg(kind, ',' ORDER BY pos) AS kinds FROM e GROUP BY ALL
)
SELECT doc_id, page_idx::bigint + 1 AS page_number, CASE WHEN plain_text = '' THEN 'whole' ELSE plain_text END AS markdown_content, plain_text, kinds FROM p""",
    "service_replies": r"""
SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE l_linenumber % 3 + 1 END::bigint AS page_number,
       CASE WHEN l_orderkey % 5 = 0 THEN 'order ' || l_orderkey ELSE string_agg(l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) END AS markdown_content,
       CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE string_agg(l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) END AS plain_text,
       CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) END AS n_elements
FROM lineitem GROUP BY l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE l_linenumber % 3 + 1 END""",
    "quality_rollup": r"""
SELECT user_id, coalesce(bool_or(CASE WHEN event_id % 3 = 0 THEN event_type = 'click' END), false) AS ocr_applied,
       coalesce(sum(CASE WHEN event_id % 4 <> 0 THEN length(event_type) END), 0)::bigint AS ocr_text_chars, bool_or(event_id % 97 = 0) AS multi_column_detected,
       sum(event_id % 2)::bigint AS reading_order_warnings, 0::bigint AS header_footer_removed_count
FROM events GROUP BY user_id""",
    "route_by_extension": r"""WITH f AS (
  SELECT doc_id, ['.pdf', '.docx', '.doc', '.xlsx', '.xls', '.csv', '.md', '.txt', '.html', '.doc-' || doc_id][doc_id % 10 + 1] AS extension,
         CASE WHEN doc_id % 10 = 9 THEN 'v1' ELSE 'v1.doc-' || doc_id END AS stem
  FROM documents
)
SELECT doc_id, extension, CASE WHEN extension IN ('.docx', '.doc') THEN 'docx' WHEN extension IN ('.xlsx', '.xls') THEN 'excel' WHEN extension IN ('.md', '.txt') THEN 'text'
       WHEN extension IN ('.pdf', '.csv') THEN substr(extension, 2) ELSE 'unsupported' END AS family, stem || '.md' AS output
FROM f""",
    "marker_ranges": r"""WITH t AS (SELECT doc_id, text, doc_id % 6 AS k, length(text) // 2 AS half FROM documents WHERE text IS NOT NULL),
docs AS (
  SELECT doc_id, '<!-- page_number: ' || (k + 3) || ' -->' || left(text, half) || '<!-- page_number: ' || (k + 1) || ' -->' || substr(text, half + 1)
         || '<!-- page_number: ' || (k + 3) || ' -->' || text || '<!--page_number:  9-->' AS content FROM t
)""" + _CHUNKS + r""",
listed AS (SELECT doc_id, string_agg(array_to_string(page_list, ','), ';' ORDER BY chunk_index) AS pages FROM chunks GROUP BY doc_id)
SELECT doc_id, array_to_string(regexp_extract_all(content, '<!--[\s]*page_number:[\s]*([0-9]+)[\s]*-->', 1), ',') AS markers,
       trim(regexp_replace(content, '<!--[\s]*page_number:[\s]*[0-9]+[\s]*-->', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS clean, pages
FROM docs JOIN listed USING (doc_id)""",
    "rates": r"""
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0::double ELSE round(round((event_id % 64) / ((event_id % 9) / 8), 4), 3) END AS rate, round(round((event_id % 64) / 64, 4), 3) AS ratio
FROM events""",
    **files.SQL,
}
