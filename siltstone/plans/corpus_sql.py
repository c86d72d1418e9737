"""SQL that the corpus queries are held against."""

from __future__ import annotations

from siltstone.functions import values as V
from siltstone.plans.search import _CHUNKS, _QUESTIONS, _tokens


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_EXTS = [".py", ".md", ".png", ".lock", ".xyz", ".TXT", ".js"]
_DIRS = ["src", "node_modules", ".git", "docs/en", "pkg.egg-info", "docs/english", "lib"]
_TREE = f"""tree AS (SELECT doc_id, {_list(_DIRS)}[doc_id % 7 + 1] || '/' || source || '/' || CASE WHEN doc_id % 13 = 0 THEN 'yarn.lock' ELSE doc_id || {_list(_EXTS)}[doc_id % 5 * 3 % 7 + 1] END AS path,
    CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN 2000000 ELSE octet_length(encode(text)) END AS size_bytes, doc_id % 23 = 0 AS is_binary FROM documents),
    named AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name, len(list_filter(string_split(path, '/')[:-2], lambda d: list_contains({_list(V.IGNORED_DIRS)}, d) OR d LIKE '%.egg-info')) > 0 AS pruned FROM tree),
    spoken AS (SELECT *, coalesce({_list(V.LANGUAGE_OF.values())}[list_position({_list(V.LANGUAGE_OF)}, lower(regexp_extract(name, '.(\\.[^.]*)$', 1)))], 'unknown') AS language FROM named),
    reasons AS (SELECT doc_id, path, CASE WHEN list_contains({_list(V.IGNORED_NAMES)}, name) THEN 'ignored filename' WHEN len(list_filter({_list(V.IGNORED_SUFFIXES)}, lambda s: ends_with(name, s))) > 0 THEN 'ignored extension' WHEN language = 'unknown' THEN 'unknown extension' WHEN size_bytes = 0 THEN 'empty file' WHEN size_bytes > 1000000 THEN 'too large' WHEN is_binary THEN 'binary' END AS reason FROM spoken WHERE NOT pruned)"""
_FILES = "files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, source AS package, lang AS language, text AS content, octet_length(encode(text)) AS size_bytes, greatest(1, length(text) // 4) AS tokens, CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines FROM documents)"
_SECTIONS = f"""{_FILES}, outline AS (SELECT path, language, array_to_string(list_transform(lines, lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '## ' || x ELSE x END), chr(10)) AS content FROM files),
    olines AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT path, CASE WHEN string_split(content, chr(10))[-1] = '' THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS ls FROM outline)),
    grouped AS (SELECT *, sum(regexp_matches(line, '^#{{1,3}} \\S')::INT) OVER (PARTITION BY path ORDER BY line_no) AS g FROM olines),
    sections AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY min(line_no)) AS section, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM grouped GROUP BY path, g)"""
_NUMBERED = f"{_SECTIONS}, numbered AS (SELECT *, row_number() OVER (ORDER BY path, start_line) - 1 AS ordinal FROM sections), ids AS (SELECT *, 'c' || lpad(ordinal::VARCHAR, 6, '0') || '_' || substr(sha1(path || '|' || start_line || '|' || end_line || '||' || ordinal), 1, 16) AS chunk_id FROM numbered)"
_RUNS = f"""{_FILES}, flines AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM files), islands AS (SELECT *, sum((line_no % 7 IN (3, 4))::INT) OVER (PARTITION BY path ORDER BY line_no) AS g FROM flines),
    runs AS (SELECT path, min(line_no) AS start_line, max(line_no) AS end_line FROM islands WHERE line_no % 7 NOT IN (3, 4) AND trim(line) <> '' GROUP BY path, g)"""
_SYMBOLS = f"""{_FILES}, toks AS (SELECT path, language, ({_tokens('content')})[1:12] AS t FROM files), each AS (SELECT path, language, t[1] AS top, unnest(t) AS symbol, generate_subscripts(t, 1) - 1 AS seq FROM toks),
    syms AS (SELECT path, language, seq, CASE WHEN seq % 3 = 0 THEN 'class_skeleton' ELSE 'function' END AS kind, symbol, CASE WHEN seq % 3 = 1 THEN top END AS parent_symbol FROM each)"""
_PACKAGES = f"""mods AS (SELECT source AS package, doc_id || '.txt' AS name, CASE WHEN doc_id % 4 > 0 THEN ({_tokens('text')})[1:10] ELSE [] END AS s FROM documents), entries AS (SELECT *, CASE WHEN len(s) > 0 THEN name || ' defines ' || array_to_string(s, ', ') || '.' ELSE name || ' (re-exports only).' END AS entry, count(*) OVER (PARTITION BY package) AS n, row_number() OVER (PARTITION BY package ORDER BY name) - 1 AS i FROM mods),
    parted AS (SELECT *, i // 18 + 1 AS part, ceil(n / 18)::INT AS parts, 'Package ' || package || ' — contains ' || n || ' Python modules' || CASE WHEN ceil(n / 18) > 1 THEN ' (part ' || (i // 18 + 1) || ' of ' || ceil(n / 18)::INT || ')' ELSE '' END || '. Structure and organization of ' || package || ':' AS head FROM entries WHERE n >= 2),
    sized AS (SELECT *, (length(head) + sum(length(entry) + 1) OVER w) // 4 AS tokens, row_number() OVER w AS k FROM parted WINDOW w AS (PARTITION BY package, part ORDER BY i)),
    packages AS (SELECT package || '/' AS path, CASE WHEN parts > 1 THEN part END AS part, CASE WHEN parts > 1 THEN parts END AS part_count, n AS module_count, head || chr(10) || string_agg(entry, chr(10) ORDER BY i) AS text FROM sized WHERE tokens <= 400 OR k = 1 GROUP BY package, part, parts, n, head)"""
_HEADS = f"heads AS (SELECT path, list_filter(list_transform(regexp_extract_all(content, '(?m)^#{{1,3}}[ \\t]+(.+)$', 1), lambda x: trim(x)), lambda x: true) AS h FROM outline), docs_cards AS (SELECT path, path || ' — documentation page.' || chr(10) || 'Sections: ' || array_to_string(list_transform(list_sort(list_distinct(list_transform(h, lambda x: [lpad(list_position(h, x)::VARCHAR, 9, '0'), x]))), lambda y: y[2])[1:25], '; ') || '.' AS text FROM heads WHERE len(h) > 0)"
_REPOS = f"""repos AS (SELECT doc_id AS repo_id, doc_id % 7 AS user_id, source AS name, 'repo_' || source || '__' || lang AS collection, ['queued', 'cloning', 'indexing', 'ready', 'failed'][doc_id % 5 + 1] AS status, doc_id * 37 % 1000 AS created, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS chunks, CASE WHEN doc_id % 3 = 0 THEN '/srv/' || source END AS repo_path FROM documents),
    manifests AS (SELECT 'repo_src' || (page_id % 40) || '__' || ['en', 'fr', 'xx'][page_id % 3 + 1] AS collection, 'src' || (page_id % 40) AS repo, CASE WHEN page_id % 4 = 0 THEN '/idx/' || (page_id % 40) END AS repo_path, page_id AS chunks FROM pages)"""
_LOG = "log AS (SELECT event_id, event_type AS path, CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END AS status, value AS ms, user_id AS key, floor(epoch(ts))::BIGINT AS sec FROM events)"
_URL = "url AS (SELECT doc_id, ['https://github.com/', 'https://www.github.com/', 'http://github.com/', 'git@github.com:'][doc_id % 4 + 1] || source || '/' || lang || ['', '.git', '/', '..x'][doc_id // 4 % 4 + 1] AS url FROM documents), parsed AS (SELECT doc_id, regexp_extract(url, '{0}', 1) AS o, regexp_extract(url, '{0}', 2) AS r FROM url)".format(V.REPO_URL)
_SPACE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_METRIC = "SELECT '{0}' AS metric, {1}::VARCHAR AS key, count(*)::DOUBLE AS value FROM log GROUP BY {1}"
_WINDOWED = f"""{_FILES}, units AS (SELECT path, content, tokens, lines, substr(lines[1], 1, 300) AS head, greatest(200 - least(greatest(1, length(substr(lines[1], 1, 300)) // 4), 50), 50) AS budget FROM files),
    fold AS (SELECT path, 1 AS i, 1 AS part, greatest(1, length(lines[1]) // 4) + 1 AS used FROM units WHERE tokens > 200 UNION ALL
        SELECT f.path, f.i + 1, CASE WHEN f.used + greatest(1, length(u.lines[f.i + 1]) // 4) + 1 > u.budget THEN f.part + 1 ELSE f.part END, CASE WHEN f.used + greatest(1, length(u.lines[f.i + 1]) // 4) + 1 > u.budget THEN 0 ELSE f.used END + greatest(1, length(u.lines[f.i + 1]) // 4) + 1 FROM fold f JOIN units u ON u.path = f.path WHERE f.i < len(u.lines)),
    parts AS (SELECT f.path, f.part, max(f.part) OVER (PARTITION BY f.path) AS part_count, min(f.i) AS a, max(f.i) AS z, string_agg(u.lines[f.i], chr(10) ORDER BY f.i) AS body, any_value(u.head) AS head FROM fold f JOIN units u USING (path) GROUP BY f.path, f.part)"""
_CODE = """code AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS path, ['python', 'javascript', 'typescript', 'go', 'rust', 'java'][doc_id % 6 + 1] AS language, ((len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) + 11) // 12)::INT AS n FROM documents),
    shaped AS (SELECT *, CASE WHEN language = 'python' THEN 3 ELSE 4 END AS k, CASE WHEN language = 'go' THEN 6 ELSE 5 END AS first FROM code),
    code_chunks AS (SELECT path, language, 'module' AS kind, NULL AS symbol, NULL AS parent_symbol, 1::INT AS start_line, 1::INT AS end_line, NULL::INT AS class_end_line FROM shaped
        UNION ALL SELECT path, language, 'class_skeleton', 'Store' || doc_id, NULL, 3, 3, (CASE language WHEN 'go' THEN 5 WHEN 'python' THEN 4 + 3 * n ELSE 5 + 4 * n END)::INT FROM shaped
        UNION ALL SELECT path, language, 'function', 'get' || i, CASE WHEN language <> 'go' THEN 'Store' || doc_id END, (first + k * i)::INT, (first + k * i + k - 1)::INT, NULL FROM (SELECT *, unnest(range(n)) AS i FROM shaped))"""
SQL = {
    "chunk_dispatch": f"WITH {_CODE} SELECT * FROM code_chunks",
    "chunk_python": f"WITH {_CODE} SELECT * FROM code_chunks WHERE language = 'python'",
    "chunk_braces": f"WITH {_CODE} SELECT * FROM code_chunks WHERE language <> 'python'",
    "card_python": f"""WITH {_CODE} SELECT path, path || ' — Python module in package ' || string_split(path, '/')[1] || '.' || chr(10) || 'Defines classes: Store' || doc_id || CASE WHEN n > 0 THEN ' (methods: ' || array_to_string(list_transform(range(least(n, 8)), lambda i: 'get' || i), ', ') || ')' ELSE '' END || '.' || chr(10) || 'Depends on: os.' AS text FROM code WHERE language = 'python'""",
    "scan_documents": f"WITH {_FILES} SELECT path, language, size_bytes FROM files",
    "scan_tree": f"""WITH {_TREE}, held AS (SELECT s.path, s.name, s.language, CASE WHEN d.doc_id % 17 = 0 THEN 0 WHEN d.doc_id % 97 = 0 THEN 1000001 WHEN d.doc_id % 23 = 0 OR d.doc_id % 29 = 0 THEN octet_length(encode(d.text)) + 1 ELSE octet_length(encode(d.text)) END AS size_bytes, d.doc_id, d.text FROM spoken s JOIN documents d USING (doc_id) WHERE NOT pruned),
        judged AS (SELECT *, CASE WHEN NOT regexp_matches(path, '^(docs|src|lib)/') THEN 'outside include list' WHEN starts_with(path, 'src/src1/') THEN 'user excluded' WHEN list_contains({_list(V.IGNORED_NAMES)}, name) THEN 'ignored filename' WHEN len(list_filter({_list(V.IGNORED_SUFFIXES)}, lambda s: ends_with(name, s))) > 0 THEN 'ignored extension'
            WHEN language = 'unknown' THEN 'unknown extension' WHEN size_bytes = 0 THEN 'empty file' WHEN size_bytes > 1000000 THEN 'too large' WHEN doc_id % 23 = 0 THEN 'binary' WHEN doc_id % 29 = 0 THEN 'decode error' END AS skip_reason FROM held)
        SELECT path, language, size_bytes, skip_reason, CASE WHEN skip_reason IS NULL THEN length(text)::INT END AS n_chars, CASE WHEN skip_reason IS NULL THEN md5(text) END AS text_md5 FROM judged""",
    "walk_dir_prune": f"WITH {_TREE} SELECT doc_id, path FROM named WHERE NOT pruned",
    "walk_include_exclude": f"WITH {_TREE} SELECT doc_id, path, CASE WHEN NOT (starts_with(path || '/', 'docs/en/') OR starts_with(path || '/', 'src/')) THEN 'outside include list' WHEN starts_with(path || '/', 'src/src1/') OR starts_with(path || '/', 'docs/en/src2/') THEN 'user excluded' END AS reason FROM tree",
    "walk_skip_reason": f"WITH {_TREE} SELECT * FROM reasons",
    "skip_stats": f"WITH {_TREE} SELECT coalesce(reason, 'loaded') AS reason, count(*) AS files FROM reasons GROUP BY 1",
    "walk_binary_sniff": f"WITH {_TREE} SELECT doc_id, is_binary FROM tree",
    "detect_language": f"WITH {_TREE} SELECT doc_id, language FROM spoken",
    "language_stats": "SELECT lang AS language, count(*) AS files FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "corpus_size_mb": f"WITH {_FILES} SELECT package, round(sum(size_bytes) / 1048576, 9) AS mb FROM files GROUP BY 1",
    "file_slice": f"WITH {_FILES}, a AS (SELECT doc_id, lines, doc_id % 6 + 1 AS s, doc_id % 6 + 3 AS e FROM files) SELECT doc_id, CASE WHEN s <= len(lines) THEN array_to_string(lines[greatest(s - 3, 1):least(e + 3, len(lines))], chr(10)) END AS lines FROM a",
    "parse_repo_url": f"WITH {_URL} SELECT doc_id, o <> '' AND NOT contains(o, '..') AND NOT contains(r, '..') AS ok, CASE WHEN o <> '' AND NOT contains(o, '..') AND NOT contains(r, '..') THEN o END AS owner, CASE WHEN o <> '' AND NOT contains(o, '..') AND NOT contains(r, '..') THEN r END AS repo FROM parsed",
    "duplicate_report": "SELECT count(*) AS total, count(DISTINCT text) AS distinct, count(*) - count(DISTINCT text) AS duplicate, round(100 * (count(*) - count(DISTINCT text)) / count(*), 6) AS percent FROM documents".replace("AS distinct", 'AS "distinct"'),
    "token_budget": f"WITH {_FILES} SELECT count(*) AS inspected, count(*) FILTER (tokens > 256) AS over, round(100 * count(*) FILTER (tokens > 256) / count(*), 6) AS percent, max(tokens) AS most, round(avg(tokens), 6) AS mean, sum(tokens)::BIGINT AS total FROM files".replace("AS over", 'AS "over"'),
    "token_count": f"WITH {_FILES} SELECT doc_id, tokens FROM files",
    "split_strata": f"WITH {_TREE} SELECT doc_id, CASE WHEN list_contains({_list(V.CODE_LANGUAGES)}, language) THEN 'code' ELSE 'prose' END AS stratum FROM spoken",
    "markdown_sections": f"WITH {_SECTIONS} SELECT * FROM sections",
    "module_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "emit_windowed": f"""WITH RECURSIVE {_WINDOWED} SELECT path, NULL::INT AS part, NULL::INT AS part_count, 10 AS start_line, 10 + len(lines) - 1 AS end_line, 0 AS header_lines, length(content) AS chars FROM units WHERE tokens <= 200
        UNION ALL SELECT path, part, part_count, 10 + a - 1, 10 + z - 1, CASE WHEN part > 1 AND head <> '' THEN 1 ELSE 0 END, length(trim(CASE WHEN part > 1 THEN head || chr(10) || body ELSE body END)) FROM parts""",
    "windowed_lines": f"""WITH RECURSIVE {_WINDOWED} SELECT path, part, a::INT AS start_line, z::INT AS end_line, CASE WHEN part > 1 AND head <> '' THEN 1 ELSE 0 END AS header_lines, length(trim(CASE WHEN part > 1 THEN head || chr(10) || body ELSE body END)) AS chars FROM parts""",
    "chunk_ids": f"WITH {_NUMBERED} SELECT chunk_id, path, start_line, end_line, ordinal FROM ids",
    "chunk_metadata": f"""WITH {_NUMBERED} SELECT chunk_id, ordinal AS doc_index, length(text) AS content_length, '{{"path":"' || path || '","start_line":' || start_line || ',"end_line":' || end_line || '}}' AS meta FROM ids""",
    "symbol_text": f"""WITH {_FILES}, n AS (SELECT doc_id, package, ({_tokens('content')})[1] AS name FROM files WHERE len({_tokens('content')}) > 0), q AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN name WHEN 1 THEN package || '.' || name END AS qualified FROM n)
        SELECT doc_id, concat_ws(' ', qualified, CASE WHEN name IS DISTINCT FROM qualified THEN name END, CASE WHEN package IS DISTINCT FROM qualified AND package <> name THEN package END) AS symbols FROM q""",
    "chunks_all": f"WITH {_SECTIONS}, {_RUNS.removeprefix(_FILES + ', ')} SELECT path, start_line, end_line, 'text' AS kind FROM sections UNION ALL SELECT path, start_line, end_line, 'module' FROM runs",
    "card_markdown": f"WITH {_SECTIONS}, {_HEADS} SELECT * FROM docs_cards",
    "card_from_chunks": f"""WITH {_SYMBOLS}, members AS (SELECT path, parent_symbol AS type, symbol, min(seq) AS seq FROM syms WHERE parent_symbol IS NOT NULL GROUP BY ALL), member_lists AS (SELECT path, type, array_to_string((list(symbol ORDER BY seq))[1:8], ', ') AS m FROM members GROUP BY 1, 2),
        types AS (SELECT path, symbol AS type, min(seq) AS seq FROM syms WHERE kind = 'class_skeleton' GROUP BY 1, 2), listed AS (SELECT path, array_to_string((list(CASE WHEN m IS NOT NULL THEN type || ' (members: ' || m || ')' ELSE type END ORDER BY seq))[1:25], '; ') AS t FROM types LEFT JOIN member_lists USING (path, type) GROUP BY 1),
        fs AS (SELECT path, symbol, min(seq) AS seq FROM syms WHERE kind = 'function' AND parent_symbol IS NULL GROUP BY 1, 2), funcs AS (SELECT path, array_to_string((list(symbol ORDER BY seq))[1:25], ', ') AS f FROM fs GROUP BY 1)
        SELECT path, concat_ws(chr(10), path || ' — ' || language || ' module in ' || string_split(path, '/')[1] || '.', 'Declares types: ' || t || '.', 'Declares functions: ' || f || '.') AS text FROM (SELECT DISTINCT path, language FROM syms) LEFT JOIN listed USING (path) LEFT JOIN funcs USING (path) WHERE t IS NOT NULL OR f IS NOT NULL""",
    "card_package": f"WITH {_PACKAGES} SELECT * FROM packages",
    "cards_all": f"WITH {_SECTIONS}, {_HEADS}, {_PACKAGES}, c AS (SELECT path, text, 'file_card' AS kind FROM docs_cards UNION ALL SELECT path, text, 'package_card' FROM packages) SELECT path, kind, doc_id, length(text) AS chars FROM c LEFT JOIN files USING (path)",
    "collection_slug": """SELECT page_id, substr('repo_' || CASE WHEN s = '' THEN 'repo' ELSE s END || CASE WHEN page_id % 2 = 0 THEN '__ast' ELSE '' END, 1, 63) AS collection FROM (SELECT page_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9_-]+', '_', 'g'), '_')) AS s FROM pages)""",
    "first_sentence": f"SELECT doc_id, substr({_SPACE.format('text')}, 1, 300) AS shown FROM documents",
    "format_location": f"WITH {_FILES} SELECT doc_id, CASE WHEN doc_id % 11 > 0 THEN path ELSE 'unknown' END || CASE WHEN doc_id % 3 > 1 THEN ':' || (doc_id % 50 + 1) || '-' || (doc_id % 50 + 9) WHEN doc_id % 3 > 0 THEN ':' || (doc_id % 50 + 1) ELSE '' END AS location FROM files",
    "source_projection": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '.' || lang ELSE lang END AS symbol, round(1.0::DOUBLE / (doc_id + 1), 6) AS score, substr(text, 1, 400) AS preview FROM documents",
    "path_parts": f"WITH {_TREE} SELECT doc_id, array_to_string(parts[:-2], '/') AS parent, name FROM named",
    "valid_email": "WITH m AS (SELECT c_custkey, lower(trim(' ' || replace(c_name, '#', ['@', '@@', ' ', '.'][c_custkey % 4 + 1]) || '.Example.com ')) AS email FROM customer) SELECT c_custkey, email, regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS ok FROM m",
    "limited_path": "WITH r AS (SELECT event_id, event_id % 3 > 0 AS post, ['/api/ask', '/api/conversations/7/messages', '/api/repos', '/api/auth/login', '/api/auth/signup', '/health', '/api/repos/3', '/api/conversations/7'][event_id % 8 + 1] AS path FROM events) SELECT event_id, post AND (path IN ('/api/ask', '/api/repos', '/api/auth/login', '/api/auth/signup') OR path LIKE '/api/conversations/%/messages') AS limited FROM r",
    "validate_requests": f"WITH {_QUESTIONS}, r AS (SELECT question_id, CASE WHEN length(trim(question)) < 3 THEN 'question too short' WHEN length(question) > 500 THEN 'question too long' WHEN question_id % 25 NOT BETWEEN 1 AND 20 THEN 'top_k out of range' END AS reason FROM questions) SELECT question_id, reason IS NULL AS ok, reason FROM r",
    "events_props_json": "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::INT)::BIGINT AS sum_k, max(json_extract(props, '$.k')::INT) AS max_k FROM events GROUP BY 1",
    "session_user": "SELECT event_id AS token, user_id, c_name AS user_name FROM events JOIN customer ON c_custkey = user_id WHERE ts + INTERVAL 1 HOUR * (event_id % 48) > TIMESTAMP '2024-01-15 00:00:00'",
    "list_repos": f"WITH {_REPOS} SELECT user_id, place::INTEGER AS place, repo_id, name, status, created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, repo_id) AS place FROM repos) WHERE place <= 50",
    "latest_by_name": f"WITH {_REPOS} SELECT name, repo_id, status, created FROM repos QUALIFY row_number() OVER (PARTITION BY name ORDER BY created DESC, repo_id DESC) = 1",
    "repo_status": f"WITH {_REPOS} SELECT collection, status FROM repos QUALIFY row_number() OVER (PARTITION BY collection ORDER BY created DESC, repo_id DESC) = 1",
    "collection_in_use": f"WITH {_REPOS} SELECT DISTINCT collection FROM manifests WHERE collection IN (SELECT collection FROM repos)",
    "orphan_collections": f"WITH {_REPOS}, gone AS (SELECT *, name IN ('src1', 'src2') OR status = 'failed' AS g FROM repos) SELECT collection FROM gone GROUP BY 1 HAVING bool_and(g)",
    "upsert_repo": f"WITH {_REPOS}, m AS (SELECT collection, max(chunks) AS chunks FROM manifests GROUP BY 1) SELECT * FROM m UNION ALL SELECT collection, max(chunks) FROM repos WHERE collection NOT IN (SELECT collection FROM m) GROUP BY 1",
    "propagate_stats": f"WITH {_REPOS}, m AS (SELECT collection, max(chunks) AS c FROM manifests GROUP BY 1) SELECT repo_id, collection, coalesce(c, chunks) AS chunks FROM repos LEFT JOIN m USING (collection)",
    "attach_decision": f"WITH {_REPOS}, a AS (SELECT DISTINCT chunks % 7 AS user_id, collection FROM manifests), mine AS (SELECT user_id, collection, min(repo_id) AS own FROM repos GROUP BY 1, 2), ready AS (SELECT collection, min(repo_id) AS other FROM repos WHERE status = 'ready' GROUP BY 1) SELECT user_id, collection, CASE WHEN own IS NOT NULL THEN 'mine' WHEN other IS NOT NULL THEN 'attach' ELSE 'create' END AS decision, coalesce(own, other) AS repo_id FROM a LEFT JOIN mine USING (user_id, collection) LEFT JOIN ready USING (collection)",
    "import_manifests": f"WITH {_REPOS} SELECT collection, chunks FROM manifests WHERE collection NOT IN (SELECT collection FROM repos)",
    "resolve_root": f"WITH {_REPOS}, f AS (SELECT repo, arg_min(repo_path, collection) AS found FROM manifests WHERE repo_path IS NOT NULL GROUP BY 1) SELECT repo_id, coalesce(repo_path, found, 'data/repos/' || name) AS root FROM repos LEFT JOIN f ON repo = name",
    "config_diff": "SELECT * FROM (VALUES ('rrf_k', '60', '10'), ('weights', '1:2', '1:3'), ('floor', NULL, '3')) t(key, before, after)",
    "request_metrics": f"WITH {_LOG} SELECT 'requests_total' AS metric, '' AS key, count(*)::DOUBLE AS value FROM log UNION ALL SELECT 'mean_request_ms', '', round(sum(ms) / greatest(count(*), 1), 6) FROM log UNION ALL {_METRIC.format('requests_by_status', 'status')} UNION ALL {_METRIC.format('requests_by_path', 'path')}",
    "rate_window_count": f"WITH {_LOG} SELECT event_id, key, count(*) OVER (PARTITION BY key ORDER BY sec RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS recent FROM log",
    "sse_frames": f"""WITH {_QUESTIONS}, f AS (SELECT question_id, ['{{}}'] || list_transform(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> ''), lambda w: '{{"text":"' || w || '"}}') || ['{{}}'] AS d FROM questions)
        SELECT question_id, generate_subscripts(d, 1) - 1 AS seq, CASE WHEN generate_subscripts(d, 1) = 1 THEN 'trace' WHEN generate_subscripts(d, 1) = len(d) THEN 'done' ELSE 'token' END AS event, unnest(d) AS data FROM f""",
    "index_vectors": f"WITH {_CHUNKS} SELECT stratum, count(*) AS vectors, 64 * count(*) AS cells FROM chunks GROUP BY 1",
    "manifest_roundtrip": f"WITH {_FILES} SELECT package, count(*) AS files_indexed, sum(size_bytes)::BIGINT AS bytes, count(*) AS total_chunks, count(DISTINCT content) AS unique_chunks FROM files GROUP BY 1",
}
