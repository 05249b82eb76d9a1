"""Independent SQL for the registered queries, runnable on the same tables."""

from __future__ import annotations

from codecairn.catalog.queries import (
    ARCHITECTURE_TEXT,
    COMMON_FILE,
    EMBEDDING,
    FAIL_EVERY,
    LOOKED_UP,
    MERGE_BUCKETS,
    PROJECT,
    QUERY_TEXT,
    QUERY_VECTOR,
    TOP_K,
)
from codecairn.operators.prompts import ANSWER_FORMAT, ELEMENTS_TASK

# White space trimmed in the SQL texts (the given tables hold no other).
_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def _blanks_before(x: str) -> str:
    return f"length({x}) - length(ltrim({x}, {_WS}))"


# -- shared inputs --------------------------------------------------------------

_DOC_MD = """doc_md AS (
  SELECT 'article' AS doc_type, CAST(doc_id AS VARCHAR) AS path, source, lang,
         '---' || chr(10) || 'title: "' || source || '"' || chr(10) || 'lang: ' || lang || chr(10)
           || '---' || chr(10) || chr(10) || '# ' || source || chr(10) || chr(10)
           || replace(text, chr(10), chr(10) || chr(10)) || chr(10) AS text
  FROM documents)"""

_TURN_MD = """turn_md AS (
  SELECT 'description' AS doc_type, conv_id || '/' || turn AS path, role, turn,
         'Opening of ' || conv_id || '.' || chr(10) || chr(10) || '# conversation ' || conv_id
         || chr(10) || chr(10) || '### aside' || chr(10) || chr(10) || 'Before the turn.' || chr(10)
         || chr(10) || '## ' || role || chr(10) || chr(10) || '### turn ' || turn || chr(10) || chr(10)
         || text || chr(10) || chr(10) || '## empty' || chr(10) || chr(10) || '# end' || chr(10)
         || 'Last line of ' || role || '.' || chr(10) AS text
  FROM conversations)"""

# Documents as one section each: the heading line is `# source`.
_DOC_BODY = f"""{_DOC_MD},
doc_body AS (
  SELECT doc_type, path, source AS title, source AS heading,
         {_strip("substr(text, strpos(substr(text, 4), '---') + 6)")} AS body
  FROM doc_md),
doc_section AS (
  SELECT *, length(heading) + 2 AS line_end,
         {_strip("substr(body, length(heading) + 4)")} AS content,
         length(heading) + 3 + {_blanks_before("substr(body, length(heading) + 4)")} AS text_start
  FROM doc_body)"""


def _packs(source: str, key: str, text: str, where: str = "TRUE") -> str:
    """Recursive greedy packing of the paragraphs of ``text`` per ``key``, with their offsets."""
    return f"""pieces_of AS (
  SELECT {key}, regexp_split_to_array({text}, '\\n\\n+') AS raw,
         regexp_extract_all({text}, '\\n\\n+') AS breaks
  FROM {source} WHERE {where}),
piece AS (
  SELECT {key}, u.i, raw[u.i] AS p, length(raw[u.i]) + coalesce(length(breaks[u.i]), 0) AS width
  FROM pieces_of, LATERAL (SELECT unnest(range(1, len(raw) + 1)) AS i) AS u),
laid AS (
  SELECT {key}, i, {_strip('p')} AS para,
         coalesce(sum(width) OVER (PARTITION BY {key} ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_blanks_before('p')} AS lo
  FROM piece),
paras AS (
  SELECT {key}, list(para ORDER BY i) AS ps, list(lo ORDER BY i) AS los
  FROM laid WHERE para <> '' GROUP BY {key}),
walk AS (
  SELECT {key}, ps, los, 1 AS i, 0 AS pack, length(ps[1]) AS used FROM paras
  UNION ALL
  SELECT {key}, ps, los, i + 1,
         CASE WHEN used + length(ps[i + 1]) > 1500 THEN pack + 1 ELSE pack END,
         CASE WHEN used + length(ps[i + 1]) > 1500 THEN length(ps[i + 1])
              ELSE used + length(ps[i + 1]) END
  FROM walk WHERE i < len(ps)),
packs AS (
  SELECT {key}, pack, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS content,
         min(los[i]) AS lo, max(los[i] + length(ps[i])) AS hi
  FROM walk GROUP BY {key}, pack)"""


_CHUNKS = f"""{_DOC_BODY},
{_packs('doc_section', 'path', 'content', 'length(content) > 3000')},
pack_counts AS (SELECT path, count(*) AS n FROM packs GROUP BY path),
chunk AS (
  SELECT s.doc_type, s.path, 0 AS chunk_ord, s.title, s.heading, s.content,
         s.line_end + 1 AS char_start, length(s.body) AS char_end
  FROM doc_section s WHERE s.content <> '' AND length(s.content) <= 3000
  UNION ALL
  SELECT s.doc_type, s.path, p.pack, s.title,
         CASE WHEN c.n > 1 THEN s.heading || ' (part ' || (p.pack + 1) || ')' ELSE s.heading END,
         p.content, s.text_start + p.lo, s.text_start + p.hi
  FROM doc_section s JOIN packs p USING (path) JOIN pack_counts c USING (path)),
chunks AS (
  SELECT *, title || chr(10) || heading || chr(10) || content AS embed_text FROM chunk)"""


def _weights(source: str, key: str, text: str) -> str:
    """Feature-hashed unit vectors, sparse."""
    return f"""tokens AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS token FROM {source}),
counted AS (
  SELECT {key}, CAST('0x' || substr(sha256(token), 1, 6) AS BIGINT) % {EMBEDDING.dimensions} AS dim,
         count(*) AS n
  FROM tokens GROUP BY ALL),
weights AS (
  SELECT {key}, dim,
         CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS w
  FROM counted)"""


_VECTOR = "[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in QUERY_VECTOR) + "]"
_SCORED = (
    f"SELECT vec_id, label, round(list_cosine_similarity("
    f"list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {_VECTOR}), 12) AS score FROM embeddings"
)

# -- templated source files ---------------------------------------------------------

_PARTS = """parts AS (
  SELECT CAST(p_partkey AS VARCHAR) AS k, p_size AS s, p_name AS nm, lower(p_type) AS ty,
         6 + p_size AS l,
         'src/' || lower(p_type) || '/' || replace(p_brand, '#', '_') || '/part_' || p_partkey || '.py'
           AS path
  FROM part),
bodies AS (
  SELECT *,
    'LIMIT_' || k || ' = ' || s AS b0,
    'def price_' || k || '(qty, rate=0.5) -> float' AS s1,
    'def helper_' || k || '(v)' AS s2,
    'class Part' || k || '(Base)' AS s3,
    'SIZE = ' || s AS b4,
    '    \"\"\"Price of ' || nm || '.\"\"\"' || chr(10)
      || '    x = load(os.path.join(str(qty), np.abs(rate)))' || chr(10)
      || '    return helper_' || k || '(x).wrap(check(x)) + len(x)' AS r1,
    'def total(self):' || chr(10) || '        return self.items.sum() + price_' || k
      || '(1) + self.add(2)' AS b5,
    'async def add(self, n):' || chr(10) || '        super().add(n)' || chr(10)
      || '        return helper_' || k || '(price_' || k || '(n))' AS b6
  FROM parts),
elements AS (
  SELECT path, 0 AS elem_ord, NULL::INT AS parent_ord, 0 AS depth, 'constant' AS kind,
         'LIMIT_' || k AS name, 'LIMIT_' || k AS scope_path, b0 AS signature, '' AS decorators,
         NULL AS docstring, 5 AS line_start, 5 AS line_end, b0 AS body FROM bodies
  UNION ALL SELECT path, 1, NULL, 0, 'function', 'price_' || k, 'price_' || k, s1, '',
         'Price of ' || nm || '.', l + 1, l + 4, s1 || ':' || chr(10) || r1 FROM bodies
  UNION ALL SELECT path, 2, NULL, 0, 'function', 'helper_' || k, 'helper_' || k, s2, '', NULL,
         l + 6, l + 7, s2 || ':' || chr(10) || '    return store(v)' FROM bodies
  UNION ALL SELECT path, 3, NULL, 0, 'class', 'Part' || k, 'Part' || k, s3,
         '@register("' || nm || '")', NULL, l + 10, l + 19,
         s3 || ':' || chr(10) || '    ' || b4 || chr(10) || chr(10) || '    @property' || chr(10)
           || '    ' || b5 || chr(10) || chr(10) || '    ' || b6 FROM bodies
  UNION ALL SELECT path, 4, 3, 1, 'constant', 'SIZE', 'Part' || k || ' > SIZE', b4, '', NULL,
         l + 11, l + 11, b4 FROM bodies
  UNION ALL SELECT path, 5, 3, 1, 'method', 'total', 'Part' || k || ' > total', 'def total(self)',
         '@property', NULL, l + 14, l + 15, b5 FROM bodies
  UNION ALL SELECT path, 6, 3, 1, 'method', 'add', 'Part' || k || ' > add', 'def add(self, n)', '',
         NULL, l + 17, l + 19, b6 FROM bodies),
fns AS (
  SELECT path, k, ty, fn_ord, CASE fn_ord WHEN 0 THEN 'price_' || k WHEN 1 THEN 'helper_' || k
         WHEN 2 THEN 'Part' || k || '.total' ELSE 'Part' || k || '.add' END AS qualified_name
  FROM parts, (VALUES (0), (1), (2), (3)) v(fn_ord)),
call_rows AS (
  SELECT path, f.fn_ord, qualified_name AS caller, call_ord,
         replace(replace(c.name, '%k', k), '%t', ty) AS name,
         replace(c.resolved, '%t', ty) AS resolved
  FROM fns f JOIN (VALUES
    (0, 0, 'load', '.%t'), (0, 1, 'os.path.join', 'os.path'), (0, 2, 'np.abs', 'numpy'),
    (0, 3, 'check', NULL), (1, 0, 'store', NULL), (2, 0, 'Part%k.items.sum', 'self'),
    (2, 1, 'price_%k', 'local'), (2, 2, 'Part%k.add', 'self'), (3, 0, 'helper_%k', 'local'),
    (3, 1, 'price_%k', 'local')) c(fn_ord, call_ord, name, resolved) ON f.fn_ord = c.fn_ord),
edges AS (
  SELECT path, name AS callee, caller, fn_ord, call_ord FROM call_rows
  WHERE resolved IN ('local', 'self')),
fn_stats AS (
  SELECT path, fn_ord, qualified_name,
    (SELECT count(*) FROM call_rows c WHERE c.path = f.path AND c.fn_ord = f.fn_ord) AS calls_count,
    (SELECT count(*) FROM edges e WHERE e.path = f.path AND e.callee = f.qualified_name)
      AS callers_count
  FROM fns f)"""

# Files of orders: every definition from its own row, its predecessor and a running count.
_ORDERS = """placed AS (
  SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr, year(o_orderdate) AS yr,
    CASE WHEN o_orderkey % 10 = 0 THEN 'pkg/common.py'
         ELSE 'pkg/n' || c_nationkey || '/c' || c_custkey || '.py' END AS path,
    CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE c_nationkey END AS nation,
    o_orderkey % 10 <> 0 AND c_acctbal < -900 AS broken
  FROM orders JOIN customer ON o_custkey = c_custkey),
laid AS (
  SELECT *, coalesce(lag(k) OVER o, k) AS p, coalesce(lag(st) OVER o, st) AS pst,
    coalesce(sum(CASE st WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END) OVER b, 0) AS fn0,
    coalesce(sum(CASE st WHEN 'O' THEN 4 ELSE 1 END) OVER b, 0) AS el0,
    coalesce(sum(CASE st WHEN 'F' THEN 5 WHEN 'O' THEN 11 ELSE 2 END) OVER b, 0)
      + CASE WHEN nation % 2 = 0 THEN 7 ELSE 5 END AS l
  FROM placed WHERE NOT broken
  WINDOW o AS (PARTITION BY path ORDER BY k),
         b AS (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
order_fns AS (
  SELECT *, fn0 AS fn_ord, CASE st WHEN 'F' THEN 'f_' || k ELSE 'K_' || k || '.run' END AS qualified_name, 0 AS which
  FROM laid WHERE st IN ('F', 'O')
  UNION ALL SELECT *, fn0 + 1, 'K_' || k || '.step', 1 FROM laid WHERE st = 'O'),
order_calls AS (
  SELECT path, CAST(fn_ord AS INT) AS fn_ord, qualified_name AS caller, CAST(c.o AS INT) AS call_ord,
    CASE c.n WHEN 'before' THEN 'f_' || p WHEN 'missing' THEN 'missing_' || k WHEN 'step' THEN 'K_' || k || '.step'
      WHEN 'run' THEN 'K_' || k || '.run' WHEN 'class' THEN 'K_' || k WHEN 'go' THEN 'step_' || p || '.go' ELSE c.n END AS name,
    CASE c.n WHEN 'before' THEN CASE WHEN pst = 'F' THEN 'local' END
      WHEN 'save' THEN CASE WHEN nation % 2 = 0 THEN '.late' ELSE '.m' || nation END
      WHEN 'np.abs' THEN 'numpy' WHEN 'os.path.join' THEN 'os.path' WHEN 'class' THEN 'local'
      WHEN 'step' THEN 'self' WHEN 'run' THEN 'self' END AS resolved,
    c.n IN ('step', 'run') OR (c.n = 'before' AND pst = 'F') AS wired
  FROM order_fns f JOIN (VALUES ('F', 0, 0, 'save'), ('F', 0, 1, 'np.abs'), ('F', 0, 2, 'before'), ('F', 0, 3, 'missing'),
    ('O', 0, 0, 'step'), ('O', 0, 1, 'before'), ('O', 0, 2, 'run'),
    ('O', 1, 0, 'class'), ('O', 1, 1, 'os.path.join'), ('O', 1, 2, 'go')) c(st, w, o, n) ON f.st = c.st AND f.which = c.w)"""

_ORDER_ELEMENTS = """
SELECT path, CAST(el0 + e AS INT) AS elem_ord, CAST(CASE WHEN e > 0 THEN el0 ELSE -1 END AS INT) AS parent_ord,
  CAST(CASE WHEN e > 0 THEN 1 ELSE 0 END AS INT) AS depth, kind, replace(n, '%', CAST(k AS VARCHAR)) AS name,
  CASE WHEN e > 0 THEN 'K_' || k || ' > ' ELSE '' END || replace(n, '%', CAST(k AS VARCHAR)) AS scope_path,
  replace(replace(s, '%k', CAST(k AS VARCHAR)), '%y', CAST(yr AS VARCHAR)) AS signature,
  CASE kind WHEN 'class' THEN '@register("' || pr || '")' ELSE '' END AS decorators,
  CASE kind WHEN 'function' THEN 'Handles ' || pr || '.' END AS docstring,
  CAST(l + a AS INT) AS line_start, CAST(l + b AS INT) AS line_end
FROM laid JOIN (VALUES ('F', 0, 'function', 'f_%', 'def f_%k(a, b=%y)', 0, 3),
  ('O', 0, 'class', 'K_%', 'class K_%k(Base)', 1, 9), ('O', 1, 'constant', 'YEAR', 'YEAR = %y', 2, 2),
  ('O', 2, 'method', 'run', 'def run(self)', 4, 5), ('O', 3, 'method', 'step', 'def step(self, n)', 7, 9),
  ('P', 0, 'constant', 'LIMIT_%', 'LIMIT_%k = %y', 0, 0)) v(st, e, kind, n, s, a, b) ON laid.st = v.st"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Source of every part file, the greedy walk over its folder, its prompt.
_PROMPTS = f"""sources AS (
  SELECT b.path, regexp_replace(b.path, '/[^/]*$', '') AS dir, k,
    'import os.path' || chr(10) || 'import numpy as np' || chr(10) || 'from .' || ty
      || ' import load, save as store' || chr(10) || chr(10) || b0 || chr(10) || 'rate = 0.5' || chr(10)
      || repeat('# ' || nm || chr(10), s) || e1.body || chr(10) || chr(10) || e2.body || chr(10) || chr(10)
      || '@register("' || nm || '")' || chr(10) || e3.body || chr(10) AS src
  FROM bodies b
  JOIN elements e1 ON e1.path = b.path AND e1.elem_ord = 1
  JOIN elements e2 ON e2.path = b.path AND e2.elem_ord = 2
  JOIN elements e3 ON e3.path = b.path AND e3.elem_ord = 3),
item AS (
  SELECT *, length(src) AS n, row_number() OVER (PARTITION BY dir ORDER BY path) AS i FROM sources),
walk AS (
  SELECT dir, path, 0::BIGINT AS i, 0::BIGINT AS used, FALSE AS kept, '' AS other FROM item
  UNION ALL
  SELECT w.dir, w.path, x.i, w.used + CASE WHEN x.path <> w.path AND w.used + x.n <= 50000 THEN x.n ELSE 0 END,
         x.path <> w.path AND w.used + x.n <= 50000, x.path
  FROM walk w JOIN item x ON x.dir = w.dir AND x.i = w.i + 1),
near AS (
  SELECT w.path, string_agg('### ' || x.path || chr(10) || '```' || chr(10) || x.src || chr(10) || '```'
           || chr(10), '' ORDER BY w.i) AS text
  FROM walk w JOIN item x ON x.path = w.other WHERE w.kept GROUP BY w.path),
bullets AS (
  SELECT path, string_agg(repeat('  ', depth) || '- **' || scope_path || '** (' || kind || ') — `'
           || signature || '`', chr(10) ORDER BY elem_ord) AS text
  FROM elements GROUP BY path),
made AS (
  SELECT s.path, 'This is the file `' || s.path || '` of `{PROJECT}`.' || chr(10)
    || chr(10) || '## Architecture' || chr(10) || chr(10) || {_quote(ARCHITECTURE_TEXT)} || chr(10)
    || coalesce(chr(10) || '## Files next to it' || chr(10) || chr(10) || n.text, '')
    || chr(10) || '### ' || s.path || chr(10) || '```python' || chr(10) || src || chr(10) || '```' || chr(10)
    || {_quote(ELEMENTS_TASK)} || b.text || chr(10)
    || chr(10) || '## Known callers' || chr(10) || chr(10)
    || '- `price_' || k || '` is called by: `Part' || k || '.total` (' || s.path || '), `Part' || k
    || '.add` (' || s.path || ')' || chr(10)
    || '- `helper_' || k || '` is called by: `Part' || k || '.add` (' || s.path || ')' || chr(10)
    || '- `Part' || k || '.add` is called by: `Part' || k || '.total` (' || s.path || ')' || chr(10)
    || {_quote(ANSWER_FORMAT.format(lead="Begin with a paragraph on the duty of the file." + chr(10)))} AS prompt
  FROM sources s JOIN bullets b ON b.path = s.path LEFT JOIN near n ON n.path = s.path)"""

# -- answers --------------------------------------------------------------------------

_ANSWERS = """answer AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, regexp_split_to_array(regexp_replace(text,
           '\\n([A-Za-z]+)', chr(10) || '### `\\1`' || chr(10), 'g'), '\\n') AS ls
  FROM documents),
line AS (
  SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM answer),
grouped AS (
  SELECT *, starts_with(line, '### ') AS head,
         sum(CASE WHEN starts_with(line, '### ') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS g
  FROM line),
sections AS (
  SELECT path, g,
    max(CASE WHEN head THEN trim(trim(trim(substr(line, 5), ' ' || chr(9)), '`'), ' ' || chr(9)) END)
      AS scope_path,
    coalesce(trim(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i),
         ' ' || chr(9) || chr(10) || chr(13)), '') AS description
  FROM grouped GROUP BY path, g),
symbols AS (
  SELECT path, row_number() OVER (PARTITION BY path ORDER BY g) - 1 AS sym_ord, scope_path, description
  FROM sections WHERE g > 0 AND description <> ''),
doc AS (
  SELECT doc_id, regexp_split_to_array(text, '\\n') AS ls FROM documents JOIN labels USING (doc_id)),
doc_line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM doc),
elems AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, word AS scope_path, i AS elem_ord,
         'def ' || word || '()' AS signature, i AS line_start, i + length(line) AS line_end
  FROM (SELECT *, regexp_extract(line, '^([A-Za-z]+)', 1) AS word FROM doc_line)
  WHERE i > 0 AND word <> ''),
emap AS (
  SELECT path, scope_path, min(elem_ord) AS elem_ord, arg_max(signature, elem_ord) AS signature,
         arg_max(line_start, elem_ord) AS line_start, arg_max(line_end, elem_ord) AS line_end
  FROM elems GROUP BY path, scope_path),
matched AS (
  SELECT s.path, s.sym_ord, s.scope_path, CASE WHEN e.path IS NULL THEN 'unknown' ELSE 'function' END AS kind,
         e.signature, s.description, coalesce(e.line_start, 0) AS line_start,
         coalesce(e.line_end, 0) AS line_end
  FROM symbols s LEFT JOIN emap e ON s.path = e.path AND s.scope_path = e.scope_path)"""

_ARTICLE = """article AS (
  SELECT d.doc_id, '---' || chr(10) || 'title: "Document ' || d.doc_id || '"' || chr(10)
    || 'type: synthesis' || chr(10) || 'model: ' || d.lang || chr(10)
    || CASE WHEN quality = 1 THEN 'commit: abc1234' || chr(10) ELSE '' END
    || CASE WHEN toxic = 1 THEN 'commit_dirty: true' || chr(10) ELSE '' END
    || CASE WHEN quality IS NOT NULL THEN 'sources:' || chr(10) || '  docs/' || d.doc_id || ': '
         || substr(sha256(d.text), 1, 12) || chr(10) || '  langs/' || d.lang || ': '
         || substr(sha256(d.lang), 1, 12) || chr(10) ELSE '' END
    || '---' || chr(10) || chr(10) || '# Document ' || d.doc_id || chr(10) || chr(10) || d.text
    || chr(10) AS article, d.lang, d.text, quality
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

_STATUS = """labelled AS (
  SELECT source || '-' || lang || '-' || coalesce(CAST(quality AS VARCHAR), 'new') AS name, doc_id,
         substr(sha256(text), 1, 12) AS h, substr(sha256(upper(text)), 1, 12) AS old, toxic
  FROM documents LEFT JOIN labels USING (doc_id)),
status AS (
  SELECT name,
    count(toxic) = 0
    OR bool_or(toxic IS NULL)
    OR bool_or(coalesce(toxic = 1 AND h <> old, FALSE)) AS stale
  FROM labelled GROUP BY name)"""

_PAGES = """page_path AS (
  SELECT page_id, length(html) AS n_chars,
         CASE WHEN b LIKE '%.html' THEN b ELSE b || '.py' END AS path
  FROM (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          url, '^https?://', ''), '[?#].*$', ''), '/$', ''), '^www\\.', '.') AS b FROM pages)),
page_dir AS (
  SELECT *, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir
  FROM page_path)"""


def _greedy(directory: str) -> str:
    """Documents of a directory in path order."""
    return f"""item AS (
  SELECT {directory} AS dir, {directory} || '/' || doc_id AS path, length(text) AS n,
         row_number() OVER (PARTITION BY {directory} ORDER BY CAST(doc_id AS VARCHAR)) AS i
  FROM documents)"""


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["flagship_search"] = f"""WITH RECURSIVE {_CHUNKS},
{_weights("chunks", "path, chunk_ord", "'" + EMBEDDING.before_document + "' || embed_text")},
q AS (SELECT '{EMBEDDING.before_query}{QUERY_TEXT}' AS text),
q_count AS (
  SELECT CAST('0x' || substr(sha256(token), 1, 6) AS BIGINT) % {EMBEDDING.dimensions} AS dim, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM q) GROUP BY 1),
q_weight AS (SELECT dim, CAST(n / sqrt(sum(n * n) OVER ()) AS FLOAT) AS w FROM q_count),
dots AS (
  SELECT path, chunk_ord, sum(CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE)) AS dot
  FROM weights a JOIN q_weight b USING (dim) GROUP BY path, chunk_ord),
norms AS (
  SELECT path, chunk_ord, sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) AS norm
  FROM weights GROUP BY path, chunk_ord),
scores AS (
  SELECT c.*, round(coalesce(dot / norm /
           (SELECT sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) FROM q_weight), 0), 12) AS score
  FROM chunks c LEFT JOIN dots USING (path, chunk_ord) LEFT JOIN norms USING (path, chunk_ord))
SELECT path AS document, doc_type, title, heading, chunk_ord, content, round(scores.score, 4) AS score FROM scores
ORDER BY scores.score DESC, doc_type, path, chunk_ord LIMIT {TOP_K}"""

    sql["chunk_embeddings"] = f"""WITH RECURSIVE {_CHUNKS},
{_weights("chunks", "path, chunk_ord", "'" + EMBEDDING.before_document + "' || embed_text")}
SELECT path, chunk_ord, CAST(dim AS INT) AS dim, round(CAST(w AS DOUBLE), 4) AS weight FROM weights"""

    sql["vector_topk"] = (
        f"SELECT vec_id, round(s.score, 4) AS score FROM ({_SCORED}) AS s ORDER BY s.score DESC, vec_id LIMIT {TOP_K}"
    )
    ranked = f"""WITH scored AS ({_SCORED}),
sided AS (SELECT vec_id, score, CASE WHEN label < 5 THEN 0 ELSE 1 END AS side FROM scored),
cut AS (
  SELECT *, row_number() OVER (PARTITION BY side ORDER BY score DESC, vec_id) AS r FROM sided)"""
    sql["vector_topk_merged"] = f"""{ranked}
SELECT vec_id, round(cut.score, 4) AS score, side FROM cut WHERE r <= {TOP_K}
ORDER BY cut.score DESC, side, vec_id LIMIT {TOP_K}"""
    sql["source_selector"] = f"""{ranked}
SELECT vec_id, round(score, 4) AS score, CASE side WHEN 0 THEN 'docs' ELSE 'code' END AS source, side
FROM cut WHERE r <= {TOP_K}"""
    sql["vector_norms"] = """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding,
  lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings"""

    sql["chunk_markdown"] = f"""WITH RECURSIVE {_CHUNKS}
SELECT path, chunk_ord, title, heading, content, CAST(char_start AS INT) AS char_start,
  CAST(char_end AS INT) AS char_end, embed_text FROM chunks"""

    # every turn has the same headings, so its sections are known by position
    turn_parts = f"""{_TURN_MD},
pieces AS (
  SELECT c.conv_id || '/' || c.turn AS path, c.text, c.role, c.conv_id, c.turn,
    'Opening of ' || conv_id || '.' || chr(10) || chr(10) AS p0,
    '# conversation ' || conv_id || chr(10) || chr(10) AS p1,
    '### aside' || chr(10) || chr(10) || 'Before the turn.' || chr(10) || chr(10) AS p2,
    '## ' || role || chr(10) || chr(10) AS p3,
    '### turn ' || turn || chr(10) || chr(10) || text || chr(10) || chr(10) AS p4,
    '## empty' || chr(10) || chr(10) AS p5,
    '# end' || chr(10) || 'Last line of ' || role || '.' || chr(10) AS p6
  FROM conversations c),
placed AS (
  SELECT *, length(p0) AS o1, length(p0 || p1) AS o2, length(p0 || p1 || p2) AS o3,
    length(p0 || p1 || p2 || p3) AS o4, length(p0 || p1 || p2 || p3 || p4) AS o5,
    length(p0 || p1 || p2 || p3 || p4 || p5) AS o6,
    length(p0 || p1 || p2 || p3 || p4 || p5 || p6) AS o7
  FROM pieces),
heads AS (
  SELECT path, 0 AS section_ord, 'conversation ' || conv_id AS heading, 1 AS level, o1 AS pos,
         o2 AS section_end, '' AS content FROM placed
  UNION ALL SELECT path, 1, 'conversation ' || conv_id || ' > aside', 3, o2, o3, 'Before the turn.' FROM placed
  UNION ALL SELECT path, 2, 'conversation ' || conv_id || ' > ' || role, 2, o3, o4, '' FROM placed
  UNION ALL SELECT path, 3, 'conversation ' || conv_id || ' > ' || role || ' > turn ' || turn, 3, o4, o5,
         {_strip('text')} FROM placed
  UNION ALL SELECT path, 4, 'conversation ' || conv_id || ' > empty', 2, o5, o6, '' FROM placed
  UNION ALL SELECT path, 5, 'end', 1, o6, o7, 'Last line of ' || role || '.' FROM placed)"""
    sql["heading_path"] = f"""WITH {turn_parts}
SELECT path, section_ord, heading, level, CAST(pos AS INT) AS pos,
  CAST(section_end AS INT) AS section_end FROM heads"""
    sql["chunk_turns"] = f"""WITH RECURSIVE {turn_parts},
{_packs('heads', 'path', 'content', 'length(content) > 3000')},
big AS (
  SELECT h.path, h.section_ord, p.pack, count(*) OVER (PARTITION BY h.path) AS n, h.heading, h.pos,
         p.content, p.lo, p.hi,
         h.pos + length('### turn ' || t.turn || chr(10) || chr(10)) + {_blanks_before('t.said')} AS text_start
  FROM heads h JOIN packs p USING (path)
  JOIN (SELECT conv_id || '/' || turn AS path, turn, text AS said FROM conversations) t USING (path)
  WHERE length(h.content) > 3000),
rows AS (
  SELECT path, -1 AS section_ord, 0 AS pack, '' AS heading, 'Opening of ' || conv_id || '.' AS content,
         0 AS char_start, o1 AS char_end FROM placed
  UNION ALL SELECT path, section_ord, 0, heading, content,
         pos + length(split_part(substr(t.text, pos + 1), chr(10), 1)) + 1, section_end
    FROM heads JOIN turn_md t USING (path) WHERE content <> '' AND length(content) <= 3000
  UNION ALL SELECT path, section_ord, pack,
         CASE WHEN n > 1 THEN heading || ' (part ' || (pack + 1) || ')' ELSE heading END, content,
         text_start + lo, text_start + hi FROM big)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY section_ord, pack) - 1 AS INT) AS chunk_ord,
       heading, content, CAST(char_start AS INT) AS char_start, CAST(char_end AS INT) AS char_end FROM rows"""

    sql["paragraph_pack"] = f"""WITH RECURSIVE src AS (
  SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),
{_packs('src', 'doc_id', 'text')}
SELECT doc_id, pack, content, CAST(lo AS INT) AS start, CAST(hi AS INT) AS "end" FROM packs"""

    sql["kb_documents"] = f"""WITH {_DOC_MD}, {_TURN_MD}
SELECT doc_type, path, source AS title, substr(sha256(text), 1, 12) AS content_hash FROM doc_md
UNION ALL SELECT doc_type, path, '', substr(sha256(text), 1, 12) FROM turn_md"""
    turn_chunks = sql["chunk_turns"].replace("WITH RECURSIVE ", "", 1)
    sql["index_stats"] = f"""SELECT 'article' AS doc_type, (SELECT count(*) FROM documents) AS documents,
  (SELECT count(*) FROM ({sql['chunk_markdown']})) AS chunks
UNION ALL SELECT 'description', (SELECT count(*) FROM conversations),
  (SELECT count(*) FROM (WITH RECURSIVE {turn_chunks}))"""

    sql["frontmatter_split"] = f"""WITH {_DOC_BODY}
SELECT path, 'title: "' || source || '"' || chr(10) || 'lang: ' || lang AS raw, source AS title,
  substr(sha256(body), 1, 12) AS body_hash,
  substr(sha256(CASE WHEN content = '' THEN body ELSE content END), 1, 12) AS content_hash
FROM doc_section JOIN doc_md USING (path)"""
    sql["frontmatter_scalars"] = """SELECT CAST(doc_id AS VARCHAR) AS path, 'title' AS key, source AS value
FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lang', lang FROM documents"""
    sql["article_render"] = f"WITH {_ARTICLE} SELECT doc_id, article FROM article"
    sql["sources_map"] = f"""WITH {_ARTICLE}
SELECT doc_id, 'docs/' || doc_id AS path, substr(sha256(text), 1, 12) AS hash FROM article
WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, 'langs/' || lang, substr(sha256(lang), 1, 12) FROM article
WHERE quality IS NOT NULL"""
    sql["content_hash"] = "SELECT doc_id, substr(sha256(text), 1, 12) AS content_hash FROM documents"
    sql["section_extract"] = f"""WITH {turn_parts}
SELECT path, {_strip('p3 || p4')} AS by_role, {_strip('p4')} AS by_turn, TRUE AS by_nothing_is_null
FROM pieces"""

    sql["path_columns"] = f"""WITH {_PAGES}
SELECT page_id, dir, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1) AS ext,
  CASE WHEN dir = '.' THEN '_root' ELSE replace(dir, '/', '_') END AS module_file,
  'flow-' || replace(lower(path), ' ', '-') AS flow_file
FROM page_dir"""
    flags = """regexp_matches(path, '(^|/)\\.') AS hidden,
  regexp_matches(path, '^.*/es/.*$') OR path LIKE '%spam%'
    OR regexp_matches(path, '/(tests|test|__pycache__|node_modules|build|dist)/') AS excluded,
  path LIKE '%.py' AS supported"""
    sql["glob_exclude"] = f"""WITH {_PAGES}, flagged AS (SELECT page_id, path, {flags} FROM page_path)
SELECT *, NOT hidden AND NOT excluded AND supported AS kept FROM flagged"""
    sql["dir_groups"] = f"""WITH {_PAGES}
SELECT dir, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM page_dir GROUP BY dir"""
    sql["project_size"] = """SELECT CAST(sum(length(text)) AS BIGINT) AS total_chars,
  sum(length(text)) > 400000 AS needs_batching FROM documents"""
    sql["neighbor_budget"] = f"""WITH RECURSIVE {_greedy('source')},
walk AS (
  SELECT dir, path, 0 AS i, 0::BIGINT AS n_neighbors, 0::BIGINT AS neighbor_chars, '' AS neighbors FROM item
  UNION ALL
  SELECT w.dir, w.path, w.i + 1,
    w.n_neighbors + CASE WHEN x.path <> w.path AND w.neighbor_chars + x.n <= 50000 THEN 1 ELSE 0 END,
    w.neighbor_chars + CASE WHEN x.path <> w.path AND w.neighbor_chars + x.n <= 50000 THEN x.n ELSE 0 END,
    CASE WHEN x.path <> w.path AND w.neighbor_chars + x.n <= 50000
         THEN w.neighbors || CASE WHEN w.neighbors = '' THEN '' ELSE ',' END || x.path
         ELSE w.neighbors END
  FROM walk w JOIN item x ON x.dir = w.dir AND x.i = w.i + 1)
SELECT path, n_neighbors, neighbor_chars, neighbors FROM walk w
WHERE i = (SELECT max(i) FROM item x WHERE x.dir = w.dir)"""
    sql["module_batches"] = f"""WITH RECURSIVE {_greedy('lang')},
walk AS (
  SELECT dir, path, i, n AS used, 0::BIGINT AS batch FROM item WHERE i = 1
  UNION ALL
  SELECT x.dir, x.path, x.i, CASE WHEN w.used + x.n > 300000 THEN x.n ELSE w.used + x.n END,
         CASE WHEN w.used + x.n > 300000 THEN w.batch + 1 ELSE w.batch END
  FROM walk w JOIN item x ON x.dir = w.dir AND x.i = w.i + 1)
SELECT path, batch FROM walk"""
    sql["first_occurrence"] = """SELECT user_id, event_type, min(event_id) AS first_ord,
  arg_max(value, event_id) AS last_value FROM events GROUP BY user_id, event_type"""

    described = """described AS (
  SELECT CAST(doc_id AS VARCHAR) AS path,
         substr(sha256(CASE WHEN quality = 1 THEN text ELSE upper(text) END), 1, 12) AS source_hash
  FROM documents JOIN labels USING (doc_id)),
current AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, substr(sha256(text), 1, 12) AS source_hash FROM documents)"""
    sql["stale_descriptions"] = f"""WITH {described}
SELECT path, source_hash FROM current EXCEPT SELECT path, source_hash FROM described"""
    sql["description_actions"] = f"""WITH {described}
SELECT count(d.path) AS cached, count(*) - count(d.path) AS generated
FROM current c LEFT JOIN described d ON c.path = d.path AND c.source_hash = d.source_hash"""
    sql["stale_articles"] = f"WITH {_STATUS} SELECT name, stale FROM status"
    sql["any_stale_article"] = f"WITH {_STATUS} SELECT bool_or(stale) AS any_stale FROM status"

    sql["response_split"] = f"""WITH {_ANSWERS}
SELECT path, description AS summary FROM sections WHERE g = 0"""
    sql["response_match"] = f"""WITH {_ANSWERS}
SELECT path, CAST(sym_ord AS INT) AS sym_ord, scope_path, kind, signature, description,
  CAST(line_start AS INT) AS line_start, CAST(line_end AS INT) AS line_end FROM matched"""
    sql["missing_elements"] = f"""WITH {_ANSWERS}
SELECT e.path, e.scope_path, CAST(e.elem_ord AS INT) AS elem_ord FROM emap e
WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.path = e.path AND s.scope_path = e.scope_path)"""
    sql["description_render"] = f"""WITH {_ANSWERS},
raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS path,
         regexp_replace(text, '\\n([A-Za-z]+)', chr(10) || '### `\\1`' || chr(10), 'g') AS response
  FROM documents),
listed AS (
  SELECT path,
    string_agg('  - scope_path: "' || scope_path || '"' || chr(10) || '    kind: ' || kind || chr(10)
      || '    lines: ' || line_start || '-' || line_end, chr(10) ORDER BY sym_ord) AS fm,
    string_agg('## `' || scope_path || '`' || coalesce(' — `' || signature || '`', '') || chr(10)
      || chr(10) || description || chr(10), chr(10) ORDER BY sym_ord) AS body
  FROM matched GROUP BY path)
SELECT r.path, '---' || chr(10) || 'source: ' || r.path || chr(10) || 'source_hash: '
    || substr(sha256(response), 1, 12) || chr(10) || 'model: template' || chr(10)
    || coalesce('symbols:' || chr(10) || fm || chr(10), '') || '---' || chr(10) || chr(10)
    || '# ' || r.path || chr(10) || chr(10) || s.description || chr(10)
    || coalesce(chr(10) || body, '') AS markdown
FROM raw r JOIN sections s ON s.path = r.path AND s.g = 0 LEFT JOIN listed l ON l.path = r.path"""
    markup = "[*_`#\\d.)\\-]+\\s*"
    sql["flow_parse"] = f"""WITH answer AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, '1. FLOW: ' || regexp_replace(text, '\\n([^\\n]*)\\n',
           chr(10) || 'TRACE: \\1' || chr(10) || 'FLOW: ', 'g') || chr(10) || 'TRACE: end' AS response
  FROM documents),
listed AS (SELECT path, regexp_split_to_array(response, '\\n') AS ls FROM answer),
line AS (
  SELECT path, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM listed),
clean AS (
  SELECT path, i, {_strip(f"regexp_replace({_strip('line')}, '{markup}', '')")} AS line FROM line),
labelled AS (
  SELECT path, i, upper(substr(line, 1, 5)) = 'FLOW:' AS is_flow,
    CASE WHEN upper(substr(line, 1, 5)) = 'FLOW:' THEN trim({_strip('substr(line, 6)')}, '*_`')
         ELSE trim({_strip('substr(line, 7)')}, '*_`') END AS value
  FROM clean WHERE upper(substr(line, 1, 5)) = 'FLOW:' OR upper(substr(line, 1, 6)) = 'TRACE:'),
paired AS (
  SELECT *, lag(is_flow) OVER w AS after_flow, lag(value) OVER w AS name
  FROM labelled WINDOW w AS (PARTITION BY path ORDER BY i))
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INT) AS flow_ord, name,
       value AS description
FROM paired WHERE NOT is_flow AND after_flow AND name <> ''"""
    sql["verdict_parse"] = """SELECT conv_id, turn, NOT (role <> 'user' AND turn > 2) AS regenerate
FROM conversations"""
    sql["token_budget"] = f"""WITH {_ANSWERS}
SELECT path, count(*) AS n_elements,
  CAST(least(greatest(count(*) * 100, 4096), 16384) AS BIGINT) AS max_tokens FROM elems GROUP BY path"""

    code = {
        "py_elements": """SELECT path, elem_ord, coalesce(parent_ord, -1) AS parent_ord, depth, kind, name, scope_path, signature,
  decorators, docstring, line_start, line_end FROM elements""",
        "py_raw_imports": """SELECT path, import_ord, replace(raw, '%t', ty) AS raw
FROM parts, (VALUES (0, 'import os.path'), (1, 'import numpy as np'),
  (2, 'from .%t import load, save as store')) v(import_ord, raw)""",
        "py_imports": """SELECT path, import_ord, replace(module, '%t', ty) AS module, names, alias
FROM parts, (VALUES (0, 'os.path', '', NULL), (1, 'numpy', '', 'np'),
  (2, '.%t', 'load,save', NULL)) v(import_ord, module, names, alias)""",
        "call_resolution": """SELECT path, fn_ord, caller, call_ord, name, resolved,
  coalesce(resolved IN ('local', 'self'), FALSE) AND name NOT LIKE '%.items.sum' AS wired FROM call_rows""",
        "caller_inversion": "SELECT path, callee, caller, fn_ord, call_ord FROM edges",
        "edge_count": "SELECT count(*) AS edges FROM edges",
        "function_stats": "SELECT path, fn_ord, qualified_name, calls_count, callers_count FROM fn_stats",
        "file_graph_stats": """SELECT path, count(*) AS functions, CAST(sum(callers_count) AS BIGINT) AS total_callers,
  CAST(sum(calls_count) AS BIGINT) AS total_calls FROM fn_stats GROUP BY path""",
        "file_callers": """SELECT path, callee, caller FROM edges e
WHERE EXISTS (SELECT 1 FROM fns f WHERE f.path = e.path AND f.qualified_name = e.callee)""",
        "code_chunks": """SELECT path, elem_ord AS chunk_ord, scope_path AS heading, body AS content,
  line_start AS char_start, line_end AS char_end,
  path || ' > ' || scope_path || chr(10) || body AS embed_text FROM elements WHERE kind <> 'constant'""",
        "code_documents": """SELECT 'code' AS doc_type, path, '' AS title, substr(sha256(body), 1, 12) AS content_hash
FROM elements WHERE elem_ord = 1""",
        "skeleton": """SELECT path, '### ' || path || chr(10) || '```' || chr(10) || 'import os.path' || chr(10)
  || 'import numpy as np' || chr(10) || 'from .' || ty || ' import load, save as store' || chr(10) || chr(10)
  || lines || chr(10) || '```' || chr(10) AS skeleton
FROM parts JOIN (
  SELECT path, string_agg(repeat('  ', depth) || signature
    || coalesce('  \"\"\"' || docstring || '\"\"\"', ''), chr(10) ORDER BY elem_ord) AS lines
  FROM elements GROUP BY path) USING (path)""",
        "element_list": """SELECT path, elem_ord, repeat('  ', depth) || '- **' || scope_path || '** (' || kind
  || ')' || coalesce(' — `' || signature || '`', '') AS bullet FROM elements""",
    }
    code["symbol_context"] = """SELECT f.path, f.fn_ord, f.qualified_name,
  coalesce((SELECT string_agg(caller, ',' ORDER BY fn_ord, call_ord) FROM edges e
    WHERE e.path = f.path AND e.callee = f.qualified_name), '') AS callers,
  (SELECT string_agg(name || '=' || coalesce(resolved, '?'), ',' ORDER BY call_ord) FROM call_rows c
    WHERE c.path = f.path AND c.fn_ord = f.fn_ord) AS calls
FROM fns f"""
    code["file_list"] = f"""SELECT path, count(*) AS functions, CAST(sum(callers_count) AS BIGINT) AS total_callers,
  CAST(sum(calls_count) AS BIGINT) AS total_calls FROM fn_stats GROUP BY path
UNION ALL SELECT path, 0, 0, 0 FROM (WITH {_PAGES} SELECT path FROM page_path)"""
    sql["describe_prompts"] = f"""WITH RECURSIVE {_PARTS},
{_PROMPTS}
SELECT path, prompt, CAST(4096 AS INT) AS max_tokens FROM made"""
    sql["path_order"] = f"""WITH {_PAGES}
SELECT page_id, path, CAST(row_number() OVER (PARTITION BY split_part(path, '/', 1)
  ORDER BY string_split(path, '/'), page_id) AS INT) AS rank FROM page_path"""
    sql["file_pieces"] = """WITH cut AS (
  SELECT source || '/' || doc_id AS path, lang, text,
         greatest(length(text) - 1, 0) // 1000 + 1 AS n,
         unnest(range(0, greatest(length(text) - 1, 0) // 1000 + 1)) AS piece
  FROM documents)
SELECT path, CAST(piece AS INT) AS piece, CAST(n AS INT) AS n_pieces,
  '### ' || path || CASE WHEN n = 1 THEN '' ELSE ' (part ' || (piece + 1) || ' of ' || n || ')' END
  || chr(10) || '```' || lang || chr(10) || substr(text, piece * 1000 + 1, 1000) || chr(10) || '```' || chr(10)
  AS block FROM cut"""
    for name, body in code.items():
        sql[name] = f"WITH {_PARTS}\n{body}"
    sql["stored_search"] = f"""SELECT document, doc_type, title, heading, content, score
FROM ({sql['flagship_search']})"""
    # the marks are lines that only one version has, and all other lines are common
    sql["source_changes"] = """WITH sized AS (
  SELECT doc_id, len(string_split(text, chr(10))) AS n, doc_id % 50 AS r FROM documents)
SELECT 'docs/' || doc_id AS path, CASE r WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'changed' END AS status,
  CASE r WHEN 2 THEN 0 WHEN 1 THEN n + n // 5 ELSE n // 5 END AS added,
  CASE r WHEN 1 THEN 0 WHEN 2 THEN n + n // 3 ELSE n // 3 END AS removed
FROM sized WHERE r IN (1, 2) OR n >= 3"""
    sql["answer_loop"] = f"""SELECT doc_id, CASE WHEN doc_id % {FAIL_EVERY} = 0 THEN 'failed' ELSE 'answered' END AS state,
  CAST(CASE WHEN doc_id % {FAIL_EVERY} = 0 THEN 3 ELSE 1 END AS INT) AS attempts,
  CASE WHEN doc_id % {FAIL_EVERY} <> 0 THEN 'Generated text ' || substr(sha256(text), 1, 8) || '.' || chr(10) END AS response,
  CASE WHEN doc_id % {FAIL_EVERY} = 0 THEN 'TimeoutError: no answer to ' || doc_id END AS error FROM documents"""
    sql["tree_round_trip"] = """WITH placed AS (
  SELECT page_id, html, CASE WHEN page_id % 13 = 0 OR page_id % 17 = 0 OR page_id % 19 = 0 THEN NULL
    WHEN page_id % 7 = 0 THEN 'src/hot' ELSE 'src/d' || page_id % 11 || '/e' || page_id % 3 END AS dir FROM pages)
SELECT dir || '/__page_' || page_id || '.py' AS path, dir, 'python' AS language, CAST(length(html) AS INT) AS n_chars,
  substr(sha256(html), 1, 12) AS source_hash FROM placed WHERE dir IS NOT NULL"""
    sql["markdown_round_trip"] = f"""WITH {_DOC_MD}
SELECT doc_type, path || '.md' AS path, length(text) AS n_chars, substr(sha256(text), 1, 12) AS hash FROM doc_md"""
    sql["store_merge"] = f"""WITH sized AS (
  SELECT count(*) AS n, greatest(1, (count(*) + {MERGE_BUCKETS - 1}) // {MERGE_BUCKETS}) AS each FROM documents),
dealt AS (
  SELECT CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
      % greatest(1, (n + each - 1) // each) AS INT) AS bucket,
    doc_id % 100 = 0 AS hit, length(text) AS chars FROM documents, sized)
SELECT bucket, bool_or(hit) AS rewritten, count(*) AS listed, count(*) AS n_rows,
  CAST(sum(CAST(hit AS INT)) AS BIGINT) AS merged,
  CAST(sum(CASE WHEN hit THEN -chars - 1 ELSE chars END) AS BIGINT) AS chars FROM dealt GROUP BY bucket"""
    edges = "resolved IN ('local', 'self')"
    ordered = {
        "order_calls": "SELECT path, fn_ord, caller, call_ord, name, resolved, wired FROM order_calls",
        "order_callers": "SELECT path, name AS callee, caller FROM order_calls WHERE wired",
        "order_caller_inversion": f"SELECT path, name AS callee, caller, fn_ord, call_ord FROM order_calls WHERE {edges}",
        "order_function_stats": f"""SELECT path, CAST(f.fn_ord AS INT) AS fn_ord, qualified_name, made.n AS calls_count,
  coalesce(got.n, 0) AS callers_count FROM order_fns f
JOIN (SELECT path, fn_ord, count(*) AS n FROM order_calls GROUP BY ALL) made USING (path, fn_ord)
LEFT JOIN (SELECT path, name AS qualified_name, count(*) AS n FROM order_calls WHERE {edges} GROUP BY ALL) got
  USING (path, qualified_name)""",
        "order_elements": _ORDER_ELEMENTS,
        "stored_symbols": f"""SELECT qualified_name AS symbol, kind, name, resolved FROM (
  SELECT f.qualified_name, 'caller' AS kind, c.caller AS name, NULL AS resolved FROM order_fns f
  JOIN order_calls c ON c.path = f.path AND c.name = f.qualified_name AND c.{edges} WHERE f.path = '{COMMON_FILE}' AND f.fn_ord < {LOOKED_UP}
  UNION ALL SELECT f.qualified_name, 'call', c.name, c.resolved FROM order_fns f
  JOIN order_calls c ON c.path = f.path AND c.fn_ord = f.fn_ord WHERE f.path = '{COMMON_FILE}' AND f.fn_ord < {LOOKED_UP})""",
    }
    for name, body in ordered.items():
        sql[name] = f"WITH {_ORDERS}\n{body}"
    return sql
