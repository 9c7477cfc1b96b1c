"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op5_mixing"] = r"""
WITH sizes AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sizes GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((rn - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM src
), r AS (
  SELECT *, cap / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER ()) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    (sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_w,
    row_number() OVER (ORDER BY ratio, source NULLS LAST) AS nth
  FROM r
), lev AS (
  SELECT min_by(remaining / open_w, nth) AS level FROM l WHERE remaining / open_w <= ratio
), goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM lev) * weight, cap)) AS target FROM r
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS expected,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 6))::BIGINT AS offs
  FROM goal
), pos AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM sizes
), cp AS (
  SELECT p.doc_id, p.size, e.source_size, e.target, p.source,
    ((k * expected + offs) // 16777216 - ((k - 1) * expected + offs) // 16777216)::BIGINT AS n_copies
  FROM pos p JOIN e ON p.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, n_copies * size AS taken, source, n_copies FROM cp
"""

SQL["op7_topk"] = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

SQL["op10_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(role) END AS role,
    replace(coalesce(text, ''), '<|', '< |') AS body, coalesce(text, '') AS raw
  FROM conversations
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, raw) - 1 AS nth FROM t
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), p AS (
  SELECT s.conv_id, s.speaker, o.nth, o.role = s.speaker AS own, o.body,
    '<|im_start|>' || CASE WHEN o.role = 'system' THEN 'system' WHEN o.role = s.speaker THEN 'assistant' ELSE 'user name=' || replace(o.role, '<|', '< |') END || chr(10) AS head
  FROM s JOIN o ON s.conv_id IS NOT DISTINCT FROM o.conv_id
), q AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS piece FROM p
), m AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM q
)
SELECT conv_id, speaker, (nth // 256)::BIGINT AS chunk, count(*) AS n_turns, min(begins) AS first_char, sum(length(piece))::BIGINT AS n_chars, sha256(string_agg(piece, '' ORDER BY nth)) AS text_sha256,
  coalesce(string_agg(CASE WHEN own THEN (begins + length(head)) || ':' || (begins + length(head) + length(body)) END, ',' ORDER BY nth), '') AS mask
FROM m GROUP BY conv_id, speaker, nth // 256
"""


def _url_sql(levels: int = 6) -> str:
    """The template tree, level by level, as for ``urls.judged``'s defaults; for
    paths of up to ``levels`` segments (the query itself knows no such bound)."""
    rate = "(b + 2.0::DOUBLE * prior) / (l + 2.0::DOUBLE)"
    parts = [r"""u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
)""", r"""h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)""", r"""v AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    array_to_string([CASE WHEN regexp_matches(x, '^[0-9]+(\.[A-Za-z]+)?$') THEN '{number}' WHEN regexp_matches(x, '^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$') THEN '{date}'
      WHEN regexp_matches(x, '^[0-9A-Fa-f-]{16,}$') THEN '{hex}' ELSE x END FOR x IN string_split(path, '/') IF x <> ''], '/') AS first
  FROM h
)""", r"""paths AS (
  SELECT host, first, count(*) AS n, sum((rule IS NOT NULL)::INT) AS labelled, sum(coalesce(rule IN ('example.org/en/1', 'example.org/es/', 'com/de/'), FALSE)::INT) AS blocked FROM v GROUP BY host, first
)""", "pr AS (SELECT coalesce(sum(blocked) / nullif(sum(labelled)::DOUBLE, 0), 0) AS prior FROM paths)", "r0 AS (SELECT *, string_split(first, '/') AS todo, '' AS made FROM paths)"]
    for i in range(levels):
        parts += [
            f"s{i} AS (SELECT *, todo[1] AS seg, array_to_string(todo[2:], '/') AS then_ FROM r{i} WHERE len(todo) > 0)",
            f"c{i} AS (SELECT host, made, seg, sum(n) AS n, sum(l) AS l, sum(b) AS b, max({{'n': n, 't': then_}}).t AS cont FROM (SELECT host, made, seg, then_, sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS l, sum(blocked)::BIGINT AS b FROM s{i} GROUP BY ALL) x GROUP BY host, made, seg)",
            f"d{i} AS (SELECT c.*, floor({rate} * 5) AS rate FROM c{i} c, pr)",
            f"g{i} AS (SELECT host, made, count(*) >= 8 AND count(*) * 2 >= sum(n) AS varies FROM d{i} GROUP BY host, made)",
            f"a{i} AS (SELECT host, made, cont, rate, min(seg) AS low, count(*) AS members FROM d{i} GROUP BY host, made, cont, rate)",
            f"n{i} AS (SELECT d.host, d.made, d.seg, CASE WHEN d.seg = '' THEN '' WHEN varies THEN '{{any}}' WHEN members > 1 AND NOT starts_with(d.seg, '{{') THEN '{{' || low || '|' || members || '}}' ELSE d.seg END AS name "
            f"FROM d{i} d JOIN g{i} g ON d.host = g.host AND d.made = g.made JOIN a{i} a ON d.host = a.host AND d.made = a.made AND d.cont = a.cont AND d.rate = a.rate)",
            f"r{i + 1} AS (SELECT s.host, s.first, s.n, s.labelled, s.blocked, s.todo[2:] AS todo, s.made || '/' || name AS made "
            f"FROM s{i} s JOIN n{i} n ON s.host = n.host AND s.made = n.made AND s.seg = n.seg)",
        ]
    ended = " UNION ALL ".join(f"SELECT host, first, labelled, blocked, made AS template FROM r{i + 1} WHERE len(todo) = 0" for i in range(levels))
    parts += [
        f"z AS ({ended})",
        "t AS (SELECT host, template, string_split(template, '/') AS way, sum(labelled)::BIGINT AS l, sum(blocked)::BIGINT AS b FROM z GROUP BY host, template)",
        f"w AS (SELECT host, array_to_string(way[1:i], '/') AS node, sum(l)::BIGINT AS l, sum(b)::BIGINT AS b FROM t, range(1, {levels + 2}) x(i) WHERE i <= len(way) GROUP BY ALL)",
        "p0 AS (SELECT host, template, way, prior AS v FROM t, pr)",
    ]
    for i in range(1, levels + 2):
        parts.append(
            f"p{i} AS (SELECT p.host, p.template, p.way, CASE WHEN len(p.way) >= {i} THEN (w.b + 2.0::DOUBLE * p.v) / (w.l + 2.0::DOUBLE) ELSE p.v END AS v "
            f"FROM p{i - 1} p LEFT JOIN w ON w.host = p.host AND w.node = array_to_string(p.way[1:{i}], '/') AND len(p.way) >= {i})"
        )
    parts.append(f"k AS (SELECT host, template, v > 0.5 AS rejected FROM p{levels + 1})")
    return "WITH " + ",\n".join(parts) + """
SELECT v.page_id, v.host, v.path, v.rule, CASE WHEN v.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN v.rule IS NOT NULL OR k.rejected THEN 'block' ELSE 'allow' END AS verdict, z.template
FROM v LEFT JOIN z ON v.host = z.host AND v.first = z.first LEFT JOIN k ON z.host = k.host AND z.template = k.template"""


SQL["op4_url_filters"] = _url_sql()
