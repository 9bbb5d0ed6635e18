"""DuckDB SQL of the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

from . import secret_scan as S

LINE_DEDUP = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE l.doc_id > s.first_doc) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE s.k IS NULL OR l.doc_id = s.first_doc), '')) AS kept_sha256
FROM l LEFT JOIN shared s USING (k) GROUP BY l.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""

_MARKS = r"[\x{80}-\x{a9}\x{ab}-\x{b4}\x{b6}-\x{b9}\x{bb}-\x{bf}\x{d7}\x{f7}\x{2000}-\x{206f}\x{20a0}-\x{20cf}\x{2190}-\x{2bff}\x{3000}-\x{303f}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff0f}]+"

#: All pairs by shared shingles, then reachability; for tables of a few thousand documents.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, trim(coalesce(text, ''), E' \t\n\r\f\v') AS bare, regexp_extract_all(lower(regexp_replace(nfc_normalize(coalesce(text, '')), '{_MARKS}', ' ', 'g')), '[0-9a-z_\x{{80}}-\x{{10ffff}}]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(sh, '|' ORDER BY sh)) AS h FROM s GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, md5('bare ' || bare) FROM d WHERE len(w) = 0 AND bare <> ''
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k * 10 >= 8 * (a.n + b.n - k)
  UNION ALL SELECT a.doc_id, b.doc_id FROM n a JOIN n b ON a.h = b.h AND a.doc_id < b.doc_id WHERE a.n = 0
), links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, least(d.doc_id, coalesce(r.low, d.doc_id)) AS class_id, coalesce(min(n.doc_id) OVER (PARTITION BY coalesce(n.h, 'alone ' || d.doc_id)), d.doc_id) AS rep_id,
       coalesce(k.links, 0)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS low FROM reach GROUP BY x) r ON r.x = d.doc_id LEFT JOIN (SELECT x, count(*) AS links FROM links GROUP BY x) k ON k.x = d.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: str, pattern: str, group: int, table: str = "d", key: str = "doc_id", text: str = "t") -> str:
    """(key, kind, i, s, m, g): each match with its start, from the pieces between the matches."""
    p = _quoted(pattern)
    return f"""SELECT {key}, '{kind}' AS kind, i, m, g, sum(len(piece) + coalesce(len(before), 0)) OVER (PARTITION BY {key} ORDER BY i) AS s FROM (
      SELECT *, lag(m) OVER (PARTITION BY {key} ORDER BY i) AS before FROM (
        SELECT {key}, unnest(ms) AS m, unnest(gs) AS g, unnest(pieces[:len(ms)]) AS piece, unnest(range(len(ms))) AS i
        FROM (SELECT {key}, regexp_extract_all({text}, {p}) AS ms, regexp_extract_all({text}, {p}, {group}) AS gs, string_split_regex({text}, {p}) AS pieces FROM {table} WHERE regexp_matches({text}, {p}))))"""


def _secrets() -> str:
    repeats = "|".join(f"[{c}]{{6}}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_") + "|-{6}"
    allow = S.ALLOW.rpartition("|")[0] + "|" + repeats
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(S.KINDS))
    w = S.WINDOW
    has = lambda c: f"regexp_matches(x, '[{c}]')"
    classes = {
        "entropy_hex": f"part AND regexp_full_match(x, '[0-9a-fA-F]+') AND {has('0-9')}", "entropy_mixed": f"part AND {has('0-9')} AND {has('A-Z')} AND {has('a-z')}",
        "entropy_lower": f"part AND regexp_full_match(x, '[0-9a-z]+') AND {has('0-9')} AND {has('a-z')} AND {has('g-z')}", "entropy_upper": f"part AND regexp_full_match(x, '[0-9A-Z]+') AND {has('0-9')} AND {has('A-Z')} AND {has('G-Z')}",
        "entropy_letters": "NOT part",
    }
    high = " UNION ALL ".join(f"SELECT id, s, j, '{k}' AS kind FROM counted WHERE bits >= {S.THRESHOLDS[k]} - 1e-12 AND {c}" for k, c in classes.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (
  SELECT doc_id, kind, s, s + len(m) AS e FROM ({_found("assign", S.ASSIGN, 2)}) WHERE len(g) >= 6
  UNION ALL SELECT doc_id, kind, s, s + len(m) FROM ({_found("access", "AKIA[A-Z0-9]+", 0)}) WHERE len(m) >= 20
  UNION ALL SELECT doc_id, kind, s, s + len(m) FROM ({_found("hex", "[0-9a-f]{24,}", 0)})
),
candidate AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, part, i) AS id FROM (
    SELECT doc_id, i, s, m, true AS part FROM ({_found("candidate", S.CANDIDATE, 0)}) WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    UNION ALL SELECT doc_id, i, s, m, false FROM ({_found("letters", "[A-Za-z0-9]{20,}", 0)}) WHERE NOT regexp_matches(m, '[0-9]'))
),
allowed AS (SELECT id, s AS a, s + len(m) AS z FROM ({_found("allowed", allow, 0, "candidate", "id", "m")})),
windows AS (SELECT w.* FROM (SELECT id, s, part, j, substr(m, j::INT + 1, {w}) AS x FROM (SELECT *, unnest(range(len(m) - {w} + 1)) AS j FROM candidate)) w
            WHERE NOT EXISTS (SELECT 1 FROM allowed l WHERE l.id = w.id AND l.a < w.j + {w} AND w.j < l.z)),
counted AS (SELECT id, s, part, j, x, log2({w}) - sum(c * log2(c)) / {w} AS bits FROM (SELECT id, s, part, j, x, ch, count(*) AS c FROM (SELECT *, unnest(string_split(x, '')) AS ch FROM windows) GROUP BY ALL) GROUP BY ALL),
high AS ({high}),
islands AS (SELECT *, count(*) FILTER (WHERE j > p + {w}) OVER (PARTITION BY id, kind ORDER BY j) AS island FROM (SELECT *, lag(j) OVER (PARTITION BY id, kind ORDER BY j) AS p FROM high)),
added AS (SELECT doc_id, kind, s, e FROM (SELECT id, kind, any_value(s) + min(j) AS s, any_value(s) + max(j) + {w} AS e FROM islands GROUP BY id, kind, island) JOIN (SELECT id, doc_id FROM candidate) USING (id)),
free AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
spans AS (SELECT *, true AS own FROM base UNION ALL SELECT *, false FROM free),
joined AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c, count(*) FILTER (WHERE kind = 'hex') AS h,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, CASE kind {order} END, e) FILTER (WHERE own) AS b, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, CASE kind {order} END, e) AS every
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN joined USING (doc_id)
"""


SECRETS = _secrets()
