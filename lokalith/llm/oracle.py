"""DuckDB SQL of the queries on spelling, conversations and URLs: the same rows by plain joins and recursion."""

from __future__ import annotations

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The table of CRC-32 by its rule, and the checksum of the bytes listed in a column ``b``.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda x, i: xor(x >> 1, CASE WHEN (x & 1) = 1 THEN 3988292384 ELSE 0 END))) AS crc)"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])))"
_HEX = "hex(encode({0}))"
_BYTES = "list_transform(range(0, length({0}) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr({0}, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr({0}, 2 * i + 2, 1)) - 1 AS BIGINT))"

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_LOW}), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
known AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
keyed AS (SELECT run, k, {_HEX.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS hx FROM known),
hashed AS (SELECT run, k, {_CRC} AS h FROM (SELECT run, k, {_BYTES.format("hx")} AS b FROM keyed), crc_table),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
gone AS (SELECT word, i, substr(word, 1, i) AS l, substr(word, i + 2) AS r FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
         UNION SELECT a.word, v.word FROM gone a JOIN v ON a.l || a.r = v.word
         UNION SELECT v.word, a.word FROM gone a JOIN v ON a.l || a.r = v.word),
best AS (SELECT near.word, other, v.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near,
                row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, other) AS place FROM near JOIN v ON v.word = other),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n
          FROM v LEFT JOIN best ON best.word = v.word AND place = 1),
steps AS (SELECT word, form AS here, 1 AS depth FROM forms WHERE form IS NOT NULL
          UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN forms f ON f.word = s.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, depth) AS root FROM steps GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)"""


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _arc(label: str, cost: str, line: str, to: str) -> str:
    return f"{{'c': {to}.c + {cost}, 'l': '{label}' || {to}.l, 'o': {line} || {to}.o}}"


def _steps() -> tuple[str, str, str]:
    """One row composed with the grammar at each state, and two rounds of insertions; ``q``, ``y``, ``z`` are lists of four weights."""
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    role = {2: "user", 3: "assistant"}
    rows = []
    for s in range(4):
        options = [_arc("D", "2", "''", f"b[{s + 1}]")]
        options += [_arc("K", f"CASE WHEN fault IN ('blank', 'duplicate') OR left(role, 1) <> '{x}' THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END", "chr(10) || role || ':' || text", f"b[{t + 1}]") for x, t in kept[s].items()]
        options.append(_arc("R", "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 6 ELSE 1 END", f"chr(10) || '{role[to[s]]}:' || text", f"b[{to[s] + 1}]"))
        rows.append(_least(*options))
    inserted = lambda name: "[" + ", ".join(_least(f"{name}[{s + 1}]", _arc("I", "5", f"chr(10) || '{role[to[s]]}:'", f"{name}[{to[s] + 1}]")) for s in range(4)) + "]"
    return "[" + ", ".join(rows) + "]", inserted("q"), inserted("y")


_Q, _Y, _Z = _steps()
_END = "[{'c': 0, 'l': '', 'o': ''}, {'c': 10, 'l': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 5, 'l': 'I', 'o': chr(10) || 'assistant:'}, {'c': 0, 'l': '', 'o': ''}]"
_BLANK = r"\x20\x09-\x0D"

CONVERSATIONS = f"""
WITH RECURSIVE {_CRC_TABLE},
told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS f FROM (SELECT *, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM told), crc_table),
made AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM made),
rows AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_BLANK}]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][{_BLANK}]*$') THEN 'truncated' ELSE '' END AS fault,
                left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM placed),
walk AS (SELECT conv_id, max(pos) + 1 AS pos, {_END} AS b FROM rows GROUP BY conv_id
         UNION ALL
         SELECT conv_id, pos, {_Z} FROM (SELECT conv_id, pos, {_Y} AS y FROM (
           SELECT r.conv_id, r.pos, {_Q} AS q FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos - 1))),
best AS (SELECT conv_id, b[1].c AS cost, b[1].l AS audit, sha256(substr(b[1].o, 2)) AS repaired_sha256 FROM walk WHERE pos = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id"""

_LABEL = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
_SEPARATOR = "(?:[^a-z0-9_.%-]|$)"
URLS = rf"""
WITH sites(rule, host, path, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
                                                 ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
patterns(pattern, regex, verdict) AS (VALUES
  ('||adult-', '{_LABEL}adult-', 'block'), ('||xxx.', '{_LABEL}xxx[.]', 'block'), ('||free-bets.', '{_LABEL}free-bets[.]', 'block'), ('||casino.', '{_LABEL}casino[.]', 'block'),
  ('||spam-farm.', '{_LABEL}spam-farm[.]', 'block'), ('/wp-login.php|', '/wp-login[.]php$', 'block'), ('^phpsessid=*', '{_SEPARATOR}phpsessid=', 'block'), ('.exe|', '[.]exe$', 'block'),
  ('/cgi-bin/*?*=', '(?s)/cgi-bin/.*[?].*=', 'block'), ('|ftp://', '^ftp://', 'block'), ('/wp-login.php?action=help^', '/wp-login[.]php[?]action=help{_SEPARATOR}', 'allow'),
  ('||casino.*/history/', '(?s){_LABEL}casino[.].*/history/', 'allow')),
p AS (SELECT page_id, translate(coalesce(url, ''), {_LOW}) AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
a AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), {_LOW}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
s AS (SELECT page_id, a.host, a.path, low, (SELECT {{'r': rule, 'v': verdict}} FROM sites WHERE ('.' || a.host) LIKE ('%.' || sites.host) AND starts_with(a.path, sites.path) ORDER BY length(rule) DESC LIMIT 1) AS site,
             (SELECT {{'r': pattern, 'v': verdict}} FROM patterns WHERE regexp_matches(low, regex) ORDER BY verdict, pattern LIMIT 1) AS other FROM a)
SELECT page_id, host, path, site.r AS rule, coalesce(site.v, other.v, 'allow') AS verdict, CASE WHEN site IS NULL THEN other.r END AS pattern FROM s"""
