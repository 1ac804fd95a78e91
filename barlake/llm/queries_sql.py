"""DuckDB equivalents of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
lengths AS (SELECT DISTINCT n FROM items),
places AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, p.n, i, item_id FROM places p JOIN windows v ON v.n = p.n AND v.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

OP6 = r"""
WITH sized AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    strlen(coalesce(text, '')) - (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))) AS solid,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g')) AS marks FROM documents),
keyed AS (SELECT doc_id, source, text_md5, CAST(size AS BIGINT) AS size, -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / (0.1 + 0.9 * (1 - marks / greatest(solid, 1))) AS key FROM sized),
sources AS (SELECT *, list_extract([5.0, 2.0, 1.0], CAST((r - 1) % 3 + 1 AS INTEGER))::DOUBLE AS w, 2.0::DOUBLE * s AS cap FROM (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM keyed GROUP BY source)),
tried AS (SELECT *, cap / w AS level, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam FROM sources),
water AS (SELECT max(lam) AS water FROM tried WHERE level = (SELECT min(level) FROM tried WHERE lam <= level * (1 + 1e-12))),
targets AS (SELECT source, s, r, least(cap, water * w) AS target, CASE WHEN s > 0 THEN floor(least(cap, water * w) / s + 1e-9) ELSE 0 END AS epochs FROM tried, water),
placed AS (SELECT doc_id, size, s, target, epochs, target - epochs * s AS rest, coalesce(sum(size) OVER (PARTITION BY r ORDER BY key, doc_id NULLS FIRST, text_md5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target, CAST(size * (epochs + CASE WHEN epochs < 2 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""

OP8 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT y.doc_id, k, line, s.first_doc IS NOT NULL AND s.first_doc < y.doc_id AS gone FROM keyed y LEFT JOIN shared s ON s.key = y.key)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""

#: CRC-32 bit by bit: a character is added, then eight shifts follow.
_HARM = """xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20"""

#: Edits are found from a conversation's end, a recursion step a row: v0 to v3 are the best {cost, audit} from each grammar state, as structs that
#: compare by cost and then by audit. Roles follow by counting the audit's letters forward.
OP11 = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
harmed AS (SELECT *, {_HARM} AS harm FROM keyed),
left_over AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS again FROM harmed WHERE harm <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again) AS k FROM left_over),
seen AS (SELECT conv_id, role, text, min(k) AS first_k FROM placed GROUP BY ALL),
faulty AS (SELECT p.*, substr(p.role, 1, 1) AS i, CASE WHEN NOT regexp_matches(p.text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN first_k < k THEN 'duplicate' WHEN NOT regexp_matches(p.text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
    FROM placed p JOIN seen s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.role = p.role AND s.text = p.text),
sizes AS (SELECT conv_id, max(k) AS n FROM faulty GROUP BY conv_id),
back AS (
    SELECT conv_id, n AS k, {{'c': 0, 'a': ''}} AS v0, {{'c': 10, 'a': 'II'}} AS v1, {{'c': 5, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM sizes
    UNION ALL
    SELECT conv_id, k, list_min([b0, {{'c': 5 + w2.c, 'a': 'I' || w2.a}}]), list_min([b1, {{'c': 5 + w2.c, 'a': 'I' || w2.a}}]), w2, w3 FROM (
        SELECT *, list_min([b2, {{'c': 5 + b3.c, 'a': 'I' || b3.a}}]) AS w2, list_min([b3, {{'c': 5 + b2.c, 'a': 'I' || b2.a}}]) AS w3 FROM (
            SELECT b.conv_id, b.k - 1 AS k,
                list_min([{{'c': 2 + v0.c, 'a': 'D' || v0.a}}, {{'c': keep + CASE f.i WHEN 's' THEN v1.c WHEN 'u' THEN v2.c ELSE 1000000000 END, 'a': 'K' || CASE f.i WHEN 's' THEN v1.a ELSE v2.a END}}, {{'c': keep + 1 + v2.c, 'a': 'R' || v2.a}}]) AS b0,
                list_min([{{'c': 2 + v1.c, 'a': 'D' || v1.a}}, {{'c': keep + CASE f.i WHEN 'u' THEN v2.c ELSE 1000000000 END, 'a': 'K' || v2.a}}, {{'c': keep + 1 + v2.c, 'a': 'R' || v2.a}}]) AS b1,
                list_min([{{'c': 2 + v2.c, 'a': 'D' || v2.a}}, {{'c': keep + CASE f.i WHEN 'a' THEN v3.c ELSE 1000000000 END, 'a': 'K' || v3.a}}, {{'c': keep + 1 + v3.c, 'a': 'R' || v3.a}}]) AS b2,
                list_min([{{'c': 2 + v3.c, 'a': 'D' || v3.a}}, {{'c': keep + CASE f.i WHEN 'u' THEN v2.c ELSE 1000000000 END, 'a': 'K' || v2.a}}, {{'c': keep + 1 + v2.c, 'a': 'R' || v2.a}}]) AS b3
            FROM back b JOIN (SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS keep FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.k = b.k WHERE b.k > 0))),
best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM back WHERE k = 0),
letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS e, audit FROM best WHERE audit <> ''),
rowed AS (SELECT conv_id, p, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS k FROM letters),
lined AS (SELECT r.conv_id, p, e, f.role, f.i, f.text FROM rowed r LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k AND e <> 'I' WHERE e <> 'D'),
firsts AS (SELECT conv_id, arg_min(e = 'K' AND i = 's', p) AS with_system FROM lined GROUP BY conv_id),
counted AS (SELECT l.*, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) - CASE WHEN with_system THEN 1 ELSE 0 END AS q FROM lined l JOIN firsts s ON s.conv_id IS NOT DISTINCT FROM l.conv_id),
joined AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS h FROM counted GROUP BY conv_id),
steps AS (SELECT a.conv_id, count(*) FILTER (a.i || b.i NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty a JOIN faulty b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.k = a.k + 1 GROUP BY a.conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM faulty GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM d.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM d.conv_id
"""

ORACLES: dict[str, str] = {"op5_decontamination": OP5, "op6_source_mix": OP6, "op8_line_dedup": OP8, "op11_conversation_repair": OP11}
