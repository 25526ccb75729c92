"""DuckDB SQL for the training-data queries that SQL can express."""

OP2 = r"""
WITH r AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), b AS (
    SELECT *, greatest(0, floor(coalesce(turn, 0) / 1024))::BIGINT AS block, greatest(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), ceil(length(text) / 8))::BIGINT + 1 AS tokens FROM r
), k AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) - 1 AS seq FROM b
), t AS (
    SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id, block ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k
), w AS (
    SELECT *, before // 512 AS win, block = 0 AND seq = 0 AND role = 'system' AS sys, 16 + length(role) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g')) AS chars FROM t
), sp AS (
    SELECT conv_id, block, win, max(before + tokens) AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY block, win) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM w GROUP BY conv_id, block, win
), again AS (
    SELECT w.conv_id, w.chars FROM w JOIN sp USING (conv_id, block, win) WHERE nth < n AND before >= stop - 128 AND NOT sys
    UNION ALL SELECT w.conv_id, w.chars FROM w JOIN sp ON w.conv_id = sp.conv_id AND sp.nth > 1 WHERE sys
), extra AS (
    SELECT conv_id, sum(chars) AS chars FROM again GROUP BY conv_id
), a AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY block, seq) AS said, coalesce(string_agg(text, '' ORDER BY block, seq) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars
    FROM w GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(a.chars + coalesce(extra.chars, 0) AS BIGINT) AS formatted_chars
FROM a LEFT JOIN extra USING (conv_id)
"""

OP4 = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), rep AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_id FROM win) WHERE doc_id > first_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM rep
), kept AS (
    SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.j) AS t, count(*) AS n
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.j = g.j
    WHERE g.j IS NULL GROUP BY x.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
    SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p
), f AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP7 = r"""
WITH d AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
    FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP10 = r"""
WITH dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
), bw AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), pat AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT m FROM pat
), win AS (
    SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS p
    FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)
), hit AS (
    SELECT doc_id, item_id, m, i FROM win JOIN pat USING (m, p)
), words AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hit) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# Costs to go as a recursion from the last turn to the first (a row for each turn, four states), the walk as one from the first turn on.
OP12 = r"""
WITH RECURSIVE crc(i, c, k) AS (
    SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc WHERE k < 8
), crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8
), keys AS (
    SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), dealt AS (
    SELECT key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 20 AS deal FROM keys, crc_table
), dam AS (
    SELECT conv_id, turn, CASE WHEN deal = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
        CASE deal WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN deal = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM conversations JOIN dealt ON key = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') WHERE deal <> 0
), nth AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, role[1] AS r FROM dam
), kind AS (
    SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS kind, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS bad FROM nth
), found AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'd') AS duplicate,
        count(*) FILTER (WHERE kind = 't') AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM kind GROUP BY conv_id
), go(conv_id, i, c0, cs, cu, ca) AS (
    SELECT conv_id, n + 1, 0, 4, 2, 0 FROM found
    UNION ALL
    SELECT conv_id, i, least(b0, 2 + bu, 4 + ba), least(bs, 2 + bu, 4 + ba), least(bu, 2 + ba), least(ba, 2 + bu) FROM (
        SELECT go.conv_id, k.i, least(3 + c0, CASE WHEN g THEN 99999999 ELSE x + least(2 + cu, CASE r WHEN 's' THEN cs WHEN 'u' THEN cu ELSE 99999999 END) END) AS b0, least(3 + cs, CASE WHEN g THEN 99999999 ELSE x + CASE r WHEN 'u' THEN cu ELSE 2 + cu END END) AS bs,
            least(3 + cu, CASE WHEN g THEN 99999999 ELSE x + CASE r WHEN 'a' THEN ca ELSE 2 + ca END END) AS bu, least(3 + ca, CASE WHEN g THEN 99999999 ELSE x + CASE r WHEN 'u' THEN cu ELSE 2 + cu END END) AS ba
        FROM go JOIN (SELECT conv_id, i, r, kind IN ('b', 'd') AS g, (kind = 't')::INT AS x FROM kind) k ON k.conv_id IS NOT DISTINCT FROM go.conv_id AND k.i = go.i - 1)
), states AS (
    SELECT conv_id, i, unnest([{'q': '0', 'c': c0, 'm': 'u', 'mc': cu}, {'q': 's', 'c': cs, 'm': 'u', 'mc': cu}, {'q': 'u', 'c': cu, 'm': 'a', 'mc': ca}, {'q': 'a', 'c': ca, 'm': 'u', 'mc': cu}], recursive := true) FROM go
), steps AS (
    SELECT s.conv_id, s.i, s.q, s.m, k.role, k.text, CASE WHEN k.i IS NULL THEN 'I' WHEN 3 + d.c = s.c THEN 'D' WHEN 2 + s.mc = s.c THEN 'I' WHEN x + kc.c = s.c THEN 'K' ELSE 'R' END AS e, k.r
    FROM states s LEFT JOIN (SELECT conv_id, i, r, role, text, (kind = 't')::INT AS x FROM kind) k ON k.conv_id IS NOT DISTINCT FROM s.conv_id AND k.i = s.i
    LEFT JOIN states d ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND d.i = s.i + 1 AND d.q = s.q
    LEFT JOIN states kc ON kc.conv_id IS NOT DISTINCT FROM s.conv_id AND kc.i = s.i + 1 AND kc.q = k.r AND ((s.q = '0' AND k.r IN ('s', 'u')) OR (s.q IN ('s', 'a') AND k.r = 'u') OR (s.q = 'u' AND k.r = 'a'))
), walk(conv_id, i, q, nr, e, line) AS (
    SELECT conv_id, 1::BIGINT, '0', 0, '', NULL::VARCHAR FROM found
    UNION ALL
    SELECT w.conv_id, CASE WHEN s.e = 'I' THEN w.i ELSE w.i + 1 END, CASE s.e WHEN 'D' THEN w.q WHEN 'K' THEN s.r ELSE s.m END, w.nr + 1, s.e,
        CASE s.e WHEN 'K' THEN s.role || ':' || s.text WHEN 'R' THEN CASE s.m WHEN 'u' THEN 'user:' ELSE 'assistant:' END || s.text WHEN 'I' THEN CASE s.m WHEN 'u' THEN 'user:' ELSE 'assistant:' END END
    FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i AND s.q = w.q JOIN found f ON f.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i <= f.n OR w.q IN ('s', 'u')
), repaired AS (
    SELECT conv_id, string_agg(e, '' ORDER BY nr) AS audit, coalesce(string_agg(line, chr(10) ORDER BY nr), '') AS said FROM walk GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(c0, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN go ON go.conv_id IS NOT DISTINCT FROM c.conv_id AND go.i = 1 AND f.n IS NOT NULL LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = r"""
WITH u AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS seed
    FROM documents
), h AS (
    SELECT doc_id, text, units, len(units)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda a: list_sum(list_transform(range(0, 8), lambda i: (strpos('0123456789abcdef', seed[a + i : a + i]) - 1) * (16 ^ (7 - i))::BIGINT))::BIGINT) AS h FROM u
), f AS (
    SELECT doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), p AS (
    SELECT *, array_to_string(units[:low], '') AS prefix, array_to_string(units[low + 1 : high], '') AS middle, array_to_string(units[high + 1 :], '') AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2, "op4_substring_dedup": OP4, "op6_warc": OP6, "op7_exact_dedup": OP7, "op10_decontaminate": OP10, "op12_conversation_repair": OP12, "op13_fill_in_middle": OP13}
