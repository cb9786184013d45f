"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

_DIGEST = " || ".join(f"translate(upper(to_base(('0x' || substr(x, {5 * k + 1}, 5))::BIGINT, 32, 4)), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for k in range(8))

TOP_K = """WITH v AS (SELECT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS query_id, b.id AS vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
    SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM d"""

NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)),
    k AS (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS set_key, count(*) AS n FROM g GROUP BY doc_id),
    r AS (SELECT set_key, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM k GROUP BY set_key),
    s AS (SELECT rep, n, gram FROM r JOIN g ON g.doc_id = r.rep),
    pairs AS (SELECT a.rep AS a, b.rep AS b FROM s a JOIN s b ON a.gram = b.gram AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(a, b) AS (SELECT rep, rep FROM r UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
    class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a), n_links AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a)
    SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(copies, 1)::BIGINT AS n_copies
    FROM w LEFT JOIN k USING (doc_id) LEFT JOIN r USING (set_key) LEFT JOIN class USING (rep) LEFT JOIN n_links USING (rep)"""



def _clusters(k: int = 16, rounds: int = 3) -> str:
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, vec_id, q) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT v.r, c.c, {square} AS d FROM v, c{n} c QUALIFY row_number() OVER (PARTITION BY v.r ORDER BY d, c.c) = 1)")
        if n < rounds:
            parts.append(f"""s{n} AS (SELECT c, k, sum(x) AS s, count(*) AS m FROM (SELECT a{n}.c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS k FROM a{n} JOIN v USING (r)) GROUP BY c, k),
    c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m.q, c{n}.q) AS q FROM c{n} LEFT JOIN (SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY k) AS q FROM s{n} GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)}
    SELECT v.vec_id, a.c::INT AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON a.c = c.c"""


MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(x, k, 8))::BIGINT) AS h FROM d),
    f AS (SELECT *, len(units) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
        least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b FROM u),
    p AS (SELECT *, array_to_string(units[1 : a], '') AS prefix, array_to_string(units[a + 1 : b], '') AS middle, array_to_string(units[b + 1 : n], '') AS suffix FROM f)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: A turn is its role and text with 24 characters of template, and a backslash for each control string in either.
CHAT = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(k))),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, md5(text)) AS k,
        length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|')) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + 24 AS chars FROM r)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM o GROUP BY conv_id"""

SQL = {"op11_yinyang": _clusters(), "op12_fill_in_middle": MIDDLE, "op13_chat_format": CHAT, "op4_exact_top_k": TOP_K, "op6_warc_revisits": WARC, "op10_ngram_join": NEAR}
