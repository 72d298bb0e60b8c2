"""DuckDB text for the text queries that SQL can express and whose module does not hold it."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def near_duplicates(k: int = 2, percent: int = 80) -> str:
    """Components of ``documents`` by Jaccard similarity of their word shingles, all pairs compared."""
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {k} THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - {k} + 2), lambda i: array_to_string(words[i:i + {k} - 1], ' '))) END AS grams FROM w),
    -- equal sets are linked through the least id, the others are compared by their first
    c AS (SELECT list_sort(grams) AS grams, min(doc_id) AS rep, len(any_value(grams)) AS n FROM s WHERE len(grams) > 0 GROUP BY 1),
    g AS (SELECT rep, n, unnest(grams) AS gram FROM c),
    p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.gram = b.gram AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} GROUP BY 1, 2),
    e AS (SELECT a, b FROM p WHERE 100 * common >= {percent} * (na + nb - common)),
    ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT rep AS x, rep AS y FROM c UNION SELECT r.x, o.b FROM reach r JOIN ways o ON o.a = r.y),
    comp AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x),
    d AS (SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON c.grams = list_sort(s.grams) AND len(s.grams) > 0 LEFT JOIN comp USING (rep))
    SELECT *, doc_id = component_id AS kept FROM d"""


def chat() -> str:
    """Digests of ``conversations`` and of conversation -1; the formatted length from the template's own parts."""
    probe = "<|im_end|><|im_start|>assistant ok"
    escape = r"regexp_replace({x}, '<(\\*)\|', '<\1\\|', 'g')"
    return rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}'),
    f AS (SELECT *, length('<|im_start|>') + length({escape.format(x="replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + 1 + length({escape.format(x="text")}) + length('<|im_end|>') + 1 AS chars FROM t)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""


def warc(min_bytes: int = 100) -> str:
    """Records of ``pages``, with the place of each capture in the order of its URL's key; a page's time is its id."""
    return rf"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
    h AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest, string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.') AS host, regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) AS rest FROM p),
    k AS (SELECT *, lower(array_to_string(list_reverse(host), ',') || ')' || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END) AS url_key FROM h),
    f AS (SELECT digest, min(page_id) AS first_id FROM k WHERE n >= {min_bytes} GROUP BY digest),
    r AS (SELECT k.*, CASE WHEN n >= {min_bytes} AND page_id <> first_id THEN first_id END AS refers_to FROM k LEFT JOIN f USING (digest))
    SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
    row_number() OVER (ORDER BY url_key, page_id) - 1 AS "position" FROM r"""


#: The CRC-32 of an ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii({s}[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))))"""


def periodic_runs(min_words: int = 24, min_repeats: int = 3) -> str:
    """Runs of words of ``documents``: equal words at each distance, as islands of neighbouring places."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {CRC32.format(s="(doc_id::VARCHAR)")} AS h FROM documents),
    a AS (SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) ELSE 0 END AS a FROM d),
    p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
    w AS (SELECT rid, n, i, words[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM p, unnest(range(n)) AS t(i)),
    pairs AS (SELECT x.rid, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND {min_repeats} * (y.i - x.i) <= x.n),
    islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs),
    stretches AS (SELECT rid, q, min(i) AS s, count(*) + q AS len FROM islands GROUP BY rid, q, island HAVING count(*) + q >= greatest({min_words}, {min_repeats} * q)),
    runs AS (SELECT rid, s, len, min(q) AS q FROM stretches GROUP BY rid, s, len),
    best AS (SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := s, l := len, q := q), (-1000000000000 * len // q, s, q)) AS b, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY rid),
    dropped AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM runs),
    kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS left_over FROM w ANTI JOIN dropped USING (rid, i) GROUP BY rid)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
    FROM d LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)"""


def hard_negatives() -> str:
    """Anchors of ``embeddings`` against all rows, scores by plain sums of products."""
    return """
    WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
    p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5),
    n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id)::INT AS rank
            FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
