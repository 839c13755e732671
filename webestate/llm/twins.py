"""DuckDB SQL with the same rows as the numbered queries."""

LINE_DEDUP = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), frequent AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

SOURCE_MIXING = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS place
    FROM sized GROUP BY source
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
    FROM sources
    WINDOW before AS (ORDER BY 3 * source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
    SELECT source, source_size, least(3 * source_size::DOUBLE, max(level) OVER () * weight) AS target FROM levels
), classed AS (
    SELECT *, length(bin(size)) AS bits FROM sized
), ranked AS (
    SELECT doc_id, source, size, row_number() OVER (PARTITION BY source
        ORDER BY bits * 32 + ((size << 4) >> (bits - 1)), ((doc_id % 1021) + 1021) % 1021, size, doc_id) AS nth
    FROM classed
), stepped AS (
    SELECT doc_id, size, source_size, target, nth,
        CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
        ('0x' || substr(md5('mix' || coalesce(ranked.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS start
    FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
    (least(3, floor(rate * nth + start) - floor(rate * (nth - 1) + start)) * size)::BIGINT AS taken
FROM stepped
"""

URL_FILTER = r"""
WITH parsed AS (
    SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), cut AS (
    SELECT page_id, rest, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        array_to_string(list_filter(string_split(coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), ''), '&'), lambda x: NOT starts_with(x, 'utm_')), '&') AS fields
    FROM parsed
), urls AS (
    SELECT page_id, host, path, CASE WHEN rest IS NOT NULL THEN host || regexp_replace(path, '/$', '') || CASE WHEN fields <> '' THEN '?' || fields ELSE '' END END AS canon FROM cut
), listed AS (
    SELECT DISTINCT canon FROM urls
    WHERE canon IS NOT NULL AND list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
), rules(r_host, r_path, r_verdict) AS (
    VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
    SELECT host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
    FROM (SELECT DISTINCT host, path FROM urls) JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(r_verdict, CASE WHEN listed.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    listed.canon IS NOT NULL AS listed
FROM urls LEFT JOIN listed USING (canon) LEFT JOIN best USING (host, path)
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach(id, root) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT b, root FROM reach JOIN links ON id = a
), rooted AS (
    SELECT id, min(root) AS component_id FROM reach GROUP BY id
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN rooted ON id = vec_id
"""


def _distance(a: str, b: str) -> str:
    return f"list_dot_product({a}, {a}) - 2 * list_dot_product({a}, {b}) + list_dot_product({b}, {b})"


def _vector_codes() -> str:
    """Full scans in every round; distances are integers below 2**53 in doubles."""
    steps = [r"""
kept AS (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, len(embedding) // 16 AS w,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
    SELECT r, p, q[p * w + 1 : p * w + w] AS v FROM kept, range(16) t(p)
), book0 AS (
    SELECT p, r - 1 AS e, v FROM parts WHERE r <= 64
)"""]
    for i in range(3):
        steps.append(f"""
code{i} AS (
    SELECT r, p, min((({_distance("parts.v", f"book{i}.v")})::BIGINT * 64 + e)::BIGINT) AS best FROM parts JOIN book{i} USING (p) GROUP BY r, p
)""")
        if i < 2:
            steps.append(f"""
mean{i} AS (
    SELECT p, e, list(m::DOUBLE ORDER BY j) AS v FROM (
        SELECT p, best % 64 AS e, j, floor(sum(x) / count(*)) AS m
        FROM (SELECT p, best, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM parts JOIN code{i} USING (r, p)) GROUP BY p, e, j) GROUP BY p, e
), book{i + 1} AS (
    SELECT p, e, coalesce(mean{i}.v, book{i}.v) AS v FROM book{i} LEFT JOIN mean{i} USING (p, e)
)""")
    return "WITH " + ",".join(steps) + r""", flat AS (
    SELECT p, e, unnest(v)::BIGINT::VARCHAR AS x, generate_subscripts(v, 1) AS j FROM book2
), digest AS (
    SELECT sha256(string_agg(x, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM flat
), coded AS (
    SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM code2 GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN digest
"""


VECTOR_CODES = _vector_codes()


def _escaped(text: str) -> str:
    out = f"replace({text}, chr(92), chr(92) || chr(92))"
    for control in ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '-{control[1:]}')"
    return out


CHAT_FORMAT = rf"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(23 + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""

FILL_IN_MIDDLE = r"""
WITH hashed AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
    SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
        ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM hashed
), cut AS (
    SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
            WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
    SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
