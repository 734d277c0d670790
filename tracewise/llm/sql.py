"""SQL for DuckDB that gives the same rows, for the operators that SQL can express."""

from tracewise.llm.quality import POLICIES, RULES

_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))


def _any(policy: str) -> str:
    return " OR ".join(f"({rule})" for name, rule in RULES if name in POLICIES[policy])


QUALITY = f"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ), windows AS (
        SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM texts WHERE len(w) > 2
    ), named AS (
        SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM windows
    ), repeated AS (
        SELECT r, count(DISTINCT p) AS n
        FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM named WHERE n > 1) GROUP BY r
    ), lines AS (
        SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
        FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts)
        WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
    ), measured AS (
        SELECT doc_id, len(w)::BIGINT AS n_words,
               length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
               length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper,
               length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_bangs,
               coalesce(lines.n, 0)::BIGINT AS n_lines,
               coalesce(lines.dup, 0)::BIGINT AS n_dup_lines,
               coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
        FROM texts LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           ({_any("base")}) AS base_failed,
           NOT ({_any("base")} OR {_any("v1")}) AS kept,
           ({_BITS})::BIGINT AS failed
    FROM measured"""

WARC = """
    WITH payloads AS (
        SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), firsts AS (
        SELECT payload_digest, max(page_id) AS first FROM payloads WHERE payload_bytes >= 1000
        GROUP BY payload_digest
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
    FROM payloads LEFT JOIN firsts USING (payload_digest)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

COLLOCATIONS = f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents
    ), texts AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
    ), phrases AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p
        FROM texts, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
    ), f AS (
        SELECT lang, k, p, count(*) AS f FROM phrases GROUP BY ALL
    ), totals AS (
        SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
    ), frequent AS (
        SELECT * FROM f WHERE k > 1 AND f >= 10
    ), covered AS (
        SELECT lang, part AS p, max(f) AS most
        FROM (SELECT lang, f, unnest([p[1:2], p[2:3]]) AS part FROM frequent WHERE k = 3) GROUP BY ALL
    ), cuts AS (
        SELECT c.lang, c.p, c.f AS a, cut, l.f AS l, r.f AS r,
               ((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM frequent) c
        LEFT JOIN covered v ON v.lang = c.lang AND v.p = c.p
        JOIN f l ON l.lang = c.lang AND l.p = c.p[1:cut]
        JOIN f r ON r.lang = c.lang AND r.p = c.p[cut + 1:]
        WHERE v.most IS NULL OR 100 * v.most < 50 * c.f
    ), least AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
    ), ranked AS (
        SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM least
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
           phrase, a, l, r, n, score
    FROM ranked JOIN totals USING (lang)
    QUALIFY rank <= 2000"""

CHOSEN_PATH = f"""
    WITH RECURSIVE texts AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE
            list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
        FROM texts
    ), items AS (
        SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
    ), links AS (
        SELECT a.doc_id AS u, b.doc_id AS v
        FROM items a JOIN items b ON a.x = b.x AND a.doc_id != b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n
        HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reached AS (
        SELECT doc_id AS d, doc_id AS c FROM documents
        UNION
        SELECT links.v, reached.c FROM reached JOIN links ON reached.d = links.u
    ), components AS (
        SELECT d, min(c) AS component_id FROM reached GROUP BY d
    )
    SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
    FROM sets JOIN components ON d = doc_id"""

ORACLES = {
    "op3_quality_rules": QUALITY,
    "op4_warc": WARC,
    "op11_collocations": COLLOCATIONS,
    "op13_chosen_path": CHOSEN_PATH,
}
