"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from bookwise.llm import divergence, licenses, phrases, quality_rules as qr

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT >> {35 - 5 * j}) & 31) + 1)::INT, 1)"
    for i in range(4) for j in range(8)
)



def _licenses() -> str:
    """The scan over whole pages: no anchors, every line, paragraph, header and license file is compared."""
    idf, unknown, vectors = licenses.weights()
    known = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    model = ", ".join(f"({i}, '{n}', '{w}', {x!r}::DOUBLE)" for i, n, w, x in vectors)
    return f"""
        WITH known(term, idf) AS (VALUES {known}), model(template, license, term, weight) AS (VALUES {model}),
        p AS (SELECT row_number() OVER () AS id, page_id, nullif(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '') AS path,
                     coalesce(html, '') AS body FROM pages),
        plain AS (SELECT id, path, replace(replace(lower(regexp_replace(body, '<[^>]*>', chr(10), 'g')), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS plain FROM p),
        cut AS (SELECT *, regexp_split_to_array(plain, '\\n([^a-z0-9\\n]*\\n)+') AS paragraphs,
                       coalesce(path LIKE '%/' OR regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENSE_FILE}'), FALSE) AS whole FROM plain),
        blocks AS (SELECT DISTINCT id, block FROM (
                     SELECT id, unnest(string_split(plain, chr(10))) AS block FROM cut
                     UNION ALL SELECT id, unnest(paragraphs) FROM cut
                     UNION ALL SELECT id, array_to_string(paragraphs[:k], chr(10)) FROM (SELECT *, unnest(range(2, len(paragraphs) + 1)) AS k FROM cut)
                     UNION ALL SELECT id, plain FROM cut WHERE whole)),
        terms AS (SELECT id, block, unnest(regexp_extract_all(block, '[a-z0-9]+(?:\\.[0-9]+)*')) AS term FROM blocks),
        counted AS (SELECT id, block, term, count(*) AS tf FROM terms GROUP BY ALL),
        valued AS (SELECT c.*, tf * coalesce(idf, {unknown!r}) AS value FROM counted c LEFT JOIN known USING (term)),
        norms AS (SELECT id, block, sqrt(sum(value * value)) AS norm FROM valued GROUP BY ALL),
        scored AS (SELECT v.id, template, license, round(sum(value * weight) / any_value(norm), 6) AS similarity
                   FROM valued v JOIN model USING (term) JOIN norms n ON v.id = n.id AND v.block = n.block
                   GROUP BY v.id, v.block, template, license),
        best AS (SELECT id, arg_max(license, (similarity, -template)) AS license, max(similarity) AS similarity
                 FROM scored WHERE similarity >= {licenses.THRESHOLD} GROUP BY id),
        marked AS (SELECT p.id, page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, similarity FROM p LEFT JOIN best USING (id)),
        stated AS (SELECT dir AS above, arg_min(license, (-similarity, license)) AS dir_license, max(similarity) AS dir_similarity FROM marked
                   WHERE license IS NOT NULL AND path IS NOT NULL
                     AND (path LIKE '%/' OR regexp_matches(regexp_extract(path, '[^/]*$'), '{licenses.LICENSE_FILE}'))
                   GROUP BY dir),
        near AS (SELECT m.id, arg_max(above, length(above)) AS from_dir, arg_max(dir_license, length(above)) AS dir_license,
                        arg_max(dir_similarity, length(above)) AS dir_similarity
                 FROM marked m JOIN stated s ON m.dir = s.above OR starts_with(m.dir, s.above || '/') GROUP BY m.id)
        SELECT page_id, path, coalesce(license, dir_license) AS license, coalesce(similarity, dir_similarity) AS similarity,
               CASE WHEN license IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' END AS how,
               CASE WHEN license IS NULL THEN from_dir END AS from_dir
        FROM marked LEFT JOIN near USING (id)"""


def _quality_rules() -> str:
    word = r"[^\x20\x09-\x0D]"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '{word}+') AS words FROM d),
        c AS (SELECT id, doc_id, i, word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS code
              FROM (SELECT id, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w)),
        n AS (SELECT *, lead(code) OVER o AS code2, lead(word) OVER o AS word2, lead(word, 2) OVER o AS word3 FROM c WINDOW o AS (PARTITION BY id ORDER BY i)),
        grams AS (SELECT id, doc_id, code % {qr.BUCKETS} AS b FROM n
                  UNION ALL SELECT id, doc_id, (code * 1000003 + code2) % {qr.BUCKETS} FROM n WHERE code2 IS NOT NULL),
        counts AS (SELECT b, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS trusted FROM grams GROUP BY b),
        sums AS (SELECT sum(raw)::DOUBLE AS raw_all, sum(trusted)::DOUBLE AS trusted_all FROM counts),
        weights AS (SELECT b, CASE WHEN trusted_all = 0 THEN 0
                    ELSE round(ln((trusted + {qr.SMOOTHING}) / (raw * (trusted_all / raw_all) + {qr.SMOOTHING})) * {qr.SCALE})::BIGINT END AS w FROM counts, sums),
        rated AS (SELECT id, sum(w) AS total, count(*) AS grams FROM grams JOIN weights USING (b) GROUP BY id),
        windows AS (SELECT id, i, count(*) OVER (PARTITION BY id, word, word2, word3) AS k FROM n WHERE word3 IS NOT NULL),
        again AS (SELECT id, count(DISTINCT j) AS k FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE k > 1) GROUP BY id),
        base AS (SELECT id, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
                        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
        figures AS (SELECT b.*, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words,
                           coalesce(total, 0) AS total, coalesce(grams, 0) AS grams FROM base b LEFT JOIN again USING (id) LEFT JOIN rated USING (id)),
        judged AS (SELECT *, n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM figures)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, total / greatest(grams, 1) / {qr.SCALE} AS llr, base_failed,
               NOT base_failed AND total >= {round(qr.THRESHOLD * qr.SCALE)} * grams AS kept
        FROM judged"""


def _collocations() -> str:
    return f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
        totals AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        sizes AS (SELECT unnest(range(1, {phrases.LONGEST + 1})) AS k),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
              FROM p, sizes WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        inner_ AS (SELECT lang, f, unnest(list_concat(list_transform(range(1, k - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' ')), [])) AS phrase
                   FROM c, (SELECT unnest(range(2, {phrases.LONGEST})) AS size) WHERE size < k),
        most AS (SELECT lang, phrase, max(f) AS most FROM inner_ GROUP BY ALL),
        kept AS (SELECT c.* FROM c LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < {phrases.SUBSUMED_PERCENT} * f),
        cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
                 FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
        scored AS (SELECT s.lang, s.phrase, a, cut, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
                   FROM cuts s JOIN f h ON h.lang = s.lang AND h.phrase = head JOIN f t ON t.lang = s.lang AND t.phrase = tail JOIN totals o ON o.lang = s.lang),
        weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r,
               n::BIGINT AS n, score::BIGINT AS score
        FROM weakest QUALIFY rank <= {phrases.FIRST}"""


def _divergence() -> str:
    share = f"1 + (1000000000::HUGEINT * (coalesce(n, 0) + {divergence.SMOOTHING})) // (total + {divergence.SMOOTHING} * v)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all({_FOLDED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {divergence.MIN_DOCUMENTS}),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
        gt AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
        lt AS (SELECT lang, sum(total) AS total FROM gt GROUP BY lang),
        gp AS (SELECT lang, source, term, coalesce(n, 0) AS n, {share} AS p FROM gt JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        lp AS (SELECT lang, term, {share} AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN lt USING (lang) JOIN v USING (lang)),
        apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
                  FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                 UNION ALL
                 SELECT lang, source, 'term', term, (p - q)::BIGINT FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM rows QUALIFY part = 'pair' OR rank <= {divergence.TERMS}"""


SQL: dict[str, str] = {
    "op12_collocations": _collocations(),
    "op13_divergence": _divergence(),
    "op1_quality_rules": _quality_rules(),
    "op2_license_scan": _licenses(),
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op8_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
        SELECT page_id, strlen(p.body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
               TRUE AS verified
        FROM p JOIN f ON p.body = f.body""",
}
