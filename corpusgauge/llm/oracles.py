"""The queries that SQL can express, for DuckDB, over whole tables and whole texts."""

from __future__ import annotations

from corpusgauge.llm import licenses
from corpusgauge.llm.quality import ERROR, GRIDS, PRICE, RISK

WORDS = r"[^\x20\x09-\x0D]+"


def components_sql(nodes: str, links: str) -> str:
    """CTE `groups` (node, component): the smallest node reached; `links` has each link in both directions (a, b)."""
    return f"""reached(node, low) AS (
    SELECT node, node FROM {nodes}
    UNION
    SELECT l.b, r.low FROM reached r JOIN {links} l ON l.a = r.node WHERE r.low < l.b
), groups AS (SELECT node, min(low) AS component FROM reached GROUP BY node)"""


def _rule_grids() -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, i, {a} * pow({b}, i) AS cutoff FROM range({n}) t(i)" for r, (a, b, n) in GRIDS.items())


OP4 = rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{WORDS}') AS w FROM texts)),
grams AS (
    SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER own || ' ' || lead(word, 2) OVER own AS gram FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY pos)
), found AS (
    SELECT doc_id, pos FROM grams WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), repeated AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM found, range(3) s(k) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS l FROM texts),
measured AS (
    SELECT x.doc_id, x.lang, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
    FROM texts x JOIN lines USING (doc_id) LEFT JOIN counted c USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
shares AS (
    SELECT doc_id, lang, base_failed, rule, coalesce(part / nullif(whole, 0)::DOUBLE, 0) AS share FROM (
        SELECT doc_id, lang, base_failed, 'symbol_share' AS rule, n_symbols AS part, word_chars AS whole FROM judged
        UNION ALL SELECT doc_id, lang, base_failed, 'dup_line_share', n_dup_lines, n_lines FROM judged
        UNION ALL SELECT doc_id, lang, base_failed, 'repeat_share', n_repeat_words, n_words FROM judged)
), labelled AS (SELECT s.lang, rule, share, quality FROM shares s JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
grid AS ({_rule_grids()}),
tested AS (
    SELECT lang, rule, i, any_value(cutoff) AS cutoff, count(*) FILTER (quality = 1) AS n_good,
        count(*) FILTER (quality = 1 AND share > cutoff) AS lost, count(*) FILTER (quality = 0 AND share > cutoff) AS caught
    FROM labelled JOIN grid USING (rule) GROUP BY lang, rule, i
), bounded AS (
    SELECT *, CASE WHEN lost >= n_good * {RISK / len(GRIDS)} THEN 1 ELSE list_sum(list_transform(range(lost + 1), lambda j:
        exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({RISK / len(GRIDS)}) + (n_good - j) * ln(1 - {RISK / len(GRIDS)})))) END AS p
    FROM tested
), strata AS (SELECT count(DISTINCT lang) + coalesce(max((lang IS NULL)::INT), 0) AS n FROM labelled),
safe AS (SELECT *, max(p) OVER (PARTITION BY lang, rule ORDER BY i) AS worst FROM bounded),
cutoffs AS (
    SELECT lang, rule, cutoff FROM safe, strata WHERE worst <= {ERROR} / (strata.n * {len(GRIDS)}) AND caught > {PRICE} * lost
    QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - {PRICE} * lost DESC, i) = 1
), rejected AS (SELECT DISTINCT doc_id FROM shares s JOIN cutoffs c ON c.rule = s.rule AND c.lang IS NOT DISTINCT FROM s.lang WHERE share > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM judged
"""

OP7 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM texts),
passages AS (
    SELECT doc_id, pos, word, CASE WHEN pos + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS passage FROM words
), often AS (SELECT passage FROM passages WHERE passage IS NOT NULL GROUP BY passage HAVING count(*) > 1),
marked AS (
    SELECT doc_id, pos, word, max((o.passage IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
    FROM passages p LEFT JOIN often o USING (passage)
), kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS rest FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (doc_id)
"""

OP8 = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM texts),
grams AS (
    SELECT doc_id, n, word || coalesce(' ' || lead(word, 1) OVER own, '') || coalesce(' ' || lead(word, 2) OVER own, '') AS shingle, pos FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY pos)
), items AS (SELECT DISTINCT doc_id, shingle FROM grams WHERE pos = 1 OR pos + 2 <= n),
sizes AS (SELECT doc_id, count(*) AS size FROM items GROUP BY doc_id),
ranked AS (
    SELECT doc_id, shingle, size, row_number() OVER (PARTITION BY doc_id ORDER BY often, shingle) AS place
    FROM (SELECT *, count(*) OVER (PARTITION BY shingle) AS often FROM items) JOIN sizes USING (doc_id)
), firsts AS (SELECT * FROM ranked WHERE place <= size - ceil(0.9 * size) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.size AS x, b.size AS y FROM firsts a JOIN firsts b USING (shingle) WHERE a.doc_id < b.doc_id),
linked AS (
    SELECT p.a, p.b FROM pairs p JOIN items i ON i.doc_id = p.a JOIN items j ON j.doc_id = p.b AND j.shingle = i.shingle
    GROUP BY p.a, p.b, x, y HAVING 100 * count(*) >= 90 * (x + y - count(*))
), ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
{components_sql("(SELECT doc_id AS node FROM texts)", "ways")}
SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component AS component_id FROM texts LEFT JOIN sizes USING (doc_id) JOIN groups ON node = doc_id
"""

OP9 = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (
    SELECT vec_id, v FROM vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{components_sql("(SELECT vec_id AS node FROM vectors)", "linked")},
counts AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept FROM vectors JOIN groups ON node = vec_id LEFT JOIN counts ON a = vec_id
"""

#: A SHA-1 in hexadecimal as base32: five hexadecimal digits are four characters.
OP10 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS last,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1) for k in range(32)], '') AS digest FROM payloads)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to FROM named
"""

_LICENSE_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in values)


OP11 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_LICENSE_WORDS}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM texts),
next AS (SELECT doc_id, pos, word, lead(word, 1) OVER own AS w2, lead(word, 2) OVER own AS w3 FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY pos)),
base AS (SELECT doc_id, pos, label FROM next, (VALUES {_rows(list(licenses.PHRASES.items()))}) p(phrase, label) WHERE word || ' ' || w2 = phrase OR word || ' ' || w2 || ' ' || w3 = phrase),
based AS (SELECT doc_id, count(*) AS n, min(pos) AS first, max(pos) AS last FROM base GROUP BY doc_id),
notices AS (
    SELECT notice, label, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place
    FROM (SELECT notice, label, regexp_extract_all({_LOWER.format("t")}, '{_LICENSE_WORDS}') AS w FROM (VALUES {_rows([(n, label, t) for n, (label, t) in enumerate(licenses.NOTICES)])}) v(notice, label, t))
), places AS (SELECT *, lead(word, 1) OVER own AS w2, lead(word, 2) OVER own AS w3 FROM notices WINDOW own AS (PARTITION BY notice ORDER BY place)),
votes AS (
    SELECT doc_id, notice, n.pos - place AS shift, count(*) AS votes FROM next n JOIN places p ON n.word = p.word AND n.w2 = p.w2 AND n.w3 = p.w3 GROUP BY doc_id, notice, n.pos - place
), agreed AS (
    SELECT doc_id, notice, shift, sum(votes) OVER (PARTITION BY doc_id, notice ORDER BY shift RANGE BETWEEN CURRENT ROW AND {licenses.SLACK} FOLLOWING) AS agree FROM votes
), asked AS (
    SELECT a.* FROM agreed a JOIN (SELECT notice, count(*) AS n FROM notices GROUP BY notice) s USING (notice) WHERE agree >= {licenses.VOTES} * greatest(1, s.n - {licenses.GRAM - 1})
), shares AS (
    SELECT a.doc_id, a.notice, a.shift, any_value(t.label) AS label, count(DISTINCT t.place) / any_value(t.n)::DOUBLE AS share
    FROM asked a JOIN notices t USING (notice) JOIN words d ON d.doc_id = a.doc_id AND d.word = t.word AND d.pos - t.place BETWEEN a.shift AND a.shift + {licenses.SLACK} GROUP BY ALL
), labelled AS (SELECT doc_id, label, share FROM shares WHERE share >= {licenses.WORDS} UNION ALL SELECT doc_id, label, 0 FROM base),
joined AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM labelled GROUP BY doc_id),
base_joined AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first AS first_word, b.last AS last_word, coalesce(x.labels, '') AS base_labels,
    coalesce(j.labels, '') AS labels, coalesce(j.score, 0)::DOUBLE AS score
FROM texts t LEFT JOIN based b USING (doc_id) LEFT JOIN joined j USING (doc_id) LEFT JOIN base_joined x USING (doc_id)
"""

#: A run of lag q holds at least five places whose next five words stand q further on too; only those pairs are compared.
OP12 = rf"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, x: list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, x)), 4294967295::BIGINT)) AS h FROM documents
), drawn AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM split),
placed AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM drawn),
texts AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM placed),
words AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM texts),
grams AS (
    SELECT doc_id, n, pos, hash(word, lead(word, 1) OVER own, lead(word, 2) OVER own, lead(word, 3) OVER own, lead(word, 4) OVER own) AS gram
    FROM words WINDOW own AS (PARTITION BY doc_id ORDER BY pos) QUALIFY lead(word, 4) OVER own IS NOT NULL
), pairs AS (SELECT x.doc_id, x.pos AS i, y.pos - x.pos AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.pos > x.pos AND 4 * (y.pos - x.pos) <= x.n),
stretches AS (
    SELECT doc_id, q, min(i) AS first, count(*) + 4 + q AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (SELECT doc_id, first, size, min(q) AS q FROM stretches WHERE size >= greatest(6, 4 * q) GROUP BY doc_id, first, size),
listed AS (
    SELECT doc_id, count(*) AS n_runs, sha256(string_agg(first || ',' || size || ',' || q || chr(10), '' ORDER BY first, q)) AS digest, list(struct_pack(size := size, first := first, q := q) ORDER BY size DESC, first, q)[1] AS top
    FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(first + q, first + size)) AS pos FROM runs),
rest AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS left_over FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.first::BIGINT AS start, top.size::BIGINT AS length, top.q::BIGINT AS period, (1000 * top.size // top.q)::BIGINT AS exponent_milli,
    coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

OP13 = r"""
WITH cuts AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id::VARCHAR) AS x FROM documents
), drawn AS (
    SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS c2, ('0x' || x[25:32])::BIGINT % 100 AS draw,
        t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 100 AS plain FROM cuts
), parts AS (
    SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:n], '') AS s FROM drawn
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN draw < 50 THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
    sha256(CASE WHEN plain THEN t WHEN draw < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op4_quality_rules": OP4, "op7_substring_dedup": OP7, "op8_ngram_jaccard": OP8, "op9_embedding_near_dedup": OP9, "op10_warc": OP10, "op11_license_scan": OP11, "op12_periodic_runs": OP12, "op13_fill_in_middle": OP13}
