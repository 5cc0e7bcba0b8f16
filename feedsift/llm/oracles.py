"""Reference SQL of the llm queries that SQL can express.

Written from what a query means, with other means than the Spark side: sorted
rows instead of sketches, joins on shingles instead of bands, whole windows
instead of seeds, all pairs of vectors.
"""

from __future__ import annotations

from feedsift.llm import clusters, embed, licenses, minhash, negatives, quality, secrets, substring
from feedsift.llm.queries import MINED_LABEL

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_ROWS = "docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    def found(rule: secrets.Rule) -> str:
        p, number = _quoted(rule.pattern), secrets.RULES.index(rule)
        return f"""
SELECT r, {number} AS rule, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
  'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
  'n': length(m[i]), 'g': length(g[i])}})) AS s
FROM (SELECT r, regexp_split_to_array(text, {p}) AS p, regexp_extract_all(text, {p}, 0) AS m,
             regexp_extract_all(text, {p}, {rule.group}) AS g FROM docs WHERE regexp_matches(text, {p}))"""

    every = " UNION ALL ".join(
        f"SELECT r, rule, s.a AS a, s.a + s.n AS b FROM ({found(rule)}) WHERE s.g >= {rule.least}" for rule in secrets.RULES
    )
    names = ", ".join(f"({n}, '{rule.kind}')" for n, rule in enumerate(secrets.RULES))
    told = "string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, rule)"
    base = len(secrets.BASE_RULES)
    return f"""
WITH {_ROWS}, kinds(rule, kind) AS (VALUES {names}), found AS ({every}),
told AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE rule = {n}) AS c{n}" for n in range(base))},
                {told} FILTER (WHERE rule < {base}) AS base, {told} AS spans FROM found JOIN kinds USING (rule) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(c{n}, 0) AS n_{rule.kind}" for n, rule in enumerate(secrets.BASE_RULES))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (r)"""


def _near_documents() -> str:
    n = minhash.SHINGLE_WORDS
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {_ROWS},
cut AS (SELECT r, doc_id, regexp_extract_all({lower}, {_WORD}) AS w FROM docs),
grams AS (SELECT r, doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {n} + 1, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1),
                                           lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS s FROM cut),
each AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM grams),
pairs AS (SELECT a.r AS x, b.r AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
          FROM each a JOIN each b ON a.g = b.g AND a.r <> b.r AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.r, b.r),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= {minhash.LEAST_PERCENT} * (n + m - shared)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(doc_id) AS low FROM reach JOIN docs ON docs.r = reach.y GROUP BY x)
SELECT doc_id, len(s) AS n_shingles, coalesce(least(doc_id, low), doc_id) AS component_id,
       coalesce(doc_id <= coalesce(low, doc_id), true) AS kept FROM grams LEFT JOIN least ON least.x = grams.r"""


def _near_vectors() -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.r AS x, b.r AS y FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= {embed.LEAST_COSINE}),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(vec_id) AS low FROM reach JOIN v ON v.r = reach.y GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, low), vec_id) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept FROM v LEFT JOIN least ON least.x = r LEFT JOIN counts ON counts.x = r"""


def _substrings() -> str:
    n = substring.WINDOW
    return f"""
WITH {_ROWS},
cut AS (SELECT r, doc_id, regexp_extract_all(text, {_WORD}) AS w FROM docs),
places AS (SELECT r, doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS p FROM cut WHERE len(w) >= {n} AND doc_id IS NOT NULL),
windows AS (SELECT r, doc_id, p, array_to_string(w[p:p + {n - 1}], ' ') AS s FROM places),
held AS (SELECT r, p FROM (SELECT r, doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {n})) AS p FROM held),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM cut),
kept AS (SELECT words.r, count(*) AS n, count(gone.p) AS g, string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS s
         FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY words.r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(g, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (r)"""


def _quality() -> str:
    def cell(v: str) -> str:
        drop = f"greatest(length(bin({v})) - 7, 0)"
        return f"((CAST({v} AS BIGINT) >> {drop}) << {drop})"

    def limits(keys: list[str], name: str) -> str:
        """Every percentile of each measure by its rank, then the first large step between two neighbours."""
        by = ", ".join(keys)
        columns = f"{by}, " if keys else ""
        kept = ", ".join(f"{k} AS {name}_{k}" for k in keys)
        whole = f"{name}_rows AS (SELECT {columns}m, c, row_number() OVER (PARTITION BY {columns}m ORDER BY c) AS rank, count(*) OVER (PARTITION BY {columns}m) AS n FROM melted)"
        percents = (
            f"{name}_percents AS (SELECT {columns}m, p, any_value(n) AS n, min(c) AS c FROM {name}_rows, range({quality.FROM_PERCENT}, 101) t(p) "
            f"WHERE 100 * rank >= p * n GROUP BY {columns}m, p)"
        )
        steps = (
            f"{name}_steps AS (SELECT {columns}m, n, c, lead(c) OVER (PARTITION BY {columns}m ORDER BY p) - c AS step FROM {name}_percents)"
        )
        guard = "CASE m " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in quality.GUARD.items()) + " END"
        found = ", ".join(
            f"min_by(c + step // 2, c) FILTER (WHERE m = '{m}' AND step >= {guard}) AS {name}_{m}" for m in quality.GUARD
        )
        group = f" GROUP BY {by}" if keys else ""
        return f"{whole}, {percents}, {steps}, {name} AS (SELECT {kept + ', ' if keys else ''}max(n) AS {name}_n, {found} FROM {name}_steps{group})"

    def limit(m: str) -> str:
        return f"CASE WHEN g_n >= {quality.MIN_GROUP_ROWS} THEN g_{m} WHEN l_n >= {quality.MIN_GROUP_ROWS} THEN l_{m} ELSE a_{m} END"

    melted = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS m, {cell(m)} AS c FROM shares" for m in quality.GUARD)
    within = " AND ".join(f"coalesce({m} <= {limit(m)}, true)" for m in quality.GUARD)
    return f"""
WITH {_ROWS},
cut AS (SELECT r, doc_id, lang, source, text, regexp_extract_all(text, {_WORD}) AS w,
               list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM docs),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM cut),
triples AS (SELECT r, p, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM triples WHERE c IS NOT NULL) WHERE n > 1),
again AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, p + k AS p FROM twice, range(3) t(k)) GROUP BY r),
counted AS (SELECT r, doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
            FROM cut LEFT JOIN again USING (r)),
shares AS (SELECT *, CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbol_share,
                  CASE WHEN n_lines > 0 THEN 10000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_share,
                  CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeat_share,
                  CASE WHEN n_words > 0 THEN 10000 * word_chars // n_words ELSE 0 END AS word_length FROM counted),
melted AS ({melted}),
{limits(["lang", "source"], "g")}, {limits(["lang"], "l")}, {limits([], "a")},
failed AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM shares)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {within} AS kept
FROM failed JOIN g ON lang IS NOT DISTINCT FROM g_lang AND source IS NOT DISTINCT FROM g_source
JOIN l ON lang IS NOT DISTINCT FROM l_lang, a"""


def _clusters() -> str:
    """Each round spelled out over all vectors and all centroids."""
    away = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def nearest(n: int) -> str:
        return f"""
near{n} AS MATERIALIZED (
  SELECT r, vec_id, x, arg_min(j, (d, j)) AS j, min(d) AS d
  FROM (SELECT r, vec_id, x, j, CAST({away} AS BIGINT) AS d FROM v, at{n}) GROUP BY r, vec_id, x)"""

    rounds = "".join(f"""{nearest(n)},
means{n} AS (
  SELECT j, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c
  FROM (SELECT j, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
        FROM (SELECT j, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM near{n}) GROUP BY j, i) GROUP BY j),
at{n + 1} AS MATERIALIZED (SELECT j, coalesce(means{n}.c, at{n}.c) AS c FROM at{n} LEFT JOIN means{n} USING (j)),"""
                     for n in range(clusters.ROUNDS))
    last = clusters.ROUNDS
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: CAST(floor({clusters.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda e: isfinite(e))) = {clusters.DIMS} AND len(embedding) = {clusters.DIMS}),
at0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{clusters.SALT}:' || vec_id)) - 1 AS j, x AS c FROM v
  QUALIFY j < {clusters.CLUSTERS}),{rounds}{nearest(last)}
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near{last} JOIN at{last} USING (j)"""


def _hard_negatives() -> str:
    score = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, {MINED_LABEL} AS label,
         list_transform(embedding, lambda e: CAST(floor({negatives.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
scored AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS other_id, b.r AS b, a.label = b.label AS alike,
         CAST({score.format(a="a.x", b="b.x")} AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % {negatives.EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
pos AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, other_id) AS n FROM scored WHERE alike QUALIFY n <= {negatives.POSITIVES}),
found AS (
  SELECT pos.anchor_id, pos.other_id AS positive_id, scored.other_id AS negative_id, pos.s AS positive_score, scored.s AS negative_score,
         row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY scored.s DESC, scored.other_id) AS rank
  FROM pos JOIN scored ON pos.a = scored.a AND NOT scored.alike AND {negatives.LEAST_PERCENT} * pos.s <= 100 * scored.s
    AND 100 * scored.s <= {negatives.MOST_PERCENT} * pos.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= {negatives.NEGATIVES}"""


def _exact() -> str:
    return """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id NULLS LAST, r) AS place FROM t)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY place) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       place = 1 AS kept, sha256(s) AS text_sha256 FROM ranked"""


def llm_oracles() -> dict[str, str]:
    return {
        "op1_secret_scans": _secrets(),
        "op2_minhash_dedup": _near_documents(),
        "op4_embedding_dedup": _near_vectors(),
        "op6_license_scans": licenses.oracle(),
        "op8_substring_dedup": _substrings(),
        "op10_quality_rules": _quality(),
        "op11_centroid_clusters": _clusters(),
        "op12_hard_negatives": _hard_negatives(),
        "op13_exact_dedup": _exact(),
    }
