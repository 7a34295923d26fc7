"""DuckDB SQL for the results of the queries that SQL can state."""

from __future__ import annotations

from . import bisectors, line_dedup, mixing, url_rules
from .hashing import unit_sql
from .quality import Rules

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_RULES = Rules()


def _left(text: str, pattern: str) -> str:
    """Characters of a class in a text."""
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


def _classes(text: str) -> str:
    """Counts of the visible character classes, in the operator's order."""
    lower, upper = _left(text, "[a-z]"), _left(text, "[A-Z]")
    stop, symbol, digit = _left(text, "[.,;:!?''\"()-]"), _left(text, "[#*$%&|<>]"), _left(text, "[0-9]")
    letter = f"({_left(text, chr(92) + 'p{L}')} - {lower} - {upper})"
    rest = _left(text, r"[^\p{L}\x20\x09-\x0D.,;:!?''\"()#*$%&|<>0-9-]")
    return f"[{lower}, {letter}, {upper}, {stop}, {symbol}, {digit}, {rest}]"


def _js(p: str, q: str) -> str:
    term = "(case when {0} > 0 then -({0}) * log2({0}) else 0.0::double end)"
    pi, qi = f"({p})[i]", f"({q})[i]"
    both = f"(({pi} + {qi}) / 2)"
    inner = f"{term.format(both)} - ({term.format(pi)} + {term.format(qi)}) / 2"
    return f"round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {inner})), 0.0::double)), 6)"


_QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t,
         {_WORDS.format('text')} AS w
  FROM documents),
counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM base) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n_words FROM counts GROUP BY lang),
class_sums AS (
  SELECT lang, list(s ORDER BY i) AS c
  FROM (SELECT lang, i, sum(n * c[i])::double AS s FROM (SELECT lang, n, {_classes('word')} AS c, unnest(range(1, 8)) AS i FROM counts) GROUP BY ALL)
  GROUP BY lang),
tops AS (
  SELECT lang, list(word ORDER BY r) AS common, list(n / n_words ORDER BY r) AS share
  FROM (SELECT counts.*, n_words, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts JOIN totals USING (lang))
  WHERE r <= {_RULES.common_words} GROUP BY lang),
refs AS (
  SELECT lang, common, list_transform(c, lambda x: x / greatest(list_sum(c), 1)) AS class_share,
         list_append(share, greatest(1 - list_sum(share), 0.0::double)) AS word_share
  FROM class_sums JOIN tops USING (lang)),
windows AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
twice AS (SELECT row_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT row_id, count(DISTINCT i + k) AS n
  FROM windows JOIN twice USING (row_id, win) CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id),
measured AS (
  SELECT base.*, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, {_classes('t')} AS c,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(covered.n, 0) AS n_repeat_words, common, class_share, word_share,
         list_transform(common, lambda x: len(list_filter(w, lambda y: y = x)) / greatest(len(w), 1)) AS own
  FROM base LEFT JOIN covered USING (row_id) LEFT JOIN refs USING (lang)),
shared AS (
  SELECT *, list_transform(c, lambda x: x / greatest(list_sum(c), 1)) AS own_class,
         list_append(own, greatest(1 - list_sum(own), 0.0::double)) AS own_word
  FROM measured),
judged AS (
  SELECT doc_id, n_words::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars, c[5]::bigint AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
         n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeated_percent} * n_words AS base_failed,
         CASE WHEN word_chars >= {_RULES.min_chars} THEN {_js('own_class', 'class_share')} END AS class_distance,
         CASE WHEN n_words >= {_RULES.min_histogram_words} THEN {_js('own_word', 'word_share')} END AS word_distance
  FROM shared)
SELECT *, NOT base_failed AND NOT coalesce(class_distance > {_RULES.max_class_distance}, false)
          AND NOT coalesce(word_distance > {_RULES.max_word_distance}, false) AS kept
FROM judged
"""

_PASSAGES = rf"""
WITH base AS (SELECT row_number() OVER () AS row_id, coalesce(doc_id, 9223372036854775807) AS id, doc_id, {_WORDS.format('text')} AS w FROM documents),
windows AS (
  SELECT row_id, id, i, array_to_string(w[i:i + 49], ' ') AS win
  FROM (SELECT row_id, id, w, unnest(range(1, len(w) - 48)) AS i FROM base)),
firsts AS (SELECT win, min(id) AS lo FROM windows GROUP BY win HAVING min(id) < max(id)),
gone AS (SELECT row_id, list(DISTINCT i + k) AS places
         FROM windows JOIN firsts USING (win) CROSS JOIN (SELECT unnest(range(0, 50)) AS k) WHERE id > lo GROUP BY row_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(places), 0)::bigint AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE
         list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM base LEFT JOIN gone USING (row_id)
"""

def mixing_sql(temper: float = mixing.TEMPER) -> str:
    """Rows of the mix; the frame of the classes is played out slot by slot."""
    frame, docs = mixing.FRAME, mixing.BLOCK_DOCS
    return f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
weighed AS (
  SELECT *, round(least(pow(n_docs::double, {temper}), {mixing.MOST_EPOCHS} * n_docs::double * pow((SELECT max(n_docs)::double FROM sizes), {temper - 1!r})), 9) AS w FROM sizes),
shares AS (SELECT *, round(w / (SELECT sum(w::decimal(38,9))::double FROM weighed) * {frame}, 9) AS share FROM weighed),
powers AS (SELECT *, CASE WHEN share < 1 THEN floor(log2(greatest(share, 1e-9)))::int END AS power FROM shares),
entities AS (
  SELECT 1 AS kind, source AS name, 0 AS p, share AS e FROM powers WHERE power IS NULL
  UNION ALL SELECT 0, NULL, power, sum(share::decimal(38,9))::double FROM powers WHERE power IS NOT NULL GROUP BY power),
framed AS (SELECT *, count(*) OVER () AS k, greatest({frame}, count(*) OVER ()) AS f FROM entities),
ideals AS (SELECT *, round(e / sum(e) OVER () * (f - k), 6) AS ideal FROM framed),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY round(ideal - floor(ideal), 6) DESC, kind, name NULLS FIRST, p) AS r, f - k - sum(floor(ideal)) OVER () AS spare FROM ideals),
slotted AS (SELECT kind, name, p, f, (floor(ideal) + 1 + (r <= spare)::int)::int AS slots FROM ranked),
classed AS (
  SELECT source, n_docs, 'u' || slots AS class, slots, f FROM powers JOIN slotted ON power IS NULL AND kind = 1 AND source IS NOT DISTINCT FROM name
  UNION ALL SELECT source, n_docs, 'p' || p, slots, f FROM powers JOIN slotted ON kind = 0 AND power = p),
placed_sources AS (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY {unit_sql('turn', 'source')}, source) - 1 AS place, count(*) OVER (PARTITION BY class) AS m FROM classed),
units AS (SELECT source, class, f::bigint AS f, place, m, (CASE WHEN class LIKE 'u%' THEN slots * m ELSE slots END)::bigint AS u,
                 ceil(n_docs / {docs})::bigint AS b FROM placed_sources),
classes AS (SELECT DISTINCT class, u, f FROM units),
lists AS (SELECT list(class ORDER BY class) AS s, list(u::int ORDER BY class) AS u, max(f)::int AS f FROM classes),
edf(t, given, pick, u, f) AS (
  SELECT -1, list_transform(u, lambda x: 0), 0, u, f FROM lists
  UNION ALL
  SELECT t + 1, list_transform(given, lambda g, i: CASE WHEN i = best.k THEN g + 1 ELSE g END), best.k, u, f
  FROM (SELECT *, list_min(list_transform(
          list_filter(range(1, len(u) + 1), lambda k: given[k] < u[k] AND floor(given[k] * f / u[k]) <= t + 1),
          lambda k: {{'due': ceil((given[k] + 1) * f / u[k])::int, 'k': k::int}})) AS best
        FROM edf WHERE t + 1 < f)),
turns AS (SELECT s[pick] AS class, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM edf CROSS JOIN lists WHERE t >= 0),
horizon AS (
  SELECT max((((b - 1) * m + place) // units.u) * units.f + slot + 1) AS slots
  FROM units JOIN turns ON units.class = turns.class AND ((b - 1) * m + place) % units.u = turn),
rows AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {unit_sql("mix", "doc_id")}, doc_id) - 1 AS spot FROM documents),
epochs AS (
  SELECT doc_id, rows.source, spot, units.*, slots, unnest(range(0, ((ceil(slots / f) * u)::bigint // m) // b + 2)) AS epoch
  FROM rows JOIN units ON rows.source IS NOT DISTINCT FROM units.source CROSS JOIN horizon),
blocks AS (SELECT *, epoch * b + spot // {docs} AS i, (epoch * b + spot // {docs}) * m + place AS n FROM epochs)
SELECT doc_id, blocks.source, epoch::bigint AS epoch, i::bigint AS block,
       floor(i * blocks.f * m / blocks.u)::bigint AS release, ceil((i + 1) * blocks.f * m / blocks.u)::bigint AS deadline,
       ((n // blocks.u) * blocks.f + slot)::bigint AS slot, (((n // blocks.u) * blocks.f + slot) * {docs} + spot % {docs})::bigint AS position
FROM blocks JOIN turns ON blocks.class = turns.class AND n % blocks.u = turn
WHERE (n // blocks.u) * blocks.f + slot < slots
"""


_JACCARD = rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM base),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS total, count(*) AS k
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (total - k)),
reached(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT sets.doc_id, len(s)::bigint AS n_shingles, min(b) AS component_id
FROM sets JOIN reached ON sets.doc_id = reached.a GROUP BY sets.doc_id, s
"""

_LINES = f"""
WITH base AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
sets AS (
  SELECT DISTINCT source, list_sort(list_distinct(list_transform(list_filter(coalesce(lines, []), lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')))) AS k
  FROM base),
pages AS (SELECT source, count(*) AS n FROM sets GROUP BY source),
frequent AS (SELECT source, line, count(*) AS c FROM (SELECT source, unnest(k) AS line FROM sets) GROUP BY ALL HAVING count(*) >= {line_dedup.MIN_PAGES}),
listed AS (
  SELECT f.source, list(line) AS boilerplate FROM frequent f JOIN pages p ON f.source IS NOT DISTINCT FROM p.source
  WHERE c > {line_dedup.RATIO}::double * n GROUP BY f.source),
cut AS (
  SELECT base.doc_id, base.source, lines, list_filter(lines, lambda x: trim(x, ' ') = '' OR NOT list_contains(coalesce(boilerplate, []), trim(x, ' '))) AS kept
  FROM base LEFT JOIN listed ON base.source IS NOT DISTINCT FROM listed.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0)::bigint AS n_lines,
       coalesce(len(lines) - len(kept), 0)::bigint AS n_dropped
FROM cut
"""


def _rule_cases() -> str:
    cases = []
    for rule in sorted((r for r, _ in url_rules.RULES), key=lambda r: (-len(r), r)):
        host, slash, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + rest}') THEN '{rule}'")
    return "CASE " + " ".join(cases) + " END"


_URLS = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS row_id, page_id, coalesce(url, '') AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
listed AS (
  SELECT *, list_distinct(list_filter(list_concat(
      list_transform(string_split(host, '.'), lambda x: 'h:' || x),
      list_transform(flatten(list_transform(list_filter(string_split(host, '.'), lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: 'w:' || x),
      list_transform(regexp_split_to_array(lower(path), '[^\p{{L}}]+'), lambda x: 'p:' || x),
      list_transform(regexp_extract_all(u, '[?&]([^=&#]+)', 1), lambda x: 'q:' || lower(x)),
      ['s:' || lower(regexp_extract(u, '(?s)^(.*?)://', 1))]), lambda x: length(x) > 2)) AS tokens
  FROM cut),
bad AS (SELECT doc_id, max((coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0)::int) AS b FROM labels GROUP BY doc_id),
labelled AS (SELECT row_id, tokens, b FROM listed JOIN bad ON page_id = doc_id),
one AS (SELECT row_id, b, unnest(tokens) AS x FROM labelled),
subsets AS (
  SELECT row_id, b, [x] AS items FROM one
  UNION ALL SELECT o.row_id, o.b, [o.x, p.x] FROM one o JOIN one p ON o.row_id = p.row_id AND o.x < p.x
  UNION ALL SELECT o.row_id, o.b, [o.x, p.x, q.x] FROM one o JOIN one p ON o.row_id = p.row_id AND o.x < p.x JOIN one q ON o.row_id = q.row_id AND p.x < q.x),
counted AS (
  SELECT items, sum(b) / count(*) AS p, count(*)::double AS n, {url_rules.DEVIATIONS}::double * len(items) AS z FROM subsets GROUP BY items
  HAVING sum(b) >= {url_rules.LEAST_BLOCKED}),
mined AS (
  SELECT items, p AS confidence FROM counted
  WHERE p >= {url_rules.MIN_CONFIDENCE}
    AND round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) > (SELECT round(avg(b), 9) FROM labelled)),
hits AS (SELECT row_id, max(confidence) AS confidence FROM listed JOIN mined ON list_has_all(tokens, items) GROUP BY row_id),
judged AS (SELECT page_id, host, path, {_rule_cases()} AS rule, coalesce(confidence, 0.0) AS confidence FROM listed LEFT JOIN hits USING (row_id))
SELECT page_id, host, path, rule, confidence,
       CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in url_rules.RULES)} WHEN confidence > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


def _clusters() -> str:
    d, k = bisectors.DIMS, bisectors.CENTROIDS
    too_large = f"abs({bisectors.SCALE} * x::double) >= {bisectors.LARGEST}"
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor({bisectors.SCALE} * x::double)) AS v
  FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR {too_large})) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('1:' || coalesce(cast(vec_id AS varchar), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(bisectors.ROUNDS + 1):
        apart = "list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v)"
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT row_id, min({{'d': {apart}, 'c': c.c}}) AS best FROM kept k CROSS JOIN c{r} c GROUP BY row_id)""")
        if r < bisectors.ROUNDS:
            parts.append(f"""m{r} AS (
  SELECT c, list(x ORDER BY i) AS v FROM (
    SELECT best.c AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{r} JOIN kept USING (row_id), range(1, {d + 1}) g(i) GROUP BY best.c, i)
  GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c)""")
    r = bisectors.ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, best.c::int AS cluster, best.d::bigint AS distance,
       sum(best.d::bigint) OVER (PARTITION BY best.c)::bigint AS cluster_inertia, sum(best.d::bigint) OVER ()::bigint AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: cast(x::bigint AS varchar)), ',')) AS centroid_sha256
FROM a{r} JOIN kept USING (row_id) JOIN c{r} c ON c.c = best.c
"""


ORACLES: dict[str, str] = {
    "op1_quality_divergence": _QUALITY,
    "op2_passage_automata": _PASSAGES,
    "op5_pfair_mixing": mixing_sql(),
    "op7_jaccard_join": _JACCARD,
    "op9_site_lines": _LINES,
    "op10_url_rules": _URLS,
    "op11_bisector_tournament": _clusters(),
}
