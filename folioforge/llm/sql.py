"""SQL for the operators that it can express, from the operators' own parameters."""

from __future__ import annotations

from folioforge.llm import collocations as c
from folioforge.llm import manifest as m
from folioforge.llm import quality_rules as q
from folioforge.llm import secret_scan as s


def quality_rules() -> str:
    gamma = (1 + q.ACCURACY) / (1 - q.ACCURACY)
    space = "\\x20\\x09-\\x0D"
    rules = ", ".join(f"{{'rule': '{r}', 'v': CASE WHEN {d} > 0 THEN {n}::DOUBLE / {d} ELSE 0.0 END, 'reach': {reach}::DOUBLE, 'part': {part}::DOUBLE, 'two': {str(two).lower()}}}" for r, (n, d, reach, part, two) in q.RULES.items())

    def quantiles(name: str, by: str) -> str:
        keys = f"{by}, rule" if by else "rule"
        return f"""
{name}_n AS (SELECT {keys}, bucket, count(*) AS n FROM b GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}) AS n_docs,
  sum(CASE WHEN bucket = {q.ZERO} THEN n ELSE 0 END) OVER (PARTITION BY {keys}) AS zeros,
  CASE WHEN bucket = {q.ZERO} THEN 0.0 ELSE 2 * pow({gamma!r}::DOUBLE, bucket) / {gamma + 1!r}::DOUBLE END AS value FROM {name}_n),
{name} AS (SELECT {keys}, min(CASE WHEN upto >= ceil(0.25 * n_docs) THEN value END) AS q25, min(CASE WHEN upto >= ceil(0.75 * n_docs) THEN value END) AS q75,
  coalesce(min(CASE WHEN bucket <> {q.ZERO} AND 10 * (upto - zeros) >= 9 * (n_docs - zeros) THEN value END), 0.0) AS top, max(n_docs)::BIGINT AS n_docs, max(n_docs - zeros)::BIGINT AS n_some FROM {name}_c GROUP BY {keys})"""

    def blend(wider: str) -> str:
        return ", ".join(f"({n} * {c} + {q.PRIOR} * {wider}_{c}) / ({n} + {q.PRIOR}) AS {c}" for c, n in q.STATISTICS.items())

    def renamed(name: str) -> str:
        return ", ".join(f"{c} AS {name}_{c}" for c in q.STATISTICS)

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[{space}]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i : i + {q.WINDOW - 1}], chr(10)) AS win FROM w, unnest(range(1, len(ws) - {q.WINDOW - 2})) u(i)),
r AS (SELECT doc_id, win FROM g GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g JOIN r USING (doc_id, win), range({q.WINDOW}) o(k) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{space}]') GROUP BY 1),
m AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN ln USING (doc_id)
), f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.REPEAT_PERCENT} * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, base_failed, x.rule AS rule, x.v AS v, x.reach AS reach, x.part AS part, x.two AS two, p FROM (SELECT *, unnest([{rules}]) AS x, generate_subscripts([{', '.join('0' for _ in q.RULES)}], 1) AS p FROM f)),
b AS (SELECT *, CASE WHEN v < {q.SMALLEST!r} THEN {q.ZERO} ELSE ceil(ln(v) / ln({gamma!r}::DOUBLE))::INTEGER END AS bucket FROM v WHERE NOT base_failed),
{quantiles('own', 'lang, source')}, {quantiles('l', 'lang')}, {quantiles('a', '')},
lb AS (SELECT lang, rule, {blend('a')} FROM l JOIN (SELECT rule, {renamed('a')} FROM a) USING (rule)),
e AS (SELECT lang, source, rule, {blend('l')} FROM own JOIN (SELECT lang, rule, {renamed('l')} FROM lb) USING (lang, rule)),
j AS (
  SELECT doc_id, string_agg(v.rule, ',' ORDER BY p) AS broken FROM v JOIN e USING (lang, source, rule)
  WHERE v > q75 + greatest(reach * (q75 - q25), part * top) OR (two AND v < q25 - greatest(reach * (q75 - q25), part * top)) GROUP BY 1
)
SELECT doc_id, {', '.join(q.COUNTS)}, base_failed, NOT base_failed AND broken IS NULL AS kept,
  concat_ws(',', CASE WHEN base_failed THEN 'base' END, broken) AS failed_rules FROM f LEFT JOIN j USING (doc_id)
"""


def secret_scan() -> str:
    parts, spans = [], []
    for k, r in enumerate(s.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"regexp_extract_all(t, '{pattern}', 0) AS m{k}, [length(x) FOR x IN string_split_regex(t, '{pattern}')] AS p{k}, regexp_extract_all(t, '{pattern}', {r.group}) AS g{k}"
        )
        start = f"list_sum(p{k}[1 : i])::BIGINT + coalesce(list_sum([length(x) FOR x IN m{k}[1 : i - 1]]), 0)::BIGINT"
        spans.append(f"[{{'a': {start}, 'k': {k}, 'b': {start} + length(m{k}[i])}} FOR i IN range(1, len(m{k}) + 1) IF length(g{k}[i]) >= {r.least}]")
    names = "[" + ", ".join(f"'{r.kind}'" for r in s.RULES) + "]"
    base = [k for k, r in enumerate(s.RULES) if r.base]
    shown = lambda rows: f"array_to_string([{names}[x.k + 1] || ':' || x.a || ':' || x.b FOR x IN {rows}], ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(parts)} FROM d),
x AS (SELECT doc_id, list_sort(flatten([{', '.join(spans)}])) AS found FROM m)
SELECT doc_id, {', '.join(f"len([1 FOR x IN found IF x.k = {k}])::BIGINT AS n_{s.RULES[k].kind}" for k in base)},
  sha256({shown(f"list_filter(found, lambda x: x.k < {len(base)})")}) AS base_sha256, {shown("found")} AS spans FROM x
"""


def merkle_manifest() -> str:
    shown = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(shown(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    steps = "list_prepend(4294967295, flatten([list_concat([ord(c)], [-1 FOR _ IN range(8)]) FOR c IN string_split(doc_id::VARCHAR, '')]))"
    crc = f"xor(4294967295, list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
    grown = f"""SELECT tree, h + 1, i // {m.FAN}, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {{0}}) WHERE c > 1 GROUP BY tree, h, i // {m.FAN}"""
    return f"""
WITH RECURSIVE
l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, {leaf(f"translate(text, '{m.UPPER}', '{m.UPPER.lower()}')")} AS lowered, {crc} % {m.TAMPERED_ONE_IN} = 0 AS tampered FROM documents),
o AS (SELECT row_number() OVER () AS key, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
nodes(tree, h, i, d) AS (SELECT tree, 0, i, leaf FROM o UNION ALL {grown.format('nodes')}),
s AS (SELECT tree, max(h) AS top, arg_max(d, h) AS subroot FROM nodes GROUP BY tree),
t AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS i FROM s),
tops(tree, h, i, d) AS (SELECT '', 0, i, subroot FROM t UNION ALL {grown.format('tops')}),
r AS (SELECT tree, h, i // {m.FAN} AS run, list(d ORDER BY i) AS ds FROM nodes GROUP BY ALL),
u AS (SELECT h, i // {m.FAN} AS run, list(d ORDER BY i) AS ds FROM tops GROUP BY ALL),
p AS (
  SELECT key, r.h AS step, (o.i >> ({m.BITS} * r.h)) % {m.FAN} AS slot, ds FROM o JOIN s USING (tree) JOIN r ON r.tree = o.tree AND r.h < s.top AND r.run = o.i >> ({m.BITS} * (r.h + 1))
  UNION ALL
  SELECT key, t.top + u.h, (t.i >> ({m.BITS} * u.h)) % {m.FAN}, ds FROM o JOIN t USING (tree) JOIN u ON u.h < (SELECT max(h) FROM tops) AND u.run = t.i >> ({m.BITS} * (u.h + 1))
),
f(key, step, d) AS (
  SELECT key, 0, CASE WHEN coalesce(tampered, false) THEN lowered ELSE leaf END FROM o
  UNION ALL SELECT f.key, f.step + 1, sha256(array_to_string(list_concat(list_append(list_slice(ds, 1, slot), d), list_slice(ds, slot + 2, {m.FAN})), '')) FROM f JOIN p ON p.key = f.key AND p.step = f.step
),
g AS (SELECT key, arg_max(d, step) AS folded_root FROM f GROUP BY key),
q AS (SELECT key, sha256(string_agg(array_to_string(list_concat(list_slice(ds, 1, slot), list_slice(ds, slot + 2, {m.FAN})), ''), '' ORDER BY step)) AS proof FROM p GROUP BY key),
z AS (SELECT arg_max(d, h) AS root FROM tops)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o JOIN s USING (tree) JOIN g USING (key) LEFT JOIN q USING (key), z
"""


def collocations() -> str:
    words = "string_split(phrase, ' ')"
    return f"""
WITH p AS (SELECT coalesce(lang, '{c.UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{c.UPPER}', '{c.UPPER.lower()}'), '{c.BREAKS}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '{c.BLANKS}'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k AS m, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, {c.LONGEST + 1})) AS k FROM w), unnest(range(1, len(ws) - k + 2)) u(i)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
a AS (SELECT lang, m, phrase, f AS a, {words} AS ws FROM f WHERE m >= 2 AND f >= {c.LEAST}),
k AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS rest FROM a, unnest(range(1, m)) u(k)),
s AS (SELECT k.lang, k.m, k.phrase, a, k, h.f AS l, r.f AS r, (({c.SCALE}::HUGEINT * a * a) // (h.f::HUGEINT * r.f))::BIGINT AS score FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.rest),
b AS (SELECT lang, m, phrase, a, unnest(min({{'score': score, 'k': k, 'l': l, 'r': r}})) FROM s GROUP BY lang, m, phrase, a),
c AS (SELECT lang, array_to_string(ws[i : i + z - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(2, m)) AS z FROM a WHERE m >= 3), unnest(range(1, m - z + 2)) u(i) GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN c ON c.lang = b.lang AND c.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {c.COVERED_PERCENT} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {c.BEST}
"""
