"""SQL that gives the rows of the queries which SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from .quality_rules import BASE, RULES, STOP_WORDS
from .url_filter import RULES as URL_RULES

A_TO_Z = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]+"


def broken(rule) -> str:
    of = rule.denominator or "1"
    bounds = ([f"{rule.numerator} < {rule.least} * {of}"] if rule.least is not None else []) + ([f"{rule.numerator} > {rule.most} * {of}"] if rule.most is not None else [])
    return "(" + " OR ".join(bounds) + ")"


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i:i+2] AS k FROM w, LATERAL (SELECT unnest(generate_series(1, len(words) - 2)) AS i) t WHERE len(words) >= 3),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c >= 2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '{SPACE}', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS n_upper,
 len(list_filter(words, lambda x: lower(x) IN ({STOPS}))) AS n_stop FROM w LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, {' OR '.join(map(broken, BASE))} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({' OR '.join(map(broken, RULES))}) AS kept FROM v"""


def rule_case(out: str, host: str = "host", path: str = "path") -> str:
    order = sorted(URL_RULES, key=lambda r: (-len(r.name), r.verdict != "allow"))
    return "CASE " + " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.name if out == 'rule' else r.verdict}'" for r in order) + " END"


def node(rest: str) -> str:
    kept = rf"regexp_replace('&' || regexp_extract({rest}, '^[^?#]*\?([^#]*)', 1), '&(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g')"
    h = A_TO_Z.format(f"regexp_extract({rest}, '^[^/?#]*')")
    return f"CASE WHEN {h} <> '' THEN {h} || regexp_replace(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '/+$', '') || CASE WHEN {kept} = '&' THEN '' ELSE {kept} END END"


REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
#: Attribute values, with the references that addresses hold decoded.
def attr(tag: str, name: str) -> str:
    each = rf"""list_filter(regexp_extract_all({tag}, '(?is)[^\s"''>/=]+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+)'), lambda a: regexp_matches(a, '(?i)^{name}\s*='))[1]"""
    value = " || ".join(rf"""regexp_extract(coalesce({each}, ''), '(?s)^[^=]*=\s*(?:"([^"]*)"|''([^'']*)''|(.*))$', {k})""" for k in (1, 2, 3))
    for plain, written in (("&", "amp|#38|#x0*26"), ("/", "sol|#47|#x0*2f"), (":", "colon|#58|#x0*3a"), (".", "period|#46|#x0*2e")):
        value = f"regexp_replace({value}, '(?i)&(?:{written});', '{plain}', 'g')"
    return value


def seen_from(base: str, target: str) -> str:
    t = f"regexp_replace(trim({target}), '#.*$', '')"
    before, folder = f"regexp_extract({base}, '^(.*?://[^/?#]*)', 1)", f"regexp_replace(regexp_extract({base}, '^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"
    return f"""CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {t} WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with({t}, '//') THEN 'http:' || {t} WHEN {before} = '' OR {t} = '' THEN NULL
 WHEN starts_with({t}, '/') THEN {before} || {t} WHEN starts_with({t}, '?') THEN regexp_replace({base}, '[?#].*$', '') || {t} ELSE {before} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {t} END"""


def straight(url: str) -> str:
    steps = f"string_split(regexp_extract({url}, '^.*?://[^/?#]*/?([^?#]*)', 1), '/')"
    walk = f"list_reduce({steps}, lambda d, s: CASE WHEN s = '..' THEN regexp_replace(d, '/[^/]*$', '') WHEN s = '.' THEN d ELSE d || '/' || s END, '')"
    return f"CASE WHEN regexp_matches({url}, '/\\.{{1,2}}(/|[?#]|$)') THEN regexp_extract({url}, '^(.*?://[^/?#]*)', 1) || {walk} || regexp_extract({url}, '([?][^#]*)', 1) ELSE {url} END"


#: What is no markup, in the order in which it can begin; RE2 has no back references.
NO_MARKUP = r"(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|$)" for t in "script style textarea title xmp iframe noembed noframes".split())
TAGS = r"""(?is)<(?:link|meta|base)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
OP8 = rf"""WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce({REST.format('url')}, '') AS rest FROM pages),
q AS (SELECT page_id, url, html, {A_TO_Z.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {node('rest')} AS node FROM p),
j AS (SELECT *, {rule_case('rule')} AS rule, {rule_case('verdict')} AS own FROM q),
g AS (SELECT url, node AS a, regexp_extract_all(regexp_replace(html, '{NO_MARKUP}', ' ', 'g'), '{TAGS}') AS tags FROM j),
k AS (SELECT url, a, list_filter(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<base\b')), lambda t: {attr('t', 'href')}), lambda v: v <> '')[1] AS based,
 unnest(list_concat(list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<link\b') AND list_contains(regexp_split_to_array(lower({attr('t', 'rel')}), '\s+'), 'canonical')), lambda t: {attr('t', 'href')}),
 list_transform(list_filter(tags, lambda t: regexp_matches(t, '(?i)^<meta\b') AND lower(trim({attr('t', 'http-equiv')})) = 'refresh'), lambda t: regexp_extract({attr('t', 'content')}, '(?is)\burl\s*=\s*["'']?([^"'']+)', 1)))) AS target FROM g),
kb AS (SELECT a, target, {seen_from('url', 'based')} AS rb, url FROM k WHERE target <> ''), kc AS (SELECT a, target, coalesce({straight('rb')}, url) AS base FROM kb),
kd AS (SELECT a, {seen_from('base', 'target')} AS far FROM kc), ke AS (SELECT a, {straight('far')} AS far FROM kd),
u AS (SELECT a, substr(far, instr(far, '://') + 3) AS rest FROM ke WHERE far IS NOT NULL),
e AS (SELECT DISTINCT a, {node('rest')} AS b FROM u WHERE rest IS NOT NULL), e2 AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
n AS (SELECT node, own FROM j WHERE node IS NOT NULL UNION ALL SELECT {node('rest')}, {rule_case('verdict', A_TO_Z.format("regexp_extract(rest, '^[^/?#]*')"), "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1)")} FROM u WHERE rest IS NOT NULL),
reach(x, y) AS (SELECT DISTINCT node, node FROM n UNION SELECT r.x, e2.b FROM reach r JOIN e2 ON e2.a = r.y),
blocked AS (SELECT r.x AS node FROM reach r JOIN n ON n.node = r.y GROUP BY r.x HAVING bool_or(n.own = 'block') AND NOT coalesce(bool_or(n.own = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE b.node = j.node) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""

LOW = A_TO_Z.format("coalesce(text, '')")
OP9 = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({LOW}, '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' ')) END) AS k FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.b FROM reach r JOIN l ON l.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM reach r WHERE r.x = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP10 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{WORD}') AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOW}, '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i+12], ' ') AS k FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i) t WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS k FROM d, (SELECT DISTINCT n FROM iw) z, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) t WHERE len(w) >= n),
h AS (SELECT doc_id, i, dw.n, item FROM dw JOIN iw USING (n, k)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: crc32 of a decimal number, bit by bit: DuckDB has no such function.
BITS = "list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: list_transform(range(8), lambda i: (ascii(d)::BIGINT >> i) & 1))))"
CRC = f"xor(list_reduce({BITS}, lambda r, b: CASE WHEN xor(r, b) & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295)"
OP11 = f"""WITH t AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, own, {CRC} % 9 AS h FROM t),
r AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h+1:]) AS p FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5),
m AS (SELECT c, len(p) AS n, d, p[1:d] AS k, p[1:d-1] AS up FROM r, LATERAL (SELECT unnest(range(len(p) + 1)) AS d) x),
n AS (SELECT k, any_value(CASE WHEN d > 0 THEN up END) AS up, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends, CASE WHEN d > 0 THEN strlen(any_value(k[-1].text)) ELSE 0 END AS size FROM m GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
s AS (SELECT k[1:j] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM w, LATERAL (SELECT unnest(range(d + 1)) AS j) x GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256 FROM w JOIN s USING (k) LEFT JOIN w p ON w.d > 0 AND p.d = w.d - 1 AND p.k = w.up"""

OP13 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM reach r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.x = vec_id"""

ORACLES = {"op7_quality_rules": OP7, "op8_url_filter": OP8, "op9_jaccard_join": OP9, "op10_decontamination": OP10, "op11_prefix_trie": OP11, "op13_cover_tree": OP13}
