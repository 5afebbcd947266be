"""SQL that gives the rows of those corpus queries that SQL can express, written for DuckDB and apart from the operators."""

from __future__ import annotations

from scriptoria.llm import pii
from scriptoria.llm.mixing import BLOCK_ROWS, PARTS
from scriptoria.llm.secrets import ALLOWED, BASE_KINDS, CANDIDATE, STRETCH, THRESHOLDS, WINDOW


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _pieces(kind: str, pattern: str, texts: str) -> str:
    """Matches of a pattern in texts (doc_id, text) with their starts, from the pieces between them."""
    p = _quoted(pattern)
    return f"""m_{kind} AS (SELECT doc_id, i, m[i] AS piece, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM {texts})))"""


def _blanked(name: str, spans: str, texts: str) -> str:
    """texts with a blank for each character that spans (doc_id, listed, start, stop) cover."""
    return f"""{name}_parts AS (SELECT doc_id, listed, start, stop, coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY start, listed ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM {spans}),
  {name}_done AS (SELECT doc_id, string_agg(substring(text, done + 1, greatest(start - done, 0)) || repeat(' ', greatest(stop - greatest(start, done), 0)), '' ORDER BY start, listed) || substring(any_value(text), max(stop) + 1) AS text
    FROM {name}_parts JOIN {texts} USING (doc_id) GROUP BY doc_id),
  {name} AS (SELECT t.doc_id, coalesce(n.text, t.text) AS text FROM {texts} t LEFT JOIN {name}_done n USING (doc_id))"""


def secrets_sql() -> str:
    parts = [_pieces(kind, pattern, "whole") for kind, (pattern, _, _) in BASE_KINDS.items()]
    base = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS listed, '{kind}' AS kind, start, start + length(piece) AS stop FROM m_{kind} WHERE length({f'regexp_extract(piece, {_quoted(pattern)}, {group})' if group else 'piece'}) >= {least}"
        for n, (kind, (pattern, group, least)) in enumerate(BASE_KINDS.items())
    )
    plain = " OR ".join(f"regexp_matches(piece, {_quoted(p)})" for p in ALLOWED)
    bits = f"CASE WHEN regexp_matches(piece, '^[0-9a-fA-F-]+$') THEN {THRESHOLDS['hex']} WHEN regexp_matches(piece, '^[A-Za-z0-9]+$') THEN {THRESHOLDS['alnum']} ELSE {THRESHOLDS['base64']} END"
    most = f"list_max(list_transform(range(1, greatest(1, length(piece) - {WINDOW - 1}) + 1), lambda i: list_entropy(string_split(substring(piece, i, {WINDOW}), ''))))"
    return f"""WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(parts)}, base AS ({base}),
    {_blanked("without_base", "base", "whole")}, {_pieces("allowed", STRETCH, "without_base")},
    stretches AS (SELECT doc_id, 0 AS listed, start, start + length(piece) AS stop FROM m_allowed),
    {_blanked("rest", "stretches", "without_base")}, {_pieces("entropy", CANDIDATE, "rest")},
    random AS (SELECT doc_id, 3 AS listed, 'entropy' AS kind, start, start + length(piece) AS stop FROM m_entropy WHERE NOT ({plain}) AND {most} >= {bits}),
    spans AS (FROM base UNION ALL FROM random),
    sums AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, listed) FILTER (listed < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, listed) AS spans FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN sums USING (doc_id)"""


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, url, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url, true AS intact FROM f"""

MIX_SQL = f"""WITH RECURSIVE s AS (SELECT source, count(*) AS n, CAST(ceil(count(*) / {BLOCK_ROWS}) AS BIGINT) AS blocks FROM documents GROUP BY source),
u AS (SELECT source, blocks, CAST(greatest(1, round(pow(n, 0.5) * {PARTS} / sum(pow(n, 0.5)) OVER ())) AS BIGINT) AS units FROM s),
l AS (SELECT list({{'source': source, 'units': units, 'blocks': blocks}} ORDER BY source NULLS FIRST) AS srcs, CAST(sum(units) AS BIGINT) AS whole, CAST(sum(blocks) AS BIGINT) AS n_blocks FROM u),
run(slot, done, base, since, period, pick, ran) AS (SELECT CAST(-1 AS BIGINT), list_transform(srcs, lambda x: CAST(0 AS BIGINT)), list_transform(srcs, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT), whole, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM l
  UNION ALL SELECT slot, list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END), CASE WHEN gone THEN list_transform(done, lambda d, i: CASE WHEN i = p THEN d + 1 ELSE d END) ELSE base END,
    CASE WHEN gone THEN slot + 1 ELSE since END, CASE WHEN gone THEN period - srcs[p].units ELSE period END, p, done[p] FROM (
    SELECT *, done[p] + 1 = srcs[p].blocks AS gone FROM (SELECT r.slot + 1 AS slot, done, base, since, period, srcs,
      list_min(list_filter(list_transform(range(1, len(srcs) + 1), lambda i: {{'deadline': since + ((done[i] + 1 - base[i]) * period + srcs[i].units - 1) // srcs[i].units, 'i': i, 'release': since + ((done[i] - base[i]) * period) // srcs[i].units, 'left': srcs[i].blocks - done[i]}}),
        lambda w: w.left > 0 AND w.release <= r.slot + 1)).i AS p FROM run r, l WHERE r.slot + 1 < n_blocks))),
seen AS (SELECT slot, srcs[pick].source AS source, srcs[pick].units AS units, ran AS block, pick, coalesce(lag(since) OVER (ORDER BY slot), 0) AS start, coalesce(lag(period) OVER (ORDER BY slot), 0) AS period, lag(base) OVER (ORDER BY slot) AS base FROM run, l),
slots AS (SELECT *, (block - base[pick]) * period // units AS release, ((block - base[pick] + 1) * period + units - 1) // units AS deadline FROM seen WHERE slot >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS number FROM documents)
SELECT d.doc_id, d.source, block AS mix_block, units AS mix_units, CAST(period AS BIGINT) AS mix_period, CAST(release AS BIGINT) AS mix_release, CAST(deadline AS BIGINT) AS mix_deadline, CAST(slot AS BIGINT) AS mix_slot,
  CAST(start AS BIGINT) AS mix_start, CAST(slot * {BLOCK_ROWS} + number % {BLOCK_ROWS} AS BIGINT) AS mix_position FROM d JOIN slots p ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.number // {BLOCK_ROWS}"""


def _context_score(kind: pii.Kind) -> str:
    around = "translate(right(before, {n}) || ' ' || left(after, {n}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format(n=pii.CONTEXT)
    words = [f"CASE WHEN regexp_matches({around}, {_quoted(pii.word_pattern(w))}) THEN {gain} ELSE 0 END" for w, gain in ((kind.helped_by, pii.WORD_GAIN), (kind.hurt_by, -pii.WORD_GAIN)) if w]
    return f"least(100, {' + '.join([str(kind.prior), *words])})"


# How SQL confirms a match (column piece, d its digits), written apart from the operator's expressions.
_DIGIT = "CAST(substring(d, length(d) - i, 1) AS INTEGER)"
_COMPACT = "replace(piece, ' ', '')"
PII_CONFIRMED = {
    "ip": "len(list_filter(string_split(piece, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0",
    "card": f"length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN {_DIGIT} ELSE 2 * {_DIGIT} // 10 + 2 * {_DIGIT} % 10 END)) % 10 = 0",
    "phone": "length(d) BETWEEN 9 AND 15",
    # the remainder by 97 of up to 68 digits, seven at a time
    "iban": f"""list_reduce(list_transform(regexp_extract_all(list_reduce(list_transform(string_split(substring({_COMPACT}, 5) || left({_COMPACT}, 4), ''), lambda c: CASE WHEN c >= 'A' THEN CAST(unicode(c) - 55 AS VARCHAR) ELSE c END), lambda a, b: a || b), '.{{1,7}}'),
      lambda x: [CAST(x AS BIGINT), length(x)]), lambda a, b: [(a[1] * CAST(pow(10, b[2]) AS BIGINT) + b[1]) % 97, 0])[1] % 97 = 1""",
    "nir": "substring(d, 4, 2) BETWEEN '01' AND '12' AND 97 - CAST(left(d, 13) AS BIGINT) % 97 = CAST(right(d, 2) AS BIGINT)",
    "ssn": "left(piece, 3) NOT IN ('000', '666') AND left(piece, 3) < '900' AND substring(piece, 5, 2) <> '00' AND right(piece, 4) <> '0000'",
}


def _pii_kind(name: str, texts: str) -> str:
    kind, listed = pii.KINDS[name], list(pii.KINDS).index(name)
    pattern, size = _quoted(kind.plain or kind.pattern), "length(piece)"
    if name == "iban":
        whole = "(MAP {" + ", ".join(f"'{c}': {n}" for c, n in pii.IBAN_LENGTHS.items()) + "})[left(piece, 2)]"
        size = f"CASE WHEN substring(piece, 5, 1) = ' ' THEN {whole} + CAST(ceil({whole} / 4.0) AS INTEGER) - 1 ELSE {whole} END"
    apart = f"NOT regexp_matches(before, '[{kind.apart}]$') AND NOT regexp_matches(substring(whole, size + 1) || after, '^[{kind.apart}]')" if kind.apart else "true"
    enough = "true" if name in pii.BASE_KINDS else f"score >= {pii.ENOUGH}"
    return f"""f_{name} AS (SELECT doc_id, piece AS whole, coalesce(before, '') AS before, coalesce(after, '') AS after, CAST(sum(length(before) + length(piece)) OVER (PARTITION BY doc_id ORDER BY i) - length(piece) AS BIGINT) AS start, {size} AS size
    FROM (SELECT doc_id, i, m[i] AS piece, g[i] AS before, g[i + 1] AS after FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {pattern}) AS m, string_split_regex(text, {pattern}) AS g FROM {texts})))),
  p_{name} AS (SELECT *, left(whole, size) AS piece, regexp_replace(left(whole, size), '[^0-9]', '', 'g') AS d, {_context_score(kind)} AS score FROM f_{name} WHERE size <= length(whole) AND {apart}),
  s_{name} AS (SELECT doc_id, {listed} AS listed, '{name}' AS kind, start, start + size AS stop, score FROM p_{name} WHERE {enough} AND CASE WHEN {PII_CONFIRMED.get(name, "true")} THEN true ELSE false END)"""


def pii_sql() -> str:
    first, rest = [*pii.BASE_KINDS, *pii.BESIDE_BASE], list(pii.IN_THE_REST)
    together = lambda names: " UNION ALL ".join(f"FROM s_{n}" for n in names)
    base, line = len(pii.BASE_KINDS), "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE_KINDS)
    shown = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE_KINDS)
    return f"""WITH whole_texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(_pii_kind(n, "whole_texts") for n in first)}, first_spans AS ({together(first)}),
    {_blanked("rest", "first_spans", "whole_texts")}, {", ".join(_pii_kind(n, "rest") for n in rest)}, spans AS (FROM first_spans UNION ALL {together(rest)}),
    sums AS (SELECT doc_id, {counts}, string_agg({line}, ',' ORDER BY start, listed) FILTER (listed < {base}) AS base, string_agg({line}, ',' ORDER BY start, listed) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, listed) AS scores FROM spans GROUP BY doc_id)
    SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents LEFT JOIN sums USING (doc_id)"""


RANKED_SQL = """WITH texts AS (SELECT doc_id, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark)),
docs AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, words FROM texts WHERE doc_id IS NOT NULL AND len(words) > 0),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(words) AS term FROM texts WHERE item_id IS NOT NULL) GROUP BY ALL),
sizes AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, sizes GROUP BY term),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM held JOIN weights USING (term) JOIN asked USING (term), sizes GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""

_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"


def merkle_sql() -> str:
    digest = lambda text: f"sha256({' || '.join(_FIELD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    tree = lambda name, leaves: f"""{name}(tree, level, place, h, size) AS (SELECT tree, 0, place, h, size FROM {leaves}
    UNION ALL SELECT tree, any_value(level) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(size) + 2) // 3 FROM {name} WHERE size > 1 GROUP BY tree, place // 3)"""  # noqa: E731
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: " + "{0})"
    steps = "xor(a, b)"
    for _ in range(8):
        steps = f"list_transform([{steps}], lambda v: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)[1]"
    odd = f"xor({crc.format(steps)}, 4294967295) % 2"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, source, coalesce('=' || source, '') AS tree, {digest("text")} AS h, CASE WHEN {odd} = 0 THEN {digest("replace(text, chr(10), '')")} ELSE {digest("text")} END AS claimed FROM documents),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM leaves),
  {tree("inner_nodes", "placed")},
  subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS number, count(*) OVER () AS size FROM inner_nodes WHERE size = 1),
  over_leaves AS (SELECT '' AS tree, number AS place, subroot AS h, size FROM subroots), {tree("outer_nodes", "over_leaves")},
  highest AS (SELECT tree, max(level) AS top FROM inner_nodes GROUP BY tree),
  nodes AS (SELECT tree, level, place, h FROM inner_nodes WHERE size > 1 UNION ALL SELECT s.tree, top + o.level, o.place, o.h FROM outer_nodes o, subroots s JOIN highest USING (tree) WHERE o.size > 1),
  ways AS (SELECT p.doc_id, p.h AS leaf, p.tree, l.level, CASE WHEN l.level < top THEN p.place // CAST(pow(3, l.level) AS BIGINT) ELSE number // CAST(pow(3, l.level - top) AS BIGINT) END AS own
    FROM placed p JOIN highest USING (tree) JOIN subroots USING (tree) JOIN (SELECT DISTINCT tree, level FROM nodes) l USING (tree)),
  beside AS (SELECT w.doc_id, w.leaf, w.level, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place < own), '') AS before, coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place > own), '') AS after
    FROM ways w JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND n.place // 3 = own // 3 GROUP BY w.doc_id, w.leaf, w.level),
  proofs AS (SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM beside GROUP BY doc_id, leaf),
  folded(doc_id, leaf, level, node) AS (SELECT doc_id, h, 0, claimed FROM placed UNION ALL SELECT f.doc_id, f.leaf, f.level + 1, sha256(before || node || after) FROM folded f JOIN beside b ON b.doc_id = f.doc_id AND b.leaf = f.leaf AND b.level = f.level),
  ends AS (SELECT doc_id, leaf, arg_max(node, level) AS folded_root FROM folded GROUP BY doc_id, leaf), root AS (SELECT h AS root FROM outer_nodes WHERE size = 1)
  SELECT p.doc_id, p.h AS leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
  FROM placed p JOIN subroots USING (tree), root, ends e LEFT JOIN proofs q ON q.doc_id = e.doc_id AND q.leaf = e.leaf WHERE e.doc_id = p.doc_id AND e.leaf = p.h"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets_sql(), "op5_warc": WARC_SQL, "op9_mix_sources": MIX_SQL, "op11_pii": pii_sql(), "op12_ranked": RANKED_SQL, "op13_merkle": merkle_sql()}
