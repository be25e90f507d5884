"""DuckDB SQL that the llm queries are held against, where SQL can express them.

Not here: op3, op4 and op6, whose tokenizers SQL cannot express; they are tested against the
tokenizer library, exact round trips and plain restatements.
"""

from __future__ import annotations

import math

from gridloom.llm.decontaminate import WORD as SMALL_WORD
from gridloom.llm.quality import QualityRules
from gridloom.llm.secrets import ALLOWED, CANDIDATE, KINDS, SCALE, EntropyRules
from gridloom.llm.url_filter import LOWER, SHAPES, UPPER, TemplateRules
from gridloom.llm.vector_codes import ProductCodes

WORD = r"[^\x20\x09-\x0D]+"
TOKENS = f"""texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 listed AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM texts),
 tokens AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM listed))"""


def grams(size: int, source: str = "tokens") -> str:
    """Windows of ``size`` words by their start."""
    frame = f"(PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)"
    return f"SELECT doc_id, i, word, string_agg(word, ' ') OVER {frame} AS gram, count(*) OVER {frame} = {size} AS whole FROM {source}"


def covered(size: int) -> str:
    return f"coalesce(max(again::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW), 0) = 1"


OP1 = f"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
 sources AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM sized GROUP BY source),
 ranked AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source) AS nth FROM sources),
 levels AS (SELECT *, ((SELECT sum(size) FROM sized) - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
     / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
   FROM ranked WINDOW before AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 stop AS (SELECT nth, level FROM levels WHERE level * weight <= 3 * source_size ORDER BY nth LIMIT 1),
 aims AS (SELECT l.source, source_size, CASE WHEN l.nth < stop.nth THEN (3 * source_size)::DOUBLE ELSE stop.level * weight END AS target FROM levels l, stop),
 quotas AS (SELECT *, round_even(target, 0)::BIGINT AS quota FROM aims),
 keyed AS (SELECT s.*, q.source_size, q.target, q.quota, ('0x' || substr(md5('17:' || s.doc_id || ':' || s.size), 1, 15))::BIGINT AS key
   FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source),
 running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS so_far,
   CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS copies FROM keyed)
 SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, quota - copies * source_size - (so_far - size))))::BIGINT AS taken FROM running"""

OP5 = f"""WITH RECURSIVE texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 listed AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM texts),
 tokens AS (SELECT doc_id, i, words[i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM listed)),
 grams AS ({grams(5)}),
 members AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM grams WHERE whole
   UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM listed WHERE len(words) BETWEEN 1 AND 4),
 sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM members GROUP BY doc_id),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM members a JOIN members b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
 both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
 least AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
 SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id,
   d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept
 FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id"""

OP7 = f"""WITH {TOKENS}, grams AS ({grams(35)}),
 counted AS (SELECT *, whole AND count(*) FILTER (whole) OVER (PARTITION BY gram) > 1 AS again FROM grams),
 laid AS (SELECT *, {covered(35)} AS gone FROM counted),
 summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS stays FROM laid GROUP BY doc_id)
 SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(stays, '')) AS kept_sha256
 FROM texts t LEFT JOIN summed USING (doc_id)"""

OP8 = """WITH fine AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS codes FROM embeddings
   WHERE embedding IS NOT NULL AND len(embedding) > 0
     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 scored AS (SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, list_inner_product(q.codes, c.codes)::BIGINT AS score
   FROM fine q JOIN fine c ON q.r <> c.r AND len(q.codes) = len(c.codes) WHERE q.vec_id % 50 = 0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM scored)
 SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _divergence(shares: str, reference: str) -> str:
    half = "CASE WHEN {0} > 0 THEN {0} * log2(2.0::DOUBLE * {0} / ({0} + {1})) ELSE 0.0::DOUBLE END"
    return f"list_sum(list_transform(list_zip({shares}, {reference}), lambda z: 0.5::DOUBLE * (({half.format('z[1]', 'z[2]')}) + ({half.format('z[2]', 'z[1]')}))))"


def _rest(shares: str) -> str:
    return f"list_concat({shares}, [greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum({shares}))])"


def _doubles(values) -> str:
    return "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in values) + "]"


def _op9() -> str:
    rules = QualityRules()
    pick = lambda f, of=rules.common_words: "CASE lang " + " ".join(f"WHEN '{k}' THEN {f(v)}" for k, v in of.items())
    common = pick(lambda v: "[" + ", ".join(f"'{w}'" for w in v) + "]") + " END"
    expected = pick(lambda v: _doubles([*v.values(), 1.0 - sum(v.values())])) + " END"
    cased = r"2 * length(regexp_replace(text, '[^\p{Ll}\p{Lu}]+', '', 'g')) >= length(regexp_replace(text, '\P{L}+', '', 'g'))"
    classes = pick(_doubles, rules.classes) + f" ELSE CASE WHEN {cased} THEN {_doubles(rules.classes[rules.fallback])} END END"
    share = lambda p: f"length(regexp_replace(text, '{p}', '', 'g'))::DOUBLE / length(text)"
    return rf"""WITH {TOKENS}, grams AS ({grams(5)}),
 counted AS (SELECT *, whole AND count(*) FILTER (whole) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM grams),
 laid AS (SELECT *, {covered(5)} AS again_word FROM counted),
 repeats AS (SELECT doc_id, count(*) FILTER (again_word) AS n FROM laid GROUP BY doc_id),
 lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
 dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
 base AS (SELECT t.doc_id, text, lang, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
     length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
   FROM texts t JOIN listed USING (doc_id) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) LEFT JOIN dups d USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
 failed AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base),
 shares AS (SELECT *, [{share(r'\P{Ll}+')}, {share(r'\P{Lu}+')}, {share(r'\P{Nd}+')}, (length(text) - word_chars)::DOUBLE / length(text)] AS class_shares,
     list_transform({common}, lambda w: len(list_filter(words, lambda x: lower(x) = w))::DOUBLE / n_words) AS word_shares, {expected} AS expected, {classes} AS expected_classes
   FROM failed WHERE n_words >= {rules.guard_words}),
 judged AS (SELECT doc_id, coalesce(CASE WHEN expected_classes IS NOT NULL THEN {_divergence(_rest('class_shares'), 'expected_classes')} > {rules.max_class_divergence!r}::DOUBLE END, FALSE)
     OR coalesce({_divergence(_rest('word_shares'), 'expected')} > {rules.max_word_divergence!r}::DOUBLE + {rules.word_noise!r}::DOUBLE / n_words, FALSE) AS far FROM shares)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, FALSE) AS kept
 FROM failed LEFT JOIN judged USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op2() -> str:
    """Spans from the gaps between matches; entropy by counting every window anew."""
    rules = EntropyRules()

    def found(pattern: str, group: int, least: int, number: int) -> str:
        p = _quoted(pattern)
        lengths = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)::BIGINT"
        start = f"{lengths.format('gaps[1:i]')} + {lengths.format('m[1:i-1]')}"
        return (
            f"SELECT doc_id, {number} AS k, {start} AS s, {start} + length(m[i]) AS e, m[i] AS t FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM "
            f"(SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {group}) AS g "
            f"FROM texts WHERE regexp_matches(text, {p}))) WHERE length(g[i]) >= {least}"
        )

    allowed = " OR ".join(  # without possessive groups, which make no difference to what matches
        f"regexp_matches(t, {_quoted(a.replace('++', '+'))})" + (f" AND NOT regexp_matches(t, {_quoted(unless)})" if unless else "") for a, unless in ALLOWED if "\\1" not in a
    )
    allowed += " OR length(replace(t, t[1], '')) = 0"
    limits = " ".join(
        f"WHEN '{name}' THEN {math.floor((math.log2(rules.window) - least) * rules.window * SCALE)}" for name, least in rules.thresholds.items()
    )
    base = " UNION ALL ".join(found(pattern, group, least, k) for k, (_, pattern, group, least) in enumerate(KINDS))
    names = "[" + ", ".join(f"'{n}'" for n, *_ in KINDS) + ", 'entropy']"
    render = f"string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 base AS MATERIALIZED ({base}),
 runs AS ({found(CANDIDATE, 0, 1, len(KINDS))}),
 free AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s <= r.s AND r.e <= b.e) AND NOT ({allowed})),
 windows AS (SELECT *, substr(t, j::BIGINT, {rules.window}) AS w FROM (SELECT *, unnest(range(1, length(t) - {rules.window - 2})) AS j FROM free)),
 letters AS (SELECT doc_id, s, e, t, j, c, count(*) AS n FROM (SELECT *, unnest(string_split(w, '')) AS c FROM windows) GROUP BY ALL),
 sums AS (SELECT doc_id, s, e, t, j, sum(round(n * log2(n) * {SCALE}))::BIGINT AS total FROM letters GROUP BY ALL),
 hits AS (SELECT DISTINCT doc_id, {len(KINDS)} AS k, s, e, t FROM sums WHERE total <= CASE CASE
     WHEN regexp_full_match(t, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(t, '[A-Za-z0-9]+') THEN 'alnum' ELSE 'base64' END {limits} END),
 spans AS (SELECT * FROM base UNION ALL SELECT * FROM hits),
 rendered AS (SELECT doc_id, {render} FILTER (k < {len(KINDS)}) AS base_spans, {render} AS spans,
     {", ".join(f"count(*) FILTER (k = {k}) AS n_{n}" for k, n in enumerate([*(n for n, *_ in KINDS), "entropy"]))} FROM spans GROUP BY doc_id)
 SELECT t.doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in [*(n for n, *_ in KINDS), "entropy"])},
   sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN rendered USING (doc_id)"""


#: Levels that the SQL walks; the paths of the tables are less deep.
SQL_LEVELS = 8


def op10(rules: dict[str, str]) -> str:
    """The template tree, a level after the other."""
    how = TemplateRules()
    fits, verdicts = [], []
    for text in sorted(rules, key=lambda r: (-len(r), r)):
        host, slash, rest = text.partition("/")
        test = f"(s.host = '{host}' OR ends_with(s.host, '.{host}')) AND starts_with(s.path, '{slash + rest}')"
        fits.append(f"WHEN {test} THEN '{text}'")
        verdicts.append(f"WHEN {test} THEN '{rules[text]}'")
    hexadecimal = r"(regexp_full_match(stem, '[0-9a-fA-F]{8,}') AND regexp_matches(stem, '[0-9]'))"
    shapes = " ".join(
        f"WHEN {hexadecimal if name == '<hex>' else f'regexp_full_match(stem, {_quoted(p)})'} THEN '{name}' || substr(x, length(stem) + 1)" for name, p in SHAPES
    ).replace("stem", "regexp_extract(x, '^([^.]*)', 1)")
    levels = ""
    for n in range(SQL_LEVELS):
        levels += f""",
 nodes{n} AS (SELECT host, template, shape[{n + 1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM tree{n} WHERE len(shape) > {n} GROUP BY ALL),
 parents{n} AS (SELECT host, template, count(*) AS children, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM nodes{n} GROUP BY ALL),
 gaps{n} AS (SELECT *, abs(bad / nullif(labelled, 0) - (all_bad - bad) / nullif(all_labelled - labelled, 0)) AS gap, all_bad / nullif(all_labelled, 0) AS share
   FROM nodes{n} JOIN parents{n} USING (host, template)),
 steps{n} AS (SELECT host, template, segment, CASE WHEN children > 1 AND ((children > {how.many_children} AND n < {how.least_support})
     OR coalesce(gap <= {how.similar_z!r}::DOUBLE * sqrt(share * (1 - share) * (1.0::DOUBLE / nullif(labelled, 0) + 1.0::DOUBLE / nullif(all_labelled - labelled, 0))), TRUE)) THEN '*' ELSE segment END AS step FROM gaps{n}),
 tree{n + 1} AS MATERIALIZED (SELECT t.host, t.shape, t.n, t.labelled, t.bad, CASE WHEN step IS NULL THEN t.template ELSE list_append(t.template, step) END AS template
   FROM tree{n} t LEFT JOIN steps{n} s ON s.host = t.host AND s.template = t.template AND s.segment = t.shape[{n + 1}])"""
    return rf"""WITH urls AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
 shaped AS MATERIALIZED (SELECT *, list_transform(string_split(regexp_replace(path, '^/|/$', '', 'g'), '/'), lambda x: CASE {shapes} ELSE x END) AS shape FROM parts),
 known AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INTEGER) AS bad FROM labels GROUP BY doc_id),
 tree0 AS MATERIALIZED (SELECT host, shape, count(*)::DOUBLE AS n, count(bad)::DOUBLE AS labelled, coalesce(sum(bad), 0)::DOUBLE AS bad, []::VARCHAR[] AS template
   FROM shaped LEFT JOIN known USING (page_id) GROUP BY host, shape){levels},
 tree AS (SELECT host, shape, n, labelled, bad, template FROM tree{SQL_LEVELS}),
 prior AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad) / sum(labelled) ELSE 0.5::DOUBLE END AS p FROM tree),
 judged AS (SELECT host, template, (sum(bad) + {how.smoothing!r}::DOUBLE * any_value(p)) / (sum(labelled) + {how.smoothing!r}::DOUBLE) AS purity, sum(labelled) AS labelled FROM tree, prior GROUP BY ALL)
 SELECT page_id, s.host, s.path, CASE {" ".join(fits)} END AS rule,
   CASE {" ".join(verdicts)} WHEN purity >= {how.purity!r}::DOUBLE AND j.labelled >= {how.least_labels} THEN 'block' ELSE 'allow' END AS verdict,
   '/' || array_to_string(j.template, '/') AS template, purity
 FROM shaped s JOIN tree t ON t.host = s.host AND t.shape = s.shape JOIN judged j ON j.host = t.host AND j.template = t.template"""


def _op11() -> str:
    """Units of the query are code points, so cuts are plain substrings."""
    draw = lambda k: f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT"
    after = lambda text, mark: f"substr({text}, instr({text}, '{mark}') + 3)"
    between = lambda a, b: f"substr(output, instr(output, '{a}') + 3, instr(output, '{b}') - instr(output, '{a}') - 3)"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
 drawn AS (SELECT *, {draw(0)} % (n + 1) AS a, {draw(1)} % (n + 1) AS b,
     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {draw(2)} % 100 >= 90 THEN 'plain' WHEN {draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM texts),
 cut AS (SELECT *, least(a, b) AS p, greatest(a, b) AS q FROM drawn),
 parts AS (SELECT *, substr(text, 1, p) AS prefix, substr(text, p + 1, q - p) AS middle, substr(text, q + 1) AS suffix FROM cut),
 made AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars, sha256(output) AS output_sha256,
   sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between('<P>', '<S>')} || {after('output', '<M>')} || {between('<S>', '<M>')}
     ELSE {between('<P>', '<M>')} || {after('output', '<M>')} || {between('<S>', '<P>')} END) AS restored_sha256 FROM made"""


OP12 = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SMALL_WORD}') AS words FROM documents),
 items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SMALL_WORD}') AS words FROM benchmark),
 windows AS MATERIALIZED (SELECT DISTINCT item, len(words[s:s + 9]) AS size, array_to_string(words[s:s + 9], ' ') AS gram FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM items WHERE len(words) > 0)),
 sizes AS (SELECT DISTINCT size FROM windows),
 runs AS (SELECT r, s, size, array_to_string(words[s:s + size - 1], ' ') AS gram FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM docs, sizes WHERE len(words) >= size)),
 found AS MATERIALIZED (SELECT r, s, x.size, item FROM runs x JOIN windows w ON x.gram = w.gram AND x.size = w.size),
 hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS i FROM (SELECT DISTINCT r, s, size FROM found)) GROUP BY r),
 named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
 SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
 FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""


def _op13() -> str:
    """Rounds written out; a part's nearest entry is the least of distance * entries + index."""
    how = ProductCodes()
    floored = "(s - ((s % n) + n) % n) // n"
    rounds = ""
    for k in range(how.rounds + 1):
        rounds += f""",
 near{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * {how.entries} + e)::BIGINT AS best
   FROM parts JOIN book{k} USING (p) GROUP BY r, p)"""
        if k < how.rounds:
            rounds += f""",
 sums{k} AS (SELECT p, e, d, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT p, best % {how.entries} AS e, unnest(x) AS v, unnest(range(len(x))) AS d FROM near{k}) GROUP BY ALL),
 moved{k} AS (SELECT p, e, list({floored} ORDER BY d) AS y FROM sums{k} GROUP BY p, e),
 book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN moved{k} m ON m.p = b.p AND m.e = b.e)"""
    last = how.rounds
    return f"""WITH fine AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda v: floor({how.scale} * v::DOUBLE)::BIGINT) AS codes FROM embeddings
   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
 parts AS MATERIALIZED (SELECT r, p, codes[(p * len(codes) // {how.parts} + 1):((p + 1) * len(codes) // {how.parts})] AS x FROM (SELECT *, unnest(range({how.parts})) AS p FROM fine)),
 book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {how.entries}){rounds},
 coded AS (SELECT r, string_agg(printf('%02x', best % {how.entries}), '' ORDER BY p) AS code, sum(best // {how.entries})::BIGINT AS error FROM near{last} GROUP BY r),
 digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{last})
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM fine JOIN coded USING (r), digest"""


SQL: dict[str, str] = {
    "op1_source_mix": OP1,
    "op2_secret_scan": _op2(),
    "op5_near_duplicates": OP5,
    "op7_substring_dedup": OP7,
    "op8_top_k_search": OP8,
    "op9_quality_rules": _op9(),
    "op11_fill_in_middle": _op11(),
    "op12_decontamination": OP12,
    "op13_vector_codes": _op13(),
}
