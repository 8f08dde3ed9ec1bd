"""DuckDB twins of the operators that SQL can say."""

from __future__ import annotations

from gaugeworks.llm import quality_rules

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _warc() -> str:
    """Base32 is cut out of the hex digest, forty bits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = [
        f"substr('{letters}', CAST(((('0x' || substr(h, {10 * g + 1}, 10))::BIGINT >> {35 - 5 * k}) & 31) + 1 AS INT), 1)"
        for g in range(4) for k in range(8)]
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS best FROM p GROUP BY h)
SELECT page_id, strlen(b) AS payload_bytes, {' || '.join(digits)} AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM p JOIN m USING (h)"""


def _quality_rules() -> str:
    limits, words = quality_rules.Limits(), quality_rules.VOCABULARY
    gone = [r"\p{Ll}", *quality_rules.CLASSES]
    size = len(gone)
    counts = ", ".join(
        f"length(b) - length(regexp_replace(b, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g'))" for c in gone)
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / (s + r)) ELSE 0 END"
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS b, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
rep AS (SELECT doc_id, i FROM i QUALIFY count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, count(x) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(b, chr(10))) AS x FROM t)
  WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
n AS (SELECT t.doc_id, lang, b, w, len(w) AS n_words, length(regexp_replace(b, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(b, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
x AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed, [{counts}] AS c FROM n),
cs AS (SELECT doc_id, 'c' AS kind, unnest(range({size} + 1)) AS item,
  unnest(list_concat(c, [length(b) - list_sum(c)])) / greatest(length(b), 1) AS s FROM x),
v AS (SELECT unnest([{_quoted(words)}]) AS word, unnest(range({len(words)})) AS item),
hit AS (SELECT doc_id, lower(word) AS word, count(*) AS k FROM (SELECT doc_id, unnest(w) AS word FROM x)
  WHERE word IN ({_quoted([*words, *(w.capitalize() for w in words)])}) GROUP BY ALL),
ws AS (SELECT x.doc_id, 'w' AS kind, v.item, coalesce(k, 0) / greatest(n_words, 1) AS s FROM x JOIN v ON true
  LEFT JOIN hit ON hit.doc_id = x.doc_id AND hit.word = v.word),
rest AS (SELECT x.doc_id, 'w' AS kind, {len(words)} AS item, (n_words - coalesce(sum(k), 0)) / greatest(n_words, 1) AS s
  FROM x LEFT JOIN hit ON hit.doc_id = x.doc_id GROUP BY x.doc_id, n_words),
fs AS (FROM cs UNION ALL FROM ws UNION ALL FROM rest),
ref AS (SELECT lang, kind, item, avg(s) AS r FROM fs JOIN x USING (doc_id)
  WHERE NOT base_failed AND lang IN ({_quoted(quality_rules.COMMON_WORDS)}) GROUP BY ALL),
d AS (SELECT fs.doc_id, ref.lang, kind, sqrt(greatest(0, sum({term.format('s')} + {term.format('r')}) / 2)) AS d
  FROM fs JOIN ref USING (kind, item) GROUP BY ALL),
fit AS (SELECT doc_id, bool_or(a.d <= {limits.class_limit} + {limits.class_scatter} / sqrt(greatest(n_words, 1)) AND
  (z.d <= {limits.word_limit} + {limits.word_scatter} / sqrt(greatest(n_words, 1)) OR n_words < {limits.min_words_for_words})) AS ok
  FROM d a JOIN d z USING (doc_id, lang) JOIN x USING (doc_id) WHERE a.kind = 'c' AND z.kind = 'w' GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM x LEFT JOIN fit USING (doc_id)"""


def _collocations() -> str:
    return r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM i, range(1, 5) r(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE words = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE words > 1 AND f >= 30),
u AS (SELECT lang, phrase, f, words, w, unnest(range(1, words)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.f AS a, l.f AS l, r.f AS r, cut, (2000000::HUGEINT * u.f) // (l.f::HUGEINT + r.f) AS score
  FROM u JOIN g l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN g r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
v AS (SELECT lang, array_to_string(w[b:e], ' ') AS phrase, max(f) AS f FROM c, range(1, 4) x(b), range(2, 5) y(e)
  WHERE e > b AND e <= words AND e - b + 1 < words GROUP BY ALL),
d AS (SELECT m.* FROM m LEFT JOIN v USING (lang, phrase) WHERE NOT coalesce(100 * v.f::HUGEINT >= 80 * a::HUGEINT, FALSE)),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000"""


def _filter_audit() -> str:
    """Documents, orders and steps one by one: what is gone at a step failed an earlier letter."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS b FROM documents),
w AS (SELECT *, regexp_extract_all(b, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(b, '[^A-Z]+', '', 'g')) > 2 * length(b) THEN 'C' END,
    CASE WHEN regexp_matches(b, '[#$%&*|]') THEN 'D' END,
    CASE WHEN min(doc_id) OVER (PARTITION BY b) < doc_id THEN 'E' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, filter_order[k] AS letter, filter_order[1:k - 1] AS before FROM o, range(1, 6) r(k)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
m AS (SELECT *, contains(fails, letter) AS bad, translate(fails, before, '') <> fails AS gone FROM g, s),
r AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""


def oracles() -> dict[str, str]:
    return {"op5_warc": _warc(), "op8_quality_rules": _quality_rules(), "op12_collocations": _collocations(),
            "op13_filter_audit": _filter_audit()}
