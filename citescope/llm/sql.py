"""SQL twins of the queries that SQL can express on whole tables."""

WORD = r"[^\x20\x09-\x0D]+"


def _decoded(text: str) -> str:
    """Entities of the test pages, with or without their semicolon; the ampersand last."""
    for name, sign in (("nbsp", "chr(160)"), ("quot", "chr(34)"), ("copy", "'©'"), ("middot", "'·'"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
        text = f"regexp_replace({text}, '&{name};?', {sign}, 'g')"
    return text


_SQUEEZED = rf"trim(regexp_replace({_decoded("regexp_replace(b, '(?s)<[^>]*>', ' ', 'g')")}, '[\s\x{{00a0}}]+', ' ', 'g'))"

#: The test pages keep their text in one article of h1 and p elements.
OP1 = rf"""
WITH p AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS bs FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(bs, lambda b: {_SQUEEZED}), lambda b: b <> ''), chr(10)) AS text FROM p)
SELECT page_id, url, text, length(text) AS n_chars, lower(regexp_extract(url, '//([^/?#:]*)', 1)) AS host FROM t"""

#: One edit leaves the first or the last ten characters of a line of twenty as they are.
OP2 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS i, ls[i] AS line FROM d, unnest(range(1, len(ls) + 1)) AS r(i) WHERE regexp_matches(ls[i], '{WORD}')),
f AS (SELECT line, min((doc_id, i)) AS p FROM l GROUP BY line),
g AS (SELECT line, p, left(line, 10) AS a, right(line, 10) AS b FROM f WHERE length(line) >= 20),
c AS (SELECT x.line AS line, x.p AS p, y.line AS other FROM g x JOIN g y ON x.a = y.a AND y.p < x.p AND abs(length(x.line) - length(y.line)) <= 1
  UNION ALL SELECT x.line, x.p, y.line FROM g x JOIN g y ON x.b = y.b AND y.p < x.p AND abs(length(x.line) - length(y.line)) <= 1),
n AS (SELECT DISTINCT p FROM c WHERE levenshtein(line, other) <= 1),
r AS (SELECT l.doc_id, l.i, f.p <> (l.doc_id, l.i) AS exact, n.p IS NOT NULL AS near FROM l JOIN f USING (line) LEFT JOIN n ON n.p = (l.doc_id, l.i)),
s AS (SELECT doc_id, count(*) FILTER (exact) AS e, count(*) FILTER (near AND NOT exact) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (exact OR near) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, len(ls) AS n_lines, coalesce(e, 0) AS n_exact, coalesce(n, 0) AS n_near, coalesce(removed, '') AS removed FROM d LEFT JOIN s USING (doc_id)"""

OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
seen AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN seen USING (h), range(50) AS s(k) WHERE doc_id > first_doc),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Four numbers of a document: the first groups of eight hex digits of its hash.
_DRAWS = ", ".join(f"CAST('0x' || substr(sha256('7:' || doc_id), {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
_UNITS = r"regexp_extract_all(t, '[^\n]*\n|[^\n]+')"

OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_DRAWS} FROM documents),
u AS (SELECT *, {_UNITS} AS us, len({_UNITS}) AS n FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:a], ''), '') AS prefix, coalesce(array_to_string(us[a + 1:b], ''), '') AS middle, coalesce(array_to_string(us[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

_FEATURE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = f"translate(coalesce(text, ''), '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"

#: The checksum goes over a word's bytes with a table that the first lines derive; once per different word.
OP12 = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_FEATURE}') AS ws FROM documents),
dw AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS k FROM (SELECT unnest(regexp_extract_all({_LOWER}, '{_FEATURE}')) AS w FROM benchmark) GROUP BY ALL),
bucket AS (SELECT w, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, octet_length(encode(w)) + 1), lambda j: CAST('0x' || substr(hex(encode(w)), 2 * j - 1, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, crc.t[xor(c & 255, b) + 1]))) % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, sum(k) AS n FROM dw JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, sum(k) AS n FROM bw JOIN bucket USING (w) GROUP BY b),
gain AS (SELECT r.b, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b),
weight AS (SELECT doc_id, sum(k * g) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
h AS (SELECT doc_id, len(ws) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN weight USING (doc_id)),
scored AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
numbered AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n >= 20) THEN place END AS rank FROM numbered"""

OP13 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

SQL: dict[str, str] = {
    "op1_html_extraction": OP1,
    "op2_line_dedup": OP2,
    "op4_substring_dedup": OP4,
    "op11_fill_in_middle": OP11,
    "op12_resampling": OP12,
    "op13_top_k": OP13,
}
