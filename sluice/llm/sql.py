"""DuckDB SQL of the corpus operators that SQL can express."""

from __future__ import annotations

from sluice.llm import op1_quality as q


def quality() -> str:
    """The whole of op1_quality: counts, references from all documents, distances and verdict."""
    common = ", ".join(f"'{w}'" for w in sorted(set(q.COMMON)))
    shares = ", ".join(f"sum(c{i}) / sum({' + '.join(f'c{k}' for k in range(len(q.CLASSES)))}) AS q{i}" for i in range(len(q.CLASSES)))
    total = f"greatest({' + '.join(f'c{k}' for k in range(len(q.CLASSES)))}, 1)"

    def term(p: str, r: str) -> str:
        return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {r})) + CASE WHEN {r} > 0 THEN {r} * log2(2 * {r} / ({p} + {r})) ELSE 0 END - {r} ELSE 0 END)"

    by_class = " + ".join(term(f"(c{i} / {total})", f"q{i}") for i in range(len(q.CLASSES)))
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    regexp_extract_all(text, '[\p{{Lu}}0-9!-/:-@\[-`{{-~]') AS marks FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) > 2),
named AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM named) WHERE n > 1),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM twice) GROUP BY doc_id),
counts AS (SELECT t.doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(list_filter(marks, lambda c: contains('#*$%&|<>', c))) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(marks) AS n_marks, length(text) AS chars, strlen(text) AS bytes,
    len(list_filter(marks, lambda c: c BETWEEN '0' AND '9')) AS n_digit, len(list_filter(marks, lambda c: c BETWEEN 'A' AND 'Z' OR c > '~')) AS n_upper,
    list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({common})) AS known
    FROM words t LEFT JOIN covered USING (doc_id)),
features AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, chars - word_chars AS c0, n_upper AS c1, n_digit AS c2, n_symbols AS c3,
    n_marks - n_digit - n_upper - n_symbols AS c4, bytes - chars AS c5, greatest(0, word_chars - n_marks - (bytes - chars)) AS c6 FROM counts),
usable AS (SELECT * FROM features WHERE NOT base_failed AND lang IS NOT NULL),
class_reference AS (SELECT lang, sum(n_words) AS words, {shares} FROM usable GROUP BY lang HAVING sum(n_words) >= {q.MIN_REFERENCE_WORDS}),
common_reference AS (SELECT u.lang, word, count(*) / any_value(words) AS share FROM (SELECT lang, unnest(known) AS word FROM usable) u JOIN class_reference r ON u.lang = r.lang GROUP BY u.lang, word),
rest AS (SELECT r.lang, greatest(0, 1 - coalesce(sum(share), 0)) AS share FROM class_reference r LEFT JOIN common_reference c ON c.lang = r.lang GROUP BY r.lang),
class_distance AS (SELECT doc_id, min(sqrt(greatest(0, ({by_class} + 1) / 2))) AS d FROM features, class_reference GROUP BY doc_id),
runs AS (SELECT doc_id, n_words, word, count(*) AS n FROM (SELECT doc_id, n_words, unnest(known) AS word FROM features) GROUP BY ALL),
hits AS (SELECT r.doc_id, c.lang, {term("(r.n / greatest(r.n_words, 1))", "coalesce(s.share, 0)")} AS t FROM runs r CROSS JOIN class_reference c LEFT JOIN common_reference s ON s.lang = c.lang AND s.word = r.word),
summed AS (SELECT doc_id, lang, sum(t) AS t FROM hits GROUP BY doc_id, lang),
common_distance AS (SELECT f.doc_id, min(sqrt(greatest(0, (coalesce(s.t, 0) + {term("((f.n_words - len(known)) / greatest(f.n_words, 1))", "o.share")} + 1) / 2))) AS d
    FROM features f CROSS JOIN rest o LEFT JOIN summed s ON s.doc_id = f.doc_id AND s.lang = o.lang GROUP BY f.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(({total} >= {q.MIN_CLASS_CHARS} AND a.d > {q.MAX_CLASS_DISTANCE}) OR (n_words >= {q.MIN_COMMON_WORDS} AND b.d > {q.MAX_COMMON_DISTANCE}), false) AS kept
FROM features LEFT JOIN class_distance a USING (doc_id) LEFT JOIN common_distance b USING (doc_id)
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One row: the 256 remainders of CRC-32, from its polynomial.
_CRC_TABLE = "crc AS (SELECT list(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))"


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8; a column ``t`` has the table."""
    hexed = f"hex(encode({text}))"
    digit = lambda k: f"instr('0123456789ABCDEF', substr({hexed}, {k}, 1)) - 1"
    byte = f"16 * ({digit('2 * k + 1')}) + {digit('2 * k + 2')}"
    return f"xor(4294967295, list_reduce([4294967295] || list_transform(range(length({hexed}) // 2), lambda k: {byte}), lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8)))"


def prefix_trie() -> str:
    """op11_prefix_trie: nodes by the lists of their turns; subtrees by comparing nodes with each other."""
    return f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS at, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) AS token, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
counts AS (SELECT c, count(*) AS n, c - c % 5 AS base FROM turns GROUP BY c),
spans AS (SELECT s.c, s.n, s.base, CASE WHEN s.c = s.base THEN 0 ELSE {_crc32("CAST(s.c AS VARCHAR)")} % 9 END AS h, coalesce(b.n, 0) AS nb FROM counts s LEFT JOIN counts b ON b.c = s.base, crc),
rebuilt AS (SELECT s.c, t.at AS depth, token, bytes FROM spans s JOIN turns t ON t.c = s.base AND t.at <= s.h UNION ALL SELECT s.c, t.at - h + least(h, nb), token, bytes FROM spans s JOIN turns t ON t.c = s.c AND t.at > s.h),
ways AS (SELECT c, depth, bytes, string_agg(token, '') OVER (PARTITION BY c ORDER BY depth) AS key FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM spans),
ends AS (SELECT c, max(depth) AS depth FROM ways GROUP BY c),
nodes AS (SELECT w.key, any_value(w.depth) AS depth, min(w.c) AS conv_id, count(*) AS n_convs, max(w.bytes) AS bytes, coalesce(string_agg(CAST(w.c AS VARCHAR), ',' ORDER BY w.c) FILTER (w.depth = e.depth), '') AS ids FROM ways w JOIN ends e ON e.c = w.c GROUP BY w.key),
children AS (SELECT left(key, 32 * (depth - 1)::INT) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.key = n.key),
totals AS (SELECT a.key, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM full_nodes a JOIN full_nodes b ON b.depth >= a.depth AND starts_with(b.key, a.key) GROUP BY a.key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_nodes n JOIN totals t ON t.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.key = left(n.key, 32 * (n.depth - 1)::INT)
"""


def jaccard() -> str:
    """op12_jaccard: shingle texts, pairs that share one, and what can be reached over linked pairs."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON b.s = a.s AND b.doc_id <> a.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.root AS component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = d.doc_id
"""


def spelling() -> str:
    """op13_spelling: near words by what is left when a code point is deleted."""
    return f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("doc_id || ':' || run")} AS h FROM runs, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON b.cut = a.cut AND b.i = a.i AND b.word <> a.word
    UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON b.word = a.cut UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON b.word = a.cut),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS top, min(other) FILTER (other_n = m) AS form FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN form END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS at, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.form)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
