"""DuckDB SQL that states the same results as the registered queries."""

_SPACED = r"regexp_split_to_array(trim(translate(lower_ascii, chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     ')), ' +')"

#: A-Z only, so that other letters keep their case.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter({_SPACED}, lambda x: x <> '') AS w FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_in AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM both_in p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM words
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT w.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM words w JOIN reach r ON r.node = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""

#: Words of letters, digits and all beyond ASCII.
_ALNUM = "regexp_extract_all(lower_ascii, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

BENCHMARK_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM (SELECT doc_id, {_LOWER} AS lower_ascii FROM documents)),
b AS (SELECT DISTINCT item_id, {_ALNUM} AS w FROM (SELECT item_id, {_LOWER} AS lower_ascii FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i+least(13, len(w))-1], ' '))) AS t
  FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, lengths WHERE len(w) >= size),
grams AS (SELECT doc_id, size, i, array_to_string(w[i:i+size-1], ' ') AS t FROM places),
hits AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON x.t = g.t AND x.size = g.size),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def extendible_sharding(limit: int, bits: int = 60) -> str:
    """Each row's bucket is the first prefix of its hash that fits, or that holds one hash only."""
    return f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {bits // 4}) AS BIGINT) AS h FROM documents
), keys AS (SELECT h, sum(n_bytes) AS n_bytes, count(*) AS n FROM d GROUP BY h),
levels AS (SELECT h, n_bytes, n, depth, h >> ({bits} - depth) AS prefix FROM keys, (SELECT unnest(range(0, {bits} + 1)) AS depth)),
buckets AS (
  SELECT depth, prefix, sum(n_bytes) AS shard_bytes, sum(n) AS shard_docs FROM levels GROUP BY 1, 2
  HAVING sum(n_bytes) <= {limit} OR min(h) = max(h)
), first AS (
  SELECT l.h, min(l.depth) AS depth FROM levels l JOIN buckets b ON l.depth = b.depth AND l.prefix = b.prefix GROUP BY l.h
)
SELECT d.doc_id, d.n_bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(b.prefix), CAST(f.depth AS INTEGER), '0') END AS shard, CAST(f.depth AS INTEGER) AS shard_depth,
  CAST(b.shard_bytes AS BIGINT) AS shard_bytes, CAST(b.shard_docs AS BIGINT) AS shard_docs
FROM d JOIN first f ON f.h = d.h JOIN buckets b ON b.depth = f.depth AND b.prefix = d.h >> ({bits} - f.depth)
"""


def quality_rules() -> str:
    """Counts by unnesting, and expectation-maximisation as a recursion over one row of parameters."""
    from grainmill.llm.quality_rules import _FLOOR, GOOD_MEAN, GOOD_WEIGHT, ITERATIONS, RULES

    n = len(RULES)
    votes = ", ".join(f"{r.vote()} AS v{j}" for j, r in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in range(n))
    params = ", ".join(f"a{j}, b{j}" for j in range(n))
    start = ", ".join(f"CAST({GOOD_MEAN} AS DOUBLE) AS a{j}, CAST(0.3 AS DOUBLE) AS b{j}" for j in range(n))
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE v{j} WHEN 1 THEN ln(a{j} / (1 - b{j})) WHEN 0 THEN ln((1 - a{j}) / b{j}) ELSE 0 END" for j in range(n))
    inside = lambda x: f"least({1 - _FLOOR}, greatest({_FLOOR}, {x}))"
    step = ", ".join(
        inside(f"(coalesce(sum(n * p) FILTER (WHERE v{j} = 1), 0) + {GOOD_WEIGHT * GOOD_MEAN} * sum(n)) / (coalesce(sum(n * p) FILTER (WHERE v{j} IS NOT NULL), 0) + {GOOD_WEIGHT} * sum(n))") + f" AS a{j}, " + inside(f"(coalesce(sum(n * (1 - p)) FILTER (WHERE v{j} = 0), 0) + 1) / (coalesce(sum(n * (1 - p)) FILTER (WHERE v{j} IS NOT NULL), 0) + 2)") + f" AS b{j}" for j in range(n)
    )
    count = lambda pattern: f"CAST(len(regexp_extract_all(t, '{pattern}')) AS BIGINT)"
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS x FROM places),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM texts) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, {count("[^\x20\x09-\x0D]")} AS word_chars, {count("[#*$%&|<>]")} AS n_symbols, {count("[A-Z]")} AS n_capitals,
    {count("[A-Za-z]")} AS n_letters, {count("[.!?](?:[\x20\x09-\x0D]|$)")} AS n_stops, {count("!!")} AS n_shouts,
    CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(l.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t JOIN words w USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), voted AS (SELECT *, {votes} FROM counts),
patterns AS (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted WHERE n_words > 0 GROUP BY {names}),
em AS (
  SELECT 0 AS step, CAST(0.8 AS DOUBLE) AS prior, {start}
  UNION ALL
  SELECT step + 1, {inside("(sum(n * p) + 1) / (sum(n) + 2)")} AS prior, {step}
  FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM em, patterns WHERE step < {ITERATIONS}) GROUP BY step
), fitted AS (SELECT prior, {params} FROM em WHERE step = {ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted), fitted
"""


def line_dedup(least_length: int, least_documents: int) -> str:
    """Lines by unnesting; keys in full, without digests or filters."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= {least_length} GROUP BY k HAVING count(DISTINCT doc_id) >= {least_documents}
), marked AS (SELECT doc_id, line, place, r.k IS NOT NULL AND doc_id <> r.last AS gone FROM keyed LEFT JOIN repeated r USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


#: crc32 of a list of bytes: eight shifts of each byte make the table, one entry of it is used for each byte of the list.
_CRC_TABLE = """
crc_bits AS (
  SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS crc_entries FROM crc_bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """SQL of the unsigned crc32 of a string's UTF-8; ``crc_entries`` must be in reach."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc_entries[xor(c & 255, b) + 1])), 4294967295)"


def spelling_variants(least_length: int, least_count: int, delete_one_in: int, ratio: int) -> str:
    """Near words by what is left when a letter is taken out, roots by recursion."""
    return f"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00c0-\u00ff]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), counted AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= {least_length} GROUP BY 1, 2),
hashed AS (SELECT w, n, {_crc32("concat(CAST(doc_id AS VARCHAR), ':', w)")} AS h FROM counted, crc_table),
spelt AS (SELECT CASE WHEN h % {delete_one_in} = 0 THEN concat(w[1:h % length(w)], w[h % length(w) + 2:]) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {least_length} GROUP BY 1 HAVING sum(n) >= {least_count}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
less AS (SELECT word, n, p, concat(word[1:p - 1], word[p + 1:]) AS rest FROM places),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION
  SELECT a.word, a.n, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION
  SELECT b.word, b.n, a.word, a.n FROM less a JOIN v b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS top, first(other ORDER BY m DESC, encode(other)) AS other FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {ratio} * n THEN other END AS form, CASE WHEN top >= {ratio} * n THEN top END AS form_n FROM v LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS at FROM forms
  UNION ALL
  SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
), roots AS (SELECT c.word, c.at AS root FROM chains c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms JOIN roots USING (word)
"""
