"""Queries over documents: text functions, decontamination, deduplication, splits, mixtures, groups, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.functions import hashing as H
from grainmill.functions import text as T
from grainmill.operators import decontam as D
from grainmill.operators import groups as G
from grainmill.operators import retrieval as R
from grainmill.operators import splits as S
from grainmill.plans.registry import register
from grainmill.plans.shipping import ship
from grainmill.plans.tables import table

_FOLD = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"
_WORDS = "regexp_extract_all(" + _FOLD + ", '[\\p{{L}}\\p{{N}}_]+')"
_GRAMS = "list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))"
_INDEX = f"""d AS (SELECT doc_id, lang, {_WORDS.format("text")} AS w FROM documents), b AS (SELECT {_WORDS.format("text")} AS w FROM benchmark),
index AS (SELECT DISTINCT 'gram' AS kind, unnest({_GRAMS}) AS key FROM b WHERE len(w) >= 13 UNION SELECT 'exact', array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 4 AND 12),
keys AS (SELECT doc_id, 'gram' AS kind, unnest({_GRAMS}) AS key FROM d WHERE len(w) >= 13 UNION ALL SELECT doc_id, 'exact', array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 4 AND 12),
hits AS (SELECT DISTINCT doc_id FROM keys JOIN index USING (kind, key))"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("decontam_by_lang", f"WITH {_INDEX} SELECT lang, count(*) FILTER (WHERE h.doc_id IS NULL) AS kept, count(h.doc_id) AS dropped FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY lang")
def decontam_by_lang(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    hit = D.hits(docs, D.gram_index(table(spark, sf_dir, "benchmark")), "doc_id")
    return docs.select("doc_id", "lang").join(hit, F.col("doc_id") == F.col("id"), "left").groupBy("lang").agg(F.count_if(F.col("id").isNull()).alias("kept"), F.count("id").alias("dropped"))


@register("decontam_kept", f"WITH {_INDEX} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)")
def decontam_kept(spark, sf_dir):
    return D.decontaminate(_docs(spark, sf_dir), D.gram_index(table(spark, sf_dir, "benchmark")), "doc_id").select("doc_id")


@register(
    "text_functions",
    f"""SELECT doc_id, {_FOLD.format("text")} AS folded, len({_WORDS.format("text")}) AS n_words, replace(source, '_', ' ') AS human,
  CASE WHEN length(text) > 80 THEN left(text, 37) || ' [...] ' || right(text, 36) ELSE text END AS ends,
  regexp_replace(source, '^\\s*[(\\[]?\\d{{1,2}}\\s*[)\\].:\\-]\\s*', '') AS unmarked, regexp_matches(source, '(?i)(^|[\\s_])(id|idx|index|case[\\s_]?id)$') AS id_column FROM documents""",
)
def text_functions(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold("text").alias("folded"), F.size(T.words("text")).cast("long").alias("n_words"), T.humanize("source").alias("human"), T.head_and_tail("text", 80).alias("ends"), T.strip_level_marker("source").alias("unmarked"), T.is_id_column("source").alias("id_column"))


_NUMBERS = "len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?'))"
_REQUEST = "text || chr(10) || source"


@register(
    "routing_features",
    f"""SELECT doc_id, len(regexp_extract_all({_REQUEST}, '\\d')) AS n_digits, len(regexp_extract_all({_REQUEST}, '\\b\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}\\b')) AS n_dates,
  len(regexp_extract_all({_REQUEST}, '(?i)[$€£¥₩%]|\\b(?:USD|EUR|GBP|KRW|percent)\\b')) AS n_money,
  len(regexp_extract_all({_REQUEST}, '(?i)\\b(?:more|less|greater|fewer|higher|lower|before|after|earlier|later|least|most|equal|than|minimum|maximum)\\b')) AS n_comparisons,
  round(ln(1 + length(text)), 6) AS log_state_length, {_NUMBERS} AS n_numbers,
  length(text) > 1800 OR {_NUMBERS} >= 3 OR regexp_matches(text || source, '(?i)\\b(amend|exception|unless|override|policy|clause|article|rule|probabilit|conditional|prevalence|sensitivity|without replacement|calendar|cutoff)') AS needs_evidence,
  {_NUMBERS} >= 3 AND regexp_matches(source, '(?i)\\d|\\b(?:{T.QUANTITIES})\\b') AS needs_calculation FROM documents""",
)
def routing_features(spark, sf_dir):
    counts = T.surface_features("text", "source")
    length = F.round(counts.pop("log_state_length"), 6).alias("log_state_length")
    return _docs(spark, sf_dir).select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()], length, T.number_count("text").cast("long").alias("n_numbers"), T.needs_evidence("text", "source").alias("needs_evidence"), T.needs_calculation("text", F.col("source"), F.array().cast("array<string>"), F.lit("choice")).alias("needs_calculation"))


@register(
    "content_hashes",
    f"""SELECT doc_id, sha256({_FOLD.format("text")} || chr(31) || {_FOLD.format("lang")} || chr(31) || array_to_string(list_sort([{_FOLD.format("source")}, 'other']), chr(30))) AS dedup_key,
  sha256(text || chr(31) || 'm1' || chr(31) || 't2') AS cache_key, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 100 AS bucket,
  round(CAST('0x' || substr(sha256(text), 7, 2) || substr(sha256(text), 5, 2) || substr(sha256(text), 3, 2) || substr(sha256(text), 1, 2) AS BIGINT) / 4294967295.0, 6) AS fraction FROM documents""",
)
def content_hashes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", H.dedup_key("text", "lang", F.array("source", F.lit("other"))).alias("dedup_key"), H.state_cache_key("text", "m1", "t2").alias("cache_key"), H.bucket("text").cast("long").alias("bucket"), F.round(H.unit_fraction("text"), 6).alias("fraction"))


@register("dedup_global", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_FOLD.format('text')}, lang")
def dedup_global(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("dedup_key", H.dedup_key("text", "lang", F.array(F.lit("yes"), F.lit("no"))))
    return S.dedup_questions(docs.select("doc_id", "dedup_key"), order=["doc_id"]).select("doc_id")


@register("dedup_by_source", f"SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, {_FOLD.format('text')}, lang")
def dedup_by_source(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("dedup_key", H.dedup_key("text", "lang", F.array(F.lit("yes"), F.lit("no"))))
    return S.dedup_questions(docs.select("doc_id", "source", "dedup_key"), scope=["source"], order=["doc_id"]).select("source", "doc_id")


_FRACTION = "CAST('0x' || substr(sha256({0}), 7, 2) || substr(sha256({0}), 5, 2) || substr(sha256({0}), 3, 2) || substr(sha256({0}), 1, 2) AS BIGINT) / 4294967295.0"


@register("group_split", f"SELECT doc_id, CASE WHEN {_FRACTION.format(chr(39) + '7:' + chr(39) + ' || lang || source')} < 0.3 THEN 'val' ELSE 'train' END AS split FROM documents")
def group_split(spark, sf_dir):
    return S.group_split(_docs(spark, sf_dir), F.concat("lang", "source"), 0.3, 7).select("doc_id", "split")


_BUCKET = "CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"


@register("bucket_split", f"SELECT source, CASE WHEN {_BUCKET} < 72 THEN 'train' WHEN {_BUCKET} < 79 THEN 'dev' WHEN {_BUCKET} < 86 THEN 'fit' WHEN {_BUCKET} < 93 THEN 'gate' ELSE 'test' END AS split, count(*) AS n FROM documents GROUP BY 1, 2")
def bucket_split(spark, sf_dir):
    return S.bucket_split(_docs(spark, sf_dir), "doc_id", {"train": 72, "dev": 7, "fit": 7, "gate": 7, "test": 7}).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"))


@register(
    "quota_fill",
    """WITH r AS (SELECT doc_id, source, CAST(n_chars < 3000 AS INT) AS ok, sum(CAST(n_chars < 3000 AS INT)) OVER (PARTITION BY source ORDER BY sha256('15:' || CAST(doc_id AS VARCHAR)) ROWS UNBOUNDED PRECEDING) AS upto FROM documents)
SELECT source, count(*) FILTER (WHERE ok = 1 AND upto <= 10) AS taken, count(*) FILTER (WHERE ok = 0 AND upto < 10) AS excluded FROM r GROUP BY source""",
)
def quota_fill(spark, sf_dir):
    rows = S.quota_fill(_docs(spark, sf_dir), ["source"], [H.hashed_order(15, "doc_id")], 10, "n_chars < 3000")
    return rows.groupBy("source").agg(F.count_if("taken").alias("taken"), F.count_if("excluded").alias("excluded"))


@register("round_robin", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || CAST(doc_id AS VARCHAR))) AS turn FROM documents) SELECT doc_id, source FROM r ORDER BY turn, sha256('3:' || source), source LIMIT 50")
def round_robin(spark, sf_dir):
    return S.round_robin(_docs(spark, sf_dir), "source", 50, 3, "doc_id").select("doc_id", "source")


@register(
    "apportionment",
    """WITH c AS (SELECT source, lang, sqrt(count(*)) AS weight FROM documents GROUP BY 1, 2), r AS (SELECT *, round(weight / sum(weight) OVER (PARTITION BY source) * 37, 9) AS raw FROM c),
k AS (SELECT *, 37 - sum(floor(raw)) OVER (PARTITION BY source) AS spare, row_number() OVER (PARTITION BY source ORDER BY raw - floor(raw) DESC, sha256('tie:' || lang)) AS rank FROM r)
SELECT source, lang, CAST(floor(raw) + CASE WHEN rank <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k""",
)
def apportionment(spark, sf_dir):
    counts = _docs(spark, sf_dir).groupBy("source", "lang").agg(F.sqrt(F.count(F.lit(1))).alias("weight"))
    return S.apportion(counts, 37, by=["source"], tie="lang").select("source", "lang", "quota")


@register(
    "mixture_sample",
    """WITH c AS (SELECT source, lang, sqrt(count(*)) AS weight FROM documents GROUP BY 1, 2), r AS (SELECT *, round(weight / sum(weight) OVER (PARTITION BY source) * 12, 9) AS raw FROM c),
k AS (SELECT *, 12 - sum(floor(raw)) OVER (PARTITION BY source) AS spare, row_number() OVER (PARTITION BY source ORDER BY raw - floor(raw) DESC, sha256('tie:' || lang)) AS rank FROM r),
q AS (SELECT source, lang, floor(raw) + CASE WHEN rank <= spare THEN 1 ELSE 0 END AS quota FROM k),
d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY sha256('5:' || CAST(doc_id AS VARCHAR))) AS i FROM documents)
SELECT d.doc_id, d.source, d.lang FROM d JOIN q ON d.source = q.source AND d.lang = q.lang WHERE i <= quota""",
)
def mixture_sample(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    quotas = S.apportion(docs.groupBy("source", "lang").agg(F.sqrt(F.count(F.lit(1))).alias("weight")), 12, by=["source"], tie="lang")
    return S.sample_cells(docs, quotas, ["source", "lang"], 5, "doc_id").select("doc_id", "source", "lang")


@register("split_leakage", f"WITH d AS (SELECT sha256(text) AS state, source || '/' || lang AS lineage, CASE WHEN {_BUCKET} < 50 THEN 'a' ELSE 'b' END AS split FROM documents) SELECT 'lineage' AS key, lineage AS value, count(DISTINCT split) AS n_splits FROM d GROUP BY lineage HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'state', state, count(DISTINCT split) FROM d GROUP BY state HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    docs = S.bucket_split(_docs(spark, sf_dir), "doc_id", {"a": 50, "b": 50}).select("split", F.sha2("text", 256).alias("state"), F.concat_ws("/", "source", "lang").alias("lineage"))
    return S.leakage(docs, ["state", "lineage"])


@register("pool_summary", "SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, count(*) AS samples, count(DISTINCT text) AS states, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def pool_summary(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("state", F.xxhash64("text")).cube("source", "lang").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("state").alias("states"), F.sum("n_chars").alias("chars")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "samples", "states", "chars")


@register(
    "evidence_groups",
    """WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS state, CASE WHEN doc_id % 7 = 0 THEN CAST(doc_id // 21 AS VARCHAR) END AS lineage FROM documents),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.state = b.state UNION SELECT a.doc_id, b.doc_id FROM d a JOIN d b ON a.lineage = b.lineage),
r AS (SELECT doc_id AS id, doc_id AS o FROM d UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.o)
SELECT id, min(o) AS "group" FROM r GROUP BY id""",
)
def evidence_groups(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("state"), F.expr("CASE WHEN doc_id % 7 = 0 THEN cast(doc_id div 21 AS string) END").alias("lineage"))
    return G.connected_rows(docs, "doc_id", ["state", "lineage"])


@register("first_by_fingerprint", "SELECT source, min(sha256(text)) AS fingerprint, min_by(doc_id, sha256(text) || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS doc_id FROM documents GROUP BY source")
def first_by_fingerprint(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("source", "doc_id", F.sha2("text", 256).alias("fingerprint"))
    return S.first_by(docs, ["source"], ["fingerprint", "doc_id"])


@register("near_equal_groups", """WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
g AS (SELECT *, CAST(ceil(n / 7.0) AS BIGINT) AS g FROM r), p AS (SELECT source, doc_id, CASE WHEN i < (n % g) * (n // g + 1) THEN i // (n // g + 1) ELSE (n % g) + (i - (n % g) * (n // g + 1)) // (n // g) END + 1 AS part FROM g)
SELECT source, CAST(part AS INTEGER) AS part, count(*) AS n, min(doc_id) AS first FROM p GROUP BY 1, 2""")
def near_equal_groups(spark, sf_dir):
    return S.near_equal_groups(_docs(spark, sf_dir), ["source"], ["doc_id"], 7).groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = "list_filter(regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + _STOP + "))"


@register(
    "bm25_spans",
    f"""WITH s AS (SELECT doc_id, unnest(range(0, len(l))) AS span, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
t AS (SELECT doc_id, span, {_TOKENS.format("text")} AS w FROM s), sizes AS (SELECT doc_id, count(*) AS n, avg(len(w)) AS avg_len FROM t GROUP BY doc_id),
q AS (SELECT doc_id, unnest(list_distinct({_TOKENS.format("text")})) AS term FROM documents),
tf AS (SELECT doc_id, span, len, term, count(*) AS tf FROM (SELECT doc_id, span, len(w) AS len, unnest(w) AS term FROM t) JOIN q USING (doc_id, term) GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM tf GROUP BY ALL),
r AS (SELECT doc_id, span, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest(avg_len, 1)))) AS score FROM tf JOIN df USING (doc_id, term) JOIN sizes USING (doc_id) GROUP BY ALL)
SELECT s.doc_id, CAST(s.span AS INTEGER) AS span, round(coalesce(score, 0), 6) AS score FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.span = s.span""",
)
def bm25_spans(spark, sf_dir):
    """Lines of every document, in any language, against its whole text."""
    ship(spark)
    docs = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"), "text")
    scored = docs.select("doc_id", F.posexplode(R.bm25_in_row(F.col("lines"), F.col("text"))).alias("span", "score"))
    return scored.select("doc_id", "span", F.round("score", 6).alias("score"))


@register("packed_spans")
def packed_spans(spark, sf_dir):
    """Lines by length, then place, packed into 600 characters."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("span", "t"))
    return R.pack_spans(lines.select("doc_id", F.struct((-F.length("t")).alias("k"), "span").alias("priority"), "span", F.length("t").alias("chars")), 600).select("doc_id", "chars", F.array_join("spans", ",").alias("spans"))


@register("evidence_spans")
def evidence_spans(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.evidence_spans("text")).alias("span", "s")).select("doc_id", "span", "s.start", "s.stop")


@register("evidence_selection")
def evidence_selection(spark, sf_dir):
    """Spans chosen from every long document, with its source and language as the question.

    Spans are cut and scored in the document's own row; only their places and scores are shuffled.
    """
    ship(spark)
    docs = _docs(spark, sf_dir).select("doc_id", F.length("text").alias("length"), "text", F.concat_ws(" ", "source", "lang").alias("query"))
    rows = docs.where(F.col("length") > R.WHOLE_CHARS).select("doc_id", "length", F.posexplode(R.scored_evidence_spans(F.col("text"), F.col("query"))).alias("span", "s")).select("doc_id", "length", "span", "s.*")
    return R.select_scored(rows).select("doc_id", "chars", F.array_join("spans", ",").alias("spans"))


@register("role_by_hash")
def role_by_hash(spark, sf_dir):
    pick = H.role_of({"train": 80, "dev": 10, "test": 10})
    return _docs(spark, sf_dir).groupBy(pick(F.col("doc_id").cast("string")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@register("normalized_text")
def normalized_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.normalize_text("text"), 256).alias("hash"), T.grounded(F.left("text", F.lit(60)), "text").alias("grounded"))
