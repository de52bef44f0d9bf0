"""Queries that keep reserved evidence apart: blockers over whole samples, closure of paragraphs, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.operators import evidence_block as B
from grainmill.operators import paragraphs as P
from grainmill.plans.queries_corpus import _FOLD, _WORDS
from grainmill.plans.registry import register
from grainmill.plans.tables import table
from grainmill.plans.workspace import Workspace

_WIDTHS = f"""
protected AS (SELECT DISTINCT {_WORDS.format("t")} AS w FROM (SELECT text AS t FROM benchmark UNION ALL SELECT unnest(regexp_split_to_array(text, '[.!?]')) FROM benchmark)),
long AS (SELECT DISTINCT array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM protected WHERE len(w) >= 13)),
short AS (SELECT DISTINCT len(w) AS size, array_to_string(w, ' ') AS key FROM protected WHERE len(w) BETWEEN 4 AND 12),
parts AS (
  SELECT 'd' || doc_id AS sample, 'state' AS part, text FROM documents
  UNION ALL SELECT 'd' || doc_id, 'instruction', source FROM documents
  UNION ALL SELECT 'c' || conv_id, CASE role WHEN 'system' THEN 'state' WHEN 'user' THEN 'instruction' ELSE 'candidate' END, text FROM conversations
), folded AS (SELECT sample, part, {_WORDS.format("text")} AS w, row_number() OVER () AS r FROM parts)"""


def _parts(spark, sf_dir: str) -> DataFrame:
    """States, instructions and candidates of samples: a document with its source, a conversation with its turns by role."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    of_doc = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample")
    role = F.when(F.col("role") == "system", "state").when(F.col("role") == "user", "instruction").otherwise("candidate")
    states = docs.select(of_doc, F.lit("state").alias("part"), "text")
    instructions = docs.select(of_doc, F.lit("instruction").alias("part"), F.col("source").alias("text"))
    return states.unionByName(instructions).unionByName(turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("sample"), role.alias("part"), "text"))


def _protected(spark, sf_dir: str) -> DataFrame:
    """Benchmark texts, and their sentences as texts of their own."""
    texts = table(spark, sf_dir, "benchmark").select("text")
    return texts.unionByName(texts.select(F.explode(F.split("text", "[.!?]")).alias("text")))


@register(
    "evidence_blocked",
    f"""WITH {_WIDTHS},
places AS (SELECT f.sample, s.size, array_to_string(f.w[i:i + s.size - 1], ' ') AS key FROM folded f, (SELECT DISTINCT size FROM short UNION SELECT 13) s, unnest(range(1, len(f.w) - s.size + 2)) AS u(i) WHERE len(f.w) >= s.size),
hits AS (
  SELECT sample, 'gram' AS kind FROM places JOIN long USING (key) WHERE places.size = 13
  UNION SELECT sample, 'run' FROM places JOIN short USING (size, key)
), kinds AS (SELECT sample, string_agg(kind, ',' ORDER BY kind) AS kinds FROM hits GROUP BY sample)
SELECT sample, count(*) AS n_parts, coalesce(any_value(kinds), '') AS kinds, any_value(kinds) IS NOT NULL AS blocked FROM parts LEFT JOIN kinds USING (sample) GROUP BY sample""",
)
def evidence_blocked(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return B.blocked_samples(parts, B.part_hits(parts, B.protected_patterns(_protected(spark, sf_dir)), ["sample"]), "sample")


@register(
    "samples_decontaminated",
    f"""WITH {_WIDTHS},
places AS (SELECT f.sample, f.part, array_to_string(f.w[i:i + 12], ' ') AS key FROM folded f, unnest(range(1, len(f.w) - 11)) AS u(i) WHERE len(f.w) >= 13),
hits AS (
  SELECT sample, part, 'gram' AS kind FROM places JOIN long USING (key)
  UNION SELECT sample, part, 'exact' FROM folded f JOIN short s ON len(f.w) = s.size AND array_to_string(f.w, ' ') = s.key
)
SELECT part, kind, count(*) AS n_parts FROM hits GROUP BY part, kind""",
)
def samples_decontaminated(spark, sf_dir):
    patterns = B.protected_patterns(_protected(spark, sf_dir), reserved=False)
    return B.part_hits(_parts(spark, sf_dir), patterns, ["sample", "part"]).groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n_parts"))


ROLES, ROLE_SEED = {"train": 6, "dev": 2, "test": 2}, 5
#: Rows of each language and label that a role takes; some cells cannot be filled.
QUOTAS = {(role, lang, kind): {"train": 6, "dev": 3, "test": 2}[role] * (2 if kind == "choice" else 1) for role in ROLES for lang in ("en", "fr", "de") for kind in ("choice", "noul")}
_TITLE, _LINES = "split(coalesce(text, ''), '\\n')[0]", "filter(slice(split(coalesce(text, ''), '\\n'), 2, 1000000000), x -> length(x) >= 20)"

_ROLE_SQL = f"""lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
values_ AS (SELECT doc_id AS id, CASE WHEN i = 0 THEN 'title/' || source ELSE 'text/' END AS kind, {_FOLD.format("line")} AS value FROM lines WHERE i = 0 OR length(line) >= 20),
aliases AS (SELECT DISTINCT id, kind || ':' || value AS alias FROM values_ WHERE value <> ''),
edges AS MATERIALIZED (SELECT DISTINCT a.id AS a, h.head AS b FROM aliases a JOIN (SELECT alias, min(id) AS head FROM aliases GROUP BY alias) h USING (alias) WHERE a.id <> h.head),
both_ways AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
components AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
{_WIDTHS.split("folded AS")[0].strip().rstrip(",")},
bad AS (
  SELECT DISTINCT component FROM components JOIN (
    SELECT doc_id AS id FROM (SELECT doc_id, array_to_string(w[i:i + 12], ' ') AS key FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), unnest(range(1, len(w) - 11)) AS u(i) WHERE len(w) >= 13) JOIN long USING (key)
    UNION SELECT doc_id FROM (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents) JOIN short ON len(w) = size AND array_to_string(w, ' ') = key
  ) USING (id)
), rows_ AS (SELECT d.doc_id AS id, d.lang AS source, CASE l.quality WHEN 1 THEN 'choice' WHEN 0 THEN 'noul' END AS type FROM documents d LEFT JOIN labels l USING (doc_id)),
drawn AS (SELECT *, CAST('0x' || substr(sha256('{ROLE_SEED}:' || component), 1, 8) AS BIGINT) % {sum(ROLES.values())} AS draw FROM rows_ JOIN components USING (id)),
placed AS (SELECT *, CASE WHEN draw < {ROLES["dev"]} THEN 'dev' WHEN draw < {ROLES["dev"] + ROLES["test"]} THEN 'test' ELSE 'train' END AS role, component IN (SELECT component FROM bad) AS blocked FROM drawn),
plan (role, source, type, quota) AS (VALUES {", ".join(str((*c, n)) for c, n in QUOTAS.items())}),
turns AS (SELECT id, role, source, type, component, quota, row_number() OVER (PARTITION BY role, source, type, component ORDER BY id) AS turn FROM placed JOIN plan USING (role, source, type) WHERE NOT blocked),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, source, type ORDER BY turn, sha256('{ROLE_SEED}:' || component), component, id) AS place FROM turns) WHERE place <= quota)"""


def _paragraph_rows(spark, sf_dir):
    """Documents as rows: the first line is a title of its source, longer lines are paragraphs; labels give types."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = docs.selectExpr("doc_id AS id", "source", f"concat(array(struct({_TITLE} AS title, cast(null AS string) AS text)), transform({_LINES}, x -> struct(cast(null AS string) AS title, x AS text))) AS paragraphs")
    rows = docs.join(labels, "doc_id", "left").selectExpr("doc_id AS id", "lang AS source", "CASE quality WHEN 1 THEN 'choice' WHEN 0 THEN 'noul' END AS type")
    aliases = P.paragraph_aliases(held, "id", "paragraphs", "source")
    public = B.part_hits(docs.select(F.col("doc_id").alias("id"), "text"), B.protected_patterns(_protected(spark, sf_dir), reserved=False), ["id"])
    return P.assign_roles(rows, P.close_paragraphs(rows, aliases), public, ROLES, QUOTAS, ROLE_SEED), aliases


@register(
    "paragraph_roles",
    f"""WITH RECURSIVE {_ROLE_SQL}
SELECT p.id AS doc_id, p.component, p.role, CASE WHEN p.type IS NULL THEN 'bridge' WHEN blocked THEN 'blocked' WHEN plan.quota IS NULL THEN 'unplanned' WHEN k.id IS NOT NULL THEN 'selected' ELSE 'spare' END AS status
FROM placed p LEFT JOIN plan USING (role, source, type) LEFT JOIN picked k ON k.id = p.id""",
)
def paragraph_roles(spark, sf_dir):
    return _paragraph_rows(spark, sf_dir)[0].select(F.col("id").alias("doc_id"), "component", "role", "status")


@register(
    "paragraph_audit",
    f"""WITH RECURSIVE {_ROLE_SQL}, got AS (SELECT role, source, type, count(*) AS selected, count(DISTINCT component) AS components FROM picked GROUP BY ALL)
SELECT role, source, type, CAST(quota AS BIGINT) AS quota, coalesce(selected, 0) AS selected, coalesce(components, 0) AS components, quota - coalesce(selected, 0) AS missing,
  (SELECT count(*) FROM (SELECT alias FROM aliases JOIN picked USING (id) GROUP BY alias HAVING count(DISTINCT role) > 1)) AS shared
FROM plan LEFT JOIN got USING (role, source, type)""",
)
def paragraph_audit(spark, sf_dir):
    """Quotas against what was selected, and how many titles or texts two roles share (none may)."""
    assigned, aliases = _paragraph_rows(spark, sf_dir)
    assigned = Workspace(spark, "audit").table("assigned", assigned)
    shared = P.shared_between_roles(assigned, aliases).agg(F.count(F.lit(1)).alias("shared"))
    return P.quota_report(assigned, QUOTAS).join(F.broadcast(shared))  # one row
