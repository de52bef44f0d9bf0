"""Recorded questions of several shapes as items: benchmark records, canonical samples, questions as they come over the wire.

Records are JSON text, one a row. Column functions read, check and reshape
them; nothing is refused by an exception: an item that breaks a rule has the
rule's name in ``fault``, and ``items`` without a fault are sound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import probability as P

# Fixed values, part of the data contract: names of tiers, prefixes that hint at one in their order, and labels that mean no.
TIER_NAMES = {"easy": "easy", "original": "standard", "standard": "standard", "judge": "judge", "hard": "hard"}
TIER_PREFIXES = (("easy", "easy"), ("original", "standard"), ("standard", "standard"), ("hard", "hard"))
FALSE_LABELS = ("false", "no", "0")
MOST_CHOICES, MOST_LEVELS = 255, 10

_META = "struct<tier: string, task_family: string, split: string, case_id: string, source: string, source_example_id: string, source_lineage: string, case_facts_sha256: string, modality: string, media: string, lineage_ids: array<string>>"
_RECORD = f"id string, state string, question struct<type: string, instructions: string, instruction: string, criteria: string>, labels array<string>, expected string, family string, tier string, split string, source string, public boolean, media string, `group` string, case_id string, lineage_ids array<string>, provenance struct<gold_probs: map<string, double>>, target_distribution map<string, double>, gold_distribution map<string, double>, metadata {_META}"
_CANDIDATE = "struct<id: string, description: string, ordinal: bigint>"
_SAMPLE = f"id string, state string, family string, tier string, split string, public boolean, media string, case_id string, questions array<struct<id: string, type: string, instruction: string, family: string, tier: string, candidates: array<{_CANDIDATE}>, target_distribution: map<string, double>>>, metadata {_META}"


def _stem(source: Column) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_replace(F.regexp_extract(source, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")


def infer_tier(record: Column, source: Column) -> Column:
    """easy, standard, judge or hard: by the first recorded name, then by hints in family, split and id, else standard."""
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    meta = record["metadata"]
    named = [lower(c) for c in (record["tier"], meta["tier"], record["split"], _stem(source))]
    names = F.create_map(*[F.lit(x) for pair in TIER_NAMES.items() for x in pair])
    recorded = F.coalesce(*[F.try_element_at(names, c) for c in named])
    hints = [lower(c) for c in (record["tier"], record["family"], record["split"], record["id"], meta["tier"], meta["task_family"], meta["split"], _stem(source))]
    judged = F.exists(F.array(*hints), lambda h: F.contains(h, F.lit("judge")))
    by_prefix = [F.when(h.rlike(f"^{prefix}([-_/]|\\z)"), tier) for h in hints for prefix, tier in TIER_PREFIXES]
    return F.coalesce(recorded, F.when(judged, "judge"), *by_prefix, F.lit("standard"))


def is_public(record: Column, source: Column, folders: tuple[str, ...] = ("public",)) -> Column:
    """Marked so, of the split ``public``, or below a folder of that name."""
    split = F.coalesce(record["split"], record["metadata"]["split"], F.lit(""))
    parts = F.transform(F.split(source, r"[/\\]"), F.lower)
    return F.coalesce(record["public"], F.lit(False)) | (split == "public") | F.arrays_overlap(parts, F.array(*map(F.lit, folders)))


def is_image(record: Column) -> Column:
    """Whether a record's evidence is a picture: by modality, or media that are not empty."""
    given = lambda c: F.coalesce(~c.isin("", "[]", "{}", "null", "false"), F.lit(False))
    return F.coalesce(record["metadata"]["modality"] == "image", F.lit(False)) | given(record["metadata"]["media"]) | given(record["media"])


def wire_question(kind: Column, criteria: Column, sort_score: bool = False) -> Column:
    """Struct of ``labels``, ``descriptions`` and ``fault`` of a question as sent: criteria are a JSON object, a list, or absent for a noul.

    A noul takes descriptions of false and true, or of no and yes; a choice a list of options or an object of
    descriptions, blank ones standing for their labels; a score a list of levels from 0 or an object by level.
    """
    by_name = F.from_json(criteria, "map<string,string>")
    keys = F.json_object_keys(criteria)
    listed = F.when(F.trim(criteria).startswith("["), F.from_json(criteria, "array<string>"))
    absent = criteria.isNull() | (criteria == "null")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    described = lambda names: F.transform(names, lambda k: F.try_element_at(by_name, k))
    old = F.coalesce(F.size(F.array_except(keys, F.array(F.lit("no"), F.lit("yes")))) == 0, F.lit(False))
    names = F.when(old, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("false"), F.lit("true")))
    noul_labels = F.array(F.lit("false"), F.lit("true"))
    noul_text = F.when(absent, noul_labels).otherwise(F.zip_with(described(names), noul_labels, lambda d, label: F.coalesce(d, label)))
    noul_fault = F.when(~absent & (keys.isNull() | (~old & (F.size(F.array_except(keys, noul_labels)) > 0))), "noul criteria")
    levels = F.array_sort(keys, lambda a, b: F.signum(a.try_cast("bigint") - b.try_cast("bigint")).cast("int")) if sort_score else keys
    score_labels = F.when(listed.isNotNull(), F.transform(F.sequence(F.lit(0), F.greatest(F.size(listed) - 1, F.lit(0))), lambda i: i.cast("string"))).otherwise(levels)
    choice_labels = F.coalesce(listed, keys)
    choice_text = F.when(listed.isNotNull(), listed).otherwise(F.zip_with(described(keys), keys, lambda d, k: F.when(blank(d), k).otherwise(d)))
    score_text = F.when(listed.isNotNull(), listed).otherwise(described(levels))
    of_kind = lambda noul, choice, score: F.when(kind == "noul", noul).when(kind == "choice", choice).when(kind == "score", score)
    labels, texts = of_kind(noul_labels, choice_labels, score_labels), of_kind(noul_text, choice_text, score_text)
    width = F.size(F.coalesce(listed, keys))
    outside = lambda most: F.coalesce(listed, keys).isNull() | (width < 2) | (width > most)
    fault = (
        F.when(F.coalesce(~kind.isin("noul", "choice", "score"), F.lit(True)), "unknown type")
        .when(kind == "noul", noul_fault)
        .when((kind == "choice") & outside(MOST_CHOICES), "number of options")
        .when((kind == "score") & outside(MOST_LEVELS), "number of levels")
        .when((kind == "score") & F.exists(texts, blank), "blank level")
        .when(F.size(F.array_distinct(labels)) != F.size(labels), "repeated label")
    )
    return F.struct(labels.alias("labels"), texts.alias("descriptions"), fault.alias("fault"))


def _gold_fault(labels: Column, gold: Column) -> Column:
    """Why a distribution over labels is not sound, or null."""
    mass = F.map_values(gold)
    return (
        F.when(gold.isNull() | (F.size(gold) == 0), "no gold")
        .when(F.size(F.array_except(F.map_keys(gold), labels)) > 0, "gold outside labels")
        .when(F.exists(mass, lambda x: x.isNull() | F.isnan(x) | (x < 0)) | (F.abs(P.total(mass) - 1) > 1e-3), "gold is no distribution")
    )


def _mapped(gold: Column, rename: Column) -> Column:
    """A map with its keys renamed; keys that the renaming lacks stay."""
    return F.map_from_arrays(F.transform(F.map_keys(gold), lambda k: F.coalesce(F.try_element_at(rename, k), k)), F.map_values(gold))


def benchmark_items(records: DataFrame, json_col: str = "record", source: str | Column = "inline") -> DataFrame:
    """Items of benchmark records: ``id``, ``source``, ``tier``, ``state``, ``type``, ``instruction``, ``labels``, ``descriptions``, ``gold``, ``public``, ``identity``, ``split``, ``family``, ``lineage`` and ``fault``.

    A record has a question, labels and an expected label or distribution; a recorded distribution (of gold probabilities, then
    targets) goes before it. A choice's criteria describe its labels, by name or place; a noul's labels become false and true.
    The identity that keeps cases together is the record's group, the id of a public record, its case, or its id.
    Text that is no such record gives an item with the fault *record*.
    """
    where = F.lit(source) if isinstance(source, str) else source
    rows = records.select(F.from_json(F.col(json_col), _RECORD).alias("r"), where.alias("from"))
    r = F.col("r")
    kind, given = r["question"]["type"], r["labels"]
    no = lambda x: F.lower(x).isin(*FALSE_LABELS)
    false = F.get(F.filter(given, no), F.lit(0))
    known = F.array_distinct(F.array_compact(given))
    rename = F.map_from_arrays(known, F.transform(known, lambda x: F.when(kind != "noul", x).when(x == false, "false").otherwise("true")))
    criteria = r["question"]["criteria"]
    by_name, by_place = F.from_json(criteria, "map<string,string>"), F.when(F.trim(criteria).startswith("["), F.from_json(criteria, "array<string>"))
    choice_text = F.transform(given, lambda x, i: F.coalesce(F.get(by_place, i), F.try_element_at(by_name, x), x))
    parsed = wire_question(kind, criteria)
    choice = kind == "choice"
    labels = F.when(choice, given).otherwise(parsed["labels"])
    expected = F.when(r["expected"].startswith("{"), F.from_json(r["expected"], "map<string,double>")).otherwise(F.create_map(F.coalesce(r["expected"], F.lit("")), F.lit(1.0)))
    gold = _mapped(F.coalesce(r["provenance"]["gold_probs"], r["target_distribution"], r["gold_distribution"], expected), rename)
    public = is_public(r, F.col("from"))
    identity = F.coalesce(r["group"], F.when(~public, F.coalesce(r["case_id"], r["metadata"]["case_id"])), r["id"])
    fault = (
        F.when(r.isNull() | r["id"].isNull() | given.isNull() | r["expected"].isNull() | F.exists(given, lambda x: x.isNull()), "record")
        .when((kind == "noul") & (F.size(given) != 2), "noul labels")
        .when((kind == "noul") & false.isNull(), "no false label")
        .when(choice & ((F.size(given) < 2) | (F.size(given) > MOST_CHOICES)), "number of options")
        .when(choice & (F.size(F.array_distinct(given)) != F.size(given)), "repeated label")
    )
    fault = F.coalesce(fault, F.when(~choice, parsed["fault"]), _gold_fault(labels, gold))
    return rows.select(
        r["id"].alias("id"),
        F.coalesce(r["source"], F.col("from")).alias("source"),
        infer_tier(r, F.col("from")).alias("tier"),
        F.coalesce(r["state"], F.lit("")).alias("state"),
        kind.alias("type"),
        F.coalesce(r["question"]["instructions"], r["question"]["instruction"], F.lit("")).alias("instruction"),
        labels.alias("labels"),
        F.when(choice, choice_text).otherwise(parsed["descriptions"]).alias("descriptions"),
        gold.alias("gold"),
        public.alias("public"),
        identity.alias("identity"),
        F.coalesce(r["split"], r["metadata"]["split"]).alias("split"),
        r["family"].alias("family"),
        F.coalesce(r["lineage_ids"], r["metadata"]["lineage_ids"], F.array().cast("array<string>")).alias("lineage"),
        fault.alias("fault"),
    )


def canonical_items(records: DataFrame, json_col: str = "record", source: str | Column = "inline") -> DataFrame:
    """The same columns, one item per question of canonical samples; records of pictures give none.

    A noul's candidates become false and true, a score's are named by their ordinals, which must be there and distinct. Tiers count only where
    they are recorded. The lineage is every recorded ancestor and the case itself, sorted.
    """
    where = F.lit(source) if isinstance(source, str) else source
    rows = records.select(F.from_json(F.col(json_col), _SAMPLE).alias("r"), where.alias("from"))
    rows = rows.where(~is_image(F.col("r"))).select("r", "from", F.posexplode("r.questions").alias("place", "q"))
    r, q, meta = F.col("r"), F.col("q"), F.col("r")["metadata"]
    base = F.coalesce(r["id"], meta["source_example_id"], F.col("from"))
    case = F.coalesce(meta["source_lineage"], meta["case_facts_sha256"], r["case_id"], meta["case_id"], base)
    ids = F.transform(q["candidates"], lambda c: c["id"])
    named = F.transform(q["candidates"], lambda c: F.when(q["type"] == "noul", F.when(F.lower(c["id"]).isin(*FALSE_LABELS), "false").otherwise("true")).when(q["type"] == "score", c["ordinal"].cast("string")).otherwise(c["id"]))
    pairs = F.arrays_zip(ids.alias("id"), named.alias("name"), F.transform(q["candidates"], lambda c: c["description"]).alias("text"))
    # a noul is read as false, then true
    pairs = F.when(q["type"] == "noul", F.array_sort(pairs, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))).otherwise(pairs)
    labels = F.transform(pairs, lambda p: p["name"])
    rename = F.map_from_entries(F.transform(F.filter(F.arrays_zip(ids.alias("k"), named.alias("v")), lambda e: e["k"].isNotNull() & e["v"].isNotNull()), lambda e: F.struct(e["k"], e["v"])))
    gold = _mapped(q["target_distribution"], rename)
    bad = (
        F.when(F.coalesce(~q["type"].isin("noul", "choice", "score"), F.lit(True)), "unknown type")
        .when((q["type"] == "score") & F.exists(q["candidates"], lambda c: c["ordinal"].isNull()), "no ordinal")
        .when((F.size(F.array_distinct(ids)) != F.size(ids)) | (F.size(F.array_distinct(labels)) != F.size(labels)), "repeated label")
        .when((F.size(ids) < 2) | ((q["type"] == "noul") & (F.size(ids) != 2)), "number of options")
    )
    sound = F.when(bad.isNull(), _gold_fault(labels, gold))
    tier = F.coalesce(q["tier"], r["tier"], meta["tier"], F.lit("standard"))
    ancestors = F.concat(F.coalesce(meta["lineage_ids"], F.array().cast("array<string>")), F.array(meta["source_lineage"], meta["case_facts_sha256"], case))
    return rows.select(
        F.concat_ws("/", base, F.coalesce(q["id"], F.col("place").cast("string"))).alias("id"),
        F.coalesce(meta["source"], F.col("from")).alias("source"),
        F.when(tier == "original", "standard").otherwise(tier).alias("tier"),
        F.coalesce(r["state"], F.lit("")).alias("state"),
        q["type"].alias("type"),
        F.coalesce(q["instruction"], F.lit("")).alias("instruction"),
        labels.alias("labels"),
        F.transform(pairs, lambda p: F.when(F.coalesce(p["text"], F.lit("")) == "", p["name"]).otherwise(p["text"])).alias("descriptions"),
        F.when(bad.isNull(), gold).alias("gold"),
        is_public(r, F.col("from")).alias("public"),
        case.alias("identity"),
        F.coalesce(r["split"], meta["split"]).alias("split"),
        F.coalesce(q["family"], r["family"], meta["task_family"]).alias("family"),
        F.array_sort(F.array_distinct(F.array_compact(ancestors))).alias("lineage"),
        F.coalesce(bad, sound).alias("fault"),
    )


def benchmark_records(items: DataFrame) -> DataFrame:
    """Items back as benchmark records (``id`` and ``record``, JSON): what ``benchmark_items`` reads as the same item."""
    criteria = F.map_from_arrays("labels", "descriptions")
    question = F.struct("type", F.col("instruction").alias("instructions"), criteria.alias("criteria"))
    top = F.get("labels", P.argmax(F.transform("labels", lambda x: F.coalesce(F.try_element_at("gold", x), F.lit(0.0)))))
    fields = F.struct("id", "source", "tier", "state", question.alias("question"), "labels", top.alias("expected"), F.col("gold").alias("gold_distribution"), "public", F.col("identity").alias("group"), "split", "family", F.col("lineage").alias("lineage_ids"))
    return items.where("fault IS NULL").select("id", F.to_json(fields).alias("record"))
