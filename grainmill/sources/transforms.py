"""Raw rows to canonical samples.

A sample is ``state`` (text), ``questions`` (array of struct<id, type,
instruction, candidates, target>) and ``metadata`` (map). A transform takes a
DataFrame and returns samples; rows that give no question are left out. All of
them are column expressions. ``REGISTRY`` names them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import probability as P
from grainmill.functions import text as T

NOTA = "__nota__"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def candidates(descriptions: Column, prefix: str = "c", ordinals: bool = False) -> Column:
    """Candidates c0, c1, ... of an array of descriptions."""
    return F.transform(
        descriptions,
        lambda d, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("id"), d.cast("string").alias("description"), (i.cast("double") if ordinals else F.lit(None).cast("double")).alias("ordinal"), F.lit(False).alias("is_nota")),
    )


def question(qid: Column | str, kind: str, instruction: Column | str, options: Column, probabilities: Column) -> Column:
    """A question whose target gives the probabilities to the candidates in order."""
    ids = F.transform(options, lambda c: c["id"])
    return F.struct(
        (F.lit(qid) if isinstance(qid, str) else qid).alias("id"),
        F.lit(kind).alias("type"),
        (F.lit(instruction) if isinstance(instruction, str) else instruction).alias("instruction"),
        options.alias("candidates"),
        F.map_from_arrays(ids, probabilities).alias("target"),
    )


def noul(qid: Column | str, instruction: Column | str, p_true: Column) -> Column:
    """A yes/no question, candidates [false, true]."""
    return question(qid, "noul", instruction, candidates(F.array(F.lit("false"), F.lit("true")), "b"), F.array(1 - p_true, p_true))


def samples(df: DataFrame, state: Column, questions: Column, keep: Column | None = None, metadata: Sequence[str] = ()) -> DataFrame:
    """Samples of the rows with a non-empty array of questions; ``metadata`` columns go along as strings."""
    meta = F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]) if metadata else F.create_map().cast("map<string,string>")
    rows = df if keep is None else df.where(F.coalesce(keep, F.lit(False)))
    return rows.select(state.alias("state"), questions.alias("questions"), meta.alias("metadata")).where(F.size("questions") > 0)


_NLI = ("entailment", "neutral", "contradiction")


def nli_choice(df: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis", label: str = "label", instruction: str = "How does the hypothesis relate to the premise?", metadata: Sequence[str] = ()) -> DataFrame:
    """Three-way labels by number or name; others are dropped."""
    names = F.array(*map(F.lit, _NLI))
    at = F.coalesce(F.col(label).try_cast("int"), (F.array_position(names, F.lower(F.col(label).cast("string"))) - 1).cast("int"))
    state = F.concat(F.lit("Premise: "), F.col(premise), F.lit("\nHypothesis: "), F.col(hypothesis))
    return samples(df, state, F.array(question("q0", "choice", instruction, candidates(names), P.one_hot(F.lit(3), at))), at.between(0, 2), metadata)


def vote_distribution(df: DataFrame, state: str, options: Sequence[str], counts: str, instruction: str, metadata: Sequence[str] = ()) -> DataFrame:
    """A soft target from counts of votes; rows without votes are dropped."""
    c = F.transform(counts, lambda x: x.cast("double"))
    return samples(df, F.col(state), F.array(question("q0", "choice", instruction, candidates(F.array(*map(F.lit, options))), P.renormalize(c))), (P.total(c) > 0) & (F.size(counts) == len(options)), metadata)


def intent_choice(df: DataFrame, text: str, label: str, ontology: Sequence[str], out_of_scope: str = "oos", instruction: str = "Which intent does the text express?", metadata: Sequence[str] = ()) -> DataFrame:
    """A choice over an ontology; an out-of-scope row has a further none-of-these candidate with all the mass."""
    names = F.array(*map(F.lit, ontology))
    base = candidates(F.transform(names, lambda n: F.replace(n, F.lit("_"), F.lit(" "))))
    nota = F.struct(F.lit(NOTA).alias("id"), F.lit("none of these").alias("description"), F.lit(None).cast("double").alias("ordinal"), F.lit(True).alias("is_nota"))
    at, out = F.array_position(names, F.col(label)) - 1, F.col(label) == out_of_scope
    inside = question("q0", "choice", instruction, base, P.one_hot(F.lit(len(ontology)), at))
    outside = question("q0", "choice", instruction, F.concat(base, F.array(nota)), P.one_hot(F.lit(len(ontology) + 1), F.lit(len(ontology))))
    return samples(df, F.col(text), F.array(F.when(out, outside).otherwise(inside)), out | (at >= 0), metadata)


def multiple_choice(df: DataFrame, state: Column | str, options: Column | str, answer: Column | str, instruction: Column | str, max_chars: int | None = None, metadata: Sequence[str] = ()) -> DataFrame:
    """An indexed answer over distinct options; out-of-range answers and states over ``max_chars`` are dropped, never cut."""
    o, at = _c(options), _c(answer).cast("int")
    keep = (at >= 0) & (at < F.size(o)) & (F.size(F.array_distinct(o)) == F.size(o)) & (F.size(o) >= 2)
    if max_chars is not None:
        keep = keep & (F.length(_c(state)) <= max_chars)
    return samples(df, _c(state), F.array(question("q0", "choice", instruction, candidates(o), P.one_hot(F.size(o), at))), keep, metadata)


def labelled_choice(df: DataFrame, state: str, labels: str, texts: str, key: str, instruction: Column | str, metadata: Sequence[str] = ()) -> DataFrame:
    """An answer given by its label, as A to E."""
    return multiple_choice(df, state, texts, F.array_position(F.col(labels), F.col(key)) - 1, instruction, metadata=metadata)


def boolean_noul(df: DataFrame, state: Column | str, instruction: Column | str, answer: Column | str, metadata: Sequence[str] = ()) -> DataFrame:
    """A boolean or probability as a yes/no question; null answers are dropped."""
    p = _c(answer).cast("double")
    return samples(df, _c(state), F.array(noul("q0", instruction, p)), p.between(0, 1), metadata)


def many_nouls(df: DataFrame, state: Column | str, answers: Column | str, template: str, metadata: Sequence[str] = ()) -> DataFrame:
    """One yes/no question for each entry (text, p) of an array of structs; ``{text}`` in the template is replaced."""
    made = F.transform(F.filter(_c(answers), lambda a: a["p"].isNotNull()), lambda a, i: noul(F.concat(F.lit("q"), i.cast("string")), F.replace(F.lit(template), F.lit("{text}"), a["text"]), a["p"].cast("double")))
    return samples(df, _c(state), made, None, metadata)


def adjacent_levels(score: Column, n: int) -> Column:
    """Linear mass on the two levels next to a real score; at the last level all on it."""
    low = F.floor(score)
    high = F.least(low + 1, F.lit(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i == low) & (low == high), 1.0).when(i == low, 1 - (score - low)).when(i == high, score - low).otherwise(0.0))


def real_score(df: DataFrame, state: Column | str, score: Column | str, n: int, instruction: str, qid: str = "q0", metadata: Sequence[str] = ()) -> DataFrame:
    """A real score in 0..n-1 on n levels; others are dropped."""
    s = _c(score).cast("double")
    levels = candidates(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string")), "l", ordinals=True)
    return samples(df, _c(state), F.array(question(qid, "score", instruction, levels, adjacent_levels(s, n))), s.between(0, n - 1), metadata)


def attribute_scores(df: DataFrame, state: Column | str, attributes: Sequence[str], n: int, template: str, metadata: Sequence[str] = ()) -> DataFrame:
    """A score question for each attribute that is not null."""
    levels = candidates(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("string")), "l", ordinals=True)
    made = [F.when(F.col(a).cast("double").between(0, n - 1), question(a, "score", template.replace("{text}", a), levels, adjacent_levels(F.col(a).cast("double"), n))) for a in attributes]
    return samples(df, _c(state), F.array_compact(F.array(*made)), None, metadata)


def distilled(df: DataFrame, state: str, options: str, target: str, instruction: Column | str, metadata: Sequence[str] = ()) -> DataFrame:
    """A teacher's weights as target: negative ones count as 0, the rest is normalised."""
    keep = (F.size(options) == F.size(target)) & (F.size(options) >= 2)
    return samples(df, F.col(state), F.array(question("q0", "choice", instruction, candidates(F.col(options)), P.clip_renormalize(F.transform(target, lambda x: x.cast("double"))))), keep, metadata)


def preference_choice(df: DataFrame, chosen: str = "chosen", rejected: str = "rejected", marker: str = "\n\nAssistant:", instruction: str = "Which reply is better?", metadata: Sequence[str] = ()) -> DataFrame:
    """Two dialogues that differ in the last reply only. The order of the replies is hashed from the prompt."""
    reply = lambda c: F.substring_index(F.col(c), marker, -1)
    prefix = lambda c: F.expr(f"left({c}, length({c}) - length(substring_index({c}, '{marker}', -1)))".replace("\n", "\\n"))
    good, bad = F.trim(reply(chosen)), F.trim(reply(rejected))
    keep = F.contains(chosen, F.lit(marker)) & (prefix(chosen) == prefix(rejected)) & (good != bad) & (good != "") & (bad != "")
    flip = F.pmod(F.crc32(prefix(chosen).cast("binary")), F.lit(2)) == 1
    options = F.when(flip, F.array(bad, good)).otherwise(F.array(good, bad))
    return samples(df, prefix(chosen), F.array(question("q0", "choice", instruction, candidates(options), F.when(flip, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))))), keep, metadata)


def lettered_choice(df: DataFrame, state: str, options: str, answer: str, instruction: str = "Which answer is right?", metadata: Sequence[str] = ()) -> DataFrame:
    """Options written as ``A)text``; every one must match, and the texts be distinct."""
    pattern = r"^\s*([A-E])\s*\)\s*(.+)$"
    texts = F.transform(options, lambda o: F.regexp_extract(o, pattern, 2))
    letters = F.transform(options, lambda o: F.regexp_extract(o, pattern, 1))
    keep = F.forall(options, lambda o: o.rlike(pattern))
    return multiple_choice(df.where(keep), state, texts, F.array_position(letters, F.col(answer)) - 1, instruction, metadata=metadata)


def paragraph_decision(df: DataFrame, titles: str, paragraphs: str, question_col: str, answer: str, choices: str, metadata: Sequence[str] = ()) -> DataFrame:
    """Paragraphs as state; yes/no answers as a yes/no question, else a choice of the two compared; others are dropped."""
    state = F.array_join(F.zip_with(titles, paragraphs, lambda t, p: F.concat(t, F.lit(": "), p)), "\n\n")
    yes = F.lower(F.col(answer)).isin("yes", "no")
    at = F.array_position(F.col(choices), F.col(answer)) - 1
    first = samples(df, state, F.array(noul("q0", F.col(question_col), (F.lower(F.col(answer)) == "yes").cast("double"))), yes, metadata)
    second = samples(df, state, F.array(question("q0", "choice", F.col(question_col), candidates(F.col(choices)), P.one_hot(F.size(choices), at))), ~yes & (at >= 0) & (F.size(choices) == 2), metadata)
    return first.unionByName(second)


def ordinal_score(df: DataFrame, state: Column | str, label: str, n: int, instruction: str, descriptions: Sequence[str] | None = None, metadata: Sequence[str] = ()) -> DataFrame:
    """A whole-number label on n described levels; labels outside them are dropped."""
    at = F.col(label).try_cast("int")
    names = F.array(*[F.lit(d) for d in descriptions or [f"level {i}" for i in range(n)]])
    return samples(df, _c(state), F.array(question("q0", "score", instruction, candidates(names, "l", ordinals=True), P.one_hot(F.lit(n), at))), at.between(0, n - 1), metadata)


def typed_passthrough(df: DataFrame, state: str = "state", questions: str = "questions", metadata: Sequence[str] = ()) -> DataFrame:
    """Rows that already hold typed questions, cast to the canonical types; a question without id takes its place, q0, q1, ..."""
    option = lambda c: F.struct(c["id"].cast("string").alias("id"), c["description"].cast("string").alias("description"), c["ordinal"].cast("double").alias("ordinal"), F.coalesce(c["is_nota"], F.lit(False)).alias("is_nota"))
    mass = lambda q: F.map_from_entries(F.transform(F.map_entries(q["target"]), lambda e: F.struct(e["key"].cast("string"), e["value"].cast("double"))))
    cast = F.transform(F.col(questions), lambda q, i: F.struct(F.coalesce(q["id"].cast("string"), F.concat(F.lit("q"), i.cast("string"))).alias("id"), q["type"].alias("type"), q["instruction"].alias("instruction"), F.transform(q["candidates"], option).alias("candidates"), mass(q).alias("target")))
    return samples(df, F.col(state), cast, None, metadata)


#: Descriptions that mean no.
NO_WORDS = ("no", "false")


def question_rows(df: DataFrame, group: str, order: str, state_json: str = "state_json", metadata: Sequence[str] = ()) -> DataFrame:
    """Rows of one question each (``id``, ``kind``, ``question``, ``options``, ``target``) as one sample of each group.

    Negative weights count as 0. A question is left out where options and target differ in length, are
    fewer than two, weigh nothing, or (choices) repeat an option. A state that is a JSON string of JSON is
    decoded once more. A group is one decision with its few questions, which bounds what a row gathers.
    """
    weights = F.transform("target", lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    sound = (F.size("options") == F.size("target")) & (F.size("options") >= 2) & (P.total(weights) > 0)
    share, qid = P.renormalize(weights), F.regexp_extract("id", "[^:]*$", 0)
    no = P.total(F.zip_with("options", share, lambda o, w: F.when(F.lower(o).isin(*NO_WORDS), w).otherwise(0.0)))
    choice = F.when(F.size(F.array_distinct("options")) == F.size("options"), question(qid, "choice", F.col("question"), candidates(F.col("options"), "o"), share))
    made = F.when(F.col("kind") == "noul", noul(qid, F.col("question"), 1 - no)).when(F.col("kind") == "score", question(qid, "score", F.col("question"), candidates(F.col("options"), "s", ordinals=True), share)).otherwise(choice)
    rows = df.withColumn("_q", F.when(sound, made))
    first = F.min_by(F.struct(state_json, *metadata), F.col(order))
    own = F.array_sort(F.collect_list(F.when(F.col("_q").isNotNull(), F.struct(F.col(order).alias("o"), F.to_json("_q").alias("j"), F.col("_q").alias("q")))), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["j"] < b["j"], -1).when(a["j"] > b["j"], 1).otherwise(0))
    out = rows.groupBy(group).agg(first.alias("_f"), own.alias("_r")).select(group, "_f.*", F.transform("_r", lambda r: r["q"]).alias("_q"))
    unquoted = F.when(F.col(state_json).startswith('"'), F.get_json_object(F.concat(F.lit('{"s":'), F.col(state_json), F.lit("}")), "$.s")).otherwise(F.col(state_json))
    return samples(out, unquoted, F.col("_q"), None, [group, *metadata])


#: Verdicts on a claim and their descriptions.
VERDICTS = {"SUPPORTS": "The evidence supports the claim", "REFUTES": "The evidence contradicts the claim", "NOT ENOUGH INFO": "The evidence neither supports nor contradicts the claim"}


def verdict_choice(df: DataFrame, evidence: str = "evidence", claim: str = "claim", label: str = "label", metadata: Sequence[str] = ()) -> DataFrame:
    """A claim against its evidence, three verdicts; other labels are dropped."""
    ids = [v.lower().replace(" ", "_") for v in VERDICTS]
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(d).alias("description"), F.lit(None).cast("double").alias("ordinal"), F.lit(False).alias("is_nota")) for i, d in zip(ids, VERDICTS.values(), strict=True)])
    at = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col(label)) - 1
    ask = F.concat(F.lit("Claim: "), F.col(claim), F.lit("\nWhat does the evidence say about this claim?"))
    return samples(df, F.col(evidence), F.array(question("q0", "choice", ask, options, P.one_hot(F.lit(3), at))), at >= 0, metadata)


def safety_nouls(df: DataFrame, metadata: Sequence[str] = ()) -> DataFrame:
    """Safety of a prompt and of its response, where a person judged it; redacted or empty prompts are dropped."""
    judged = lambda side: F.col(f"{side}_label").isin("safe", "unsafe") & (F.col(f"{side}_label_source") == "human")
    unsafe = lambda side: (F.col(f"{side}_label") == "unsafe").cast("double")
    replied = F.coalesce(F.col("response") != "", F.lit(False))
    made = F.array_compact(
        F.array(
            F.when(judged("prompt"), noul("prompt_unsafe", "Is the user's request unsafe (harmful, abusive or seeking dangerous help)?", unsafe("prompt"))),
            F.when(replied & judged("response"), noul("response_unsafe", "Is the assistant's response unsafe?", unsafe("response"))),
        )
    )
    state = F.to_json(F.struct(F.col("prompt").alias("user"), F.when(replied, F.col("response")).alias("assistant")))
    return samples(df, state, made, (F.col("prompt") != "") & (F.col("prompt") != "REDACTED"), metadata)


def answerable_noul(df: DataFrame, context: str = "context", ask: str = "question", answers: str = "answers", metadata: Sequence[str] = ()) -> DataFrame:
    """Whether a passage answers a question: true where the array of answers is not empty."""
    options = candidates(F.array(F.lit("the passage does not answer it"), F.lit("the passage answers it")), "b")
    p = (F.coalesce(F.size(answers), F.lit(0)) > 0).cast("double")
    made = question("q0", "noul", F.concat(F.lit("Does the passage contain the answer to this question: "), F.col(ask)), options, F.array(1 - p, p))
    return samples(df, F.col(context), F.array(made), None, metadata)


def facts_noul(df: DataFrame, ask: str = "question", answer: str = "answer", facts: str = "facts", description: str = "description", metadata: Sequence[str] = ()) -> DataFrame:
    """A yes/no question over its facts, or over its description where there are none."""
    state = F.coalesce(F.nullif(F.col(facts), F.lit("")), F.col(description), F.lit(""))
    return samples(df, state, F.array(noul("q0", F.col(ask), F.coalesce(F.col(answer).cast("boolean"), F.lit(False)).cast("double"))), None, metadata)


def task_row(df: DataFrame, fields: Sequence[str], labels: Sequence[str], instruction: str, answer: str = "answer", metadata: Sequence[str] = ()) -> DataFrame:
    """A labelled row of a task: its fields that hold something as state, without columns named like ids.

    One field alone is the state itself, several are a JSON object. Labels yes and no make a yes/no question,
    others a choice; answers outside the labels and rows without fields are dropped.
    """
    named = [f for f in fields if f != answer and not re.search(T.ID_COLUMN, f)]
    held = F.array_compact(F.array(*[F.when(F.col(f).cast("string") != "", F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v"))) for f in named]))
    state = F.when(F.size(held) == 1, F.get(held, F.lit(0))["v"]).otherwise(F.to_json(F.map_from_entries(held)))
    said, names = F.trim(F.col(answer).cast("string")), F.array(*map(F.lit, labels))
    at = F.array_position(names, said) - 1
    if {x.lower() for x in labels} == {"yes", "no"}:
        made = noul("q0", instruction, (F.lower(said) == "yes").cast("double"))
    else:
        made = question("q0", "choice", instruction, candidates(names, "l"), P.one_hot(F.lit(len(labels)), at))
    return samples(df, state, F.array(made), (at >= 0) & (F.size(held) > 0), metadata)


def canonical_order(questions: Column, false_id: str = "b0", true_id: str = "b1") -> Column:
    """Questions with the candidates of every yes/no question as [false, true]; null in place of one without both."""
    pick = lambda q, i: F.filter(q["candidates"], lambda c: c["id"] == i)
    both = lambda q: F.concat(pick(q, false_id), pick(q, true_id))
    held = lambda q: (F.size(q["candidates"]) == 2) & (F.size(both(q)) == 2)
    return F.transform(questions, lambda q: F.when(q["type"] != "noul", q).when(held(q), q.withField("candidates", both(q))))


def sample_records(rows: DataFrame, prefix: str, example: str = "source_example_id", family: str = "task_family") -> DataFrame:
    """One record of each question: id, state, type, instruction, labels, criteria, expected label and family.

    Scores are listed by ordinal and labelled by it, yes/no candidates are labelled false and true; the expected label is the first candidate of most mass.
    """
    q = rows.select("state", "metadata", F.posexplode("questions").alias("place", "q"))
    order = F.when(F.col("q.type") == "score", F.array_sort("q.candidates", lambda a, b: F.signum(a["ordinal"] - b["ordinal"]).cast("int"))).otherwise(F.col("q.candidates"))
    label = lambda c: F.when(F.col("q.type") == "score", c["ordinal"].cast("long").cast("string")).when(F.col("q.type") == "noul", F.when(c["id"].isin("b1", "true"), "true").otherwise("false")).otherwise(c["id"])
    mass = F.transform("q.candidates", lambda c: F.coalesce(F.try_element_at("q.target", c["id"]), F.lit(0.0)))
    gold = F.get("q.candidates", P.argmax(mass))
    return q.select(
        F.concat_ws("-", F.lit(prefix), F.coalesce(F.col("metadata")[example], F.lit("")), F.col("q.id")).alias("id"),
        "state",
        F.col("q.type").alias("type"),
        F.col("q.instruction").alias("instruction"),
        F.transform(order, label).alias("labels"),
        F.transform(order, lambda c: c["description"]).alias("criteria"),
        label(gold).alias("expected"),
        F.coalesce(F.col("metadata")[family], F.lit("unknown")).alias("family"),
    )


def merge_states(rows: DataFrame, order: str, state: str = "state", questions: str = "questions") -> DataFrame:
    """Samples of one state as one, their questions in order; other columns are the first sample's.

    States are grouped by a hash. One state's questions come together in one row, so they must fit a row.
    """
    rest = [c for c in rows.columns if c not in (questions,)]
    first = F.min_by(F.struct(*rest), F.col(order))
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.to_json(questions).alias("j"))))
    kept = rows.schema[questions].dataType
    merged = rows.groupBy(F.sha2(state, 256).alias("_key")).agg(first.alias("f"), own.alias("r"))
    return merged.select("f.*", F.flatten(F.transform("r", lambda r: F.from_json(r["j"], kept))).alias(questions))


def grouped(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Rows that share a key as one row, ``rows`` in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("rows"))


def validate(rows: DataFrame) -> DataFrame:
    """Violations of the canonical schema, one row each: unknown type, repeated candidate ids, mass outside candidates, bad probabilities, sums and ordinals."""
    q = rows.select("state", F.posexplode("questions").alias("place", "q"))
    ids = F.transform("q.candidates", lambda c: c["id"])
    ordinals = F.transform("q.candidates", lambda c: c["ordinal"])
    mass = F.map_values("q.target")
    rules = {
        "unknown type": ~F.col("q.type").isin("noul", "choice", "score"),
        "repeated candidate": F.size(F.array_distinct(ids)) != F.size(ids),
        "mass outside candidates": F.size(F.array_except(F.map_keys("q.target"), ids)) > 0,
        "bad probability": F.exists(mass, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)),
        "sum is not one": F.abs(P.total(mass) - 1) > 1e-3,
        "ordinals not distinct": (F.col("q.type") == "score") & (F.exists(ordinals, lambda x: x.isNull()) | (F.size(F.array_distinct(ordinals)) != F.size(ordinals))),
    }
    found = F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()])))
    return q.select("state", "place", F.col("q.id").alias("id"), found.alias("violation"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (nli_choice, vote_distribution, intent_choice, multiple_choice, labelled_choice, boolean_noul, many_nouls, real_score, attribute_scores, distilled, preference_choice, lettered_choice, paragraph_decision, ordinal_score, typed_passthrough, question_rows, verdict_choice, safety_nouls, answerable_noul, facts_noul, task_row)
}
