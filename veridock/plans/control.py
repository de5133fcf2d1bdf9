"""Decisions of a question's course as columns: state of the session, refinement rounds, refocusing, progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veridock.functions.labels import abbreviation_list, clean_list
from veridock.functions.text import facts_phrase, strip
from veridock.operators.selection import merge_dedup
from veridock.plans.evaluation import next_step

ROUNDS, QUESTIONS, REFOCUS_SIZE = 1, 3, 8
FREE_REPLY = "respuesta_medico"


def pinned_specialty(state: Column, context: Column, configured: Column, known: list[str], default: str) -> Column:
    """First non-empty choice among the session, the run and the configuration, else the default; unknown ones are null."""
    chosen = F.coalesce(F.nullif(state, F.lit("")), F.nullif(context, F.lit("")), F.nullif(configured, F.lit("")), F.lit(default))
    return F.when(chosen.isin(known), chosen)


def asks_for_patient(flagged: Column, facts: Column) -> Column:
    """Whether to stop and ask if this is another patient: only if flagged, and only if something is remembered."""
    return F.coalesce(flagged, F.lit(False)) & (F.coalesce(F.size(facts), F.lit(0)) > 0)


def facts_after(facts: Column, turn_facts: Column, new_patient: Column) -> Column:
    """Another patient leaves the facts of this turn alone."""
    return F.when(new_patient, turn_facts).otherwise(facts)


def merged(old: Column, new: Column) -> Column:
    """Union of two maps; the new one's values win, the old one's order stays."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def still_pending(asked: Column, answered: Column) -> Column:
    """Questions without an answer in the map, in order."""
    return F.filter(asked, lambda q: ~F.array_contains(F.map_keys(answered), q))


def capped_questions(questions: Column, n: int = QUESTIONS) -> Column:
    return F.slice(clean_list(questions), 1, max(1, n))


def offers_refinement(pending: Column, rounds: Column, most: int = ROUNDS) -> Column:
    return (F.size(pending) > 0) & (rounds < most)


def answers_by_question(pending: Column, reply: Column) -> Column:
    """A single text answers a lone question; for several questions it can't be told which, so it has a key of its own. Blank: nothing."""
    text = strip(F.coalesce(reply, F.lit("")))
    nothing = F.create_map().cast("map<string,string>")
    return F.when(text == "", nothing).when(F.size(pending) == 1, F.create_map(F.get(pending, F.lit(0)), text)).otherwise(F.create_map(F.lit(FREE_REPLY), text))


def fold_answers(state: DataFrame) -> DataFrame:
    """Closes a round of state(facts, pending, asked, rounds, answers map): facts, rounds, pending, asked and refining after it."""
    given = F.map_filter("answers", lambda k, v: (k != "") & (strip(v) != ""))
    return state.withColumns({
        "facts": merged(F.col("facts"), given),
        "rounds": F.col("rounds") + 1,
        "asked": F.concat("asked", "pending"),
        "pending": still_pending(F.col("pending"), given),
        "refining": F.size(given) > 0,
    })


def reply_text(questions: Column, answers: Column) -> Column:
    """A lone question's reply as plain text; null for several (see reply_map)."""
    return F.when(F.size(questions) == 1, F.coalesce(F.get(F.transform(F.map_values(answers), lambda v: strip(F.coalesce(v, F.lit("")))), F.lit(0)), F.lit("")))


def reply_map(answers: Column) -> Column:
    """Non-blank replies, trimmed; null rather than an empty map."""
    told = F.map_filter(F.transform_values(answers, lambda _, v: strip(F.coalesce(v, F.lit("")))), lambda _, v: v != "")
    return F.when(F.size(told) > 0, told)


def enriched(query: Column, phrase: Column) -> Column:
    """The query with the patient's known facts after it."""
    return F.when(F.coalesce(phrase, F.lit("")) == "", query).otherwise(F.concat(query, F.lit("\n"), phrase))


def retrieves_again(rounds: Column, phrase: Column) -> Column:
    return (F.coalesce(rounds, F.lit(0)) > 0) & (F.coalesce(phrase, F.lit("")) != "")


def refocus_query(query: Column, claims: Column) -> Column:
    """The query with all unsupported claims after it; null if there are none, as there is nothing to look for then."""
    focus = clean_list(claims)
    return F.when(F.size(focus) > 0, F.concat(query, F.lit("\n"), F.array_join(focus, " ")))


def refocused(previous: DataFrame, found: DataFrame, run: str, key: str, pos: str, scorer: Column, size: int = REFOCUS_SIZE) -> DataFrame:
    """New evidence before what was at hand, without repetitions, ranked anew and cut to as many rows per run as there were (`size` if there were none)."""
    both = merge_dedup([found, previous.select(*found.columns)], key, pos, [run]).withColumn("score", scorer)
    room = previous.groupBy(run).agg(F.count("*").alias("_room"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(F.col("score").desc(), "place")))
    return ranked.join(room, run, "left").where(F.col("rank") <= F.coalesce("_room", F.lit(size))).drop("_room")


def rephrased(question: Column, model: Column) -> Column:
    """struct(query, in_domain, facts, modifiers, other_patient) of a model's reply of that form; where it failed (null), the question as it is, in the domain."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(F.nullif(strip(model["query"]), F.lit("")), question).alias("query"), F.coalesce(model["in_domain"], F.lit(True)).alias("in_domain"),
        F.coalesce(model["facts"], none).alias("facts"), F.coalesce(model["modifiers"], none).alias("modifiers"), F.coalesce(model["other_patient"], F.lit(False)).alias("other_patient"),
    )


def domain_route(in_domain: Column, label: Column) -> Column:
    """struct(step, message): retrieval, or the message that the question lies outside the specialty."""
    inside = F.coalesce(in_domain, F.lit(True))
    return F.struct(F.when(inside, "retrieve").otherwise("out_of_domain").alias("step"), F.when(~inside, F.concat(F.lit("Esta consulta queda fuera del ámbito de "), label, F.lit("."))).alias("message"))


def feedback(validation: Column) -> Column:
    """What a second attempt is told of the first one's verdict struct(is_valid, reason, unsupported_claims); null if that was valid or there was none."""
    claims = clean_list(validation["unsupported_claims"])
    text = F.concat(F.lit("Corrige la respuesta anterior: "), F.coalesce(validation["reason"], F.lit("")), F.when(F.size(claims) > 0, F.concat(F.lit("\n"), bullets(claims))).otherwise(""))
    return F.when(validation.isNotNull() & ~F.coalesce(validation["is_valid"], F.lit(False)), text)


def validated(sufficient: Column, judge: Column) -> Column:
    """struct(is_valid, error, reason, unsupported_claims): an insufficient answer claims nothing and is valid; a judge that failed (null) is an error, never a pass."""
    none, claims = F.array().cast("array<string>"), clean_list(judge["unsupported_claims"])
    given = judge.isNotNull() & judge["is_valid"].isNotNull()
    spared = ~F.coalesce(sufficient, F.lit(False))
    return F.struct(
        (spared | F.coalesce(judge["is_valid"], F.lit(False))).alias("is_valid"), (~spared & ~given).alias("error"),
        F.when(spared, "").otherwise(F.coalesce(judge["reason"], F.lit(""))).alias("reason"), F.when(spared, none).otherwise(claims).alias("unsupported_claims"),
    )


def final_message(outcome: Column, answer: Column, fallback: str, broken: str) -> Column:
    """What is shown in the end: the answer, the message that it couldn't be validated, or that of a technical error."""
    return F.when(outcome.isin("answered", "insufficient"), answer).when(outcome == "technical_error", broken).otherwise(fallback)


def guarded(result: Column, error: Column, step: str) -> Column:
    """struct(value, failed_step, technical_detail) of a step whose failure came as struct(type, message); a pause is control flow and no failure."""
    bad = error.isNotNull() & ~F.coalesce(error["type"].isin("Interrupt", "GraphInterrupt"), F.lit(False))
    return F.struct(F.when(~bad, result).alias("value"), F.when(bad, step).alias("failed_step"), F.when(bad, F.concat_ws(": ", error["type"], error["message"])).alias("technical_detail"))


def hop_plan(question: Column, plan: Column, most: int = 3) -> Column:
    """Sub-queries of plan struct(multi_hop, queries); the question alone where it is single-hop, gives none, or the planner failed."""
    own = F.slice(clean_list(plan["queries"]), 1, most)
    return F.when(F.coalesce(plan["multi_hop"], F.lit(False)) & (F.size(own) > 0), own).otherwise(F.array(question))


def reflection(verdict: Column) -> Column:
    """The next sub-query of verdict struct(sufficient, next), or null to stop: enough is known, nothing more is asked, or the judge failed."""
    return F.when(~F.coalesce(verdict["sufficient"], F.lit(True)), F.nullif(strip(F.coalesce(verdict["next"], F.lit(""))), F.lit("")))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def user_prompt(question: Column, contexts: Column, facts: Column, concept_map: Column, open_questions: Column) -> Column:
    """The blocks of a generation prompt that are there, in order: numbered contexts array<struct(label, text)>, known facts, concept map, open questions, question."""
    told = F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["label"], F.lit("\n"), c["text"])), "\n\n")
    block = lambda title, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{title}:\n"), x))
    parts = (("CONTEXTO", told), ("DATOS DEL PACIENTE", facts_phrase(facts)), ("MAPA CONCEPTUAL (no citable)", concept_map), ("PREGUNTAS ABIERTAS", bullets(clean_list(open_questions))), ("PREGUNTA", question))
    return F.array_join(F.array_compact(F.array(*[block(n, x) for n, x in parts])), "\n\n")


def system_prompt(template: Column, profile: Column, abbreviations: Column, titles: Column) -> Column:
    """A template with {specialty}, {abbreviations} and {documents} filled from a specialty's profile and the manifest's titles."""
    y = F.replace(template, F.lit("{specialty}"), profile)
    return F.replace(F.replace(y, F.lit("{abbreviations}"), abbreviation_list(abbreviations)), F.lit("{documents}"), bullets(titles))


def fan_out(questions: DataFrame, plan: str, run: str) -> DataFrame:
    """One row per sub-query: (run, hop from 1, query), for branches that run side by side and meet again by run and hop."""
    return questions.select(run, F.posexplode(plan).alias("_i", "query")).select(run, (F.col("_i") + 1).alias("hop"), "query")


def counted(*counts: Column) -> Column:
    """Sum of counters that may be missing."""
    return sum((F.coalesce(c, F.lit(0)) for c in counts), F.lit(0))


#: Steps of a question's course by the kind of graph: what follows each step, or the choices that a column decides between.
COURSE = {
    "rephrase": ("retrieve", "out_of_domain"), "retrieve": ("generate",), "generate": ("validate",), "validate": ("evidence", "refocus", "fallback"),
    "refocus": ("generate",), "evidence": (), "fallback": (), "out_of_domain": (),
}


def course(outcomes: DataFrame, run: str, most: int = 2) -> DataFrame:
    """(run, steps): the steps that a question takes, from its in_domain flag and the verdicts array<struct(error, valid)> of its attempts."""
    verdict = F.transform("verdicts", lambda v, i: next_step(v["error"], v["valid"], i + 1, most))
    used = F.slice(verdict, 1, most)
    stop = F.coalesce(F.nullif(F.array_position(F.transform(used, lambda s: s != "refocus"), F.lit(True)), F.lit(0)), F.size(used))
    taken = F.flatten(F.transform(F.slice(used, F.lit(1), stop.cast("int")), lambda s: F.array(F.lit("generate"), F.lit("validate"), s)))
    steps = F.when(F.coalesce("in_domain", F.lit(True)), F.concat(F.array(F.lit("rephrase"), F.lit("retrieve")), taken)).otherwise(F.array(F.lit("rephrase"), F.lit("out_of_domain")))
    return outcomes.select(run, steps.alias("steps"))


def session_commands(turns: DataFrame) -> DataFrame:
    """turns(session_id, turn, text) with `command` (new, show, specialty, ask), the specialty that holds from then on, and the patient's number: a new one
    with each `/nuevo`, while `/especialidad x` keeps the patient."""
    word, rest = F.lower(F.substring_index(F.trim("text"), " ", 1)), F.trim(F.regexp_replace(F.trim("text"), r"^\S+\s*", ""))
    command = F.when(word == "/nuevo", "new").when(word == "/ver", "show").when((word == "/especialidad") & (rest != ""), "specialty").otherwise("ask")
    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.withColumn("command", command)
    return own.withColumns({"specialty": F.last(F.when(F.col("command") == "specialty", rest), ignorenulls=True).over(w), "patient": F.sum((F.col("command") == "new").cast("int")).over(w)})


def last_output(events: DataFrame, run: str, seq: str, output: str) -> DataFrame:
    """(run, output): the last non-empty output of each run."""
    return events.where(F.coalesce(output, F.lit("")) != "").groupBy(run).agg(F.max_by(output, seq).alias(output))


def progress_events(chunks: DataFrame) -> DataFrame:
    """(run, seq, node, event) of chunks(run, seq, channel, updates map<node, output>).

    Custom chunks are progress. A node's update is a step; if it has a value also a state, and if that is not empty an output; the node
    `__interrupt__` is a pause. Other channels tell nothing.
    """
    custom = chunks.where("channel = 'custom'").select("run", "seq", F.lit(None).cast("string").alias("node"), F.lit("progress").alias("event"))
    own = chunks.where("channel = 'updates'").select("run", "seq", F.explode("updates").alias("node", "value"))
    kinds = F.when(F.col("node") == "__interrupt__", F.array(F.lit("interrupt"))).otherwise(
        F.array_compact(F.array(F.lit("step"), F.when(F.col("value").isNotNull(), "state"), F.when(F.col("value") != "", "output")))
    )
    return own.select("run", "seq", "node", F.explode(kinds).alias("event")).unionAll(custom)


def false_rejections(records: DataFrame) -> DataFrame:
    """(false, rejected, rate) of records(outcome, rejected_answer, agrees); agrees is the judge's word, null where the judge failed."""
    own = records.where("outcome = 'not_validated' AND rejected_answer <> ''")
    return own.agg(F.count_if("agrees").alias("false"), F.count("*").alias("rejected")).withColumn("rate", F.col("false") / F.nullif("rejected", F.lit(0)))
