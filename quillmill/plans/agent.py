"""The question loop over a table of states: a round lets all open questions choose, and runs each tool as one table to table step.

What the loop calls are functions from tables to tables: a search is a join, a model call a function over batches of rows. Nothing of a
question passes through the driver but the number of open ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

SQL_TRIES, WEB_TRIES, ROUNDS, PARTS = 6, 2, 20, 10
#: Tools after which a question is over whatever they say.
LAST = ["self_knowledge"]
SUMMARIES = ["document_summarizer", "global_summarizer"]
STATE = ["question_id", "question", "action", "answer", "sql_tries", "web_tries", "notes", "done"]
Table = Callable[[DataFrame], DataFrame]


def route() -> Column:
    """The node that comes after a choice (G2): a web search twice at most and then what is known, a statement six times at most and then the answer."""
    action = F.col("action")
    return (
        F.when(action == "web_search", F.when(F.col("web_tries") < WEB_TRIES, "web_search").otherwise("self_knowledge"))
        .when(action == "sql_query", F.when(F.col("sql_tries") < SQL_TRIES, "sql_query").otherwise("answer"))
        .when(action == "failure", "self_knowledge")
        .when(action.isin(*SUMMARIES, "self_knowledge"), action)
        .otherwise("answer")
    )


def ask(questions: DataFrame, retrieve: Table, generate: Table, tools: dict[str, Table], rounds: int = ROUNDS) -> DataFrame:
    """The states (STATE) of questions (question_id, question) when all are answered, or after ``rounds`` choices.

    retrieve: questions to (question_id, note), several rows a question or none. generate: states to (question_id, action, answer); a question without a row,
    or whose action is null, has answered with what it has. tools: name to a function from the states that chose it to (question_id, note); a
    tool that gives a question no row gives it an empty note, and so does one that is not there, behind which the question is over. Notes are in the order in
    which they came, those of one step by their text. A summary goes on as its tool's own words say: a note that begins with FAILURE leads to self_knowledge."""
    notes = lambda found: found.groupBy("question_id").agg(F.array_sort(F.collect_list("note")).alias("_notes"))
    first = questions.join(notes(retrieve(questions)), "question_id", "left")
    none = F.array().cast("array<string>")
    states = settled(
        first.select("question_id", "question", F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("sql_tries"), F.lit(0).alias("web_tries"), F.coalesce("_notes", none).alias("notes"), F.lit(False).alias("done")),
        "states",
    )
    over: list[DataFrame] = []
    for _ in range(rounds):
        if states.isEmpty():
            break
        chosen = generate(states).select("question_id", F.col("action").alias("_action"), F.col("answer").alias("_answer"))
        routed = states.join(chosen, "question_id", "left").withColumn("action", F.coalesce("_action", F.lit("answer"))).withColumn("answer", F.coalesce("_answer", "answer")).withColumn("node", route())
        routed = settled(routed.drop("_action", "_answer"), "routed")
        known = routed.node.isin(*tools)
        over.append(routed.where(~known).withColumn("done", F.lit(True)).select(STATE))
        after = None
        for name, tool in tools.items():
            here = routed.where(F.col("node") == name).drop("node")
            said = here.join(notes(tool(here)), "question_id", "left").withColumn("notes", F.concat("notes", F.coalesce("_notes", F.array(F.lit("")))))
            if name in SUMMARIES and "self_knowledge" in tools:
                said = said.withColumn("action", F.when(F.element_at("notes", -1).startswith("FAILURE"), "failure").otherwise(F.col("action")))
            moved = said.withColumn("sql_tries", F.col("sql_tries") + int(name == "sql_query")).withColumn("web_tries", F.col("web_tries") + int(name == "web_search")).withColumn("done", F.lit(name in LAST)).select(STATE)
            after = moved if after is None else after.unionByName(moved)
        if after is None:
            states = states.limit(0)
            break
        after = settled(after, "states")
        failed = after.where("action = 'failure' AND NOT done")
        if "self_knowledge" in tools:
            known = failed.join(notes(tools["self_knowledge"](failed)), "question_id", "left")
            over.append(known.withColumn("notes", F.concat("notes", F.coalesce("_notes", F.array(F.lit(""))))).withColumn("done", F.lit(True)).select(STATE))
        over.append(after.where("done"))
        states = settled(after.where("NOT done AND action <> 'failure'"), "states")
    over.append(states.select(STATE))
    out = over[0]
    for one in over[1:]:
        out = out.unionByName(one)
    return out


def ask_in_parts(questions: DataFrame, decompose: Table, answer: Table, combine: Table, parts: int = PARTS) -> DataFrame:
    """(question_id, answer) of questions (question_id, question) by way of up to ``parts`` sub-questions each.

    decompose: questions to (question_id, place, question). All sub-questions are answered as one table: answer gets (question_id, question), with ids of its own, and gives
    (question_id, answer). A question of one part, or of none, is answered alone. combine: (question_id, question, answers in order) to (question_id, answer)."""
    split = decompose(questions).where(F.col("place") < parts).select("question_id", F.col("place").cast("long").alias("place"), F.col("question").alias("part"))
    every = questions.join(split, "question_id", "left").withColumn("part", F.coalesce("part", "question")).withColumn("place", F.coalesce("place", F.lit(0)))
    own = F.concat(F.col("question_id").cast("string"), F.lit("#"), F.col("place").cast("string"))
    every = settled(every.withColumn("_part_id", own), "parts")
    answers = answer(every.select(F.col("_part_id").alias("question_id"), F.col("part").alias("question"))).select(F.col("question_id").alias("_part_id"), "answer")
    found = every.join(answers, "_part_id", "left").groupBy("question_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("place", "answer"))).alias("a"))
    found = settled(found.select("question_id", "question", F.transform("a", lambda x: x["answer"]).alias("answers")), "answers")
    alone = found.where(F.size("answers") == 1).select("question_id", F.get("answers", F.lit(0)).alias("answer"))
    return alone.unionByName(combine(found.where(F.size("answers") > 1)).select("question_id", "answer"))
