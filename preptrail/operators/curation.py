"""Generated answers: gate, best attempt, preference pairs, prompts, leaks and failures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preptrail.functions import code
from preptrail.functions.clean import strip_space

# --- Fixed values -----------------------------------------------------------
SOLVED_SCORE = 0.8
FAILURE_SCORE = 0.4
JUDGE_ERROR_SCORE = 1.0
LEAK_LINE_CHARS = 15
SYSTEM_TURN = -1
NO_MESSAGE = "Start of conversation"
FEW_SHOT_PREAMBLE = "\n\nHere are similar solved problems from our knowledge base for reference:\n"
REFERENCE_HEADER = "--- Reference Solution %d ---\n%s"
PROBLEM_CONTEXT = "\n--- PROBLEM ---\n"
GROUND_TRUTH = "\n--- GROUND TRUTH SOLUTION (INTERNAL ONLY) ---\n"
FAILURE_FORMAT = "Score: %s\nReason: %s\nAssistant Response: %s\n"
# ---------------------------------------------------------------------------


def scored(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Answers with reward, compiled and error."""
    checked = answers.withColumn("_check", code.checked_code(F.col(column)))
    return checked.select(*answers.columns, "_check.reward", "_check.compiled", "_check.error")


def gated_score(compiled: Column, judge_score: Column) -> Column:
    """0 for code that does not compile, else the judge's score, or 1 when the judge failed."""
    return F.when(~compiled, F.lit(0.0)).otherwise(F.coalesce(judge_score, F.lit(JUDGE_ERROR_SCORE)))


def to_judge(checked: DataFrame) -> DataFrame:
    """Only answers that compile are worth a judge's time."""
    return checked.filter("compiled")


def compile_rate(checked: DataFrame) -> DataFrame:
    passed, total = F.count_if("compiled"), F.count("*")
    share = F.when(total > 0, passed / total * 100).otherwise(F.lit(0.0))
    return checked.agg(
        total.alias("total"), passed.alias("passed"), (total - passed).alias("rejected"), share.alias("pass_percent")
    )


def best_attempt(attempts: DataFrame, at_most: int | None = None) -> DataFrame:
    """Solution used per problem: the first good attempt, else the best one, earliest on a tie.

    ``attempts`` is (problem_id, attempt, solution, score). All attempts count, or the first ``at_most``
    of each problem. One aggregate with a few fixed-size states per problem, however many attempts
    were logged.
    """
    tried = attempts if at_most is None else attempts.filter(F.col("attempt") <= at_most)
    good = F.col("score") >= SOLVED_SCORE
    scored_above_floor = F.col("score") > -1
    best = tried.groupBy("problem_id").agg(
        F.min_by(F.struct("attempt", "score", "solution"), F.when(good, F.col("attempt"))).alias("first_good"),
        F.max_by(
            F.struct("attempt", "score", "solution"),
            F.when(scored_above_floor, F.struct("score", -F.col("attempt"))),
        ).alias("highest"),
    )
    used = F.coalesce("first_good", "highest")
    return best.select(
        "problem_id",
        used["attempt"].alias("attempt"),
        F.coalesce(used["score"], F.lit(-1.0)).alias("score"),
        F.coalesce(used["solution"], F.lit("")).alias("solution"),
        F.col("first_good").isNotNull().alias("reached_target"),
    )


def pick_prompts(problems: DataFrame, order: list[Column], n: int | None = None) -> DataFrame:
    """Descriptions to generate candidates for: the first ``n`` in an explicit order, or all."""
    described = problems.filter(F.col("description") != "").orderBy(*order)
    return described if n is None else described.limit(n)


def preference_pairs(answers: DataFrame) -> DataFrame:
    """Chosen and rejected answer per prompt, from all its candidates.

    ``answers`` is (prompt_id, candidate, prompt, answer). Chosen is the shortest code that compiles.
    Rejected is the first answer that does not compile; if all do, the longest one, if it is longer
    than the chosen one. Ties go to the earlier candidate; otherwise there is no pair. One aggregate
    with fixed-size states per prompt, however many candidates it has.
    """
    asked = answers.filter(F.col("prompt") != "")
    checked = asked.withColumn("_check", code.checked_code(F.col("answer"))).select("*", "_check.compiled", "_check.size")
    row = F.struct("size", "answer")
    best = checked.groupBy("prompt_id").agg(
        F.max("prompt").alias("prompt"),
        F.min_by(row, F.when(F.col("compiled"), F.struct("size", "candidate"))).alias("shortest"),
        F.max_by(row, F.when(F.col("compiled"), F.struct(F.col("size"), -F.col("candidate")))).alias("longest"),
        F.min_by(row, F.when(~F.col("compiled"), F.col("candidate"))).alias("failed"),
    )
    shortest, longest, failed = F.col("shortest"), F.col("longest"), F.col("failed")
    paired = best.filter(shortest.isNotNull() & (failed.isNotNull() | (longest["size"] > shortest["size"])))
    return paired.select(
        "prompt_id",
        "prompt",
        shortest["answer"].alias("chosen"),
        F.when(failed.isNotNull(), failed["answer"]).otherwise(longest["answer"]).alias("rejected"),
    )


def few_shot_context(found: DataFrame) -> DataFrame:
    """Text that lists the solutions found per query (query_id, rank, document), in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("document", F.lit("")).alias("document"))))
    examples = F.transform(
        listed, lambda d, i: F.format_string(REFERENCE_HEADER, i.cast("int") + 1, strip_space(d["document"]))
    )
    return found.groupBy("query_id").agg(
        F.concat(F.lit(FEW_SHOT_PREAMBLE), F.array_join(examples, "\n\n")).alias("context")
    )


def system_message(system: Column, problem: Column, solution: Column) -> Column:
    def section(header: str, text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit(header), text, F.lit("\n"))).otherwise(F.lit(""))

    return F.concat(system, F.coalesce(section(PROBLEM_CONTEXT, problem), F.lit("")), F.coalesce(section(GROUND_TRUTH, solution), F.lit("")))


def prompt_messages(turns: DataFrame, systems: DataFrame) -> DataFrame:
    """Messages to send per conversation, one row each: the system message, then the turns.

    ``turns`` is (conv_id, turn, role, text), ``systems`` is (conv_id, system). The system message
    gets turn -1. Rows stay rows, so a conversation may be of any length.
    """
    first = systems.select("conv_id", F.lit(SYSTEM_TURN).alias("turn"), F.lit("system").alias("role"), F.col("system").alias("content"))
    known = turns.join(systems.select("conv_id"), "conv_id", "left_semi")
    return first.unionByName(known.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", F.col("text").alias("content")))


def last_message(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Text of the last turn per conversation, or a fixed text for one without turns."""
    last = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return conversations.select("conv_id").join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("text", F.lit(NO_MESSAGE)).alias("last_message")
    )


def failure_log(replies: DataFrame) -> DataFrame:
    """Text of every low-scored reply that had a solution to be judged against."""
    low = (F.col("score") < FAILURE_SCORE) & (F.col("reply") != "") & (F.col("solution") != "")
    text = F.format_string(FAILURE_FORMAT, F.col("score"), F.col("reason"), F.col("reply"))
    return replies.filter(low).withColumn("failure", text)


def leaks_solution(reply: Column, solution: Column) -> Column:
    """Whether a solution line longer than a few characters appears in the reply, within the row."""
    lines = F.transform(F.split(solution, "\n"), strip_space)
    return F.exists(lines, lambda line: (F.length(line) > LEAK_LINE_CHARS) & F.contains(reply, line))


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"), F.count("*").alias("n"))


def distinct_descriptions(problems: DataFrame, order: Column) -> DataFrame:
    """One row per distinct description, the first in order, so that each is solved once."""
    rest = [c for c in problems.columns if c != "description"]
    first = problems.filter(F.col("description") != "").groupBy("description").agg(
        F.min_by(F.struct(*rest), order).alias("_row"), F.count("*").alias("n_uses")
    )
    return first.select("_row.*", "description", "n_uses")
