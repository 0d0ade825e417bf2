"""Generated answers: extraction, compile reward, gate, pairs, attempts, prompts and leaks."""

from pyspark.sql import functions as F

from checks import domain as D
from checks.base import query, rounded, sql_r6, with_ctes
from checks.search import _found_solutions, vectors_sql
from preptrail.functions import code
from preptrail.operators import curation
from preptrail.plans import reports
from preptrail.session import scratch_path
from preptrail.sources import readers, writers

# --- Answers: every document as a comment above code that parses or does not.
# The case number says which, so SQL knows the outcome without parsing Python.
COMMENT = "concat('# ', replace(replace(text, '```', ''), chr(10), concat(chr(10), '# ')))"
GOOD_CODE = "concat(comment, chr(10), 'def solve_', key, '(n):', chr(10), '    return n + ', key)"
SHORT_CODE = "concat('def solve_', key, '(n):', chr(10), '    return n')"
BAD_CODE = "concat(comment, chr(10), 'def solve_', key, '(:', chr(10), '    pass')"
FENCE = "concat(chr(96), chr(96), chr(96))"
ANSWER = f"""CASE kind WHEN 0 THEN concat('Here is the solution:', chr(10), {FENCE}, 'python', chr(10), {GOOD_CODE}, chr(10), {FENCE}, chr(10), 'Done.')
  WHEN 1 THEN concat({FENCE}, chr(10), {BAD_CODE}, chr(10), {FENCE}) WHEN 2 THEN {SHORT_CODE}
  WHEN 3 THEN concat({FENCE}, 'py', chr(10), {SHORT_CODE}, chr(10), {FENCE}, ' and ', {FENCE}, 'x', {FENCE})
  WHEN 4 THEN concat(' ', chr(10), ' ') WHEN 5 THEN concat({FENCE}, 'python', chr(10), {GOOD_CODE}) ELSE 'this is not code at all, just text' END"""
CODE = f"""CASE kind WHEN 0 THEN {GOOD_CODE} WHEN 1 THEN {BAD_CODE} WHEN 2 THEN {SHORT_CODE} WHEN 3 THEN {SHORT_CODE} WHEN 4 THEN '' WHEN 5 THEN {GOOD_CODE}
  ELSE 'this is not code at all, just text' END"""
ANSWERS = f"""answers AS (
  SELECT doc_id, candidate, kind, key, text, {ANSWER} AS answer, {CODE} AS code, kind IN (0, 2, 3, 5) AS compiled
  FROM (SELECT doc_id, text, candidate, CAST((doc_id * (candidate + 1) + n_chars * candidate) % 7 AS INT) AS kind, concat(doc_id, '_', candidate) AS key, {COMMENT} AS comment
    FROM documents, (SELECT unnest([1, 2, 3]) AS candidate)))"""


def answers(spark, sf):
    docs = D.spread_table(spark, sf, "documents").withColumn("candidate", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    docs = docs.withColumn("kind", F.expr("CAST((doc_id * (candidate + 1) + n_chars * candidate) % 7 AS INT)"))
    docs = docs.withColumn("key", F.concat_ws("_", "doc_id", "candidate")).withColumn("comment", F.expr(COMMENT))
    return docs.select("doc_id", "candidate", "kind", "key", "text", F.expr(ANSWER).alias("answer"))


@query(with_ctes(ANSWERS) + " SELECT doc_id, candidate, md5(code) AS code_hash, length(code) AS size FROM answers")
def code_extract(spark, sf):
    extracted = answers(spark, sf).withColumn("code", code.extract_code(F.col("answer")))
    return extracted.select("doc_id", "candidate", F.md5("code").alias("code_hash"), F.length("code").cast("bigint").alias("size"))


ERROR = r"""CASE WHEN kind = 4 THEN 'Empty code output.' WHEN kind = 1 THEN 'SyntaxError at line ' || (length(code) - length(replace(code, chr(10), ''))) || ': invalid syntax'
  WHEN kind = 6 THEN 'SyntaxError at line 1: invalid syntax' END"""


@query(with_ctes(ANSWERS) + f" SELECT doc_id, candidate, CASE WHEN compiled THEN 1 ELSE -1 END AS reward, compiled, {ERROR} AS error FROM answers")
def compile_reward(spark, sf):
    return curation.scored(answers(spark, sf)).select("doc_id", "candidate", "reward", "compiled", "error")


RATE = f"count(*) AS total, count(*) FILTER (compiled) AS passed, count(*) FILTER (NOT compiled) AS rejected, {sql_r6('100.0::DOUBLE * count(*) FILTER (compiled) / count(*)')} AS pass_percent"


@query(with_ctes(ANSWERS) + f" SELECT {RATE} FROM answers")
def compile_rate(spark, sf):
    return rounded(curation.compile_rate(curation.scored(answers(spark, sf))), "pass_percent")


JUDGE = "CASE WHEN n_chars % 13 = 0 THEN NULL ELSE (n_chars * candidate % 100) / 100.0::DOUBLE END"
GATED = f"""gated AS (
  SELECT a.doc_id, a.candidate, a.compiled, a.answer, CASE WHEN NOT compiled THEN 0 ELSE coalesce({JUDGE}, 1) END AS score
  FROM answers a JOIN documents USING (doc_id))"""


def _judged(spark, sf):
    sizes = D.table(spark, sf, "documents").select("doc_id", "n_chars")
    judge = F.expr("CASE WHEN n_chars % 13 = 0 THEN NULL ELSE (n_chars * candidate % 100) / 100.0D END")
    checked = curation.scored(answers(spark, sf)).join(sizes, "doc_id").withColumn("judge", judge)
    return checked.withColumn("score", curation.gated_score(F.col("compiled"), F.col("judge")))


@query(with_ctes(ANSWERS, GATED) + f" SELECT doc_id, candidate, compiled, {sql_r6('score')} AS score FROM gated")
def two_stage_gate(spark, sf):
    return rounded(_judged(spark, sf).select("doc_id", "candidate", "compiled", "score"), "score")


@query(with_ctes(ANSWERS, GATED) + " SELECT doc_id, candidate FROM gated WHERE compiled")
def judge_queue(spark, sf):
    return curation.to_judge(curation.scored(answers(spark, sf))).select("doc_id", "candidate")


@query(
    with_ctes(ANSWERS, GATED)
    + f""", tried AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN score >= 0.8 THEN candidate ELSE 99 END,
      CASE WHEN score >= 0.8 THEN 0 ELSE -score END, candidate) AS nth, bool_or(score >= 0.8) OVER (PARTITION BY doc_id) AS reached_target FROM gated)
    SELECT doc_id AS problem_id, candidate AS attempt, {sql_r6('score')} AS score, md5(answer) AS solution_hash, reached_target FROM tried WHERE nth = 1"""
)
def best_attempt(spark, sf):
    attempts = _judged(spark, sf).select(
        F.col("doc_id").alias("problem_id"), F.col("candidate").alias("attempt"), F.col("answer").alias("solution"), "score"
    )
    best = rounded(curation.best_attempt(attempts), "score")
    return best.withColumn("solution_hash", F.md5("solution")).drop("solution")


@query("SELECT doc_id, n_chars, md5(text) AS description_hash FROM documents WHERE text <> '' ORDER BY n_chars DESC, doc_id LIMIT 10")
def preference_prompts(spark, sf):
    docs = D.table(spark, sf, "documents").withColumnRenamed("text", "description")
    picked = curation.pick_prompts(docs, [F.col("n_chars").desc(), F.col("doc_id")], 10)
    return picked.select("doc_id", "n_chars", F.md5("description").alias("description_hash"))


PAIRS = """pairs AS (
  SELECT doc_id AS prompt_id, text AS prompt, shortest AS chosen, CASE WHEN n_failed > 0 THEN failed ELSE longest END AS rejected
  FROM (SELECT doc_id, text, first(answer ORDER BY length(code), candidate) FILTER (compiled) AS shortest, min(length(code)) FILTER (compiled) AS least,
      first(answer ORDER BY length(code) DESC, candidate) FILTER (compiled) AS longest, max(length(code)) FILTER (compiled) AS most,
      first(answer ORDER BY candidate) FILTER (NOT compiled) AS failed, count(*) FILTER (NOT compiled) AS n_failed, count(*) FILTER (compiled) AS n_compiled
    FROM answers WHERE text <> '' GROUP BY 1, 2)
  WHERE n_compiled > 0 AND (n_failed > 0 OR most > least))"""


def _pairs(spark, sf):
    asked = answers(spark, sf).select(F.col("doc_id").alias("prompt_id"), "candidate", F.col("text").alias("prompt"), "answer")
    return curation.preference_pairs(asked)


@query(with_ctes(ANSWERS, PAIRS) + " SELECT prompt_id, md5(prompt) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected FROM pairs")
def preference_pairs(spark, sf):
    return _pairs(spark, sf).select("prompt_id", *[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")])


@query(with_ctes(ANSWERS, PAIRS) + " SELECT md5(prompt) AS prompt, md5(chosen) AS chosen, md5(rejected) AS rejected FROM pairs")
def preference_pair_sink(spark, sf):
    path = scratch_path(spark, "pairs")
    writers.write_preference_pairs(_pairs(spark, sf), path)
    return readers.read_preference_pairs(spark, path).select(*[F.md5(c).alias(c) for c in ("prompt", "chosen", "rejected")])


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    with_ctes(vectors_sql("sv", "documents", "doc_id", "text"), vectors_sql("qv", "benchmark", "item_id", "text"))
    + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, 'sol_' || doc_id) AS rank FROM (
      SELECT item_id, doc_id, round(sum(s.w * q.w), 9) AS score FROM sv s JOIN qv q USING (d) GROUP BY 1, 2)) WHERE rank <= 2)
    SELECT item_id AS query_id, concat(chr(10), chr(10), 'Here are similar solved problems from our knowledge base for reference:', chr(10),
      string_agg(concat('--- Reference Solution ', rank, ' ---', chr(10), {STRIP.format('text')}), concat(chr(10), chr(10)) ORDER BY rank)) AS context
    FROM top JOIN documents USING (doc_id) GROUP BY 1"""
)
def few_shot(spark, sf):
    texts = D.table(spark, sf, "documents").select(F.concat(F.lit("sol_"), F.col("doc_id")).alias("id"), F.col("text").alias("document"))
    return curation.few_shot_context(_found_solutions(spark, sf).join(texts, "id"))


# --- Conversations about documents ------------------------------------------
SYSTEM = """systems AS (
  SELECT conv_id, concat('You are a tutor.', CASE WHEN coalesce(text, '') = '' THEN '' ELSE concat(chr(10), '--- PROBLEM ---', chr(10), text, chr(10)) END,
    CASE WHEN conv_id % 3 = 0 THEN concat(chr(10), '--- GROUND TRUTH SOLUTION (INTERNAL ONLY) ---', chr(10), 'return ', conv_id, chr(10)) ELSE '' END) AS system
  FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN documents ON doc_id = conv_id)"""


@query(
    with_ctes(SYSTEM)
    + """ SELECT conv_id, -1::BIGINT AS turn, 'system' AS role, system AS content FROM systems
      UNION ALL SELECT conv_id, turn, role, text FROM conversations"""
)
def prompt_assembly(spark, sf):
    turns = D.table(spark, sf, "conversations")
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), "text")
    asked = turns.select("conv_id").distinct().join(docs, "conv_id", "left")
    solution = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("return "), F.col("conv_id")))
    system = curation.system_message(F.lit("You are a tutor."), F.col("text"), solution)
    return curation.prompt_messages(turns, asked.select("conv_id", system.alias("system")))


@query(
    """SELECT d.doc_id AS conv_id, coalesce(arg_max(text, turn), 'Start of conversation') AS last_message
    FROM (SELECT doc_id FROM documents) d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY 1"""
)
def last_turn(spark, sf):
    asked = D.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"))
    return curation.last_message(asked, D.table(spark, sf, "conversations"))


# --- Replies: assistant turns, some quoting a line of the solution ----------
LINE = "split_part(d.text, chr(10), 1 + CAST(c.turn AS INT))"
REPLIES = f"""replies AS (
  SELECT c.conv_id, c.turn, CASE WHEN quality = 0 THEN concat(c.text, ' ', {LINE}) WHEN c.turn = 3 THEN '' ELSE c.text END AS reply,
    CASE WHEN c.conv_id % 5 = 0 THEN '' ELSE coalesce(d.text, '') END AS solution, (c.conv_id * 7 + c.turn) % 11 / 10.0::DOUBLE AS score, 'graded' AS reason
  FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN labels l ON l.doc_id = c.conv_id WHERE role = 'assistant')"""


def replies(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("solved"))
    graded = D.table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"), "quality")
    said = D.table(spark, sf, "conversations").filter("role = 'assistant'").join(docs, "conv_id", "left").join(graded, "conv_id", "left")
    quoted = F.expr("CASE WHEN quality = 0 THEN concat(text, ' ', coalesce(split_part(solved, chr(10), 1 + CAST(turn AS INT)), '')) WHEN turn = 3 THEN '' ELSE text END")
    return said.select(
        "conv_id", "turn", quoted.alias("reply"),
        F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.coalesce("solved", F.lit(""))).alias("solution"),
        F.expr("(conv_id * 7 + turn) % 11 / 10.0D").alias("score"), F.lit("graded").alias("reason"),
    )


LEAKED = f"""leaks AS (
  SELECT conv_id, turn, score, coalesce(bool_or(length(line) > 15 AND contains(reply, line)), false) AS leaked
  FROM (SELECT conv_id, turn, reply, score, {STRIP.format("unnest(string_split(solution, chr(10)))")} AS line FROM replies) GROUP BY 1, 2, 3)"""


@query(with_ctes(REPLIES, LEAKED) + " SELECT conv_id, turn, leaked FROM leaks")
def leak_check(spark, sf):
    return replies(spark, sf).select("conv_id", "turn", curation.leaks_solution(F.col("reply"), F.col("solution")).alias("leaked"))


@query(
    with_ctes(REPLIES, LEAKED)
    + f""" SELECT count(*) AS total, count(*) FILTER (leaked) AS leaked, {sql_r6('avg(score)')} AS mean_score,
      {sql_r6('100.0::DOUBLE * count(*) FILTER (leaked) / count(*)')} AS leak_percent, avg(score) >= 0.6 AS passed FROM leaks"""
)
def report_leaks(spark, sf):
    return rounded(reports.leak_report(replies(spark, sf)), "mean_score", "leak_percent")


@query(
    with_ctes(REPLIES)
    + """ SELECT conv_id, turn, concat('Score: ', score::VARCHAR, chr(10), 'Reason: graded', chr(10), 'Assistant Response: ', reply, chr(10)) AS failure
    FROM replies WHERE score < 0.4 AND reply <> '' AND solution <> ''"""
)
def failure_log(spark, sf):
    return curation.failure_log(replies(spark, sf)).select("conv_id", "turn", "failure")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS description_hash, count(*) AS n_uses FROM documents WHERE text <> '' GROUP BY text")
def solution_cache(spark, sf):
    docs = D.table(spark, sf, "documents").select("doc_id", F.col("text").alias("description"))
    return curation.distinct_descriptions(docs, F.col("doc_id")).select("doc_id", F.md5("description").alias("description_hash"), "n_uses")


@query(f"SELECT {sql_r6('avg(quality)')} AS mean_score, count(*) AS n FROM labels")
def mean_score(spark, sf):
    return rounded(curation.mean_score(D.table(spark, sf, "labels").select(F.col("quality").alias("score"))), "mean_score")


@query(
    with_ctes(ANSWERS)
    + " SELECT count(*) AS total, count(*) FILTER (CASE WHEN kind = 4 THEN true ELSE starts_with(code, CASE WHEN kind IN (2, 3) THEN 'def solve_' ELSE '# ' END) END) AS passed FROM answers"
)
def report_extraction(spark, sf):
    expected = F.when(F.col("kind") == 4, "").when(F.col("kind").isin(2, 3), "def solve_").otherwise("# ")
    return reports.extraction_report(answers(spark, sf).withColumn("expected", expected))
