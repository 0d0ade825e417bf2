"""Columns that pull code out of generated answers and check that it parses."""

import ast
import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preptrail.functions.clean import strip_space

# --- Fixed values -----------------------------------------------------------
FENCED_BLOCK = r"(?U)```(?:python|py)?\s*([\s\S]*?)\s*```"
OPENING_FENCE = r"(?iU)^```(?:python|py)?\s*"
FENCE_MARKS = ["```python", "```py", "```"]
EMPTY_ANSWER = "Empty code output."
EMPTY_CODE = "Empty code."
# ---------------------------------------------------------------------------


def extract_code(answer: Column) -> Column:
    """Code of the first fenced block, or the answer without stray fences."""
    answer = F.coalesce(answer, F.lit(""))
    fenced = strip_space(F.regexp_extract(answer, FENCED_BLOCK, 1))
    unfenced = answer
    for mark in FENCE_MARKS:
        unfenced = F.replace(unfenced, F.lit(mark))
    code = F.when(answer.rlike(FENCED_BLOCK), fenced).otherwise(strip_space(unfenced))
    code = F.regexp_replace(code, OPENING_FENCE, "")
    return strip_space(F.regexp_replace(code, "```$", ""))


def _parse_error(code: str) -> str | None:
    if not code:
        return EMPTY_CODE
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
    except SyntaxError as err:
        return f"SyntaxError at line {err.lineno}: {err.msg}"
    except (ValueError, RecursionError, MemoryError) as err:
        # Input too deep or not decodable is not valid code either.
        return type(err).__name__
    return None


_CHECK = T.StructType(
    [T.StructField("compiled", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("size", T.IntegerType())]
)


def _check(code: pa.Array) -> pa.Array:
    errors = [_parse_error(c.as_py()) for c in code]  # one text at a time becomes a Python string
    columns = [pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string()), pc.utf8_length(code).cast(pa.int32())]
    return pa.StructArray.from_arrays(columns, names=_CHECK.names)


_check_syntax = F.arrow_udf(_check, _CHECK)


def checked_code(answer: Column) -> Column:
    """Struct (reward, compiled, error, size): +1 for code that parses, -1 otherwise, and the code's length.

    The code is pulled out of the answer once, on its way to the check.
    """
    blank = strip_space(F.coalesce(answer, F.lit(""))) == ""
    check = _check_syntax(F.when(blank, F.lit("")).otherwise(extract_code(answer)))
    return F.struct(
        F.when(check["compiled"], 1).otherwise(-1).alias("reward"),
        check["compiled"].alias("compiled"),
        F.when(blank, F.lit(EMPTY_ANSWER)).otherwise(check["error"]).alias("error"),
        check["size"].alias("size"),
    )


def compile_reward(answer: Column) -> Column:
    """Struct (reward, compiled, error) of ``checked_code``."""
    return F.struct(*(checked_code(answer)[name].alias(name) for name in ("reward", "compiled", "error")))
