"""Patch checks: routing by extension, Python syntax, dangerous substrings."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Substrings that must not appear in a Python patch.
DANGERS = [
    ("eval(", "Use of eval()"),
    ("exec(", "Use of exec()"),
    ("__import__(", "Dynamic import"),
    ("subprocess.call(shell=True", "Shell injection risk"),
    ("os.system(", "Use of os.system()"),
    ("pickle.loads", "Unsafe deserialization"),
    ("yaml.load(", "Unsafe YAML loading"),
    ("input(", "Use of input() in Python 2 style"),
]
PYTHON_OK = "Python syntax valid, no obvious new issues"


def danger_list(patch: Column) -> Column:
    """Descriptions of the dangerous substrings found, in table order."""
    return F.array_compact(F.array(*[F.when(patch.contains(s), F.lit(d)) for s, d in DANGERS]))


def file_suffix(path: Column) -> Column:
    """Extension without its dot; none for dot-files and names without one."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"[^.].*?\.([^.]+)$|$", 1)


@F.pandas_udf(T.StringType())
def python_syntax_error(code: pd.Series) -> pd.Series:
    """Null when the text parses as Python, else the parser's message."""

    def check(text: str | None) -> str | None:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text or "")
            return None
        except SyntaxError as e:
            return f"Python syntax error: {e}"
        except (ValueError, RecursionError, MemoryError) as e:
            return f"Validation error: {e}"

    return code.map(check, na_action=None)


def native_verdict(path: Column, patch: Column, validators: dict[str, Column]) -> Column:
    """(is_valid, message) where no parser is needed: plug-in validators, unknown extensions; null for Python."""
    ext = file_suffix(path)
    expr = F
    for name, verdict in validators.items():
        expr = expr.when(ext == name, verdict)
    expr = expr.when(ext == "py", F.lit(None).cast("struct<is_valid: boolean, message: string>"))
    return expr.otherwise(F.struct(
        F.lit(True).alias("is_valid"),
        F.concat(F.lit("No validator for ."), ext, F.lit(", assuming valid")).alias("message")))


def python_verdict(syntax_error: Column, patch: Column) -> Column:
    """(is_valid, message) from a syntax result: syntax first, then the danger list."""
    issues = danger_list(patch)
    return (F.when(syntax_error.isNotNull(), F.struct(F.lit(False).alias("is_valid"), syntax_error.alias("message")))
            .when(F.size(issues) > 0, F.struct(
                F.lit(False).alias("is_valid"),
                F.concat(F.lit("New issues introduced: "), F.array_join(issues, ", ")).alias("message")))
            .otherwise(F.struct(F.lit(True).alias("is_valid"), F.lit(PYTHON_OK).alias("message"))))
