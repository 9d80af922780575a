"""Facts only a Python parser can tell. The engine's one Python function.

Code is parsed, never run. Spark sends the parser Arrow batches of the .py
texts alone; everything else about a file stays in the JVM.
"""

from __future__ import annotations

import ast
import sys
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpaudit import constants as K
from corpaudit.functions import decode_text, hashed_id
from corpaudit.operators.files import code_candidates
from corpaudit.operators.findings import finding_rows
from corpaudit.schemas import PYTHON_METRICS

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_IMPORTS = (ast.Import, ast.ImportFrom)


def _measure(text: str | None) -> tuple | None:
    """(functions, classes, imports, max_depth, syntax_error, error_line, modules)."""
    if text is None:
        return None
    try:
        tree = ast.parse(text)
    except SyntaxError as failure:
        return 0, 0, 0, 0, failure.msg or "syntax error", failure.lineno, []
    except Exception as failure:  # too deep, too large: a fact about the file
        return 0, 0, 0, 0, f"cannot be parsed: {type(failure).__name__}", None, []
    functions = classes = imports = deepest = 0
    modules: set[str] = set()
    level, depth = [tree], 0
    while level:  # level by level, so depth never meets the recursion limit
        deepest, below = depth, []
        for node in level:
            if isinstance(node, _FUNCTIONS):
                functions += 1
            elif isinstance(node, ast.ClassDef):
                classes += 1
            elif isinstance(node, _IMPORTS):
                imports += 1
                if isinstance(node, ast.Import):
                    modules.update(a.name.partition(".")[0] for a in node.names)
                elif not node.level and node.module:
                    modules.add(node.module.partition(".")[0])
            for name in node._fields:
                value = getattr(node, name, None)
                if isinstance(value, ast.AST):
                    below.append(value)
                elif isinstance(value, list):
                    below.extend(v for v in value if isinstance(v, ast.AST))
        level, depth = below, depth + 1
    return functions, classes, imports, deepest, None, None, sorted(modules)


_METRICS = pa.struct([
    ("functions", pa.int32()), ("classes", pa.int32()), ("imports", pa.int32()), ("max_depth", pa.int32()),
    ("syntax_error", pa.string()), ("error_line", pa.int32()), ("modules", pa.list_(pa.string())),
])


@F.arrow_udf(PYTHON_METRICS)
def _python_metrics(texts: pa.Array) -> pa.Array:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = [_measure(t) or (None,) * len(_METRICS) for t in texts.to_pylist()]
    columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_METRICS)]
    return pa.StructArray.from_arrays(columns, fields=list(_METRICS))


# Marked so that no optimizer rule parses a file twice for a filter on the result.
_python_metrics = _python_metrics.asNondeterministic()


def metrics_of(text: Column) -> Column:
    """Struct of parser facts; null text gives null facts."""
    return _python_metrics(text)


def python_metrics(files: DataFrame, *, max_bytes: int | None = None) -> DataFrame:
    """Parser facts per .py file, one parse each."""
    python = code_candidates(files).filter(F.col("extension") == ".py")
    text = decode_text(F.col("content"), max_bytes)
    parsed = python.select("repo_id", "path", text.alias("text")).withColumn("facts", metrics_of(F.col("text")))
    return parsed.select("repo_id", "path", "facts.*")


def python_imports(metrics: DataFrame) -> DataFrame:
    """(repo_id, path, module): absolute imports, each module once per file."""
    return metrics.select("repo_id", "path", F.explode("modules").alias("module"))


def syntax_findings(metrics: DataFrame) -> DataFrame:
    broken = metrics.filter(F.col("syntax_error").isNotNull())
    return finding_rows(
        broken,
        id=hashed_id("CODE-SYNTAX-", F.col("path")),
        severity="MEDIUM",
        category="Code Health",
        title="Python file does not parse",
        path=F.col("path"),
        line=F.col("error_line"),
        explanation=F.concat(F.lit("The parser stopped: "), F.col("syntax_error")),
        recommendation="Repair the syntax; until then the file cannot be examined.",
    )


def nesting_findings(metrics: DataFrame) -> DataFrame:
    deep = metrics.filter(F.col("max_depth") > K.MAX_AST_DEPTH)
    return finding_rows(
        deep,
        id=hashed_id("CODE-NESTING-", F.col("path")),
        severity="LOW",
        category="Code Health",
        title="Very deep nesting",
        path=F.col("path"),
        explanation=F.concat(
            F.lit("The syntax tree is "), F.col("max_depth").cast("string"), F.lit(" levels deep.")
        ),
        recommendation="Move inner logic into functions of its own.",
    )
