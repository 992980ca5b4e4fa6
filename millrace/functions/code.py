"""Facts that need a real Python parser. Text is parsed, never run.

The functions are nested so that they travel to the workers by value; executors
need no copy of this package. Their type hints must be real types, so this module does
not postpone annotations.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BRANCH_NODES = ("If", "For", "While", "Try", "With")


def compiles(code: Column) -> Column:
    """Whether the text compiles as a module. Null text counts as valid and costs nothing."""
    @F.pandas_udf("boolean")
    def check(texts: pd.Series) -> pd.Series:
        import warnings

        def one(text):
            if text is None:
                return True
            try:
                compile(text, "<string>", "exec")
                return True
            except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
                return False

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return texts.map(one).astype("bool")

    return check(code)


def parse_state(code: Column) -> Column:
    """struct<ok, error> of the grammar check alone."""
    @F.pandas_udf("ok boolean, error string")
    def check(texts: pd.Series) -> pd.DataFrame:
        import ast
        import warnings

        def one(text):
            try:
                ast.parse(text or "")
                return True, None
            except SyntaxError as e:
                return False, f"Syntax Error: {e}"
            except (ValueError, RecursionError, MemoryError, OverflowError) as e:
                return False, f"{type(e).__name__}: {e}"

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return pd.DataFrame([one(t) for t in texts], columns=["ok", "error"])

    return check(code)


def syntax_facts(code: Column) -> Column:
    """struct<nodes map, docstrings> of the syntax tree; null when the text does not parse."""
    @F.pandas_udf("nodes map<string,int>, docstrings int")
    def facts(texts: pd.Series) -> pd.DataFrame:
        import ast
        import warnings
        from collections import Counter

        owners = (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)

        def one(text):
            try:
                tree = ast.parse(text or "")
            except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
                return None, None
            nodes = list(ast.walk(tree))
            documented = sum(1 for n in nodes if isinstance(n, owners) and ast.get_docstring(n) is not None)
            return dict(Counter(type(n).__name__ for n in nodes)), documented

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return pd.DataFrame([one(t) for t in texts], columns=["nodes", "docstrings"])

    return facts(code)


def branching(nodes: Column, kinds: Sequence[str] = BRANCH_NODES) -> Column:
    """Number of branching nodes, from the `nodes` map of `syntax_facts`."""
    total = F.lit(0)
    for kind in kinds:
        total = total + F.coalesce(nodes[kind], F.lit(0))
    return F.when(nodes.isNotNull(), total)
