"""Detectors over Python syntax trees: eight for security, five for performance, and the shape of a file.

A small visitor per file runs in tasks; files are rows, and findings are exploded.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that the detectors look for.
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "CREATE")
DOM = ("innerHTML", "outerHTML", "document.write", "eval")
FILES = ("open", "read", "write", "readFile", "writeFile")
COMMANDS = ("exec", "system", "popen", "subprocess", "shell_exec")
SECRETS = ("password", "passwd", "pwd", "secret", "key", "token", "api_key", "apikey", "auth", "credential", "private_key")
UNSAFE = ("pickle.loads", "yaml.load", "eval", "exec")
WEAK = ("MD5", "SHA1", "DES", "RC4")
QUERY_CALLS = ("query", "find", "select", "get")
OPENING = ("open", "connect", "allocate", "new", "malloc")
CLOSING = ("close", "disconnect", "free", "delete")
BLOCKING = ("readFileSync", "writeFileSync", "sleep", "time.sleep")
ALLOCATING = ("new", "malloc", "allocate")
LOOPS = (ast.For, ast.While, ast.AsyncFor)


def _has(text: str, words) -> bool:
    return any(w in text for w in words)


def _name(node) -> str:
    """The dotted name of what is called or assigned."""
    if isinstance(node, ast.Call):
        return _name(node.func)
    if isinstance(node, ast.Attribute):
        return f"{_name(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


def _calls(node, deep: bool = True) -> list[ast.Call]:
    """Calls anywhere below a node, or only those that its body's statements make themselves."""
    if deep:
        return [x for x in ast.walk(node) if isinstance(x, ast.Call)]
    values = [getattr(x, "value", None) for x in node.body]
    return [v for v in values if isinstance(v, ast.Call)]


def _text(node) -> str:
    return " ".join(str(x.value) for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str)).upper()


def detect(code: str | None) -> list[tuple[str, str, int]]:
    """(kind, detector, line) of every finding, in order; text that isn't Python gives one of kind ``parse``."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return [("parse", "parse_error", 0)]
    out = []
    security, performance = (lambda d, n: out.append(("security", d, n.lineno))), (lambda d, n: out.append(("performance", d, n.lineno)))
    inner = {id(x) for n in ast.walk(tree) if isinstance(n, ast.BinOp) for x in (n.left, n.right)}
    for node in ast.walk(tree):
        if isinstance(node, (ast.BinOp, ast.JoinedStr)) and id(node) not in inner:
            joined = isinstance(node, ast.JoinedStr) or (isinstance(node.op, (ast.Add, ast.Mod)) and any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in ast.walk(node)))
            if joined and _has(_text(node), SQL_WORDS):
                security("sql_injection", node)
        if isinstance(node, ast.Assign):
            names = [_name(t) for t in node.targets]
            if any(_has(n, DOM) for n in names):
                security("xss", node)
            if any(_has(n.lower(), SECRETS) for n in names) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                security("hardcoded_secrets", node)
        if isinstance(node, ast.Call):
            name = _name(node)
            if _has(name, FILES) and any(isinstance(a, ast.Name) and "user" in a.id.lower() for a in node.args):
                security("path_traversal", node)
            for detector, words, said in (("command_injection", COMMANDS, name), ("unsafe_deserialization", UNSAFE, name), ("weak_crypto", WEAK, name.upper())):
                if _has(said, words):
                    security(detector, node)
            if _has(name, BLOCKING):
                performance("blocking_io", node)
        if isinstance(node, ast.If) and _has(ast.unparse(node.test), ("exists", "isfile")) and any(_has(_name(c), ("open", "create", "write")) for c in _calls(node, False)):
            security("race_condition", node)
        if isinstance(node, LOOPS):
            if any(_has(_name(c), QUERY_CALLS) for c in _calls(node, False)):
                performance("n_plus_one", node)
            if any(isinstance(x, LOOPS) for x in ast.walk(node) if x is not node):
                performance("inefficient_loop", node)
            for x in node.body:
                if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and _has(_name(x.value), ALLOCATING):
                    performance("excessive_allocation", x)
                if isinstance(x, ast.AugAssign) and isinstance(x.op, ast.Add):
                    performance("sum_in_loop", x)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and not any(_has(_name(c), CLOSING) for c in _calls(node)):
            for c in _calls(node):
                if _has(_name(c), OPENING):
                    performance("memory_leak", c)
        if isinstance(node, ast.ExceptHandler) and node.type is None:
            out.append(("practice", "bare_except", node.lineno))
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def _each(codes: pd.Series, f) -> pd.Series:
    """``f`` of every text; equal texts of a batch are parsed once."""
    places, texts = pd.factorize(codes, use_na_sentinel=False)
    found = [f(None if pd.isna(t) else t) for t in texts]
    return pd.Series([found[i] for i in places], dtype=object)


def findings(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, detector and line of every finding."""

    @F.pandas_udf("array<struct<kind:string,detector:string,line:int>>")
    def found(codes: pd.Series) -> pd.Series:
        return _each(codes, lambda c: [{"kind": a, "detector": b, "line": n} for a, b, n in detect(c)])

    return files.select(key, found(F.col(text)).alias("f")).select(key, F.inline("f"))


def shape(code: str | None) -> dict:
    """Lines of code and of comment, complexity (branches, and boolean operands beyond the first) and imported modules."""
    lines = [x.strip() for x in (code or "").split("\n")]
    held = {"loc": sum(bool(x) and not x.startswith("#") for x in lines), "comments": sum(x.startswith("#") for x in lines), "complexity": 1, "imports": []}
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return held
    for node in ast.walk(tree):
        if isinstance(node, (ast.If, ast.ExceptHandler, ast.IfExp, *LOOPS)):
            held["complexity"] += 1
        elif isinstance(node, ast.BoolOp):
            held["complexity"] += len(node.values) - 1
        elif isinstance(node, ast.Import):
            held["imports"] += [x.name for x in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            held["imports"].append(node.module)
    held["imports"] = sorted(set(held["imports"]))
    return held


def shapes(files: DataFrame, key: str, text: str) -> DataFrame:
    @F.pandas_udf("struct<loc:long,comments:long,complexity:long,imports:array<string>>")
    def of(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_each(codes, shape).tolist(), columns=["loc", "comments", "complexity", "imports"])

    return files.select(key, of(F.col(text)).alias("s")).select(key, "s.*")
