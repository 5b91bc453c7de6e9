"""Rules on the bodies of functions and loops in brace languages.

A text is scanned once: comments and the contents of strings are blanked, and a stack of braces gives nested bodies as
intervals, each a function, a loop or another block by the header before its brace. A rule then looks within an interval: a
place counts as inside a loop if going outward a loop is met before the function that holds it, so the code of a function that
a loop merely defines isn't. A body that is never closed reaches to the end, a brace too many closes nothing.

Files are rows and are scanned in their tasks; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.operators.batches import found_rows

_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
#: What is skipped by language: comments, strings and characters.
SKIPPED = {
    "go": rf"{_COMMENTS}|{_QUOTED}|`[^`]*`?|'(?:\\.|[^'\\\n])+'",
    "java": rf'{_COMMENTS}|"""(?:\\.|.)*?"""|{_QUOTED}|' + r"'(?:\\.|[^'\\\n])+'",
    "rust": rf'{_COMMENTS}|r(#+)".*?"\1|{_QUOTED}|' + r"'(?:\\[^']+|[^'\\\n])'",
    "typescript": rf"{_COMMENTS}|{_QUOTED}|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?",
}
_LOOP = re.compile(r"\b(?:for|while|loop|do)\b")
FUNCTIONS = {
    "go": re.compile(r"\bfunc\b"),
    "java": re.compile(r"\)\s*(?:throws\s+[\w.,\s]+)?$|->\s*$"),
    "rust": re.compile(r"\bfn\b|\|[^|]*\|\s*(?:->[^|]*)?$"),
    "typescript": re.compile(r"\bfunction\b|=>\s*$|^\s*(?:(?:public|private|protected|static|async|get|set)\s+)*[\w$]+\s*\([^()]*\)\s*(?::[^=]*)?$"),
}
_BRANCH = re.compile(r"\b(?:if|else|switch|catch|try|match|select|synchronized|with|finally|unsafe)\b")


@dataclass(slots=True)
class Body:
    kind: str
    first: int
    last: int
    parent: int


_SKIPPED = {language: re.compile(pattern, re.S) for language, pattern in SKIPPED.items()}
_KEPT = re.compile(r"[^\n]")
_BRACE = re.compile(r"[{}]")


def _blank(m: re.Match) -> str:
    """As long as the match; newlines and quotes at its ends stay, so that a rule can tell a string from none."""
    said = m[0]
    plain = _KEPT.sub(" ", said) if "\n" in said else " " * len(said)
    if said[-1] in "\"'`":
        plain = plain[:-1] + said[-1]
    return said[0] + plain[1:] if said[0] in "\"'`" else plain


def blanked(code: str, language: str) -> str:
    """The text with comments and strings blanked, of the same length."""
    return _SKIPPED[language].sub(_blank, code)


def _header(said: str) -> str:
    """What stands before a brace: its line, or the last one with text. Lines within parentheses are parts of one."""
    above, newline, own = said.rpartition("\n")
    if "(" not in above and ")" not in above:
        return own.strip() or above.strip().rpartition("\n")[2].strip()
    start, before, depth = 0, "", 0
    for m in re.finditer(r"[()\n]", said):
        if m[0] == "\n":
            if depth == 0:
                before = said[start : m.start()].strip() or before
                start = m.end()
        else:
            depth = max(depth + (1 if m[0] == "(" else -1), 0)
    return said[start:].strip() or before


def scan(code: str, language: str) -> tuple[str, list[Body]]:
    """The text with comments and strings blanked (of the same length), and its bodies in the order of their braces."""
    plain = blanked(code, language)
    return plain, bodies_of(plain, language)


def bodies_of(plain: str, language: str) -> list[Body]:
    bodies: list[Body] = []
    stack: list[int] = []
    start = 0
    for m in _BRACE.finditer(plain):
        at = m.start()
        if m[0] == "{":
            header = _header(plain[start:at])
            kind = _kind(header, language) if len(header) <= KNOWN_HEADER else _kind.__wrapped__(header, language)
            bodies.append(Body(kind, at + 1, len(plain), stack[-1] if stack else -1))
            stack.append(len(bodies) - 1)
        elif stack:
            bodies[stack.pop()].last = at
        start = at + 1
    return bodies


#: Characters of the headers whose kinds are remembered.
KNOWN_HEADER = 200


@lru_cache(maxsize=8192)
def _kind(header: str, language: str) -> str:
    if FUNCTIONS[language].search(header) and not (_BRANCH.search(header) or _LOOP.search(header)) or language == "go" and re.search(r"\bfunc\s*\([^()]*\)[^{]*$", header):
        return "function"
    return "loop" if _LOOP.search(header) else "block"


#: (rule, language, scope, what is looked for, what must be missing in the function, severity). Scopes: ``loop``, ``nested`` (a loop
#: within a loop), ``function``.
RULES = (
    ("defer-in-loop", "go", "loop", r"\bdefer\b", None, "high"),
    ("query-in-loop", "go", "loop", r"\.(?:Query|QueryRow|Exec)(?:Context)?\(", None, "high"),
    ("concat-in-loop", "go", "loop", r"\+=\s*\"", None, "medium"),
    ("open-without-close", "go", "function", r"\bos\.(?:Open|Create)\(", r"\.Close\(", "high"),
    ("lock-without-unlock", "go", "function", r"\.Lock\(\)", r"\.Unlock\(\)", "high"),
    ("query-in-loop", "java", "loop", r"\.(?:executeQuery|createQuery|findById|getOne)\(", None, "high"),
    ("concat-in-loop", "java", "loop", r"\+=\s*\"", None, "medium"),
    ("lock-without-unlock", "java", "function", r"\.lock\(\)", r"\.unlock\(\)", "high"),
    ("work-in-nested-loop", "java", "nested", r"\.(?:contains|indexOf|remove)\(", None, "medium"),
    ("clone-in-loop", "rust", "loop", r"\.clone\(\)", None, "medium"),
    ("allocation-in-loop", "rust", "loop", r"\b(?:Vec|String)::new\(\)|\.to_string\(\)|\bformat!\(", None, "medium"),
    ("lock-in-loop", "rust", "loop", r"\.lock\(\)", None, "medium"),
    ("await-in-loop", "typescript", "loop", r"\bawait\b", None, "medium"),
    ("listener-without-cleanup", "typescript", "function", r"\baddEventListener\(", r"\bremoveEventListener\(", "medium"),
    ("timer-without-cleanup", "typescript", "function", r"\bsetInterval\(", r"\bclearInterval\(", "medium"),
    ("work-in-nested-loop", "typescript", "nested", r"\.(?:find|filter|indexOf|includes)\(", None, "medium"),
)


def findings(code: str, language: str, rules=RULES) -> list[tuple[str, str, int, int, int]]:
    """(rule, severity, line, first and last line of the body in question) in the order of lines and rules."""
    if language not in SKIPPED:
        return []
    plain = blanked(code, language)
    matched = [(rule, m.start()) for rule in rules if rule[1] == language for m in re.finditer(rule[3], plain)]
    if not matched:
        return []
    bodies = bodies_of(plain, language)
    breaks = [m.start() for m in re.finditer("\n", plain)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    firsts = [b.first for b in bodies]

    def outward(at: int):
        i = bisect_right(firsts, at) - 1
        while i >= 0:
            if bodies[i].first <= at < bodies[i].last:
                yield bodies[i]
            i = bodies[i].parent if bodies[i].last > at else i - 1

    out = []
    for (rule, _, scope, _, missing, severity), at in matched:
        chain = []
        for body in outward(at):
            chain.append(body)
            if body.kind == "function":
                break
        if scope == "function":
            body = chain[-1] if chain and chain[-1].kind == "function" else None
            hit = body if body and not re.search(missing, plain[body.first : body.last]) else None
        else:
            loops = [b for b in chain if b.kind == "loop"]
            hit = loops[0] if len(loops) > (scope == "nested") else None
        if hit:
            out.append((rule, severity, line(at), line(hit.first), line(min(hit.last, len(plain)))))
    return sorted(out, key=lambda f: (f[2], f[0]))


FINDING = "rule_id string, severity string, line int, first int, last int"


def body_findings(files: DataFrame, key: str, text: str, language: Column, rules=RULES) -> DataFrame:
    """key, rule_id, severity, line, and first and last line of the body of every finding; null or other languages have none."""
    return found_rows(files, [key], [F.col(text), language], FINDING, lambda code, lang: findings(code or "", lang or "", rules))
