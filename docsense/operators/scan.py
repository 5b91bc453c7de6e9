"""Personal-data and code scans by rule tables, redaction and finding summaries."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Personal-data kinds with their patterns.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "phone": r"\+[0-9][0-9 ().-]{6,}[0-9]",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
}

#: Line rules: id, language, family, pattern, severity, weakness.
LINE_RULES = [
    ("script-tag", "html", "xss", r"(?i)<script", "high", "CWE-79"),
    ("inline-handler", "html", "xss", r"(?i)\son[a-z]+\s*=", "medium", "CWE-79"),
    ("javascript-url", "html", "xss", r"(?i)javascript:", "high", "CWE-79"),
    ("inner-html", "typescript", "xss", r"\.innerHTML\s*=", "high", "CWE-79"),
    ("any-type", "typescript", "types", r":\s*any\b", "low", ""),
    ("sql-concat", "go", "injection", r"(?i)(select|insert|update|delete)\s.*\"\s*\+", "high", "CWE-89"),
    ("command-exec", "go", "injection", r"exec\.Command\(", "critical", "CWE-78"),
    ("weak-hash", "java", "crypto", r"MessageDigest\.getInstance\(\"(MD5|SHA-?1)\"\)", "high", "CWE-327"),
    ("object-input", "java", "integrity", r"new ObjectInputStream\(", "critical", "CWE-502"),
    ("hard-coded-secret", "any", "secrets", r"(?i)(password|secret|token|api_key)\s*[=:]\s*[\"'][^\"']{8,}[\"']", "critical", "CWE-798"),
    ("unsafe-block", "rust", "memory", r"\bunsafe\s*\{", "high", "CWE-119"),
    ("unwrap-call", "rust", "errors", r"\.unwrap\(\)", "medium", ""),
    ("http-link", "html", "transport", r"(?i)href=\"http://", "low", "CWE-319"),
    ("document-write", "typescript", "xss", r"document\.write\(", "high", "CWE-79"),
    ("open-redirect", "typescript", "xss", r"window\.location(\.href)?\s*=[^=]", "medium", "CWE-601"),
    ("eval-call", "typescript", "injection", r"\beval\(", "critical", "CWE-94"),
    ("sql-template", "typescript", "injection", r"(?i)query\(`\s*(select|insert|update|delete)[^`]*\$\{", "critical", "CWE-89"),
    ("exec-template", "typescript", "injection", r"exec(Sync)?\(`", "critical", "CWE-78"),
    ("stored-token", "typescript", "auth", r"(?i)localStorage\.setItem\([^)]*(token|password)", "medium", "CWE-522"),
    ("console-secret", "typescript", "sensitive", r"(?i)console\.(log|info|debug)\([^)]*(password|token|secret)", "medium", "CWE-532"),
    ("as-any", "typescript", "types", r"\bas any\b", "low", ""),
    ("var-declaration", "typescript", "modern", r"^\s*var\s", "low", ""),
    ("whole-import", "typescript", "bundle", r"import \* as \w+ from ['\"](lodash|moment)", "medium", ""),
    ("then-chain", "typescript", "async", r"\.then\([^;]*\.then\(", "medium", ""),
    ("weak-hash-go", "go", "crypto", r"\b(md5|sha1)\.(New|Sum)", "high", "CWE-327"),
    ("ignored-error", "go", "errors", r"[,\s]_\s*:?=\s*[A-Za-z_.]+\(", "medium", ""),
    ("unbuffered-channel", "go", "channels", r"make\(chan [A-Za-z_.]+\)", "low", ""),
    ("unsized-map", "go", "maps", r"make\(map\[[^\]]+\][A-Za-z_.]+\)", "low", ""),
    ("underscore-name", "go", "naming", r"^func [A-Za-z]+_[A-Za-z_]+\(", "low", ""),
    ("statement-concat", "java", "injection", r"(executeQuery|executeUpdate|createQuery)\([^)]*\"\s*\+", "critical", "CWE-89"),
    ("runtime-exec", "java", "injection", r"getRuntime\(\)\.exec\(", "critical", "CWE-78"),
    ("any-origin", "java", "configuration", r"@CrossOrigin\([^)]*\*", "high", "CWE-942"),
    ("weak-password", "java", "auth", r"NoOpPasswordEncoder|password\.length\(\)\s*[<>]=?\s*[1-7]\b", "medium", "CWE-521"),
    ("logged-secret", "java", "logging", r"(?i)\blog(ger)?\.[a-z]+\([^;]*(password|token|secret)", "high", "CWE-532"),
    ("opened-url", "java", "ssrf", r"new URL\([a-z]", "high", "CWE-918"),
    ("static-collection", "java", "memory", r"\bstatic\s[^=;(]*(List|Map)<[^=;]*=\s*new\b", "high", ""),
    ("old-collection", "java", "collections", r"\bnew (Vector|Hashtable)\b", "low", ""),
    ("shared-date-format", "java", "threads", r"\bstatic\s[^=;(]*SimpleDateFormat\b", "high", ""),
    ("empty-catch", "java", "exceptions", r"catch\s*\([^)]*\)\s*\{\s*\}", "high", ""),
    ("broad-catch", "java", "exceptions", r"catch\s*\(\s*(Exception|Throwable)\b", "medium", ""),
    ("print-call", "java", "style", r"System\.out\.print", "low", ""),
    ("transmute", "rust", "unsafe", r"\btransmute\b", "critical", "CWE-843"),
    ("unchecked-index", "rust", "unsafe", r"\bget_unchecked", "high", "CWE-125"),
    ("static-mut", "rust", "concurrency", r"\bstatic mut\b", "high", "CWE-362"),
    ("panic-call", "rust", "errors", r"\bpanic!\(", "high", ""),
    ("collect-in-for", "rust", "iterators", r"\bfor\s.*\.collect(::<[^>]*>)?\(\)\s*\{", "low", ""),
    ("push-formatted", "rust", "strings", r"push_str\(&?(format!|[^)]*to_string\()", "medium", ""),
    ("sprintf-sql", "go", "injection", r"(?i)Sprintf\(\"(select|insert|update|delete)\b", "high", "CWE-89"),
    ("shell-exec", "go", "injection", r"exec\.Command\(\"(sh|bash)\"", "critical", "CWE-78"),
    ("slice-without-capacity", "go", "allocations", r"make\(\[\][A-Za-z0-9_.]+,\s*0\)", "medium", ""),
    ("empty-interface", "go", "interfaces", r"interface\{\}", "medium", ""),
    ("fresh-context", "go", "context", r"context\.(TODO|Background)\(\)", "medium", ""),
    ("open-mapping", "java", "access", r"@(Get|Post|Put|Delete)Mapping", "high", "CWE-862"),
    ("weak-cipher", "java", "crypto", r"Cipher\.getInstance\(\"(DES|RC4|Blowfish)", "high", "CWE-327"),
    ("query-concat", "java", "injection", r"create(Native)?Query\(\".*\"\s*\+", "critical", "CWE-89"),
    ("directory-concat", "java", "injection", r"(?i)\bsearch\(.*\"\s*\+", "high", "CWE-90"),
    ("old-dependency", "java", "dependencies", r"log4j:1\.|struts2-core:2\.[0-3]", "high", "CWE-1104"),
    ("xml-decoder", "java", "integrity", r"new XMLDecoder\(", "critical", "CWE-502"),
    ("yaml-load", "java", "integrity", r"new Yaml\(\)\.load\(", "critical", "CWE-502"),
    ("unclosed-stream", "java", "memory", r"new (FileInputStream|FileReader|BufferedReader)\(", "high", ""),
    ("raw-thread", "java", "threads", r"new Thread\(", "high", ""),
    ("string-equality", "java", "strings", r"==\s*\"", "low", ""),
    ("field-injection", "java", "spring", r"@Autowired\s+private", "medium", ""),
    ("throws-everything", "java", "exceptions", r"throws\s+Exception\b", "medium", ""),
    ("raw-pointer", "rust", "memory", r"\*(const|mut)\s+[A-Za-z_]+", "high", "CWE-824"),
    ("forgotten-memory", "rust", "memory", r"mem::(forget|uninitialized|zeroed)\(", "critical", "CWE-416"),
    ("expect-call", "rust", "errors", r"\.expect\(\"", "medium", ""),
    ("shared-cell", "rust", "ownership", r"Rc<RefCell<", "medium", ""),
    ("clone-call", "rust", "ownership", r"\.clone\(\)", "low", ""),
    ("weak-random", "rust", "crypto", r"rand::random|thread_rng\(", "high", "CWE-338"),
    ("raw-arguments", "rust", "input", r"env::args\(\)", "medium", ""),
    ("growing-vector", "rust", "allocations", r"Vec::new\(\)", "low", ""),
    ("collected-length", "rust", "iterators", r"collect::<Vec<_>>\(\)\.len\(\)", "low", ""),
    ("string-sum", "rust", "strings", r"\.to_string\(\)\s*\+", "medium", ""),
    ("blocking-sleep", "rust", "async", r"thread::sleep\(", "high", ""),
    ("unfinished", "rust", "style", r"\b(todo|unimplemented)!\(", "low", ""),
    ("lock-unwrap", "rust", "concurrency", r"\.lock\(\)\.unwrap\(\)", "high", "CWE-362"),
    ("dangerous-html", "typescript", "xss", r"dangerouslySetInnerHTML", "high", "CWE-79"),
    ("checked-off", "typescript", "types", r"@ts-(ignore|nocheck)", "medium", ""),
    ("signed-with-literal", "typescript", "auth", r"jwt\.sign\(.*['\"][^'\"]{4,}['\"]", "medium", "CWE-522"),
    ("readable-cookie", "typescript", "auth", r"httpOnly:\s*false", "low", ""),
    ("any-version", "typescript", "dependencies", r"\"[^\"]+\":\s*\"(\*|latest)\"", "low", ""),
    ("inline-handler-function", "typescript", "react", r"on[A-Z][A-Za-z]+=\{\(\)\s*=>", "low", ""),
    ("index-as-key", "typescript", "react", r"key=\{(i|index)\}", "low", ""),
    ("in-over-array", "typescript", "performance", r"for\s*\((const|let|var)\s+[A-Za-z_]+\s+in\s", "low", ""),
    ("async-in-foreach", "typescript", "async", r"forEach\(async", "medium", ""),
    ("swallowed-error", "typescript", "errors", r"catch\s*(\([^)]*\))?\s*\{\s*\}", "high", ""),
    ("thrown-text", "typescript", "errors", r"throw\s+['\"]", "high", ""),
    ("skipped-test", "typescript", "testing", r"\b(it|test|describe)\.(skip|only)\(", "high", ""),
    ("heavy-import", "typescript", "bundle", r"from ['\"](moment|lodash)['\"]", "medium", ""),
    ("loose-equality", "typescript", "modern", r"[^=!<>]==[^=]", "low", ""),
]

#: Whole-file rules: id, language, family, pattern that must occur, pattern that must not, severity, weakness.
FILE_RULES = [
    ("form-without-token", "html", "auth", r"(?i)<form\b", r"(?i)csrf", "medium", "CWE-352"),
    ("script-without-policy", "html", "xss", r"(?i)<script\b", r"(?i)content-security-policy", "low", "CWE-1021"),
    ("article-without-section", "html", "structure", r"(?i)<article\b", r"(?i)<section\b", "low", ""),
    ("test-without-expectation", "typescript", "tests", r"\b(it|test)\(['\"]", r"\bexpect\(", "high", ""),
    ("effect-without-cleanup", "typescript", "react", r"addEventListener\(", r"removeEventListener\(", "medium", ""),
    ("goroutine-without-sync", "go", "race", r"\bgo func\b", r"\bsync\.|<-", "high", "CWE-362"),
    ("unsafe-without-reason", "rust", "unsafe", r"\bunsafe\b", r"SAFETY:", "medium", ""),
    ("unwrap-without-result", "rust", "errors", r"\.unwrap\(\)", r"Result<", "high", ""),
    ("singleton-without-lock", "java", "design", r"static\s+\w+\s+getInstance\(", r"synchronized|enum ", "medium", ""),
]

#: Neighbourhood rules: id, language, pattern of the line, pattern that one of the lines from ``first`` to ``last`` (relative) must match.
NEAR_RULES = [
    ("open-without-defer", "go", r"os\.(Open|Create)\(", r"\bdefer\b", 1, 10, "medium"),
    ("undocumented-function", "rust", r"^\s*pub fn ", r"^\s*///", -1, -1, "low"),
    ("fetch-without-catch", "typescript", r"\bfetch\(", r"\bcatch\b", 0, 10, "medium"),
    ("image-without-text", "html", r"(?i)<img\b", r"(?i)\balt=", 0, 0, "low"),
    ("heading-without-paragraph", "html", r"(?i)<h[1-3]\b", r"(?i)<p\b", 0, 1, "low"),
    ("bold-not-closed", "html", r"(?i)<b>", r"(?i)</b>", 0, 2, "low"),
    ("script-not-closed", "html", r"(?i)<script\b", r"(?i)</script>", 0, 2, "medium"),
]

#: Loop rules: id, language, pattern within a loop, severity. A loop is open from its head to the first line that is a closing brace.
LOOP_HEAD, LOOP_END = r"\b(for|while)\b.*\{\s*$", r"^\s*\}\s*$"
LOOP_RULES = [
    ("concat-in-loop", "go", r"\+=\s*\"", "medium"),
    ("defer-in-loop", "go", r"\bdefer\b", "high"),
    ("query-in-loop", "java", r"\.(executeQuery|find|findById)\(", "high"),
    ("await-in-loop", "typescript", r"\bawait\b", "medium"),
    ("clone-in-loop", "rust", r"\.clone\(\)", "low"),
]

#: The same for regions of a page: what doesn't belong in its article.
ARTICLE_HEAD, ARTICLE_END = r"(?i)<article\b", r"(?i)</article>"
ARTICLE_RULES = [
    ("ad-in-article", "html", r"(?i)class=\"ad\b", "low"),
    ("script-in-article", "html", r"(?i)<script\b", "medium"),
    ("navigation-in-article", "html", r"(?i)<(nav|footer|aside)\b", "low"),
    ("presentation-in-article", "html", r"(?i)<(b|i|font|center)>", "low"),
]

#: Branch words by language, for the complexity of a file, and its import lines.
BRANCHES = {
    "go": r"\b(if|for|case|select)\b|&&|\|\|", "java": r"\b(if|for|while|case|catch)\b|&&|\|\|", "rust": r"\b(if|for|while|loop|match)\b|&&|\|\|",
    "typescript": r"\b(if|for|while|case|catch)\b|&&|\|\|", "python": r"\b(if|elif|for|while|except|and|or)\b",
}
IMPORTS = {
    "go": r"(?m)^\s*(?:import\s+)?\"([A-Za-z0-9_./-]+)\"\s*$", "java": r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z0-9_.]+)", "rust": r"(?m)^\s*(?:use|extern crate)\s+([A-Za-z0-9_]+)",
    "html": r"(?i)(?:src|href)=\"(?:https?:)?/?/?([A-Za-z0-9.-]+)",
    "typescript": r"(?:from|require\()\s*['\"]([^'\"\n]+)['\"]", "python": r"(?m)^\s*(?:import|from)\s+([A-Za-z0-9_]+)",
}

INJECTION = r"(?i)(union\s+select|drop\s+table|;\s*--|'\s*or\s+'1'\s*=\s*'1|insert\s+into)"
SCRIPT = r"(?i)(<script|javascript:|onerror\s*=|onload\s*=|eval\()"


def pii_counts(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in PII.items()]


def mask(text: Column) -> Column:
    """Every match replaced by a tag of its kind, in order of the kinds."""
    for kind, pattern in PII.items():
        text = F.regexp_replace(text, pattern, f"[{kind}]")
    return text


def luhn_valid(number: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(number, "[^0-9]", ""))


def line_findings(files: DataFrame, key: str, text: str, rules=LINE_RULES, language: str | None = None) -> DataFrame:
    """One row for each line and rule that matches: all rules are tested in one pass over the lines.

    ``language`` is the column with a file's language: only its rules, and those of any language, are tested. Without it
    a file is tested as of every language.
    """
    own = [language] if language else []
    lines = files.select(key, *own, F.posexplode(F.split(text, "\n")).alias("line", "code"))
    rule = "struct<rule_id:string,family:string,severity:string,cwe:string>"

    def hits(some):
        found = [F.when(F.col("code").rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(f).alias("family"), F.lit(s).alias("severity"), F.lit(c).alias("cwe"))) for i, _, f, p, s, c in some]
        return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{rule}>")

    if language is None:
        matched = hits(rules)
    else:
        # A line meets the rules of its own language only, not a condition for each rule.
        matched = hits([r for r in rules if r[1] == "any"])
        for lang in sorted({r[1] for r in rules} - {"any"}):
            matched = F.when(F.col(language) == lang, hits([r for r in rules if r[1] in (lang, "any")])).otherwise(matched)
    return lines.select(key, (F.col("line") + 1).alias("line"), F.inline(matched))


def severity_summary(findings: DataFrame, key: str) -> DataFrame:
    """Findings by severity, zero-filled."""
    return findings.groupBy(key).pivot("severity", ["critical", "high", "medium", "low"]).count().na.fill(0)


def python_findings(files: DataFrame, key: str, text: str) -> DataFrame:
    """Findings from Python syntax trees: hard-coded secrets, exec or eval, bare except; unparsable text gives a parse finding."""
    def walk(code: str):
        try:
            tree = ast.parse(code or "")
        except (SyntaxError, ValueError, RecursionError):
            return [("parse-error", "high", 0)]
        out = []
        for node in ast.walk(tree):
            if isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str) and len(node.value.value) > 8:
                out += [("hard-coded-secret", "critical", node.lineno) for t in node.targets if isinstance(t, ast.Name) and any(w in t.id.lower() for w in ("password", "secret", "token", "key"))]
            elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("exec", "eval"):
                out.append(("dynamic-code", "critical" if node.func.id == "exec" else "high", node.lineno))
            elif isinstance(node, ast.ExceptHandler) and node.type is None:
                out.append(("bare-except", "medium", node.lineno))
        return sorted(out, key=lambda x: (x[2], x[0]))

    @F.pandas_udf("array<struct<rule_id:string,severity:string,line:int>>")
    def found(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: [{"rule_id": a, "severity": b, "line": n} for a, b, n in walk(c)])

    return files.select(key, found(F.col(text)).alias("f")).select(key, F.inline("f"))


def file_findings(files: DataFrame, key: str, text: str, rules=FILE_RULES) -> DataFrame:
    """One row for each file and whole-file rule: something occurs and what should go with it doesn't."""
    t = F.col(text)
    hit = [F.when(t.rlike(p) & ~t.rlike(a), F.struct(F.lit(i).alias("rule_id"), F.lit(f).alias("family"), F.lit(s).alias("severity"), F.lit(c).alias("cwe"))) for i, _, f, p, a, s, c in rules]
    return files.select(key, F.inline(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def near_findings(files: DataFrame, key: str, text: str, rules=NEAR_RULES) -> DataFrame:
    """Lines whose neighbourhood lacks what should be there. Lines stay in their file's row; nothing is shuffled."""
    lines = files.select(key, F.split(text, "\n").alias("code"))

    def at(rule):
        i, _, line, wanted, first, last, severity = rule

        def lacks(x, n):
            low, high = F.greatest(n + first, F.lit(0)), n + last
            around = F.when(high >= low, F.slice("code", low + 1, high - low + 1)).otherwise(F.array().cast("array<string>"))
            return F.when(x.rlike(line) & ~F.exists(around, lambda y: y.rlike(wanted)), F.struct((n + 1).alias("line"), F.lit(i).alias("rule_id"), F.lit(severity).alias("severity")))

        return F.transform("code", lacks)

    found = F.concat(*[at(r) for r in rules])
    return lines.select(key, F.inline(F.filter(found, lambda x: x.isNotNull())))


def region_findings(files: DataFrame, key: str, text: str, rules=LOOP_RULES, head: str = LOOP_HEAD, end: str = LOOP_END) -> DataFrame:
    """Lines within a region (such as a loop) that match a rule.

    A region opens after its head and closes at the first line that matches ``end``; a fold over the lines of each file
    carries whether one is open.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("open"), F.array().cast("array<int>").alias("inside"))

    def step(state, x):
        n, ends = state["n"] + 1, x.rlike(end)
        inside = F.when(state["open"] & ~ends, F.concat(state["inside"], F.array(n))).otherwise(state["inside"])
        return F.struct(n.alias("n"), (x.rlike(head) | (state["open"] & ~ends)).alias("open"), inside.alias("inside"))

    lines = files.select(key, F.split(text, "\n").alias("code")).withColumn("inside", F.aggregate("code", start, step)["inside"])
    each = lines.select(key, F.explode(F.transform("inside", lambda n: F.struct(n.alias("line"), F.element_at("code", n).alias("code")))).alias("x")).select(key, "x.line", "x.code")
    hit = [F.when(F.col("code").rlike(p), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"))) for i, _, p, s in rules]
    return each.select(key, "line", F.inline(F.filter(F.array(*hit), lambda x: x.isNotNull())))


def complexity(text: Column, language: str) -> Column:
    """One more than the branches of a file."""
    return (1 + F.regexp_count(text, F.lit(BRANCHES[language]))).cast("long")


def dependencies(text: Column, language: str) -> Column:
    """Names of what a file imports, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(IMPORTS[language]), F.lit(1))))
