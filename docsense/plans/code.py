"""Code scans over source files that Spark derives from the part table, with their oracle SQL.

Every part is a source file in one of six languages: a choice of lines by its number, with its name in a comment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docsense.operators import bodies, detectors, scan
from docsense.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


LINES = {
    "go": ['db.Query("SELECT * FROM t WHERE id = " + id)', 'cmd := exec.Command("sh", "-c", input)', "out := make([]int, 0)", "v, _ := strconv.Atoi(s)", "ctx := context.Background()", "h := md5.New()", "ch := make(chan int)", "return nil"],
    "java": ['MessageDigest.getInstance("MD5");', "Object o = new ObjectInputStream(in).readObject();", 'if (name == "admin") {', "@GetMapping", "catch (Exception e) {", 'em.createQuery("from U where n=" + n);', "List<String> l = new Vector<>();", "return x;"],
    "rust": ["let x = y.unwrap();", "unsafe { *p }", 'let v: Vec<u8> = Vec::new();', "let g = m.lock().unwrap();", "let z = a.clone();", "todo!()", 'r.expect("no")', "Ok(())"],
    "typescript": ["el.innerHTML = html;", "const x: any = 1;", "// @ts-ignore", "items.forEach(async x => 1);", "try { f() } catch (e) {}", "if (a == b) {", "import _ from 'lodash';", "export default x;"],
    "html": ["<script>go()</script>", '<a href="http://example.com">x</a>', '<b onclick="f()">x</b>', "<p>text</p>", '<a href="javascript:f()">y</a>', "<div>", "</div>", "<hr>"],
}
#: Python pieces, each a statement of its own, and what is found in it (kind, detector, line in the piece).
PYTHON = [
    ('q = "SELECT * FROM t WHERE id = " + user_id', [("security", "sql_injection", 1)]),
    ("el.innerHTML = html", [("security", "xss", 1)]),
    ("data = open(user_path)", [("security", "path_traversal", 1)]),
    ("os.system(cmd)", [("security", "command_injection", 1)]),
    ('db_password = "hunter2hunter2"', [("security", "hardcoded_secrets", 1)]),
    ("obj = pickle.loads(blob)", [("security", "unsafe_deserialization", 1)]),
    ("h = hashlib.md5(x)", [("security", "weak_crypto", 1)]),
    ("if os.path.exists(p):\n    f = open(p)", [("security", "race_condition", 1)]),
    ("for u in users:\n    row = db.query(u)", [("performance", "n_plus_one", 1)]),
    ("for a in x:\n    for b in y:\n        f(a, b)", [("performance", "inefficient_loop", 1)]),
    ("def load(p):\n    f = connect(p)\n    return f", [("performance", "memory_leak", 2)]),
    ("time.sleep(1)", [("performance", "blocking_io", 1)]),
    ("for a in x:\n    buf = allocate(a)", [("performance", "excessive_allocation", 2)]),
    ("for a in x:\n    total += a", [("performance", "sum_in_loop", 2)]),
    ("try:\n    f()\nexcept:\n    pass", [("practice", "bare_except", 3)]),
    ("x = 1", []),
    ("def broken(:", [("parse", "parse_error", -1)]),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sources(spark, d):
    langs = list(LINES)
    row = lambda lang: F.array(*map(F.lit, LINES[lang]))
    k = F.col("p_partkey")
    language = F.element_at(F.array(*map(F.lit, langs)), (k % len(langs) + 1).cast("int"))
    lines = F.element_at(F.array(*map(row, langs)), (k % len(langs) + 1).cast("int"))
    kept = F.filter(lines, lambda x, i: ((k / 5).cast("long") + i) % 3 > 0)
    return table(spark, d, "part").select("p_partkey", language.alias("language"), F.concat(F.lit("// "), "p_name", F.lit("\n"), F.array_join(kept, "\n")).alias("code"))


_LINE_ROWS = ", ".join(f"({n}, {_quoted(lang)}, {i}, {_quoted(line)})" for n, lang in enumerate(LINES) for i, line in enumerate(LINES[lang]))
_RULE_ROWS = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in scan.LINE_RULES)
_FIND = rf"""s(n, language, i, line) AS (VALUES {_LINE_ROWS}), f AS (SELECT p_partkey, language, '// ' || any_value(p_name) || chr(10) || string_agg(line, chr(10) ORDER BY i) AS code FROM part JOIN s ON n = p_partkey % 5 WHERE (p_partkey // 5 + i) % 3 > 0 GROUP BY ALL),
l AS (SELECT p_partkey, language, i, x[i] AS code FROM (SELECT p_partkey, language, string_split(code, chr(10)) AS x FROM f), unnest(range(1, len(x) + 1)) t(i)), r(rule_id, lang, family, pattern, severity, cwe) AS (VALUES {_RULE_ROWS}),
found AS (SELECT p_partkey, i::INTEGER AS line, rule_id, family, severity, cwe, language FROM l JOIN r ON lang IN (language, 'any') AND regexp_matches(code, pattern))"""


@query(f"WITH {_FIND} SELECT p_partkey, line, rule_id, family, severity, cwe FROM found")
def code_rule_scan(spark, d):
    """Line rules of each file's own language."""
    return scan.line_findings(_sources(spark, d), "p_partkey", "code", language="language")


@query(f"WITH {_FIND} SELECT language, severity, count(*) AS n FROM found GROUP BY ALL")
def issues_by_language(spark, d):
    files = _sources(spark, d)
    found = scan.line_findings(files, "p_partkey", "code", language="language")
    return found.join(files.select("p_partkey", "language"), "p_partkey").groupBy("language", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_FIND} SELECT p_partkey, count(*) AS n FROM found WHERE severity IN ('critical', 'high') AND family = 'injection' GROUP BY 1")
def issue_filter(spark, d):
    """Findings of a severity and a family."""
    wanted = [r for r in scan.LINE_RULES if r[2] == "injection" and r[4] in ("critical", "high")]
    found = scan.line_findings(_sources(spark, d), "p_partkey", "code", wanted, language="language")
    return found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


#: The quantity above which a line's statement stands in the loop, and the statement that its return flag calls for.
_LOOPED, _STATEMENTS = 25, {"R": "defer f.Close()", "A": "rows := db.Query(q) // } not a brace", "N": 's += "}"'}
_RULE_OF = {"R": ("defer-in-loop", "high"), "A": ("query-in-loop", "high"), "N": ("concat-in-loop", "medium")}


def _order_programs(spark, d):
    """Every order is a Go file with a function of eight lines for each of its lines: a loop, and a statement in or behind it."""
    word = lambda x: F.when(x == "R", _STATEMENTS["R"]).when(x == "A", _STATEMENTS["A"]).when(x == "N", _STATEMENTS["N"]).otherwise("pass()")

    def code(x):
        said, looped = word(x["l_returnflag"]), x["l_quantity"] > _LOOPED
        head = F.concat(F.lit("func f"), x["l_linenumber"].cast("string"), F.lit("(q string) {\n\tif ready {\n\t\tfor i := 0; i < "), x["l_quantity"].cast("int").cast("string"), F.lit("; i++ {\n\t\t\t"))
        return F.concat(head, F.when(looped, said).otherwise("work()"), F.lit("\n\t\t}\n\t}\n\t"), F.when(looped, "work()").otherwise(said), F.lit("\n}\n"))

    # The lines are shuffled, their code is written behind the shuffle.
    rows = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("f"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), code), "").alias("code"))


_IS = " ".join(f"WHEN '{k}' THEN '{r}'" for k, (r, _) in _RULE_OF.items())
_HOW = " ".join(f"WHEN '{k}' THEN '{s}'" for k, (_, s) in _RULE_OF.items())


@query(f"""WITH p AS (SELECT l_orderkey, l_returnflag, l_quantity, 8 * (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1) AS above FROM lineitem)
SELECT l_orderkey, CASE l_returnflag {_IS} END AS rule_id, CASE l_returnflag {_HOW} END AS severity, (above + 4)::INTEGER AS line, (above + 3)::INTEGER AS first, (above + 5)::INTEGER AS last FROM p WHERE l_quantity > {_LOOPED} AND l_returnflag IN {tuple(_RULE_OF)}""")
def body_rules(spark, d):
    """Statements that must not stand in loops, by the bodies that braces make."""
    return bodies.body_findings(_order_programs(spark, d), "l_orderkey", "code", F.lit("go"))


@query("SELECT p_partkey, '/src/' || CASE p_partkey % 4 WHEN 0 THEN 'node_modules' WHEN 1 THEN 'app' WHEN 2 THEN '.git' ELSE 'lib' END || '/' || p_partkey AS path FROM part WHERE p_partkey % 4 IN (1, 3)")
def skipped_paths(spark, d):
    """Files outside folders that scans skip."""
    folder = F.element_at(F.array(*map(F.lit, ("node_modules", "app", ".git", "lib"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    files = table(spark, d, "part").select("p_partkey", F.concat(F.lit("/src/"), folder, F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    return files.where(~F.col("path").rlike(r"(node_modules|\.git|__pycache__|venv|\.venv|dist|build|\.pytest_cache)"))


def _python(spark, d):
    """Two pieces a file, by the part's number."""
    pieces = F.array(*[F.lit(code) for code, _ in PYTHON])
    k, n = F.col("p_partkey"), len(PYTHON)
    pick = lambda e: F.element_at(pieces, (F.pmod(e, F.lit(n)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("# "), "p_name", F.lit("\nimport os\n"), pick(k), F.lit("\n"), pick(k * 3 + 1)).alias("code"))


_PIECES = ", ".join(f"({i}, {code.count(chr(10)) + 1})" for i, (code, _) in enumerate(PYTHON))
_WANTED = ", ".join(f"({i}, '{kind}', '{detector}', {line})" for i, (_, found) in enumerate(PYTHON) for kind, detector, line in found)
_N = len(PYTHON)
_BROKEN = next(i for i, (_, f) in enumerate(PYTHON) if f and f[0][0] == "parse")


@query(f"""WITH c(i, lines) AS (VALUES {_PIECES}), w(i, kind, detector, line) AS (VALUES {_WANTED}), f AS (SELECT p_partkey, p_partkey % {_N} AS a, (p_partkey * 3 + 1) % {_N} AS b FROM part),
ok AS (SELECT p_partkey, a, b, lines FROM f JOIN c ON c.i = a WHERE a <> {_BROKEN} AND b <> {_BROKEN})
SELECT p_partkey, kind, detector, (2 + line)::INTEGER AS line FROM ok JOIN w ON w.i = a UNION ALL SELECT p_partkey, kind, detector, (2 + lines + line)::INTEGER FROM ok JOIN w ON w.i = b
UNION ALL SELECT p_partkey, 'parse', 'parse_error', 0 FROM f WHERE a = {_BROKEN} OR b = {_BROKEN}""")
def python_detectors(spark, d):
    """Security and performance detectors over whole Python files."""
    return detectors.findings(_python(spark, d), "p_partkey", "code")


@query(f"""WITH f AS (SELECT p_partkey, p_partkey % {_N} AS a, (p_partkey * 3 + 1) % {_N} AS b FROM part) SELECT p_partkey, 1::BIGINT AS comments, CASE WHEN a = {_BROKEN} OR b = {_BROKEN} THEN '' ELSE 'os' END AS imports FROM f""")
def python_shapes(spark, d):
    shown = detectors.shapes(_python(spark, d), "p_partkey", "code")
    return shown.select("p_partkey", "comments", F.array_join("imports", ",").alias("imports"))


@query()
def python_complexity(spark, d):
    return detectors.shapes(_python(spark, d), "p_partkey", "code").select("p_partkey", "loc", "complexity")


@query("""WITH c AS (SELECT p_partkey, p_partkey % 3 = 0 AS has_test, p_partkey % 5 = 0 AS has_doc, p_size AS lines FROM part)
SELECT p_partkey, list_aggregate(list_filter([CASE WHEN NOT has_test THEN 'Add tests' END, CASE WHEN NOT has_doc THEN 'Add documentation' END, CASE WHEN lines > 30 THEN 'Split long functions' END], lambda x: x IS NOT NULL), 'string_agg', '; ') AS suggestions, has_test AND has_doc AND lines <= 30 AS valid FROM c""")
def code_suggestions(spark, d):
    """What a file lacks of a standard: tests, documentation, short functions."""
    k = F.col("p_partkey")
    found = F.concat_ws("; ", F.when(k % 3 != 0, "Add tests"), F.when(k % 5 != 0, "Add documentation"), F.when(F.col("p_size") > 30, "Split long functions"))
    return table(spark, d, "part").select("p_partkey", F.nullif(found, F.lit("")).alias("suggestions"), ((k % 3 == 0) & (k % 5 == 0) & (F.col("p_size") <= 30)).alias("valid"))
