"""Bodies by braces: nested, unbalanced and disguised ones, against a plain stack over random programs."""

import random

import pytest
from pyspark.sql import functions as F

from docsense.operators import bodies

CASES = [
    ("go", "func a() {\n\tfor _, x := range xs {\n\t\tdefer x.Close()\n\t}\n}", [("defer-in-loop", 3)]),
    ("go", "func a() {\n\tfor {\n\t\tfunc() {\n\t\t\tdefer m.Unlock()\n\t\t}()\n\t}\n}", []),
    ("go", "func a() {\n\tfor {\n\t}\n\tdefer x.Close()\n}", []),
    ("go", 'func a() {\n\ts := "for {"\n\tdefer x()\n\t// for {\n\tdefer y() /* { */\n}', []),
    ("go", "func a() {\n\tfor i := 0; i < 3; i++ {\n\t\tif x {\n\t\t\tdb.Query(q)", [("query-in-loop", 4)]),
    ("go", "}}}\nfunc a() {\n\tf, _ := os.Open(p)\n}\nfunc b() {\n\tg, _ := os.Open(p)\n\tdefer g.Close()\n}", [("open-without-close", 3)]),
    ("go", "func a(\n\tx int,\n) {\n\tmu.Lock()\n}", [("lock-without-unlock", 4)]),
    ("go", "for {\n\tdefer top()\n}", [("defer-in-loop", 2)]),
    ("java", 'class A {\n  void f() throws E\n  {\n    for (int i = 0; i < n; i++)\n    {\n      s += "x";\n    }\n    s += "y";\n  }\n}', [("concat-in-loop", 6)]),
    ("java", "class A {\n void f() {\n  while (a) { for (X x : y) { l.contains(x); } m.contains(1); }\n }\n}", [("work-in-nested-loop", 3)]),
    ("java", "class A { void f() { lock.lock(); } void g() { lock.lock(); lock.unlock(); } }", [("lock-without-unlock", 1)]),
    ("rust", "fn f<'a>(x: &'a str) {\n  loop {\n    let c = '{';\n    y.clone();\n  }\n  z.clone();\n}", [("clone-in-loop", 4)]),
    ("rust", 'fn f() {\n  for x in y {\n    let r = r#"} {"#;\n    m.lock().unwrap();\n  }\n}', [("lock-in-loop", 4)]),
    ("typescript", "async function f() {\n  for (const x of xs) {\n    await g(x);\n    h(async () => {\n      await k();\n    });\n  }\n}", [("await-in-loop", 3)]),
    ("typescript", "useEffect(() => {\n  w.addEventListener('x', f);\n}, []);\nuseEffect(() => {\n  w.addEventListener('x', f);\n  return () => w.removeEventListener('x', f);\n}, []);", [("listener-without-cleanup", 2)]),
    ("typescript", "const t = `for { ${x} `;\nasync function f() { await g(); }", []),
    ("cobol", "for { defer }", []),
    ("go", "", []),
]


@pytest.mark.parametrize("language, code, want", CASES)
def test_known_bodies(language, code, want):
    assert [(r, n) for r, _, n, _, _ in bodies.findings(code, language)] == want


def test_random_programs_against_a_plain_stack():
    """Programs written with their bodies known, some left open at the end."""
    rng = random.Random(14)
    for _ in range(150):
        lines, stack, want = [], [], []
        for _ in range(rng.randrange(1, 40)):
            pick = rng.random()
            if pick < 0.2:
                stack.append("loop")
                lines.append(rng.choice(["for x := range y {", "for {", "for i := 0; i < f(3); i++ {"]))
            elif pick < 0.3:
                stack.append("function")
                lines.append(rng.choice(["func g() {", "go func(x int) {", "func (r *T) M(a, b int) (int, error) {"]))
            elif pick < 0.4:
                stack.append("block")
                lines.append(rng.choice(["if x := f(); x > 0 {", "switch v {", "{"]))
            elif pick < 0.65 and stack:
                stack.pop()
                lines.append("}")
            elif pick < 0.8:
                inner = next((k for k in reversed(stack) if k != "block"), None)
                lines.append("defer f()")
                want += [len(lines)] if inner == "loop" else []
            else:
                lines.append(rng.choice(['s := "{ } for {"', "// } {", "/* { */ x()", "y := `}`", "", "c := '{'"]))
        got = [n for r, _, n, _, _ in bodies.findings("\n".join(lines), "go") if r == "defer-in-loop"]
        assert got == want, "\n".join(lines)


def test_body_findings_of_a_table(spark):
    rows = [(i, language, code) for i, (language, code, _) in enumerate(CASES)] + [(90, None, "for { defer }"), (91, "go", None)]
    df = spark.createDataFrame(rows, "k int, language string, code string").withColumn("line", F.lit(0))
    found = sorted((r.k, r.line, r.rule_id) for r in bodies.body_findings(df, "k", "code", F.col("language")).collect())
    assert found == sorted((i, n, r) for i, (_, _, want) in enumerate(CASES) for r, n in want)
    assert all(r.first <= r.line <= r.last for r in bodies.body_findings(df, "k", "code", F.col("language")).collect())


def test_large_results_leave_in_batches(spark, monkeypatch):
    """Findings of a batch are never all held: they leave after every few; keys of any type and null rows stay right."""
    from docsense.operators import batches

    monkeypatch.setattr(batches, "FINDINGS", 3)
    code = "func f() {\n\tfor a {\n" + "\t\tdefer x()\n" * 5 + "\t}\n}\n"
    files = spark.createDataFrame([(f"k{i}", code if i % 2 else None) for i in range(6)], "k string, code string").coalesce(1)
    found = [(r.k, r.rule_id, r.line) for r in bodies.body_findings(files, "k", "code", F.lit("go")).collect()]
    assert sorted(found) == [(f"k{i}", "defer-in-loop", 3 + j) for i in (1, 3, 5) for j in range(5)]


def test_order_programs_are_written_behind_the_shuffle(spark):
    """What is shuffled are a line's numbers, not its code."""
    from docsense.plans import code

    plan = code._order_programs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("collect_list") :].partition("\n")[2]
    assert "l_quantity" in below and "func f" not in below


def test_lines_meet_the_rules_of_their_language_only(spark):
    """A condition a language instead of one a rule; null and unknown languages meet the rules of any language."""
    from docsense.operators import scan

    said = 'eval(x); exec.Command("sh"); secret = "abcdefghijkl"; y.unwrap()\n<script'
    files = spark.createDataFrame([(i, lang, said) for i, lang in enumerate(["go", "rust", "html", "typescript", "cobol", None])], "k int, lang string, code string")
    found = scan.line_findings(files, "k", "code", language="lang")
    names = {}
    for r in found.collect():
        names.setdefault(r.k, []).append((r.line, r.rule_id))
    every = (1, "hard-coded-secret")
    assert names == {0: [(1, "command-exec"), every, (1, "shell-exec")], 1: [every, (1, "unwrap-call")], 2: [every, (2, "script-tag")], 3: [every, (1, "eval-call")], 4: [every], 5: [every]}
    # A condition for each rule would compare the language some ninety times.
    assert found._jdf.queryExecution().analyzed().toString().count("(lang#") <= len({r[1] for r in scan.LINE_RULES})
