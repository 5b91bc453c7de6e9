"""Rubrics, sections, file rules, readers and reviews on small literal fixtures."""

import json
import random

from pyspark.sql import functions as F

from docsense.functions import markup
from docsense.operators import reviews, rubrics, scan, sections, tokens
from docsense.sources import readers

DOC = """# Title
Intro text of the document that is long enough to be shown here.

## Overview
This overview line says a good deal and has more than fifty characters.
- first application point
- second point

## Requirements
1. must do this
2. must do that

## Examples
```go
x := 1
```
## Notes
short
"""


def _one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").withColumn("low", F.lower("t")).select(*columns).first()


def test_markup(spark):
    html = '<h1 class="x">Top</h1><p>One <b>two</b><br>three</p><ul><li>a</li><li><a href="u">b</a></li></ul><pre>c</pre>'
    assert _one(spark, html, markup.to_markdown(F.col("t")))[0].strip() == "# Top\n\nOne two\nthree\n\n- a\n- [b](u)\n\n```\nc\n```"
    assert _one(spark, None, markup.to_markdown(F.col("t")))[0] is None
    row = _one(spark, "API Design: v2!", markup.anchor(F.col("t")), markup.title_from_id(F.lit("api_design-v2")), markup.occurrences(F.col("low"), "i", "de"), markup.preview(F.col("t"), 3), markup.technical_terms(F.col("t")))
    assert tuple(row) == ("api-design-v2", "Api Design V2", 3, "API...", ["API", "Design"])
    assert _one(spark, "token=abc at /a/b.py", markup.redact_message(F.col("t")))[0] == "token=[redacted] at [path]"


def test_rubrics(spark):
    t, low, yes, no = F.col("t"), F.col("low"), F.lit(True), F.lit(False)
    row = _one(spark, DOC, rubrics.completeness(t, low, [yes, no]), rubrics.consistency(t), rubrics.clarity(t, low), rubrics.compliance(t, low, ["must"], ["Intro", "GDPR"]), rubrics.guidance(t, low, no), rubrics.maintainability(low, yes, no, no, yes))
    # No named section, half of the metadata, a code block; heading levels 1 2 2 2 2.
    assert row[0] == 0 + 0 + 10 + 15 + 0 and row[3] == 40 + 15 and row[4] == 10 + 4 and row[5] == 45
    assert 25 <= row[1] <= 60 and 0 < row[2] <= 100
    empty = _one(spark, "", rubrics.completeness(t, low, []), rubrics.consistency(t), rubrics.clarity(t, low), rubrics.compliance(t, low, [], []), rubrics.guidance(t, low, yes))
    assert tuple(empty) == (0, 0, 0, 0, 0)
    jumps = rubrics.heading_structure(t, ["# ", "## Scope"])
    assert tuple(_one(spark, "## a\n#### b\n```", *jumps.values())) == ("## Scope", True, 1, True)
    scores = spark.createDataFrame([(1, 80.0, 40.0, 60.0, 0.0, 100.0, 59.5)], "k int, completeness double, consistency double, clarity double, compliance double, guidance double, maintainability double")
    assert rubrics.overall(scores).first().overall == 58.95
    assert {(r.metric, r.missing) for r in rubrics.recommendations(scores, "k").collect()} == {("consistency", 20.0), ("compliance", 60.0), ("maintainability", 0.5)}


def test_record_validation(spark):
    s, yes, no = F.lit("x"), F.lit(True), F.lit(False)
    r = spark.range(1).select(*[c.alias(k) for k, c in rubrics.record_validation(s, F.lit(None).cast("string"), s, s, [yes, no, yes, no]).items()]).first()
    assert (r.valid, r.completeness, r.clarity, r.actionability) == (False, 0.65, 0.0, 0.6)


def test_sections_and_formats(spark):
    df = spark.createDataFrame([(1, DOC), (2, ""), (3, None)], "k int, t string").select("k", sections.parse(F.col("t")).alias("s"))
    held = {r.k: r.s for r in df.collect()}
    assert [(x.title, x.kind, x.priority) for x in held[1]] == [("Title", "other", 4), ("Overview", "overview", 8), ("Requirements", "requirements", 9), ("Examples", "example", 5)]
    assert held[2] == [] and held[3] is None
    out = df.where("k = 1").select(sections.reference_format(F.col("s"), 1000).alias("ref"), sections.reference_format(F.col("s"), 5).alias("cut"), sections.summary_format(F.col("s"), 1000).alias("sum")).first()
    assert out.ref == "## Overview\n- first app point\n- second point\n\n## Requirements\n1. must do this\n2. must do that"
    assert out.cut.endswith("[Content truncated due to token limit]") and len(out.cut) < 65
    assert out.sum == "**Summary**: This overview line says a good deal and has more than fifty characters.\n\n**Sections covered**: Requirements, Overview, Examples"
    packed = sections.condensed_format(df.where("k = 1"), "k", "s", 20).first()
    assert packed.used <= 20 and packed.text.startswith("## reqs\n1. must do this\n2. must do that")


def test_file_rules(spark):
    go = "func f() {\nfor i := range x {\n  s += \"a\"\n  defer g()\n}\n  s += \"b\"\nos.Open(p)\n}\ngo func() {}"
    files = spark.createDataFrame([("go", go), ("rs", "/// doc\npub fn a() {}\npub fn b() {}\nunsafe { transmute(x) }"), ("none", None)], "k string, t string")
    assert {(r.k, r.line, r.rule_id) for r in scan.region_findings(files, "k", "t").collect()} == {("go", 3, "concat-in-loop"), ("go", 4, "defer-in-loop")}
    assert {(r.k, r.line, r.rule_id) for r in scan.near_findings(files, "k", "t").collect()} == {("go", 7, "open-without-defer"), ("rs", 3, "undocumented-function")}
    assert {(r.k, r.rule_id) for r in scan.file_findings(files, "k", "t").collect()} == {("go", "goroutine-without-sync"), ("rs", "unsafe-without-reason")}
    java = "import java.util.List;\nclass A { static List<String> x = new ArrayList<>();\n try { } catch (Exception e) { }\n stmt.executeQuery(\"select \" + id);\n if (a && b) {} }"
    code = spark.createDataFrame([("j", java)], "k string, t string")
    assert {r.rule_id for r in scan.line_findings(code, "k", "t").collect()} >= {"static-collection", "empty-catch", "broad-catch", "statement-concat"}
    assert tuple(code.select(scan.complexity(F.col("t"), "java"), scan.dependencies(F.col("t"), "java")).first()) == (4, ["java.util.List"])
    ts = spark.createDataFrame([("t", "const a = b as any;\nconsole.log(`x`, password);\nlocalStorage.setItem('token', t);\nexec(`ls ${d}`);\nimport * as _ from 'lodash';")], "k string, t string")
    assert {r.rule_id for r in scan.line_findings(ts, "k", "t").collect()} >= {"as-any", "console-secret", "stored-token", "exec-template", "whole-import"}


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.json").write_text(json.dumps({"title": "One", "tags": ["a"], "content": "c"}))
    (tmp_path / "sub" / "many.json").write_text(json.dumps({"standards": [{"id": "m1", "title": "M1"}, {"id": "m2"}]}))
    (tmp_path / "manifest.json").write_text("{}")
    assert {(r.id, r.title) for r in readers.read_json(spark, str(tmp_path)).collect()} == {("one", "One"), ("m1", "M1"), ("m2", None)}
    (tmp_path / "a.yaml").write_text("title: A\ntags: [x, y]\n")
    (tmp_path / "b.yml").write_text("standards:\n  web:\n    sections:\n      s1:\n        standards:\n          - {id: n1, title: N1}\n          - {id: n2}\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    got = {r.id: r for r in readers.read_yaml(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "n1", "n2"} and got["a"].tags == ["x", "y"] and got["n1"].title == "N1"
    (tmp_path / "x.md").write_text("intro\n# Head\nbody")
    (tmp_path / "sub" / "y.md").write_text("plain")
    docs = readers.read_markdown(spark, str(tmp_path))
    assert {(r.id, r.title) for r in docs.collect()} == {("doc:x", "Head"), ("doc:y", "")}
    assert [r.id for r in readers.read_markdown(spark, str(tmp_path), spark.createDataFrame([("doc:x",)], "id string")).collect()] == ["doc:y"]
    readers.write_index(docs, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).count() == 2


def test_file_filter(spark):
    rows = [("docs/a.md", 10), ("docs/deep/b.md", 10), ("../a.md", 10), ("docs/con.md", 10), ("docs/x/draft.md", 10), ("docs/big.md", 1 << 21), ("/abs.md", 1), ("docs/.git/a.md", 1), (None, 1), ("a.txt", 1)]
    df = spark.createDataFrame(rows, "path string, size long")
    ok = readers.admitted(F.col("path"), F.col("size"), ["docs/**.md"], ["**/draft.md"])
    assert [r.path for r in df.where(ok).collect()] == ["docs/a.md", "docs/deep/b.md"]


def test_reviews(spark):
    a = spark.createDataFrame([("r1", "d", "technical", "2024-01-01", "assigned"), ("r1", "d", "community", "2024-01-01", "completed"), ("r2", "e", "odd", "2024-01-01", "assigned")], "r string, doc string, stage string, day string, status string").withColumn("day", F.to_date("day"))
    dated = reviews.due_dates(a, "stage", "day").withColumn("status", reviews.overdue(F.col("status"), F.col("due"), F.lit("2024-01-08").cast("date")))
    assert {(r.stage, str(r.due), r.status) for r in dated.collect()} == {("technical", "2024-01-06", "overdue"), ("community", "2024-01-11", "completed"), ("odd", "None", "assigned")}
    load = reviews.workload(spark.createDataFrame([("r1",), ("r3",)], "r string"), dated, "r")
    assert {tuple(r) for r in load.collect()} == {("r1", 2, 1, 1), ("r3", 0, 0, 0)}
    assert {tuple(r) for r in reviews.progress(dated, "doc").collect()} == {("d", 2, 1, 50.0), ("e", 1, 0, 0.0)}


def test_abbreviations_search_what_a_text_holds(spark):
    """One replacement in the expression instead of one a word, with the results of all replacements in turn."""
    rng = random.Random(4)
    words = [*tokens.ABBREVIATIONS, *tokens.ABBREVIATIONS.values(), "und", "é", "_", "x9"]
    texts = ["".join(rng.choice((str.upper, str.title, str.lower))(rng.choice(words)) + rng.choice((" ", ".", "", "é", "\n", "-")) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "k int, t string")
    inturn = F.col("t")
    for word, short in tokens.ABBREVIATIONS.items():
        inturn = F.regexp_replace(inturn, rf"(?i)\b{word}\b", short)
    found = rows.select(tokens.abbreviate(F.col("t")).alias("a"), inturn.alias("b"), F.col("t"))
    assert found.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and found.where("a <> t").count() > 100
    plan = rows.select(tokens.abbreviate(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") < 5
