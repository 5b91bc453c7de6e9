"""Rule queries over order contexts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsense.operators import rules
from docsense.sources.tables import table

QUERIES, SQL = {}, {}

KINDS = {"totalprice": "number", "tags": "array", "customer.balance": "number"}

RULES = [
    {"id": "r1", "priority": 10, "tags": ["finance"], "standards": ["audit", "ledger"], "conditions": [{"field": "totalprice", "operator": "greater_than", "value": 200000}, {"field": "customer.segment", "operator": "in", "value": ["BUILDING", "MACHINERY"]}]},
    {"id": "r2", "priority": 20, "tags": ["risk"], "standards": ["ledger", "review"], "conditions": {"logic": "OR", "conditions": [{"field": "customer.balance", "operator": "less_than", "value": 0}, {"field": "status", "operator": "equals", "value": "F"}]}},
    {"id": "r3", "priority": 5, "tags": ["ops"], "standards": ["express"], "conditions": {"field": "order_priority", "operator": "matches_regex", "value": "[12]-"}},
    {"id": "r4", "priority": 30, "tags": ["ops", "risk"], "standards": ["review", "audit"], "conditions": {"logic": "NOT", "conditions": [{"field": "customer.nation", "operator": "contains", "value": "A"}]}},
    {"id": "r5", "priority": 15, "tags": ["ops"], "standards": ["tagged"], "conditions": [{"field": "tags", "operator": "contains", "value": "O"}, {"field": "tags", "operator": "not_contains", "value": "5-LOW"}, {"field": "customer.missing", "operator": "not_exists"}, {"field": "customer.segment", "operator": "equals", "value": "building", "case_sensitive": False}]},
]

_CTX = "ctx AS (SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS totalprice, o_orderpriority AS order_priority, c_mktsegment AS segment, c_acctbal AS balance, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_HIT = """hits AS (
 SELECT o_orderkey, 'r1' AS rule_id, 10 AS priority, ['audit', 'ledger'] AS standards FROM ctx WHERE totalprice > 200000 AND segment IN ('BUILDING', 'MACHINERY')
 UNION ALL SELECT o_orderkey, 'r2', 20, ['ledger', 'review'] FROM ctx WHERE balance < 0 OR status = 'F'
 UNION ALL SELECT o_orderkey, 'r3', 5, ['express'] FROM ctx WHERE regexp_matches(order_priority, '^[12]-')
 UNION ALL SELECT o_orderkey, 'r4', 30, ['review', 'audit'] FROM ctx WHERE NOT contains(nation, 'A')
 UNION ALL SELECT o_orderkey, 'r5', 15, ['tagged'] FROM ctx WHERE status = 'O' AND order_priority <> '5-LOW' AND lower(segment) = 'building')"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def contexts(spark, d):
    """One context per order, nested as rules address it."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("o_orderpriority").alias("order_priority"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("n_name").alias("nation"), F.lit(None).cast("string").alias("missing")).alias("customer"),
    )


def _matches(spark, d):
    return rules.matched(contexts(spark, d), "o_orderkey", rules.select_rules(RULES), KINDS)


@query(f"WITH {_CTX}, {_HIT} SELECT o_orderkey, rule_id, priority, array_to_string(standards, ',') AS standards FROM hits")
def rules_match_orders(spark, d):
    return _matches(spark, d).withColumn("standards", F.array_join("standards", ","))


@query(f"WITH {_CTX}, {_HIT}, e AS (SELECT o_orderkey, rule_id, priority, unnest(standards) AS standard_id FROM hits) SELECT o_orderkey, standard_id, min(priority) AS priority, arg_min(rule_id, priority) AS rule_id FROM e GROUP BY ALL")
def rules_resolved(spark, d):
    return rules.resolved(_matches(spark, d), "o_orderkey")


@query(f"WITH {_CTX}, {_HIT}, e AS (SELECT o_orderkey, rule_id, priority, unnest(standards) AS standard_id FROM hits), w AS (SELECT *, row_number() OVER z::INTEGER AS n, string_agg(rule_id, ',') OVER z AS rules FROM e WINDOW z AS (PARTITION BY o_orderkey, standard_id ORDER BY priority, rule_id)) SELECT o_orderkey, standard_id, rule_id, n, rules FROM w WHERE n > 1".replace("row_number() OVER z::INTEGER", "(row_number() OVER z)::INTEGER"))
def rules_conflicts(spark, d):
    return rules.conflicts(_matches(spark, d), "o_orderkey")


@query(f"WITH {_CTX}, {_HIT}, e AS (SELECT o_orderkey, rule_id, priority, unnest(standards) AS standard_id FROM hits), r AS (SELECT o_orderkey, standard_id, min(priority) AS priority FROM e GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY priority, standard_id) AS rn FROM r) SELECT o.o_orderkey, coalesce(standard_id, 'none') AS standard_id, coalesce(upper(standard_id[1]) || standard_id[2:], 'Untitled') AS title FROM orders o LEFT JOIN k ON o.o_orderkey = k.o_orderkey AND rn = 1")
def rules_first_standard(spark, d):
    """Each order with its first resolved standard, or defaults: a left join on the resolution."""
    first = rules.resolved(_matches(spark, d), "o_orderkey").groupBy("o_orderkey").agg(F.min(F.struct("priority", "standard_id"))["standard_id"].alias("standard_id"))
    joined = table(spark, d, "orders").select("o_orderkey").join(first, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("standard_id", F.lit("none")).alias("standard_id"), F.coalesce(F.initcap("standard_id"), F.lit("Untitled")).alias("title"))


@query(f"WITH {_CTX}, {_HIT}, k(rule_id, field_key) AS (VALUES ('r1', 'customer.segment,totalprice'), ('r2', 'customer.balance,status'), ('r3', 'order_priority'), ('r4', 'customer.nation'), ('r5', 'customer.missing,customer.segment,tags')), m AS (SELECT DISTINCT rule_id FROM hits) SELECT field_key, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, count(*) AS n FROM m JOIN k USING (rule_id) GROUP BY 1")
def rules_decision_tree(spark, d):
    """Rules that match any order, grouped by the fields they read."""
    read = F.create_map(*[x for r in RULES for x in (F.lit(r["id"]), F.array(*map(F.lit, rules.fields(r["conditions"]))))])
    return rules.decision_tree(_matches(spark, d).select("rule_id").distinct().select("rule_id", read[F.col("rule_id")].alias("fields")))


_OPS = [
    ("exists", "status", None, "status IS NOT NULL"), ("not_exists", "customer.missing", None, "true"), ("equals", "status", "O", "status = 'O'"), ("not_equals", "status", "O", "status <> 'O'"),
    ("contains", "customer.nation", "AN", "contains(nation, 'AN')"), ("not_contains", "customer.nation", "AN", "NOT contains(nation, 'AN')"), ("in", "status", ["O", "P"], "status IN ('O', 'P')"), ("not_in", "status", ["O", "P"], "status NOT IN ('O', 'P')"),
    ("matches_regex", "order_priority", "[1-3]", "regexp_matches(order_priority, '^[1-3]')"), ("greater_than", "totalprice", 100000, "totalprice > 100000"), ("less_than", "totalprice", 100000, "totalprice < 100000"),
    ("greater_equal", "order_priority", 1, "coalesce(try_cast(order_priority AS DOUBLE) >= 1, false)"), ("less_equal", "customer.balance", 0, "balance <= 0"),
]


@query(f"WITH {_CTX} " + " UNION ALL ".join(f"SELECT '{o}' AS operator, count(*) FILTER ({s}) AS hits, count(*) AS n FROM ctx" for o, _, _, s in _OPS))
def rules_operator_matrix(spark, d):
    """Every operator of the rule language on one row set, in one scan."""
    each = [F.struct(F.lit(o).alias("operator"), F.count_if(rules.leaf(f, o, v, True, KINDS)).alias("hits"), F.count(F.lit(1)).alias("n")) for o, f, v, _ in _OPS]
    return contexts(spark, d).agg(F.array(*each).alias("a")).select(F.inline("a"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') AND NOT (source = 'src0') GROUP BY 1")
def context_list_filter(spark, d):
    condition = rules.compile_tree([{"field": "tags", "operator": "contains", "value": "x"}], {"tags": "array"})
    docs = table(spark, d, "documents").withColumn("tags", F.array("source", F.when(F.col("lang").isin("en", "fr"), "x").otherwise("y")))
    return docs.where(condition & ~rules.leaf("source", "equals", "src0")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
