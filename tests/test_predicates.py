"""Proofs that a condition has no rows: sound for any selectors, conditions and rows."""

import random

import pytest

from popspark.model import Selector
from popspark.plans.predicates import And, Cmp, In, Not, Opaque, Or, contradicts, from_sql, impossible, key_literals, of_selectors


def holds(p, row):
    if isinstance(p, And):
        return holds(p.left, row) and holds(p.right, row)
    if isinstance(p, Or):
        return holds(p.left, row) or holds(p.right, row)
    if isinstance(p, Not):
        return not holds(p.inner, row)
    v = row[p.field.lower()]
    if isinstance(p, In):
        return (v in p.values) != p.negated
    q = p.value
    return {"=": v == q, "!=": v != q, ">": v > q, ">=": v >= q, "<": v < q, "<=": v <= q}[p.op]


def fits(s, row):
    v, x = row[s.field.lower()], s.list
    return {"eq": v == x[0], "in": v in x, "neq": v != x[0], "not_in": v not in x, "gt": v > x[0], "gte": v >= x[0], "lt": v < x[0], "lte": v <= x[0], "between": s.operator == "between" and x[0] <= v <= x[-1]}[s.operator]


def random_predicate(rng, depth=2):
    kind = rng.random()
    if depth and kind < 0.4:
        return rng.choice([And, Or])(random_predicate(rng, depth - 1), random_predicate(rng, depth - 1))
    if depth and kind < 0.5:
        return Not(random_predicate(rng, depth - 1))
    f = rng.choice(["x", "Y"])
    if kind < 0.7:
        return In(f, tuple(rng.sample(range(8), rng.randint(1, 3))), rng.random() < 0.3)
    return Cmp(f, rng.choice(["=", "!=", ">", ">=", "<", "<="]), rng.randint(0, 7))


def test_no_proof_is_ever_wrong():
    rng, proofs = random.Random(5), 0
    rows = [{"x": x, "y": y} for x in range(8) for y in range(8)]
    for _ in range(4000):
        selectors = []
        for i in range(rng.randint(1, 2)):
            op = rng.choice(["eq", "in", "neq", "not_in", "gt", "gte", "lt", "lte", "between"])
            values = sorted(rng.sample(range(8), 2)) if op in ("in", "not_in", "between") else rng.randint(0, 7)
            selectors.append(Selector(str(i), rng.choice(["X", "y"]), op, values))
        p = random_predicate(rng)
        if impossible(selectors, p):
            proofs += 1
            assert not any(all(fits(s, r) for s in selectors) and holds(p, r) for r in rows), (selectors, p)
    assert proofs > 200


@pytest.mark.parametrize(
    ("selector", "predicate", "proof"),
    [
        (("eq", "A"), Cmp("c", "=", "B"), True),
        (("eq", "A"), Cmp("c", "=", "A"), False),
        (("eq", "A"), Cmp("c", "!=", "A"), True),
        (("in", [1, 2]), In("c", (3, 4)), True),
        (("in", [1, 2]), In("c", (3, 4), True), False),
        (("in", [1, 2]), Cmp("c", ">", 2), True),
        (("in", [1, 2]), Cmp("c", "<=", 0), True),
        (("between", [40, 75]), Cmp("c", "<", 40), True),
        (("between", [40, 75]), Cmp("c", "<=", 40), False),
        (("between", [40, 75]), Cmp("c", ">=", 76), True),
        (("gt", 5), Cmp("c", "=", 5), True),
        (("gte", 5), Cmp("c", "=", 5), False),
        (("gte", 5), Cmp("c", "<", 5), True),
        (("lt", 5), Cmp("c", ">=", 5), True),
        (("lte", 5), Cmp("c", ">", 5), True),
        (("neq", 5), Cmp("c", "=", 5), False),
        (("between", [40, 75]), Cmp("c", "=", 65.0), False),
        (("eq", 65), Cmp("c", "=", 65.0), False),
        (("eq", "65"), Cmp("c", "=", 65), False),
        (("eq", 1), Opaque("c = 2"), False),
    ],
)
def test_table(selector, predicate, proof):
    assert contradicts(Selector("s", "C", *selector), predicate) is proof


def test_exclusions_never_prune():
    assert not contradicts(Selector("s", "c", "eq", 1, is_exclusion=True), Cmp("c", "=", 2))


def test_key_literals():
    k = lambda p: key_literals(p, "id")
    assert k(Cmp("ID", "=", 42)) == [42] and k(In("id", (1, 2, 3))) == [1, 2, 3]
    assert k(And(Cmp("id", "=", 42), Cmp("id", "=", 99))) == [42, 99] and k(And(Cmp("id", "=", 42), Cmp("x", "=", 1))) == [42]
    assert k(Cmp("x", "=", 1)) is None and k(In("id", (1,), True)) is None
    assert k(Or(Cmp("id", "=", 1), In("id", (2,)))) == [1, 2] and k(Or(Cmp("id", "=", 1), Cmp("x", "=", 2))) is None


def test_sql_is_read_by_sparks_parser(spark):
    assert from_sql(spark, "5 < a AND b IN ('x', 'y') OR NOT (c = -2.5)") == Or(And(Cmp("a", ">", 5), In("b", ("x", "y"))), Cmp("c", "!=", -2.5))
    assert isinstance(from_sql(spark, "a LIKE 'x%'"), Opaque) and from_sql(spark, "a NOT IN (1, 2)") == In("a", (1, 2), True)
    df = spark.createDataFrame([(1, "x"), (7, "y"), (None, "x")], "a int, b string")
    for text in ("a > 2 OR b = 'x'", "NOT (a = 1)", "a BETWEEN 0 AND 3", "a IS NULL"):
        assert sorted(map(str, df.where(from_sql(spark, text).column()).collect())) == sorted(map(str, df.where(text).collect()))


def test_selectors_join_by_logic_and_exclusions_apart():
    a, b, c = Selector("a", "x", "eq", 1), Selector("b", "y", "gt", 2), Selector("c", "z", "eq", 3, is_exclusion=True)
    assert of_selectors([a, b, c], "OR") == And(Or(Cmp("x", "=", 1), Cmp("y", ">", 2)), Not(Cmp("z", "=", 3)))
    assert of_selectors([]) == Opaque("true")


COLUMNS = {
    "date": (["2024-01-01", "2024-01-15", "2024-01-31", "2024-02-01"], ["2024-01-15", "2024-1-15", "2024-01-31 00:00:00", "2024-01-31", "2023-12-31"]),
    "timestamp_ntz": (["2024-01-01 00:00:00", "2024-01-15 12:00:00", "2024-01-31 00:00:00"], ["2024-01-15", "2024-01-31 00:00:00", "2024-1-31", "2024-01-15 12:00:00"]),
    "timestamp": (["2024-01-01 00:00:00", "2024-01-31 00:00:00"], ["2024-01-31", "2024-01-01 00:00:00"]),
    "int": (["5", "10", "20", "100"], ["5", "20", "010", " 10", "100", 5, 20, 9.5]),
    "decimal(12,2)": (["0.10", "5.00", "20.50"], [0.1, 5, 20, 20.5, "5"]),
    "double": (["0.1", "5", "20.5"], [0.1, 5, 20, 20.5]),
    "string": (["10", "5", "B", "b"], ["10", "5", "B", "a", "010"]),
}


@pytest.mark.parametrize("kind", COLUMNS)
def test_no_proof_is_wrong_for_typed_columns(spark, kind):
    """Against Spark's own comparison of columns of that type with literals of several forms."""
    values, literals = COLUMNS[kind]
    rng = random.Random(len(kind))
    df = spark.createDataFrame([(v,) for v in values], "t string").selectExpr(f"cast(t AS {kind}) AS c").cache()
    proofs, checked = 0, []
    for _ in range(150):
        op = rng.choice(["eq", "in", "gt", "gte", "lt", "lte", "between"])
        picked = [rng.choice(literals) for _ in range(2)] if op in ("in", "between") else rng.choice(literals)
        s, p = Selector("s", "c", op, picked), Cmp("c", rng.choice(["=", "!=", ">", ">=", "<", "<="]), rng.choice(literals))
        if impossible([s], p, {"c": kind}):
            proofs += 1
            checked.append((s, p))
    for s, p in checked:
        fitting = df.where(of_selectors([s]).column())
        assert fitting.where(p.column()).isEmpty(), (s, p)
    assert (proofs > 3) == (kind != "timestamp")
    df.unpersist()


def test_scans_and_sql_keep_rows_that_other_forms_of_a_literal_match(spark, tmp_path):
    from popspark.model import Definition
    from popspark.plans.catalog import Catalog
    from popspark.sources import package

    days = spark.createDataFrame([("2024-01-15",), ("2024-01-31",)], "t string").selectExpr("cast(t AS date) AS d", "t AS k")
    january = Selector("s", "d", "between", ["2024-01-01", "2024-01-31"])
    package.write_package(spark, str(tmp_path / "c/a"), Definition("a", selectors=(january,)), {"Days": days}, index="k")
    later = spark.createDataFrame([("2024-03-01",)], "t string").selectExpr("cast(t AS date) AS d", "t AS k")
    package.write_package(spark, str(tmp_path / "c/b"), Definition("b", selectors=(Selector("s", "d", "gte", "2024-02-01"),)), {"Days": later}, index="k")
    c = Catalog(spark, str(tmp_path / "c"))
    for where, n, scans in (("d = '2024-1-15'", 1, 2), ("d = '2024-01-31 00:00:00'", 1, 2), ("d = '2024-01-31'", 1, 1), ("d > '2024-02-15'", 1, 1), ("k = '2024-03-01'", 1, 1), ("d = '2025-01-01'", 0, 1)):
        assert c.scan("Days", where).count() == n and c.sql(f"SELECT * FROM days WHERE {where}").count() == n
        plan = c.sql(f"SELECT d FROM days WHERE {where}")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") <= scans
    both = "SELECT a.d FROM days a JOIN days b ON a.d < b.d WHERE a.d = '2024-01-15' AND b.d = '2024-03-01'"
    assert c.sql(both).count() == 1 and c.sql("SELECT count(*) AS n FROM days").first().n == 3
