"""Edit rules with parentheses and ``not``, at all ages from -5 to 120."""

from riskspark.functions.rules import compile_rule, rule_fails_open, rule_holds

NESTED = {
    "(age >= 12 and age <= 55)": lambda a: 12 <= a <= 55,
    "(age < 1) or (age > 60)": lambda a: a < 1 or a > 60,
    "age >= 18 and (age < 65)": lambda a: 18 <= a < 65,
    "not age >= 18": lambda a: a < 18,
    "NOT (age > 40 or (age < 20))": lambda a: 20 <= a <= 40,
    "not not age > 5": lambda a: a > 5,
    "age > 3 or age < 1 and not (age != 0)": lambda a: a > 3 or a == 0,
    "(age = 5 or age = 7) and not age = 7": lambda a: a == 5,
    "((10 < age <= 20))": lambda a: 10 < a <= 20,
    "not (age 50+)": lambda a: a < 50,
    "(age > 12.5)": lambda a: a > 12.5,
    "(age) and age < 4": lambda a: a != 0 and a < 4,
    "not age < 10 and not age > 20 or (age = 99)": lambda a: 10 <= a <= 20 or a == 99,
    "not (age < 0 and age > 0)": lambda a: True,
    "(age < 0 and age > 0)": lambda a: False,
}
OPEN = ["(age > 1", "age >= 18 and ()", "not", "(age) age", "not adult", "age > 1)"]


def test_nested_rules(spark):
    rows = [(r, a) for r in NESTED for a in range(-5, 121)]
    table = spark.createDataFrame(rows, "rule string, age int").selectExpr("rule", "age", f"{compile_rule('rule')} AS c")
    got = {(r.rule, r.age): r.ok for r in table.selectExpr("rule", "age", f"{rule_holds('c', 'age')} AS ok").collect()}
    assert got == {(r, a): NESTED[r](a) for r, a in rows}


def test_what_cannot_be_read_holds_and_is_told(spark):
    table = spark.createDataFrame([(r, 30) for r in OPEN], "rule string, age int").selectExpr("rule", "age", f"{compile_rule('rule')} AS c")
    rows = table.selectExpr(f"{rule_holds('c', 'age')} AS ok", f"{rule_fails_open('rule', 'c')} AS open").collect()
    assert all(r.ok and r.open for r in rows)
