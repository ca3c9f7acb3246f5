"""Mutation rules: all forms of a query, weak algorithms, branches, odd code; and the table function in SQL."""

import pytest
from pyspark.sql import functions as F

from sievekit.functions.code import compiles, parsed
from sievekit.operators import audit
from sievekit.operators import mutation as mu
from sievekit.operators import similarity as si


def made(operator, code):
    return [(t, d) for _, t, d in mu.mutants(code, [r for r in mu.default_rules() if r.operator == operator])]


def test_query_with_a_literal():
    code = 'def get(user_id):\n    db.execute("SELECT * FROM users WHERE id = ? AND é = ?", (user_id, a.b["c"]))\n'
    head, tail = "def get(user_id):\n    db.execute(", ")\n"
    assert made("PSQLI", code) == [
        (head + "f'SELECT * FROM users WHERE id = {user_id} AND é = {a.b[\"c\"]}'" + tail, "[Variant 1] f-string: SELECT * FROM users WHERE id =..."),
        (head + "\"SELECT * FROM users WHERE id = \" + str(user_id) + \" AND é = \" + str(a.b[\"c\"]) + \"\"" + tail, "[Variant 2] Concatenation: SELECT * FROM users WHERE id =..."),
        (head + "\"SELECT * FROM users WHERE id = %s AND é = %s\" % (user_id, a.b[\"c\"],)" + tail, "[Variant 3] % formatting: SELECT * FROM users WHERE id =..."),
        (head + "\"SELECT * FROM users WHERE id = {} AND é = {}\".format(user_id, a.b[\"c\"])" + tail, "[Variant 4] .format(): SELECT * FROM users WHERE id =..."),
    ]


def test_query_with_percent_marks_and_a_list():
    assert [t for t, _ in made("PSQLI", "c.execute('SELECT 1 WHERE a = %s', [x])")] == [
        'c.execute(f"SELECT 1 WHERE a = {x}")', 'c.execute("SELECT 1 WHERE a = " + str(x) + "")', 'c.execute("SELECT 1 WHERE a = {}".format(x))',
    ]


def test_query_in_a_name():
    code = 'q = "SELECT {} WHERE a = ?"\nr = 1\nc.execute(q, (x,))\n'
    assert [t for t, _ in made("PSQLI", code)] == [
        'q = f"SELECT {{}} WHERE a = {x}"\nr = 1\nc.execute(q)\n', 'q = "SELECT {} WHERE a = " + str(x) + ""\nr = 1\nc.execute(q)\n',
        'q = "SELECT {} WHERE a = %s" % (x,)\nr = 1\nc.execute(q)\n', 'q = "SELECT {{}} WHERE a = {}".format(x)\nr = 1\nc.execute(q)\n',
    ]


@pytest.mark.parametrize("code", ["c.execute(q, (x,))", 'c.execute("SELECT 1")', 'c.execute("SELECT ?", x)', 'c.execute("SELECT 1", (x,))', 'c.execute("SELECT ?", ())', "def f(:"])
def test_no_query(code):
    assert made("PSQLI", code) == []


def test_weak_algorithms():
    code = "k = hashlib.pbkdf2_hmac('SHA512', p, salt=s, iterations=100000)\nb = gensalt(1, rounds=12)\nc = AES.new(k)\n"
    assert [d for _, d in made("WEAKCRYPTO", code)] == [
        "sha512 → md5 (case-insensitive)", "sha512 → sha1 (case-insensitive)", "AES → DES", "AES → RC4", "Removed salt from cryptographic operation",
        "Reduced iterations from 100000 to 1", "Removed rounds parameter", "Reduced rounds from 12 to 1",
    ]
    assert made("WEAKCRYPTO", "my_sha256x = 1\nrounds = 1\n") == []


def test_branches():
    code = "def f(u):\n    if u in ALLOWED_HOSTS:\n        a = 1\n        if a:\n            return redirect(u)\n    else:\n        raise ValueError(u)\n    return 0\n"
    assert ("def f(u):\n    a = 1\n    if a:\n        return redirect(u)\n    return 0\n", "Removed check with its other branch") in made("OPENREDIRECT", code)
    assert made("OPENREDIRECT", "if a:\n    b = 1\nelif u in ALLOWED:\n    c = 1\nelse:\n    d = 1\n") == []


DEEP = ["-" * 200_000 + "1", "a" + ".b" * 100_000, "(" * 50_000, "x = '\0'", "\ud800", "def f(:"]


@pytest.mark.parametrize("code", DEEP)
def test_odd_code_ends_no_job(code):
    assert isinstance(compiles(code), bool)
    parsed(code)
    assert all(compiles(t) for t, _ in made("PSQLI", code))


def test_odd_code_in_tables(spark):
    rows = spark.createDataFrame([(k, c, None) for k, c in enumerate(DEEP) if "\ud800" not in c], "id int, secure_code string, mutation_operators array<string>")
    assert mu.generate(rows).where("operator = 'PSQLI'").count() == 0
    found = rows.select(audit.py_compiles("secure_code"), audit.ast_counts("secure_code"), audit.rename_identifiers("secure_code", F.lit("x")), si.test_functions("secure_code"))
    assert len(found.collect()) == rows.count()


def test_table_function_in_sql(spark):
    mu.register(spark, name="my_mutants", most=3)
    spark.createDataFrame([(1, "h = hashlib.sha256(p)", ["WEAKCRYPTO"]), (2, "x = 1", None), (3, None, [])], "id int, code string, ops array<string>").createOrReplaceTempView("my_codes")
    got = spark.sql("SELECT id, m.seq, m.mutated_code AS c FROM my_codes, LATERAL my_mutants(code, ops) AS m").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "h = hashlib.md5(p)"), (1, 1, "h = hashlib.sha1(p)")]


def test_registry(spark):
    rows = {r.operator: r for r in mu.registry(spark).collect()}
    assert list(rows) == list(mu.TARGETS) and rows["WEAKCRYPTO"].kinds == ["all", "word"] and rows["PSQLI"].cwes == ["CWE-89"]
    assert sum(r.rules for r in rows.values()) == len(mu.default_rules())


def test_final_checks(spark):
    """Comments are a difference; only an entry point without parameters is told by its calls."""
    base = {"cwe": "CWE-1", "entry_point": "f", "secure_code": "def f():\n    return 1\n", "insecure_code": "def f():\n    return 2\n", "security_tests": "assert f() == 1"}
    cases = [
        ({}, None), ({"insecure_code": "def f():\n    return 1  # x\n"}, None), ({"insecure_code": "def  f():\n\n  return 1"}, "trivial_diff"),
        ({"security_tests": "assert f(1) == 1"}, "signature_mismatch"), ({"security_tests": "assert f ( 'a') == 1"}, "signature_mismatch"), ({"security_tests": "assert f([1]) == 1"}, None),
        ({"security_tests": "assert ef(1) == 1"}, None), ({"secure_code": "def f(a, b=2):\n    return 1\n", "security_tests": "assert f(1) == 1"}, None),
        ({"secure_code": "class C:\n    def f(self):\n        return 1\n", "security_tests": "assert C().f(x) == 1"}, "signature_mismatch"), ({"entry_point": ""}, None),
        ({"entry_point": "g", "security_tests": "assert g(1) == 1"}, None), ({"secure_code": " \n"}, "empty_code"),
    ]
    rows = [(k, *({**base, **c}[n] for n in base), want, True, 1, True, False) for k, (c, want) in enumerate(cases)]
    frame = spark.createDataFrame(rows, f"id int, {', '.join(f'{n} string' for n in base)}, want string, operators_apply boolean, n_mutants int, secure_passes boolean, insecure_passes boolean")
    assert [(r.id, r.drop_reason) for r in audit.final_reason(frame).orderBy("id").collect()] == [(k, want) for k, (_, want) in enumerate(cases)]


def test_blank_code_is_not_broken(spark):
    rows = spark.createDataFrame([("",), (" \n",), (None,), ("x = 1",), ("def f(:",)], "code string")
    assert [tuple(r) for r in rows.select(audit.broken("code"), audit.py_compiles("code")).collect()] == [(False, False), (False, False), (False, False), (False, True), (True, False)]
