"""Variations: what each step does, what is kept apart, and that variations still do the same."""

import pytest

from sievekit.functions.code import compiles
from sievekit.operators import variations as va

SECURE = '''import os

def load(path, mode="r"):
    """Read it."""
    base = os.path.basename(path)  # cut
    def inner(x):
        return x + base
    return inner(x=mode)
'''
INSECURE = SECURE.replace("os.path.basename(path)", "path")


def run(code, name, *args):
    space = {}
    exec(compile(code, "<test>", "exec"), space)  # noqa: S102
    return space[name](*args)


@pytest.mark.parametrize("strategy", va.STRATEGIES)
def test_variations_do_the_same(strategy):
    made, steps, why = va.vary(va.Codes(SECURE, INSECURE, "load", "7"), va.STRATEGIES[strategy])
    assert why is None and steps == list(va.STRATEGIES[strategy])
    for old, new in ((SECURE, made.secure), (INSECURE, made.insecure)):
        assert compiles(new) and new != old and run(new, made.entry_point, "/a/b", "w") == run(old, "load", "/a/b", "w")


def test_steps():
    codes = va.Codes(SECURE, INSECURE, "load", "7")
    assert va.defined(SECURE) == ["load", "path", "mode", "base", "inner", "x"]
    assert "def order(invoice, amount='r')" in va.STEPS["domain_orders"](codes).secure
    assert va.bare(codes).secure.count("Read") == 0 and "cut" not in va.bare(codes).secure
    assert va.wrapped(codes).entry_point == "handle_load" and va.wrapped(va.Codes(SECURE, INSECURE, "no", "")).entry_point == "no"
    assert va.hashed(codes).entry_point.startswith("v_") and va.hashed(codes) != va.hashed(va.Codes(SECURE, INSECURE, "load", "8"))
    taken = va.domain(["order"])(va.Codes("def f(a):\n    return order + a", "", "f", ""))
    assert taken.secure == "def order_2(order_3):\n    return order + order_3" and taken.entry_point == "order_2"


def test_what_is_skipped(spark):
    rows = [
        (1, SECURE, INSECURE, "load"), (2, "def broken(:", "x = 1", "f"), (3, "x.y = 1", "def broken(:", "f"), (4, None, None, None), (5, "print(1)", "print(2)", ""),
        (6, "-" * 200_000 + "1", "x = 1", "f"), (1, SECURE, INSECURE, "load"),
    ]
    frame = spark.createDataFrame(rows, "id int, secure_code string, insecure_code string, entry_point string").selectExpr("*", "1 AS strategy", "2 AS steps")
    got = va.variations(frame).collect()
    assert len(got) == len(rows) * len(va.STRATEGIES)
    why = {(r.id, r.strategy): r.skipped for r in got}
    assert {why[1, s] for s in va.STRATEGIES} == {None} and {why[2, s] for s in va.STRATEGIES} == {"secure code does not parse"} == {why[6, s] for s in va.STRATEGIES}
    assert {why[3, s] for s in va.STRATEGIES} == {"insecure code does not parse"} and {why[4, s] for s in va.STRATEGIES} == {why[5, s] for s in va.STRATEGIES} == {"nothing to change"}
    assert all((r.secure_code is None) == (r.skipped is not None) == (not r.steps) for r in got)
