"""Kill classification: golden cases with rules from a file, and rules of every operator."""

import json

import pytest
from pyspark.sql import functions as F

from sievekit.operators import kills
from sievekit.operators import mutation as mu

RULES = {
    "keywords": {
        "PSQLI": ["sql", "string.*concat"], "CMDINJECT": ["command"], "PATHCONCAT": ["traversal", r"\\.\\./"], "EVALINJECT": ["eval"],
        "OPENREDIRECT": ["redirect"], "NOCERTVALID": ["certificate"], "INFOEXPOSE": ["expos"], "REGEXDOS": ["regex"], "MISSINGAUTH": ["authoriz"], "WEAKCRYPTO": ["md5"],
    },
    "payloads": {"RVALID": ["<script"], "PATHCONCAT": ["/etc/PASSWD"]},
    "mocks": {"PSQLI": {"db": ["last_query", "last_params"]}},
}

#: (operator, error, mock_access as JSON, kill_type, layer): golden cases.
GOLDEN = (
    ("PSQLI", "AssertionError: SQL injection detected", "{}", "semantic", "operator_keyword"),
    ("CMDINJECT", "AssertionError: Command injection in shell", "{}", "semantic", "operator_keyword"),
    ("PATHCONCAT", "AssertionError: path traversal detected", "{}", "semantic", "operator_keyword"),
    ("PSQLI", "AssertionError: test failed", '{"db": ["last_query", "last_params"]}', "semantic", "mock_observability"),
    ("PSQLI", "ImportError: No module named 'foo'", "{}", "crash", "crash"),
    ("PSQLI", "AssertionError: expected True, got False", "{}", "assertion_incidental", "none"),
    ("WEAKCRYPTO", "Failed: DID NOT RAISE <class 'ValueError'>", "{}", "functional", "functional"),
    ("WEAKCRYPTO", "AssertionError: assert '<script>' not in output", "{}", "assertion_incidental", "none"),
    ("RVALID", "AssertionError: assert '<script>' not in output", "{}", "semantic", "attack_payload"),
    ("PSQLI", "AssertionError: result is not secure enough", "{}", "semantic", "generic_keyword"),
    (None, "AssertionError: unsafe operation detected", "{}", "semantic", "generic_keyword"),
    ("EVALINJECT", "AssertionError: eval injection detected in code", "{}", "semantic", "operator_keyword"),
    ("OPENREDIRECT", "AssertionError: redirect URL not validated", "{}", "semantic", "operator_keyword"),
    ("NOCERTVALID", "AssertionError: SSL certificate verification disabled", "{}", "semantic", "operator_keyword"),
    ("INFOEXPOSE", "AssertionError: error message exposes stack trace", "{}", "semantic", "operator_keyword"),
    ("REGEXDOS", "AssertionError: regex pattern vulnerable to backtracking", "{}", "semantic", "operator_keyword"),
    ("MISSINGAUTH", "AssertionError: authorization check missing", "{}", "semantic", "operator_keyword"),
    ("PSQLI", "", "{}", "other", "none"),
    ("PSQLI", "ValueError: odd", "{}", "other", "none"),
    ("PSQLI", "E   error collecting tests", "{}", "crash", "crash"),
    ("PATHCONCAT", "AssertionError: read /etc/passwd", "{}", "semantic", "attack_payload"),
    ("PSQLI", "AssertionError: test failed", '{"db": ["other"], "fs": ["last_query"]}', "assertion_incidental", "none"),
    ("PSQLI", "AssertionError: one string was concatenated", None, "semantic", "operator_keyword"),
    ("NOSUCH", "AssertionError: sql", "{}", "assertion_incidental", "none"),
    ("PSQLI", None, None, "other", "none"),
)


@pytest.mark.parametrize("most", [0, kills.MAX_BROADCAST])
def test_golden(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(kills, "MAX_BROADCAST", most)
    (tmp_path / "rules.json").write_text(json.dumps(RULES))
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(GOLDEN)], "k int, operator string, error string, access string, want_type string, want_layer string")
    rows = rows.withColumn("mock_access", F.from_json("access", "map<string,array<string>>"))
    got = kills.classify(rows, kills.read_rules(spark, f"file://{tmp_path}/rules.json")).collect()
    assert len(got) == len(GOLDEN)
    for r in got:
        assert (r.kill_type, r.layer) == (r.want_type, r.want_layer), r.error


def test_every_operator_has_its_own_rules(spark, tmp_path):
    """An error that names one operator's word is semantic for that operator alone."""
    names = list(mu.TARGETS)
    rules = {"keywords": {n: [f"sign {k}\\b"] for k, n in enumerate(names)}, "payloads": {n: [f"Load-{k}!"] for k, n in enumerate(names)}, "mocks": {n: {"m": [n]} for n in names}}
    (tmp_path / "rules.json").write_text(json.dumps(rules))
    table = kills.read_rules(spark, f"file://{tmp_path}/rules.json")
    assert table.count() == 33
    rows = [(a, f"AssertionError: {text}", {"m": [b]} if not text else {}, a == b) for a in names for k, b in enumerate(names) for text in (f"Sign {k} here", f"load-{k}!", "")]
    got = kills.classify(spark.createDataFrame(rows, "operator string, error string, mock_access map<string,array<string>>, own boolean"), table)
    assert {(r.own, r.kill_type, r.layer) for r in got.collect()} == {
        (True, "semantic", "operator_keyword"), (True, "semantic", "attack_payload"), (True, "semantic", "mock_observability"), (False, "assertion_incidental", "none"),
    }
    hits = kills.mock_hits(spark.createDataFrame(rows, "operator string, error string, mock_access map<string,array<string>>, own boolean"), table)
    assert hits.count() == 33 and hits.where("own").count() == 33
