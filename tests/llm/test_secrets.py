"""Secret scans: base spans against Python's expressions, the battery on drawn tokens."""

import base64
import hashlib
import random
import re
import string

from pyspark.sql import functions as F

from sievekit.llm import secrets as s

BASE = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    None, "", "password=hunter22 x", "token: abc", "secret=token:abcdefg", 'Api_Key = "abc.def-123"', "é password:ab_cd==ef \U0001f600 token=zzzzzz",
    "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIAAKIA" + "C" * 20, "x" + "0123456789abcdef" * 2, "0123456789abcdef0123456", "\x01password=aaaaaa\x02",
    "secret='AKIA" + "D" * 20 + "' tail", "passwd passwd=abcdef passwd=abcdefgh", "a\nb\nsecret =  k1k2k3k4",
]


def base(text):
    out = [(m.start(), 0, m.end()) for m in BASE.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: [tuple(x) for x in r.base_spans] for r in s.find(docs).collect()}
    assert got == {k: base(t or "") for k, t in enumerate(TEXTS)}


def test_query_digest(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in s.op4_secret_scans(spark, str(tmp_path)).collect():
        want = ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in base(TEXTS[r.doc_id] or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base(TEXTS[r.doc_id] or "")) for i in range(3))


def drawn():
    rng = random.Random(3)
    words = [w for n in (24, 30, 44, 60) for w in ("thereandtionwithofintheesanerhaation" * 3)[n % 7 : n % 7 + n].split()]
    words += ["550e8400-e29b-41d4-a716-446655440000", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "2024-01-15T10-22-33Z_backup_file", "/usr/lib/x86_64-linux-gnu/libc/so"]
    words += ["aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "getUserAccountNameFromDatabaseById", "path/to/some/file/in/the/tree/of/files", "1111111111222222222233333333"]
    tokens = [base64.b64encode(rng.randbytes(n)).decode().rstrip("=") for n in (24, 30, 36, 48, 60) for _ in range(6)]
    return words, tokens


def test_battery_tells_random_from_words(spark):
    words, tokens = drawn()
    rows = [(k, f"see {t} here") for k, t in enumerate(words + tokens)]
    found = {r.doc_id: [tuple(x) for x in r.spans] for r in s.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert not any(kind == 3 for k in range(len(words)) for _, kind, _ in found[k])
    hit = sum(found[k] == [(4, 3, 4 + len(t))] for k, t in enumerate(tokens, len(words)))
    assert hit >= 0.9 * len(tokens)


ALPHABETS = {
    "upper hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
}


def test_detection_by_encoding_and_length(spark):
    """Most drawn tokens reach the discovery control with a small p-value, and few fail the tests of randomness."""
    rng = random.Random(7)
    rows = [(name, n, "".join(rng.choices(chars, k=n))) for name, chars in ALPHABETS.items() for n in (20, 24, 32, 64) for _ in range(100)]
    out = spark.createDataFrame(rows, "name string, n int, t string").select("name", "n", s.battery(F.col("t")).alias("b"))
    for r in out.groupBy("name", "n").agg(F.avg((F.col("b.score") >= 3).cast("int")).alias("power"), F.avg((F.col("b.random") < -2).cast("int")).alias("off")).collect():
        assert r.power >= 0.85 and r.off <= 0.08, r


def test_ordinary_model_is_a_distribution():
    table = s._ordinary_table()
    for before in range(len(s.AFTER)):
        assert abs(sum(10 ** row[before] for row in table.values()) - 1) < 1e-9


def test_limits_equal_benjamini_hochberg(spark):
    rng = random.Random(2)
    tried = [[(0, 1, rng.randrange(3), rng.choice([0, 0, 0, 3, 12, 25, 40, 60]))] * rng.randint(0, 3) for _ in range(300)]
    table = spark.createDataFrame([(x,) for x in tried], "_tried array<struct<s:int,e:int,c:int,bin:int>>")
    want = {}
    for c in range(3):
        p = sorted(10.0 ** (-x[3] / s.BINS_PER_DECADE) for row in tried for x in row if x[2] == c)
        passing = [k for k, v in enumerate(p, 1) if v <= 0.05 * k / len(p)]
        if passing:
            want[c] = p[max(passing) - 1]
    got = {c: 10.0 ** (-b / s.BINS_PER_DECADE) for c, b in s.limits(table, 0.05).items()}
    assert got.keys() == want.keys() and want and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_many_spans_in_one_text(spark):
    """Offsets over many blocks, tokens between base spans, and masks, against Python."""
    rng = random.Random(9)
    parts = []
    for _ in range(3000):
        parts.append(rng.choice(["".join(rng.choices("0123456789abcdef", k=32)), "token=abcdefgh", "word", "".join(rng.choices(string.ascii_letters + "0123456789", k=40))]))
        parts.append(rng.choice([" ", "  ", "é", "\U0001f600", "/"]))
    text = "".join(parts)
    found = s.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    own = base(text)
    assert [tuple(x) for x in found.base_spans] == own
    rest = [(a, b) for a, k, b in found.spans if k == 3]
    tokens = {(m.start(), m.end()) for m in re.finditer(s.TOKEN, text)}
    free = {(a, b) for a, b in tokens if not any(x < b and a < y for x, _, y in own)}
    assert set(rest) <= free and len(rest) > 0.9 * len(free) > 100
    want, at = [], 0
    for a, _, b in found.spans:
        if a >= at:
            want += [text[at:a], "<SECRET>"]
        at = max(at, b)
    got = s.redact(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().text
    assert got == "".join(want) + text[at:]


def test_battery_on_a_very_long_token(spark):
    token = base64.b64encode(random.Random(1).randbytes(60_000)).decode()
    row = spark.createDataFrame([(token,)], "t string").select(s.battery(F.col("t")).alias("b")).first().b
    assert row.n == len(token) and abs(row.z_runs) < 4 and abs(row.z_serial) < 4


def test_redact(spark):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(TEXTS)], "doc_id bigint, text string, spans int, _doc string")
    out = s.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[2] == "<SECRET> x" and got[3] == "token: abc"
    assert got[13] == "<SECRET>' tail" and got[12] == "\x01<SECRET>\x02"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert s.find(docs).count() == 0 and s.redact(docs).count() == 0
