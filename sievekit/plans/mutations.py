"""Each mutation operator on programs of its own that quote the documents' texts, with the mutants written down by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import mutation as mu
from sievekit.plans.rules import literal
from sievekit.session import table

_GUARD = "def f(x):\n    if not isinstance(x, str):\n        raise ValueError('no')\n    return x\n"
#: Operator, code, its mutants.
CASES = (
    ("PSQLI", 'cur.execute("SELECT a FROM t WHERE b = ?", (b,))', ('cur.execute(f"SELECT a FROM t WHERE b = {b}")', 'cur.execute("SELECT a FROM t WHERE b = " + str(b) + "")', 'cur.execute("SELECT a FROM t WHERE b = %s" % (b,))', 'cur.execute("SELECT a FROM t WHERE b = {}".format(b))')),
    ("RVALID", "y = html.escape(x)", ("y = x",)),
    ("INPUTVAL", _GUARD, ("def f(x):\n    return x\n", "def f(x):\n    if not isinstance(x, str):\n        pass\n    return x\n")),
    ("SUBDOMAIN_SPOOF", "if not host.endswith(d):\n    raise ValueError(1)\nx = 1\n", ("x = 1\n", "if not host.endswith(d):\n    pass\nx = 1\n")),
    ("RHTTPO", "r.set_cookie('a', b, httponly=True)", ("r.set_cookie('a', b)", "r.set_cookie('a', b, httponly=False)")),
    ("WEAKCRYPTO", "h = hashlib.sha256(p)", ("h = hashlib.md5(p)", "h = hashlib.sha1(p)")),
    ("HARDCODE", 'k = os.environ["KEY"]', ('k = "hardcoded_secret"',)),
    ("RMAUTH", "@login_required\ndef f():\n    pass\n", ("def f():\n    pass\n",)),
    ("PATHCONCAT", "p = base.resolve()", ("p = base", "p = base.absolute()")),
    ("CMDINJECT", "subprocess.call(c, shell=False)", ("subprocess.call(c, shell=True)",)),
    ("RENCRYPT", "requests.get(u, verify=True)", ("requests.get(u, verify=False)",)),
    ("DESERIAL", "y = yaml.safe_load(s)", ("y = yaml.unsafe_load(s)",)),
    ("SSRF", "ok = is_safe_url(u)", ("ok = True",)),
    ("IDOR", "ok = user.has_permission(p)", ("ok = True",)),
    ("XXE", "p = XMLParser(resolve_entities=False)", ("p = XMLParser(resolve_entities=True)",)),
    ("SSTI", "e = SandboxedEnvironment()", ("e = Environment()",)),
    ("CORS_WEAK", "h['Access-Control-Allow-Origin'] = 'https://a.b'", ("h['Access-Control-Allow-Origin'] = '*'",)),
    ("CSRF_REMOVE", "ok = hmac.compare_digest(a, b)", ("ok = (a == b)",)),
    ("WEAKRANDOM", "k = secrets.choice(x)", ("k = random.choice(x)",)),
    ("EVALINJECT", "v = ast.literal_eval(s)", ("v = eval(s)",)),
    ("LOGINJECT", "log.info(m.replace('\\n', ''))", ("log.info(m)",)),
    ("OPENREDIRECT", "ok = url_has_allowed_host_and_scheme(u, h)", ("ok = True",)),
    ("NOCERTVALID", "c.verify_mode = ssl.CERT_REQUIRED", ("c.verify_mode = ssl.CERT_NONE",)),
    ("FILEUPLOAD", "ok = allowed_file(n)", ("ok = True",)),
    ("INFOEXPOSE", "app.run(debug=False)", ("app.run(debug=True)",)),
    ("WEAKKEY", "k = RSA.generate(2048)", ("k = RSA.generate(512)",)),
    ("LDAPINJECT", "f = escape_filter_chars(x)", ("f = x",)),
    ("XMLBOMB", "p = XMLParser(huge_tree=False)", ("p = XMLParser(huge_tree=True)",)),
    ("REGEXDOS", "re.compile(re.escape(x))", ("re.compile(x)",)),
    ("CREDEXPOSE", "h = bcrypt.hashpw(p, bcrypt.gensalt())", ("h = p",)),
    ("WEAKPASSREQ", "if len(password) < 12:\n    raise ValueError(1)\nx = 1\n", ("x = 1\n", "if len(password) < 12:\n    pass\nx = 1\n")),
    ("MISSINGAUTH", "os.chmod(p, 0o600)", ("os.chmod(p, 0o777)",)),
    ("HTTPRS", "h = v.replace('\\r\\n', '')", ("h = v",)),
)


def _samples(s, d):
    """A program for each document: one of the cases, and the text in a string of its own."""
    names, codes = (F.array(*(F.lit(x[k]) for x in CASES)) for k in (0, 1))
    cwes = F.array(*(F.lit(mu.TARGETS[x[0]].split()[0]) for x in CASES))
    at = (F.col("doc_id") % len(CASES) + 1).cast("int")
    said = F.concat(F.lit("\nnote = '"), F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", " "), F.lit("'\n"))
    return table(s, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.element_at(codes, at), said).alias("secure_code"), F.array(F.element_at(names, at)).alias("mutation_operators"), F.element_at(cwes, at).alias("cwe")
    )


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


#: Operators of the case's first weakness that find something in it, where it is not the case's own alone.
APPLICABLE: dict[str, tuple[str, ...]] = {}
_EXPECTED = [(k, name, mu.TARGETS[name].split()[0], code, j, "pass_variant" if "pass\nx" in code or "pass\n    return" in code else "removal") for k, (name, _, codes) in enumerate(CASES) for j, code in enumerate(codes)]
_MUTANTS = f"""made AS (SELECT doc_id AS id, operator, cwe, seq, kind, code || chr(10) || 'note = ' || chr(39) || regexp_replace(coalesce(text, ''), '[^A-Za-z ]', ' ', 'g') || chr(39) || chr(10) AS mutated_code
  FROM documents JOIN ({_values(_EXPECTED, 'k, operator, cwe, code, seq, kind')}) AS e ON doc_id % {len(CASES)} = k)"""


def _by_sql(s, d):
    """The table function in SQL."""
    mu.register(s, name="sievekit_mutants")
    _samples(s, d).createOrReplaceTempView("sievekit_samples")
    return s.sql("SELECT id, m.operator, md5(m.mutated_code) AS h FROM sievekit_samples, LATERAL sievekit_mutants(secure_code, mutation_operators) AS m")


QUERIES = {
    "u14_mutants": lambda s, d: mu.generate(_samples(s, d)).select("id", "operator", F.md5(F.col("mutated_code").cast("binary")).alias("h"), "seq"),
    "u14_mutants_by_sql": _by_sql,
    "u14_variant_types": lambda s, d: mu.generate(_samples(s, d)).groupBy("operator", "variant_type").agg(F.count("*").alias("n")),
    "u14_applicable": lambda s, d: mu.applicable(_samples(s, d)),
    "a15_mutant_validity": lambda s, d: mu.validity(mu.generate(_samples(s, d)).join(_samples(s, d).select("id", "cwe"), "id")),
}

ORACLE = {
    "u14_mutants": f"WITH {_MUTANTS} SELECT id, operator, md5(mutated_code) AS h, seq FROM made",
    "u14_mutants_by_sql": f"WITH {_MUTANTS} SELECT id, operator, md5(mutated_code) AS h FROM made",
    "u14_variant_types": f"WITH {_MUTANTS} SELECT operator, kind AS variant_type, count(*) AS n FROM made GROUP BY 1, 2",
    "u14_applicable": f"SELECT DISTINCT doc_id AS id, operator FROM documents JOIN ({_values([(k, o) for k, (name, code, _) in enumerate(CASES) for o in APPLICABLE.get(name, (name,))], 'k, operator')}) AS e ON doc_id % {len(CASES)} = k",
    "a15_mutant_validity": f"WITH {_MUTANTS} SELECT operator, cwe, count(*) AS total, count(*) AS compilable, CAST(NULL AS VARCHAR) AS broken FROM made GROUP BY 1, 2",
}
