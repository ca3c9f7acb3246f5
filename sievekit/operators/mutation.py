"""Mutation operators as a rule table, applied by a table function of Spark.

A rule rewrites text by a regular expression, everywhere ("all") or at one match a
mutant ("each"), or a word ("word": whatever its case if the code does not have it as it stands),
or works on if statements whose condition matches: "drop" removes them, "dead" makes their
body pass, "else" leaves of an if with an else its first branch. "query" rewrites calls of
execute with parameters. A mutant counts if it differs from the code and compiles under
this Python. PSQLI and WEAKCRYPTO have all their rewrites, the other operators their main
ones; further ones can be given as a parameter.

mutant_table() is the table function: generate() joins it laterally, and after register() SQL does,
as in SELECT * FROM samples, LATERAL mutants(secure_code, mutation_operators).
"""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievekit.functions.code import compiles, parsed
from sievekit.functions.text import mutant_id, variant_type


@dataclass(frozen=True)
class Rule:
    """One rewrite of an operator."""

    operator: str
    kind: str
    pattern: str
    replacement: str
    description: str


#: Weaknesses that each operator aims at: fixed values.
TARGETS = {
    "PSQLI": "CWE-89", "RVALID": "CWE-20 CWE-79 CWE-89", "INPUTVAL": "CWE-20", "SUBDOMAIN_SPOOF": "CWE-20 CWE-918", "RHTTPO": "CWE-1004",
    "WEAKCRYPTO": "CWE-327 CWE-328", "HARDCODE": "CWE-798 CWE-259", "RMAUTH": "CWE-287 CWE-306", "PATHCONCAT": "CWE-22 CWE-73",
    "CMDINJECT": "CWE-78 CWE-77", "RENCRYPT": "CWE-319 CWE-311", "DESERIAL": "CWE-502 CWE-94", "SSRF": "CWE-918", "IDOR": "CWE-639 CWE-284",
    "XXE": "CWE-611", "SSTI": "CWE-1336 CWE-94", "CORS_WEAK": "CWE-942 CWE-346", "CSRF_REMOVE": "CWE-352", "WEAKRANDOM": "CWE-338 CWE-330 CWE-331",
    "EVALINJECT": "CWE-95", "LOGINJECT": "CWE-117", "OPENREDIRECT": "CWE-601", "NOCERTVALID": "CWE-295", "FILEUPLOAD": "CWE-434",
    "INFOEXPOSE": "CWE-200 CWE-209", "WEAKKEY": "CWE-326", "LDAPINJECT": "CWE-90", "XMLBOMB": "CWE-776", "REGEXDOS": "CWE-1333 CWE-400",
    "CREDEXPOSE": "CWE-522", "WEAKPASSREQ": "CWE-521", "MISSINGAUTH": "CWE-862 CWE-863", "HTTPRS": "CWE-113",
}

_ALL = {
    "RVALID": [(r"\b(?:html\.)?escape\(([^()]*)\)", r"\1", "Removed escape() validation"), (r"\bautoescape\s*=\s*True", "autoescape=False", "Disabled template autoescaping")],
    "RHTTPO": [(r"(?i),\s*httponly\s*=\s*True", "", "Removed HttpOnly flag from cookie"), (r"(?i)httponly\s*=\s*True", "httponly=False", "Changed HttpOnly=True to HttpOnly=False")],
    "WEAKCRYPTO": [
        (r",\s*salt\s*=\s*[^,)]+", "", "Removed salt from cryptographic operation"), (r"iterations\s*=\s*(\d+)", "iterations=1", r"Reduced iterations from \1 to 1"),
        (r",\s*rounds\s*=\s*(\d+)", "", "Removed rounds parameter"), (r",\s*rounds\s*=\s*(0*[2-9]\d*|0*1\d+)\b", ", rounds=1", r"Reduced rounds from \1 to 1"),
    ],
    "PATHCONCAT": [
        (r"\.resolve\(\)", "", "[Easy] Removed .resolve() - path not canonicalized"), (r"\.resolve\(\)", ".absolute()", "[Medium] Replaced .resolve() with .absolute() (no symlink resolution)"),
        (r"os\.path\.(?:realpath|abspath)\(([^()]*)\)", r"str(\1)", "[Medium] Replaced os.path.realpath with str() (identity)"),
        (r"os\.path\.join\(([^(),]+),\s*([^(),]+)\)", r"\1 + '/' + \2", "[Hard] Replaced os.path.join with string concatenation"),
    ],
    "CMDINJECT": [
        (r"shell\s*=\s*False", "shell=True", "[Variant 1] Changed shell=False to shell=True"), (r"shlex\.quote\(([^()]*)\)", r"\1", "[Variant 6] Removed shlex.quote"),
        (r"subprocess\.run\(\s*\[([^\]]*)\][^()]*\)", r"os.system(' '.join([\1]))", "[Variant 4] Replaced subprocess with os.system"),
    ],
    "RENCRYPT": [
        (r"verify\s*=\s*True", "verify=False", "Changed verify=True to verify=False"), (r"https://", "http://", "Replaced https with http"),
        (r"check_hostname\s*=\s*True", "check_hostname = False", "Disabled hostname checking"),
    ],
    "DESERIAL": [
        (r"\bjson\.loads\(", "pickle.loads(", "json.loads → pickle.loads"), (r"\bjson\.loads\(", "eval(", "json.loads → eval"), (r"\bjson\.load\(", "pickle.load(", "json.load → pickle.load"),
        (r"\byaml\.safe_load\(", "yaml.unsafe_load(", "yaml.safe_load → yaml.unsafe_load"), (r"\bSafeLoader\b", "UnsafeLoader", "SafeLoader → UnsafeLoader"),
        (r"\bast\.literal_eval\(", "eval(", "ast.literal_eval → eval"),
    ],
    "XXE": [
        (r"resolve_entities\s*=\s*False", "resolve_entities=True", "Enabled resolve_entities in XML parser"), (r"no_network\s*=\s*True", "no_network=False", "Disabled no_network restriction"),
        (r"load_dtd\s*=\s*False", "load_dtd=True", "Enabled DTD loading"), (r"\bdefusedxml\b", "xml", "Replaced defusedxml with standard xml library"),
    ],
    "SSTI": [(r"\bautoescape\s*=\s*True", "autoescape=False", "Disabled template autoescaping"), (r"\bSandboxedEnvironment\b", "Environment", "Replaced SandboxedEnvironment with Environment")],
    "CSRF_REMOVE": [
        (r"(?m)^[ \t]*@csrf_protect[ \t]*\n", "", "Removed @csrf_protect decorator"), (r"(?:hmac\.|secrets\.)?compare_digest\(([^(),]+),\s*([^(),]+)\)", r"(\1 == \2)", "Replaced compare_digest with == (timing attack)"),
    ],
    "EVALINJECT": [(r"\bast\.literal_eval\(", "eval(", "ast.literal_eval → eval (code injection)"), (r"\bsafe_eval\(", "eval(", "safe_eval → eval"), (r"\bjson\.loads\(", "eval(", "json.loads → eval (code injection)")],
    "LOGINJECT": [(r"""\.replace\(\s*["']\\[rn]["']\s*,\s*["'][^"']*["']\s*\)""", "", "Removed newline sanitization from log input"), (r"re\.sub\([^,()]+,\s*[^,()]+,\s*([^,()]+)\)", r"\1", "Removed re.sub sanitization from log input")],
    "NOCERTVALID": [
        (r"verify\s*=\s*True", "verify=False", "Disabled SSL certificate verification"), (r"\bCERT_REQUIRED\b", "CERT_NONE", "Changed CERT_REQUIRED to CERT_NONE"),
        (r"ssl\.create_default_context\(\)", "ssl._create_unverified_context()", "Replaced secure SSL context with unverified context"),
    ],
    "LDAPINJECT": [(r"\bescape_(?:filter_chars|rdn)\(([^()]*)\)", r"\1", "Removed LDAP filter escaping")],
    "XMLBOMB": [
        (r"\bdefusedxml\b", "xml", "Replaced defusedxml with vulnerable xml.etree"), (r"huge_tree\s*=\s*False", "huge_tree=True", "Enabled huge_tree (allows entity expansion)"),
        (r"resolve_entities\s*=\s*False", "resolve_entities=True", "Enabled entity resolution"),
    ],
    "HTTPRS": [(r"""\.replace\(\s*["']\\[rn](?:\\n)?["']\s*,\s*["']["']\s*\)""", "", "Removed CRLF sanitization from headers")],
    "INFOEXPOSE": [(r"\bDEBUG\s*=\s*False", "DEBUG = True", "Enabled DEBUG mode (information exposure)"), (r"debug\s*=\s*False", "debug=True", "Enabled DEBUG mode (information exposure)")],
    "CREDEXPOSE": [(r"bcrypt\.hashpw\(([^,()]+(?:\([^()]*\))?),[^()]*(?:\([^()]*\))?\)", r"\1", "Stored password in plaintext instead of bcrypt hash")],
    "REGEXDOS": [(r"re\.escape\(([^()]*)\)", r"\1", "Removed re.escape() allowing user-controlled regex (ReDoS)"), (r"\.read\(\d[\d_]*\)", ".read()", "Removed read size limit")],
}
_EACH = {
    "HARDCODE": [
        (r"""os\.environ\[\s*["'](\w+)["']\s*\]""", '"hardcoded_secret"', "[Easy] Replaced os.environ with hardcoded value"),
        (r"""os\.environ\.get\(\s*["'](\w+)["'][^()]*\)""", '"hardcoded_secret"', "[Medium] Replaced os.environ.get with hardcoded value"),
        (r"""os\.getenv\(\s*["'](\w+)["'][^()]*\)""", '"hardcoded_secret"', "[Medium] Replaced os.getenv() with hardcoded credential"),
    ],
    "RMAUTH": [
        (r"(?m)^[ \t]*@(?:login_required|require_auth|permission_required)\b[^\n]*\n", "", "Removed auth decorator"),
        (r"(?:request\.user|current_user)\.is_authenticated", "True", "Replaced is_authenticated with True"),
    ],
    "CORS_WEAK": [(r"""(Access-Control-Allow-Origin["']\]?\s*[=:,]\s*)["'][^"'*]+["']""", r"\1'*'", "Changed CORS origin to wildcard *"), (r"supports_credentials\s*=\s*False", "supports_credentials=True", "Enabled CORS credentials")],
    "WEAKRANDOM": [
        (r"secrets\.token_bytes\(([^()]*)\)", r"random.randbytes(\1)", "Replaced secrets.token_bytes with weak random.randbytes"), (r"secrets\.token_hex\(([^()]*)\)", r"'%x' % random.getrandbits(64)", "Replaced secrets.token_hex with weak random.getrandbits"),
        (r"secrets\.choice\(", "random.choice(", "Replaced secrets.choice with weak random.choice"), (r"os\.urandom\(([^()]*)\)", r"random.randbytes(\1)", "Replaced os.urandom with weak random.randbytes"),
        (r"\bSystemRandom\b", "Random", "Replaced SystemRandom with weak Random"),
    ],
    "WEAKKEY": [(r"(key_size\s*=\s*)(?:[1-9]\d{3,})", r"\g<1>512", "Reduced key_size to 512 bits"), (r"(RSA\.generate\()\d{4,}", r"\g<1>512", "Reduced RSA key to 512 bits")],
    "MISSINGAUTH": [(r"\b0o600\b", "0o777", "Weakened file permissions 0o600 → 0o777"), (r"\b0o700\b", "0o777", "Weakened directory permissions 0o700 → 0o777"), (r"\b\w+\.is_admin\b", "True", "Bypassed .is_admin check with True")],
    "SSRF": [(r"\bis_safe_url\([^()]*\)", "True", "[Hard] Bypassed URL validation function")],
    "IDOR": [(r"\b\w+\.has_permission\([^()]*\)", "True", "Replaced has_permission() with True")],
    "OPENREDIRECT": [(r"\burl_has_allowed_host_and_scheme\([^()]*(?:\([^()]*\))?[^()]*\)", "True", "Removed url_has_allowed_host check")],
    "FILEUPLOAD": [(r"\ballowed_file\([^()]*\)", "True", "Replaced extension check with True")],
    "SUBDOMAIN_SPOOF": [(r"\bis_(?:valid|allowed)_domain\([^()]*\)", "True", "[Hard] Replaced domain check with True")],
}
#: Names of algorithms and the weak ones that take their place: fixed values.
WEAK = {
    "sha256": ("md5", "sha1"), "sha384": ("md5", "sha1"), "sha512": ("md5", "sha1"), "sha3_256": ("md5", "sha1"), "sha3_512": ("md5", "sha1"),
    "AES": ("DES", "RC4"), "Fernet": ("DES", "RC4"),
}
#: Conditions of the ifs of which an operator leaves the first branch.
_BRANCHES = {
    "OPENREDIRECT": r"^[\w.]+ in \w*(?:allow|ALLOW|safe|SAFE|trusted|TRUSTED|whitelist)\w*$", "MISSINGAUTH": r"is_admin|\.role\b|has_perm|is_authenticated",
}
#: Conditions of the guards that an operator removes.
_GUARDS = {
    "INPUTVAL": r"isinstance|len\(|not in range|[<>]|re\.(?:match|fullmatch)|^not \w+$", "SUBDOMAIN_SPOOF": r"endswith|allowed_domains|netloc|hostname",
    "RVALID": r"re\.(?:match|fullmatch|search)|valid", "RMAUTH": r"authenticated|session|token|password", "PATHCONCAT": r"startswith|\.\.|is_relative_to|parents",
    "SSRF": r"hostname|netloc|scheme|blocked|allowed", "IDOR": r"owner|user_id|\.user\b|permission", "CSRF_REMOVE": r"csrf", "OPENREDIRECT": r"netloc|safe|startswith|scheme|ALLOWED",
    "FILEUPLOAD": r"endswith|extension|mime|content_type|ALLOWED", "REGEXDOS": r"len\(|size", "WEAKPASSREQ": r"len\(\s*\w*pass\w*\s*\)|isupper|isdigit|islower", "MISSINGAUTH": r"admin|role|owner|permission",
    "EVALINJECT": r"allowed|re\.(?:match|fullmatch)|isinstance", "CORS_WEAK": r"origin", "DESERIAL": r"!!python|startswith", "LDAPINJECT": r"re\.match|isalnum",
}


def default_rules() -> list[Rule]:
    """The rules in the order of TARGETS."""
    out = []
    for name in TARGETS:
        if name == "PSQLI":
            out.append(Rule(name, "query", r"\.execute\s*\(", "", ""))
        if name == "WEAKCRYPTO":
            out += [Rule(name, "word", strong, weak, f"{strong} → {weak}") for strong, others in WEAK.items() for weak in others]
        out += [Rule(name, "all", *x) for x in _ALL.get(name, [])]
        out += [Rule(name, "each", *x) for x in _EACH.get(name, [])]
        if name in _GUARDS:
            out.append(Rule(name, "drop", _GUARDS[name], "", "Removed check"))
            out.append(Rule(name, "dead", _GUARDS[name], "", "Dead check (pass instead of raise)"))
        if name in _BRANCHES:
            out.append(Rule(name, "else", _BRANCHES[name], "", "Removed check with its other branch"))
    return out


def _ifs(code: str, pattern: str, branches: bool) -> Iterator[ast.If]:
    """If statements whose condition matches: with an else, or without one and ending in raise or return."""
    tree = parsed(code)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, ast.If) and bool(node.orelse) == branches and (branches or isinstance(node.body[-1], ast.Raise | ast.Return)):
            if re.search(pattern, ast.get_source_segment(code, node.test) or ""):
                yield node


def _first_branches(code: str, pattern: str) -> Iterator[str]:
    """The code with one matching if and its else replaced by its first branch; an elif is left alone."""
    lines = code.split("\n")
    for node in _ifs(code, pattern, True):
        if lines[node.lineno - 1].lstrip().startswith("elif"):
            continue
        body = textwrap.dedent("\n".join(lines[node.body[0].lineno - 1 : node.body[-1].end_lineno]))
        yield "\n".join([*lines[: node.lineno - 1], textwrap.indent(body, " " * node.col_offset), *lines[node.end_lineno :]])


def _quoted(text: str) -> str:
    """A string literal, in double quotes where that needs no escapes."""
    return f'"{text}"' if text.isprintable() and not set(text) & set('"\\') else repr(text)


#: How a query with parameters is put together instead: fixed names of the variants.
_FORMS = ("f-string", "Concatenation", "% formatting", ".format()")


def _forms(query: str, mark: str, values: list[str]) -> Iterator[tuple[str, str]]:
    """Expressions that put values into a query at its marks, with the variant's name."""
    parts = query.split(mark, len(values))
    values = values[: len(parts) - 1]
    braced = [p.replace("{", "{{").replace("}", "}}") for p in parts]
    inner = "".join(p + "{" + v + "}" for p, v in zip(braced, values, strict=False)) + braced[-1]
    yield _FORMS[0], "f" + _quoted(inner)
    yield _FORMS[1], " + ".join(x for p, v in zip(parts, values, strict=False) for x in (_quoted(p), f"str({v})")) + " + " + _quoted(parts[-1])
    if mark == "?":
        yield _FORMS[2], f"{_quoted('%s'.join(p.replace('%', '%%') for p in parts))} % ({', '.join(values)},)"
    yield _FORMS[3], f"{_quoted('{}'.join(braced))}.format({', '.join(values)})"


def _queries(code: str) -> Iterator[tuple[str, str]]:
    """Code and variant: each execute call with a query and parameters, the query put together from them.

    The query is a literal in the call, or a name that the code assigns a literal; its marks are ? or %s.
    """
    tree = parsed(code)
    if tree is None:
        return
    data = code.encode()
    starts = [0, *(k + 1 for k, c in enumerate(data) if c == 10)]

    def span(node: ast.expr) -> tuple[int, int]:
        return starts[node.lineno - 1] + node.col_offset, starts[node.end_lineno - 1] + node.end_col_offset

    nodes = list(ast.walk(tree))
    literals = {n.targets[0].id: n.value for n in reversed(nodes) if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and _is_text(n.value)}
    for call in nodes:
        if not (isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "execute" and len(call.args) == 2):
            continue
        query, given = call.args
        literal = query if _is_text(query) else literals.get(query.id) if isinstance(query, ast.Name) else None
        if literal is None or not isinstance(given, ast.Tuple | ast.List) or not given.elts:
            continue
        mark = next((m for m in ("?", "%s") if m in literal.value), None)
        if mark is None:
            continue
        values = [data[slice(*span(v))].decode() for v in given.elts]
        said = f"query '{query.id}'" if isinstance(query, ast.Name) else f"{literal.value[:30]}..."
        for k, (name, form) in enumerate(_forms(literal.value, mark, values)):
            edits = sorted([(*span(literal), form.encode()), (span(query)[1], span(given)[1], b"")], reverse=True)
            out = data
            for begin, end, new in edits:
                out = out[:begin] + new + out[end:]
            yield out.decode(), f"[Variant {k + 1}] {name}{'' if mark == '?' else ' from %s'}: {said}"


def _is_text(node: ast.expr) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


def apply(rule: Rule, code: str) -> Iterator[tuple[str, str]]:
    """The texts that a rule makes of code, not yet checked, with what was done."""
    if rule.kind == "query":
        yield from _queries(code)
    elif rule.kind == "word":
        as_it_stands = rule.pattern in code
        pattern = re.compile(rf"\b{re.escape(rule.pattern)}\b", 0 if as_it_stands else re.IGNORECASE)
        yield pattern.sub(rule.replacement, code), rule.description + ("" if as_it_stands else " (case-insensitive)")
    elif rule.kind == "all":
        if m := re.search(rule.pattern, code):
            yield re.sub(rule.pattern, rule.replacement, code), m.expand(rule.description) if "\\" in rule.description else rule.description
    elif rule.kind == "each":
        for m in re.finditer(rule.pattern, code):
            yield code[: m.start()] + m.expand(rule.replacement) + code[m.end() :], rule.description
    elif rule.kind == "else":
        for text in _first_branches(code, rule.pattern):
            yield text, rule.description
    else:
        lines = code.split("\n")
        for node in _ifs(code, rule.pattern, False):
            first, last = node.lineno - 1, node.end_lineno
            indent = " " * node.body[0].col_offset
            middle = [] if rule.kind == "drop" else [*lines[first : node.body[0].lineno - 1], f"{indent}pass"]
            yield "\n".join([*lines[:first], *middle, *lines[last:]]), rule.description


def mutants(code: str, rules: Iterable[Rule], most: int | None = None) -> list[tuple[str, str, str]]:
    """operator, code, description of valid mutants: cut at most, then one a text."""
    out: list[tuple[str, str, str]] = []
    for rule in rules:
        for text, done in apply(rule, code):
            if text != code and compiles(text):
                out.append((rule.operator, text, done))
                if most is not None and len(out) >= most:
                    return list({t: (o, t, d) for o, t, d in reversed(out)}.values())[::-1]
    first: dict[str, tuple[str, str, str]] = {}
    for o, t, d in out:
        first.setdefault(t, (o, t, d))
    return list(first.values())


def mutant_table(rules: list[Rule] | None = None, most: int | None = 30):
    """The table function: (code, operators) -> seq, operator, mutated_code, description; operators null or empty: all."""
    table = rules or default_rules()

    class Mutants:
        def eval(self, code: str, operators: list[str]) -> Iterator[tuple[int, str, str, str]]:
            wanted = set(operators or TARGETS)
            for k, (o, t, d) in enumerate(mutants(code or "", [r for r in table if r.operator in wanted], most)):
                yield k, o, t, d

    return F.udtf(Mutants, returnType="seq int, operator string, mutated_code string, description string")


def register(spark: SparkSession, rules: list[Rule] | None = None, most: int | None = 30, name: str = "mutants") -> None:
    """Make the table function known to SQL."""
    spark.udtf.register(name, mutant_table(rules, most))


def generate(samples: DataFrame, rules: list[Rule] | None = None, most: int | None = 30) -> DataFrame:
    """Mutants of samples (id, secure_code, mutation_operators; empty or null: all operators).

    Columns: id, seq, mutant_id, operator, mutated_code, description, variant_type.
    """
    made = mutant_table(rules, most)
    found = samples.select("id", "secure_code", "mutation_operators").lateralJoin(made(F.col("secure_code").outer(), F.col("mutation_operators").outer()))
    return found.select(
        "id", "seq", mutant_id(F.col("operator"), F.col("mutated_code")).alias("mutant_id"), "operator", "mutated_code", "description",
        variant_type(F.col("description")).alias("variant_type"),
    )


def dedup(rows: DataFrame) -> DataFrame:
    """The first mutant of each text of a sample."""
    rank = F.row_number().over(W.partitionBy("id", "mutated_code").orderBy("seq"))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def operators_of(samples: DataFrame) -> DataFrame:
    """id, cwe, seq, operator by the target table: one row an operator."""
    spark = samples.sparkSession
    pairs = [(c, k, o) for k, (o, cs) in enumerate(TARGETS.items()) for c in cs.split()]
    table = spark.createDataFrame(pairs, "cwe string, seq int, operator string")
    return samples.select("id", "cwe").join(F.broadcast(table), "cwe")


def validity(rows: DataFrame) -> DataFrame:
    """Total and compilable mutants by operator and (where rows have one) cwe, and the least text that is not."""

    @F.pandas_udf("boolean")
    def ok(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: compiles(c or ""))

    keys = ["operator", *(c for c in ("cwe",) if c in rows.columns)]
    judged = rows.withColumn("_ok", ok("mutated_code"))
    return judged.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("_ok").alias("compilable"), F.min(F.when(~F.col("_ok"), F.col("mutated_code"))).alias("broken"))


def applies(rule: Rule, code: str) -> bool:
    """Whether a rule finds something to rewrite."""
    if rule.kind == "word":
        return rule.pattern.lower() in code.lower()
    if rule.kind in ("all", "each", "query"):
        return re.search(rule.pattern, code) is not None
    return next(_ifs(code, rule.pattern, rule.kind == "else"), None) is not None


def applicable(samples: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """id, operator: the operators that find something in a sample's secure_code, of its weakness (cwe) where it has one, else of all."""
    table = rules or default_rules()

    @F.udtf(returnType="operator string")
    class Applicable:
        def eval(self, code: str, cwe: str) -> Iterator[tuple[str]]:
            for name in TARGETS:
                if (not cwe or cwe in TARGETS[name].split()) and any(applies(r, code or "") for r in table if r.operator == name):
                    yield (name,)

    return samples.select("id", "secure_code", "cwe").lateralJoin(Applicable(F.col("secure_code").outer(), F.col("cwe").outer())).select("id", "operator")


def registry(spark: SparkSession, rules: list[Rule] | None = None) -> DataFrame:
    """operator, cwes, rules, kinds: what is known of each operator, one row a name."""
    table = rules or default_rules()
    rows = [(n, c.split(), sum(r.operator == n for r in table), sorted({r.kind for r in table if r.operator == n})) for n, c in TARGETS.items()]
    return spark.createDataFrame(rows, "operator string, cwes array<string>, rules int, kinds array<string>")


def diagnose(samples: DataFrame, rules: list[Rule] | None = None, most: int | None = 30) -> DataFrame:
    """id, cwe, applying (operators of the sample's weakness that find something), producing (those with mutants), mutants."""
    table = rules or default_rules()

    @F.pandas_udf("applying array<string>, producing array<string>, mutants int")
    def run(codes: pd.Series, cwes: pd.Series) -> pd.DataFrame:
        out = []
        for code, cwe in zip(codes, cwes, strict=True):
            own = [r for r in table if cwe in TARGETS[r.operator].split()]
            found = mutants(code or "", own, most)
            out.append((sorted({r.operator for r in own if applies(r, code or "")}), sorted({o for o, _, _ in found}), len(found)))
        return pd.DataFrame(out, columns=["applying", "producing", "mutants"])

    return samples.select("id", "cwe", run("secure_code", "cwe").alias("d")).select("id", "cwe", "d.*")


def diagnosis(rows: DataFrame) -> DataFrame:
    """By cwe: samples, those that no operator applies to, those without mutants, and mutants in all."""
    return rows.groupBy(F.coalesce("cwe", F.lit("unknown")).alias("cwe")).agg(
        F.count("*").alias("total_samples"), F.count_if(F.size("applying") == 0).alias("no_applies"),
        F.count_if(F.size("producing") == 0).alias("no_mutants"), F.sum(F.col("mutants").cast("bigint")).alias("total_mutants"),
    )
