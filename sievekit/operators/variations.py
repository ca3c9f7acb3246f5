"""Variations of a sample's codes by chains of named rewrites of their syntax trees.

A strategy is a name and the steps it takes, each a named rewrite of both codes and the entry point. Every
strategy gives a row: the variation with the steps that changed something, or why there is none.
Further strategies and domains are parameters.
"""

from __future__ import annotations

import ast
import hashlib
import io
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.code import compiles, parsed


@dataclass(frozen=True)
class Codes:
    """A sample's codes and entry point, and the seed of its hashed names."""

    secure: str
    insecure: str
    entry_point: str
    seed: str


Step = Callable[[Codes], Codes]

#: Words that names of a domain are made of.
DOMAINS = {
    "orders": "order invoice amount customer item basket receipt total".split(), "clinic": "patient record visit dose chart ward case note".split(),
    "stock": "shelf crate parcel depot label batch pallet count".split(), "mail": "letter sender topic folder draft reply header line".split(),
}
KEPT = frozenset({"self", "cls"})


def defined(code: str) -> list[str]:
    """Names of the functions, parameters and variables that code defines, as they come, attributes and imports left out."""
    tree = parsed(code)
    found = []
    for node in ast.walk(tree) if tree else ():
        name = node.name if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else node.arg if isinstance(node, ast.arg) else None
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            name = node.id
        if name and name not in KEPT and not (name.startswith("__") and name.endswith("__")):
            found.append((node.lineno, node.col_offset, name))
    return list(dict.fromkeys(name for _, _, name in sorted(found)))


class _Renamer(ast.NodeTransformer):
    def __init__(self, names: dict[str, str]) -> None:
        self.names = names

    def visit_Name(self, node: ast.Name) -> ast.AST:
        node.id = self.names.get(node.id, node.id)
        return node

    def visit_arg(self, node: ast.arg) -> ast.AST:
        self.generic_visit(node)
        node.arg = self.names.get(node.arg, node.arg)
        return node

    def visit_keyword(self, node: ast.keyword) -> ast.AST:
        self.generic_visit(node)
        node.arg = self.names.get(node.arg, node.arg) if node.arg else None
        return node

    def _function(self, node: ast.AST) -> ast.AST:
        self.generic_visit(node)
        node.name = self.names.get(node.name, node.name)
        return node

    visit_FunctionDef = visit_AsyncFunctionDef = _function


class _Bare(ast.NodeTransformer):
    """Without docstrings; ast.unparse() leaves out comments."""

    def _body(self, node: ast.AST) -> ast.AST:
        self.generic_visit(node)
        if node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
            node.body = node.body[1:] or [ast.Pass()]
        return node

    visit_Module = visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _body


def _rewritten(code: str, how: ast.NodeTransformer) -> str:
    """The code as it is if the tree stays the same."""
    tree, after = parsed(code), parsed(code)
    if tree is None:
        return code
    after = ast.fix_missing_locations(how.visit(after))
    return code if ast.dump(tree) == ast.dump(after) else ast.unparse(after)


def _commented(code: str) -> bool:
    try:
        return any(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError):
        return False


def renamed(codes: Codes, names: dict[str, str]) -> Codes:
    """The codes with names of the secure one replaced in both."""
    return Codes(_rewritten(codes.secure, _Renamer(names)), _rewritten(codes.insecure, _Renamer(names)), names.get(codes.entry_point, codes.entry_point), codes.seed) if names else codes


def domain(words: list[str]) -> Step:
    """Names made of a domain's words, a number after them from the second round on; names in use are not taken."""

    def step(codes: Codes) -> Codes:
        used = {n.id for c in (codes.secure, codes.insecure) if (t := parsed(c)) for n in ast.walk(t) if isinstance(n, ast.Name)}
        free = (w if not k else f"{w}_{k + 1}" for k in range(1 << 20) for w in words)
        free = (w for w in free if w not in used)
        return renamed(codes, dict(zip(defined(codes.secure), free, strict=False)))

    return step


def hashed(codes: Codes) -> Codes:
    """Names by the MD5 of the seed and the old name."""
    return renamed(codes, {n: f"v_{hashlib.md5(f'{codes.seed}{n}'.encode()).hexdigest()[:8]}" for n in defined(codes.secure)})


def bare(codes: Codes) -> Codes:
    """Without comments and docstrings."""

    def one(code: str) -> str:
        after = _rewritten(code, _Bare())
        tree = parsed(after)
        return ast.unparse(tree) if tree is not None and _commented(after) else after

    return replace(codes, secure=one(codes.secure), insecure=one(codes.insecure))


def wrapped(codes: Codes) -> Codes:
    """A function that hands everything on to the entry point, and is the new one."""
    if codes.entry_point not in defined(codes.secure):
        return codes
    name = f"handle_{codes.entry_point}"
    more = f"\n\n\ndef {name}(*args, **kwargs):\n    return {codes.entry_point}(*args, **kwargs)\n"
    return replace(codes, secure=codes.secure.rstrip() + more, insecure=codes.insecure.rstrip() + more, entry_point=name)


STEPS: dict[str, Step] = {"hashed": hashed, "bare": bare, "wrapped": wrapped} | {f"domain_{k}": domain(w) for k, w in DOMAINS.items()}
#: The steps of each strategy.
STRATEGIES = {
    "orders": ("domain_orders",), "clinic": ("domain_clinic",), "bare_stock": ("bare", "domain_stock"), "wrapped_mail": ("wrapped", "domain_mail"), "hashed_bare": ("hashed", "bare"),
}


def vary(codes: Codes, steps: tuple[str, ...], known: dict[str, Step] = STEPS) -> tuple[Codes | None, list[str], str | None]:
    """The variation, the steps that changed something, and why there is none."""
    if parsed(codes.secure) is None:
        return None, [], "secure code does not parse"
    if parsed(codes.insecure) is None:
        return None, [], "insecure code does not parse"
    now, done = codes, []
    for name in steps:
        after = known[name](now)
        if (after.secure, after.insecure) != (now.secure, now.insecure):
            done.append(name)
        now = after
    if not done or now.secure == codes.secure:
        return None, [], "nothing to change"
    if not (compiles(now.secure) and compiles(now.insecure)):
        return None, [], "variation does not compile"
    return now, done, None


def variations(samples: DataFrame, strategies: dict[str, tuple[str, ...]] = STRATEGIES, known: dict[str, Step] = STEPS) -> DataFrame:
    """id, strategy, secure_code, insecure_code, entry_point, steps, skipped: a row for each strategy of each sample.

    Codes are null where a strategy is skipped; null codes count as empty ones, which leave nothing to change.
    """
    chains = dict(strategies)

    @F.udtf(returnType="strategy string, new_secure string, new_insecure string, new_entry string, steps array<string>, skipped string")
    class Vary:
        def eval(self, secure: str, insecure: str, entry_point: str, seed: str) -> Iterator[tuple]:
            codes = Codes(secure or "", insecure or "", entry_point or "", seed or "")
            for name, steps in chains.items():
                made, done, why = vary(codes, steps, known)
                yield (name, made.secure, made.insecure, made.entry_point, done, None) if made else (name, None, None, None, [], why)

    rows = samples.select("id", "secure_code", "insecure_code", "entry_point")
    found = rows.lateralJoin(Vary(F.col("secure_code").outer(), F.col("insecure_code").outer(), F.col("entry_point").outer(), F.col("id").cast("string").outer()))
    return found.select("id", "strategy", F.col("new_secure").alias("secure_code"), F.col("new_insecure").alias("insecure_code"), F.col("new_entry").alias("entry_point"), "steps", "skipped")
