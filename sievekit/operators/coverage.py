"""Line coverage from sets of lines, and what a function's parameters are for."""

from __future__ import annotations

import ast
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.functions.code import parsed


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def executable_lines(code: pd.Series) -> pd.Series:
    """Numbers of the lines on which a node of the syntax tree begins, strings that stand alone left out but for what they hold.

    Of code that doesn't parse the lines that are neither blank nor comments.
    """

    def one(text: str) -> list[int]:
        tree = parsed(text)
        if tree is None:
            return [k for k, line in enumerate(text.split("\n"), 1) if line.strip() and not line.strip().startswith("#")]
        alone = lambda n: isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)
        return sorted({n.lineno for n in ast.walk(tree) if hasattr(n, "lineno") and not alone(n)})

    return code.map(lambda text: one(text or ""))


def line_coverage(samples: DataFrame, executed: DataFrame) -> DataFrame:
    """id, lines_total, lines_covered, line_coverage (0.0 without lines) of samples (id, code), from executed lines (id, line).

    Lines that are not executable don't count, nor does a line count twice.
    """
    lines = samples.select("id", F.explode_outer(executable_lines("code")).alias("line"))
    ran = executed.select("id", "line").distinct().withColumn("ran", F.lit(True))
    found = lines.join(ran, ["id", "line"], "left").groupBy("id").agg(F.count("line").alias("lines_total"), F.count("ran").alias("lines_covered"))
    share = F.when(F.col("lines_total") > 0, F.col("lines_covered") / F.col("lines_total")).otherwise(0.0)
    return found.withColumn("line_coverage", share)


#: Names of parameters that take what users send, and of those that take the program's own objects; types of the latter: fixed values.
TAINTED = tuple(
    "user_input input data payload query value name username user email password pwd url path filename file filepath command cmd xml json_data body "
    "content text message comment title search q term param arg host hostname address ip token key secret api_key table column field heading header "
    "subject label description html html_content markup template display_name full_name first_name last_name bio about summary snippet excerpt post "
    "article blog entry note".split()
)
OWN_OBJECTS = tuple(
    "connection conn cursor db database session sess transaction tx request req response res config cfg settings options opts context ctx app env "
    "environment logger log account_id user_id profile_id owner_id author_id active_user_id current_user_id requester_id account_role user_role role".split()
)
OWN_TYPES = ("connection", "cursor", "session", "request", "response", "config")


def typed_parameters(code: Column, name: Column) -> Column:
    """Array of (name, type, default) of the first function of a name, as its text has them; self, cls and starred ones left out.

    Parameters are parted by commas wherever they are, and a default ends at the next one.
    """
    inside = F.call_function("regexp_extract", code, F.concat(F.lit(r"def\s+\Q"), name, F.lit(r"\E\s*\(([^)]*)\)")), F.lit(1))

    def trimmed(text: Column) -> Column:
        return F.btrim(text, F.lit(" \t\n\r\f\v"))

    def one(text: Column) -> Column:
        before = F.split_part(text, F.lit("="), F.lit(1))
        default = F.when(text.contains("="), trimmed(F.substring(text, F.instr(text, F.lit("=")) + 1, F.length(text))))
        kind = F.when(before.contains(":"), trimmed(F.substring(before, F.instr(before, F.lit(":")) + 1, F.length(before))))
        return F.struct(trimmed(F.split_part(before, F.lit(":"), F.lit(1))).alias("name"), kind.alias("type"), default.alias("default"))

    parts = F.transform(F.split(inside, ","), trimmed)
    own = F.filter(parts, lambda p: (p != "") & ~p.isin("self", "cls") & ~p.startswith("*"))
    found = F.filter(F.transform(own, one), lambda p: p["name"] != "")
    return F.when((F.coalesce(code, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != ""), found).otherwise(F.array().cast("array<struct<name:string,type:string,default:string>>"))


def parameter_class(name: Column, kind: Column) -> Column:
    """tainted, infrastructure or unknown, by a parameter's name and type."""
    low, types = F.lower(name), F.lower(F.coalesce(kind, F.lit("")))
    own = low.isin(*OWN_OBJECTS) | reduce(lambda a, b: a | b, (types.contains(t) for t in OWN_TYPES))
    return F.when(own, "infrastructure").when(low.isin(*TAINTED), "tainted").otherwise("unknown")


def classified_parameters(code: Column, name: Column) -> Column:
    """typed_parameters() with each one's class."""
    return F.transform(typed_parameters(code, name), lambda p: F.struct(p["name"].alias("name"), p["type"].alias("type"), p["default"].alias("default"), parameter_class(p["name"], p["type"]).alias("class")))
