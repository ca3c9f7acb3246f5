"""N-gram contamination audits, corpus fingerprints, temporal and novelty filters, perturbation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.session import written

WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
CVE = r"CVE-(\d{4})-\d+"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once a row, however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _runs(size: Column, n: int, piece: Callable[[Column], Column], kind: str = "string") -> Column:
    found = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), piece)
    return F.when(size >= n, F.array_distinct(found)).otherwise(F.array().cast(f"array<{kind}>"))


def windows(items: Column, n: int) -> Column:
    """Distinct runs of n elements of an array as text; empty where there are fewer."""
    return once(items, lambda w: _runs(F.size(w), n, lambda i: F.array_join(F.slice(w, i, n), " ")))


def char_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct character n-grams of lower-cased text with white space runs as one space."""
    t = F.split(F.regexp_replace(F.lower(text), r"\s+", " "), "")
    return once(t, lambda w: _runs(F.size(w), n, lambda i: F.array_join(F.slice(w, i, n), "")))


def token_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct n-grams of lower-cased tokens: word runs or single marks, joined by a space."""
    return windows(_tokens(text), n)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_MARK), F.lit(0))


def gram_hashes(text: Column, n: int = 5) -> Column:
    """The distinct n-grams of token_ngrams() as 64-bit hashes, without their strings."""
    return once(_tokens(text), lambda w: _runs(F.size(w), n, lambda i: F.xxhash64(F.slice(w, i, n)), "bigint"))


def jaccard(one: Column, two: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements; 0.0 if either is empty."""
    both = F.size(F.array_intersect(one, two))
    return F.when((F.size(one) == 0) | (F.size(two) == 0), F.lit(0.0)).otherwise(both * 1.0 / (F.size(one) + F.size(two) - both))


def ngram_rows(rows: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """A row for each distinct token n-gram of each text, with their number."""
    grams = rows.select(id_col, token_ngrams(F.col(text_col), n).alias("grams"))
    # explode() would make Catalyst add a filter that works the n-grams out a second time.
    return grams.select(id_col, F.size("grams").alias("n_grams"), F.explode_outer("grams").alias("gram")).where("gram IS NOT NULL")


def hash_rows(rows: DataFrame, id_col: str, text_col: str, n: int = 5) -> DataFrame:
    """A row for each distinct token n-gram of each text, as its hash h, with their number."""
    grams = rows.select(id_col, gram_hashes(F.col(text_col), n).alias("grams"))
    return grams.select(id_col, F.size("grams").alias("n_grams"), F.explode_outer("grams").alias("h")).where("h IS NOT NULL")


#: Most n-grams of a corpus (a hash, an id and a number each) that are broadcast; beyond, both sides are dealt by hash.
MAX_BROADCAST = 1_000_000


def overlaps(samples: DataFrame, corpus: DataFrame, n: int = 5) -> DataFrame:
    """Jaccard similarity of each sample (id, code) and corpus text (item_id, text) that share an n-gram.

    An equi-join on the n-grams' 64-bit hashes; counts are combined before the shuffle by pair, and a small
    corpus goes to the samples, whose n-grams are then not dealt at all.
    """
    a = hash_rows(samples, "id", "code", n)
    b = hash_rows(corpus, "item_id", "text", n).withColumnRenamed("n_grams", "n_item")
    if b.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        b = F.broadcast(b)
    pairs = a.join(b, "h").groupBy("id", "item_id", "n_grams", "n_item").agg(F.count("*").alias("shared"))
    return pairs.select("id", "item_id", "shared", (F.col("shared") * 1.0 / (F.col("n_grams") + F.col("n_item") - F.col("shared"))).alias("overlap"))


def audit(samples: DataFrame, corpus: DataFrame, n: int = 5, threshold: float = 0.3) -> DataFrame:
    """Every sample with its largest overlap, and whether that reaches the threshold."""
    most = overlaps(samples, corpus, n).groupBy("id").agg(F.max("overlap").alias("overlap"))
    found = samples.select("id").join(most, "id", "left")
    return found.select("id", F.coalesce("overlap", F.lit(0.0)).alias("overlap")).withColumn("flagged", F.col("overlap") >= threshold)


def audit_summary(audited: DataFrame) -> DataFrame:
    """Flagged samples, their rate and the mean overlap."""
    return audited.agg(
        F.count("*").alias("total"), F.count_if("flagged").alias("flagged"),
        F.coalesce(F.avg(F.col("flagged").cast("int")), F.lit(0.0)).alias("rate"), F.avg("overlap").alias("avg_overlap"),
    )


def fingerprint(samples: DataFrame, n: int = 5, least: int = 3, most: int = 10_000) -> DataFrame:
    """The n-grams of least samples and more, the most frequent first; the limit is the feature.

    Hashes are counted, a sample that has one kept with it. Those as frequent as the last that fits are
    looked up in their samples, as n-grams of one frequency are in the order of their text.
    """
    hashed = samples.select("id", F.explode(gram_hashes(F.col("code"), n)).alias("h"))
    counts = hashed.groupBy("h").agg(F.count("*").alias("df"), F.min("id").alias("id")).where(F.col("df") >= least)
    counts = written(counts, "fingerprint")
    by_df = counts.groupBy("df").agg(F.count("*").alias("n")).orderBy(F.desc("df")).limit(most).collect()
    total, cut = 0, least
    for r in by_df:
        total, cut = total + r["n"], r["df"]
        if total >= most:
            break
    wanted = counts.where(F.col("df") >= cut)
    grams = samples.join(wanted.select("id").distinct(), "id", "left_semi").select("id", token_ngrams(F.col("code"), n).alias("g"), gram_hashes(F.col("code"), n).alias("k"))
    # Distinct strings and distinct hashes of a text are in one order.
    found = grams.select("id", F.explode(F.arrays_zip("g", "k")).alias("x")).select("id", F.col("x.g").alias("gram"), F.col("x.k").alias("h"))
    return found.join(wanted, ["id", "h"]).select("gram", "df").orderBy(F.desc("df"), "gram").limit(most)


def cve_year(*texts: Column) -> Column:
    """The year of the first CVE id, looking at one text after the other; null without any."""
    years = [F.nullif(F.regexp_extract(t, CVE, 1), F.lit("")).cast("int") for t in texts]
    return F.coalesce(*years)


def temporal_halves(rows: DataFrame, texts: list[str], cutoff: int = 2024) -> tuple[DataFrame, DataFrame]:
    """Rows from the cutoff year on (or without a year), and the rest."""
    passes = F.coalesce(cve_year(*(F.col(t) for t in texts)) >= cutoff, F.lit(True))
    return rows.where(passes), rows.where(~passes)


def novelty(samples: DataFrame, novel: list[str], known: dict[str, str], least: float = 0.3) -> DataFrame:
    """Origins: counts and shares by bucket, and whether enough is novel."""
    bucket = F.when(F.col("source").isin(*novel), "novel")
    for source, name in known.items():
        bucket = bucket.when(F.col("source") == source, name)
    counts = samples.select(bucket.otherwise("adapted_other").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    every = W.partitionBy()
    share = F.col("n") * 1.0 / F.sum("n").over(every)
    new = F.sum(F.when(F.col("bucket") == "novel", F.col("n")).otherwise(0)).over(every)
    return counts.select("bucket", "n", share.alias("ratio"), (new * 1.0 / F.sum("n").over(every) >= least).alias("enough_novel"))


def modify_comments(code: Column) -> Column:
    """Drop comments that a line ends with, unless an odd number of either quote stands before; lines of comment go."""

    def cut(line: Column) -> Column:
        head = F.substring_index(line, "#", 1)
        closed = F.lit(True)
        for quote in ("\"", "'"):
            closed = closed & ((F.length(head) - F.length(F.replace(head, F.lit(quote)))) % 2 == 0)
        return F.when(line.contains("#") & closed, F.regexp_replace(head, r"\s+$", "")).otherwise(line)

    kept = F.filter(F.split(code, "\n"), lambda x: ~x.rlike(r"^\s*#"))
    return F.array_join(F.transform(kept, cut), "\n")


def swap_quotes(code: Column) -> Column:
    """Double-quoted literals without quotes or escapes inside become single-quoted."""
    return F.regexp_replace(code, "\"([^\"\\\\']+)\"", "'$1'")


def identifiers(code: Column) -> Column:
    """The distinct identifiers of a text, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]*)"), F.lit(1)))


def new_identifiers(code: Column, known: Column) -> Column:
    """Those of code that an array of known names lacks."""
    return F.array_except(identifiers(code), known)


def restructure(code: Column) -> Column:
    """Rewrite two forms of conditions to equal ones."""
    negated = F.regexp_replace(code, r"if not (\w+):", "if $1 is None or not $1:")
    return F.regexp_replace(negated, r"if (\w+) == True:", "if $1:")


def rename(code: Column, names: dict[str, str]) -> Column:
    """Replace whole words by a fixed map, all at once: what one name becomes is not another's old name."""
    order = sorted(names, key=lambda k: (-len(k), k))
    for k, old in enumerate(order):
        code = F.regexp_replace(code, rf"(?<![\p{{L}}\p{{N}}_]){re.escape(old)}(?![\p{{L}}\p{{N}}_])", f"\ue000{k}\ue001")
    for k, old in enumerate(order):
        code = F.replace(code, F.lit(f"\ue000{k}\ue001"), F.lit(names[old]))
    return code


#: Rewrites of how code does a thing, by weakness and name: patterns and replacements are fixed values.
STRUCTURES = {
    "CWE-89": {
        "sql_direct_execute": [(r"\bdb\.execute\b", "conn.execute")],
        "sql_cursor_based": [(r"(\s*)(\w+)\s*=\s*db\.execute\((.+?)\)", "$1cursor = db.cursor()\n$1cursor.execute($3)\n$1$2 = cursor.fetchall()")],
        "sql_context_manager": [(r"(?s)(def \w+\([^)]*\):)\n(\s+)(.+db\.execute.+)", "$1\n$2with db.connection() as conn:\n$2    $3")],
        "sql_fetchone_variant": [(r"(\w+)\s*=\s*db\.execute\((.+?)\)\.fetchall\(\)", "cursor = db.execute($2)\n$1 = cursor.fetchone()")],
    },
    "CWE-78": {
        "cmd_subprocess_run": [(r"subprocess\.call\((.+?)\)", "subprocess.run($1, capture_output=True)")],
        "cmd_subprocess_popen": [(r"subprocess\.run\((.+?)\)", "proc = subprocess.Popen($1, stdout=subprocess.PIPE)\noutput, _ = proc.communicate()")],
        "cmd_check_output": [(r"subprocess\.(?:run|call)\((.+?)\)", "subprocess.check_output($1)")],
    },
    "CWE-22": {
        "path_os_path": [(r"Path\((.+?)\)\s*/\s*(.+)", "os.path.join($1, $2)")],
        "path_context_manager": [(r"(\w+)\s*=\s*open\((.+?)\)\.read\(\)", "with open($2) as f:\n    $1 = f.read()")],
        "path_pathlib": [
            (r"(?s)\A(?=.*os\.path)", "from pathlib import Path\n"), (r"os\.path\.join\((.+?),\s*(.+?)\)", "Path($1) / $2"), (r"os\.path\.exists\((.+?)\)", "Path($1).exists()"),
        ],
    },
    "CWE-502": {"deser_json_loads": [(r"json\.load\(", "json.loads(")]},
}


#: Ways that need a word somewhere in the code: fixed values.
NEEDS = {"path_os_path": "pathlib", "sql_context_manager": "def "}


def restructured(code: Column, cwe: Column, seed: str = "42", structures: dict = STRUCTURES) -> tuple[Column, Column]:
    """code rewritten in one of its weakness's ways, chosen by the hash of seed and code, and the way's name; none without any."""
    out, name = code, F.lit("none")
    for weakness, ways in sorted(structures.items()):
        pick = F.pmod(F.xxhash64(F.lit(seed), code), F.lit(len(ways)))
        for k, (way, steps) in enumerate(sorted(ways.items())):
            done = code
            for pattern, replacement in steps:
                done = F.regexp_replace(done, pattern, replacement)
            here = (cwe == weakness) & (pick == k)
            if way in NEEDS:
                done = F.when(F.contains(F.lower(code), F.lit(NEEDS[way])), done).otherwise(code)
            out, name = F.when(here, done).otherwise(out), F.when(here, F.lit(f"structural_{way}")).otherwise(name)
    return out, name


def perturbation_hash(code: Column) -> Column:
    """16 hexadecimal digits that stand for a text."""
    return F.substring(F.sha2(code.cast("binary"), 256), 1, 16)
