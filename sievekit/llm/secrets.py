"""Secret scans: base patterns, and a battery of randomness tests.

Base patterns give the spans of their kinds. Besides, each run of TOKEN characters that
no base span touches is tested: its encoding is inferred (hex, base32, base62 or
base64) and, over that alphabet, a chi-squared test of uniformity, a runs test about the
middle and a lag-one serial correlation test each give a p-value of randomness. Fisher's
method combines the three.

The discovery control asks the other way round: how unlikely would an ordinary string be?
Ordinary strings are drawn by a model of character classes that mostly follow their own
kind, and of the letters of written language. The likelihood ratio of the uniform source
against that model, times the combined p-value (a factor of 1 at most), has an expected
value of 1 at most for ordinary strings, so by Markov's inequality its inverse is a
p-value, for each alphabet and length. These p-values go through the Benjamini-Hochberg
procedure within each class of lengths over the whole corpus, and what it accepts is a
span of kind "random".

All of it is built-in functions; one bounded table (length class x p-value bin) goes to
the driver. Work is in proportion to a text's matches, but for the copying of arrays.

Defined results: a null text has no spans; repeated rows are scanned once each; an empty
table gives an empty result; further columns are kept by redact() and ignored by
find(). Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

#: Share of false discoveries, the p-value bins (tenths of -log10) and the length classes.
FDR = 0.01
BINS_PER_DECADE, MAX_BIN = 10, 400
CLASS_ENDS = (24, 32, 40, 48, 64, 96, 128, 256)
#: Percentages of the letters a to z in written English.
LETTERS = (
    8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15,
    2.0, 0.074,
)
#: Share of even letters mixed with these, for other languages and names.
EVEN = 0.2
#: Chance that an ordinary string goes on with a class (lower, upper, digit, mark) after one of it, and after
#: another: rows by the class before, with "none" first.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/-_=")
AFTER = (
    (0.55, 0.25, 0.12, 0.08),
    (0.86, 0.06, 0.03, 0.05),
    (0.40, 0.50, 0.04, 0.06),
    (0.07, 0.07, 0.78, 0.08),
    (0.45, 0.20, 0.20, 0.15),
)

_HEX, _B32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B64 = _B62 + "+/-_"

# Marks put around matches; a text's own are replaced by as many other characters before.
_A, _B, _C = "\u0001", "\u0002", "\u0003"


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _A + _B + _C, "���")


#: Matches whose places are worked out together; less than any place or its negative.
BLOCK, LEAST = 256, -(1 << 31) + 1

_SPAN = "array<struct<s:int,e:int>>"
_SPAN_TEXT = "array<struct<s:int,e:int,v:string>>"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)


def _spans(text: Column, pattern: str, value: bool = False, keep: bool = False) -> Column:
    """Places of a pattern's leftmost non-overlapping matches, as (s, e) and with keep their text.

    value: only matches whose second group has LEAST_VALUE characters or more.
    """
    marked = F.regexp_replace(text, pattern, f"{_A}$0{_B}" + (f"$2{_C}" if value else ""))
    kind = _SPAN_TEXT if keep else _SPAN

    def step(acc: Column, part: Column) -> Column:
        match = F.substring_index(part, _B, 1)
        size = F.length(match)
        rest = F.length(F.substring_index(part, _C if value else _B, -1))
        fields = [acc["at"].alias("s"), (acc["at"] + size).alias("e")]
        if keep:
            fields.append(match.alias("v"))
        found = F.concat(acc["found"], F.array(F.struct(*fields)))
        if value:
            second = F.substring_index(F.substring_index(part, _B, -1), _C, 1)
            found = F.when(F.length(second) >= LEAST_VALUE, found).otherwise(acc["found"])
        return F.struct((acc["at"] + size + rest).alias("at"), found.alias("found"))

    def block(parts: Column) -> Column:
        # Places from the block's beginning on, and its length.
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")), step)

    def places(parts: Column) -> Column:
        starts = F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)), F.lit(BLOCK))
        blocks = F.transform(starts, lambda k: block(F.slice(parts, k, BLOCK)))
        return once(F.struct(F.length(F.get(parts, 0)).alias("first"), blocks.alias("blocks")), joined)

    def joined(x: Column) -> Column:
        first = F.struct(x["first"].alias("at"), F.array().cast("array<int>").alias("bases"))

        def add(acc: Column, one: Column) -> Column:
            return F.struct((acc["at"] + one["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases"))

        def shifted(one: Column, base: Column) -> Column:
            def moved(m: Column) -> Column:
                fields = [(m["s"] + base).alias("s"), (m["e"] + base).alias("e")]
                return F.struct(*fields, m["v"].alias("v")) if keep else F.struct(*fields)

            return F.transform(one["found"], moved)

        bases = F.aggregate(x["blocks"], first, add, lambda acc: acc["bases"])
        return F.flatten(F.zip_with(x["blocks"], bases, shifted))

    return F.when(text.rlike(pattern), once(F.split(marked, _A), places)).otherwise(F.array().cast(kind))


def _blocks(items: Column) -> Column:
    """An array's parts of BLOCK elements."""
    def cut(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK))
        return F.transform(starts, lambda k: F.slice(items, k, BLOCK))

    return once(items, cut)


def most_before(values: Column) -> Column:
    """For each element of an array of integers the largest of those before it, LEAST for the first.

    Blocks are run through on their own and then raised to the largest of the blocks before.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["most"], x).alias("most"), F.concat(acc["out"], F.array(acc["most"])).alias("out"))

    def start() -> Column:
        return F.struct(F.lit(LEAST).alias("most"), F.array().cast("array<int>").alias("out"))

    def joined(blocks: Column) -> Column:
        bases = F.aggregate(blocks, start(), lambda acc, one: step(acc, one["most"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, bases, lambda one, base: F.transform(one["out"], lambda x: F.greatest(x, base))))

    return once(F.transform(_blocks(values), lambda part: F.aggregate(part, start(), step)), joined)


def free_tokens(base: Column, found: Column) -> Column:
    """The tokens (s, e, v) that no base span (s, e) touches.

    In order of their places, none before a token may reach into it, and the next one must begin past its end.
    """
    events = F.sort_array(
        F.concat(
            F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("kind"), x["e"].alias("e"), F.lit("").alias("v"))),
            F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("kind"), x["e"].alias("e"), x["v"].alias("v"))),
        )
    )

    def sifted(events: Column) -> Column:
        ends = most_before(F.transform(events, lambda x: F.when(x["kind"] == 0, x["e"]).otherwise(F.lit(LEAST))))
        starts = F.transform(F.reverse(events), lambda x: F.when(x["kind"] == 0, -x["s"]).otherwise(F.lit(LEAST)))
        after = F.reverse(most_before(starts))
        marked = F.arrays_zip(events.alias("x"), ends.alias("ends"), after.alias("after"))
        kept = F.filter(marked, lambda m: (m["x"]["kind"] == 1) & (m["ends"] <= m["x"]["s"]) & (-m["after"] >= m["x"]["e"]))
        return F.transform(kept, lambda m: F.struct(m["x"]["s"].alias("s"), m["x"]["e"].alias("e"), m["x"]["v"].alias("v")))

    return F.when((F.size(base) == 0) | (F.size(found) == 0), found).otherwise(once(events, sifted))


def _log_tail(z: Column) -> Column:
    """The natural logarithm of the two-sided normal tail beyond |z|, to some percent."""
    x = F.abs(z)
    return x * -0.717 - x * x * 0.416


def combined(logs: list[Column]) -> Column:
    """Fisher's combination of three p-values, given by their natural logarithms: the decimal logarithm."""
    half = -reduce(lambda a, b: a + b, logs)
    return (F.log(1 + half + half * half / 2) - half) / F.lit(math.log(10))


def _ordinary_table() -> dict[str, list[float]]:
    """Decimal logarithm of each character's chance in an ordinary string, by the class before it (0: none)."""
    total = sum(LETTERS)
    letters = [(1 - EVEN) * x / total + EVEN / 26 for x in LETTERS]
    shares = (letters, letters, [0.1] * 10, [1 / len(CLASSES[3])] * len(CLASSES[3]))
    return {
        c: [math.log10(row[k] * share) for row in AFTER]
        for k, (chars, own) in enumerate(zip(CLASSES, shares, strict=True)) for c, share in zip(chars, own, strict=True)
    }


_EVERY = "".join(CLASSES)
_TABLE = [x for c in _EVERY for x in _ordinary_table()[c]]


def battery(token: Column) -> Column:
    """Struct of n, k (size of the inferred alphabet), z_chi, z_runs, z_serial, random and score.

    random is log10 of the three tests' combined p-value; score is -log10 of the p-value that
    goes to the discovery control.
    """
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def with_alphabet(token: Column) -> Column:
        return (
            F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), F.lit(_HEX))
            .when(token.rlike("^[A-Z2-7]+=*$"), F.lit(_B32))
            .when(token.rlike("^[0-9A-Za-z]+$"), F.lit(_B62))
            .otherwise(F.lit(_B64))
        )

    def with_places(x: Column) -> Column:
        alphabet = x["alphabet"]
        read = F.when(alphabet == _HEX, F.lower(x["token"])).otherwise(x["token"])
        k = F.when(alphabet == _B64, F.lit(64)).otherwise(F.length(alphabet)).cast("double")
        chars = F.split(x["token"], "")
        lower = alphabet == _HEX
        at = F.transform(chars, lambda c: F.instr(alphabet, F.when(lower, F.lower(c)).otherwise(c)).cast("double"))
        return F.struct(
            F.length(x["token"]).alias("n"), k.alias("k"), read.alias("read"), F.split(read, "").alias("chars"), at.alias("at"),
            chars.alias("own"),
        )

    def with_middle(x: Column) -> Column:
        classes = F.transform(
            x["own"], lambda c: F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).when(c.between("0", "9"), 3).otherwise(4)
        )
        return F.struct(
            *(x[f].alias(f) for f in ("n", "k", "read", "chars", "at", "own")), (total(x["at"]) / x["n"]).alias("middle"),
            F.concat(F.array(F.lit(0)), classes).alias("before"),
        )

    def finish(x: Column) -> Column:
        size, k, at = x["n"], x["k"], x["at"]
        n = size.cast("double")
        squares = total(
            F.transform(
                F.array_distinct(x["chars"]),
                lambda c: F.pow((size - F.length(F.replace(x["read"], c))).cast("double"), F.lit(2.0)),
            )
        )
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = F.transform(at, lambda i: (i * 2 > k).cast("double"))
        ups = total(high)
        downs = n - ups
        tail = F.slice(high, 2, size)
        changes = total(F.zip_with(F.slice(high, 1, size - 1), tail, lambda a, b: F.abs(a - b)))
        mean = 2 * ups * downs / n
        spread = F.sqrt(F.greatest(mean * (2 * ups * downs - n) / (n * (n - 1)), F.lit(0.0)))
        z_runs = F.when((ups == 0) | (downs == 0), (n - 1) / F.sqrt(n - 1.0)).otherwise(
            (changes - mean) / F.greatest(spread, F.lit(1e-9))
        )
        off = F.transform(at, lambda i: i - x["middle"])
        energy = total(F.transform(off, lambda i: i * i))
        lag = total(F.zip_with(F.slice(off, 1, size - 1), F.slice(off, 2, size), lambda a, b: a * b))
        z_serial = F.when(energy == 0, F.sqrt(n * 1.0)).otherwise((lag / F.greatest(energy, F.lit(1e-9)) + 1 / n) * F.sqrt(n * 1.0))
        # One-sided: characters that are too even are no sign against randomness.
        p_chi = F.when(z_chi > 0, _log_tail(z_chi)).otherwise(F.lit(0.0))
        random = combined([p_chi, _log_tail(z_runs), _log_tail(z_serial)])
        table = F.array(*map(F.lit, _TABLE))
        ordinary = total(
            F.zip_with(
                x["own"], F.slice(x["before"], 1, size),
                lambda c, before: F.get(table, (F.instr(F.lit(_EVERY), c) - 1) * len(AFTER) + before),
            )
        )
        return F.struct(
            size.alias("n"), k.alias("k"), z_chi.alias("z_chi"), z_runs.alias("z_runs"), z_serial.alias("z_serial"),
            random.alias("random"), F.greatest(random - n * F.log10(k) - ordinary, F.lit(0.0)).alias("score"),
        )

    # Each step's values are worked out once: what a lambda names again would be worked out again.
    named = once(token, lambda t: F.struct(t.alias("token"), with_alphabet(t).alias("alphabet")))
    return once(once(once(named, with_places), with_middle), finish)


def length_class(n: Column) -> Column:
    """The class of a token's length."""
    out = F.lit(len(CLASS_ENDS))
    for k in range(len(CLASS_ENDS) - 1, -1, -1):
        out = F.when(n <= CLASS_ENDS[k], F.lit(k)).otherwise(out)
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base (assign, access, hex: arrays of spans) and tried (tested tokens) to docs."""
    text = F.col("_clean")
    base = F.struct(
        _spans(text, ASSIGN, value=True).alias("assign"),
        _spans(text, ACCESS).alias("access"),
        _spans(text, HEX).alias("hex"),
    )
    free = free_tokens(F.concat(F.col("_base.assign"), F.col("_base.access"), F.col("_base.hex")), F.col("_tokens"))
    tried = F.transform(free, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["v"]).alias("b")))
    tried = F.transform(
        tried,
        lambda t: F.struct(
            t["s"].alias("s"), t["e"].alias("e"), length_class(t["b"]["n"]).alias("c"),
            F.least(F.floor(t["b"]["score"] * BINS_PER_DECADE), F.lit(MAX_BIN)).cast("int").alias("bin"),
        ),
    )
    return (
        docs.withColumn("_clean", _clean(F.col(text_col)))
        .withColumn("_base", base)
        .withColumn("_tokens", _spans(text, TOKEN, keep=True))
        .withColumn("_tried", tried)
        .drop("_clean", "_tokens")
    )


def limits(scanned: DataFrame, rate: float = FDR) -> dict[int, int]:
    """For each class of lengths the least p-value bin that is accepted.

    Benjamini-Hochberg on bins: all tokens of a class count as tests, and a bin is taken at
    its largest p-value.
    """
    rows = scanned.select(F.explode("_tried").alias("t")).groupBy(F.col("t.c").alias("c"), F.col("t.bin").alias("bin")).count().collect()
    out: dict[int, int] = {}
    for c in {r["c"] for r in rows}:
        own = sorted(((r["bin"], r["count"]) for r in rows if r["c"] == c), reverse=True)
        tests, so_far = sum(k for _, k in own), 0
        for bin_, k in own:
            so_far += k
            if 10.0 ** (-bin_ / BINS_PER_DECADE) <= rate * so_far / tests:
                out[c] = bin_
    return out


def spans_of(scanned: DataFrame, found: dict[int, int]) -> DataFrame:
    """Replace _base and _tried by base_spans and spans: arrays of (s, kind number, e), in order."""

    def least(c: Column) -> Column:
        out = F.lit(MAX_BIN + 1)
        for k, bin_ in sorted(found.items()):
            out = F.when(c == k, F.lit(bin_)).otherwise(out)
        return out

    def as_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    base = F.concat(*(as_kind(F.col(f"_base.{k}"), i) for i, k in enumerate(KINDS[:3])))
    random = as_kind(F.filter("_tried", lambda t: t["bin"] >= least(t["c"])), 3)
    return (
        scanned.withColumn("base_spans", F.sort_array(base))
        .withColumn("spans", F.sort_array(F.concat("base_spans", random)))
        .drop("_base", "_tried")
    )


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with base_spans and spans of every row."""
    scanned = materialize(
        scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text"), "scanned"
    )
    return spans_of(scanned, limits(scanned))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with each span (in order, overlapping ones together) replaced by mask.

    Cuts are worked off in blocks of about their square root, each on its own part of the text.
    """
    def block(cuts: Column) -> Column:
        first, last = F.get(cuts, 0)["s"], F.get(cuts, F.size(cuts) - 1)["e"]
        part = F.substring(text, first + 1, last - first)
        return once(
            F.struct(first.alias("first"), part.alias("part"), cuts.alias("cuts")),
            lambda x: F.array_join(
                F.transform(x["cuts"], lambda c: F.concat(F.substring(x["part"], c["s"] - x["first"] + 1, c["e"] - c["s"]), F.lit(mask))), ""
            ),
        )

    def cut(spans: Column) -> Column:
        # The text kept before each mask; a span that begins within those before it makes none.
        pairs = F.zip_with(most_before(F.transform(spans, lambda x: x["e"])), spans, lambda p, x: F.struct(F.greatest(p, F.lit(0)).alias("s"), x["s"].alias("e")))
        return F.struct(F.filter(pairs, lambda x: x["s"] <= x["e"]).alias("cuts"), F.array_max(F.transform(spans, lambda x: x["e"])).alias("at"))

    def joined(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x["cuts"]).cast("double"))).cast("int")
        starts = F.sequence(F.lit(1), F.size(x["cuts"]), size)
        parts = F.transform(starts, lambda k: block(F.slice(x["cuts"], k, size)))
        return F.concat(F.array_join(parts, ""), F.substring(text, x["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, once(once(spans, cut), joined)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """docs with every span's text replaced by mask; overlapping spans by one. Null texts stay null.

    The scan is written once, with its rows; limits and masks are taken from there.
    """
    # The row goes along as one column, so that none of its names can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(text_col).alias("_text"))
    scanned = materialize(scan(rows, "_text").drop("_text"), "scanned")
    found = spans_of(scanned, limits(scanned))
    text = F.col("_doc").getField(text_col)
    return found.select(F.col("_doc").withField(f"`{text_col}`", masked(text, F.col("spans"), mask)).alias("_doc")).select("_doc.*")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, digest and all spans of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(as_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


QUERIES = {"op4_secret_scans": op4_secret_scans}
ORACLE: dict[str, str] = {}
