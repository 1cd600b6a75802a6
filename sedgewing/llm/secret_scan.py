"""Secret scan by patterns and by sliding-window entropy (built-in functions only).

Patterns give the base kinds assign, access and hex. Candidate strings, runs of letters, digits and ``+/_=-`` of CANDIDATE
or more characters, are read through a window of WINDOW characters: counts per character are kept up to date by the one
that leaves and the one that enters, and where the entropy of a window reaches the threshold of the string's character class
(hex digits, or any) the window belongs to a span. Strings on the allow list, and windows of base spans, give none.

Spans are code points, end exclusive. Null counts as empty; other columns are not read; repeated rows are scanned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import documents, text_or_empty
from sedgewing.llm.quality_rules import let

ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE, WINDOW = 20, 20
CANDIDATES = f"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}"
#: Bits a character that a window must reach, by character class.
THRESHOLD = {"hex": 3.05, "any": 3.65}
#: Strings that are no secrets: one letter case or digits alone, UUIDs, placeholders.
ALLOWED = "^[a-z]+$|^[A-Z][a-z]+$|^[A-Z]+$|^[0-9]+$|^[A-Za-z/_=+-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i)example|placeholder|sample|dummy|xxxx"
#: c * log2(c) of a count within the window; what a count adds to WINDOW * log2(WINDOW) - WINDOW * entropy.
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """(start, text) of each match, leftmost and non-overlapping; empty where ``hint`` is false.

    The parts between the matches and the matches themselves come from the same pattern, so their lengths add up to the
    places."""

    def zipped(found: Column) -> Column:
        parts = F.split(text, pattern, -1)
        both = F.arrays_zip(F.slice(parts, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,m:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["gap"])
            return F.struct((start + F.length(x["m"])).alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), x["m"].alias("m")))).alias("out"))

        return F.aggregate(both, none, step, lambda a: a["out"])

    empty = F.array().cast("array<struct<start:int,m:string>>")
    return F.when(hint, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)).otherwise(empty)


def spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x["start"] + F.length(x["m"])).alias("end")))


def high_windows(s: Column) -> Column:
    """(start, end) pairs, merged, of the windows of s whose entropy reaches the threshold of its class."""
    limit = F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLD["hex"])).otherwise(F.lit(THRESHOLD["any"]))
    weights = F.array(*[F.lit(x) for x in _CLOGC])
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int>>").alias("out"),
    )

    def run(cs: Column) -> Column:
        def code(c: Column) -> Column:
            return F.call_function("instr", F.lit(ALPHABET), c) - 1

        def step(a: Column, c: Column) -> Column:
            enters = code(c)
            leaves = F.when(a["at"] >= WINDOW, code(F.get(cs, a["at"] - WINDOW))).otherwise(F.lit(-1))
            same = enters == leaves
            up, down = F.get(a["n"], enters), F.get(a["n"], leaves)
            change = F.when(same, F.lit(0.0)).otherwise(
                F.get(weights, up + 1) - F.get(weights, up) + F.when(leaves >= 0, F.get(weights, down - 1) - F.get(weights, down)).otherwise(F.lit(0.0))
            )
            total = a["sum"] + change
            n = F.when(same, a["n"]).otherwise(F.transform(a["n"], lambda x, i: x + (i == enters).cast("int") - (i == leaves).cast("int")))
            end = a["at"] + 1
            high = (end >= WINDOW) & (math.log2(WINDOW) - total / WINDOW >= limit)
            last = F.element_at(F.concat(F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))), a["out"]), -1)
            joined = F.when(
                last["end"] >= end - WINDOW,
                F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end")))),
            ).otherwise(F.concat(a["out"], F.array(F.struct((end - WINDOW).alias("start"), end.alias("end")))))
            return F.struct(n.alias("n"), total.alias("sum"), end.alias("at"), F.when(high, joined).otherwise(a["out"]).alias("out"))

        return F.aggregate(cs, start, step, lambda a: a["out"])

    return let(letters, run)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and the arrays base and entropy of (start, kind, end)."""
    t = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    long_value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6
    rows = rows.select(
        "id",
        "text",
        F.filter(matches(t, ASSIGN, t.rlike("[:=]") & t.rlike(ASSIGN)), long_value).alias("assign"),
        matches(t, ACCESS, F.contains(t, F.lit("AKIA"))).alias("access"),
        matches(t, HEX, t.rlike(HEX)).alias("hex"),
        F.filter(matches(t, CANDIDATES, t.rlike(CANDIDATES)), lambda x: ~x["m"].rlike(ALLOWED)).alias("candidates"),
    )
    rows = rows.select("id", "text", F.array_sort(F.concat(spans(F.col("assign"), "assign"), spans(F.col("access"), "access"), spans(F.col("hex"), "hex"))).alias("base"), "candidates")
    windows = F.flatten(F.transform("candidates", lambda x: F.transform(high_windows(x["m"]), lambda w: F.struct((x["start"] + w["start"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + w["end"]).alias("end")))))
    rows = rows.select("id", "text", "base", F.when(F.size("candidates") > 0, windows).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("windows"))
    fresh = F.filter("windows", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.select("id", "text", "base", fresh.alias("entropy"))


def as_string(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scanned(docs, id_col, text_col).select(
        F.col("id").alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(as_string(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_string(F.array_sort(F.concat("base", "entropy"))).alias("spans")
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE: dict[str, str] = {}
