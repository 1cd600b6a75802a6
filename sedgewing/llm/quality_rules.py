"""Quality rules as a short-circuit cascade (built-in functions only).

Rules are predicates over a text, its words and measures of both. On a sample of about SAMPLE rows, drawn evenly from all, each
rule's rejections are counted and its cost a row is timed (over REPEATS evaluations of each row, less the time of a job without a
rule), and the rules are ordered by rejections per cost. One CASE then tries them in that order and stops at the first that
rejects. The order changes the cost, never the verdict.

``kept`` computes the words of a text once and every measure only when a rule asks for it; the parts of the base rule, of which
repeated words are the dearest of all measures, stand in the order with the others. ``judged`` returns the base measures of
every row, so they are all computed there, and the base rule comes first as it costs nothing more; the others are ordered by what
they reject of the rows that it leaves.

Null and empty texts have no word and fail the base rule. A very long text is one row's work, n log n in its words. Repeated
rows are judged each for itself; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import documents, text_or_empty

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows on which cost and selectivity are estimated, and how often a rule is evaluated on each to be timed.
SAMPLE, REPEATS = 2000, 8


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though used often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words that lie in windows found twice or more. Windows are told apart by a 64-bit hash; equal ones are found as
    neighbours after one sort, so the cost is n log n whatever repeats."""
    last = F.size(words) - window
    hashes = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*[F.get(words, i + k) for k in range(window)]).alias("h"), i.alias("i")),
    )

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])

    return let(F.array_sort(hashes), lambda s: let(places(s), covered))


def _thunks(text: Column, words: Column) -> dict[str, Callable[[], Column]]:
    """The base measures of a text and its words."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    return {
        "n_words": lambda: F.size(words).cast("long"),
        "word_chars": lambda: F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": lambda: (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": lambda: let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": lambda: let(words, lambda w: repeated_words(w)).cast("long"),
    }


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, words and the base measures."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    base = base.withColumn("words", words_of(F.col("text")))
    return base.select("id", "text", "words", *[f().alias(k) for k, f in _thunks(F.col("text"), F.col("words")).items()])


class Parts:
    """What rules are made of: a text, its words, and measures that are computed where they are asked for."""

    def __init__(self, text: Column, words: Column, columns: bool = False):
        self.text, self.words = text, words
        self.found = {k: (lambda k=k: F.col(k)) for k in _thunks(text, words)} if columns else _thunks(text, words)

    def __getitem__(self, name: str) -> Column:
        return self.found[name]()


def base_rules(p: Parts) -> dict[str, Column]:
    return {"few_words": p["n_words"] < 50, "repeats": 100 * p["n_repeat_words"] > 50 * p["n_words"]}


def base_failed() -> Column:
    few, repeats = base_rules(Parts(F.col("text"), F.col("words"), True)).values()
    return few | repeats


def rules(p: Parts) -> dict[str, Column]:
    """Each is true where the text is to go."""
    n = p["n_words"]
    lines = F.size(F.split(p.text, "\n"))
    upper = F.length(p.text) - F.length(F.regexp_replace(p.text, "\\p{Lu}", ""))
    marks = F.size(F.filter(p.words, lambda w: w.rlike("[\\p{L}\\p{M}]")))
    # letters of any script: the SQL names the Latin ones, which are all that its tables have
    return {
        "symbols": 5 * p["n_symbols"] > n,  # more than one for five words
        "short_words": p["word_chars"] < 2 * n,
        "long_words": p["word_chars"] > 15 * n,
        "dup_lines": 2 * p["n_dup_lines"] > lines,
        "upper_case": 2 * upper > p["word_chars"],
        "letters": 10 * marks < 7 * n,
    }


def ordered_rules(docs: DataFrame, text_col: str, with_base: bool, sample: int = SAMPLE) -> list[str]:
    """Names of the rules, the most rejections per cost first; a rule that rejects none comes last, the cheapest first. Without the
    base rules, only rows that those leave are counted. Every task keeps its own rows of the sample, which are not moved."""
    share = min(1.0, sample / max(1, docs.count()))
    few = docs.sample(share, seed=1) if share < 1 else docs
    few = few.select(text_or_empty(text_col).alias("text")).withColumn("words", words_of(F.col("text")))
    parts = Parts(F.col("text"), F.col("words"))
    base, found = base_rules(parts), rules(parts)
    open_ = F.lit(True) if with_base else ~(base["few_words"] | base["repeats"])
    if with_base:
        found = base | found
    return by_price(few, found, open_)


def by_price(few: DataFrame, found: dict[str, Column], open_: Column) -> list[str]:
    """Names of rules over rows (text, words), by what they reject of the open rows for their cost."""
    few = few.cache()
    try:
        few.count()
        counts = few.filter(open_).agg(*[F.coalesce(F.sum(rule.cast("int")), F.lit(0)).alias(name) for name, rule in found.items()]).first()
        again = few.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def seconds(rule: Column) -> float:
            # the condition on _again keeps the rule behind the repetition
            began = time.perf_counter()
            again.agg(F.sum(F.when(F.col("_again") > 0, rule.cast("int")))).first()
            return time.perf_counter() - began

        none = min(seconds(F.length("text") < 0) for _ in range(2))
        price = {}
        for name, rule in found.items():
            cost = max(seconds(rule) - none, 1e-4)
            price[name] = (-counts[name] / cost, cost)
        return sorted(price, key=price.get)
    finally:
        few.unpersist()


def cascade(found: dict[str, Column], order: list[str]) -> Column:
    """The first rule in the order that rejects, else null; the later ones are not evaluated then."""
    first, *others = order
    out = F.when(found[first], F.lit(first))
    for name in others:
        out = out.when(found[name], F.lit(name))
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, the base measures, base_failed and kept."""
    found = {"base": base_failed()} | rules(Parts(F.col("text"), F.col("words"), True))
    order = ["base", *(ordered_rules(docs, text_col, False, sample) if sample else list(found)[1:])]
    out = measures(docs, id_col, text_col)
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), cascade(found, order).isNull().alias("kept")
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """docs without the rejected rows, all columns kept, in one pass and without a shuffle."""
    order = ordered_rules(docs, text_col, True, sample) if sample else []

    def verdict(text: Column, words: Column) -> Column:
        p = Parts(text, words)
        found = base_rules(p) | rules(p)
        return cascade(found, order or list(found))

    stays = let(text_or_empty(text_col), lambda t: let(words_of(t), lambda w: verdict(t, w))).isNull()
    return docs.filter(stays)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE = {
    "op1_quality_rules": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents),
        m AS (
            SELECT r, doc_id, text, words, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines
            FROM d),
        win AS (
            SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM m)),
        rep AS (
            SELECT r, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE c >= 2 GROUP BY r),
        a AS (
            SELECT m.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN rep ON m.r = rep.r),
        b AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                    OR 2 * n_dup_lines > len(string_split(text, chr(10)))
                    OR 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
                    OR 10 * len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z\x{00C0}-\x{024F}]'))) < 7 * n_words) AS kept
        FROM b"""
}
