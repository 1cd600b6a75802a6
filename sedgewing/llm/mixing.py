"""Mixing of sources to target weights by iterative proportional fitting (built-in functions only).

1. Texts are counted into cells (source, lang, topic) with their tokens; only cells take part in the fitting.
2. Every cell starts with the probability BUDGET. A round rakes source, language and topic in turn: the cells of a margin are
   scaled so that their expected tokens meet the margin's share of the budget; then probabilities above 1 are cut to 1, and the
   next rounds give what that left to the other cells. Each round is written to the shared folder.
3. A document stays if a number in [0, 1) that its id alone decides is below its cell's probability.

Shares can be given for each margin; without them a margin's values have the power TEMPERATURE of their tokens. Values that
given shares don't name get nothing.

Tokens are words here (runs of other than ASCII white space). Nulls: a null text has no token, null source and lang count as
empty names, a null id as the empty id. Rows that share an id share its number, so copies stay or go together within a cell.
An empty table gives an empty result. Other columns are kept by ``sampled`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgewing.llm.common import documents, hot_keys, salted_join, saved, text_or_empty

#: Share of all tokens that the mix is to have, power of the default shares, rounds of raking.
BUDGET, TEMPERATURE, ROUNDS = 0.5, 0.5, 10
MARGINS = ("source", "lang", "topic")
#: Cells up to which they are broadcast.
BROADCAST_CELLS = 50_000


def topic_of(text: Column) -> Column:
    """A coarse topic that counts of characters decide."""
    n = F.length(text)
    digits = n - F.length(F.translate(text, "0123456789", ""))
    signs = n - F.length(F.translate(text, "#*$%&|<>{}[]=@", ""))
    return F.when(20 * signs > n, "markup").when(20 * digits > n, "figures").when(F.lower(text).contains("license"), "terms").when(n < 500, "note").otherwise("prose")


def _described(docs: DataFrame, text_col: str) -> dict[str, Column]:
    text = text_or_empty(text_col)
    return {
        "source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
        "topic": topic_of(text),
        "n_tokens": F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("long"),
    }


def uniform(key: Column) -> Column:
    """A number in [0, 1) for each id, the same on every machine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def target_shares(cells: DataFrame, margin: str, given: dict[str, float] | None, temperature: float) -> DataFrame:
    """(margin, share); the shares add up to 1."""
    spark = cells.sparkSession
    if given:
        names = F.array(*[F.struct(F.lit(k).alias(margin), F.lit(float(v) / sum(given.values())).alias("share")) for k, v in given.items()])
        return spark.range(1).select(F.explode(names).alias("e")).select("e.*")
    mass = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("mass"))
    total = mass.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    return mass.select(margin, (F.col("mass") / F.lit(total) if total else F.lit(0.0)).alias("share"))


def _raked(cells: DataFrame, margin: str, shares: DataFrame, goal: float) -> DataFrame:
    # a window reads the cells once: an aggregate joined with them again would double the plan with every margin
    have = F.sum(F.col("p") * F.col("tokens")).over(Window.partitionBy(margin))
    factor = F.when(F.col("_have") > 0, F.coalesce("share", F.lit(0.0)) * F.lit(goal) / F.col("_have")).otherwise(F.lit(1.0))
    return cells.withColumn("_have", have).join(shares, margin, "left").withColumn("p", F.col("p") * factor).drop("_have", "share")


def fitted(lean: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, tokens, docs, p) from rows (source, lang, topic, n_tokens)."""
    cells = saved(lean.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("p", F.lit(float(budget))), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shares = {m: saved(target_shares(cells, m, (targets or {}).get(m), temperature), f"shares-{m}") for m in MARGINS}
    for _ in range(rounds):
        for m in MARGINS:
            cells = _raked(cells, m, shares[m], budget * total)
        cells = saved(cells.withColumn("p", F.least(F.col("p"), F.lit(1.0))), "cells")
    return cells


def _with_cells(rows: DataFrame, cells: DataFrame, spread: Column) -> DataFrame:
    """rows with p; rows of hot cells are dealt over many tasks where the cells are too many to broadcast."""
    lean = cells.select(*MARGINS, "p")
    n, docs = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    if n <= BROADCAST_CELLS:
        return rows.join(F.broadcast(lean), list(MARGINS))
    key = F.struct(*MARGINS)
    hot = hot_keys(cells.withColumn("_cell", key), "_cell", "docs", docs)
    return salted_join(rows.withColumn("_cell", key), lean.select(key.alias("_cell"), "p"), "_cell", hot, spread).drop("_cell")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """id, source, lang, topic, n_tokens, probability and kept of each row."""
    described = _described(docs, text_col)
    lean = saved(docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in described.items()]), "described")
    out = _with_cells(lean, fitted(lean, **fit), F.col("id"))
    return out.select(F.col("id").alias(id_col), *MARGINS, "n_tokens", F.round("p", 6).alias("probability"), (uniform(F.col("id")) < F.col("p")).alias("kept"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """The rows of docs that the mix keeps, all columns as they are. Texts are not shuffled while cells can be broadcast."""
    described = _described(docs, text_col)
    lean = saved(docs.select(*[c.alias(k) for k, c in described.items()]), "described")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), *[c.alias(k) for k, c in described.items() if k != "n_tokens"])
    return _with_cells(row, fitted(lean, **fit), F.col("_id")).filter(uniform(F.col("_id")) < F.col("p")).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def _oracle() -> str:
    def raked(name: str, m: str, of: str) -> str:
        return f"""
        {name} AS MATERIALIZED (
            SELECT c.source, c.lang, c.topic, c.tokens, CASE WHEN h.have > 0 THEN c.p * (s.share * {BUDGET} * t.total / h.have) ELSE c.p END AS p
            FROM {of} c JOIN (SELECT {m}, sum(p * tokens) AS have FROM {of} GROUP BY {m}) h ON c.{m} = h.{m}
            JOIN share_{m} s ON s.{m} = c.{m}, t)"""

    parts = [
        r"""
        d AS MATERIALIZED (
            SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
                   CASE WHEN 20 * length(regexp_replace(text, '[^#*$%&|<>{}\[\]=@]', '', 'g')) > length(text) THEN 'markup'
                        WHEN 20 * length(regexp_replace(text, '[^0-9]', '', 'g')) > length(text) THEN 'figures'
                        WHEN contains(lower(text), 'license') THEN 'terms'
                        WHEN length(text) < 500 THEN 'note' ELSE 'prose' END AS topic,
                   CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
            FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),""",
        f"""
        c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST({BUDGET} AS DOUBLE) AS p FROM d GROUP BY ALL),
        t AS MATERIALIZED (SELECT sum(tokens) AS total FROM c0),""",
    ]
    parts += [f"share_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens), {TEMPERATURE}) / sum(pow(sum(tokens), {TEMPERATURE})) OVER () AS share FROM c0 GROUP BY {m})," for m in MARGINS]
    last = "c0"
    for r in range(ROUNDS):
        for m in MARGINS:
            parts.append(raked(f"r{r}_{m}", m, last) + ",")
            last = f"r{r}_{m}"
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, least(p, 1.0) AS p FROM {last})" + ("," if r + 1 < ROUNDS else ""))
        last = f"c{r + 1}"
    return f"""
        WITH {" ".join(parts)}
        SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, round(c.p, 6) AS probability,
               CAST(('0x' || substr(md5(CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR)), 1, 13)) AS BIGINT) / CAST({16**13} AS DOUBLE) < c.p AS kept
        FROM d JOIN {last} c USING (source, lang, topic)"""


QUERIES = {"op2_mixing": op2_mixing}
ORACLE = {"op2_mixing": _oracle()}
