"""Ordered folds over arrays: longest increasing subsequences, smaller neighbours, trace windows, chains, envelopes, block splits."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from sedgewing.functions import cigar


def increasing_subsequence(x: list) -> list[int]:
    """Places of one longest strictly increasing subsequence."""
    tails, ends, before = [], [], []
    for i, v in enumerate(x):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def increasing_from(x: list) -> tuple[list[int], list[int]]:
    """(lengths, successors): of the longest strictly increasing subsequence that starts at each place; -1 is none."""
    n = len(x)
    lengths, following, tails, ends = [0] * n, [-1] * n, [], []
    for i in range(n - 1, -1, -1):
        k = bisect_left(tails, -x[i])
        lengths[i], following[i] = k + 1, ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(-x[i])
            ends.append(i)
        else:
            tails[k], ends[k] = -x[i], i
    return lengths, following


def previous_smaller(x: list) -> list[int]:
    """The nearest place to the left with a smaller value, -1 for none: the parents' order of the Cartesian tree."""
    out, stack = [], []
    for i, v in enumerate(x):
        while stack and x[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def border_array(s: str) -> list[int]:
    """Length of the longest proper border of each prefix."""
    out = [0] * len(s)
    for i in range(1, len(s)):
        k = out[i - 1]
        while k and s[k] != s[i]:
            k = out[k - 1]
        out[i] = k + (s[k] == s[i])
    return out


def longest_prefix_match(needle: str, haystack: str) -> tuple[int, int]:
    """(place, length) of the first longest prefix of the needle in the haystack."""
    borders, k, best = border_array(needle), 0, (0, 0)
    for i, c in enumerate(haystack):
        while k and (k == len(needle) or needle[k] != c):
            k = borders[k - 1]
        if needle and needle[k] == c:
            k += 1
        if k > best[1]:
            best = i + 1 - k, k
    return best


@pandas_udf(T.ArrayType(T.IntegerType()))
def longest_increasing(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else increasing_subsequence(list(v)))


@pandas_udf(T.ArrayType(T.IntegerType()))
def smaller_before(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else previous_smaller(list(v)))


@pandas_udf(T.ArrayType(T.IntegerType()))
def borders(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else border_array(v))


def _letters(trace: Column) -> Column:
    return F.filter(F.split(trace, ""), lambda c: c != "")


def _once(value: Column, body) -> Column:
    """body(value) with value computed once, though used often."""
    return F.get(F.transform(F.array(value), body), 0)


def _batch_gains(traces: pa.Array, match: int, error: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, bounds): running sums, from 0, over the letters of all traces of a batch one after the other, and where each trace begins and
    ends in them. A letter that is not = is an error, however many bytes it has."""
    traces = pc.fill_null(traces.cast(pa.large_string()), "")
    raw = np.frombuffer(b"".join(t.encode() for t in traces.to_pylist()), dtype=np.uint8)
    first = raw & 0xC0 != 0x80  # the other bytes go on with a letter
    letters = raw[first]
    sums = np.concatenate([[0], np.cumsum(np.where(letters == ord("="), match, error), dtype=np.int64)])
    return sums, np.concatenate([[0], np.cumsum(pc.utf8_length(traces).to_numpy(zero_copy_only=False))]).astype(np.int64)


def window_errors(traces: pa.Array, width: int) -> pa.Array:
    """The most errors in ``width`` successive operations of each trace."""
    sums, bounds = _batch_gains(traces, 0, 1)
    size = np.diff(bounds)
    begin = np.repeat(bounds[:-1], size)
    stop = np.arange(len(begin)) + 1
    held = sums[stop] - sums[np.maximum(begin, stop - width)]
    most = np.zeros(len(size), np.int64)
    if len(held):
        most[size > 0] = np.maximum.reduceat(held, bounds[:-1][size > 0])
    return pa.array(most, pa.int32(), mask=traces.is_null().to_numpy(zero_copy_only=False))


def window_error(trace: Column, width: int) -> Column:
    """The most errors (other letters than =) in ``width`` successive operations."""

    @arrow_udf(T.IntegerType())
    def most(traces: pa.Array) -> pa.Array:
        return window_errors(traces, width)

    return most(trace)


def last_good_window(trace: Column, width: int, errors: int) -> Column:
    """End of the last window of ``width`` operations with at most so many errors; -1 for none."""

    def last(t: Column) -> Column:
        n = F.length(t)
        ends = F.when(n >= width, F.sequence(F.lit(width), n)).otherwise(F.array().cast("array<int>"))
        bad = lambda e: F.length(F.translate(F.substring(t, e - width + 1, F.lit(width)), "=", ""))
        return F.coalesce(F.array_max(F.filter(ends, lambda e: bad(e) <= errors)), F.lit(-1))

    return _once(trace, last)


def low_quality(trace: Column, width: int, errors: int) -> Column:
    """(start, stop) of the merged windows of ``width`` operations with more errors than allowed; stop is exclusive."""

    def starts(t: Column) -> Column:
        n = F.length(t)
        all_starts = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
        return F.filter(all_starts, lambda i: F.length(F.translate(F.substring(t, i + 1, F.lit(width)), "=", "")) > errors)

    bad = _once(trace, starts)
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(out: Column, i: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        here = F.struct(i.alias("start"), (i + width).alias("stop"))
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (i + width).alias("stop"))))
        return F.when(F.size(out) == 0, F.array(here)).when(last["stop"] >= i, joined).otherwise(F.concat(out, F.array(here)))

    return F.aggregate(bad, none, step)


def longest_match(trace: Column) -> Column:
    """(start, stop) of the first longest run of matches; an empty range at the end if there is none."""
    runs = F.regexp_extract_all(trace, F.lit("(=+|[^=]+)"), F.lit(1))
    n = F.length(trace)
    state = F.struct(F.lit(0).alias("at"), n.alias("start"), n.alias("stop"))

    def step(s: Column, r: Column) -> Column:
        size = F.length(r)
        better = r.startswith("=") & (size > s["stop"] - s["start"])
        return F.struct((s["at"] + size).alias("at"), F.when(better, s["at"]).otherwise(s["start"]).alias("start"), F.when(better, s["at"] + size).otherwise(s["stop"]).alias("stop"))

    return F.aggregate(runs, state, step, lambda s: F.struct(s["start"], s["stop"]))


def best_score(trace: Column, match: int = 1, error: int = -1) -> Column:
    """(score, start, stop) of the segment of the trace with the highest score; the first of equal ones."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.lit(0).alias("from"), F.lit(0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def step(s: Column, c: Column) -> Column:
        total, i = s["sum"] + F.when(c == "=", match).otherwise(error), s["i"] + 1
        fell = total < 0
        now, since = F.when(fell, F.lit(0)).otherwise(total), F.when(fell, i).otherwise(s["from"])
        better = now > s["score"]
        return F.struct(i.alias("i"), now.alias("sum"), since.alias("from"), F.when(better, now).otherwise(s["score"]).alias("score"), F.when(better, since).otherwise(s["start"]).alias("start"), F.when(better, i).otherwise(s["stop"]).alias("stop"))

    return F.aggregate(_letters(trace), state, step, lambda s: F.struct(s["score"], s["start"], s["stop"]))


def diagonals(trace: Column) -> Column:
    """(diagonal, matches): how many matches lie on each diagonal (a less b)."""
    return cigar_diagonals(cigar.from_trace(trace))


def cigar_diagonals(elements: Column) -> Column:
    """The same from a CIGAR: a step for each element, however long."""
    state = F.struct(F.lit(0).alias("d"), F.array().cast("array<struct<d:int,n:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        moved = F.when(x["op"] == "D", x["len"]).when(x["op"] == "I", -x["len"]).otherwise(F.lit(0))
        here = F.struct(s["d"].alias("d"), x["len"].alias("n"))
        return F.struct((s["d"] + moved).alias("d"), F.when((x["op"] == "=") & (x["len"] > 0), F.concat(s["out"], F.array(here))).otherwise(s["out"]).alias("out"))

    on = F.aggregate(elements, state, step, lambda s: s["out"])
    total = lambda o, d: F.aggregate(F.filter(o, lambda x: x["d"] == d), F.lit(0), lambda n, x: n + x["n"])
    return _once(on, lambda o: F.transform(F.array_sort(F.array_distinct(F.transform(o, lambda x: x["d"]))), lambda d: F.struct(d.alias("diagonal"), total(o, d).alias("matches"))))


def chains(matches: DataFrame, keys: list[str], gap_cost: float = 0.5) -> DataFrame:
    """(keys, chain, start_a, start_b, length, score): collinear matches of each key put into the chains of highest score, each match
    in one. A key is one pair of sequences; its matches are one task's."""
    names = [*keys, "start_a", "start_b", "length"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["start_a", "start_b", "length"]].itertuples(index=False, name=None))
        best, before = [], []
        for i, (a, b, n) in enumerate(rows):
            score, prev = float(n), -1
            for j in range(i - 1, -1, -1):
                x, y, m = rows[j]
                if x + m <= a and y + m <= b:
                    s = best[j] + n - gap_cost * abs((a - x - m) - (b - y - m))
                    if s > score:
                        score, prev = s, j
            best.append(score)
            before.append(prev)
        used, out, chain = set(), [], 0
        for i in sorted(range(len(rows)), key=lambda i: (-best[i], i)):
            path, k = [], i
            while k >= 0 and k not in used:
                path.append(k)
                k = before[k]
            if path:
                used.update(path)
                out += [(chain, *rows[p], best[i]) for p in path[::-1]]
                chain += 1
        res = pd.DataFrame(out, columns=["chain", "start_a", "start_b", "length", "score"])
        for c in keys[::-1]:
            res.insert(0, c, pdf[c].iloc[0])
        return res

    schema = ", ".join([*[f"{c} {matches.schema[c].dataType.simpleString()}" for c in keys], "chain long, start_a long, start_b long, length long, score double"])
    return matches.select(*names).groupBy(*keys).applyInPandas(run, schema)


def envelope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """The rows that no row of smaller or equal x and higher y dominates, per key."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(x, F.col(y).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.max(y).over(w)).filter(F.col("_m").isNull() | (F.col(y) > F.col("_m"))).drop("_m")


def split_blocks(df: DataFrame, order: str, length: str, most: int) -> DataFrame:
    """(block, low, high, size): the rows in order are cut greedily, a block ends where the next row would exceed ``most``.

    The cut depends on all rows before, so it is one task's work, over two numbers per row in batches; only the blocks are kept."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = at = size = block = 0
        any_row = False
        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                if any_row and size + n > most:
                    out.append((block, low, at, size))
                    block, low, size = block + 1, at, 0
                size, at, any_row = size + n, at + 1, True
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("block", "low", "high", "size"))})
        if any_row:
            yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in zip(("block", "low", "high", "size"), (block, low, at, size), strict=True)})

    rows = df.select(F.col(order).alias("_o"), F.col(length).cast("long").alias("_n")).orderBy("_o").coalesce(1)
    return rows.select("_n").mapInArrow(run, "block long, low long, high long, size long")


def needle_prefix(needle: str):
    """A function of columns: the length of the longest start of the needle in a text."""

    @pandas_udf(T.IntegerType())
    def found(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else longest_prefix_match(needle, v)[1]).astype("Int32")

    return found


@pandas_udf(T.ArrayType(T.IntegerType()))
def increasing_lengths(x: pd.Series) -> pd.Series:
    """The length of the longest strictly increasing subsequence that starts at each place."""
    return x.map(lambda v: None if v is None else increasing_from(list(v))[0])


def batch_ends(traces: pa.Array, match: int, error: int) -> pa.Array:
    """(prefix, suffix) of each trace, as ``positive_ends`` says."""
    sums, bounds = _batch_gains(traces, match, error)
    size = np.diff(bounds)
    some = size > 0
    begin, end = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    place = np.arange(len(begin))
    prefix, suffix = np.zeros(len(size), np.int64), size.copy()
    if len(place):
        starts = bounds[:-1][some]
        prefix[some] = np.maximum.reduceat(np.where(sums[place + 1] > sums[begin], place + 1 - begin, 0), starts)
        suffix[some] = np.minimum.reduceat(np.where(sums[end] > sums[place], place - begin, end - begin), starts)
    fields = [pa.array(prefix, pa.int32()), pa.array(suffix, pa.int32())]
    return pa.StructArray.from_arrays(fields, ["prefix", "suffix"], mask=traces.is_null())


def positive_ends(trace: Column, match: int = 1, error: int = -1) -> Column:
    """(prefix, suffix): the length of the longest start of a trace whose score is above 0, and the place of the longest such end;
    0 and the trace's length where there is none."""

    @arrow_udf("prefix int, suffix int")
    def ends(traces: pa.Array) -> pa.Array:
        return batch_ends(traces, match, error)

    return ends(trace)
