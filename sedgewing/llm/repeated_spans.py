"""Removal of byte strings of LENGTH bytes that also start anywhere else, and a count of the bytes in shorter repeated passages.

Two lengths are searched at once: strings of LENGTH bytes are removed; strings of PASSAGE bytes, which a passage of 50 words fills,
are counted (``n_passage_bytes``) and left in place.

Candidates. Hashes of GRAM-byte windows are winnowed: a string of PASSAGE bytes holds WINDOW of them, and the leftmost least
one, its anchor, owns it. The string's bytes alone decide its anchor, so equal strings have equal anchors at one offset, and
only strings of equal anchors need be compared. A string of LENGTH bytes belongs to the anchor of its first PASSAGE bytes. An
anchor that occurs once in the corpus owns no repeated string.

Contexts. The strings that one occurrence of an anchor owns lie side by side; together they are its context. Contexts are
first compared as a whole, by hash: where one occurs twice, all its strings are repeated. Of each different context of an
anchor with several, one copy is then fetched.

Suffix array. A task cuts the contexts of its anchors, some megabytes at a time, into units of UNIT bytes counted from the
anchors, ranks the units and sorts the suffixes of the sequences of ranks by linear grouping (``suffix_groups``). A string holds
(length - UNIT + 1) // UNIT units whole, so equal strings have suffixes that share so many ranks and stand side by side in the
array; the bytes before and behind those units are then compared as they are. A suffix of
units stands for UNIT strings, which is what makes the array affordable: one of single bytes takes 4 microseconds a byte here,
2000 CPU seconds a GB of input.

Anchors with more than GROUP different contexts give a row per string instead, grouped by anchor and hash over all tasks, so that
no anchor needs to fit into one.

Texts that are equal as a whole are one text with a number of copies: all their bytes are repeated if they have the length.

Texts are told apart by a number of 64 bits; should two share one, it is found by their SHA-256 and both get others. Contexts are equal by hash only within one anchor, so by two hashes of 64 bits,
the anchor's and their own; strings of an anchor with too many contexts likewise. All other strings are compared byte for byte.

Nulls count as empty; a text shorter than a length has no string of it; rows that repeat an id and text are copies of each other.
Null ids stay null. An empty table gives an empty result. Other columns are not read, whatever their names. A text of any length is
hashed in blocks of BLOCK bytes; what its task holds is the text and a few numbers for each of its anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import KeyFilter, Tables, documents, hot_keys, salted_join, small_batches, text_or_empty
from sedgewing.llm.exact_dedup import sha256_digest
from sedgewing.llm.suffix_groups import suffix_order
from sedgewing.llm.textnum import inverse_powers, mix, running_sum, window_hashes

LENGTH, PASSAGE, GRAM = 400, 280, 48
WINDOW = PASSAGE - GRAM + 1
#: Contexts whose strings one task compares at once; a group of more is cut by the hash of its strings instead.
GROUP = 8000
#: Bytes of a unit, and bytes of contexts that form one suffix array.
UNIT = 32
ARRAY = 2 << 20
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted places of the least hash (the last of equal ones) of each window of so many."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, span = h.copy(), 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    window = np.minimum(least[:n], least[rest : rest + n])
    # a place is chosen if a window that holds it has it as the least: compare with the largest least of those windows
    k = len(h)
    padded = np.zeros(n + 2 * (width - 1), dtype=h.dtype)
    padded[width - 1 : width - 1 + n] = window
    most, span = padded, 1
    while span * 2 <= width:
        most = np.maximum(most[: len(most) - span], most[span:])
        span *= 2
    rest = width - span
    most = np.maximum(most[:k], most[rest : rest + k])
    return np.flatnonzero(h == most)


def anchors(data: np.ndarray, length: int = PASSAGE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's anchors; every window of length bytes holds one, decided by its bytes alone. Of equal
    least hashes in a window all are anchors."""
    width = length - gram + 1
    places, hashes, at = [], [], 0
    while len(data) - at >= length:
        part = data[at : at + BLOCK + length]
        h = window_hashes(part, gram)
        p = _sliding_argmin(h, width)
        places.append(p + at)
        hashes.append(h[p])
        at += len(part) - length + 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, i = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[i]


def owned(p: np.ndarray, h: np.ndarray, size: int, length: int = PASSAGE, gram: int = GRAM) -> tuple[list[int], list[int]]:
    """First and last start of the strings that each anchor owns: those in whose gram windows it is the leftmost least one.
    A string's bytes alone decide that, so equal strings are owned by equal anchors at the same offset."""
    places, values, n, width = p.tolist(), h.tolist(), len(p), length - gram + 1
    low, high, stack = [0] * n, [0] * n, []
    for i in range(n):
        v = values[i]
        while stack and values[stack[-1]] > v:
            j = stack.pop()
            high[j] = min(places[j], places[i] - width, size - length)
        low[i] = max(places[stack[-1]] + 1 if stack else 0, places[i] - width + 1)
        stack.append(i)
    for j in stack:
        high[j] = min(places[j], size - length)
    return low, high


def _text_key(odd: list[bytes]) -> Column:
    """64 bits that name a text by its digest; the few digests that share a number with another (odd) get one from other bits."""
    plain = F.xxhash64("digest")
    return F.when(F.col("digest").isin(odd), F.xxhash64("digest", F.lit(1))).otherwise(plain) if odd else plain


def _shared_keys(digests: DataFrame) -> list[bytes]:
    """Digests whose numbers of 64 bits are equal: of n texts n * n / 2**65 pairs are expected, 3 of 10**10 texts."""
    twice = digests.groupBy(F.xxhash64("digest").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("digest").alias("all")).filter("n > 1")
    return [bytes(x) for r in twice.select("all").collect() for x in r[0]]


def _distinct(docs: DataFrame, text_col: str, copies: DataFrame, n_copies: int, odd: list[bytes]) -> DataFrame:
    """(digest, d, text) of each different text of at least PASSAGE bytes; only rows with copies are shuffled."""
    marked = KeyFilter(copies, "digest", n_copies).mark(_long_rows(docs, text_col), "digest", "_many")
    once = marked.filter("_many").drop("_many").dropDuplicates(["digest"])
    return marked.filter(~F.col("_many")).drop("_many").unionByName(once).withColumn("d", _text_key(odd))


def _long_rows(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.select(text_or_empty(text_col).cast("binary").alias("text")).filter(F.octet_length("text") >= PASSAGE)
    return rows.withColumn("digest", sha256_digest(F.col("text")))


#: Bits of the numbers that ``at`` is made of, behind the first start of a context.
PLACE = {"more": (1 << 19, 1023), "over": (1 << 10, 511), "back": (1, 1023)}


def _placed(name: str) -> Column:
    """low, high, stop or back out of ``at``."""
    part = lambda k: (F.col("at").bitwiseAND(PLACE[k][0] * PLACE[k][1]) / F.lit(PLACE[k][0])).cast("long")
    low = F.shiftright("at", 29)
    return {"low": low, "high": low + part("more"), "stop": low + part("more") + part("over"), "back": part("back")}[name]


def _occurrences(texts: DataFrame) -> DataFrame:
    """(f, c, d, at): an anchor, its context's hash, the text, and in one number the first start of the strings that it owns, how
    many more starts there are, how far the context goes beyond the last, and how far behind the first the anchor stands."""
    names = ("f", "c", "d", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for d, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                p, h = anchors(data)
                low, high = (np.array(x, np.int64) for x in owned(p, h, len(data)))
                own = low <= high
                low, high, h, p = low[own], high[own], h[own], p[own]
                stop = np.minimum(high + LENGTH, len(data))
                c = mix(span_hashes(data, low, stop) ^ (high - low).astype(np.uint64))
                at = low << 29 | (high - low) << 19 | (stop - high) << 10 | (p - low)
                for x, y in zip(out, (h.view(np.int64), c.view(np.int64), np.full(len(h), d, np.int64), at), strict=True):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(x), pa.int64()) for k, x in zip(names, out, strict=True)})

    return texts.select("d", "text").mapInArrow(run, "f long, c long, d long, at long")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, at = [], 0
    while at < len(start):  # the spans ascend: as many at once as BLOCK bytes hold
        upto = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, side="right")))
        upto = min(upto, len(start))
        base = int(start[at])
        s = running_sum(data[base : int(end[at:upto].max())], False)
        i, j = start[at:upto] - base, end[at:upto] - base
        out.append(mix((s[j] - s[i]) * inverse_powers(int(i.max()) + 1)[i]))
        at = upto
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _fetched(texts: DataFrame) -> DataFrame:
    """(f, n, d, low, starts, back, context) from (d, text, wanted), wanted being (f, n, low, high, stop, back)."""
    names = ("f", "n", "d", "low", "starts", "back", "context")
    types = (*[pa.int64()] * 6, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(names, types, strict=True))})

        for batch in batches:
            rows, size = [], 0
            for d, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                for w in wanted.as_py():
                    rows.append((w["f"], w["n"], d, w["low"], w["high"] - w["low"] + 1, w["back"], raw[w["low"] : w["stop"]]))
                    size += len(rows[-1][-1])
                    if size > 4 << 20:
                        yield packed(rows)
                        rows, size = [], 0
            yield packed(rows)

    return texts.select("d", "text", "wanted").mapInArrow(run, "f long, n long, d long, low long, starts long, back long, context binary")


def string_keys(f: int, context: bytes, starts: int, length: int) -> np.ndarray:
    """A key of each string of so many bytes that a context's anchor owns."""
    h = window_hashes(np.frombuffer(context, dtype=np.uint8), length)[:starts]
    return h ^ mix(np.array([f ^ length], np.int64).view(np.uint64))


def _shared_head(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before."""
    apart = rows[1:] != rows[:-1]
    return np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1])


def _levels(kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): rows sorted within their kind, and the bytes that each shares with the one before, -1 where a kind begins."""
    key = np.concatenate([kind.astype(">u4").view(np.uint8).reshape(-1, 4), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel(), kind="stable")
    shared = np.full(len(order), -1, dtype=np.int64)
    if len(order) > 1:
        same = kind[order][1:] == kind[order][:-1]
        shared[1:] = np.where(same, _shared_head(rows[order]), -1)
    return order, shared


def _numbers(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """By row: a number of the rows that share so many bytes with it."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def _strings_of(starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """How many strings of a length each context has."""
    return np.minimum(starts, np.maximum(0, sizes - length + 1))


def repeated_starts(contexts: list[bytes], backs: list[int], starts: list[int], lengths: tuple[int, ...] = (LENGTH, PASSAGE)) -> list[list[np.ndarray]]:
    """For each length and context a flag per string that the context's anchor owns: whether the string starts elsewhere in the
    contexts, at the same distance from an anchor modulo UNIT."""
    sizes, most = np.array([len(c) for c in contexts], dtype=np.int64), np.array(starts, dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    first = np.array(backs, dtype=np.int64) % UNIT
    units = np.maximum(0, (sizes - first) // UNIT)
    owner = np.repeat(np.arange(len(contexts)), units)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(units) - units, units)
    place = begin[owner] + first[owner] + UNIT * nth
    if not len(place):
        return [[np.zeros(n, bool) for n in _strings_of(most, sizes, length).tolist()] for length in lengths]
    _, rank = np.unique(np.ascontiguousarray(data[place[:, None] + np.arange(UNIT)]).view(f"V{UNIT}").ravel(), return_inverse=True)
    # the sequences of ranks, a number of its own behind each
    text = np.empty(len(place) + len(contexts), dtype=np.int64)
    at = np.arange(len(place)) + owner
    text[at] = rank.ravel() + len(contexts)
    text[np.cumsum(units) + np.arange(len(contexts))] = np.arange(len(contexts))
    row = np.full(len(text), -1, dtype=np.int64)
    row[at] = np.arange(len(place))
    array = row[np.array(suffix_order(text.tolist()), dtype=np.int64)]
    array = array[array >= 0]
    out = []
    for length in lengths:
        core = (length - UNIT + 1) // UNIT
        some = array[units[owner[array]] - nth[array] >= core]
        flags, own = np.zeros(len(data), dtype=bool), _strings_of(most, sizes, length)
        if len(some) > 1:
            cores = text[at[some][:, None] + np.arange(core)]
            kind = np.concatenate([[0], np.cumsum((cores[1:] != cores[:-1]).any(axis=1))])
            twice = np.bincount(kind)[kind] > 1
            _flag(flags, data, length, core, place[some[twice]], kind[twice], begin[owner[some[twice]]], sizes[owner[some[twice]]], own[owner[some[twice]]])
        out.append([flags[b : b + n] for b, n in zip(begin.tolist(), own.tolist(), strict=True)])
    return out


def _flag(flags: np.ndarray, data: np.ndarray, length: int, core: int, start: np.ndarray, kind: np.ndarray, left: np.ndarray, size: np.ndarray, own: np.ndarray) -> None:
    """Sets the flags of the repeated strings among those that hold the units from each start on; units of one kind are equal."""
    if not len(start):
        return
    behind = length - UNIT * core
    before, after = np.minimum(start - left, UNIT - 1), np.minimum(left + size - start - UNIT * core, behind)
    back, forth = start[:, None] - 1 - np.arange(UNIT - 1), start[:, None] + UNIT * core + np.arange(behind)
    heads = np.where(np.arange(UNIT - 1) < before[:, None], data[np.maximum(back, 0)], 0)
    tails = np.where(np.arange(behind) < after[:, None], data[np.minimum(forth, len(data) - 1)], 0)
    by_head, by_tail = _levels(kind, heads), _levels(kind, tails)
    for e in range(UNIT):  # strings that begin e bytes before the first whole unit
        fits = np.flatnonzero((before >= e) & (after >= behind - e) & (start - e - left < own))
        both = _numbers(*by_tail, behind - e)[fits] * (len(start) + 1) + _numbers(*by_head, e)[fits]
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        flags[start[fits[counts[inverse.ravel()] > 1]] - e] = True


def _compared(contexts: DataFrame) -> DataFrame:
    """(d, size, start, end): strings of a size that are repeated, of contexts that occur once, the rows of an anchor standing
    side by side."""

    def flush(rows: list[tuple], out: list[tuple]) -> None:
        for length, found in zip((LENGTH, PASSAGE), repeated_starts([r[6] for r in rows], [r[5] for r in rows], [r[4] for r in rows]), strict=True):
            for r, twice in zip(rows, found, strict=True):
                if r[1] == 1:
                    for i, j in zip(*_runs(twice), strict=True):
                        out.append((r[2], length, r[3] + int(i), r[3] + int(j) - 1 + length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            out.clear()
            return pa.RecordBatch.from_pydict({k: pa.array(x, pa.int64()) for k, x in zip(("d", "size", "start", "end"), cols, strict=True)})

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if size > ARRAY and rows[-1][0] != row[0]:
                    flush(rows, out)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
            yield packed()
        if rows:
            flush(rows, out)
        yield packed()

    return contexts.select("f", "n", "d", "low", "starts", "back", "context").mapInArrow(run, "d long, size long, start long, end long")


def _strings(contexts: DataFrame) -> DataFrame:
    """(f, key, size, once, d, start) of each string of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, n, d, low, starts, context in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                for length in (LENGTH, PASSAGE):
                    keys = string_keys(f, context, starts, length).view(np.int64)
                    k = len(keys)
                    yield pa.RecordBatch.from_pydict(
                        {"f": pa.array(np.full(k, f), pa.int64()), "key": pa.array(keys, pa.int64()), "size": pa.array(np.full(k, length), pa.int64()), "once": pa.array(np.full(k, n == 1)), "d": pa.array(np.full(k, d), pa.int64()), "start": pa.array(low + np.arange(k), pa.int64())}
                    )

    return contexts.select("f", "n", "d", "low", "starts", "context").mapInArrow(run, "f long, key long, size long, once boolean, d long, start long")


def _repeated_of_hot(contexts: DataFrame, tables: Tables) -> DataFrame:
    strings = tables.saved(_strings(contexts).withColumn("key", F.struct("f", "key", "size")), "strings")
    groups = tables.saved(strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-strings")
    hot = hot_keys(groups, "key", "n", strings.count())
    found = salted_join(strings.filter("once").drop("f"), groups.select("key"), "key", hot, F.xxhash64("d", "start"))
    return found.select("d", "size", "start", (F.col("start") + F.col("size")).alias("end"))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans(docs: DataFrame, text_col: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame, list[bytes]]:
    """((d, spans) of each different text with repeated strings, (digest) of the texts that occur as a whole more than once, the
    digests that need other numbers). A span is (start, short, long): repeated strings of PASSAGE bytes cover the text from start to
    short, those of LENGTH to long; 0 is none. The tables in between are deleted."""
    small_batches(docs.sparkSession)
    tables = Tables(docs.sparkSession)
    digests = tables.saved(_long_rows(docs, text_col).groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digests")
    odd = _shared_keys(digests)
    copies = tables.saved(digests.filter("n > 1").select("digest"), "copies")
    texts = _distinct(docs, text_col, copies, copies.count(), odd)
    found = tables.saved(_occurrences(texts), "occurrences")
    total = found.count()
    shared = tables.saved(found.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f"), "anchors")
    near = tables.saved(KeyFilter(shared, "f", shared.count()).mark(found, "f", "_hit").filter("_hit").drop("_hit"), "near")
    tables.drop(found, digests)
    # one row of each different context, the copy with the least (d, at)
    contexts = tables.saved(near.groupBy("f", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "at")).alias("w")).select("f", "c", "n", "w.*"), "contexts")
    per_anchor = tables.saved(contexts.groupBy("f").agg(F.count(F.lit(1)).alias("m"), F.max(F.when(F.col("n") == 1, 1).otherwise(0)).alias("open")).filter("m > 1 AND open = 1").select("f", (F.col("m") > group).alias("hot")), "open-anchors")
    wanted = tables.saved(contexts.join(per_anchor, "f").select("f", "n", "d", "at"), "wanted")
    is_hot = tables.saved(per_anchor.filter("hot").select("f"), "hot-anchors")
    # every step ends in a table, so that the shuffle files of one are gone before the next one begins
    key = F.struct("f", "c")
    twice = tables.saved(contexts.filter("n > 1").select(key.alias("k"), "n"), "repeated-contexts")
    tables.drop(contexts, per_anchor, shared)
    many = hot_keys(twice, "k", "n", total)
    whole = salted_join(near.select(key.alias("k"), "d", "at"), twice.select("k"), "k", many, F.xxhash64("d", "at"))
    long = F.when(_placed("stop") - _placed("low") >= LENGTH, _placed("stop")).otherwise(F.lit(0))
    whole = tables.saved(whole.select("d", _placed("low").alias("start"), (_placed("high") + PASSAGE).alias("short"), long.alias("long")), "whole-contexts")
    tables.drop(near, twice)
    asked = F.struct("f", "n", *[_placed(x).alias(x) for x in ("low", "high", "stop", "back")])
    by_text = wanted.groupBy("d").agg(F.collect_list(asked).alias("wanted"))
    holders = KeyFilter(wanted, "d", wanted.count()).mark(texts, "d", "_hit").filter("_hit").select("d", "text")
    fetched = _fetched(holders.join(by_text, "d"))
    if is_hot.isEmpty():
        cool, hot = fetched, None
    else:
        cool, hot = fetched.join(is_hot, "f", "left_anti"), fetched.join(is_hot, "f", "left_semi")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    removed = tables.saved(_compared(cool.repartition(parts, "f").sortWithinPartitions("f")), "compared")
    if hot is not None:
        removed = removed.unionByName(_repeated_of_hot(hot, tables))
    short = F.col("size") == PASSAGE
    removed = removed.select("d", "start", F.when(short, F.col("end")).otherwise(0).alias("short"), F.when(short, 0).otherwise(F.col("end")).alias("long"))
    out = tables.saved(removed.unionByName(whole).groupBy("d").agg(F.sort_array(F.collect_list(F.struct("start", "short", "long"))).alias("spans")), "spans")
    tables.drop_all_but(out, copies)
    return out, copies, odd


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in zip(starts, ends, strict=True):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, n_passage_bytes and kept (the remaining bytes) of each row."""
    found, copies, odd = spans(docs, text_col, group)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows = rows.withColumn("digest", sha256_digest(F.col("text"))).withColumn("d", _text_key(odd))
    rows = KeyFilter(found, "d", found.count()).mark(rows, "d", "_some")
    rows = KeyFilter(copies, "digest", copies.count()).mark(rows, "digest", "_many")
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    plain = rows.filter("NOT _some AND NOT _many").select("id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), zero.alias("n_passage_bytes"), F.col("text").alias("kept"))
    rest = rows.filter("_some OR _many").select("id", "text", "digest", "d", "_many")
    whole = salted_flag(rest.filter("_many"), copies)
    long = size >= LENGTH
    gone = whole.filter("_copy").select("id", size.alias("n_bytes"), F.when(long, size).otherwise(zero).alias("n_removed"), long.cast("long").alias("n_spans"), size.alias("n_passage_bytes"), F.when(long, F.lit(b"")).otherwise(F.col("text")).alias("kept"))
    some = rest.filter("NOT _many").unionByName(whole.filter("NOT _copy").drop("_copy")).join(found, "d", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, counts, passages, kept = [], [], [], [], []
            for text, span in zip(batch.column(1), batch.column(2), strict=True):
                raw, cut = text.as_py(), span.as_py() or []
                runs = merged([x["start"] for x in cut if x["long"]], [x["long"] for x in cut if x["long"]])
                parts, at = [], 0
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                n.append(len(raw))
                removed.append(sum(b - a for a, b in runs))
                counts.append(len(runs))
                passages.append(sum(b - a for a, b in merged([x["start"] for x in cut if x["short"]], [x["short"] for x in cut if x["short"]])))
                kept.append(b"".join(parts))
            cols = {"n_bytes": n, "n_removed": removed, "n_spans": counts, "n_passage_bytes": passages}
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | {k: pa.array(x, pa.int64()) for k, x in cols.items()} | {"kept": pa.array(kept, pa.binary())})

    cut = some.withColumn("id", F.col("id").cast("long")).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, n_passage_bytes long, kept binary")
    return plain.unionByName(gone).unionByName(cut).withColumnRenamed("id", id_col)


def salted_flag(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows with _copy: whether the digest is among copies. Rows are dealt by digest and id, the other side by salts for all
    digests, so that a text with very many copies does not meet in one task."""
    salts = 8
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    right = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_copy", F.lit(True))
    return left.join(right, ["digest", "_salt"], "left").withColumn("_copy", F.coalesce("_copy", F.lit(False))).drop("_salt")


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")


QUERIES = {"op10_repeated_spans": op10_repeated_spans}
ORACLE: dict[str, str] = {}
