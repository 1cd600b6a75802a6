"""Exact and near dedup and repeated spans, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sedgewing.llm import exact_dedup, near_dedup, repeated_spans
from sedgewing.llm.components import components
from sedgewing.llm.suffix_groups import suffix_order

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.3:
            words = (rng.choice(out)[1] or "a").split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = "zz" + str(rng.randint(0, 9))
            out.append((i, " ".join(words)))
        elif kind < 0.36:
            out.append((i, rng.choice(["", None, "one", "Two Words", "a b c", " \n\t", "\x00é"])))
        else:
            out.append((i, prose(rng, rng.randint(1, 120))))
    return out


ODD = [(1, None), (2, ""), (3, " \n"), (4, "x"), (4, "x"), (None, "x"), (None, None), (5, "w " * 60_000), (6, "\x00é\U0001f600 " * 50)]


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(texts, k, num=80, den=100):
    sets = {i: shingles(t, k) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_exact_against_brute_force(spark):
    texts = corpus()
    groups: dict = {}
    for i, t in texts:
        groups.setdefault(t or "", []).append(i)
    got = {r["doc_id"]: r for r in exact_dedup.verdicts(frame(spark, texts)).collect()}
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.deduplicated(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(ids) for ids in groups.values())
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_exact_verifies_bytes_of_equal_digests(spark):
    texts = [(1, "aa"), (2, "ab"), (3, "aa"), (4, "b")]
    clash = lambda t: F.unhex(F.sha2(F.substring(t, 1, 1).cast("binary"), 256))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.verdicts(frame(spark, texts), digest=clash).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_exact_on_odd_rows(spark):
    df = frame(spark, ODD).withColumns({"digest": F.lit(1), "_hit": F.lit(2), "keep_id": F.lit(3)})
    got = exact_dedup.verdicts(df).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert by[4] == [(4, 3, True)] * 2 and sorted(by[None]) == [(2, 3, False), (4, 3, False)]
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns and kept.count() == 5 + 0
    assert exact_dedup.verdicts(df.limit(0)).count() == 0 and exact_dedup.deduplicated(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    parent = {v: v for e in edges for v in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).select("node", "root").collect())
    assert got == {v: find(v) for v in parent if find(v) != v}


@pytest.mark.parametrize(("k", "region"), [(4, near_dedup.REGION), (5, near_dedup.REGION), (4, 300)])
def test_near_against_brute_force(spark, k, region):
    texts = corpus(7)
    want = brute_classes(texts, k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.verdicts(frame(spark, texts), size=k, region=region).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_near_threshold_is_met_exactly(spark):
    # 80 of 100 shingles in common link, 79 of 100 don't
    base = [f"w{i}" for i in range(93)]
    a, b = " ".join(base), " ".join([*base[:83], *[f"x{i}" for i in range(10)]])
    want = brute_classes([(1, a), (2, b)], 4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.verdicts(frame(spark, [(1, a), (2, b)]), size=4).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_near_on_odd_rows(spark):
    df = frame(spark, ODD).withColumns({"_own": F.lit(1), "_hit": F.lit(2), "k": F.lit(3), "sig": F.lit(4)})
    got = near_dedup.verdicts(df).collect()
    assert len(got) == len(ODD)
    assert {(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(0, 1, True), (0, 2, True), (0, 3, True)}
    assert {(r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] and r["doc_id"] in (4, None)} == {(4, 4), (None, 4)}
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and kept.filter("_hit <> 2").isEmpty()
    assert near_dedup.verdicts(df.limit(0)).count() == 0 and near_dedup.deduplicated(df.limit(0)).count() == 0


def test_near_tells_rows_of_null_and_repeated_ids_apart(spark):
    rng = random.Random(21)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    # a and d: near copies with a null against an id, and of one id; b: clean under null; c, f: clean under a repeated id, f's twin lost
    rows = [(1, a), (None, a + " end"), (None, b), (5, c), (5, d), (5, d + " end"), (None, e), (None, e + " end"), (7, f), (8, f + " end"), (8, b + " " + c), (9, None), (9, None), (7, f)]
    got = sorted(near_dedup.deduplicated(frame(spark, rows)).select("doc_id", "text").collect(), key=str)
    count = lambda *texts: sum(r["text"] in texts for r in got)
    assert [count(x, x + " end") for x in (a, d, e, f)] == [1, 1, 1, 1]
    assert (1, a) in got and (7, f) in got and (None, b) in got and (5, c) in got and (8, b + " " + c) in got
    assert count(None) == 2 and len(got) == 9
    kept = [(r["doc_id"], r["kept"]) for r in near_dedup.verdicts(frame(spark, rows)).collect()]
    assert len(kept) == len(rows) and sum(k for _, k in kept) == 10  # the repeated row of 7 is kept twice there


def test_suffix_order():
    rng = random.Random(3)
    for _ in range(1500):
        x = [rng.randint(0, rng.choice([0, 1, 2, 9])) for _ in range(rng.randint(0, 24))]
        assert suffix_order(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_spans(texts, length):
    seen = Counter()
    for _, t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t in texts:
        b = (t or "").encode()
        runs = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        kept, at = b"", 0
        for x, y in runs:
            kept += b[at:x]
            at = y
        out.append((i, len(b), sum(y - x for x, y in runs), len(runs), kept + b[at:]))
    return sorted(out, key=str)


def spanned_corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(80, 300)) for _ in range(4)] + ["é" * 350, "ab" * 500]
    out = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 250))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(t))
            t = t[:at] + p[cut : cut + rng.randint(300, 900)] + t[at:]
        out.append((i, t))
    return [*out, (60, out[3][1]), (61, None), (62, ""), (63, "q" * 399), (64, "q" * 400), (65, "z" * 2000), (66, out[3][1])]


def spans_of(got):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)


@pytest.mark.parametrize("group", [repeated_spans.GROUP, 2])
def test_repeated_spans_against_brute_force(spark, group):
    texts = spanned_corpus(11)
    got = repeated_spans.cleaned(frame(spark, texts), group=group).collect()
    assert spans_of(got) == brute_spans(texts, 400)
    assert sorted(((r.doc_id, r.n_passage_bytes) for r in got), key=str) == sorted(((x[0], x[2]) for x in brute_spans(texts, 280)), key=str)


def test_repeated_spans_on_odd_rows(spark):
    df = frame(spark, ODD).withColumns({"d": F.lit(1), "spans": F.lit(2), "kept": F.lit(3), "digest": F.lit(4)})
    assert spans_of(repeated_spans.cleaned(df).collect()) == brute_spans(ODD, 400)
    assert repeated_spans.cleaned(df.limit(0)).count() == 0


def test_repeated_spans_leave_their_result_alone_in_the_shared_folder(spark):
    """The tables in between are deleted, and the result can be read twice."""
    out = repeated_spans.cleaned(frame(spark, spanned_corpus(5)))
    assert sorted(out.collect(), key=str) == sorted(out.collect(), key=str)


def test_repeated_starts_within_one_array():
    rng = random.Random(4)
    shared = bytes(rng.randrange(97, 101) for _ in range(460))
    parts = [bytes(rng.randrange(97, 101) for _ in range(40)) for _ in range(6)]
    contexts = [parts[0] + shared + parts[1], parts[2][:37] + shared[3:] + parts[3], parts[4] + shared[:430] + parts[5]]
    starts = [len(c) - 279 for c in contexts]
    for length, found in zip((400, 280), repeated_spans.repeated_starts(contexts, [40, 34, 40], starts), strict=True):
        for c, flags in zip(contexts, found, strict=True):
            assert len(flags) == len(c) - length + 1
            for i, f in enumerate(flags):
                want = sum(x.count(c[i : i + length]) for x in contexts) > 1
                assert bool(f) == want, (length, i)
