"""MinHash near-dedup by an LSH forest, with every link confirmed on whole shingle sets.

1. Each text gives its set of word shingles, a 128-bit key of that set and a signature of minima. Texts of one set are one node.
2. The forest: TREES orders of the signature, each a sort of all nodes by the signature's values in that order. In an order a
   node's candidates are the REACH nodes before and behind it, which are those with the longest common prefixes: where nodes lie
   dense these are long, where they lie thin they may be as short as DEPTH values. So each region is searched as deep as it takes to
   be left with 2 * REACH candidates. Candidates whose signatures agree in at least NEAR of the values bind
   a region (a connected component of such pairs).
3. Within a region all links are found exactly on the whole sets. A set's shingles are ordered by how few sets of the region have
   them; two sets that are linked share one of the first 20 % (at 0.8) and one shingle more. Lists by those shingles give the
   sets to compare with; the most common shingles are compared as bits, 64 at once, the others only where the bits leave it open. A search
   from node to node takes each set that it links out of the lists, so no pair within a component is compared twice. Regions of more than REGION shingles or NODES nodes are cut into blocks, and each pair of blocks is
   searched by a task of its own.
4. The components of the confirmed links are the classes.

What can be missed: a pair at the threshold agrees in fewer than NEAR of the values with a chance of about 3 in 100,000; in one order its
prefix of DEPTH agrees with a chance of 0.5, and more than REACH nodes can stand between the two. Tests hold recall against brute force.

Nulls and empty texts have no set and are linked with nothing. Rows of one set share one class, named by the least id in it;
null ids lose against others. Rows are told apart by id and by a 64-bit hash of the text, so null and repeated ids over
different texts are rows of their own; of equal ids in a class the text of the least hash wins. A very long text is hashed in blocks. An
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import KeyFilter, documents, hot_keys, salted_join, saved, small_batches, text_or_empty
from sedgewing.llm.components import components
from sedgewing.llm.textnum import U, mix, shingles, word_hashes

TREES, VALUES, DEPTH, NEAR = 24, 48, 3, 26 / 48
#: Neighbours on either side of a node that are its candidates in an order.
REACH = 3
#: Values that an order compares with 16 bits; the others have 8.
WIDE = 4
#: Shingles and nodes of a region that one task holds at most.
REGION, NODES = 6_000_000, 20_000
#: Shingles of a region, the most common ones, that are kept as bits.
COMMON = 1024
_RNG = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64) * U(2) + U(1)
_XOR = _RNG.integers(1, 1 << 63, VALUES, dtype=np.uint64)
_ORDERS = np.array([_RNG.permutation(VALUES) for _ in range(TREES)])


def set_key(values: np.ndarray) -> bytes:
    """128 bits that name a sorted set of shingles."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def signature(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each of VALUES minima, by row; every row has a shingle."""
    out = np.empty((len(starts), VALUES), dtype=np.uint16)
    for v in range(VALUES):
        least = np.minimum.reduceat((hashes ^ _XOR[v]) * _MULTIPLY[v], starts)
        out[:, v] = (mix(least) >> U(40)).astype(np.uint16)
    return out


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, words, bounds in word_hashes(column):
        h, b = shingles(words, bounds, size)
        yield first, h, b


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_or_empty(text_col))


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, t, k, n, sig) of each row; t is a hash of the text, k and sig are null where there is no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, sigs = [], [], []
            for _, h, b in _sets(batch.column(2), size):
                filled = np.flatnonzero(np.diff(b) > 0)
                sig = signature(h, b[:-1][filled]) if len(filled) else None
                row = dict(zip(filled.tolist(), range(len(filled)), strict=True))
                for r in range(len(b) - 1):
                    if r in row:
                        u = np.unique(h[b[r] : b[r + 1]])
                        keys.append(set_key(u))
                        counts.append(len(u))
                        sigs.append(sig[row[r]].tobytes())
                    else:
                        keys.append(None)
                        counts.append(0)
                        sigs.append(None)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "t": batch.column(1), "k": pa.array(keys, pa.binary()), "n": pa.array(counts, pa.int64()), "sig": pa.array(sigs, pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("t"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, t long, k binary, n long, sig binary")


def _ordered(nodes: DataFrame) -> DataFrame:
    """A row for each tree and node: the signature's values in the tree's order, as bytes that compare in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, VALUES)
            for t in range(TREES):
                own = sig[:, _ORDERS[t]]
                wide = np.ascontiguousarray(own[:, :WIDE], dtype=">u2").view(np.uint8).reshape(len(own), 2 * WIDE)
                rows = np.concatenate([np.full((len(own), 1), t, np.uint8), wide, own[:, WIDE:].astype(np.uint8)], axis=1)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
                yield pa.RecordBatch.from_pydict({"place": flat.cast(pa.binary()), "k": batch.column(0)})

    return nodes.select("k", "sig").mapInArrow(run, "place binary, k binary")


def _bound(ordered: DataFrame, partitions: int) -> DataFrame:
    """Pairs (a, b) of candidates that bind a region. The range partitions are cut within long runs too, and each hands its
    first and last rows on, so that no neighbours are lost where it was cut."""
    head, width = 1 + 2 * DEPTH, 1 + 2 * WIDE + VALUES - WIDE
    schema = "a binary, b binary, place binary"

    def pairs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        near = np.flatnonzero((x[:, :head] == y[:, :head]).all(axis=1))
        same = x[near] == y[near]
        wide = same[:, 1 : 1 + 2 * WIDE].reshape(len(same), WIDE, 2).all(axis=2).sum(axis=1)
        return near[wide + same[:, 1 + 2 * WIDE :].sum(axis=1) >= NEAR * VALUES]

    def packed(a: np.ndarray, b: np.ndarray, place: list | None) -> pa.RecordBatch:
        last = pa.array(place, pa.binary()) if place is not None else pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "place": last})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, k, old = np.zeros((0, width), np.uint8), np.zeros(0, object), 0
        begun = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            more = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            if begun < REACH:
                first = min(REACH - begun, len(more))
                yield packed(keys[:first], keys[:first], [r.tobytes() for r in more[:first]])
                begun += first
            rows, k = np.concatenate([rows[-REACH:], more]), np.concatenate([k[-REACH:], keys])
            old = len(rows) - len(more)
            for w in range(1, REACH + 1):
                since = max(0, old - w)
                hit = pairs(rows[since:-w], rows[since + w :]) + since if len(rows) > since + w else np.zeros(0, np.int64)
                yield packed(k[hit], k[hit + w], None)
        yield packed(k[-REACH:], k[-REACH:], [r.tobytes() for r in rows[-REACH:]])

    dealt = ordered.repartitionByRange(partitions, "place", "k").sortWithinPartitions("place", "k")
    found = saved(dealt.mapInArrow(run, schema).dropDuplicates(["a", "b", "place"]), "neighbours")
    # 2 * REACH rows for each partition: as few as there are tasks
    edges = found.filter("place IS NOT NULL").select("place", F.col("a").alias("k")).coalesce(1).sortWithinPartitions("place", "k")
    seams = edges.mapInArrow(run, schema).filter("place IS NULL")
    return found.filter("place IS NULL").unionByName(seams).select("a", "b").filter("a <> b").distinct()


class Region:
    """Exact links among whole sets."""

    def __init__(self, sets: list[np.ndarray], numerator: int, denominator: int):
        self.num, self.den, self.n = numerator, denominator, len(sets)
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        values, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        order = np.argsort(counts, kind="stable")
        by_rarity = np.empty(len(values), dtype=np.int64)
        by_rarity[order] = np.arange(len(values))
        owner = np.repeat(np.arange(self.n), self.size)
        self.tokens = by_rarity[ids.ravel()]
        self.tokens = self.tokens[np.lexsort((self.tokens, owner))]  # a set's rarest first
        # a set has at least num/den of its shingles in common with one that it is linked with: one is among so many of the rarest
        self.head = self.size + 1 - -(-self.num * self.size // self.den)
        self.mark = np.zeros(len(values), dtype=bool)
        # common shingles are bits of words, and those between them and the ones of one set alone are compared as they are
        n_common = min(COMMON, int((counts >= max(8, self.n // 128)).sum()))
        first = len(values) - n_common
        common = self.tokens >= first
        flags = np.zeros((self.n, -(-max(1, n_common) // 64) * 64), dtype=bool)
        flags[owner[common], self.tokens[common] - first] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)
        middle = ~common & (counts[order][self.tokens] > 1)
        self.rest = np.bincount(owner[middle], minlength=self.n)
        self.middle, self.middle_at = self.tokens[middle], np.concatenate([[0], np.cumsum(self.rest)])

    def _heads(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in tokens, node) of each shingle in the nodes' heads."""
        n = self.head[nodes]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.at[nodes], n) + inner, np.repeat(nodes, n)

    def _indexed(self, nodes: np.ndarray) -> None:
        """Inverted lists over the heads of the nodes that can still be linked."""
        place, node = self._heads(nodes)
        token = self.tokens[place]
        self.listed = node[np.argsort(token, kind="stable")]
        self.starts = np.zeros(len(self.mark) + 1, dtype=np.int64)
        np.cumsum(np.bincount(token, minlength=len(self.mark)), out=self.starts[1:])
        self.live = nodes, self.bits[nodes], self.size[nodes], self.rest[nodes]

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links."""
        self._indexed(np.arange(self.n))
        place, node = self._heads(np.arange(self.n))
        lone = np.diff(self.starts)[self.tokens[place]] == 1
        left = np.bincount(node[~lone], minlength=self.n) > 0  # the others share no shingle of their heads
        many = held = int(left.sum())
        roots = np.flatnonzero(left)
        self._indexed(roots)
        out: list[tuple[int, int]] = []
        for root in roots[np.argsort(-self.size[roots], kind="stable")].tolist():
            if not left[root]:
                continue
            left[root] = False
            many -= 1
            stack = [root]
            while stack and many:
                x = stack.pop()
                if many * 2 < held:  # the lists shrink as nodes leave them
                    self._indexed(np.flatnonzero(left))
                    held = many
                hit = self._linked(x, left)
                left[hit] = False
                many -= len(hit)
                out += [(x, y) for y in hit.tolist()]
                stack += hit.tolist()
            if not many:
                break
        return out

    def _linked(self, x: int, left: np.ndarray) -> np.ndarray:
        """The nodes left that x is linked with."""
        head = self.tokens[self.at[x] : self.at[x] + self.head[x]]
        n = self.starts[head + 1] - self.starts[head]
        if 4 * n.sum() < len(self.live[0]):
            near = np.unique(self.listed[np.repeat(self.starts[head] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            bits, size, rest = self.bits[near], self.size[near], self.rest[near]
        else:
            near, bits, size, rest = self.live
        both = np.bitwise_count(bits & self.bits[x]).sum(axis=1, dtype=np.int64)
        wanted = self.num * (self.size[x] + size)
        may = np.flatnonzero(((both + np.minimum(rest, self.rest[x])) * (self.num + self.den) >= wanted) & left[near])
        sure = both[may] * (self.num + self.den) >= wanted[may]
        open_ = may[~sure]
        if not len(open_):
            return near[may]
        own = self.middle[self.middle_at[x] : self.middle_at[x + 1]]
        n = rest[open_]
        self.mark[own] = True
        shared = self.mark[self.middle[np.repeat(self.middle_at[near[open_]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        self.mark[own] = False
        upto = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(n)])]
        found = (both[open_] + np.diff(upto)) * (self.num + self.den) >= wanted[open_]
        return near[np.concatenate([may[sure], open_[found]])]


def _confirmed(rows: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """Links (a, b) from rows (task, k, text) sorted by task: all nodes of one task at once."""

    def flush(keys: list[bytes], sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        return [(keys[x], keys[y]) for x, y in Region(sets, numerator, denominator).links()] if len(sets) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, sets, seen, found = None, [], [], set(), []
        for batch in batches:
            tasks, ks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, h, b in _sets(batch.column(2), size):
                for r in range(len(b) - 1):
                    if tasks[first + r] != now:
                        found += flush(keys, sets)
                        now, keys, sets, seen = tasks[first + r], [], [], set()
                    k = ks[first + r]
                    u = np.unique(h[b[r] : b[r + 1]])
                    if len(u) and k not in seen and set_key(u) == k:
                        seen.add(k)
                        keys.append(k)
                        sets.append(u)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})
            found = []
        found = flush(keys, sets)
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return rows.mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100, region: int = REGION, most: int = NODES) -> DataFrame:
    """(id, t, n_shingles, component_id, k, copies, best) of each row of docs; best: the row is the one that its class keeps, or
    repeats it in id and text."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = saved(signed(docs, id_col, text_col, size), "signatures")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("t").alias("t"))  # the least is kept
    nodes = saved(rows.filter("k IS NOT NULL").groupBy("k").agg(F.min(place).alias("w"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    regions = saved(components(_bound(_ordered(nodes), partitions)), "regions")
    bound = regions.unionByName(regions.select(F.col("root").alias("node"), "root").distinct())
    members = saved(bound.withColumnRenamed("node", "k").join(nodes.select("k", F.col("w.id").alias("least"), F.col("w.t").alias("t"), "n"), "k"), "members")
    # blocks: 1 for a region that fits one task
    weights = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / F.lit(region / 2)), F.ceil(F.count(F.lit(1)) / F.lit(most / 2))).cast("int").alias("cuts"))
    weights = weights.withColumn("cuts", F.when(F.col("cuts") <= 2, 1).otherwise(F.col("cuts")))
    large = weights.filter("cuts > 1")
    tasks = members.join(F.broadcast(large) if large.count() <= 10_000 else large, "root", "left")
    cuts, block = F.coalesce(F.col("cuts"), F.lit(1)), F.pmod(F.xxhash64("k"), F.coalesce(F.col("cuts"), F.lit(1))).cast("int")
    tasks = tasks.withColumn("_i", block).withColumn("_j", F.explode(F.sequence(F.lit(0), cuts - 1)))
    task = F.struct(F.col("root"), F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"))
    n_members = members.count()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("_t"), text_or_empty(text_col).cast("binary").alias("text"))
    keys = KeyFilter(members.select(F.xxhash64("least", "t").alias("_key")), "_key", n_members)
    texts = keys.mark(texts.withColumn("_key", F.xxhash64("id", "_t")), "_key", "_hit").filter("_hit").drop("_hit", "_key")
    work = texts.join(tasks.select(task.alias("task"), "k", "least", "t"), F.col("id").eqNullSafe(F.col("least")) & (F.col("_t") == F.col("t")))
    work = work.select(F.xxhash64("task", F.lit(1)).alias("task"), "k", "text").repartition(partitions, "task").sortWithinPartitions("task")
    links = components(_confirmed(work, size, numerator, denominator))
    named = links.unionByName(links.select(F.col("root").alias("node"), "root").distinct())
    least = named.withColumnRenamed("node", "k").join(nodes.select("k", "w"), "k")
    names = least.groupBy("root").agg(F.min("w").alias("first"))
    by_node = least.join(names, "root").select("k", "first")
    by_node = nodes.select("k", "w", "copies").join(by_node, "k", "left").select("k", "copies", F.coalesce("first", "w").alias("first"))
    hot = hot_keys(nodes, "k", "copies", nodes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0])
    some = salted_join(rows.filter("k IS NOT NULL").select("id", "t", "n", "k"), by_node, "k", hot, F.xxhash64("id", "t"))
    some = some.withColumn("best", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("t") == F.col("first.t")))
    none = rows.filter("k IS NULL").select("id", "t", "n", "k", F.lit(1).cast("long").alias("copies"), F.col("id").alias("component_id"), F.lit(True).alias("best"))
    both = some.select("id", "t", "n", "k", "copies", F.col("first.id").alias("component_id"), "best").unionByName(none)
    return both.select("id", "t", F.col("n").alias("n_shingles"), "component_id", "k", "copies", "best")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100, region: int = REGION, most: int = NODES) -> DataFrame:
    out = classes(docs, id_col, text_col, size, numerator, denominator, region, most)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("best").alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """docs with one row of each class, all columns kept; rows without a word all stay. Only rows that may have lost or that
    are repeated are shuffled."""
    out = classes(docs, id_col, text_col, size, numerator, denominator).filter("k IS NOT NULL AND (NOT best OR copies > 1)")
    marks = saved(out.groupBy(F.col("id").alias("_lost"), F.col("t").alias("_text"), "best").agg(F.count(F.lit(1)).alias("n")).filter("NOT best OR n > 1").drop("n"), "marks")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_own"), text_hash(text_col).alias("_t"))
    keys = KeyFilter(marks.select(F.xxhash64("_lost", "_text").alias("_key")), "_key", marks.count())
    marked = keys.mark(rows.withColumn("_key", F.xxhash64("_own", "_t")), "_key", "_hit")
    both = marked.filter("_hit").join(marks, F.col("_own").eqNullSafe(F.col("_lost")) & (F.col("_t") == F.col("_text")), "left").filter("best IS NULL OR best")
    stays = both.withColumn("_one", F.when(F.col("best"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id())).dropDuplicates(["_own", "_t", "_one"])
    return marked.filter(~F.col("_hit")).select("_row").unionByName(stays.select("_row")).select("_row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir), size=4)


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE: dict[str, str] = {}
