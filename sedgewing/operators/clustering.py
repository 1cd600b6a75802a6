"""k-means of vectors, quantisation and the silhouette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewing.scratch import written


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _centre_array(centres: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])


def nearest(vector: Column, centres: list[list[float]], last: bool = False) -> Column:
    """(distance, at): the closest centre, the first (or the last) of equally close ones. The centres are a parameter of k rows."""
    cs, sign = _centre_array(centres), -1 if last else 1
    found = F.array_min(F.transform(cs, lambda c, i: F.struct(squared_distance(vector, c).alias("distance"), (i * sign).alias("at"))))
    return F.struct(found["distance"].alias("distance"), (found["at"] * sign).alias("at")) if last else found


def quantised(df: DataFrame, vector: str, centres: list[list[float]], last: bool = False) -> DataFrame:
    """df with the number of the nearest centre (of equally close ones the first, or the last) and the squared distance to it."""
    return df.withColumn("_n", nearest(F.col(vector).cast("array<double>"), centres, last)).withColumn("cluster", F.col("_n.at")).withColumn("distance", F.col("_n.distance")).drop("_n")


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1, restarts: int = 1, rounds: int = 50, tolerance: float = 1e-6, id_col: str | None = None) -> tuple[list[list[float]], float]:
    """(centres, sum of squared distances) of the best restart. Seeding draws each further centre with a chance in proportion to the squared
    distance to the chosen ones (an exponential race over hashes, so it is the same on every machine); a round is one map-side aggregate per dimension."""
    rows = written(df.select(F.col(vector).cast("array<double>").alias("v"), (F.col(id_col) if id_col else F.xxhash64(vector)).alias("i")).filter("v IS NOT NULL"), "vectors")
    width = rows.select(F.size("v")).first()
    if width is None:
        return [], 0.0
    best: tuple[list[list[float]], float] | None = None
    for r in range(restarts):
        centres: list[list[float]] = []
        for c in range(k):
            u = (F.pmod(F.xxhash64("i", F.lit(seed), F.lit(r), F.lit(c)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
            weight = nearest(F.col("v"), centres)["distance"] if centres else F.lit(1.0)
            chosen = rows.withColumn("_w", weight).filter("_w > 0").agg(F.min_by("v", F.struct((-F.log(u) / F.col("_w")).alias("race"), F.col("i")))).first()[0]
            if chosen is None:
                break
            centres.append([float(x) for x in chosen])
        error = None
        for _ in range(rounds):
            near = rows.select("v", nearest(F.col("v"), centres).alias("n"))
            sums = near.groupBy("n.at").agg(F.count(F.lit(1)).alias("m"), F.sum("n.distance").alias("e"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(width[0])]).collect()
            now = sum(x["e"] for x in sums)
            if error is not None and error - now <= tolerance * max(error, 1e-300):
                error = now
                break
            error = now
            for x in sums:
                centres[x["at"]] = [x[f"s{j}"] / x["m"] for j in range(width[0])]
        if best is None or error < best[1]:
            best = centres, error
    return best


def rephred(counts: dict[int, int], k: int, rounds: int = 100) -> dict[int, int]:
    """A coarser table of Phred values: the error probabilities of a histogram of qualities (94 values at most) are put into k
    clusters by their weights, and each value becomes that of its cluster's mean error."""
    import math

    points = sorted((10 ** (-q / 10), n, q) for q, n in counts.items() if n > 0)
    if not points:
        return {}
    k = min(k, len(points))
    centres = [points[len(points) * (2 * i + 1) // (2 * k)][0] for i in range(k)]
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for x in points:
            groups.setdefault(min(range(k), key=lambda i: abs(centres[i] - x[0])), []).append(x)
        now = [sum(p * n for p, n, _ in groups[i]) / sum(n for _, n, _ in groups[i]) if i in groups else centres[i] for i in range(k)]
        if now == centres:
            break
        centres = now
    return {q: round(-10 * math.log10(centres[min(range(k), key=lambda i: abs(centres[i] - p))])) for p, _, q in points}


def silhouette(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """One row (silhouette, points): the mean over all points of (b - a) / max(a, b), a being the mean squared distance to the own
    cluster, the point itself included, b the least mean to another. A mean squared distance follows from a cluster's moments,
    so the cost is points times clusters. The clusters' moments, k rows, are gathered into one row."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(cluster).alias("c")).filter("v IS NOT NULL")
    width = rows.select(F.size("v")).first()
    if width is None:
        return rows.agg(F.avg(F.lit(None).cast("double")).alias("silhouette"), F.count(F.lit(1)).alias("points"))
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    moments = rows.groupBy("c").agg(F.avg(norm(F.col("v"))).alias("q"), F.array(*[F.avg(F.col("v")[j]) for j in range(width[0])]).alias("m"))
    few = moments.agg(F.collect_list(F.struct("c", "q", "m")).alias("all"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    far = F.transform("all", lambda k: F.struct(k["c"].alias("c"), (norm(F.col("v")) - 2 * dot(F.col("v"), k["m"]) + k["q"]).alias("d")))
    rows = rows.join(F.broadcast(few)).withColumn("_d", far)
    a = F.array_min(F.transform(F.filter("_d", lambda x: x["c"] == F.col("c")), lambda x: x["d"]))
    b = F.array_min(F.transform(F.filter("_d", lambda x: x["c"] != F.col("c")), lambda x: x["d"]))
    return rows.select(((b - a) / F.greatest(a, b)).alias("s")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("points"))
