"""Centroid clustering in exact integers, with N-simplex projection as the filter.

Vectors become integers floor(SCALE * x).  A few of the initial centroids serve as pivots: they span a simplex, and a vector's
distances to them, computed once and kept, are turned into the coordinates of the apex that has these distances to the simplex's
corners.  Two apexes with altitudes h and g over a base distance b are at least sqrt(b^2 + (h - g)^2) and at most
sqrt(b^2 + (h + g)^2) apart in the space of vectors.  In each round a vector's centroids whose lower bound is above the least
upper bound are out; the others are compared by exact integer distance.  Bounds are doubles and carry a margin far above their
rounding error, so that no nearest centroid, tied ones included, is ever filtered out.

Vectors never move: the table of vectors and apexes is written once, a round sends 40 centroids out and gets sums for each task
and centroid back, added up in integers.

Cases: vectors that are null, of another length, or hold a null, NaN or infinite component aren't kept and give no row; an
integer component beyond +-LIMIT counts as LIMIT, so that squared distances fit in a long; with fewer kept vectors than CENTROIDS
each of them starts a centroid; equal vectors may start several, of which the first wins all ties; a null vec_id hashes as the
empty string; repeated rows are vectors of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
PIVOTS, FLAT, MARGIN = 32, 0.1, 1e-7
LIMIT = 1 << 27
PAIRS = 50_000


def kept_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, v): v is array<int>."""
    v = F.col("_v")
    whole = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    whole = whole.where((F.size(v) == components) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    cut = lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(SCALE * x, F.lit(-1.0 * LIMIT)), F.lit(1.0 * LIMIT))), F.lit(LIMIT)), F.lit(-LIMIT))
    return whole.select("vec_id", F.transform(v, lambda x: cut(x).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS, seed: str = SEED):
    """int64 [at most k, components]: the vectors of least hash, in its order."""
    import numpy as np

    key = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], "i8")


class Simplex:
    """Pivots, and the triangular system that turns distances to them into an apex."""

    def __init__(self, vectors, most: int = PIVOTS, flat: float = FLAT):
        """Pivots are picked from a few vectors: each next one has the greatest altitude over the base so far; nearly flat ones are left out."""
        import numpy as np

        points = np.asarray(vectors, float)
        rest, picked, axes = points - points[0], [0], []
        while len(picked) < most:
            height = np.sqrt((rest**2).sum(1))
            k = int(height.argmax())
            if height[k] <= (flat * axes[0][1] if axes else 0):
                break
            axis = rest[k] / height[k]
            rest = rest - np.outer(rest @ axis, axis)
            picked.append(k)
            axes.append((axis, height[k]))
        self.pivots = np.asarray(vectors, "i8")[picked]
        edges = points[picked[1:]] - points[0]
        base = np.array([[e @ axis if j <= i else 0.0 for j, (axis, _) in enumerate(axes)] for i, e in enumerate(edges)]).reshape(len(edges), len(axes))
        self.solve, self.edges = np.linalg.inv(base), (edges**2).sum(1)

    def apexes(self, v):
        """float64 [rows, pivots + 1]: coordinates, altitude, and the squared distance to the first pivot (for the margin)."""
        import numpy as np

        d = np.stack([((v - p).astype(float) ** 2).sum(1) for p in self.pivots], 1)
        at = (d[:, :1] + self.edges - d[:, 1:]) / 2 @ self.solve.T
        return np.column_stack([at, np.sqrt(np.maximum(d[:, 0] - (at**2).sum(1), 0)), d[:, 0]])


def candidates(a, c, margin: float = MARGIN):
    """bool [vectors, centroids] from two arrays of apexes: what the bounds can't exclude."""
    import numpy as np

    x, y = a[:, :-2], c[:, :-2]
    base = (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)
    h, g = a[:, -2][:, None], c[:, -2]
    slack = margin * (a[:, -1][:, None] + c[:, -1] + 1)
    return base + (h - g) ** 2 - slack <= np.min(base + (h + g) ** 2 + slack, axis=1, keepdims=True)


def nearest(v, apex, centroids, centroid_apex):
    """(centroid, squared distance) of each row of v: exact integers, ties to the smaller number."""
    import numpy as np

    row, k = np.nonzero(candidates(apex, centroid_apex))
    found = np.full((len(v), len(centroids)), np.iinfo("i8").max)
    for at in range(0, len(row), PAIRS):
        r, c = row[at : at + PAIRS], k[at : at + PAIRS]
        found[r, c] = ((v[r] - centroids[c]) ** 2).sum(1)
    best = found.argmin(1)
    return best, found[np.arange(len(v)), best]


def _matrix(column, width: int, kind: str):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width) if len(column) else np.zeros((0, width), kind)


def _projected(simplex: Simplex):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            apex = simplex.apexes(_matrix(batch.column("v"), simplex.pivots.shape[1], "i8"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(apex) + 1, dtype="i4") * apex.shape[1]), pa.array(apex.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), flat], ["vec_id", "v", "apex"])

    return run


def _assigned(simplex: Simplex, centroids):
    """Batches of (vec_id, v, apex) -> (batch, vectors, centroid of each, distance of each)."""
    apexes = simplex.apexes(centroids)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            v = _matrix(batch.column("v"), centroids.shape[1], "i8")
            yield batch, v, *nearest(v, _matrix(batch.column("apex"), apexes.shape[1], "f8"), centroids, apexes)

    return run


def _sums(simplex: Simplex, centroids):
    """A row for each centroid that got vectors in this task: number and componentwise sums."""
    assigned = _assigned(simplex, centroids)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total, n = np.zeros(centroids.shape, "i8"), np.zeros(len(centroids), "i8")
        for _batch, v, cluster, _distance in assigned(batches):
            order = np.argsort(cluster, kind="stable")
            at, start = np.unique(cluster[order], return_index=True)
            if len(at):
                total[at] += np.add.reduceat(v[order], start)
                n += np.bincount(cluster, minlength=len(n))
        at = np.flatnonzero(n)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype="i4") * total.shape[1]), pa.array(total[at].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(n[at]), flat], ["cluster", "n", "sums"])

    return run


def _labelled(simplex: Simplex, centroids):
    assigned = _assigned(simplex, centroids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, _v, cluster, distance in assigned(batches):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype("i4")), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def moved(centroids, sums: DataFrame):
    """Centroids after a round; sums has at most one row for each centroid and task, and one for each centroid comes to the driver."""
    parts = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), *parts).collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return new


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, pivots: int = PIVOTS):
    """((vec_id, cluster, distance), centroids): the assignment to the final centroids, and these as int64 [centroids, components]."""
    kept = kept_vectors(df, id_col, vector_col, components)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    simplex = Simplex(centroids, pivots)
    id_type = dict(kept.dtypes)["vec_id"]
    cached = common.materialize(kept.mapInArrow(_projected(simplex), f"vec_id {id_type}, v array<int>, apex array<double>"), "apexes")
    for _ in range(rounds):
        centroids = moved(centroids, cached.select("vec_id", "v", "apex").mapInArrow(_sums(simplex, centroids), "cluster int, n long, sums array<long>"))
    return cached.mapInArrow(_labelled(simplex, centroids), f"vec_id {id_type}, cluster int, distance long"), centroids


def op11_simplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster(common.read(spark, sf_dir, "embeddings"))
    assigned = common.materialize(assigned, "clusters")
    inertia = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster")) if len(values) else F.lit(None)
    own = of([inertia.get(i, 0) for i in range(len(names))]).cast("long").alias("cluster_inertia")
    return assigned.select("vec_id", "cluster", "distance", own, F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(names).cast("string").alias("centroid_sha256"))


def _oracle_sql() -> str:
    """One assignment and one update of centroids for each round, as common table expressions."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        f"p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM p ORDER BY 1, 2 LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, k := k)) AS m FROM (SELECT p.r, c.k, {distance} AS d FROM p CROSS JOIN c{i} AS c) GROUP BY r)")
        if i < ROUNDS:
            ctes.append(f"u{i} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT a.m.k AS k, j.i AS i, CAST(sum(p.v[j.i]) AS BIGINT) AS s, count(*) AS n FROM a{i} AS a JOIN p USING (r) CROSS JOIN (SELECT unnest(range(1, {COMPONENTS + 1})) AS i) AS j GROUP BY 1, 2) GROUP BY k)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(u.v, c.v) AS v FROM c{i} AS c LEFT JOIN u{i} AS u USING (k))")
    return f"WITH {', '.join(ctes)} SELECT p.vec_id, CAST(a.m.k AS INTEGER) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} AS a JOIN p USING (r) JOIN c{ROUNDS} AS c ON c.k = a.m.k"


ORACLE_SQL = _oracle_sql()
