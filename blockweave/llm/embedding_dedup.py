"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors form a class; only class representatives are compared. Representatives are dealt into tiles and
every pair of tiles is one bounded task, which walks over blocks of both: a tile has up to HELD numbers, so that
each vector is sent as seldom as memory allows (10 million vectors of 64 numbers: 611 times). In a task each unit vector is quantised to int8 with its own scale:
x = q/s + e, where |e| is computed exactly. Then

    |x.y - (qx.qy)/(sx sy)| <= |ex| (1 + |ey|) + |ey| (1 + |ex|) + |ex| |ey|,

so a pair whose integer product plus this bound stays under the threshold cannot be a link. The integer
products are exact in float32 (below 2**24) and computed as one matrix product. Only the pairs possibly
above the threshold are recomputed in double precision.

A task returns, for each vector, how many links it found (weighted by class sizes) and a spanning forest of
its links, never the pairs themselves. Work grows with the square of the number of distinct vectors, as any
exact comparison of all of them must here: random vectors give no usable bound for skipping tile pairs.

Edge cases: null or zero vectors, or with null or non-finite components, link with nothing; vectors of
different lengths do not link; rows with a null vec_id are compared like all others and stay: their component is the
smallest vec_id reachable, null (and kept true) if none is, and they count as links of others; repeated ids give a
row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import UnionFind, components
from .common import written

#: Vectors of a block within a task; numbers of a tile at most, on average; tiles up to which a tile stays one block.
TILE, HELD, FEW = 2048, 1 << 20, 24
#: Pairs recomputed at a time.
EXACT = 1 << 17


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, |error|) of unit rows: x = q / scale + error, q of -127 to 127 held as float32."""
    scale = 127.0 / np.abs(x).max(axis=1)
    q = np.rint(x * scale[:, None])
    err = np.sqrt(((x - q / scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return q.astype(np.float32 if x.shape[1] <= 1000 else np.float64), scale, err


def possible(xa: np.ndarray, xb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of unit vectors whose cosine may reach ``least``."""
    qa, sa, ea = quantised(xa)
    qb, sb, eb = quantised(xb)
    dots = qa @ qb.T
    dots *= (1 / sa)[:, None].astype(dots.dtype)
    dots *= (1 / sb)[None, :].astype(dots.dtype)
    # the bound is ea + eb + 3 ea eb; 3 ea eb <= 3 ea max(eb)
    dots += (ea * (1 + 3 * eb.max()) + 1e-5)[:, None].astype(dots.dtype)
    return np.nonzero(dots >= (least - eb)[None, :].astype(dots.dtype))


def links_between(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) with cosine >= ``least`` in double precision; with ``same``, only i < j."""
    norm = lambda x: np.sqrt((x * x).sum(axis=1))
    na, nb = norm(a), norm(b)
    i, j = possible(a / na[:, None], b / nb[:, None], least)
    if same:
        i, j = i[i < j], j[i < j]
    keep = [np.einsum("ij,ij->i", a[i[k : k + EXACT]], b[j[k : k + EXACT]]) / (na[i[k : k + EXACT]] * nb[j[k : k + EXACT]]) >= least for k in range(0, len(i), EXACT)]
    ok = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[ok], j[ok]


def _rows(vectors: np.ndarray) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # by powers of two: no rounding, no overflow


def _tile(least: float):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        first, second = np.flatnonzero(part["tile"] == lo), np.flatnonzero(part["tile"] == hi)
        ids, size, vectors = part["rep"].to_numpy(), part["size"].to_numpy(), part["embedding"].to_numpy()
        cut = lambda at: [at[k : k + TILE] for k in range(0, len(at), TILE)]
        n, forest = np.zeros(len(part), np.int64), UnionFind()
        fi, fj = [], []
        for x, a in enumerate(cut(first)):
            rows_a = _rows(vectors[a])
            for y, b in enumerate(cut(second)):
                if lo == hi and y < x:
                    continue
                same = lo == hi and x == y
                i, j = links_between(rows_a, rows_a if same else _rows(vectors[b]), least, same)
                i, j = a[i], b[j]
                np.add.at(n, i, size[j])
                np.add.at(n, j, size[i])
                for u, v in zip(i.tolist(), j.tolist(), strict=True):
                    if forest.union(u, v):
                        fi.append(u)
                        fj.append(v)
        some = n > 0
        return pd.DataFrame({"u": np.concatenate([ids[fi], ids[some]]), "v": pd.array([*ids[fj].tolist(), *[None] * int(some.sum())], dtype="Int64"), "n": np.concatenate([np.zeros(len(fi), np.int64), n[some]])})

    return run


def embedding_groups(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of ``vectors`` (vec_id, embedding)."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fit = F.coalesce(F.forall(e, finite) & F.exists(e, lambda x: x != 0), F.lit(False))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit, e).alias("embedding"))
    good = own.filter("embedding is not null")
    # a class is known by a number of its own: it may have no vec_id at all
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    total, dim = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    tiles = max(1, -(-total // max(TILE, HELD // max(1, dim or 1))), min(-(-total // TILE), FEW))
    dealt = classes.select("rep", "size", "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(tiles)).cast("int").alias("tile"))
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    dealt = dealt.select("*", other).select("*", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    found = written(dealt.groupBy("dim", "lo", "hi").applyInPandas(_tile(least), "u long, v long, n long"), "tiles")
    labels = components(found.filter("v is not null").select("u", "v")).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    named = classes.select("rep", "size", "least", "embedding").join(labels, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
    counts = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    named = written(named.join(counts, "rep", "left").select("embedding", "least", "group", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n")), "named")
    smallest = written(named.groupBy("group").agg(F.min("least").alias("component")), "smallest")
    about = named.join(smallest, "group").select("embedding", "n", "component")
    out = own.join(about, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
