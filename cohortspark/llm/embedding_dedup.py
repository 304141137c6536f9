"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, then double precision where they don't decide.

Distinct vectors are dealt into blocks and quantised once. The codes of a block, packed into one value, meet those of every other: a
pair of blocks is a tile. A tile multiplies int8 codes (exact in float32 while sums stay below 2^24, in double precision beyond) and bounds each cosine from both sides by the
two vectors' quantisation errors. Most pairs are decided by that. Of the others a tile names the vectors, never the pairs; these vectors alone
travel in full precision, to the tiles that asked for them, and the same bounds name the pairs again. A tile reports link counts
per vector and the edges of a spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import query, stored, table
from cohortspark.llm.components import components, spanning

BLOCK = 2048  #: vectors to a block, about


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, and the exact length of what each code misses."""
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    miss = np.linalg.norm(unit - codes * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return codes, scale, miss


def tile_bounds(one: tuple, two: tuple, threshold: float, same: bool, rows: int = 512):
    """(first row, sure, unsure) of slices of `rows` rows of the first block: which pairs of quantised rows link for sure, and which only may.

    For u = q + e the product u.v lies within |e_u| + |e_v| + |e_u||e_v| of q_u.q_v, as |q| <= 1 + |e|. Pairs whose upper bound falls short of the threshold
    can't link. Every step works cell by cell on the codes, so that a pair is judged alike whatever rows stand round it. With `same` both are one block, and a pair counts once.
    """
    qa, sa, ea = one
    qb, sb, eb = two
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    fb = qb.T.astype(exact)
    for at in range(0, len(qa), rows):
        part = slice(at, min(len(qa), at + rows))
        rough = qa[part].astype(exact) @ fb
        # u.v - q_u.q_v = q_u.e_v + e_u.q_v + e_u.e_v, and |q_u| <= 1 + |e_u|
        worst = (1 + ea[part])[:, None] * eb[None] + ea[part][:, None] * (1 + eb)[None] + ea[part][:, None] * eb[None]
        worst = worst.astype(np.float32) + np.float32(1e-5)
        scale = sa[part].astype(np.float32)[:, None] * sb.astype(np.float32)[None]
        may = rough >= (threshold - worst) / scale
        sure = rough >= (threshold + worst) / scale
        if same:
            later = np.arange(part.start, part.stop)[:, None] < np.arange(len(qb))[None]
            may, sure = may & later, sure & later
        yield at, sure, may & ~sure


_FLOATS = {"array<float>": "<f4"}


def _units(cells: list[bytes], floats: str) -> np.ndarray:
    m = np.frombuffer(b"".join(cells), floats).reshape(len(cells), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _coded(floats: str):
    """Adds each vector's code, its scale and what the code misses, for vectors of one block and length; vectors become bytes of their source's precision."""

    def code(rows: pa.Table) -> pa.Table:
        m = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(floats).reshape(rows.num_rows, -1)
        cells = [x.tobytes() for x in m]
        codes, scale, miss = quantise(_units(cells, floats))
        out = rows.drop_columns(["v"]).append_column("code", pa.array([x.tobytes() for x in codes], pa.binary()))
        return out.append_column("scale", pa.array(scale)).append_column("miss", pa.array(miss)).append_column("v", pa.array(cells, pa.binary()))

    return code


def _codes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.int8).reshape(rows.num_rows, -1)
    return codes, rows["scale"].to_numpy(), rows["miss"].to_numpy()


def _packed(rows: pa.Table) -> pa.Table:
    """One row per block and length of vectors: class numbers, copies, scales, misses and codes as bytes."""
    rows = rows.sort_by("c")
    codes, scale, miss = _codes(rows)
    cells = [rows["c"].to_numpy().astype("<i8"), rows["copies"].to_numpy().astype("<i8"), scale.astype("<f8"), miss.astype("<f8"), codes]
    return pa.table({"blk": rows["blk"][:1], "size": rows["size"][:1], "cells": pa.array([b"".join(x.tobytes() for x in cells)], pa.binary())})


def _unpacked(cells: bytes, size: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Class numbers, copies and quantised vectors."""
    n = len(cells) // (32 + size)
    codes = np.frombuffer(cells, np.int8, n * size, 32 * n).reshape(n, size)
    return np.frombuffer(cells, "<i8", n), np.frombuffer(cells, "<i8", n, 8 * n), (codes, np.frombuffer(cells, "<f8", n, 16 * n), np.frombuffer(cells, "<f8", n, 24 * n))


_FOUND = "c long, links long, root long, x int, y int, unsure boolean"


class _Links:
    """Link counts of a tile's vectors and the roots of their spanning forest, from slices of pairs."""

    def __init__(self, c: np.ndarray, copies: np.ndarray):
        self.c, self.copies, self.links = c, copies, np.zeros(len(c), np.int64)
        self.ones, self.twos = [], []
        self.unsure = np.zeros(len(c), bool)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            n = len(self.c)
            self.links += np.bincount(i, self.copies[j], n).astype(np.int64) + np.bincount(j, self.copies[i], n).astype(np.int64)
            label = spanning(i, j, n)
            hit = np.flatnonzero(label != np.arange(n))
            self.ones.append(hit)
            self.twos.append(label[hit])

    def table(self, x: int, y: int) -> pa.Table:
        label = spanning(np.concatenate(self.ones), np.concatenate(self.twos), len(self.c)) if self.ones else np.arange(len(self.c))
        hit = np.flatnonzero((self.links > 0) | self.unsure)
        tile = [pa.array(np.full(len(hit), k, np.int32)) for k in (x, y)]
        return pa.table({"c": pa.array(self.c[hit], pa.int64()), "links": pa.array(self.links[hit], pa.int64()), "root": pa.array(self.c[label[hit]], pa.int64()), "x": tile[0], "y": tile[1], "unsure": pa.array(self.unsure[hit])})


def _tile(threshold: float):
    """What the codes of a tile decide (two blocks, or one with itself), and the vectors with pairs that they don't."""

    def tile(rows: pa.Table) -> pa.Table:
        size, x, y = (rows[k][0].as_py() for k in ("size", "x", "y"))
        parts = [_unpacked(cell.as_buffer(), size) for cell in rows["cells"]]
        two = len(parts) > 1
        shift = len(parts[0][0]) if two else 0
        out = _Links(*(np.concatenate([p[k] for p in parts]) for k in (0, 1)))
        for at, sure, unsure in tile_bounds(parts[0][2], parts[-1][2], threshold, x == y):
            if x == y or two:
                i, j = np.nonzero(sure)
                out.add(i + at, j + shift)
                out.unsure[at : at + len(unsure)] |= unsure.any(1)
                out.unsure[shift : shift + unsure.shape[1]] |= unsure.any(0)
        return out.table(x, y)

    return tile


def _again(threshold: float, floats: str):
    """The links among a tile's unsure pairs, in double precision."""

    def tile(rows: pa.Table) -> pa.Table:
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        first = pc.equal(rows["blk"], x)
        one = rows.filter(first)
        two = one if x == y else rows.filter(pc.invert(first))
        shift = 0 if x == y else one.num_rows
        both = [one] if x == y else [one, two]
        out = _Links(*(np.concatenate([t[k].to_numpy() for t in both]) for k in ("c", "copies")))
        a, b = (_units(t["v"].to_pylist(), floats) for t in (one, two))
        for at, _, unsure in tile_bounds(_codes(one), _codes(two), threshold, x == y):
            i, j = np.nonzero(unsure)
            for lo in range(0, len(i), 200_000):
                p, q = i[lo : lo + 200_000] + at, j[lo : lo + 200_000]
                keep = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
                out.add(p[keep], q[keep] + shift)
        return out.table(x, y)

    return tile


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """Columns (key, n_links, component_id, kept), one row per vector.

    n_links counts the other vectors whose cosine in double precision is at least the threshold. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of different length don't link. Equal vectors are
    compared once and each counts for all of them. An empty table gives no rows. Every row is a vector of its own, also where a key repeats with
    the same or another vector; component_id is the smallest key of the component. Rows with a null key link with nothing and have a null
    component. Keys are whole numbers (another type raises an error); other columns are ignored.
    """
    kinds = dict(vectors.dtypes)
    if kinds[key] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{key} must be a whole number, not {kinds[key]}")
    floats = _FLOATS.get(kinds[vector], "<f8")
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = v.isNotNull() & finite & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good & F.col("id").isNotNull())
    # equal vectors are one class; adding 0.0 turns -0.0 into 0.0
    rows = rows.withColumn("sig", F.when(F.col("good"), F.sha2(F.concat_ws(",", F.transform(v, lambda x: (x + 0.0).cast("string"))), 256)))
    classes = rows.where("good").groupBy("sig").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    # numbered and written, so that the numbers stay: keys may repeat, these don't
    classes, seen = stored(classes.withColumn("c", F.monotonically_increasing_id()), n=F.count(F.lit(1)))
    blocks = max(1, -(-seen["n"] // block))
    dealt = classes.select("c", "copies", F.size("v").alias("size"), "v", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("blk"))
    cells = "blk int, size int, c long, copies long, code binary, scale double, miss double"
    coded, _ = stored(dealt.select("blk", "size", "c", "copies", "v").groupBy("blk", "size").applyInArrow(_coded(floats), cells + ", v binary"))
    packed, _ = stored(coded.drop("v").groupBy("blk", "size").applyInArrow(_packed, "blk int, size int, cells binary"))
    # every pair of blocks is a tile: a block goes to as many tiles as there are blocks, as one value of bytes
    mates = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("blk", o).alias("x"), F.greatest("blk", o).alias("y")))
    tiles = packed.withColumn("t", F.explode(mates)).select("t.x", "t.y", "size", "blk", "cells")
    decided, _ = stored(tiles.groupBy("x", "y", "size").applyInArrow(_tile(threshold), _FOUND))
    asked = decided.where("unsure").select("c", "x", "y").join(coded, "c")
    found, _ = stored(decided.where("links > 0").unionAll(asked.groupBy("x", "y", "size").applyInArrow(_again(threshold, floats), _FOUND)))
    counts = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "c")
    known = classes.drop("v").join(counts, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    known, _ = stored(known)
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("sig", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "sig").join(known, "sig", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", key)


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
