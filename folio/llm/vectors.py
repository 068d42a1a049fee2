"""Embedding near-dedup (operator 5): spherical k-means cells, blocked cosine products, cells left out only where a bound allows it.

Equal vectors are one point, which counts for its copies. Centres are fitted on a
bounded sample (MAX_FIT points, by hash of the id); every point belongs to its
nearest cell and visits the others that may hold a partner. Two bounds rule cells
out, and no pair with them: the angle to the cell's centre is more than the cell's
radius and the pair's widest angle; or the point lies farther behind the plane
between its own centre and the cell's than the sine of that angle. Of two cells
one visits the other, so each pair is compared once. Members and visitors of a
cell are cut into blocks of BLOCK points and compared block by block, STRIP rows
at a time, so that a cell with a third of all points is many tasks; a block pair
gives counts of links and a spanning forest, never its pairs. Where the bounds
rule out little (vectors without clusters), all pairs are compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, written

MAX_FIT = 20_000
MAX_CELLS = 8_192
CELL, BLOCK, STRIP = 1_500, 4_096, 256
#: What the bounds allow for rounding.
SLACK = 1e-6


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres. Starts from rows spread over the sample; a centre without rows stays."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centres[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centres


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Enter links a-b into the labels: each row's label is the first row of its group."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while ((jump := label[label]) != label).any():
            label[:] = jump


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links are pairs of cosine >= least in double precision. Vectors that are null, empty, zero or hold null or non-finite components have no links. Vectors of another length than the most frequent one are compared among their own length, without cells. Rows without an id are left out. Each row that repeats an id is a vector, and equal rows link with each other; what any vector of an id links to counts for the id. Empty input: no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("v")).where("vec_id is not null")
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    v = F.when(F.coalesce(good, F.lit(False)), F.col("v"))
    rows = written(rows.select("vec_id", v.alias("v")).withColumn("h1", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).withColumn("h2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))))
    classes = written(rows.where("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    valid = written(rows.select("vec_id", "h1", "h2", "v").join(classes, ["vec_id", "h1", "h2"]).dropDuplicates(["vec_id", "h1", "h2"]).select("vec_id", "v", "copies"))
    by_length = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if by_length is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dim, count = by_length
    sample = valid.where(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_FIT).toPandas()
    x = np.stack(sample["v"].to_numpy()).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = spherical_kmeans(x, min(len(x), MAX_CELLS, max(1, -(-count // CELL))))

    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
    widest = np.arccos(np.clip(least, -1.0, 1.0)) + SLACK

    def unit(vs: pd.Series) -> np.ndarray:
        x = np.stack(vs.to_numpy())
        x = x / np.abs(x).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    @F.pandas_udf("cell int, angle double")
    def nearest(vs: pd.Series) -> pd.DataFrame:
        size = vs.map(len).to_numpy(dtype=int)
        cell, angle = -size, np.zeros(len(vs))
        own = np.flatnonzero(size == dim)
        for at in range(0, len(own), STRIP):
            some = own[at : at + STRIP]
            c = unit(vs.iloc[some]) @ centres.T
            cell[some] = c.argmax(1)
            angle[some] = np.arccos(np.clip(c.max(1), -1, 1))
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle})

    placed = written(valid.select("vec_id", "v", "copies", nearest("v").alias("at")).select("vec_id", "v", "copies", F.col("at.cell").alias("home"), F.col("at.angle").alias("angle")))
    radius = np.full(len(centres), -np.inf)  # of cells without points, which nothing visits
    for cell, most in placed.where("home >= 0").groupBy("home").agg(F.max("angle")).collect():  # at most MAX_CELLS rows
        radius[cell] = most

    @F.pandas_udf("array<int>")
    def visits(vs: pd.Series, home: pd.Series) -> pd.Series:
        out: list[list[int]] = [[] for _ in range(len(vs))]
        own = np.flatnonzero(home.to_numpy() >= 0)
        other = np.arange(len(centres))
        for at in range(0, len(own), STRIP):
            some = own[at : at + STRIP]
            cell = home.iloc[some].to_numpy()
            c = unit(vs.iloc[some]) @ centres.T
            may = np.arccos(np.clip(c, -1, 1)) <= radius + widest
            if widest < np.pi / 2:
                may &= c[np.arange(len(some)), cell][:, None] - c <= (np.sin(widest) + SLACK) * apart[cell] + SLACK
            # of two cells the lower visits the higher where their sum is odd, else the higher the lower
            may &= (other != cell[:, None]) & ((cell[:, None] < other) == ((cell[:, None] + other) % 2 == 1))
            for r, m in zip(some, may, strict=True):
                out[r] = np.flatnonzero(m).tolist()
        return pd.Series(out)

    stays = F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("member")))
    placed = written(placed.select("vec_id", "v", "copies", "home", visits("v", "home").alias("visits")))
    goes = F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("member")))
    spread = placed.select("vec_id", "v", "copies", F.explode(F.concat(stays, goes)).alias("in")).select("vec_id", "v", "copies", "in.cell", "in.member")
    count = lambda which: F.ceil(F.count(F.when(which, 1)) / BLOCK).cast("int")
    blocks = spread.groupBy("cell").agg(count(F.col("member")).alias("_n"), count(~F.col("member")).alias("_m"))  # a row for each cell: at most MAX_CELLS and the lengths
    # a cell's members are blocks from 0 and meet all blocks; its visitors are the blocks after them and meet members only
    block = F.pmod(F.xxhash64("vec_id"), F.when(F.col("member"), F.col("_n")).otherwise(F.col("_m"))) + F.when(F.col("member"), 0).otherwise(F.col("_n"))
    spread = spread.join(blocks, "cell").withColumn("_i", block.cast("int"))
    last = F.col("_n") - 1 + F.when(F.col("member"), F.col("_m")).otherwise(0)
    spread = spread.withColumn("_j", F.explode(F.sequence(F.lit(0), last))).select("vec_id", "v", "copies", "cell", F.col("_i").alias("own"), F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        ids, own, copies = (table[c].to_numpy() for c in ("vec_id", "own", "copies"))
        i, j = (table[c][0].as_py() for c in ("i", "j"))
        v = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        v = v / np.abs(v).max(1, keepdims=True)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), int)
        rank[order] = np.arange(len(ids))
        label, links = np.arange(len(ids)), np.zeros(len(ids))
        for at in range(0, len(left), STRIP):
            a, b = np.nonzero(v[left[at : at + STRIP]] @ v[right].T >= least)
            a, b = left[at + a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            links += np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            merge(label, rank[a], rank[b])
        keep = links > 0
        return pa.table({"vec_id": pa.array(ids[keep]), "n": pa.array(links[keep].astype(np.int64)), "root": pa.array(ids[order[label[rank[keep]]]])})

    found = written(spread.groupBy("cell", "i", "j").applyInArrow(compare, "vec_id long, n long, root long"))
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    told = classes.join(links, "vec_id", "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left").where("copies > 1 or n is not null")
    # written, so that the join has an exchange on either side and can split a frequent vector
    told = written(told.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "vec_id").alias("component_id")))
    out = rows.select("vec_id", "h1", "h2").join(told, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
