"""Vote clustering of an endless arrival order, where each post sees only the posts shortly before it.

Arrivals are cut into blocks of ``memory`` rows. A post's whole memory lies in its own block and the one
before, so both density and neighbour tests work on groups of at most two blocks, which Spark spreads
over all tasks. Labels can travel through any number of blocks. Each block becomes a transfer (which
posts of the block before reach which posts of this one, and the largest label opened inside), and
transfers of 1, 2, 4, .. blocks are joined in a number of rounds that is the logarithm of the block count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.rank import numbered
from tidegrid.session import cut

_CHUNK = 250  # posts compared with their block at a time


def _two_blocks(rows: DataFrame) -> DataFrame:
    """Copy each row to its own block (as post) and to the next (as memory)."""
    return rows.withColumn("grp", F.explode(F.array("block", F.col("block") + 1)))


def _close(z: np.ndarray, sd: np.ndarray, at: np.ndarray, sigma: float, close: float) -> np.ndarray:
    """Close test of the rows ``at`` against all rows, in units of each row's own deviations."""
    unit = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)
    d = (z[at][:, None, :] - z[None, :, :]) * unit[:, None, :]
    k = np.exp(-sigma * (d[..., :-1] ** 2).sum(axis=2)) + np.exp(-sigma * d[..., -1] ** 2)
    return k / 2 > close


def online_density(
    rows: DataFrame, dims: list[str], memory: int, sigma: float, close: float, seen: int = 0
) -> DataFrame:
    """Add ``n_close`` and the trailing deviations to numbered rows (``seq`` from 1); the first ``memory`` rows are history.

    Rows up to ``seen`` only serve as memory of the later ones.
    """
    names = [f"sd{i}" for i in range(len(dims))]

    def per_group(key, g):
        g = g.sort_values("seq", ignore_index=True)
        seq, z = g["seq"].to_numpy(), g[dims].to_numpy()
        own = np.flatnonzero((g["block"].to_numpy() == key[0]) & (seq > seen))
        sd = np.zeros((len(g), len(dims)))
        n_close = np.zeros(len(g), dtype=np.int64)
        full = own[seq[own] > memory]
        for start in range(0, len(full), _CHUNK):
            at = full[start : start + _CHUNK]
            trail = np.stack([z[i - memory : i + 1] for i in at])
            sd[at] = trail.std(axis=1, ddof=1)
            near = _close(z, sd[at], at, sigma, close)
            gap = seq[at][:, None] - seq[None, :]
            n_close[at] = (near & (gap >= 1) & (gap <= memory)).sum(axis=1)
        out = g.loc[own, ["id", "seq", "block", *dims]].copy()
        for i, n in enumerate(names):
            out[n] = sd[own, i]
        out["n_close"] = n_close[own]
        return out

    schema = "id string, seq bigint, block bigint, " + ", ".join(f"{c} double" for c in [*dims, *names]) + ", n_close bigint"
    base = rows.select("id", "seq", F.floor((F.col("seq") - 1) / F.lit(memory)).cast("bigint").alias("block"), *dims)
    return _two_blocks(base).groupBy("grp").applyInPandas(per_group, schema)


def online_votes(
    posts: DataFrame, order: list[str], dims: list[str], memory: int, sigma: float, close: float, dense: int
) -> DataFrame:
    """Cluster posts in arrival order: (id, seq, n_close, cl).

    A post with more than ``dense`` close posts among the last ``memory`` takes the largest label, compared
    as text, of the clustered ones among them, or opens the next cluster. ``dims`` end with the time; they
    are measured in sample deviations over the post and its memory.
    """
    rows = numbered(posts.select(*dict.fromkeys(["id", *order, *dims])), order, name="seq")
    return online_step(rows, None, 0, 0, dims, memory, sigma, close, dense).drop(*dims)


def online_step(
    rows: DataFrame, prior: DataFrame | None, seen: int, opened: int, dims: list[str], memory: int, sigma: float, close: float, dense: int
) -> DataFrame:
    """:func:`online_votes` of the rows numbered after ``seen``, given the last rows before them: (id, seq, dims, n_close, cl).

    ``prior`` has id, seq, dims and cl of the last ``memory`` rows (all, if fewer); ``opened`` clusters were opened so far.
    """
    names = [f"sd{i}" for i in range(len(dims))]
    base = rows.select("id", "seq", *dims)
    if prior is not None:
        base = base.unionByName(prior.select("id", "seq", *dims))
    scored = cut(online_density(base, dims, memory, sigma, close, seen))
    crowd = scored.where(F.col("n_close") > dense).withColumn("cl", F.lit(0).cast("bigint"))
    if prior is not None:  # labelled posts of the memory can be followed, and follow nobody themselves
        known = prior.where("cl <> 0").select(
            "id", "seq", F.floor((F.col("seq") - 1) / F.lit(memory)).cast("bigint").alias("block"), *dims,
            *[F.lit(0.0).alias(n) for n in names], F.lit(0).cast("bigint").alias("n_close"), "cl")
        crowd = crowd.unionByName(known)

    def links(g: pd.DataFrame, block: int):
        """Sorted group, and which earlier dense posts each dense post of the block follows."""
        g = g.sort_values("seq", ignore_index=True)
        seq = g["seq"].to_numpy()
        own = np.flatnonzero(g["block"].to_numpy() == block)
        follows = np.zeros((len(own), len(g)), dtype=bool)
        z, sd = g[dims].to_numpy(), g[names].to_numpy()
        for start in range(0, len(own), _CHUNK):
            at = own[start : start + _CHUNK]
            gap = seq[at][:, None] - seq[None, :]
            follows[start : start + _CHUNK] = _close(z, sd[at], at, sigma, close) & (gap >= 1) & (gap <= memory)
        follows[seq[own] <= seen] = False
        return g, own, follows

    def find_openers(key, g):
        g, own, follows = links(g, key[0])
        return g.loc[own[~follows.any(axis=1) & (g["seq"].to_numpy()[own] > seen)], ["seq"]]

    def transfer(key, g):
        g, own, follows = links(g, key[0])
        if not len(own):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("block", "seqs", "wide", "reach", "top")})
        before = int(own[0])
        reach = follows[:, :before].copy()
        top = g["label"].to_numpy()[own].copy()
        inner = follows[:, before:]
        for i in range(len(own)):
            j = np.flatnonzero(inner[i])
            if j.size:
                reach[i] |= reach[j].any(axis=0)
                top[i] = max(top[i], top[j].max())
        return pd.DataFrame(
            {"block": [key[0]], "seqs": [g["seq"].to_numpy()[own]], "wide": [before],
             "reach": [np.packbits(reach, axis=1).tobytes()], "top": [top]}
        )

    def join_transfers(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                top, wide, reach = np.asarray(r.top), 0, b""
                n = len(top)
                if r.p_top is not None and r.wide:
                    here = np.unpackbits(np.frombuffer(r.reach, np.uint8).reshape(n, -1), axis=1)[:, : int(r.wide)].astype(bool)
                    prev_top = np.asarray(r.p_top)
                    top = np.maximum(top, np.where(here, prev_top[None, :], 0).max(axis=1))
                    if r.p_wide:
                        past = np.unpackbits(np.frombuffer(r.p_reach, np.uint8).reshape(len(prev_top), -1), axis=1)[:, : int(r.p_wide)]
                        both = (here.astype(np.float32) @ past.astype(np.float32)) > 0
                        wide, reach = int(r.p_wide), np.packbits(both, axis=1).tobytes()
                out.append((r.block, r.seqs, wide, reach, top))
            yield pd.DataFrame(out, columns=["block", "seqs", "wide", "reach", "top"])

    grouped = _two_blocks(crowd)
    openers = numbered(cut(grouped.groupBy("grp").applyInPandas(find_openers, "seq bigint")), ["seq"], name="_no")
    openers = cut(openers.select("seq", (F.col("_no") + F.lit(opened)).cast("bigint").alias("cl")))
    named = crowd.join(openers.withColumnRenamed("cl", "_own"), "seq", "left").withColumn("cl", F.coalesce("_own", "cl")).drop("_own")
    texts = named.where("cl <> 0").select("cl", F.col("cl").cast("string").alias("_text")).distinct()
    texts = cut(numbered(texts, ["_text"], name="label").select("cl", "label"))
    labelled = named.join(texts, "cl", "left").withColumn("label", F.coalesce("label", F.lit(0).cast("bigint")))
    schema = "block bigint, seqs array<bigint>, wide bigint, reach binary, top array<bigint>"
    moves = cut(_two_blocks(labelled).groupBy("grp").applyInPandas(transfer, schema))
    ends = moves.agg(F.min("block"), F.max("block")).first()
    step = 1
    while ends[0] is not None and step <= ends[1] - ends[0]:
        past = moves.select((F.col("block") + step).alias("block"), F.col("wide").alias("p_wide"), F.col("reach").alias("p_reach"), F.col("top").alias("p_top"))
        moves = cut(moves.join(past, "block", "left").mapInPandas(join_transfers, schema))
        if moves.where("wide > 0").isEmpty():
            break
        step *= 2
    labels = moves.select(F.explode(F.arrays_zip("seqs", "top")).alias("p")).select(F.col("p.seqs").alias("seq"), F.col("p.top").alias("label"))
    named = labels.join(texts, "label").select("seq", "cl")
    return scored.join(named, "seq", "left").select("id", "seq", *dims, "n_close", F.coalesce("cl", F.lit(0).cast("bigint")).alias("cl"))
