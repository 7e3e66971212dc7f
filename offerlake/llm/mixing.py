"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096
_STATE = "doc_id bigint, source string, size bigint, source_size bigint, target double, base int, p double, home bigint, block bigint"


def source_targets(sized: DataFrame, cap: int = 3) -> DataFrame:
    """One row a source: n, source_size, target.

    Sources in code point order, null last, weigh 1, 2, 3 and again. A target is ``level * weight``, at most
    ``cap`` times the source's size. With sources in order of cap for each weight, the level after the first i
    are capped is what they leave over the weight of the rest; it rises while caps bind and falls after,
    so that the largest is the one that resharing ends at. Windows run over one row a source.
    """
    sources = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("weight", (rank - 1) % 3 + 1).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(on)
    sources = sources.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.col("most").cast("double"))
    return sources.select("source", "n", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Move ``p`` along directions that keep ``sum(p)`` and ``sum(p * size)`` until two of them at most are fractional."""
    p = p.copy()
    eps = 1e-9
    p[p < eps], p[p > 1 - eps] = 0.0, 1.0
    chance = draw.random(len(p))
    live: list[int] = []
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        live.append(k)
        if len(live) < 3:
            continue
        a, b, c = live
        u = [float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a])]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(live, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(live, u, strict=True) if x)
        step = up if chance[k] * (up + down) < down else -down
        for i, x in zip(live, u, strict=True):
            q = p[i] + step * x
            p[i] = 0.0 if q < eps else 1.0 if q > 1 - eps else q
        live = [i for i in live if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last fractional ones so that the sizes come nearest to what they promise."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off = np.abs(picks @ size[left] - p[left] @ size[left]) + 1e-6 * np.abs(picks.sum(1) - p[left].sum())
        p[left] = picks[int(np.argmin(off))]
    return p


def settle(taken: np.ndarray, size: np.ndarray, base: np.ndarray, over: float) -> np.ndarray:
    """Take or leave one copy of documents of falling size, as long as this brings the total nearer to its target."""
    taken = taken.copy()
    for k in np.argsort(-size, kind="stable").tolist():
        if over > 0 and taken[k] > base[k] and abs(over - size[k]) < abs(over):
            taken[k], over = taken[k] - 1, over - size[k]
        elif over < 0 and taken[k] == base[k] and abs(over + size[k]) < abs(over):
            taken[k], over = taken[k] + 1, over + size[k]
    return taken


def _settle(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["doc_id", "size"], kind="stable")
    base = part["base"].to_numpy(dtype=np.int64)
    taken = settle(base + part["p"].to_numpy(dtype=np.int64), part["size"].to_numpy(dtype=np.int64), base, float(part["over"].iloc[0]))
    return part.assign(p=(taken - base).astype(float)).drop(columns="over")


def _fly(seed: int, last: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "doc_id", "size"], kind="stable")
        size = part["size"].to_numpy(dtype=np.int64)
        draw = np.random.default_rng([seed, len(part), int(part["turn"].iloc[0]) & 0x7FFFFFFF])
        p = flight(part["p"].to_numpy(dtype=np.float64), size, draw)
        return part.assign(p=land(p, size) if last else p).drop(columns="turn")

    return run


def mix_sources(docs: DataFrame, cap: int = 3, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """How many words the mix takes of each document of ``docs`` (doc_id, text, source).

    A source's documents are all wanted ``target / source_size`` times: the whole part is taken for sure, the
    fraction is an inclusion probability. Blocks of about ``block`` documents of one source each run the
    flight phase of the cube method, which keeps the number of documents and of words and leaves at most two
    undecided; those of all blocks of a source form the next, ``block / 2`` times smaller round, until one block
    is left, which lands. A very long document among the last would leave its source far from the target: so the
    source's first block, which is bounded too, then takes or leaves documents until the total is nearest.

    Returns doc_id, source, size, source_size, target, taken. Random draws follow from ``seed`` and the rows
    alone. Null text: size 0. A source without words has target 0. Repeated rows count as documents.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    targets = cut(source_targets(sized, cap))
    most = targets.agg(F.max("n")).first()[0] or 0
    turn = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    wanted = F.when(F.col("source_size") > 0, F.least(F.try_divide("target", "source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("n") / block)
    state = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.doc_id", "d.source", "d.size", "t.source_size", "t.target", F.floor(wanted).cast("int").alias("base"), (wanted - F.floor(wanted)).alias("p"), F.pmod(turn, blocks).alias("home"), F.pmod(turn, blocks).alias("block"))
    done = state.filter("p = 0")
    state = state.filter("p > 0")
    left = -(-most // block)
    while True:
        last = left <= 1
        flown = state.withColumn("turn", turn).groupBy("source", "block").applyInPandas(_fly(seed, last), _STATE)
        if last:
            done = done.unionByName(flown)
            break
        flown = cut(flown)
        done = done.unionByName(flown.filter("p in (0, 1)"))
        state = flown.filter("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") * 2 / block))
        left = -(-2 * left // block)
    done = cut(done)
    over = done.groupBy("source").agg((F.sum((F.col("base") + F.col("p")) * F.col("size")) - F.first("target")).alias("over"))
    open_ = done.filter("home = 0 and base < try_divide(target, source_size)")
    mended = open_.alias("d").join(over.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source"))).select("d.*", "over").groupBy("source").applyInPandas(_settle, _STATE)
    done = done.filter("not coalesce(home = 0 and base < try_divide(target, source_size), false)").unionByName(mended)
    return done.select("doc_id", "source", "size", "source_size", "target", ((F.col("base") + F.col("p").cast("int")) * F.col("size")).alias("taken"))
