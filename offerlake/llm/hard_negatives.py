"""Hard-negative mining by a vector-approximation file: cells bound scores by table lookup, few vectors are scored exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stash

SCALE = 256
CLAMP = 1 << 23  # so that 90 times a score of 1,024 components is a long
CELLS = 64
PILOT = 16  # one of so many blocks is searched first
QUERIES_AT_ONCE = 32
BOUNDS = 1 << 22  # bounds kept at a time
CHUNK = 4096
_STORED = "row bigint, vec_id bigint, label bigint, cells binary"
_FOUND = "anchor bigint, score bigint, vec_id bigint, row bigint"


def pack(values: np.ndarray) -> bytes:
    """Integers of 32 bits by their bytes, small ones of either sign with zero high bytes."""
    folded = ((values << 1) ^ (values >> 31)).astype("<u4")
    return folded.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(bodies: list[bytes], dims: int) -> np.ndarray:
    """Rows of ``dims`` components; missing ones are 0, which adds nothing to a score."""
    out = np.zeros((len(bodies), dims), dtype=np.int64)
    lengths = np.array([len(b) // 4 for b in bodies])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        raw = np.frombuffer(b"".join(bodies[i] for i in at.tolist()), dtype=np.uint8).reshape(len(at), 4, n)
        folded = np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<u4").reshape(len(at), n).astype(np.int64)
        out[at, : min(n, dims)] = ((folded >> 1) ^ -(folded & 1))[:, :dims]
    return out


def _store_task(batches):
    first, n = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        column = batch.column(2)
        values = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE), -CLAMP, CLAMP).astype(np.int32)
        at = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))
        cells = pa.array([pack(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
        rows = pa.array(np.arange(n, n + batch.num_rows) + first)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), cells], names=["row", "vec_id", "label", "cells"])


class ApproximationFile:
    """The vectors of a block, and of each component the cell that it lies in.

    A dimension's cells hold about equally many of the block's values; their least and largest values are the marks.
    """

    def __init__(self, vectors: np.ndarray, cells: int = CELLS):
        n, self.dims = vectors.shape
        self.vectors = vectors.astype(np.int32)
        self.code = np.zeros((self.dims, n), dtype=np.uint8)
        self.low = np.zeros((self.dims, cells), dtype=np.int64)
        self.high = np.zeros((self.dims, cells), dtype=np.int64)
        self.largest = np.abs(vectors).max(axis=0, initial=0)
        for d in range(self.dims):
            values = np.sort(vectors[:, d])
            edge = np.unique(values[np.arange(cells) * n // cells])
            self.code[d] = np.searchsorted(edge, vectors[:, d], side="right") - 1
            self.low[d, : len(edge)] = edge
            self.high[d, : len(edge)] = values[np.append(np.searchsorted(values, edge[1:]), n) - 1]

    def bounds(self, queries: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products, queries x rows, by one table lookup a component."""
        n = len(queries)
        kind = np.int32 if (np.abs(queries).max(axis=0, initial=0) * self.largest).sum() < 1 << 31 else np.int64
        a, b = self.low[:, :, None] * queries.T[:, None, :], self.high[:, :, None] * queries.T[:, None, :]
        table = np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2).astype(kind)
        out = np.zeros((2 * n, rows.stop - rows.start), dtype=kind)
        for at in range(rows.start, rows.stop, CHUNK):
            to = min(at + CHUNK, rows.stop)
            sums = np.zeros((to - at, 2 * n), dtype=kind)
            for d in range(self.dims):
                sums += table[d].take(self.code[d, at:to], axis=0)
            out[:, at - rows.start : to - rows.start] = sums.T
        return out[:n], out[n:]

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ query


def candidates(low: np.ndarray, high: np.ndarray, least: int, most: int, k: int) -> np.ndarray:
    """The rows that can be among the ``k`` best of those with a score of ``least`` to ``most``, given bounds of all scores."""
    found = np.flatnonzero((high >= least) & (low <= most))
    if len(found) > k:
        sure = low[found][(low[found] >= least) & (high[found] <= most)]
        if len(sure) > k:
            found = found[high[found] >= np.partition(sure, len(sure) - k)[len(sure) - k]]
    return found


def _search_task(k: int, same: bool, cells: int):
    """Each block brings its rows first, then the anchors with their windows."""

    def answer(file: ApproximationFile, held: dict, request: dict) -> list[np.ndarray]:
        queries = unpack(request["cells"], file.dims)
        out = []
        for label in np.unique(request["label"]).tolist():
            a, b = np.searchsorted(held["label"], [label, label + 1])
            rows = slice(int(a), int(b)) if same else slice(0, len(held["label"]))
            mine = np.flatnonzero(request["label"] == label)
            step = max(1, min(QUERIES_AT_ONCE, BOUNDS // max(1, rows.stop - rows.start)))
            for at in range(0, len(mine) if rows.stop > rows.start else 0, step):
                part = mine[at : at + step]
                low, high = file.bounds(queries[part], rows)
                for j, i in enumerate(part.tolist()):
                    fits = np.ones(rows.stop - rows.start, dtype=bool)
                    if same:
                        fits &= held["row"][rows] != request["row"][i]
                    else:
                        fits[a:b] = False
                    fits = np.flatnonzero(fits)
                    picked: list = [np.zeros(0, np.int64)]
                    for window in request["windows"][i]:
                        near = fits[candidates(low[j][fits], high[j][fits], window["low"], window["high"], k)] + rows.start
                        score = file.scores(near, queries[i])
                        good = np.flatnonzero((score >= window["low"]) & (score <= window["high"]))
                        best = np.lexsort((held["row"][near[good]], held["vec_id"][near[good]], held["no_id"][near[good]], -score[good]))[:k]
                        picked.append(near[good[best]])
                    near = np.unique(np.concatenate(picked))
                    out.append(np.stack([np.full(len(near), request["row"][i]), file.scores(near, queries[i]), near]))
        return out

    def run(batches):
        block, parts, file, held = None, [], None, {}
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.unique(np.concatenate(([0], np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1, [len(blocks)])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = {c: batch.column(c).slice(a, b - a) for c in ("row", "vec_id", "label", "cells", "windows")}
                if blocks[a] != block:
                    block, parts, file = blocks[a], [], None
                if kinds[a] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if file is None:
                    bodies = [x for p in parts for x in p["cells"].to_pylist()]
                    held = {c: np.concatenate([p[c].fill_null(0).to_numpy(zero_copy_only=False) for p in parts]) for c in ("row", "vec_id", "label")}
                    held["no_id"] = np.concatenate([p["vec_id"].is_null().to_numpy(zero_copy_only=False) for p in parts])
                    file = ApproximationFile(unpack(bodies, max(map(len, bodies)) // 4), cells)
                    parts = [{}]
                request = {"row": part["row"].to_numpy(), "label": part["label"].to_numpy(), "cells": part["cells"].to_pylist(), "windows": part["windows"].to_pylist()}
                found = answer(file, held, request)
                if found:
                    anchor, score, near = np.concatenate(found, axis=1)
                    ids = pa.array(held["vec_id"][near], mask=held["no_id"][near])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(score), ids, pa.array(held["row"][near])], names=["anchor", "score", "vec_id", "row"])

    return run


_WINDOWS = "array<struct<low:bigint,high:bigint>>"


def _search(rows: DataFrame, requests: DataFrame, blocks: int, pilot: bool, k: int, same: bool, cells: int) -> DataFrame:
    """(anchor, score, vec_id, row): of the pilot blocks or of the others, the ``k`` best rows of each for every window of
    ``requests`` (row, label, cells, windows), among rows of the same label or of all others."""
    chosen = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (b % PILOT == 0) == F.lit(pilot))
    stored = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).filter((F.col("block") % PILOT == 0) == F.lit(pilot))
    stored = stored.select("block", F.lit(0).alias("kind"), "row", "vec_id", "label", "cells", F.lit(None).cast(_WINDOWS).alias("windows"))
    wanted = requests.select(F.explode(chosen).alias("block"), F.lit(1).alias("kind"), "row", F.lit(None).cast("bigint").alias("vec_id"), "label", "cells", "windows")
    dealt = stored.unionByName(wanted).repartition(max(1, blocks // PILOT if pilot else blocks), "block")
    return dealt.sortWithinPartitions("block", "kind", "label").mapInArrow(_search_task(k, same, cells), _FOUND)


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, least_rows: int = 8192, most_rows: int = 1 << 19, most_blocks: int = 128, cells: int = CELLS) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, label, embedding) for each anchor and its positives.

    Components become floor(256 x) and scores are integer inner products; higher scores come first, ties by smaller vec_id, null
    ones last. An anchor's positives are its first ``positives`` other rows of the same label. For each, the first ``negatives``
    rows of other labels with 0.3 to 0.9 of the positive's score are returned.

    Rows are dealt at random over blocks of ``least_rows`` rows, at most ``most_blocks`` of up to ``most_rows``. A block is a vector-approximation file:
    each dimension has up to ``cells`` cells, and for an anchor a table gives every cell's least and largest
    product, so that lookups bound all scores. Exact scores are computed only where a row may be in a window and
    among its best. One of 16 blocks is searched first; its last kept score bounds the windows in the others, so that what
    they return does not grow with their number. All anchors meet all blocks: the work is anchors times rows.

    Rows with a null label, a null vector or a null or non-finite component take no part. Where vec_id is
    divisible by 7, label becomes (label + 1) % 10 first. Components beyond +-32,768 count as these. Vectors of
    different lengths are compared as far as both go. Repeated rows are rows of their own, also as anchors and positives.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and positive_rank, which of the anchor's
    positives it is.
    """
    spark = vectors.sparkSession
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    whole = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = stash(clean.select(vec_id.alias("vec_id"), shifted.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_store_task, _STORED))
    n = rows.count()
    blocks = max(-(-n // most_rows), min(most_blocks, -(-n // least_rows)), 1)

    def inside(found: DataFrame, requests: DataFrame, k: int) -> DataFrame:
        slots = requests.select(F.col("row").alias("anchor"), "slot", "low", "high")
        return _best(found.join(slots, "anchor").filter(F.col("score").between(F.col("low"), F.col("high"))), k, "anchor", "slot")

    def search(requests: DataFrame, k: int, same: bool) -> DataFrame:
        """The best rows for each slot of ``requests`` (row, label, cells, slot, low, high), a window of an anchor each."""
        window = lambda df: df.groupBy("row").agg(F.first("label").alias("label"), F.first("cells").alias("cells"), F.collect_list(F.struct("low", "high")).alias("windows"))
        first = cut(_search(rows, window(requests), blocks, True, k, same, cells))
        bound = inside(first, requests, k).filter(F.col("rank") == k).select(F.col("anchor").alias("row"), "slot", F.col("score").alias("least"))
        narrow = requests.join(bound, ["row", "slot"], "left").withColumn("low", F.greatest("low", F.coalesce("least", "low")))
        return inside(first.unionByName(_search(rows, window(narrow), blocks, False, k, same, cells)), requests, k)

    asked = rows.filter(anchors)
    all_ = asked.select("row", "label", "cells", F.lit(0).alias("slot"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    best = cut(search(all_, positives, True).select("anchor", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    wanted = best.filter(p >= 0).select(F.col("anchor").alias("row"), "slot", F.expr("(positive_score * 30 + 99) div 100").alias("low"), F.expr("positive_score * 90 div 100").alias("high"))
    wanted = cut(wanted.join(asked.select("row", "label", "cells"), "row"))
    found = search(wanted, negatives, False)
    ids = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(best, ["anchor", "slot"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("slot").cast("int").alias("positive_rank"))
