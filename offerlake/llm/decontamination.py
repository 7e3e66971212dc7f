"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact weighted-shingle similarity."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vec import LOWER, NOT_LETTER, Words, groups, text_buffer, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 3
ITEMS, ITEM_BYTES = 4096, 8 << 20  # benchmark items of one search and their bytes: the bounds of what is broadcast
GROUP_BYTES = 1 << 20
SHORTEST = 5  # words of an item
#: Window sizes. An item has windows of the largest size that some stretch of it keeps whole in every text that
#: is similar enough.
SIZES = (1, 2, 3, 4, 5, 7, 10, 14, 20, 28)
NOT_ALNUM = NOT_LETTER.copy()
NOT_ALNUM[0x30:0x3A] = False
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
_HITS = "doc_id bigint, item_id bigint, similarity double, first bigint, last bigint"
_HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first", pa.int64()), ("last", pa.int64())])


def alnum_words(column: pa.Array) -> Words:
    raw, offsets = text_buffer(column)
    return Words(LOWER[raw], offsets, NOT_ALNUM)


def lane_sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums of the words' bits in 64 counters of 8 bits each, packed into 8 numbers.

    Carries from one counter into the next cancel in the difference of two sums as long as the words between
    them are at most 255.
    """
    out = np.zeros((len(words) + 1, 8), dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_SPREAD[words.astype("<u8").view(np.uint8).reshape(-1, 8)], axis=0, out=out[1:])
    return out


def simhashes(sums: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each window of ``size`` words: the majority of each bit of their hashes."""
    with np.errstate(over="ignore"):
        count = sums[size:] - sums[:-size]
    bits = np.packbits(count.view(np.uint8) > size // 2, bitorder="little")
    return bits.view("<u8")


def hamming_blocks(radius: int) -> list[tuple[int, int]]:
    """Shift and width of ``radius + 1`` blocks: of two hashes within the radius, one block at least is equal."""
    cuts = np.linspace(0, 64, radius + 2).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Probe:
    """Items of one window size: SimHashes, and for each Hamming block the entries by its value."""

    hashes: np.ndarray
    item: np.ndarray
    shift: np.ndarray  # where the window starts in its item
    tables: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, entries: list[tuple[int, int, int]], radius: int) -> Probe:
        hashes = np.array([e[0] for e in entries], dtype=np.uint64)
        tables = []
        for at, width in hamming_blocks(radius):
            key = ((hashes >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            tables.append((np.searchsorted(key[order], np.arange((1 << width) + 1)), order))
        return cls(hashes, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), tables)

    def search(self, windows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, entry) pairs within the radius."""
        found = []
        for (at, width), (starts, order) in zip(hamming_blocks(radius), self.tables, strict=True):
            key = ((windows >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
            n = starts[key + 1] - starts[key]
            w = np.flatnonzero(n)
            if not len(w):
                continue
            n = n[w]
            pair = np.repeat(w, n)
            entry = order[np.repeat(starts[key[w]] - (np.cumsum(n) - n), n) + np.arange(len(pair))]
            near = np.bitwise_count(windows[pair] ^ self.hashes[entry]) <= radius
            found.append(pair[near] * len(self.hashes) + entry[near])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // len(self.hashes), both % len(self.hashes)


def breaking_cost(weight: np.ndarray, run: int) -> float:
    """The least weight of shingles to lose so that no ``run`` of them in a row is left.

    A changed, added or dropped word takes ``SHINGLE - 1`` shingles in a row at least, fewer at an end.
    """
    n, hurt = len(weight), SHINGLE - 1
    if run > n:
        return 0.0
    sums = np.append(0.0, np.cumsum(weight)).tolist()
    # cost[i]: the last loss ends before shingle i, and no run before it is too long; cost[0]: nothing is lost yet
    cost = [0.0] * (n + 1)
    ends: deque[int] = deque()  # where the loss before may end, the cheapest first
    for i in range(1, n):
        cost[i] = sums[i] if i <= hurt else cost[i - 1] + sums[i] - sums[i - 1]
        start = i - hurt
        if start >= 0:
            while ends and cost[ends[-1]] >= cost[start]:
                ends.pop()
            ends.append(start)
            while ends[0] <= start - run:
                ends.popleft()
            cost[i] = min(cost[i], cost[ends[0]] + sums[i] - sums[start])
        if i > 1 and i <= hurt:
            cost[i] = min(cost[i], cost[i - 1] + sums[i] - sums[i - 1])
    best = sums[n]
    for i in range(n):
        for k in range(hurt + 1):  # shingles lost at the end
            if i <= n - k < i + run:
                best = min(best, cost[i] + sums[n] - sums[n - k])
    return best


@dataclass
class Benchmark:
    ids: np.ndarray
    words: list[np.ndarray]
    vocabulary: np.ndarray
    idf: np.ndarray
    top: float
    parts: list[tuple] = field(default_factory=list)  # of each item: its shingles, where each is first, how often, and their weight
    probes: dict[int, Probe] = field(default_factory=dict)

    @classmethod
    def build(cls, ids: list[int], texts: list[str], radius: int, frequency: dict[int, int] | None = None, threshold: float = SIMILARITY, shortest: int = SHORTEST) -> Benchmark:
        words = alnum_words(pa.array(texts, pa.string()))
        hashes = words.hashes()
        each = [hashes[a:b] for a, b in zip(words.first, words.first[1:], strict=False)]
        vocabulary = np.unique(hashes)
        frequency = frequency or {}
        docs = frequency.get(-1, 0)
        idf = np.array([np.log((1 + docs) / (1 + frequency.get(k, 0))) + 1 for k in range(len(vocabulary))])
        out = cls(np.array(ids, np.int64), each, vocabulary, idf, float(np.log(1 + docs) + 1))
        entries: dict[int, list] = {}
        for k, w in enumerate(each):
            out.parts.append((*np.unique(window_hashes(w, SHINGLE), return_index=True, return_counts=True), float(out.weights(w).sum()) if len(w) >= SHINGLE else 0.0))
            if len(w) < max(1, shortest):
                continue
            size, step = out.window(w, threshold)
            all_ = simhashes(lane_sums(w), size)
            for shift in sorted({*range(0, len(w) - size, step), len(w) - size}):
                entries.setdefault(size, []).append((int(all_[shift]), k, shift))
        out.probes = {s: Probe.of(e, radius) for s, e in entries.items()}
        return out

    def window(self, words: np.ndarray, threshold: float) -> tuple[int, int]:
        """The size of an item's windows and how far apart they start, so that every text that reaches the threshold has
        one of them whole. An item of fewer than five words is one window."""
        if len(words) < SHINGLE:
            return len(words), 1
        weight = self.weights(words)
        bound = (1 - threshold) * weight.sum() * (1 + 1e-9)
        # the longest run that cannot be broken everywhere: the longer it is, the less that costs
        low, high = 1, len(weight)
        while low < high:
            run = (low + high + 1) // 2
            low, high = (run, high) if breaking_cost(weight, run) > bound else (low, run - 1)
        whole = low + SHINGLE - 1
        size = max(s for s in SIZES if s <= whole)
        return size, whole - size + 1

    def weights(self, words: np.ndarray) -> np.ndarray:
        """The weight of each shingle: the mean inverse document frequency of its words."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        idf = np.where(self.vocabulary[at] == words, self.idf[at], self.top)
        total = np.append(0.0, np.cumsum(idf))
        return (total[SHINGLE:] - total[:-SHINGLE]) / SHINGLE

    def similarity(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted Jaccard similarity of two word lists' shingles, counted; of fewer than five words, whether they are equal."""
        if min(len(a), len(b)) < SHINGLE:
            return float(len(a) == len(b) and bool((a == b).all()))
        both = np.concatenate([window_hashes(a, SHINGLE), window_hashes(b, SHINGLE)])
        weight = np.concatenate([self.weights(a), self.weights(b)])
        side = np.repeat([0, 1], [max(0, len(a) - SHINGLE + 1), max(0, len(b) - SHINGLE + 1)])
        value, k = np.unique(both, return_inverse=True)
        n = np.zeros((len(value), 2))
        np.add.at(n, (k, side), 1)
        w = np.zeros(len(value))
        w[k] = weight
        return float((n.min(1) @ w) / (n.max(1) @ w)) if len(value) else 0.0

    def best_stretch(self, words: np.ndarray, item: int, at: int, threshold: float) -> tuple[float, int, int]:
        """The stretch of ``words`` about ``at``, where the item would start, that is most like the item.

        A stretch may be shorter or longer than the item, by no more than similar ones can be. The one with the best
        ratio of common to all weight is compared exactly.
        """
        own = self.words[item]
        if len(own) < SHINGLE:
            return self.similarity(words[at : at + len(own)], own), at, at + len(own)
        slack = int(len(own) * (1 / threshold - 1)) + SHINGLE
        low, high = max(0, at - slack), min(len(words), at + len(own) + slack)
        near = words[low:high]
        if len(near) < SHINGLE:
            return 0.0, low, high
        shingle, (held, first, often, total) = window_hashes(near, SHINGLE), self.parts[item]
        place = np.minimum(np.searchsorted(held, shingle), len(held) - 1)
        common = held[place] == shingle
        if not common.any():
            return 0.0, low, high
        # a shingle counts as often as the item has it: where it stands most nearly as in the item
        there = np.flatnonzero(common)
        which = place[there]
        order = np.lexsort((np.abs(there - first[which] - (at - low)), which))
        sorted_ = which[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        common[there[order[rank >= often[sorted_]]]] = False
        weight = self.weights(near)
        # the largest ratio of common to all weight, by the best sum of gains at the ratio so far until it stays
        ratio, a, b = 0.0, 0, 0
        while True:
            gain = np.append(0.0, np.cumsum(np.where(common, weight, -ratio * weight)))
            lowest = np.minimum.accumulate(gain)
            end = int(np.argmax(gain - lowest))
            start = int(np.argmin(gain[: end + 1]))
            met, all_ = float(weight[start:end][common[start:end]].sum()), float(weight[start:end].sum())
            if met / (total + all_ - met) <= ratio + 1e-12:
                break
            ratio, a, b = met / (total + all_ - met), start, end + SHINGLE - 1
        return self.similarity(near[a:b], own), low + a, low + b


def _word_frequencies(vocabulary: np.ndarray):
    """In how many documents each word of the benchmark occurs, summed in the task."""

    def run(batches):
        total, n = np.zeros(len(vocabulary), dtype=np.int64), 0
        slot = np.zeros(1 << 20, dtype=bool)
        slot[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in groups(batches, "text", GROUP_BYTES):
            n += batch.num_rows
            words = alnum_words(batch.column(0))
            hashes, text = words.hashes(), words.text_of_word()
            maybe = slot[(hashes >> np.uint64(44)).astype(np.int64)]
            hashes, text = hashes[maybe], text[maybe]
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            hit = vocabulary[at] == hashes
            seen = np.unique(text[hit] * len(vocabulary) + at[hit])
            total += np.bincount(seen % len(vocabulary), minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], names=["k", "n"])

    return run


def _search(benchmark, radius: int, threshold: float):
    def run(batches):
        bench: Benchmark = benchmark.value
        for batch in groups(batches, "text", GROUP_BYTES):
            words = alnum_words(batch.column(1))
            hashes, text = words.hashes(), words.text_of_word()
            sums = lane_sums(hashes)
            best: dict[tuple[int, int], tuple[float, int, int]] = {}
            compared: set[tuple[int, int, int]] = set()
            for size, probe in bench.probes.items():
                if len(hashes) < size:
                    continue
                windows = simhashes(sums, size)
                inside = text[: len(windows)] == text[size - 1 :]
                found, entry = probe.search(windows, radius)
                for w, e in zip(found.tolist(), entry.tolist(), strict=True):
                    if not inside[w]:
                        continue
                    item, d = int(probe.item[e]), int(text[w])
                    low, high = int(words.first[d]), int(words.first[d + 1])
                    at = w - int(probe.shift[e]) - low
                    if (d, item, at) in compared:
                        continue
                    compared.add((d, item, at))
                    s, a, b = bench.best_stretch(hashes[low:high], item, at, threshold)
                    if s >= threshold and s > best.get((d, item), (0.0,))[0]:
                        best[d, item] = (s, a, b - 1)
            if best:
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], int(bench.ids[i]), *x) for (d, i), x in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _HITS_ARROW.types, strict=True)], schema=_HITS_ARROW)

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, threshold: float = SIMILARITY, items: int = ITEMS, shortest: int = SHORTEST) -> DataFrame:
    """Where whole texts of ``docs`` (doc_id, text) hold items of ``benchmark`` (item_id, text).

    Every window of every text gets a SimHash of its words (letters and digits, lower case), for each window size of
    the items. An item's windows are of the largest size that stays whole somewhere in any text of similarity
    ``threshold`` to it, and as dense as that takes: a single changed word in a window as long as the item would change
    its hash beyond any useful radius. Multi-index Hamming blocks find all windows of texts within ``radius`` of an
    item's. There the most similar stretch, which may be shorter or longer than the item, is compared
    with the item by weighted Jaccard similarity of five-word shingles, weighted by inverse document frequency
    over all of ``docs``. The benchmark is searched in blocks of at most ``items`` items, each of which is broadcast.

    Returns one row for each document and item of similarity ``threshold`` or more: doc_id, item_id,
    similarity, first and last word of the best stretch. Items of fewer than ``shortest`` words match nothing, as
    any text holds them; with a lower bound those of fewer than five words match where all their words stand.
    Empty and null ones match nothing. Repeated rows each get their rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // items), -(-size["bytes"] // ITEM_BYTES))
    found = None
    for b in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        ids, said = [r["item_id"] for r in rows], [r["text"] for r in rows]
        bare = Benchmark.build(ids, said, radius, threshold=threshold, shortest=shortest)
        if not bare.probes:
            continue
        counts = texts.select("text").mapInArrow(_word_frequencies(bare.vocabulary), "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
        full = spark.sparkContext.broadcast(Benchmark.build(ids, said, radius, {r["k"]: r["n"] for r in counts}, threshold, shortest))
        hits = texts.mapInArrow(_search(full, radius, threshold), _HITS)
        found = hits if found is None else found.unionByName(hits)
    return spark.createDataFrame([], _HITS) if found is None else found
