"""Toxicity by exact nearest labelled examples in TF-IDF space, found in a block-max inverted index."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .vec import Words, groups, range_hashes

MAX_EXAMPLES = 1000  # labelled rows of each class that the index is fitted on
PREFIXES = (4, 5, 6, 7)
TELLING = 30.0  # chi-square from which on a word has its full weight, and a word beginning is a feature
LEAST_WEIGHT = 0.1  # of its full weight, for a word that tells nothing
BLOCK = 64
NEIGHBOURS = 15
OPENED = 2  # blocks that are opened first, then twice as many each time
OFTEN = 10  # a feature of one in so many examples is frequent
GROUP_BYTES = 4 << 20
_SCORED = "doc_id bigint, score double, evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>"
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


@dataclass
class Features:
    """The words of the examples and the telling word beginnings among them, sorted; numbers run through both."""

    words: np.ndarray
    beginnings: np.ndarray

    def __len__(self) -> int:
        return len(self.words) + len(self.beginnings)


def _hits(value: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(wanted):
        return np.zeros(0, np.int64), text[:0]
    at = np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)
    hit = wanted[at] == value
    return at[hit], text[hit]


def _counted(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    heads = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))) if len(value) else np.zeros(0, np.int64)
    return text[heads], value[heads], np.diff(np.append(heads, len(value)))


def _words_and_beginnings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    words = Words.letters(column)
    text = words.text_of_word()
    length = words.end - words.start
    values, texts = [], []
    for n in PREFIXES:
        longer = np.flatnonzero(length > n)
        values.append(range_hashes(words.raw, words.start[longer], words.start[longer] + n))
        texts.append(text[longer])
    return words.hashes(), text, np.concatenate(values), np.concatenate(texts)


def features(column: pa.Array, wanted: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of each text: its words in lower case, and their first 4 to 7 bytes, as far as wanted."""
    value, text, begin, begin_text = _words_and_beginnings(column)
    a, at = _hits(value, text, wanted.words)
    b, bt = _hits(begin, begin_text, wanted.beginnings)
    return _counted(np.append(a, b + len(wanted.words)), np.append(at, bt))


def _class_counts(batches):
    """In how many texts of each class words and beginnings are."""
    for batch in groups(batches, "text", GROUP_BYTES):
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        value, text, begin, begin_text = _words_and_beginnings(batch.column(1))
        for whole, v, t in ((True, value, text), (False, begin, begin_text)):
            t, v, _ = _counted(v, t)
            order = np.argsort(v, kind="stable")
            v, label = v[order], toxic[t[order]]
            if not len(v):
                continue
            heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            n = np.diff(np.append(heads, len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), whole)), pa.array(v[heads].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.add.reduceat(label, heads))], names=["whole", "feature", "n", "n_toxic"])


def _frequencies(wanted):
    """Document frequencies of the wanted features, summed in the task."""

    def run(batches):
        total, n = np.zeros(len(wanted.value), dtype=np.int64), 0
        for batch in groups(batches, "text", GROUP_BYTES):
            _, value, _ = features(batch.column(0), wanted.value)
            total += np.bincount(value.astype(np.int64), minlength=len(wanted.value))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(total), -1).astype(np.int32)), pa.array(np.append(total[total > 0], n))], names=["k", "n"])

    return run


def _vectors(wanted):
    def run(batches):
        for batch in groups(batches, "text", GROUP_BYTES):
            text, value, count = features(batch.column(2), wanted.value)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (value, count)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "k", "n"])

    return run


def _weights(value: np.ndarray, count: np.ndarray, text: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """L2-normalised TF-IDF weights; ``idf`` has how telling a feature is as a factor."""
    w = (1 + np.log(count)) * idf[value]
    norm = np.sqrt(np.bincount(text, w * w, minlength=texts))
    return w / norm[text]


@dataclass
class BlockMaxIndex:
    """Inverted lists of example weights over blocks of ``BLOCK`` neighbouring examples.

    A rare feature's list is short and read whole. A frequent one's is cut into blocks; ``top[f, b]`` is its largest weight
    in block b. What the rare lists give, and the query's weights times ``top``, bound the similarity of every example of a
    block, so that blocks below the k-th best so far are never opened.
    """

    wanted: Features
    idf: np.ndarray
    doc_id: np.ndarray
    toxic: np.ndarray
    start: np.ndarray  # of each feature's list; those of frequent features are empty
    example: np.ndarray
    weight: np.ndarray
    frequent: np.ndarray  # of each feature: its number among the frequent ones, or -1
    lists: np.ndarray  # blocks x frequent features x BLOCK
    top: np.ndarray
    worth: np.ndarray  # of each example: how many labelled rows of its class it stands for
    prior: float
    silent: float  # how likely texts without any feature are toxic
    knots: tuple[np.ndarray, np.ndarray] = field(default=(np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    @classmethod
    def build(cls, wanted, idf, doc_id, toxic, text, value, count, rates: tuple[float, float] = (1.0, 1.0), neighbours: int = NEIGHBOURS) -> BlockMaxIndex:
        weight = _weights(value, count, text, idf, len(doc_id)) if len(value) else np.zeros(0)
        seen = np.bincount(text, minlength=len(doc_id)) > 0
        worth = np.array(rates)[toxic] if len(toxic) else np.zeros(0)
        prior = float((worth @ toxic + 0.5) / (worth.sum() + 2.0))
        silent = float(((worth * toxic)[~seen].sum() + 2 * prior) / (worth[~seen].sum() + 2.0))
        # examples that share their heaviest feature are neighbours: their blocks have tight bounds
        lead = np.full(len(doc_id), len(idf))
        best = np.lexsort((value, -weight, text))
        firsts = np.flatnonzero(np.append(True, np.diff(text[best]) != 0)) if len(best) else best
        lead[text[best[firsts]]] = value[best[firsts]]
        order = np.lexsort((doc_id, lead, ~seen))[: int(seen.sum())]
        place = np.full(len(doc_id), -1)
        place[order] = np.arange(len(order))
        blocks = max(1, -(-len(order) // BLOCK))
        at = place[text]
        turn = np.lexsort((at, value))
        value, at, weight = value[turn], at[turn], weight[turn]
        held = np.bincount(value, minlength=len(idf))
        often = np.flatnonzero(held > len(order) / OFTEN)
        frequent = np.full(len(idf), -1, dtype=np.int32)
        frequent[often] = np.arange(len(often))
        lists = np.zeros((blocks, len(often), BLOCK))
        there = frequent[value] >= 0
        lists[at[there] // BLOCK, frequent[value[there]], at[there] % BLOCK] = weight[there]
        start = np.append(0, np.cumsum(np.where(frequent < 0, held, 0)))
        index = cls(wanted, idf, doc_id[order], toxic[order], start, at[~there].astype(np.int32), weight[~there], frequent, lists, lists.max(2).T.copy(), worth[order], prior, silent)
        # every example as a query that does not see itself: how often such votes were right
        turn = np.lexsort((value, at))
        value, at, weight = value[turn], at[turn], weight[turn]
        cuts = np.searchsorted(at, np.arange(len(order) + 1))
        votes = np.array([index.votes(value[a:b], weight[a:b], neighbours, own=i)[0] for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
        if len(votes):
            index.knots = monotone(votes, index.toxic.astype(float), index.worth)
        return index

    def nearest(self, f: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine with the query and their similarities, exactly."""
        row = self.frequent[f]
        rare = row < 0
        a = self.start[f[rare]]
        n = self.start[f[rare] + 1] - a
        place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # padded to whole blocks
        known = np.bincount(self.example[place], np.repeat(q[rare], n) * self.weight[place], minlength=self.lists.shape[0] * BLOCK).reshape(-1, BLOCK)
        row, q = row[~rare], q[~rare]
        bound = known.max(1) + q @ self.top[row]
        turn = np.argsort(-bound, kind="stable")
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        first, opened = 0, OPENED
        while first < len(turn) and bound[turn[first]] > 0 and not (len(sims) == k and sims[-1] >= bound[turn[first]] + 1e-12):
            blocks = turn[first : first + opened]
            first, opened = first + opened, 2 * opened
            score = known[blocks] + q @ self.lists[blocks[:, None], row]
            hit = np.flatnonzero(score > (max(0.0, sims[-1] - 1e-12) if len(sims) == k else 0.0))
            ids, sims = np.append(ids, blocks[hit // BLOCK] * BLOCK + hit % BLOCK), np.append(sims, score.ravel()[hit])
            best = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[best], sims[best]
        return ids, sims

    def votes(self, f: np.ndarray, q: np.ndarray, k: int, own: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The toxic share of the nearest examples, by similarity and worth; the prior has a vote that grows with their
        distance. ``own`` is an example to leave out."""
        ids, sims = self.nearest(f, q, k + (own >= 0))
        ids, sims = ids[ids != own][:k], sims[ids != own][:k]
        if not len(ids):
            return self.silent, ids, sims
        rest = 1.25 - min(1.0, float(sims.mean()))
        vote = sims * self.worth[ids]
        return float((vote @ self.toxic[ids] + rest * self.prior) / (vote.sum() + rest)), ids, sims

    def score(self, f: np.ndarray, q: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        """The votes' share, read as how often examples with such votes are toxic."""
        if not len(f):
            return self.silent, np.zeros(0, np.int64), np.zeros(0)
        share, ids, sims = self.votes(f, q, k)
        return (float(np.interp(share, *self.knots)) if len(ids) else share), ids, sims


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit of y to x (pooled neighbours), from 0 to 1, a little drawn to the diagonal."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        pools.append([c * b, c, c * a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    at = [s / n for _, n, s in pools]
    return np.array([0.0, *at, 1.0]), np.array([0.0, *((t + a) / (n + 1) for (t, n, _), a in zip(pools, at, strict=True)), 1.0])


def _score(index, k: int):
    def run(batches):
        ix: BlockMaxIndex = index.value
        for batch in groups(batches, "text", GROUP_BYTES):
            text, value, count = features(batch.column(1), ix.wanted)
            value = value.astype(np.int64)
            weight = _weights(value, count, text, ix.idf, batch.num_rows) if len(value) else np.zeros(0)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            scores, evidence = np.full(batch.num_rows, ix.silent), [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[i], cuts[i + 1])
                scores[i], ids, sims = ix.score(value[part], weight[part], k)
                evidence[i] = [{"doc_id": int(d), "similarity": float(s), "toxic": int(t)} for d, s, t in zip(ix.doc_id[ids], sims, ix.toxic[ids], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(evidence, _EVIDENCE), *batch.columns[2:]], names=["doc_id", "score", "evidence", *batch.schema.names[2:]])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> BlockMaxIndex:
    """An index over at most ``max_examples`` labelled rows of each class, chosen by a hash of their ids.

    Features are all words of those examples, and those beginnings of words that tell the classes apart (chi-square
    with a Bonferroni bound). A word's weight rises with its chi-square to that bound: words that tell nothing would
    otherwise drown the others in the cosine. Document frequencies come from all of ``docs``.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64("doc_id")
    there = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [known.filter(F.col("toxic") == y).orderBy(turn, "doc_id").limit(max_examples) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most 2 * max_examples ids
    sample = stash(texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("doc_id", "toxic", "text"))
    counts = sample.select("toxic", "text").mapInArrow(_class_counts, "whole boolean, feature bigint, n bigint, n_toxic bigint").groupBy("whole", "feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    rates = tuple(there.get(y, 0) / min(max_examples, max(1, there.get(y, 0))) for y in (0, 1))
    a, b = F.col("n_toxic"), F.col("n") - F.col("n_toxic")
    c, d = F.lit(pos) - a, F.lit(neg) - b
    # 2 ln(features) + 6: what the best of so many unrelated features reaches by chance, and a margin
    chi = (a * d - b * c) * (a * d - b * c) * float(pos + neg) / F.greatest(F.lit(1.0), F.col("n").cast("double") * (c + d) * float(max(pos, 1)) * float(max(neg, 1)))
    found = counts.select("whole", "feature", F.when(F.col("n") >= 3, chi).otherwise(0.0).alias("chi")).filter(F.col("whole") | (F.col("chi") > TELLING)).toPandas()
    parts = [found[found.whole], found[~found.whole.astype(bool)]]
    values = [np.asarray(x.feature, dtype=np.int64).view(np.uint64) for x in parts]
    orders = [np.argsort(v) for v in values]
    wanted = Features(*[v[o] for v, o in zip(values, orders, strict=True)])
    telling = np.concatenate([np.clip(np.asarray(x.chi, dtype=float)[o] / TELLING, LEAST_WEIGHT, 1.0) for x, o in zip(parts, orders, strict=True)])
    shared = spark.sparkContext.broadcast(wanted)
    seen = texts.select("text").mapInArrow(_frequencies(shared), "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(wanted))
    of = seen[seen.k >= 0]
    df[of.k.to_numpy()] = of.n.to_numpy()
    idf = telling * (np.log((1 + seen.n[seen.k < 0].sum()) / (1 + df)) + 1)
    rows = sample.mapInArrow(_vectors(shared), "doc_id bigint, toxic int, k array<int>, n array<int>").orderBy("doc_id").collect()
    text = np.repeat(np.arange(len(rows)), [len(r["k"]) for r in rows]) if rows else np.zeros(0, np.int64)
    value, count = (np.concatenate([np.asarray(r[c], dtype=np.int64) for r in rows] or [np.zeros(0, np.int64)]) for c in ("k", "n"))
    return BlockMaxIndex.build(wanted, idf, np.array([r["doc_id"] for r in rows], np.int64), np.array([r["toxic"] for r in rows], np.int64), text, value, count, rates)


def score_toxicity(docs: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS, max_examples: int = MAX_EXAMPLES, key: str | None = None) -> DataFrame:
    """How likely each whole text of ``docs`` (doc_id, text) is toxic, as ``labels`` (doc_id, toxic) mark it.

    Labels are learnt only where crc32 of the id is not 0 modulo 5. A text's vector has the TF-IDF weights
    of all words that the examples have, telling ones the most; its ``neighbours`` nearest examples by exact cosine vote, weighted by similarity
    and by how many labelled rows of their class they stand for, tempered by the class prior; the share is then
    calibrated on the examples' own leave-one-out votes. A text without any of those words (also an empty or null one) gets
    the share of toxic examples among such. Without labels all scores are the prior, 0.25.

    Returns doc_id, held_out, score, predicted, evidence (the voting examples) and the bigint column ``key``, if
    any is named. A null doc_id has null held_out. Repeated rows each get their row.
    """
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples))
    more = [] if key is None else [key]
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).cast("bigint").alias(c) for c in more])
    scored = texts.mapInArrow(_score(index, neighbours), ", ".join([_SCORED, *[f"{c} bigint" for c in more]]))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", *more)
