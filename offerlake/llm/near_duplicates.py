"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stash
from .vec import LOWER, SPACE, Words, groups, mix, text_buffer, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 9, 3
SURE = 4.2  # standard deviations below the threshold at which the samples rule a pair out
BLOCK = 128  # texts of a large bucket that one group has, twice
GROUP_BYTES = 4 << 20
GROUP_ROWS = 4096  # so that a text's number in its group takes 12 bits
FREQUENT = 1000  # idf tells words apart that are in one of so many documents or more
LEAST = 8
_LOW = np.uint64((1 << 52) - 1)
_FILLER = np.uint64(0x5851F42D4C957F2D)


class Idf:
    """Weights of shingles: (1 + ln tf) times the mean over their words of 1 + idf / largest idf.

    The largest idf is that of a word in one of ``FREQUENT`` documents, which rarer words have too. A weight is thus
    between one and twice a plain shingle's, and weighted similarity stays near the plain one. Values
    are multiples of 1 / 1024, so that their sums are exact and a shingle weighs the same in every text.
    """

    def __init__(self, docs: int, word: np.ndarray, df: np.ndarray):
        order = np.argsort(word)
        self.word = word[order]
        largest = float(np.log(1 + docs / max(LEAST, docs / FREQUENT))) or 1.0
        self.value = np.round(1024 * (1 + np.log(1 + docs / df[order]) / largest)) / 1024
        self.slot = np.zeros(1 << 20, dtype=bool)
        self.slot[(self.word >> np.uint64(44)).astype(np.int64)] = True

    def of(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), 2.0)
        maybe = np.flatnonzero(self.slot[(words >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.word, words[maybe]), len(self.word) - 1)
            hit = self.word[at] == words[maybe]
            out[maybe[hit]] = self.value[at[hit]]
        return out


def shingles(column: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted: the distinct five-word shingles of each text.

    Words are runs of other than white space, ASCII letters in lower case. A text of fewer words is one
    shingle; one without words has none. Shingles are 52-bit hashes.
    """
    raw, offsets = text_buffer(column)
    words = Words(LOWER[raw], offsets, SPACE)
    hashes = words.hashes()
    # texts of one to four words get as many copies of a filler as they lack, behind their words
    lack = np.where(words.count > 0, np.maximum(SHINGLE - words.count, 0), 0)
    first = np.append(0, np.cumsum(words.count + lack))
    if lack.any():
        hashes = np.insert(hashes, np.repeat(words.first[1:], lack), _FILLER)
    count = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(text)) - (np.cumsum(count) - count)[text] + first[:-1][text]
    sums = np.append(0.0, np.cumsum(idf.of(hashes)))
    key = (text.astype(np.uint64) << np.uint64(52)) | (window_hashes(hashes, SHINGLE)[at] & _LOW)
    order = np.argsort(key)
    key, at = key[order], at[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(heads, len(key)))
    key, at = key[heads], at[heads]
    return (key >> np.uint64(52)).astype(np.int64), key & _LOW, (1 + np.log(tf)) * (sums[at + SHINGLE] - sums[at]) / SHINGLE


def _word_counts(batches):
    """In how many texts of a group each word is, and how many texts there are."""
    for batch in groups(batches, "text", 2 * GROUP_BYTES, GROUP_ROWS):
        raw, offsets = text_buffer(batch.column(0))
        words = Words(LOWER[raw], offsets, SPACE)
        value, number = np.unique(words.hashes(), return_inverse=True)
        held = np.unique(words.text_of_word() * max(len(value), 1) + number) % max(len(value), 1)
        counts = np.bincount(held, minlength=len(value))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(value.view(np.int64), 0)), pa.array(np.append(counts, batch.num_rows)), pa.array(np.append(np.zeros(len(value), bool), True))], names=["word", "n", "total"])


def document_frequencies(texts: DataFrame) -> Idf:
    """From how many of all texts hold each word, counted exactly.

    Only words in one of ``FREQUENT`` documents or more come to the driver: at most ``FREQUENT`` times as many
    as a document has in the mean, whatever the size of the corpus.
    """
    counts = cut(texts.select("text").mapInArrow(_word_counts, "word bigint, n bigint, total boolean").groupBy("word", "total").agg(F.sum("n").alias("n")))
    docs = counts.filter("total").agg(F.sum("n")).first()[0] or 0
    found = counts.filter(~F.col("total") & (F.col("n") >= max(LEAST, docs / FREQUENT))).select("word", "n").toPandas()
    return Idf(docs, found["word"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.float64))


class Sampler:
    """Improved consistent weighted sampling.

    For sample k an element of weight w draws r and c from Gamma(2, 1) and b from [0, 1) by its hash alone;
    t = floor(ln w / r + b), and the element with the least ln c - r (t - b + 1) is taken, together with its t.
    Two texts take the same with the probability of their weighted Jaccard similarity. Draws come from tables
    of quantiles.
    """

    TABLE = 2048

    def __init__(self, samples: int, seed: int = 11):
        grid = (np.arange(self.TABLE) + 0.5) / self.TABLE
        # quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)
        x = np.linspace(1e-6, 30, 1 << 18)
        gamma = np.interp(grid, 1 - (1 + x) * np.exp(-x), x)
        self.r, self.log_c = gamma, np.log(gamma)
        self.factor = np.random.default_rng(seed).integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def sample(self, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """texts x samples identities; texts without shingles get 0."""
        out = np.zeros((texts, len(self.factor)), dtype=np.uint64)
        if not len(text):
            return out
        log_w = np.log(weight)
        element = mix(shingle.copy())
        cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        cuts = np.append(cuts, len(text))
        step = 1 << 14
        at = 0
        with np.errstate(over="ignore"):
            while at < len(cuts) - 1:
                to = max(int(np.searchsorted(cuts, cuts[at] + step, side="right")) - 1, at + 1)
                part = slice(cuts[at], cuts[to])
                starts, sizes = cuts[at:to] - cuts[at], np.diff(cuts[at : to + 1])
                lw, el, owner = log_w[part], element[part], text[cuts[at:to]]
                for k, a in enumerate(self.factor):
                    x = el * a
                    r = self.r[(x >> np.uint64(53)).view(np.int64)]
                    b = ((x >> np.uint64(32)) & np.uint64(1023)).view(np.int64) * (1 / 1024)
                    t = np.floor(lw / r + b)
                    value = self.log_c[((x >> np.uint64(42)) & np.uint64(2047)).view(np.int64)] - r * (t - b + 1)
                    least = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), sizes))
                    least = least[np.searchsorted(least, starts)]
                    out[owner, k] = mix(el[least] ^ (t[least].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                at = to
        return out


def _sketch(idf, bands: int, rows: int):
    names = ["doc_id", "key", "samples", "buckets"]

    def run(batches):
        sampler = Sampler(bands * rows)
        for batch in groups(batches, "text", GROUP_BYTES, GROUP_ROWS):
            text, shingle, weight = shingles(batch.column(2), idf.value)
            taken = sampler.sample(text, shingle, weight, batch.num_rows)
            has = np.bincount(text, minlength=batch.num_rows) > 0
            value = np.zeros((batch.num_rows, bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for j in range(rows):
                    value = mix(value ^ taken[:, j::rows])
            short = taken.astype(np.uint16)
            samples = pa.array([short[i].tobytes() for i in range(batch.num_rows)], pa.binary())
            buckets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(has, bands, 0))).astype(np.int32)), pa.array(value[has].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), samples, buckets], names=names)

    return run


def weighted_jaccard(idf: Idf, a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of each pair of texts; 0 where neither has a word."""
    sides = [shingles(x, idf) for x in (a, b)]
    key = np.concatenate([(t.astype(np.uint64) << np.uint64(52)) | s for t, s, _ in sides])
    weight = np.concatenate([w for *_, w in sides])
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    text = (key >> np.uint64(52)).astype(np.int64)
    both = np.flatnonzero(key[1:] == key[:-1])
    common = np.bincount(text[both], np.minimum(weight[both], weight[both + 1]), minlength=len(a))
    total = np.bincount(text, weight, minlength=len(a)) - common
    return np.divide(common, total, out=np.zeros(len(a)), where=total > 0)


_LINKS = "a string, b string, similarity double"


def _verify(idf, threshold: float):
    """The pairs (a, b) of (a, b, text_a, text_b) that are similar enough."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = weighted_jaccard(idf.value, part.column(2), part.column(3))
                good = pa.array(s >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good), pa.array(s[s >= threshold])], names=["a", "b", "similarity"])

    return run


def least_agreeing(samples: int, threshold: float) -> int:
    """Two texts of a similarity of ``threshold`` or more agree in at least so many samples, but for a chance of about 1 in 50,000."""
    return max(0, int(samples * threshold - SURE * (samples * threshold * (1 - threshold)) ** 0.5))


def _agreeing(samples: int) -> Column:
    """In how many samples of two bytes ``samples`` and ``lead_samples`` agree."""
    same = lambda i: (F.substring("samples", 2 * i + 1, 2) == F.substring("lead_samples", 2 * i + 1, 2)).cast("int")
    total = same(0)
    for i in range(1, samples):
        total = total + same(i)
    return total


def _block_links(idf, threshold: float, rows: int, least: int):
    """Links between different components in each slot, which has the texts of one or two blocks of a bucket.

    Sides 0 and 1 are the blocks to be compared; rows of side 2 are compared with each other.
    """

    def links(slot: dict) -> tuple[list, list, list]:
        component, side, band = slot["component"], slot["side"], int(slot["band"][0])
        samples = np.frombuffer(b"".join(slot["samples"]), dtype=np.uint16).reshape(len(side), -1)
        x, y = np.triu_indices(len(side), 1) if side[0] == 2 else (v.ravel() for v in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
        differ = component[x] != component[y]
        x, y = x[differ], y[differ]
        if not len(x):
            return [], [], []
        same = samples[x] == samples[y]
        likely = same.sum(1) >= least
        # texts that meet in an earlier band too are compared there
        earlier = same[:, : band * rows].reshape(len(x), band, rows).all(2).any(1) if band else np.zeros(len(x), bool)
        x, y = x[likely & ~earlier], y[likely & ~earlier]
        if not len(x):
            return [], [], []
        used, number = np.unique(np.append(x, y), return_inverse=True)
        x, y = number[: len(x)], number[len(x) :]
        text, shingle, weight = shingles(pa.array([slot["text"][i] for i in used.tolist()], pa.large_string()), idf.value)
        value, code = np.unique(shingle, return_inverse=True)
        cuts = np.searchsorted(text, np.arange(len(used) + 1))
        total = np.bincount(text, weight, minlength=len(used))
        found_x, found_y, found_s = [], [], []
        dense = np.zeros(len(value))
        order = np.argsort(x, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(x[order])) + 1):
            i = int(x[part[0]])
            own = slice(cuts[i], cuts[i + 1])
            dense[code[own]] = weight[own]
            common = np.bincount(text, np.minimum(dense[code], weight), minlength=len(used))[y[part]]
            dense[code[own]] = 0
            s = common / (total[i] + total[y[part]] - common)
            good = np.flatnonzero(s >= threshold)
            found_x += [slot["key"][used[i]]] * len(good)
            found_y += [slot["key"][j] for j in used[y[part[good]]].tolist()]
            found_s += s[good].tolist()
        return found_x, found_y, found_s

    def complete(rows_: pa.Table):
        slots = rows_.column("slot").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(slots)]
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows_.slice(a, b - a)
            slot = {c: part.column(c).to_pylist() for c in ("key", "samples", "text")} | {c: part.column(c).to_numpy() for c in ("side", "band")}
            slot["component"] = np.unique(part.column("component").to_pylist(), return_inverse=True)[1]
            for whole, more in zip(out, links(slot), strict=True):
                whole += more
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            slots = held.column("slot").to_numpy()
            last = int(np.searchsorted(slots, slots[-1]))
            if last:
                yield complete(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None:
            yield complete(held)

    return run


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the least node of each connected component.

    Every round takes the least label among a node and its neighbours, then the label of that label.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = cut(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("component").alias("theirs")), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(near, "node").select("node", F.least("component", "theirs").alias("component"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(jump, "component").select("node", F.least("component", "further").alias("component"), "was"))
        if step.filter("component <> was").isEmpty():
            return step.select("node", "component")
        labels = step.select("node", "component")


def _members(unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, bucket, key, samples) of the texts that share a bucket, and the buckets with their size and leader.

    The leader is the text whose buckets hold the most texts altogether. In a family of copies that is one with few
    changes of its own, near to most others, and leads in nearly all buckets of the family.
    """
    all_ = unique.select("key", "samples", F.posexplode("buckets").alias("band", "bucket"))
    sizes = all_.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(all_.join(sizes, ["band", "bucket"]))
    central = members.groupBy("key").agg(F.sum("n").alias("central"))
    led = members.join(central, "key").groupBy("band", "bucket").agg(F.max(F.struct("central", F.xxhash64("key").alias("h"), "key", "samples")).alias("lead"))
    return members, cut(led.select("band", "bucket", F.col("lead.key").alias("lead"), F.col("lead.samples").alias("lead_samples")))


def _blocks(members: DataFrame, buckets: DataFrame, components: DataFrame, block: int) -> DataFrame:
    """(slot, side, band, key, component, samples) of all that is left to compare in buckets of several components.

    In each bucket the others than those of the leader's component are to be compared with all. Both parts
    fall into blocks of about ``block`` texts, and every two blocks with one of the others make a slot.
    """
    component = F.coalesce("component", "key").alias("component")
    known = members.drop("n").join(components, "key", "left").select("band", "bucket", "key", "samples", component)
    lead = buckets.select("band", "bucket", F.col("lead").alias("key")).join(components, "key", "left").select("band", "bucket", F.coalesce("component", "key").alias("lead_component"))
    parts = known.join(lead, ["band", "bucket"]).withColumn("other", F.col("component") != F.col("lead_component"))
    # one small table of buckets, so that Spark can split the large ones in a single join
    sizes = parts.groupBy("band", "bucket").agg(F.sum(F.col("other").cast("int")).alias("others"), F.count(F.lit(1)).alias("n"), F.min("lead_component").alias("lead_component"))
    sizes = cut(sizes.filter("others > 0"))
    n = lambda count: F.ceil(count / block).cast("int")
    parts = known.join(sizes, ["band", "bucket"]).withColumns({"other": F.col("component") != F.col("lead_component"), "x": n(F.col("others")), "y": n(F.col("n") - F.col("others"))})
    h = F.xxhash64("key", F.lit(7))
    own = F.when(F.col("other"), F.pmod(h, F.col("x"))).otherwise(F.col("x") + F.pmod(h, F.greatest("y", F.lit(1)))).cast("int")
    last = F.when(F.col("other"), F.col("x") + F.col("y")).otherwise(F.col("x")) - 1
    spread = parts.withColumn("own", own).select("band", "bucket", "key", "samples", "component", "own", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("met"))
    side = F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1)
    return spread.select(F.xxhash64("band", "bucket", F.least("own", "met"), F.greatest("own", "met")).alias("slot"), side.alias("side"), "band", "key", "component", "samples")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Classes of equal and near-equal texts of ``docs`` (doc_id, text).

    Equal texts are one text from the start. Each text takes ``bands * rows`` consistent weighted samples of its
    five-word shingles, weighted by TF-IDF; texts that agree on all ``rows`` samples of a band meet in
    a bucket. Similar texts share one with a probability of 1 - (1 - s ** rows) ** bands, 0.998 at 0.8.
    Every text is first compared with its buckets' leaders. Where that leaves several components in a bucket, all
    its texts outside the leader's component are compared with all of other components, block by block. So
    every two texts of a bucket end in one component or are compared, but those whose samples agree too seldom
    (``least_agreeing``). A pair is linked if its weighted Jaccard similarity is ``threshold`` or more.

    Returns one row for each row of ``docs``: doc_id, class_id (least doc_id of the connected texts). Empty and
    null texts equal each other; texts without words link to nothing else. Rows with a null doc_id belong to
    the class of their text; a class of such rows alone has a null id.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = texts.select("doc_id", F.md5("text").alias("key"), "text")
    idf = spark.sparkContext.broadcast(document_frequencies(texts))
    least = least_agreeing(bands * rows, threshold)
    sketch = cut(keyed.mapInArrow(_sketch(idf, bands, rows), "doc_id bigint, key string, samples binary, buckets array<bigint>"))
    unique = sketch.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("samples").alias("samples"), F.min("buckets").alias("buckets"))
    members, buckets = _members(unique)
    # the only time that whole texts are shuffled to be found: those that share a bucket, once each
    needed = members.select("key").distinct().join(sketch.groupBy("key").agg(F.min("doc_id").alias("rep")), "key")
    found = keyed.alias("d").join(needed.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.rep")) & (F.col("d.key") == F.col("i.key"))).select("d.key", "d.text")
    found = stash(found.dropDuplicates(["key"]))
    near = members.join(buckets, ["band", "bucket"]).filter((F.col("key") != F.col("lead")) & (_agreeing(bands * rows) >= least))
    pairs = near.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()
    both = pairs.join(found.toDF("a", "text_a"), "a").join(found.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    first = connected(cut(both.mapInArrow(_verify(idf, threshold), _LINKS))).toDF("key", "component")
    left = _blocks(members, buckets, first, block).join(found, "key").repartition(F.col("slot")).sortWithinPartitions("slot")
    links = cut(left.mapInArrow(_block_links(idf, threshold, rows, least), _LINKS))
    of = lambda side: F.coalesce(F.col(f"{side}.component"), F.col(f"l.{side}")).alias(side)
    joined = links.alias("l").join(first.alias("a"), F.col("l.a") == F.col("a.key"), "left").join(first.alias("b"), F.col("l.b") == F.col("b.key"), "left").select(of("a"), of("b"))
    second = connected(joined.distinct()).toDF("component", "now")
    classes = sketch.select("doc_id", "key").join(first, "key", "left").withColumn("component", F.coalesce("component", "key"))
    classes = cut(classes.join(second, "component", "left").select("doc_id", F.coalesce("now", "component").alias("component")))
    # as a table, so that the join can split a component of very many rows
    least_ids = cut(classes.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    return classes.join(least_ids, "component").select("doc_id", "class_id")
