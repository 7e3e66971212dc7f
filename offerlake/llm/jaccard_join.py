"""N-gram Jaccard self-join by a token-group matrix: queries open only groups whose token union they overlap enough."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, stash
from .near_duplicates import connected
from .vec import LOWER, SPACE, Words, groups, mix, text_buffer, window_hashes, window_index

SHINGLE = 5
PERCENT = 80
GROUP_BYTES = 8 << 20
GROUP_ROWS = 4096
GROUP_SIZE = 64
QUERIES = 2048  # about so many queries of a group go to one task
SETTLE = 1 << 20
STARS = 2
_FILLER = np.uint64(0x5851F42D4C957F2D)
_KEY = np.uint64(0xA0761D6478BD642F)
_DOC, _HASHES = 0, 1
_STORED = "kind int, grp bigint, idx int, doc_id bigint, n int, digest binary, slot int, body binary"
_STORED_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
_BITS = 48  # of a shingle's hash; equal ones of different shingles only make a shingle seem to be in more sets
_ALIVE = "node bigint, n int, loss double, gid bigint, shared binary, prefix array<bigint>"
_PLACED = "node bigint, n int, loss double, gid bigint, component bigint, least int, most int, prefix array<bigint>"


def _batch(rows: list, types: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[part.split()[0] for part in schema.split(", ")])


def _edges(keys: np.ndarray) -> list[int]:
    """Where runs of equal neighbours begin, and the end."""
    return [*np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist(), len(keys)] if len(keys) else [0]


def needed(n):
    """Of a set of ``n``, so many at least are in every set that is similar to it."""
    return (PERCENT * n + 99) // 100


def sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; a text of one to four words has one."""
    raw, offsets = text_buffer(column)
    words = Words(LOWER[raw], offsets, SPACE)
    hashes = words.hashes()
    lack = np.where(words.count > 0, np.maximum(SHINGLE - words.count, 0), 0)
    first = np.append(0, np.cumsum(words.count + lack))
    if lack.any():
        hashes = np.insert(hashes, np.repeat(words.first[1:], lack), _FILLER)
    at, text = window_index(first, SHINGLE)
    value = window_hashes(hashes, SHINGLE)[at]
    cuts = np.searchsorted(text, np.arange(len(words.count) + 1))
    return [np.unique(value[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _pack(squeeze, *columns: np.ndarray) -> bytes:
    return squeeze.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns))


def _unpack(open_, body: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(open_.decompress(body), dtype=np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _hash_task(slots: int):
    """Documents with their set's size and digest, and the hashes of a group's distinct sets, by slots of hash values."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        shift = np.uint64(_BITS + 1 - slots.bit_length())
        first = TaskContext.get().partitionId() << 32
        for g, batch in enumerate(groups(batches, "text", GROUP_BYTES, GROUP_ROWS)):
            found = sets(batch.column(1))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            rows: list = [(_DOC, first + g, i, doc_id, len(s), d, i % slots, None) for i, (doc_id, s, d) in enumerate(zip(batch.column(0).to_pylist(), found, digests, strict=True))]
            once = [i for d, i in {d: i for i, d in reversed(list(enumerate(digests)))}.items() if len(found[i])]
            if once:
                value = np.concatenate([found[i] for i in once]) >> np.uint64(64 - _BITS)
                doc = np.repeat(np.array(once, dtype=np.uint16), [len(found[i]) for i in once])
                order = np.argsort(value)
                value, doc = value[order], doc[order]
                slot = (value >> shift).astype(np.int32)
                edges = _edges(slot)
                step = np.diff(value, prepend=np.uint64(0))
                step[edges[:-1]] = value[edges[:-1]]
                rows += [(_HASHES, first + g, None, None, b - a, None, int(slot[a]), _pack(squeeze, step[a:b], doc[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for at in range(0, len(rows), 4096):
                yield _batch(rows[at : at + 4096], _STORED_TYPES, _STORED)

    return run


def _frequency_task(batches):
    """Hashes that are in several sets, back to their groups, with the number of those sets. Documents go through."""
    squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    held: list = []
    size, last = 0, None

    def settle():
        value, grp, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(value, kind="stable")
        value, grp, doc = value[order], grp[order], doc[order]
        edges = np.array(_edges(value))
        df = np.repeat(np.diff(edges), np.diff(edges)).astype(np.uint32)
        shared = np.flatnonzero(df > 1)
        order = shared[np.argsort(grp[shared], kind="stable")]
        value, grp, doc, df = value[order], grp[order], doc[order], df[order]
        edges = _edges(grp)
        step = np.diff(value, prepend=np.uint64(0))
        step[edges[:-1]] = value[edges[:-1]]
        rows = [(_HASHES, int(grp[a]), None, None, b - a, None, None, _pack(squeeze, step[a:b], doc[a:b], df[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [_batch(rows, _STORED_TYPES, _STORED)] if rows else []

    for batch in batches:
        through = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            kind, grp, _, _, n, _, slot, body = row
            if kind == _DOC:
                through.append(row)
                continue
            if slot != last and size >= SETTLE:
                yield from settle()
                held, size = [], 0
            last = slot
            step, doc = _unpack(open_, body, n, "<u8", "<u2")
            held.append((np.cumsum(step), np.full(n, grp), doc))
            size += n
        if through:
            yield _batch(through, _STORED_TYPES, _STORED)
    if held:
        yield from settle()


def short(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _BITS // 8]).tobytes()


def long(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) * 8 // _BITS, 8), dtype=np.uint8)
    out[:, : _BITS // 8] = np.frombuffer(body, dtype=np.uint8).reshape(-1, _BITS // 8)
    return out.view("<u8").ravel()


def prefix(n: int, hashes: np.ndarray, df: np.ndarray) -> np.ndarray:
    """The rarest shared shingles of a set of ``n``, one of which any similar set has among its own such.

    All shingles by (sets that have them, hash), the first n - needed(n) + 1; those in no other set meet nothing.
    """
    size = len(hashes) - needed(n) + 1
    return hashes[np.lexsort((hashes, df))[: max(size, 0)]]


def _alive_task(group_size: int):
    """A group's documents come after its shared hashes. Kept are sets of which enough is in other sets at all."""

    def settle(held: list, rows: list):
        value, doc, df = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((value, doc))
        value, doc, df = value[order], doc[order], df[order]
        out = []
        for node, idx, n in rows:
            a, b = np.searchsorted(doc, [idx, idx + 1])
            if b - a < needed(n):
                continue
            own, times = value[a:b], df[a:b]
            least = int(np.argmin(mix(own ^ _KEY)))
            # the least hash is in so many sets; groups of more than group_size of them are split by chance
            share = mix(np.array([node], dtype=np.uint64))[0] % np.uint64(-(-int(times[least]) // group_size))
            with np.errstate(over="ignore"):
                gid = mix(np.array([own[least] + share * _KEY], dtype=np.uint64)).view(np.int64)[0]
            out.append((node, n, 1 - (b - a) / n, int(gid), short(own), prefix(n, own, times).view(np.int64)))
        return [_batch(out[at : at + 1024], [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], _ALIVE) for at in range(0, len(out), 1024)]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        last, held, rows = None, [], []
        for batch in batches:
            for grp, n, body, node, idx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != last:
                    if held and rows:
                        yield from settle(held, rows)
                    last, held, rows = grp, [], []
                if body is not None:
                    step, doc, df = _unpack(open_, body, n, "<u8", "<u2", "<u4")
                    held.append((np.cumsum(step), doc, df))
                else:
                    rows.append((node, idx, n))
        if held and rows:
            yield from settle(held, rows)

    return run


class TokenGroup:
    """A group of sets: the union of their tokens, and for each token the sets that have it."""

    def __init__(self, bodies: list[bytes], sizes: list[int]):
        self.sizes = np.array(sizes, dtype=np.int64)
        found = [long(b) for b in bodies]
        token = np.concatenate(found)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(token, kind="stable")
        token, self.owner = token[order], owner[order]
        self.at = np.array(_edges(token))
        self.union = token[self.at[:-1]]
        self.least = int(self.sizes.min())

    def linked(self, body: bytes, n: int) -> np.ndarray:
        """Numbers of the sets that are similar to a set of ``n``; none where the union's overlap rules them out."""
        own = long(body)
        at = np.minimum(np.searchsorted(self.union, own), len(self.union) - 1)
        at = at[self.union[at] == own]
        if len(at) < needed(max(n, self.least)):
            return np.zeros(0, np.int64)
        many = self.at[at + 1] - self.at[at]
        where = np.arange(int(many.sum())) + np.repeat(self.at[at] - (np.cumsum(many) - many), many)
        both = np.bincount(self.owner[where], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= PERCENT * (n + self.sizes - both))


def _group_task(batches):
    """The components of links within each group."""
    types = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def settle(rows: list):
        label = list(range(len(rows)))
        if len(rows) > 1:
            group = TokenGroup([r[4] for r in rows], [r[1] for r in rows])

            def top(i: int) -> int:
                while label[i] != i:
                    label[i] = label[label[i]]
                    i = label[i]
                return i

            for i, r in enumerate(rows):
                for j in group.linked(r[4], r[1]).tolist():
                    a, b = top(i), top(j)
                    label[max(a, b)] = min(a, b)
            label = [top(i) for i in range(len(rows))]
        sizes = [r[1] for r in rows]
        return [(*r[:4], rows[label[i]][0], min(sizes), max(sizes), r[5]) for i, r in enumerate(rows)]

    last, held, out = None, [], []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[3] != last and held:
                out += settle(held)
                held = []
                if len(out) >= 1024:
                    yield _batch(out, types, _PLACED)
                    out = []
            last = r[3]
            held.append(r)
    if held:
        out += settle(held)
    if out:
        yield _batch(out, types, _PLACED)


def _open_task(batches):
    """A group's sets come before its queries. One link to each other component is enough."""
    last, rows, group = None, [], None
    for batch in batches:
        links = []
        for gid, share, query, node, n, component, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (gid, share) != last:
                last, rows, group = (gid, share), [], None
            if not query:
                rows.append((component, n, body))
                continue
            if group is None:
                group = TokenGroup([r[2] for r in rows], [r[1] for r in rows])
            links += [(component, other) for other in {rows[j][0] for j in group.linked(body, n).tolist()} - {component}]
        if links:
            yield _batch(links, [pa.int64(), pa.int64()], "a bigint, b bigint")


def _links(alive: DataFrame, placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (a, b) between components, of the queries and groups ``wanted`` (node, gid)."""
    shares = wanted.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))
    wanted, shares = cut(wanted), cut(shares)
    found = alive.select("node", "gid", "n", "shared").join(placed.select("node", "component"), "node")
    columns = ["gid", "share", "query", "node", "n", "component", "shared"]
    queries = found.drop("gid").join(wanted, "node").join(shares, "gid").withColumn("share", F.pmod(F.xxhash64("node"), "shares").cast("int")).withColumn("query", F.lit(True))
    members = found.join(shares, "gid").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("query", F.lit(False))
    both = members.select(*columns).unionByName(queries.select(*columns)).repartition("gid", "share").sortWithinPartitions("gid", "share", "query")
    return both.mapInArrow(_open_task, "a bigint, b bigint")


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    now = connected(links.distinct()).toDF("component", "now")
    return cut(placed.join(now, "component", "left").withColumn("component", F.coalesce("now", "component")).drop("now"))


def _entries(placed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The prefix entries (token, node, ...) of tokens that sets of several components have there."""
    all_ = prefixes.join(placed, "node")
    contested = all_.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    return cut(all_.join(contested, "token"))


def _fits(n: Column, least: Column, most: Column) -> Column:
    return (PERCENT * n <= 100 * most) & (PERCENT * least <= 100 * n)


def _room(n: Column, rank: Column) -> Column:
    """Of a set of ``n`` whose token of this rank is the first it shares with another: PERCENT times the largest size the other can have.

    The overlap is at most n - rank, and similar sets of n and m overlap in PERCENT / (100 + PERCENT) of n + m.
    """
    return 100 * n - (100 + PERCENT) * rank


def jaccard_components(docs: DataFrame, group_size: int = GROUP_SIZE, slots: int | None = None, stars: int = STARS) -> DataFrame:
    """Components of documents (doc_id, text) linked by a Jaccard similarity of 0.8 or more of their sets of five-word shingles.

    A-Z are lower-cased; words are runs of other than ASCII white space. Fewer than five words are one shingle. The join
    is exact but for hashes of shingles: sets are known by those of 64 bits, and compared by 48 bits of each.

    1. Equal sets are one set from here on. How many sets have a shingle is counted by slots of hash values, and comes back
       to each set for its shared shingles. A set of which less than 0.8 is shared links to nothing and is done.
    2. Sets with the same least hash form groups, split at random where they may have more than ``group_size`` sets. A group
       stores its token union, and the sets of each token. Within a group all links are found, and make components.
    3. Sets of different groups can be similar only where they share one of their rarest shingles (``prefix``). Such a set is a query for
       the other's group, if the shingle's rank leaves both room enough for the overlap they need; the overlap with the union bounds all the group's sets, and only a group that qualifies is opened. First,
       ``stars`` times, the set with the least of its own in each contested shingle's entries is a query for the groups of other components; then all sets
       outside the largest component of a shingle's entries are queries for all groups of other components there. So every two
       similar sets end in one component, though not all their links are written.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the component; of rows with null doc_ids alone it is null).
    Each row is a document, also where doc_ids repeat. Null texts and texts without words have 0 shingles and are
    linked with nothing, equal ones neither.
    """
    slots = slots or max(1024, 1 << (4 * shuffle_parts(docs.sparkSession) - 1).bit_length())
    if slots < 2 or slots & (slots - 1):
        raise ValueError("slots is a power of two, 2 or more")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = rows.mapInArrow(_hash_task(slots), _STORED)
    stored = stash(hashed.repartition("slot").sortWithinPartitions("slot").mapInArrow(_frequency_task, _STORED))
    # a row's number: of its group and of itself in that
    owned = stored.filter(F.col("kind") == _DOC).select(F.shiftleft("grp", 12).bitwiseOR(F.col("idx")).alias("row"), "grp", "idx", "doc_id", "n", "digest")
    first = cut(owned.filter("n > 0").groupBy("digest").agg(F.min(F.struct("row", "grp", "idx", "n")).alias("first")).select("digest", "first.*"))
    shared = stored.filter(F.col("kind") == _HASHES)
    none = lambda kind: F.lit(None).cast(kind)
    both = shared.select("grp", "n", "body", none("bigint").alias("node"), none("int").alias("idx")).unionByName(first.select("grp", "n", none("binary").alias("body"), F.col("row").alias("node"), "idx"))
    alive = stash(both.repartition("grp").sortWithinPartitions("grp", F.col("idx").asc_nulls_first()).mapInArrow(_alive_task(group_size), _ALIVE))
    grouped = stash(alive.select("node", "n", "loss", "gid", "shared", "prefix").repartition("gid").sortWithinPartitions("gid").mapInArrow(_group_task, _PLACED))
    # unshared shingles are the rarest, so they rank before those listed
    prefixes = grouped.select("node", F.posexplode("prefix").alias("pos", "token"), F.round(F.col("n") * F.col("loss")).cast("int").alias("own"))
    prefixes = prefixes.select("node", "token", (F.col("own") + F.col("pos")).alias("rank"))
    placed = grouped.drop("prefix")
    for _ in range(stars):
        entries = _entries(placed, prefixes)
        leaders = entries.groupBy("token", "component").agg(F.min(F.struct("loss", "node", "n", "gid", "least", "most")).alias("one"), F.max(_room(F.col("n"), F.col("rank"))).alias("room"))
        hubs = leaders.groupBy("token").agg(F.min(F.struct("one", "component")).alias("hub"))
        near = leaders.join(hubs, "token").filter((F.col("component") != F.col("hub.component")) & _fits(F.col("hub.one.n"), F.col("one.least"), F.col("one.most")) & (F.col("room") >= PERCENT * F.col("hub.one.n")))
        placed = _merged(placed, cut(_links(alive, placed, near.select(F.col("hub.one.node").alias("node"), F.col("one.gid").alias("gid")).distinct())))
    entries = _entries(placed, prefixes)
    sizes = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n_sets"))
    largest = cut(sizes.groupBy("token").agg(F.max(F.struct("n_sets", "component"))["component"].alias("largest")))
    queries = entries.join(largest, "token").filter("component <> largest").select("token", "node", "n", "component", "largest", _room(F.col("n"), F.col("rank")).alias("own_room"))
    targets = entries.groupBy("token", "gid", "least", "most", F.col("component").alias("other")).agg(F.max(_room(F.col("n"), F.col("rank"))).alias("room"))
    # of two smaller components, the one with the larger number asks
    placing = (F.col("own_room") >= PERCENT * F.col("least")) & (F.col("room") >= PERCENT * F.col("n"))
    wanted = queries.join(targets, "token").filter(((F.col("other") == F.col("largest")) | (F.col("other") < F.col("component"))) & _fits(F.col("n"), F.col("least"), F.col("most")) & placing)
    placed = _merged(placed, cut(_links(alive, placed, wanted.select("node", "gid").distinct())))
    classes = owned.join(first.select("digest", F.col("row").alias("node")), "digest", "left").join(placed.select("node", "component"), "node", "left")
    classes = cut(classes.select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(-1 - F.col("row")).alias("component")))
    # as a table, so that the join can split a component of very many rows
    least_ids = cut(classes.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return classes.join(least_ids, "component").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
