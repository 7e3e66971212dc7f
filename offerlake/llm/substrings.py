"""Substring dedup: repeated fixed-length word windows merge into maximal removal intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_parts
from .vec import Words, groups, mix, window_hashes, window_index

GROUP_BYTES = 8 << 20
SECOND = np.uint64(0xA0761D6478BD642F)  # makes of a word's hash that for the second hash of windows
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id, which counts as the largest; its variant is odd, those of other ids are even
_HASH_ROWS, _SPAN_ROWS, _TEXT_ROWS = 0, 1, 2
_ROUTED = "kind int, slot int, n int, doc_id bigint, variant bigint, body binary"
_ROUTED_ARROW = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("n", pa.int32()), ("doc_id", pa.int64()), ("variant", pa.int64()), ("body", pa.binary())])
_RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<first:bigint,last:bigint>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _pack(doc: np.ndarray, variant: np.ndarray, pos: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Document ids, variants and positions; ids come in runs and positions ascend in each, so differences are small."""
    step = np.diff(doc, prepend=0)
    gap = pos.astype(np.int64)
    gap[1:] -= np.where((step[1:] == 0) & (variant[1:] == variant[:-1]), pos[:-1], 0)
    planes = [step.view(np.uint8).reshape(-1, 8).T.tobytes(), gap.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()]
    # nearly always all are 0, and left out
    return squeeze.compress(b"".join(planes + ([variant.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()] if variant.any() else [])))


def _unpack(body: bytes, n: int, open_: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(open_.decompress(body), dtype=np.uint8)
    step = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<i8").ravel()
    gap = np.ascontiguousarray(planes[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel().astype(np.int64)
    variant = np.zeros(n, dtype=np.int64) if len(planes) == 12 * n else np.ascontiguousarray(planes[12 * n :].reshape(8, n).T).view("<i8").ravel()
    doc = np.cumsum(step)
    fresh = (step != 0) | (np.diff(variant, prepend=0) != 0)
    fresh[0] = True
    total = np.cumsum(gap)
    starts = np.flatnonzero(fresh)
    before = np.where(starts > 0, total[starts - 1], 0)
    return doc, variant, total - np.repeat(before, np.diff(np.append(starts, n)))


def _slots(doc: np.ndarray, variant: np.ndarray, slots: int) -> np.ndarray:
    values = doc.astype(np.uint64) ^ mix(variant.astype(np.uint64))
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % slots


def _later(doc: np.ndarray, variant: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which of the windows, equal ones from each head on, are of a larger doc_id than the least one of theirs."""
    size = np.diff(np.append(heads, len(doc)))
    later = doc > np.repeat(np.minimum.reduceat(doc, heads), size)
    if doc.max() == NO_ID:  # that number itself comes before null
        own = (doc == NO_ID) & (variant & 1 == 0)
        later |= (variant & 1 == 1) & np.repeat(np.logical_or.reduceat(own, heads), size)
    return later


def _runs(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Equal neighbours of a sorted array."""
    if len(keys):
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            yield int(keys[a]), slice(a, b)


def _span_rows(doc: np.ndarray, variant: np.ndarray, pos: np.ndarray, slots: int, squeeze, rows: list) -> None:
    slot = _slots(doc, variant, slots)
    order = np.lexsort((pos, variant, doc, slot))
    doc, variant, pos, slot = doc[order], variant[order], pos[order], slot[order]
    for s, part in _runs(slot):
        rows.append((_SPAN_ROWS, s, part.stop - part.start, None, None, _pack(doc[part], variant[part], pos[part], squeeze)))


def _emit(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED_ARROW.types, strict=True)], schema=_ROUTED_ARROW)


def _hash_task(window: int, buckets: int, slots: int):
    """Rows for the counting step: window hashes by bucket, packed; and windows that repeat within the group."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in groups(batches, "text", GROUP_BYTES):
            ids = _ids(batch)
            words = Words.of(batch.column(1))
            at, text = window_index(words.first, window)
            if not len(at):
                continue
            hashes = words.hashes()
            value, other = window_hashes(hashes, window)[at], window_hashes(mix(hashes ^ SECOND), window)[at]
            doc, variant, pos = ids[text], batch.column(2).to_numpy()[text], at - words.first[:-1][text]
            rows: list = []
            order = np.argsort(value, kind="stable")
            sorted_ = value[order]
            fresh = np.ones(len(value), dtype=bool)
            fresh[1:] = sorted_[1:] != sorted_[:-1]
            later = np.zeros(len(value), dtype=bool)
            later[order] = _later(doc[order], variant[order], np.flatnonzero(fresh))
            if later.any():
                _span_rows(doc[later], variant[later], pos[later], slots, squeeze, rows)
            keep = np.flatnonzero(~later)
            shift = np.uint64(65 - buckets.bit_length())
            bucket = (other[keep] >> shift).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            turn = np.argsort(bucket, kind="stable")
            keep, bucket = keep[turn], bucket[turn]
            sent = value[keep].astype("<u8")
            for b, part in _runs(bucket):
                rows.append((_HASH_ROWS, b, part.stop - part.start, None, None, sent[part].tobytes() + _pack(doc[keep[part]], variant[keep[part]], pos[keep[part]], squeeze)))
            yield _emit(rows)

    return run


def _count_task(slots: int, flush: int = 1 << 20):
    """For each bucket, the least document of every hash; windows of later documents go on."""

    def settle(held: list, squeeze) -> pa.RecordBatch | None:
        value, doc, variant, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(value, kind="stable")
        value, doc, variant, pos = value[order], doc[order], variant[order], pos[order]
        later = _later(doc, variant, np.flatnonzero(np.append(True, value[1:] != value[:-1])))
        if not later.any():
            return None
        rows: list = []
        _span_rows(doc[later], variant[later], pos[later], slots, squeeze, rows)
        return _emit(rows)

    def run(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        held, size, last = [], 0, None
        for batch in batches:
            through = []
            for kind, slot, n, doc_id, variant, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != _HASH_ROWS:
                    through.append((kind, slot, n, doc_id, variant, body))
                    continue
                if slot != last and size >= flush:
                    if (out := settle(held, squeeze)) is not None:
                        yield out
                    held, size = [], 0
                last = slot
                held.append((np.frombuffer(body, dtype="<u8", count=n), *_unpack(body[8 * n :], n, open_)))
                size += n
            if through:
                yield _emit(through)
        if held and (out := settle(held, squeeze)) is not None:
            yield out

    return run


def _text_task(slots: int):
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in groups(batches, "text", GROUP_BYTES):
            ids, variant = _ids(batch), batch.column(2).to_numpy()
            bodies = [squeeze.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), _TEXT_ROWS, np.int32)), pa.array(_slots(ids, variant, slots).astype(np.int32)), pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(variant), pa.array(bodies, pa.binary())],
                schema=_ROUTED_ARROW,
            )

    return run


def _cut_task(window: int):
    """Each slot brings its spans first, then its texts."""

    def spans(held: list, open_) -> dict[tuple[int, int], np.ndarray]:
        """The starts of windows to remove, by document and variant."""
        if not held:
            return {}
        doc, variant, pos = (np.concatenate(x) for x in zip(*(_unpack(b, n, open_) for n, b in held), strict=True))
        order = np.lexsort((pos, variant, doc))
        doc, variant, pos = doc[order], variant[order], pos[order]
        cuts = [*np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1]))).tolist(), len(doc)]
        return {(int(doc[a]), int(variant[a])): pos[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)}

    def one(raw: bytes, starts: np.ndarray) -> tuple[int, int, str, list]:
        data = np.frombuffer(raw, dtype=np.uint8)
        words = Words(data, np.array([0, len(data)]))
        n = len(words.start)
        gone = np.zeros(n + 1, dtype=np.int64)
        starts = np.unique(starts)
        np.add.at(gone, starts, 1)
        np.add.at(gone, np.minimum(starts + window, n), -1)
        out = np.cumsum(gone)[:n] > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
        lines = raw.split()  # ASCII white space and no other, as in the words above
        kept = b" ".join(lines) if not len(edge) else b" ".join([w for w, x in zip(lines, out.tolist(), strict=True) if not x])
        return n, int(out.sum()), hashlib.sha256(kept).hexdigest(), [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        held, slot, found = [], None, None
        for batch in batches:
            rows = []
            for kind, s, n, doc_id, variant, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != slot:
                    held, slot, found = [], s, None
                if kind == _SPAN_ROWS:
                    held.append((n, body))
                    continue
                if found is None:
                    found = spans(held, open_)
                    held = []
                starts = found.get((doc_id, variant), np.zeros(0, np.int64))
                rows.append((None if variant & 1 else doc_id, *one(open_.decompress(body), starts)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT_ARROW.types, strict=True)], schema=_RESULT_ARROW)

    return run


def substring_dedup(docs: DataFrame, window: int = 13, slots: int | None = None) -> DataFrame:
    """Words of ``docs`` (doc_id, text) to remove, because a window of ``window`` words that covers them
    starts in a document with a smaller doc_id too.

    Every window of every text gets two Rabin-Karp hashes: 64 bits of the one are compared within the buckets that
    the first bits of the other name, so that windows pass for equal with 64 bits and those of the bucket. A task first settles what repeats among its own
    texts and sends one row of packed hashes for each of ``slots`` hash buckets, so that a passage in a
    third of all texts crosses the shuffle once a group of texts. The bucket's task finds the least document
    of each hash. The windows of later documents meet their texts by doc_id, where overlapping windows merge
    into maximal intervals. All memory is bounded by a group of texts, a bucket or one text; ``slots``
    (default: 16 for each shuffle partition, 4096 at least, a power of two) sets how fine buckets are.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space), spans (first and last word
    number of each interval). A null text has no words; a null doc_id counts as the largest. Rows that repeat a doc_id are
    rows of their own, told apart by a hash of their text; none of them is smaller than the others.
    """
    slots = slots or max(4096, 1 << (16 * shuffle_parts(docs.sparkSession) - 1).bit_length())
    if slots < 2 or slots & (slots - 1):
        raise ValueError("slots is a power of two, 2 or more")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    said = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = rows.filter("doc_id is not null").select("doc_id", said.alias("said")).groupBy("doc_id").agg(F.min("said").alias("low"), F.max("said").alias("high"))
    repeated = cut(ids.filter("low <> high").select("doc_id", F.lit(True).alias("repeated")))
    variant = F.when(F.col("doc_id").isNull(), said.bitwiseOR(F.lit(1)))
    if not repeated.isEmpty():
        rows = rows.join(repeated, "doc_id", "left")
        variant = variant.when(F.col("repeated"), said.bitwiseAND(F.lit(-2)))
    rows = rows.select("doc_id", "text", variant.otherwise(0).cast("bigint").alias("variant"))
    hashed = rows.mapInArrow(_hash_task(window, slots, slots), _ROUTED)
    spans = hashed.repartition("slot").sortWithinPartitions("kind", "slot").mapInArrow(_count_task(slots), _ROUTED)
    texts = rows.mapInArrow(_text_task(slots), _ROUTED)
    return spans.unionByName(texts).repartition("slot").sortWithinPartitions("slot", "kind").mapInArrow(_cut_task(window), _RESULT)
