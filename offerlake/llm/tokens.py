"""Token counts of whole texts, huge ones by overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vec import groups

HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
MEMO = 1_200_000
_RUNS = re.compile(r"\s[ ]|\s\Z")
_PIECES = re.compile(r"(?<=\S)(?=[ \n])")
_loaded: dict[str, object] = {}
_memo: dict[str, dict[str, int]] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_stable(text: str, at: int) -> bool:
    """Whether the pre-tokenizer breaks before ``text[at]`` whatever else the text holds.

    No pre-token of the byte-level pattern goes from a character that is not white space to a space or line
    break, nor from a letter to punctuation or a separator: letters come last in every alternative, white
    space only first or alone. From such a break on, tokens depend only on what follows.
    """
    a, b = text[at - 1], text[at]
    if b in " \n":
        return not a.isspace()
    return unicodedata.category(a)[0] == "L" and unicodedata.category(b)[0] in "PZ"


def _count_small(tokenizer, memo: dict[str, int], texts: list[str]) -> list[int]:
    """Counts by pieces between stable breaks; every distinct piece is encoded once by the tokenizer."""
    cut_up = []
    for t in texts:
        if _RUNS.search(t):
            cut_up.append(_PIECES.split(t))
        else:
            first, *rest = t.split(" ")
            cut_up.append([first, *[" " + w for w in rest]])
    fresh = list(set().union(*cut_up) - memo.keys())
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list(set().union(*cut_up))
    for i in range(0, len(fresh), 4096):
        part = fresh[i : i + 4096]
        memo.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
    return [sum(map(memo.__getitem__, pieces)) for pieces in cut_up]


def _small_task(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tokenizer, memo = _tokenizer(path), _memo.setdefault(path, {})
        for batch in groups(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(_count_small(tokenizer, memo, texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


_CHUNK = "doc bigint, part int, parts int, n_tokens bigint, lead array<struct<at:bigint,n:bigint>>, trail array<struct<at:bigint,n:bigint>>"
_EDGE = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _chunk_task(path: str):
    """For each chunk its token count, and the stable breaks in its first and last overlap, each with the
    number of tokens before it."""

    def breaks(text: str, starts: list[int], low: int, high: int, base: int) -> list[dict]:
        return [{"at": base + s, "n": i} for i, s in enumerate(starts) if max(low, 1) <= s < high and is_stable(text, s)]

    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            for doc, part, parts, base, overlap, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
                lead = breaks(text, starts, 0, overlap, base) if part else []
                trail = breaks(text, starts, len(text) - overlap, len(text), base) if part < parts - 1 else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc], pa.int64()), pa.array([part], pa.int32()), pa.array([parts], pa.int32()), pa.array([len(starts)], pa.int64()), pa.array([lead], _EDGE), pa.array([trail], _EDGE)],
                    names=["doc", "part", "parts", "n_tokens", "lead", "trail"],
                )

    return run


_PIECE = "doc bigint, part int, parts int, base bigint, overlap int, piece string"


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunk ``p`` covers ``[p * chunk, (p + 1) * chunk + overlap)``; the last one goes to the end.

    A task walks its texts once, and has one of them with one chunk of it at a time.
    """

    def run(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                said = text.as_py()
                parts = max(1, -(-(len(said) - overlap) // chunk))
                for p in range(parts):
                    piece = said[p * chunk : (p + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([p], pa.int32()), pa.array([parts], pa.int32()), pa.array([p * chunk], pa.int64()), pa.array([overlap], pa.int32()), pa.array([piece], pa.string())], names=["doc", "part", "parts", "base", "overlap", "piece"])

    return texts.select("doc", "text").mapInArrow(run, _PIECE)


def _splice(chunks: DataFrame) -> DataFrame:
    """Tokens of each document from its chunks, or null where two neighbours share no stable break."""
    order = Window.partitionBy("doc").orderBy("part")
    both = chunks.withColumn("before", F.lag("trail").over(order))
    # the break is the first that both neighbours have; each has its own number of tokens before it
    shared = F.filter("lead", lambda x: F.exists("before", lambda y: y["at"] == x["at"]))
    here = F.get(shared, F.lit(0))
    both = both.withColumn("cut", F.when(F.col("part") > 0, here["at"])).withColumn("skip", F.when(F.col("part") > 0, here["n"]).otherwise(F.lit(0)))
    both = both.withColumn("next_cut", F.lead("cut").over(order))
    until = F.when(F.col("part") == F.col("parts") - 1, F.col("n_tokens")).otherwise(F.get(F.filter("trail", lambda x: x["at"] == F.col("next_cut")), F.lit(0))["n"])
    return both.groupBy("doc").agg(F.when(F.count(until - F.col("skip")) == F.count(F.lit(1)), F.sum(until - F.col("skip"))).alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 512) -> DataFrame:
    """Token counts of every whole text of ``docs`` (doc_id, text).

    Texts of at most ``huge`` code points are counted in their task. Longer ones become chunks of ``chunk``
    code points that overlap by ``overlap``; chunks go to tasks of their own, are encoded with offsets, and two
    neighbours are spliced where both start a token at the same stable break (``is_stable``). A special
    token in the text is never split: it would have to be longer than the overlap to escape both
    neighbours. Where a pair shares no break, its document is cut anew with an overlap and chunk 16 times
    as wide, until one chunk is the whole text.

    Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``). A null text is empty: 0 tokens.
    Repeated rows each get their row.
    """
    path = tokenizer_path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = rows.filter(F.coalesce(F.length("text") <= huge, F.lit(True))).mapInArrow(_small_task(path), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    # equal long texts are encoded once; the fingerprint pairs them with their rows
    long_rows = rows.filter(F.length("text") > huge).withColumn("doc", F.xxhash64("text", F.md5("text")))
    keys = cut(long_rows.select("doc_id", "doc", F.octet_length("text").cast("bigint").alias("n_bytes")))
    counted, longest = None, keys.agg(F.max("n_bytes")).first()[0] or 0
    left = long_rows.select("doc", "text") if longest else None
    while left is not None:
        pieces = _chunks(left, chunk, overlap).repartition("doc", "part").dropDuplicates(["doc", "part"])
        done = cut(_splice(pieces.select("doc", "part", "parts", "base", "overlap", "piece").mapInArrow(_chunk_task(path), _CHUNK)))
        good = done.filter("n_tokens is not null")
        counted = good if counted is None else counted.unionByName(good)
        failed = done.filter("n_tokens is null").select("doc")
        if chunk > longest or failed.isEmpty():
            break
        chunk, overlap = chunk * 16, overlap * 16
        left = left.join(failed, "doc", "left_semi")
    if counted is not None:
        small = small.unionByName(keys.join(counted, "doc").select("doc_id", "n_bytes", "n_tokens"))
    return small.withColumn("over_limit", F.col("n_tokens") > limit)
