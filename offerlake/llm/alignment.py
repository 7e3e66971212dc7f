"""Cross-tokenizer alignment: linked token pairs of two vocabularies, counted over documents by a postings cogroup."""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, stash
from .tokens import vocabulary_path
from .vec import groups

SLOTS = 256
GROUP_BYTES = 4 << 20
GROUP_ROWS = 4096
MEMO, MEMO_BYTES = 400_000, 1 << 26
COMBINE = 1 << 22
FLUSH_DOCS = 1 << 20
#: No token of either vocabulary goes from a character that is not white space to a space: A's pre-tokenizer breaks
#: there, and no piece of B has a space mark behind another character. U+180E is white space to some engines.
_BREAK = re.compile("(?<=[^\\s᠎])(?= )")
_RUNS = re.compile("[\\s᠎] ")
_SPACES = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace()) | {"\u180e"}
_BITS, _TEXT_BITS = 24, 12  # of an id of B behind one of A, and of a text's number in its group behind both
_POSTING, _DOC = 0, 1
_STORED = "kind int, grp bigint, slot int, n_pairs int, n_entries int, pairs binary, entries binary, idx int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_TOTALS = "slot int, n int, body binary"


def _batch(rows: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _planes(squeeze: zstandard.ZstdCompressor, *columns: np.ndarray) -> bytes:
    """Integers of 64 bits by their bytes, all first bytes before all second ones."""
    return squeeze.compress(b"".join(np.ascontiguousarray(c, dtype="<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def _columns(open_: zstandard.ZstdDecompressor, body: bytes, n: int, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(open_.decompress(body), dtype=np.uint8).reshape(count, 8, n)
    return [np.ascontiguousarray(raw[k].T).view("<i8").ravel() for k in range(count)]


def slot_of(a: np.ndarray, slots: int) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % slots


def ranks_of(path: str, tokenizer, table: dict[int, bytes]) -> dict[bytes, int] | None:
    """The entries as ranks, if merging neighbours by rank is sure to give the library's tokens; else None.

    It is where merges are listed by their entry's id and every entry's own bytes come to that entry: whatever two
    neighbours make up an entry then, in any text, are the two of its listed merge, as no lower merge is left in these bytes.
    """
    with open(path) as f:
        model = json.load(f)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    ids = [model["model"]["vocab"][x + y] for x, y in merges]
    plain = {entry: i for entry, i in model["model"]["vocab"].items() if i not in {t["id"] for t in model.get("added_tokens", [])}}
    form = model["pre_tokenizer"] or {}
    same = form.get("type") == "ByteLevel" and not form.get("add_prefix_space") and form.get("use_regex", True) and not model.get("normalizer")
    own = all(x < y for x, y in itertools.pairwise(ids)) and all(len(found := tokenizer.model.tokenize(entry)) == 1 and found[0].id == i for entry, i in plain.items())
    return {table[i]: i for i in plain.values()} if same and own else None


class Tokenizers:
    """The two libraries and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte = {chr(x): x for x in shown} | {chr(0x100 + k): x for k, x in enumerate(hidden)}
        self.bytes_a = {i: bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode() for entry, i in self.a.get_vocab(with_added_tokens=True).items()}
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.vocab_size())]
        self.space_b = self.b.piece_to_id("▁")
        self.by_words = not any(" " in piece(i).replace("▁", " ").lstrip(" ") for i in range(self.b.vocab_size()))
        ranks = ranks_of(path_a, self.a, self.bytes_a)
        self.ranked = None if ranks is None else tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``" " + word`` of all words in both vocabularies, one after the other.

        Words that end in no white space are encoded as one text, which ends a token after each of them.
        """
        if len(words) == 1 and words[0] == "":
            # a space by itself is the mark that B puts before every text
            return np.array(self.a.encode(" ", add_special_tokens=False).ids), np.array([self.space_b])
        text = " ".join(words)
        of_a = self.ranked.encode_ordinary(" " + text) if self.ranked else self.a.encode(" " + text, add_special_tokens=False).ids
        return np.array(of_a), np.array(self.b.encode(text))

    def words(self, text: str) -> list[str]:
        """``" " + text`` cut before spaces where both vocabularies end a token, without each part's first space."""
        if not self.by_words:
            return [text]
        if text[:1] != " " and not _RUNS.search(text):
            return text.split(" ")
        return [part[1:] for part in _BREAK.split(" " + text)]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The offsets where both sides end a token, and how many tokens of each side have ended there."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return common, np.searchsorted(ends_a, common, side="right"), np.searchsorted(ends_b, common, side="right")


class Aligner:
    """Every distinct word is encoded and aligned once; documents are sums over their words.

    That is exact, as words end where both vocabularies end a token, so that no group goes beyond a word.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        size = 1 + max(tokenizers.bytes_a)
        self.length_a = np.array([len(tokenizers.bytes_a.get(i, b"")) for i in range(size)])
        self.length_b = np.array([len(x) for x in tokenizers.bytes_b])
        self.width = max(size, len(self.length_b))
        self.signed = np.array([f"{sign}{i}" for sign in ",|;\n" for i in range(self.width)], dtype=object)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str | None] = []
        self.counts: list[np.ndarray] = [np.zeros((0, 5), dtype=np.int32)]
        self.links: list[np.ndarray] = [np.zeros(0, dtype=np.int64)]
        self.size = 0

    def learn(self, words: list[str]) -> None:
        """Numbers the words; of each n_a, n_b, n_groups, n_links and whether both sides give it back, and its links."""
        # only at the end of a text is white space the end of a word; by themselves they lead into no other
        plain = [w for w in words if w and w[-1] not in _SPACES] if self.tokenizers.by_words else []
        odd = [w for w in words if not w or w[-1] in _SPACES] if self.tokenizers.by_words else words
        for part in [plain[i : i + 4096] for i in range(0, len(plain), 4096)] + [[w] for w in odd]:
            self._learn(part)

    def _learn(self, words: list[str]) -> None:
        t = self.tokenizers
        a, b = t.encode(words)
        raw = "".join([" " + w for w in words]).encode()
        if not all(b"".join(map(table.__getitem__, ids.tolist())) == raw for table, ids in ((t.bytes_a, a), (t.bytes_b, b))):
            if len(words) > 1:
                for half in (words[: len(words) // 2], words[len(words) // 2 :]):
                    self._learn(half)
                return
            # nothing is linked in it, nor in any text that has it
            self.number[words[0]] = len(self.said)
            self.said.append(None)
            self.counts.append(np.zeros((1, 5), dtype=np.int32))
            return
        common, to_a, to_b = align(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        ends = np.cumsum([1 + len(w.encode()) for w in words])
        to_group = np.searchsorted(common, ends, side="right")
        of_group = np.repeat(np.arange(len(common)), n_a)
        # each A token meets all B tokens of its group
        links = np.repeat(a, n_b[of_group]) << _BITS | b[_ranges((to_b - n_b)[of_group], n_b[of_group])]
        sums = [np.diff(np.append(0, np.cumsum(x))[to_group], prepend=0) for x in (n_a, n_b, np.ones(len(common), np.int64), n_a * n_b)]
        said = self._say(a, b, n_a, n_b, to_group)
        first = len(self.said)
        self.number.update(zip(words, range(first, first + len(words)), strict=True))
        self.said += said
        self.counts.append(np.stack([*sums, np.ones(len(words), np.int64)], axis=1).astype(np.int32))
        self.links.append(links)
        self.size += len(raw) + 8 * len(links) + 8 * len(a)

    def _say(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, to_group: np.ndarray) -> list[str]:
        """The groups of each word as text: every id with the sign before it, those of A and B of a group in turn."""
        width = 2 * len(n_a)
        count, start = np.zeros(width, np.int64), np.zeros(width, np.int64)
        count[::2], count[1::2] = n_a, n_b
        start[::2], start[1::2] = np.cumsum(n_a) - n_a, len(a) + np.cumsum(n_b) - n_b
        ids = np.concatenate([a, b])[_ranges(start, count)]
        sign = np.zeros(len(ids), np.int64)  # a comma
        first = np.cumsum(count) - count
        sign[first[1::2]] = 1  # a bar
        sign[first[::2]] = 2  # a semicolon
        sign[first[::2][np.append(0, to_group[:-1])]] = 3  # the next word
        return "".join(self.signed[sign * self.width + ids].tolist())[1:].split("\n")

    def group(self, texts: list[str | None]):
        """Of each text (n_a, n_b, n_groups, n_links, groups_sha256), and of all (text, pair, times) as arrays."""
        cut_up = [self.tokenizers.words(t) if t else [] for t in texts]
        if len(self.number) > MEMO or self.size > MEMO_BYTES:
            self.clear()
        self.learn(list(set().union(*cut_up) - self.number.keys()))
        self.counts, self.links = [np.concatenate(self.counts)], [np.concatenate(self.links)]
        counts, links = self.counts[0], self.links[0]
        last = np.cumsum(counts[:, 3], dtype=np.int64)
        size = np.array([len(x) for x in cut_up], dtype=np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(map(self.number.__getitem__, words) for words in cut_up), dtype=np.int64, count=int(size.sum()))
        text = np.repeat(np.arange(len(texts)), size)
        bad = np.bincount(text, counts[flat, 4] == 0, minlength=len(texts)) > 0
        cuts = np.append(0, np.cumsum(size)).tolist()
        numbers = flat.tolist()
        said = ["" if bad[i] or a == b else hashlib.sha256(";".join(map(self.said.__getitem__, numbers[a:b])).encode()).hexdigest() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        held = ~bad[text]
        text, flat = text[held], flat[held]
        sums = [np.bincount(text, counts[flat, k], minlength=len(texts)).astype(np.int64) for k in range(4)]
        many = counts[flat, 3].astype(np.int64)
        key = np.sort(links[_ranges(last[flat] - many, many)] << _TEXT_BITS | np.repeat(text, many))
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        key, times = key[heads], np.diff(np.append(heads, len(key)))
        return list(zip(*(s.tolist() for s in sums), said, strict=True)), key & (1 << _TEXT_BITS) - 1, key >> _TEXT_BITS, times


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(Tokenizers(path_a, path_b))
    return _aligners[path_a, path_b]


def _encode_task(path_a: str, path_b: str, slots: int):
    """Documents' own columns, and the postings of a group of documents for every slot of A's ids."""

    def run(batches):
        squeeze, aligner = zstandard.ZstdCompressor(level=1), _aligner(path_a, path_b)
        first = TaskContext.get().partitionId() << 32
        for g, batch in enumerate(groups(batches, "text", GROUP_BYTES, GROUP_ROWS)):
            own, text, pair, times = aligner.group(batch.column(1).to_pylist())
            rows: list = [(_DOC, first + g, None, None, None, None, None, i, doc_id, *x) for i, (doc_id, x) in enumerate(zip(batch.column(0).to_pylist(), own, strict=True))]
            slot = slot_of(pair >> _BITS, slots)
            order = np.argsort(slot, kind="stable")  # pairs and their texts ascend already
            text, pair, times, slot = text[order], pair[order], times[order], slot[order]
            edges = np.unique(np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(slot)])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                p = pair[a:b]
                heads = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                docs = np.diff(np.append(heads, b - a))
                rows.append((_POSTING, first + g, int(slot[a]), len(heads), b - a, _planes(squeeze, p[heads] >> _BITS, p[heads] & (1 << _BITS) - 1, docs), _planes(squeeze, text[a:b], times[a:b]), *[None] * 7))
            for at in range(0, len(rows), 4096):
                yield _batch(rows[at : at + 4096], _TYPES, _names(_STORED))

    return run


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[heads], b[heads], np.add.reduceat(n, heads)


def _combine_task(slots: int):
    """Documents a pair, summed over the groups of a task before they are shuffled."""

    def run(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        held: list = []
        size = 0

        def flush():
            a, b, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            slot = slot_of(a, slots)
            order = np.argsort(slot, kind="stable")
            a, b, n, slot = a[order], b[order], n[order], slot[order]
            edges = np.append(0, np.flatnonzero(slot[1:] != slot[:-1]) + 1)
            return _batch([(int(slot[i]), int(j - i), _planes(squeeze, a[i:j], b[i:j], n[i:j])) for i, j in zip(edges, [*edges[1:], len(slot)], strict=True)], [pa.int32(), pa.int32(), pa.binary()], _names(_TOTALS))

        for batch in batches:
            for n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_columns(open_, body, n, 3))
                size += n
                if size >= COMBINE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _total_task():
    """For each slot all its pairs with their documents, and whether a pair's count is its A id's highest."""

    def run(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        held: list = []
        size, last = 0, None

        def settle():
            a, b, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.append(heads, len(a))))
            return _batch([(last, len(a), _planes(squeeze, a, b, n, best))], [pa.int32(), pa.int32(), pa.binary()], _names(_TOTALS))

        for batch in batches:
            for slot, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot != last and held:
                    yield settle()
                    held, size = [], 0
                last = slot
                held.append(_columns(open_, body, n, 3))
                size += n
                if size >= COMBINE and len(held) > 1:  # as many as there are different pairs, not groups
                    held = [list(_summed(*(np.concatenate(x) for x in zip(*held, strict=True))))]
                    size = 0
        if held:
            yield settle()

    return run


_SUMS = "grp bigint, n int, body binary"


def _contribution_task():
    """A slot's totals come before its postings; documents' sums are kept over all slots of a task until there are many."""

    def run(batches):
        squeeze, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        totals = None
        sums: dict[int, np.ndarray] = {}

        def flush():
            rows = []
            for grp, s in sums.items():
                held = np.flatnonzero(s[1])
                rows.append((grp, len(held), _planes(squeeze, held, s[0][held], s[1][held])))
            return _batch(rows, [pa.int64(), pa.int32(), pa.binary()], _names(_SUMS))

        for batch in batches:
            for grp, n_pairs, n_entries, pairs, entries in zip(*(batch.column(c).to_pylist() for c in ("grp", "n_pairs", "n_entries", "pairs", "entries")), strict=True):
                if entries is None:
                    a, b, n, best = _columns(open_, pairs, n_pairs, 4)
                    totals = (a << 32 | b, n, best)
                    continue
                a, b, docs = _columns(open_, pairs, n_pairs, 3)
                text, times = _columns(open_, entries, n_entries, 2)
                at = np.repeat(np.searchsorted(totals[0], a << 32 | b), docs)
                here = sums.setdefault(grp, np.zeros((2, GROUP_ROWS), dtype=np.int64))
                np.add.at(here[0], text, times * totals[2][at])
                np.add.at(here[1], text, times * totals[1][at])
                if len(sums) * GROUP_ROWS > FLUSH_DOCS:
                    yield flush()
                    sums.clear()
        if sums:
            yield flush()

    return run


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _sum_task():
    """A group's contributions come before its documents."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor()
        last, sums = None, None
        for batch in batches:
            rows = []
            for grp, n, body, idx, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != last:
                    last, sums = grp, np.zeros((2, GROUP_ROWS), dtype=np.int64)
                if body is not None:
                    text, best, total = _columns(open_, body, n, 3)
                    sums[0][text] += best
                    sums[1][text] += total
                    continue
                rows.append((*own[:5], int(sums[0][idx]), int(sums[1][idx]), own[5]))
            if rows:
                yield _batch(rows, [pa.int64()] * 7 + [pa.string()], _names(_RESULT))

    return run


def align_tokenizers(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, slots: int = SLOTS, salts: int | None = None) -> DataFrame:
    """Groups and links between the tokens of two vocabularies in every whole text of ``docs`` (doc_id, text).

    A is a ``tokenizers`` file, which encodes a space and the text, B a ``sentencepiece`` model, which puts the
    space itself. Offsets where both end a token cut them into groups; every A token of a group is linked with
    every B token of it. The postings of a group of documents, i.e. how often each has each pair, are stored once,
    packed by slots of A's ids. Counts of pairs are summed within a task, then by slot, where each A id's highest is
    known too. These totals meet the postings by slot and ``salts`` shares of the documents (default: 8, more where there are more
    shuffle partitions than a quarter of the slots and salts), so that an id of all documents is spread; tasks read totals first and stream the postings,
    sum what they give each document, and the sums meet the documents by group.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as any pair of its A id),
    count_sum (documents of each link's pair, summed), groups_sha256. Texts that are null or empty, or that
    either vocabulary does not give back, have no tokens: zeros and ''. Each row is a document, also where a doc_id
    repeats or is null. Other columns are not looked at.
    """
    path_a, path_b = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    parts = shuffle_parts(docs.sparkSession)
    salts = salts or max(8, -(-4 * parts // slots))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = stash(rows.mapInArrow(_encode_task(path_a, path_b, slots), _STORED))
    postings = stored.filter(F.col("kind") == _POSTING)
    counts = postings.select("n_pairs", "pairs").mapInArrow(_combine_task(slots), _TOTALS)
    totals = counts.repartition("slot").sortWithinPartitions("slot").mapInArrow(_total_task(), _TOTALS)
    none = lambda kind: F.lit(None).cast(kind)
    heads = totals.select("slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), none("bigint").alias("grp"), F.col("n").alias("n_pairs"), none("int").alias("n_entries"), F.col("body").alias("pairs"), none("binary").alias("entries"))
    salt = F.pmod(F.xxhash64("grp"), F.lit(salts)).cast("int").alias("salt")
    both = heads.unionByName(postings.select("slot", salt, "grp", "n_pairs", "n_entries", "pairs", "entries")).repartition("slot", "salt")
    sums = both.sortWithinPartitions("salt", "slot", F.col("grp").asc_nulls_first()).mapInArrow(_contribution_task(), _SUMS)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    columns = {c: none("string" if c == "groups_sha256" else "bigint") for c in own}
    given = sums.select("grp", "n", "body", none("int").alias("idx"), *[v.alias(c) for c, v in columns.items()])
    mine = stored.filter(F.col("kind") == _DOC).select("grp", none("int").alias("n"), none("binary").alias("body"), "idx", *own)
    return given.unionByName(mine).repartition("grp").sortWithinPartitions("grp", F.col("idx").asc_nulls_first()).mapInArrow(_sum_task(), _RESULT)
