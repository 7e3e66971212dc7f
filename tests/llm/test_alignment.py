"""Tokenizer alignment against the two libraries on whole texts, pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm.alignment import Tokenizers, align, align_tokenizers
from offerlake.llm.tokens import vocabulary_path

PATHS = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
ODD = "ab c d  .,'s 12é漢字\n\t 　▁<|endoftext|><s></s><unk><0x41>😀ﬁ\x00\x1c\x85᠎"


def brute(rows):
    """By whole texts; rows are (doc_id, text)."""
    t = Tokenizers(*PATHS)
    whole = []
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            parts = [t.bytes_a[i] for i in a], [t.bytes_b[i] for i in b]
            if all(b"".join(p) == (" " + text).encode() for p in parts):
                ends = [[sum(map(len, p[: k + 1])) for k in range(len(p))] for p in parts]
                start = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([i for i, e in zip(ids, at, strict=True) if start < e <= end] for ids, at in zip((a, b), ends, strict=True)))
                    start = end
        whole.append((doc_id, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    count = Counter(pair for *_, links in whole for pair in links)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, groups, links in whole:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n_best = sum(n for (a, b), n in links.items() if count[a, b] == best[a])
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("args", [{}, {"slots": 3, "salts": 1}])
def test_equals_the_libraries_on_whole_texts(spark, args):
    rng = random.Random(3)
    words = ["the", "harbour", "naïve", "Straße", "x1", "don't", "漢字", "tokenizer", "…", "a_b"]
    rows = [(i, "".join(rng.choice(ODD) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    rows += [(200 + i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " "), (303, "end "), (304, "  two  spaces "), (305, "▁"), (None, "no id"), (306, "no id"), (306, "other text"), (306, "other text"), (307, "x" * 3000), (308, "the harbour " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("grp", F.lit("clash")).withColumn("slot", F.lit(None).cast("int")).repartition(5)
    got = align_tokenizers(docs, **args).collect()
    assert by_id(got) == by_id(brute(rows))


def test_a_text_that_a_vocabulary_changes_has_no_tokens(spark):
    rows = [(1, "a▁b plain words"), (2, "plain words")]
    got = {r.doc_id: r for r in align_tokenizers(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "") and got[2].n_groups > 0


def test_no_documents(spark):
    assert align_tokenizers(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert by_id(align_tokenizers(spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")).collect()) == by_id(brute([(1, None), (None, "")]))


def test_groups_end_where_both_sides_do():
    common, to_a, to_b = align(np.array([2, 3, 5]), np.array([3, 5]))
    assert common.tolist() == [3, 5] and to_a.tolist() == [2, 3] and to_b.tolist() == [1, 2]
