"""The Jaccard join against comparing all pairs of documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.llm.jaccard_join import TokenGroup, jaccard_components, long, needed, prefix, sets, short

SCHEMA = "doc_id bigint, text string"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    found = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if both and 100 * both >= 80 * len(found[i] | found[j]):
                label[top(i)] = top(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(doc_id)
    return [(doc_id, len(found[i]), min((x for x in ids[top(i)] if x is not None), default=None)) for i, (doc_id, _) in enumerate(rows)]


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


def family(rng, words, n, changes):
    """Texts with words changed, added and dropped, some of them within the similarity and some not."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, changes)):
            k = rng.randrange(len(w))
            what = rng.random()
            if what < 0.6:
                w[k] = f"new{rng.randrange(9999)}"
            elif what < 0.8:
                w.insert(k, "extra")
            elif len(w) > 1:
                del w[k]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("args", [{}, {"group_size": 2, "slots": 2}, {"group_size": 3, "stars": 0}])
def test_equals_all_pairs(spark, args):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    licence = " ".join(rng.choices(vocabulary, k=40))
    texts = []
    for size, n, changes in ((60, 40, 4), (60, 40, 2), (200, 20, 14), (12, 25, 1), (8, 10, 2), (30, 60, 2)):
        texts += family(rng, rng.choices(vocabulary, k=size), n, changes)
    texts += [licence + " " + " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 40]))) for _ in range(60)]
    texts += [" ".join(rng.choices(vocabulary[:4], k=rng.randint(1, 9))) for _ in range(60)]
    texts += [texts[3]] * 5 + [texts[3].upper(), "one two", "One  TWO", "one two three four five", "É x y z w", "é x y z w", "x" * 9000, " ".join(rng.choices(vocabulary, k=6000))]
    rows = list(enumerate(texts)) + [(None, texts[50]), (None, "nobody else has this text at all"), (7, texts[90]), (7, texts[91]), (7, texts[7]), (9001, None), (9002, ""), (9003, " \n\t "), (9004, ""), ((1 << 63) - 1, texts[60]), (-5, texts[61])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("component", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    got = jaccard_components(docs, **args).collect()
    assert by_value(got) == by_value(brute(rows))


def test_no_documents(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
    assert by_value(jaccard_components(spark.createDataFrame([(1, None), (None, "")], SCHEMA)).collect()) == [(1, 0, 1), (None, 0, None)]


def test_a_chain_through_many_groups_is_one_component(spark):
    """Each text is similar to the next, the first to the last not at all."""
    words = [f"c{i}" for i in range(900)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 100])) for i in range(130)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA), group_size=4).collect()
    assert {r.component_id for r in got} == {r[2] for r in brute(rows)} == {0}


def test_sets_and_groups():
    found = sets(pa.array(["a b c d e f a b c d e f", "A b", None, "a b c d"]))
    assert [len(x) for x in found] == [6, 1, 0, 1]
    low = [x >> np.uint64(16) for x in found]
    group = TokenGroup([short(low[0]), short(low[0][:5])], [6, 5])
    assert group.linked(short(low[0]), 6).tolist() == [0, 1] and group.linked(short(low[1]), 1).tolist() == []
    assert (long(short(low[0])) == low[0]).all()
    assert needed(5) == 4 and needed(6) == 5 and len(prefix(6, found[0], np.full(6, 2))) == 2
