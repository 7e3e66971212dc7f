"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CELLS = 24  # of a fingerprint; three tables of a third each
ROUNDS = 40
#: A paragraph is a line; of longer lines, every 24 words.
PARAGRAPH = r"\S++(?:[^\S\n]++\S++){0,23}+"
NO_ID = (1 << 63) - 1
_ENTRIES = "array<struct<cell:int,n:int,key:bigint,chk:bigint>>"
_KEYS = "array<struct<key:bigint,n:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(99)).bitwiseAND(F.lit(0xFFFFFFFF))


def _entries(key: Column, n: Column, cells: Column) -> Column:
    """What a digest adds to its cells, one in each third."""
    third = (cells / 3).cast("int")
    where = [(F.pmod(F.xxhash64(key, F.lit(j)), third) + third * j).cast("int") for j in range(3)]
    return F.array(*[F.struct(w.alias("cell"), n.alias("n"), key.alias("key"), _check(key).alias("chk")) for w in where])


def _gather(entries: Column) -> Column:
    """One entry a cell: counts added, keys and checks combined by exclusive or; empty cells left out."""

    def cells(ordered: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["cell"] != F.get(ordered, i - 1)["cell"]))
        return let(heads, lambda h: F.transform(h, lambda a, i: total(F.slice(ordered, a + 1, F.coalesce(F.get(h, i + 1), F.size(ordered)) - a))))

    def total(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("chk"))
        return F.aggregate(part, zero, lambda a, x: F.struct(x["cell"].alias("cell"), (a["n"] + x["n"]).alias("n"), a["key"].bitwiseXOR(x["key"]).alias("key"), a["chk"].bitwiseXOR(x["chk"]).alias("chk")))

    some = let(F.sort_array(entries), cells)
    return F.when(F.size(entries) == 0, F.array().cast(_ENTRIES)).otherwise(F.filter(some, lambda c: (c["n"] != 0) | (c["key"] != 0) | (c["chk"] != 0)))


def sketch(keys: Column, cells: Column) -> Column:
    """The sketch of an array of digests, as its non-empty cells in order."""
    return _gather(F.flatten(F.transform(keys, lambda k: _entries(k, F.lit(1), cells))))


def subtract(a: Column, b: Column) -> Column:
    """What both share cancels: the sketch of the difference, with -1 for what only ``b`` has."""
    minus = F.transform(b, lambda c: F.struct(c["cell"].alias("cell"), (-c["n"]).alias("n"), c["key"].alias("key"), c["chk"].alias("chk")))
    return _gather(F.concat(a, minus))


def signed_sketch(a: Column, b: Column, cells: Column) -> Column:
    """``subtract`` of the sketches of two arrays of digests, gathered in one go."""
    plus, minus = (F.flatten(F.transform(x, lambda k: _entries(k, F.lit(1), cells))) for x in (a, b))
    return _gather(F.concat(plus, F.transform(minus, lambda e: F.struct(e["cell"].alias("cell"), (-e["n"]).alias("n"), e["key"].alias("key"), e["chk"].alias("chk")))))


def peel(difference: Column, cells: Column) -> Column:
    """Struct of found (key, n) and whether everything was recovered.

    A cell of one digest shows it; taking the digest out of its other cells leaves new such cells.
    """
    zero = F.struct(difference.alias("cells"), F.array().cast(_KEYS).alias("found"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
        shown = F.array_distinct(F.transform(pure, lambda c: F.struct(c["key"].alias("key"), c["n"].alias("n"))))

        def take(keys: Column) -> Column:
            gone = F.flatten(F.transform(keys, lambda k: _entries(k["key"], -k["n"], cells)))
            return F.struct(F.when(F.size(keys) == 0, s["cells"]).otherwise(_gather(F.concat(s["cells"], gone))).alias("cells"), F.concat(s["found"], keys).alias("found"), (F.size(keys) == 0).alias("done"))

        return F.when(s["done"], s).otherwise(let(shown, take))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step, lambda s: F.struct(s["found"].alias("found"), (F.size(s["cells"]) == 0).alias("complete")))


def differences(rows: DataFrame, name: str, a: str, b: str, sketch_a: str, sketch_b: str, cells: int = CELLS) -> DataFrame:
    """Adds ``name``: how many digests differ between columns ``a`` and ``b``.

    They are peeled from the two sketches, and where that fails from ones twice as large as both together, then
    four times; failing those, taken from the digests themselves. Each try is a column of its own, as the
    analyzer goes no deeper into nested functions.
    """
    rows = rows.withColumn(name, peel(subtract(F.col(sketch_a), F.col(sketch_b)), F.lit(cells)))
    for times in (2, 4):
        size = F.col(f"{name}_cells")
        rows = rows.withColumn(f"{name}_cells", ((F.size(a) + F.size(b)) * times + 3).cast("int"))
        again = peel(signed_sketch(F.col(a), F.col(b), size), size)
        rows = rows.withColumn(name, F.when(F.col(name)["complete"], F.col(name)).otherwise(again))
    exact = F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))
    return rows.withColumn(name, F.when(F.col(name)["complete"], F.size(F.col(name)["found"])).otherwise(exact))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    """The share of two digest sets that is not in their difference; 1 if both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(1 - differ / F.greatest(both, F.lit(1)))


def as_text(keys: Column, cells: Column) -> Column:
    """The number of digests, and of each non-empty cell its number, count, key and check in 16 bytes, in base 64."""
    low = lambda x, n: F.substring(F.lpad(F.hex(x), 16, "0"), 17 - n, n)
    packed = F.transform(cells, lambda c: F.concat(low(c["cell"].cast("bigint"), 4), low(c["n"].cast("bigint"), 4), low(c["key"], 16), low(c["chk"], 8)))
    return F.concat(F.size(keys).cast("string"), F.lit(":"), F.regexp_replace(F.base64(F.unhex(F.array_join(packed, ""))), r"\s", ""))


def next_documents(ids: DataFrame) -> DataFrame:
    """(id, next_id) over the distinct ids, ascending, the last one's next being the first.

    Ids are dealt by range; within a range the next one is at hand, and the ranges' first ids, as many as there are
    partitions, link one range to the next.
    """
    ranged = cut(ids.select("id").distinct().repartitionByRange("id").withColumn("range", F.spark_partition_id()))
    firsts = ranged.groupBy("range").agg(F.min("id").alias("first"))
    along = Window.orderBy("range")
    all_ = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(along), F.min("first").over(all_)).alias("after"))
    # one row a partition of the shuffle
    return ranged.join(F.broadcast(firsts), "range").select("id", F.coalesce(F.lead("id").over(Window.partitionBy("range").orderBy("id")), "after").alias("next_id"))


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs`` (doc_id, text) and of an edited version of it.

    The edited text is the text with its last quarter of code points (rounded down) replaced by the first as
    many, or all, of the next document's by doc_id (after the last one, the first). A fingerprint is the invertible
    Bloom lookup sketch of the text's paragraph digests: sketches subtract, and peeling the difference recovers
    the digests that differ, from larger sketches where the fingerprint's cells are too few.

    Only the head of a text that its predecessor needs, and its digests, cross to the predecessor. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness 0 to 1),
    and differ_edited, differ_next (digests). A null text is empty; a null doc_id counts as the largest. Rows
    that repeat a doc_id each get their row; the next document's text is then its least.
    """
    # both joins take the same columns, so that the texts cross one shuffle that both read
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = cut(rows.groupBy("id").agg(F.max(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")))
    before = next_documents(sizes).join(sizes, "id").select(F.col("id").alias("previous"), F.col("next_id").alias("id"), F.floor(F.col("n") / 4).cast("int").alias("need"))
    heads = rows.join(before, "id").select(F.col("previous").alias("id"), F.expr("substring(text, 1, need)").alias("head"), digests(F.col("text")).alias("next_keys"))
    if not sizes.filter("rows > 1").isEmpty():
        heads = heads.groupBy("id").agg(F.min(F.struct("head", "next_keys")).alias("least")).select("id", "least.*")
    n = F.length("text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    both = rows.join(heads, "id").withColumn("n_chars", n.cast("bigint"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("head"), F.lit(1), quarter)))
    both = both.withColumn("keys", digests(F.col("text"))).withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_sha256", F.sha2("edited", 256)).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", "keys", "edited_keys", "next_keys")
    size = F.lit(CELLS)
    both = both.withColumns({"own": sketch(F.col("keys"), size), "changed": sketch(F.col("edited_keys"), size), "after": sketch(F.col("next_keys"), size)})
    both = differences(both, "differ_edited", "keys", "edited_keys", "own", "changed")
    both = differences(both, "differ_next", "keys", "next_keys", "own", "after")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("keys"), F.col("own")).alias("fingerprint"),
        as_text(F.col("edited_keys"), F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("differ_edited")).alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("differ_next")).alias("near_next"),
        "differ_edited",
        "differ_next",
    )
