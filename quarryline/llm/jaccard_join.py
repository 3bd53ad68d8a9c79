"""Operator 7, n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles, and two documents link
when ``100 * |A & B| >= percent * |A | B|``.  With all sets in one global
order, linked sets share a shingle within their first
``n - ceil(percent * n / 100) + 1`` ones (their prefix).

1.  ``_sketcher`` counts shingles in a table of 4 to 32 million slots, by the size of the corpus; its levels, rare
    before common, then by hash, are the global order.  Any order is right; this
    one keeps what many documents share out of the prefixes.  What all slots have in common is taken off first, so that
    shingles are told apart however full the table is.
2.  Documents of equal sets form a class; classes of equal prefix and size form
    a group, and only one copy of a group's prefix goes into the join.
3.  In the list of a prefix shingle, in order of its place in each prefix, each group is paired with
    the first and with the one before it, never all with all: the first has the fewest rarer
    shingles, so it is what edited copies were made from.  A shingle of a high level has its list cut into parts, each a task's
    own; the first of each part is paired with the first of all.  The members of a
    group are paired with the group's first member.  Pairs that pass the size, position and bitmap
    filters (all without loss) are verified on the whole sets, and the links make components.
4.  What can still add to the components is every pair of members of one list
    that lies in two components, passes the filters and is untested.  The components of a list are paired first,
    in blocks where a list has many and within bands of sizes that can link, by the best that their members could reach; only the members of pairs
    that are left are expanded.  They are verified without exception, so the components are those of all links.

The position filter: what two sets share, when their first common shingle stands at places i and j, is at most the
smaller of ``n - i`` and ``m - j``.  The bitmap filter: with one bit for every slot of a hash, flipped by each shingle, two sets differ
in at least as many shingles as their bitmaps differ in bits.

Nothing is capped: step 3 only spares the tests that cannot change a component.

Defined results: texts without words have no shingles and link with nothing
(component: their own id); texts of fewer words than a shingle have one, the
whole sequence; repeated rows are copies of each other; a null id is ignored
when the smallest id is taken, and a component of null ids only has a null id.
Rows out are rows in.  Other columns of the input are not read.  An id may be of any type that Spark orders, a struct as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import held, ids_bitmap, slot
from .graph import components
from .store import materialize, scratch
from .words import SHINGLE, hash_words, mix64, shingles, slices

_U = np.uint64
_SLICES = 64
_LIST_BLOCK = 256
_LIST_BITS = 20
_SKETCH_BITS, _MOST_SKETCH_BITS, _SLOT_BYTES = 22, 25, 256


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    w = hash_words(column)
    for d in range(len(w.bounds) - 1):
        yield np.unique(shingles(w.of(d), size))


def signature(hashes: np.ndarray, salt: int = 0) -> int:
    """A hash of a set of hashes, as a signed 64-bit number."""
    total = mix64(hashes ^ _U(0xA0761D6478BD642F + salt)).sum(dtype=np.uint64) + _U(len(hashes))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """A bit for each of 2 ** k slots, about two for each shingle, flipped by every shingle of the slot."""
    k = min(max(int(2 * len(hashes) - 1).bit_length(), 6), 16)
    return np.packbits(np.bincount((hashes & _U((1 << k) - 1)).astype(np.int64), minlength=1 << k) & 1, bitorder="little").tobytes()


def bitmap_distance(a: bytes, b: bytes) -> int:
    """Differing bits; the larger bitmap is folded to the smaller one's size."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) if len(z) > n else z for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _sketcher(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for b in batches:
            for part in slices(b, 0):
                got = [x >> _U(64 - bits) for x in shingle_sets(part.column(0), size)]
                slot, n = np.unique(np.concatenate(got), return_counts=True)
                slot = slot.astype(np.int64)
                counts[slot] = np.minimum(counts[slot] + n, 65535)  # far above what any level tells apart in a task
        parts = [_pack(x.astype(np.uint32)) for x in np.split(counts, _SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    return run


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(1, np.uint64)
    for x in table.column("counts"):
        total = total + _unpack(x.as_py())
    total = np.minimum(total, _U((1 << 32) - 1)).astype(np.uint32)
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([_pack(total)], pa.binary())})


def frequency_levels(docs: DataFrame, text_column: str, size: int, bits: int) -> np.ndarray:
    """For every slot of the sketch a level that grows with its count of documents (2 ** bits bytes)."""
    parts = docs.select(text_column).mapInArrow(_sketcher(size, bits), "slice int, counts binary")
    salted = parts.withColumn("salt", F.spark_partition_id() % 64)
    once = salted.groupBy("slice", "salt").applyInArrow(lambda t: _add(t.select(["slice", "counts"])), "slice int, counts binary")
    rows = once.groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect()
    counts = np.zeros((_SLICES, (1 << bits) // _SLICES), np.int64)
    for r in rows:
        counts[r["slice"]] = _unpack(bytes(r["counts"]))
    return np.minimum(255, np.log2(counts.reshape(-1) - counts.min() + 1) * 8).astype(np.uint8)


def _describe(size: int, percent: int, levels, bits: int, list_bits: int):
    """(id, n, class, group, bitmap, prefix, depth) of each text; a prefix shingle's list is cut into 2 ** depth parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for b in batches:
            for part in slices(b, 1):
                n, sig, grp, bitmap, prefix, depth = [], [], [], [], [], []
                for u in shingle_sets(part.column(1), size):
                    n.append(len(u))
                    sig.append(signature(u))
                    bitmap.append(parity_bitmap(u))
                    high = level[(u >> _U(64 - bits)).astype(np.int64)]
                    at = np.argsort(high, kind="stable")[: prefix_length(len(u), percent)] if len(u) else np.zeros(0, np.int64)
                    first = u[at]
                    prefix.append(first >> _U(24))
                    depth.append(np.maximum((high[at].astype(np.int32) + 7) // 8 - list_bits, 0))
                    grp.append(signature(first, len(u) + 1))
                ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate([*prefix, np.zeros(0, np.uint64)]).astype(np.int64))
                depths = pa.ListArray.from_arrays(ends, np.concatenate([*depth, np.zeros(0, np.int32)]).astype(np.int8))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(grp, pa.int64()), pa.array(bitmap, pa.binary()), lists, depths],
                    names=["id", "n", "cls", "grp", "bitmap", "prefix", "depth"],
                )

    return run


def _resign(size: int, wanted):
    """(class, text) of the texts whose slot is wanted, one of a class in each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(held(wanted.value, b.column(0).to_numpy()))).select([1])
            for part in slices(b, 0):
                sig = np.array([signature(u) for u in shingle_sets(part.column(0), size)], np.int64)
                at = np.unique(sig, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(sig[at]), part.column(0).take(pa.array(at))], names=["cls", "text"])

    return run


def _verify(size: int, percent: int):
    """Keeps the pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2, 3):
                keep = []
                for x, y in zip(shingle_sets(part.column(2), size), shingle_sets(part.column(3), size), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep))

    return run


def _may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """The size and position filters, for sets of n and m shingles that share one at places i and j."""
    return (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)


def _bitmap_filter(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(c).to_pylist() for c in ("n_a", "n_b", "bitmap_a", "bitmap_b"))
            keep = [(100 + percent) * (p + q - bitmap_distance(v, w)) >= 2 * percent * (p + q) for p, q, v, w in zip(n, m, x, y, strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by the whole texts of one document of each class."""
    marks = classes.select("cls", "n", "bitmap")
    both = pairs.join(marks.select(*(F.col(c).alias(d) for c, d in zip(marks.columns, ("a", "n_a", "bitmap_a"), strict=True))), "a")
    both = both.join(marks.select(*(F.col(c).alias(d) for c, d in zip(marks.columns, ("b", "n_b", "bitmap_b"), strict=True))), "b")
    both = both.select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(_bitmap_filter(percent), "a long, b long")
    pairs = materialize(both, "likely-pairs")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    named = wanted.join(classes.select("cls", "id"), "cls")
    # most documents are in no pair: a bitmap of fixed size drops them before the shuffle, and the joins are exact
    bitmap = ids_bitmap(named.select("id"))
    texts = docs.select(slot("id").alias("slot"), "text").mapInArrow(_resign(size, bitmap), "cls long, text string").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    texts = materialize(texts, "pair-texts")
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_verify(size, percent), "a long, b long"), "links")


def _band(n: Column, percent: int) -> Column:
    """A set's band of sizes; sets that link are of one band or of neighbouring ones."""
    return n if percent == 100 else F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9)


def _root_pairs(left: DataFrame, percent: int) -> DataFrame:
    """(key, root, band, root_b, band_b, reach_b, least_b): the components of each list by bands of sizes, every pair once whose members could pass the filters.

    A component's reach is the most
    that any of its members of a band can share after its place in the list, and ``least`` the smallest of them.

    A band of many components is dealt into blocks; each pair of blocks, of one band or of it and the next, is a key of its own.
    """
    sides = left.groupBy("key", "band", "root").agg(F.max(F.col("n") - F.col("pos")).alias("reach"), F.min("n").alias("least"))
    counts = sides.groupBy("key", "band").agg(F.ceil(F.count("*") / _LIST_BLOCK).cast("int").alias("blocks"))
    near = Window.partitionBy("key").orderBy("band")  # one row a band
    beside = lambda at, step: F.coalesce(F.when(at("band").over(near) == F.col("band") + step, at("blocks").over(near)), F.lit(0))
    blocks = counts.select("key", "band", "blocks", beside(F.lag, -1).alias("below"), beside(F.lead, 1).alias("above"))
    dealt = sides.join(blocks, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("root"), F.col("blocks")).cast("int"))
    me, other = ["key", "root", "reach", "least"], ["key", F.col("root").alias("root_b"), F.col("reach").alias("reach_b"), F.col("least").alias("least_b")]
    step = lambda n: F.lit(n).alias("step")
    first = dealt.select(*me, "band", step(0), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j")).unionByName(
        dealt.where("above > 0").select(*me, "band", step(1), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("above") - 1)).alias("j"))
    )
    second = dealt.select(*other, "band", step(0), F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j")).unionByName(
        dealt.where("below > 0").select(*other, (F.col("band") - 1).alias("band"), step(1), F.explode(F.sequence(F.lit(0), F.col("below") - 1)).alias("i"), F.col("block").alias("j"))
    )
    could = (100 + percent) * F.least("reach", "reach_b") >= percent * (F.col("least") + F.col("least_b"))
    once = F.when(F.col("step") == 1, F.col("root") != F.col("root_b")).otherwise((F.col("i") < F.col("j")) | (F.col("root") < F.col("root_b")))
    met = first.join(second, ["key", "band", "step", "i", "j"]).where(once & could)
    return met.select("key", "root", "band", "root_b", (F.col("band") + F.col("step")).alias("band_b"), "reach_b", "least_b")


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, percent: int = 75, sketch_bits: int | None = None, list_bits: int = _LIST_BITS
) -> DataFrame:
    """Rows (id, n_shingles, component_id) for every row of ``docs``; see the module's text.

    The list of a shingle in more than some 2 ** ``list_bits`` documents is cut into parts of about that size.
    The result is a table of the shared folder; what was written on the way to it is deleted.
    """
    with scratch(docs.sparkSession):
        found = _near_duplicates(docs, id_column, text_column, size, percent, sketch_bits, list_bits)
        return materialize(found, "near-duplicates", outlives=True)


def _near_duplicates(docs: DataFrame, id_column: str, text_column: str, size: int, percent: int, sketch_bits: int | None, list_bits: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    if sketch_bits is None:
        bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sketch_bits = min(max(math.ceil(math.log2(max(bytes_, 1) / _SLOT_BYTES)), _SKETCH_BITS), _MOST_SKETCH_BITS)
    levels = spark.sparkContext.broadcast(frequency_levels(docs, "text", size, sketch_bits))
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n", "cls", "grp")] + [T.StructField("bitmap", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("depth", T.ArrayType(T.ByteType()))])
    described = materialize(docs.mapInArrow(_describe(size, percent, levels, sketch_bits, list_bits), schema), "described")
    some = described.where("n > 0")
    classes = materialize(some.groupBy("cls").agg(F.min("id").alias("id"), F.min("grp").alias("grp"), F.min("n").alias("n"), F.min("bitmap").alias("bitmap")), "classes")
    # written, so that the joins below read plain tables and Spark can split their skewed keys
    groups = materialize(classes.groupBy("grp").agg(F.min("cls").alias("first")), "groups")

    entries = some.select("grp", "n", "prefix", "depth").dropDuplicates(["grp"]).select("n", "grp", F.posexplode(F.arrays_zip("prefix", "depth")).alias("pos", "x"))
    part = F.pmod(F.xxhash64("grp"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.depth").cast("int")))
    entries = entries.select("n", "grp", "pos", F.col("x.prefix").alias("key"), (F.col("x.depth") > 0).alias("cut"), part.alias("part"))
    order = Window.partitionBy("key", "part").orderBy("pos", "n", "grp")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    me = F.struct("n", "grp", "pos")
    lists = entries.select("key", "n", "grp", "pos", "cut", F.lag(me).over(order).alias("before"), F.lead("grp").over(order).alias("after"), F.first(me).over(whole).alias("hub"))
    lists = materialize(lists.where("before is not null or after is not null or cut"), "lists").drop("after")

    # filter the group pairs, then stand for each group by its first member
    first = F.first("hub").over(Window.partitionBy("key").orderBy("pos", "n", "grp").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one row a part
    firsts = lists.where("before is null and cut").withColumn("with", first).where("with.grp != grp").select("n", "grp", "pos", "with")
    hubs = lists.where("before is not null").select("n", "grp", "pos", F.explode(F.array("hub", "before")).alias("with")).unionByName(firsts)
    group_pairs = hubs.where(_may_link(F.col("n"), F.col("pos"), F.col("with.n"), F.col("with.pos"), percent)).select("grp", F.col("with.grp").alias("with")).distinct()
    starred = (
        group_pairs.join(groups, "grp")
        .select("with", F.col("first").alias("a"))
        .join(groups.withColumnRenamed("grp", "with"), "with")
        .select("a", F.col("first").alias("b"))
        .unionByName(classes.join(groups, "grp").where("cls != first").select(F.col("first").alias("a"), F.col("cls").alias("b")))
    )
    starred = materialize(starred.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verified(docs, starred, classes, size, percent)
    joined = components(links)

    # expand what is left: members of one list, in two components, untested
    members = classes.join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("grp", "cls", F.coalesce("root", "cls").alias("root"), "n")
    # an entry that no partner can match, even one that shares all the rest, is closed
    reach = lists.where((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    listed = reach.select("key", "grp", "pos").join(members, "grp")
    open_lists = listed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    alone = members.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("grp")
    # a group of one list is its own list as well: its members share their whole prefix
    left = listed.join(open_lists, "key").select("key", "cls", "root", "n", "pos").unionByName(
        members.join(alone, "grp").select(F.col("grp").alias("key"), "cls", "root", "n", F.lit(0).alias("pos"))
    )
    left = materialize(left.withColumn("band", _band(F.col("n"), percent)), "open-lists")
    other = left.select("key", *(F.col(c).alias(f"{c}_b") for c in ("cls", "root", "n", "pos", "band")))
    may_link = _may_link(F.col("n"), F.col("pos"), F.col("n_b"), F.col("pos_b"), percent)
    pairs = materialize(_root_pairs(left, percent), "open-roots")
    # a member goes on only if it could pass with the best of the other component
    able = (100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("reach_b")) >= percent * (F.col("n") + F.col("least_b"))
    rest = pairs.join(left, ["key", "root", "band"]).where(able).join(other, ["key", "root_b", "band_b"]).where(may_link)
    rest = rest.select(F.least("cls", "cls_b").alias("a"), F.greatest("cls", "cls_b").alias("b")).distinct().join(starred, ["a", "b"], "left_anti")
    rest = materialize(rest, "open-pairs")
    if not rest.isEmpty():
        more = verified(docs, rest, classes, size, percent)
        if not more.isEmpty():
            joined = components(links.unionByName(more))

    named = classes.select("cls", "id").join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "id")
    lowest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = named.join(lowest, "root").select("cls", "component_id")
    out = some.select("id", "n", "cls").join(of_class, "cls").select("id", "n", "component_id")
    out = out.unionByName(described.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")
