"""MinHash near-dedup with circulant permutations, exact verification and connected components.

1. One pass over the texts hashes their shingles and makes the signatures: one permutation scatters the shingles, a
   second one, shifted by one place for each coordinate, gives all coordinates. Rows of coordinates become band keys.
2. Texts with equal shingle sets form one class; only the class's smallest document goes on.
3. Documents that share a band key form a bucket. Those in any bucket have their shingle sets stored, once.
4. Each document is compared with the smallest one of each of its buckets. A link needs the full sets to overlap.
5. A bucket whose members are all in one component is done, however large. In one with at most _LEADERS members outside
   its largest component each of those is compared with the members of other components.
6. The members of all other buckets are dealt anew, by the rarest of their shingles: linked sets have one in common among
   as many of each as may be missing from the other. Copies that changed in different places share none of those.
7. Step 5 goes on with the new buckets, but for pairs that share too late what they share. Where more than _MOST would
   be compared with all, that many are, then four times as many, and so on, as each turn joins components.

So no pair that shares a key and could join two components goes unchecked, and a group of copies costs its members, not
their pairs. Groups with many rows are dealt over tasks. Between steps tables are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.store import stored
from leafmill.llm.words import find_words, mix, slices, whole, windows

_BASE = 0x9E3779B97F4A7C15
#: Members of a bucket that are compared with all its others in the first turn.
_LEADERS = 4
#: The same for buckets of rare shingles.
_MOST = 256
#: Rows of one key that a task takes.
_PART = 256


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, sorted: n consecutive words, or all words of a text that has fewer."""
    words = find_words(texts, lower=True)
    h, counts = words.hashes(), words.counts()
    at = np.flatnonzero(whole(words.first, n))
    owner, values = [words.texts()[at]], [mix(windows(h, n, _BASE)[at])]
    for size in range(1, n):
        short = np.flatnonzero(counts == size)
        value = np.full(len(short), size, np.uint64)
        for j in range(size):
            value = mix(value * np.uint64(_BASE) + h[words.first[short] + j])
        owner.append(short)
        values.append(value)
    owner, values = np.concatenate(owner), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def circulant(values: np.ndarray, starts: np.ndarray, coordinates: int) -> np.ndarray:
    """Least values, by coordinate, of the sets that begin at starts (none empty). Places are 32 bits wide.

    The first permutation is the upper half of a bijective mix; the second one, a bijective mix of 32 bits, is shifted
    by one place from coordinate to coordinate.
    """
    place = (mix(values + np.uint64(_BASE)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((coordinates, len(starts)), np.uint32)
    x, t = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.add(place, np.uint32(k), out=x)
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
            np.right_shift(x, np.uint32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=t)
        np.bitwise_xor(x, t, out=x)
        out[k] = np.minimum.reduceat(x, starts)
    return out


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, low, high, bands): low and high identify the set; bands is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                owner, values = shingle_sets(batch.column(1).slice(a, b - a), n)
                sizes = np.bincount(owner, minlength=b - a)
                full = np.flatnonzero(sizes)
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
                low, high, keys = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros((b - a, bands), np.uint64)
                if len(full):
                    low[full] = np.add.reduceat(mix(values), starts).view(np.int64)
                    high[full] = np.add.reduceat(mix(values ^ np.uint64(_BASE)), starts).view(np.int64)
                    least = circulant(values, starts, bands * rows).astype(np.uint64)
                    for band in range(bands):
                        h = np.full(len(full), band + 1, np.uint64)
                        for row in range(rows):
                            h = mix(h * np.uint64(_BASE) + least[band * rows + row])
                        keys[full, band] = h
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(keys.view(np.int64).ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(low), pa.array(high), lists], names=["id", "n_shingles", "low", "high", "bands"])

    longs = [T.StructField(c, T.LongType()) for c in ("n_shingles", "low", "high")]
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField("id", docs.schema[key].dataType), *longs, T.StructField("bands", T.ArrayType(T.LongType()))]))


def shingle_table(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(id, set): the hashes of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                owner, values = shingle_sets(batch.column(1).slice(a, b - a), n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))])
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["id", "set"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("set", T.ArrayType(T.LongType(), False))])
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def parts(members: Column) -> Column:
    """Tasks that share a group: a power of two, so that no task has many more than _PART of its members."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(members / _PART, F.lit(1.0))))).cast("int")


def _dealt(node: Column, parts_: Column) -> Column:
    return F.pmod(F.xxhash64(node), parts_).cast("int")


def joined(many: DataFrame, one: DataFrame, key: str, spread: str, total: int, members: str | None = None) -> DataFrame:
    """many, each row with its row of one; keys with many rows are dealt over several tasks by a hash of spread.

    one has a row for each key; members, if given, is its column that counts the rows of many. Of total rows at most
    100,000 keys can have more than the 100,000th part of them: that bounds the list of large keys, which is broadcast.
    The largest key is listed in any case, so the plan is the same whether or not a key is large.
    """
    at_least = max(_PART, -(-total // 100_000))
    counts = one.select(key, F.col(members).alias("_n")) if members else many.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max_by(F.struct(F.col(key).alias("key"), "_n"), "_n").alias("_m")).filter(F.col("_m._n") <= at_least)
    large = counts.filter(F.col("_n") > at_least).unionByName(most.select(F.col("_m.key").alias(key), F.col("_m._n").alias("_n")))
    large = F.broadcast(large.select(key, parts(F.col("_n")).alias("_parts")))
    copies = one.join(large, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    placed = many.join(large, key, "left").withColumn("_part", _dealt(F.col(spread), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    return placed.join(copies, [key, "_part"]).drop("_part")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, members) with linked: whether 100 * intersection >= percent * union of their sets.

    The pairs of one a, which may be many, are dealt over as many tasks as members asks for; each gets a's set once.
    """
    dealt = pairs.withColumn("parts", parts(F.col("members"))).withColumn("part", _dealt(F.col("b"), F.col("parts")))
    first = dealt.select("a", "parts", "part").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = dealt.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(first, ["a", "parts", "part"])
    common = F.size(F.array_intersect("set_a", "set_b")).alias("common")
    sized = both.select("a", "b", common, (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return sized.select("a", "b", ((100 + percent) * F.col("common").cast("long") >= percent * F.col("sizes")).alias("linked"))


def components(edges: DataFrame, total: int) -> DataFrame:
    """(node, label) for the ends of at most total edges (u, v): the smallest node that can be reached.

    Labels go to neighbours, and labels that turn out to lead further are replaced, until none changes.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        near = joined(both, labels.withColumnRenamed("node", "v"), "v", "u", 2 * total, members="degree").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node").filter("near < label").groupBy("label").agg(F.min("near").alias("near"))
        nearer = stored(nearer.select(F.col("label").alias("node"), F.col("near").alias("label")), "moved")
        if nearer.isEmpty():
            return labels.select("node", "label")
        moved = _followed(nearer).select(F.col("node").alias("label"), F.col("label").alias("to"))
        labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"), "degree"), "labels")


def _followed(moved: DataFrame) -> DataFrame:
    """(node, label) with the label of each label in place of it, where there is one."""
    further = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return moved.join(further, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def rarest(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, id, size, place): the rarest shingles of each of docs (id, size), as keys that linked ones share.

    Of a set of m shingles at most m - percent * m / 100 may be missing from a linked one; in the order of the shingles'
    counts in all of docs, then of their hashes, one of the first that are more than that is among the other's first too.
    """
    total = docs.agg(F.sum("size")).first()[0] or 0
    all_ = sets.join(docs, "id").select("id", "size", F.explode("set").alias("band"))
    counts = all_.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "band"))
    first = joined(all_, counts, "band", "id", total, members="n").withColumn("place", place)
    return first.filter((F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(percent) / 100) + 1) & (F.col("n") > 1)).select("band", "id", "size", "place")


def _merged(labels: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """labels after more links (a, b) between documents that may have none yet."""
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("label").alias(name))
    ends = links.join(of("a", "u"), "a", "left").join(of("b", "v"), "b", "left").select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
    moved = components(ends.distinct(), total).select(F.col("node").alias("label"), F.col("label").alias("to"))
    fresh = moved.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
    return stored(labels.unionByName(fresh).join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of docs.

    Documents are linked if their sets of n-word shingles overlap by percent or more; component_id is the smallest key
    that links reach, and only the row with that key is kept. A-Z count as lower case, words are runs of anything but
    ASCII white space, and a text of fewer than n words is one shingle. Texts without words and rows without a key are
    linked with nothing and kept. Rows that repeat a key count as linked, and are all kept if it is the smallest.
    A pair at the threshold shares no key, and so goes unseen, with a chance of (1 - 0.8**rows)**bands: 1 in 8 million.
    An empty table gives an empty one; other columns of docs are not read, whatever their names.
    """
    found = stored(signatures(docs, key, text, n, bands, rows), "signatures")
    total = bands * found.count()
    full = found.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = stored(full.groupBy("low", "high", "n_shingles").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "classes")
    keys = classes.select(F.col("rep").alias("id"), F.col("n_shingles").alias("size"), F.explode("bands").alias("band"))
    shared = stored(keys.groupBy("band").agg(F.min(F.struct("id", "size")).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1"), "shared")
    leaders = shared.select("band", F.col("first.id").alias("leader"), F.col("first.size").alias("leader_size"), "members")
    buckets = stored(joined(keys, leaders, "band", "id", total, members="members"), "buckets")
    wanted = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(buckets.select("id").distinct(), "id", "left_semi")
    sets = stored(shingle_table(wanted.distinct(), "id", "text", n), "sets")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    nearest = buckets.filter((F.col("leader") < F.col("id")) & fits(F.col("size"), F.col("leader_size")))
    nearest = nearest.groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.max("members").alias("members"))
    links = stored(confirm(stored(nearest, "pairs"), sets, percent), "links")
    labels = components(links.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), total)

    open_, known, turn = buckets.select("band", "id", "size", F.lit(1).alias("place")), stored(links.select("a", "b"), "tested"), 0
    while True:
        most = _MOST << 2 * (turn - 1) if turn else _LEADERS
        placed = open_.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        groups = placed.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max(F.struct("n", "label")).alias("largest"), F.sum("n").alias("members"))
        mixed = groups.select("band", "members", F.col("largest.label").alias("largest"), (F.col("members") - F.col("largest.n")).alias("others")).filter("others > 0")
        placed = stored(joined(placed, mixed, "band", "id", total, members="members"), "open")
        some = F.pmod(F.xxhash64("id"), F.col("others")) < most if turn else F.col("others") <= most
        leads = placed.filter((F.col("label") != F.col("largest")) & some)
        part = F.explode(F.sequence(F.lit(0), parts(F.col("members")) - 1)).alias("part")
        leads = leads.select("band", F.col("id").alias("lead"), F.col("size").alias("lead_size"), F.col("place").alias("lead_place"), F.col("label").alias("lead_label"), part)
        met = placed.withColumn("part", _dealt(F.col("id"), parts(F.col("members")))).join(leads, ["band", "part"])
        rest = F.least(F.col("size") - F.col("place"), F.col("lead_size") - F.col("lead_place")) + 1  # most that can be common from here on
        met = met.filter((F.col("label") != F.col("lead_label")) & ((100 + percent) * rest >= percent * (F.col("size") + F.col("lead_size"))))
        met = met.groupBy(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).agg(F.max("lead").alias("lead"), F.max("members").alias("members"))
        pairs = stored(met.join(known, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            known = stored(known.unionByName(pairs.select("a", "b")), "tested")
            other = F.when(F.col("a") == F.col("lead"), F.col("b")).otherwise(F.col("a"))
            more = stored(confirm(pairs.select(F.col("lead").alias("a"), other.alias("b"), "members"), sets, percent), "links").filter("linked")
            if not more.isEmpty():
                labels = _merged(labels, more, total)
        open_ = placed.filter(F.col("others") > most).select("band", "id", "size", "place")
        if open_.isEmpty():
            break
        if not turn:
            open_ = stored(rarest(open_.select("id", "size").distinct(), sets, percent), "open")
        turn += 1

    owner = classes.select("low", "high", F.col("n_shingles"), "copies", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    owner = owner.select(F.struct("low", "high", "n_shingles").alias("class"), "copies", F.coalesce("label", "rep").alias("component_id"))
    own = found.filter(F.col("id").isNotNull() & (F.col("n_shingles") > 0)).select("id", F.struct("low", "high", "n_shingles").alias("class"))
    linked = joined(own, owner, "class", "id", total, members="copies").select("id", F.col("class.n_shingles").alias("n_shingles"), "component_id")
    alone = found.filter(F.col("id").isNull() | (F.col("n_shingles") == 0)).select("id", "n_shingles", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))
