"""Near-duplicate documents: min-max hashing of word shingles, banded, with links confirmed on the full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillwell.llm.linkage import bucket_links
from stillwell.llm.shared import hot_join, passing, staged
from stillwell.llm.shingles import mixed, shingle_set

#: A band is the minima and maxima of two permutations: four values of which each agrees with chance J. At a
#: similarity of 0.75, 32 bands miss a pair with a chance of (1 - 0.75**4) ** 32, five in a million.
BANDS = 32
PERMUTATIONS = 2 * BANDS
SIMILARITY = 75

_RANDOM = np.random.default_rng(20_011)
XOR = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
TIMES = _RANDOM.integers(0, 1 << 32, (2, PERMUTATIONS), dtype=np.uint32) | np.uint32(1)

#: Pairs are compared in full only where four bits of the 128 minima and maxima agree in at least ALIKE places. At a
#: similarity of 0.75 a place agrees with chance 0.7656: fewer than 74 of 128 agree in about one pair in a million.
ALIKE = 74

#: Bits of the map of a set's shingles; sets far larger than this fill their maps, and the sketches alone tell them apart.
MAP_BITS = 1024
COARSE_BITS = 256

SKETCH = "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch array<long>"
BLOCK = 2048


def permuted(values: np.ndarray) -> np.ndarray:
    """Each 32-bit value under every permutation, one column each."""
    out = (values[:, None] ^ XOR) * TIMES[0]
    out ^= out >> np.uint32(15)
    out *= TIMES[1]
    out ^= out >> np.uint32(16)
    return out


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimum and the maximum of a set under each permutation, from one evaluation of it."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32), np.zeros(PERMUTATIONS, dtype=np.uint32)
    for at in range(0, len(values), BLOCK):
        out = permuted(values[at:at + BLOCK])
        np.minimum(low, out.min(axis=0), out=low)
        np.maximum(high, out.max(axis=0), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; keys of different bands do not meet."""
    low, high = low.astype(np.uint64), high.astype(np.uint64)
    lows = low[0::2] << np.uint64(32) | low[1::2]
    highs = high[0::2] << np.uint64(32) | high[1::2]
    band = np.arange(BANDS, dtype=np.uint64)
    return mixed(mixed(lows + band * np.uint64(0x9E3779B97F4A7C15)) ^ highs).view(np.int64)


def bit_planes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Four bits of every minimum and maximum: two signed 64-bit words for each of the four places."""
    values = np.concatenate([low, high])
    planes = values[None, :] >> np.arange(4, dtype=np.uint32)[:, None] & np.uint32(1)
    return np.packbits(planes.astype(np.uint8), axis=1).view(np.int64).ravel()


def alike(one: Column, two: Column) -> Column:
    """Whether at least ALIKE values of both sketches agree in all four bits."""
    # as a function of one value: written out, it makes the code of a join too long for the JVM to compile
    apart = F.zip_with(one, two, Column.bitwiseXOR)
    count = F.transform(F.array(apart), lambda x: reduce(Column.__add__, [F.bit_count(reduce(Column.bitwiseOR, [x[2 * place + word] for place in range(4)])) for word in range(2)]))
    return count[0] <= 2 * PERMUTATIONS - ALIKE


def can_reach(one: Column, two: Column, similarity: int) -> Column:
    """Whether two sets of ``size`` shingles, of which ``common`` lie in any other set, may reach the similarity.

    Exact: a pair shares at most the smaller ``common``. A pair with an unknown count may.
    """
    shared = F.least(one["common"], two["common"])
    known = one["common"].isNotNull() & two["common"].isNotNull()
    return ~known | (100 * shared >= similarity * (one["size"] + two["size"] - shared))


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names, bands, places = [], [], [], []
        for text in batch["text"]:
            shingles = shingle_set(text.as_py())
            sizes.append(len(shingles))
            names.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            values = min_max(shingles)
            bands.append(band_keys(*values) if len(shingles) else None)
            places.append(bit_planes(*values) if len(shingles) else None)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                                          pa.array(bands, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))],
                                         ["doc_id", "n_shingles", "set_id", "bands", "sketch"])


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([codec.compress(t.as_py().encode("utf-8", "replace")) for t in batch["text"]], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["node"], texts], ["node", "packed"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per node and shingle; half of its hash will do, as equal halves only make a shingle look common."""
    codec = zstandard.ZstdDecompressor()
    for batch in batches:
        for node, packed in zip(batch["node"].to_pylist(), batch["packed"].to_pylist()):
            halves = (shingle_set(codec.decompress(packed).decode()) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(halves), node, dtype=np.int64)), pa.array(halves)], ["node", "shingle"])


def alone_counts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, alone) of the ``nodes`` (node) that have one text: how many of its shingles no other node has.

    Nodes with several texts make the shingles of others common but have no row.
    """
    here = texts.join(nodes, "node", "left_semi")
    single = here.groupBy("node").agg(F.count(F.lit(1)).alias("texts")).filter("texts = 1")
    owned = here.mapInArrow(unpacked, "node long, shingle int").groupBy("shingle")
    owned = owned.agg(F.min("node").alias("node"), F.max("node").alias("high"), F.count(F.lit(1)).alias("n"))
    alone = owned.filter("node = high").groupBy("node").agg(F.sum("n").alias("alone"))
    return single.join(alone, "node", "left").select("node", F.coalesce("alone", F.lit(0)).alias("alone"))


def shingle_map(shingles: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    """So many bits, each set if a shingle falls on it, as signed 64-bit words."""
    out = np.zeros(bits, dtype=np.uint8)
    out[(shingles % np.uint64(bits)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


MAPS = ", ".join(["node long", "map array<long>", "slack long", "coarse_slack long", *[f"coarse_{word} long" for word in range(COARSE_BITS // 64)]])


def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of each node's shingles, a coarse one, and the slack of both: how many more shingles than bits it has."""
    codec = zstandard.ZstdDecompressor()
    names = [part.split()[0] for part in MAPS.split(", ")]
    for batch in batches:
        rows = []
        for node, packed in zip(batch["node"].to_pylist(), batch["packed"].to_pylist()):
            shingles = shingle_set(codec.decompress(packed).decode())
            maps = shingle_map(shingles), shingle_map(shingles, COARSE_BITS)
            slack = [len(shingles) - int(np.bitwise_count(m.view(np.uint64)).sum()) for m in maps]
            rows.append((node, maps[0], *slack, *maps[1].tolist()))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if name == "map" else pa.int64()) for c, name in zip(columns, names)], names)


def may_overlap(one: Column, two: Column, similarity: int) -> Column:
    """Whether two sets of ``size`` shingles may reach the similarity, by their maps.

    Exact: of the bits that only one map has, each stands for a shingle, at least, that the other set does not have. A
    pair without both maps may.
    """
    def reach(bits: Column, slack: str) -> Column:
        most = bits + F.least(one[slack], two[slack])
        return 100 * most >= similarity * (one["size"] + two["size"] - most)

    known = one["slack"].isNotNull() & two["slack"].isNotNull()
    coarse = reduce(Column.__add__, [F.bit_count(one[f"coarse_{word}"].bitwiseAND(two[f"coarse_{word}"])) for word in range(COARSE_BITS // 64)])
    fine = F.aggregate(F.zip_with(one["map"], two["map"], lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), Column.__add__)
    return ~known | (reach(coarse, "coarse_slack") & reach(fine, "slack"))


def confirmed(similarity: int):
    """Keep the pairs whose full shingle sets reach the similarity in per cent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        last: dict[str, tuple] = {}

        def full(side: str, node: int, packed: bytes) -> np.ndarray:
            # rows come sorted by one side, so its set is made once for a run of pairs
            if last.get(side, (None,))[0] != (node, packed):
                last[side] = ((node, packed), shingle_set(codec.decompress(packed).decode()))
            return last[side][1]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch[c].to_pylist() for c in ("a", "b", "packed_a", "packed_b"))):
                one, two = full("a", a, x), full("b", b, y)
                small, large = sorted((len(one), len(two)))
                if 100 * small < similarity * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= similarity * (small + large - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return run


def with_packed(pairs: DataFrame, texts: DataFrame, side: str) -> DataFrame:
    """Put the packed text of one side beside each pair; a node in many pairs is spread by copies of its text."""
    counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    dealt = hot_join(pairs, counts, [side], "n", pairs.count(), how="inner")
    salts = F.ceil(F.col("n") / 512).cast("int")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("a", "b"), salts).cast("int")).drop("n")
    named = texts.select(F.col("node").alias(side), F.col("packed").alias(f"packed_{side}"))
    copies = named.join(counts, side).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return dealt.join(copies, [side, "salt"]).drop("salt")


def near_groups(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct runs of five words, A-Z as a-z; two documents link when 100 times what they
    share is at least ``similarity`` times their union. component_id is the smallest doc_id that links reach, and
    that document is kept. Texts that are null or without words have no shingles and link with nothing. Rows of one
    doc_id are one document that links by any of its texts. Rows without doc_id follow their equals but link
    nothing. Other columns are ignored; an empty table gives no rows.

    Equal sets are one node from the start, so copies cost one row each. Links come from ``bucket_links``.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with passing():
        rows = staged(source.mapInArrow(sketches, SKETCH))
        full = rows.filter("n_shingles > 0")
        sets = staged(full.groupBy("set_id").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")))
        members = sets.filter(F.col("node").isNotNull()).select(F.explode("bands").alias("bucket"), "node")
        several = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket")
        # only the buckets with several nodes go on, and only the texts of their nodes are kept at hand
        members = staged(members.join(several, "bucket", "left_semi"))
        nodes = members.select("node").distinct()
        texts = staged(source.filter(F.col("text").isNotNull()).withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").mapInArrow(squeezed, "node long, packed binary"))

        def sketched(left: DataFrame) -> DataFrame:
            counted = alone_counts(texts, left.filter("crowded").select("node"))
            maps = texts.join(counted, "node").mapInArrow(mapped, MAPS)
            counted = counted.join(maps, "node")
            named = sets.select("node", "sketch", "size").join(left.select("node"), "node").join(counted, "node", "left")
            return named.select("node", F.struct("sketch", "size", (F.col("size") - F.col("alone")).alias("common"), *maps.columns[1:]).alias("sketch"))

        def near(one: Column, two: Column) -> Column:
            return can_reach(one, two, similarity) & may_overlap(one, two, similarity) & alike(one["sketch"], two["sketch"])

        def verify(pairs: DataFrame) -> DataFrame:
            sides = with_packed(with_packed(pairs, texts, "b"), texts, "a").select("a", "b", "packed_a", "packed_b")
            return sides.mapInArrow(confirmed(similarity), "a long, b long").distinct()

        _, groups = bucket_links(members, verify, sketched, near)
        named = sets.join(groups, "node", "left").select("set_id", "copies", F.coalesce("component", "node").alias("component"))
        named = staged(named, lasting=True)
        rows = staged(rows.select("doc_id", "set_id", "n_shingles"), lasting=True)
    found = hot_join(rows, named, ["set_id"], "copies", rows.count())
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for."""
    gone = near_groups(docs, similarity).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
