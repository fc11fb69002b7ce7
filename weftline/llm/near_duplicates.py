"""Near-duplicate records with small edits: pigeonhole blocks, then Hamming distance, then the exact test.

A text's fingerprint is a vector of ``blocks * rows`` minimum hashes of its shingle set. It is
split into ``blocks`` blocks; two fingerprints that differ in fewer than ``blocks`` places share a
whole block (pigeonhole), and texts of similarity s share one with probability
1 - (1 - s^rows)^blocks: at the defaults for s = 0.6 in 9,996 of 10,000 pairs, for s = 0.7 in all
but about one in five million. Records are joined on blocks. Candidates are verified by the Hamming
distance of the same fingerprints, of which one bit a place is carried (a place that differs has
another bit in half of all cases): texts at the threshold t differ in about (1 - t) / 2 of the bits,
unrelated ones in half. The bound lies ``sigmas`` standard deviations above that mean, so a pair at the
threshold is lost there about once in a hundred million cases. What remains is tested exactly on
whole shingle sets.

Texts are shingled once for the fingerprints; texts with equal shingle sets form one class and are
joined as one record. Only texts whose class is in a remaining pair are shingled again and send
their sets; a bitmap of fixed size, read by the scan, holds these classes.

Skew: the rows of a block are streamed in order of their class; of a block of up to ``tile`` classes
the pairs come out at once, a larger one is cut into pieces of ``tile`` classes whose pairs are made in
separate places, so no buffer or task grows with a block. Pairs of records are made from pairs of
classes in blocks.

Defined cases: null, empty and short texts (under ``min_words`` words) are in no pair; repeated
(id, text) rows count once; a null id is left out; an empty table gives no rows; texts are used
whole. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.classes import member_pairs
from weftline.llm.groups import connected_groups
from weftline.llm.shingles import mix, shingle_sets
from weftline.operators.temporal import group_pairs
from weftline.plans.lineage import cut, shuffle_partitions

_U = np.uint64
BITS = 1 << 23


@dataclass(frozen=True)
class NearDuplicates:
    threshold: float = 0.8
    width: int = 5
    min_words: int = 5
    blocks: int = 56
    rows: int = 4
    sigmas: float = 6.0
    tile: int = 512  # classes of a block that are paired at once

    def most_bits(self) -> int:
        """The Hamming bound of fingerprints, in bits."""
        n, p = self.blocks * self.rows, (1 - self.threshold) / 2
        return int(n * p + self.sigmas * (n * p * (1 - p)) ** 0.5)


def class_ids(offsets: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One 64-bit id per shingle set."""
    return mix(np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), offsets[:-1]) + np.diff(offsets).astype(np.uint64))


def fingerprints(offsets: np.ndarray, h: np.ndarray, blocks: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: its blocks, as one hash per block (sets x blocks), and one bit of each minimum
    hash, packed into 64-bit integers (sets x words)."""
    factors = mix(np.arange(1, blocks * rows + 1, dtype=np.uint64)) | _U(1)
    n = len(offsets) - 1
    keys, bits = np.empty((n, blocks), np.uint64), np.zeros((n, -(-blocks * rows // 64) * 64), np.uint8)
    for b in range(blocks):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(h * factors[b * rows + r], offsets[:-1])
            key = mix(key * _U(0xD1342543DE82EF95) + least)
            bits[:, b * rows + r] = (mix(least) >> _U(63)).astype(np.uint8)
        keys[:, b] = key
    return keys.view(np.int64), np.packbits(bits, axis=1).view(np.int64)


def _texts(batch: pa.RecordBatch) -> tuple[list, pa.Array]:
    return batch.column("text").to_pylist(), batch.column("id")


def _meta(cfg: NearDuplicates):
    """A row per usable text; its block keys only at the first text of a class within a slice, so a text
    that fills the corpus sends its blocks once a slice."""
    words = -(-cfg.blocks * cfg.rows // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = _texts(b)
            for rows, off, h in shingle_sets(texts, cfg.width, cfg.min_words):
                cls = class_ids(off, h)
                _, first, back = np.unique(cls, return_index=True, return_inverse=True)
                is_first = np.zeros(len(cls), bool)
                is_first[first] = True
                lens = np.diff(off)
                picked = np.sort(first)
                keys, bits = fingerprints(np.concatenate([[0], np.cumsum(lens[picked])]), h[np.repeat(is_first, lens)], cfg.blocks, cfg.rows)
                bits = bits[np.searchsorted(picked, first[back])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(is_first, cfg.blocks, 0))]), pa.int32()), pa.array(keys.reshape(-1)), mask=pa.array(~is_first))
                cols = [ids.take(pa.array(rows)), pa.array(cls.view(np.int64)), pa.array(lens.astype(np.int32)), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(words)], lists]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "cls", "n", *[f"f{i}" for i in range(words)], "keys"])

    return run


def _block_pairs(tile: int):
    """(key, a, b) from rows sorted by (key, cls): the pairs of each block of up to ``tile`` classes,
    and the single classes (b is null) of a larger one."""
    most = 1 << 19

    def out(key: np.ndarray, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["key", "a", "b"])

    def pairs(key: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lens = np.diff(np.concatenate([at, [len(key)]]))
        for n in np.unique(lens[lens > 1]).tolist():
            x, y = np.triu_indices(n, 1)
            begins = at[lens == n]
            for k in range(0, len(begins), step := max(1, most // len(x))):
                rows = cls[begins[k : k + step, None] + np.arange(n)]
                a = rows[:, x].reshape(-1)
                yield out(np.zeros(len(a), np.int64), a, rows[:, y].reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cls, large = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        last: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            k, c = b.column("key").to_numpy(), b.column("cls").to_numpy()
            fresh = np.concatenate([[last != (int(k[0]), int(c[0]))], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            opens = last is None or int(k[0]) != last[0]
            last = (int(k[-1]), int(c[-1]))
            k, c = k[fresh], c[fresh]
            if not len(k):
                continue
            if large and not opens:  # the open block is known to be large: pass its rows on
                more = int(np.searchsorted(k != k[0], True))
                yield out(k[:more], c[:more], None)
                k, c = k[more:], c[more:]
                if not len(k):
                    continue
            large = False
            key, cls = np.concatenate([key, k]), np.concatenate([cls, c])
            begin = len(key) - int(np.searchsorted(key[::-1] != key[-1], True))
            sizes = np.flatnonzero(np.concatenate([[True], key[1:begin] != key[: begin - 1]])) if begin else np.zeros(0, np.int64)
            lens = np.repeat(np.diff(np.concatenate([sizes, [begin]])), np.diff(np.concatenate([sizes, [begin]])))
            if (lens > tile).any():
                yield out(key[:begin][lens > tile], cls[:begin][lens > tile], None)
            if (small := (lens > 1) & (lens <= tile)).any():
                yield from pairs(key[:begin][small], cls[:begin][small])
            key, cls = key[begin:], cls[begin:]
            if len(key) > tile:
                yield out(key, cls, None)
                key, cls, large = key[:0], cls[:0], True
        if len(key) > 1:
            yield from pairs(key, cls)

    return run


def _sets(cfg: NearDuplicates, wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, off, h in shingle_sets(_texts(b)[0], cfg.width, cfg.min_words):
                cls, first = np.unique(class_ids(off, h), return_index=True)
                bit = (cls % _U(BITS)).astype(np.int64)
                hit = np.flatnonzero((wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                if len(hit):
                    vals = [h[off[i] : off[i + 1]].view(np.int64) for i in first[hit]]
                    yield pa.RecordBatch.from_arrays([pa.array(cls[hit].view(np.int64)), pa.array(vals, pa.list_(pa.int64()))], names=["cls", "vals"])

    return run


def _bitmap(classes: DataFrame) -> np.ndarray:
    """Which classes are wanted, by their id modulo BITS: at most BITS / 8 bytes."""
    bit = F.col("cls").bitwiseAND(F.lit(BITS - 1)) + 1  # buckets and positions count from 1
    parts = classes.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in parts:
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bits)] |= np.frombuffer(bytes(bits), np.uint8)
    return out


def near_duplicate_classes(docs: DataFrame, key: Column, text: Column, cfg: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """(id, cls, n): the class of each usable text; (a, b, shared, na, nb): the pairs of different
    classes that reach the threshold, a < b."""
    docs = docs.select(key.cast("string").alias("id"), text.alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    fp = [f"f{i}" for i in range(-(-cfg.blocks * cfg.rows // 64))]
    meta = cut(docs.mapInArrow(_meta(cfg), f"id string, cls long, n int, {', '.join(f'{f} long' for f in fp)}, keys array<long>"))
    facts = meta.where(F.col("keys").isNotNull()).groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", *fp)])
    keys = meta.where(F.col("keys").isNotNull()).select("cls", F.explode("keys").alias("key"))
    keys = keys.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "cls").select("key", "cls")
    met = cut(keys.mapInArrow(_block_pairs(cfg.tile), "key long, a long, b long"))
    large = group_pairs(met.where(F.col("b").isNull()), "key", "a", cfg.tile).select("a", "b")
    near = met.where(F.col("b").isNotNull()).select("a", "b").unionByName(large).distinct()
    fa, fb = (facts.toDF(x, f"n{x}", *[f"{x}{i}" for i in range(len(fp))]) for x in "ab")
    distance = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(len(fp))), F.lit(0))
    t = F.lit(cfg.threshold - 1e-9)
    close = near.join(fa, "a").join(fb, "b").where((distance <= cfg.most_bits()) & (F.col("na") >= t * F.col("nb")) & (F.col("nb") >= t * F.col("na")))
    close = cut(close.select("a", "b", "na", "nb"))
    wanted = _bitmap(close.select(F.explode(F.array("a", "b")).alias("cls")))
    sets = docs.mapInArrow(_sets(cfg, wanted), "cls long, vals array<long>").groupBy("cls").agg(F.first("vals").alias("vals"))
    pairs = close.join(sets.toDF("a", "va"), "a").join(sets.toDF("b", "vb"), "b").withColumn("shared", F.size(F.array_intersect("va", "vb")))
    pairs = pairs.where(F.col("shared") >= t * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b", "shared", "na", "nb")
    return meta.select("id", "cls", "n"), pairs


def near_duplicate_pairs(docs: DataFrame, key: Column, text: Column, cfg: NearDuplicates) -> DataFrame:
    """(id_lo, id_hi, shared, n_lo, n_hi): all pairs of ids whose texts reach the threshold, copies included."""
    members, pairs = near_duplicate_classes(docs, key, text, cfg)
    members = members.distinct()
    own = members.groupBy("cls", "n").agg(F.count("*").alias("k")).where("k > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.col("n").alias("shared"), F.col("n").alias("na"), F.col("n").alias("nb"))
    out = member_pairs(cut(pairs.unionByName(own)), members.select("id", "cls")).where(F.col("x") != F.col("y"))
    lo = F.col("x") < F.col("y")
    out = out.select(F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi"), "shared", F.when(lo, F.col("na")).otherwise(F.col("nb")).alias("n_lo"), F.when(lo, F.col("nb")).otherwise(F.col("na")).alias("n_hi"))
    return out.distinct()


def near_duplicate_groups(docs: DataFrame, key: Column, text: Column, cfg: NearDuplicates) -> DataFrame:
    """(id, class_id, copies, links, group_id): one row per usable text with its class of equal shingle
    sets (its smallest id), how many ids the class has, the number of other classes it is linked to,
    and the group of all texts linked directly or indirectly (its smallest id)."""
    members, pairs = near_duplicate_classes(docs, key, text, cfg)
    pairs = cut(pairs)
    members = members.select("id", "cls").distinct()
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    groups = connected_groups(pairs, "a", "b").toDF("cls", "grp")
    per = members.groupBy("cls").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).join(links, "cls", "left").join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls"))
    per = cut(per)
    least = per.groupBy("grp").agg(F.min("class_id").alias("group_id"))
    return members.join(per.join(least, "grp"), "cls").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "group_id")
