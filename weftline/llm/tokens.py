"""Encoding a corpus with a public byte-level BPE tokenizer, with reuse of shared chunks.

Texts are cut into chunks at places that a rolling hash of the last characters picks, so the cuts
follow the content and a passage copied into many texts is cut alike in all of them. A first pass
counts the chunks by a 128-bit hash. A text none of whose chunks occurs again is encoded where it is
read, as nothing of it could be reused. Of all other texts each distinct chunk is encoded once in the
whole corpus. A chunk's ids are split at its first and last *seam*: a
place where the tokenizer's pre-splitting ends a piece whatever surrounds it (a blank between a
letter or digit and a letter or digit; an unaccented Latin letter, a Han character or a kana before
a common punctuation mark). Ids between the seams hold in every context. At a chunk join, what lies
between the last seam before and the first seam after it is encoded again as one string, so joins
agree exactly with the encoding of the whole text; a chunk without a seam is passed on whole into
the next join. No tokenizer is trained and no special tokens are made.

Which chunks occur again is told to the scans by a Bloom filter of fixed size; where it errs, a text
takes the way of shared chunks without need and gets the same ids. A chunk that can't be found again
at the join is an error, never left out.

Defined cases: a null or empty text has an empty list of ids; texts are encoded as they are, whole;
strings of special tokens are ordinary text; rows are told apart by their place in the input, so
repeated doc_ids give one row each; an empty table gives no rows. Only the two named
columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shingles import _powers, mix

# Fixed value: the pre-splitting pattern of the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SEAM = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])|(?<=[A-Za-zぁ-ゖァ-ヺ一-鿿])(?=[.,!?;:()、。，！？；：（）])")
_U = np.uint64
WINDOW = 8
BITS, PROBES = 1 << 27, 3  # of the Bloom filter of repeated chunks: 16 MB


@dataclass(frozen=True)
class Tokenizer:
    folder: str = "/opt/tokenizers"
    file: str = "byte_bpe_50k.tiktoken"
    chunk: int = 256  # mean length of a chunk, in characters (a power of 2)
    longest: int = 4096


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # a special token that is never allowed: with none at all, the encoder stops at every character to look for one
    bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|no special token|>": len(ranks) + 1})
    return lambda text: bpe.encode_to_numpy(text, disallowed_special=())


def _place(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts."""
    lens = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lens)])


def _ends(points: np.ndarray, starts: np.ndarray, mean: int, longest: int) -> np.ndarray:
    """End positions of the chunks of texts laid in a row: where the hash of the last WINDOW
    characters of a text has enough zero bits, and at the latest ``longest`` after the last cut."""
    picked = np.zeros(0, np.int64)
    if len(points) >= WINDOW:
        # a polynomial over the window, from prefix sums of the whole row
        up, down = _powers(len(points) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + _U(1)) * up[: len(points)], dtype=np.uint64)])
        h = mix((sums[WINDOW:] - sums[:-WINDOW]) * down[: len(points) - WINDOW + 1])
        picked = np.flatnonzero((h & _U(mean - 1)) == 0)
        # the whole window lies in one text
        picked = picked[np.searchsorted(starts, picked, "right") == np.searchsorted(starts, picked + WINDOW - 1, "right")] + WINDOW
    ends = np.union1d(picked, starts[1:])
    gaps = np.diff(np.concatenate([[0], ends]))
    if len(gaps) and gaps.max() > longest:
        more = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest], strict=True)]
        ends = np.union1d(ends, np.concatenate(more))
    return ends


def cuts(text: str, mean: int, longest: int) -> list[int]:
    """End positions of the chunks of one text."""
    points, starts = _place([text])
    return _ends(points, starts, mean, longest).tolist()


def split(encode, chunk: str) -> tuple[str, np.ndarray | None, str]:
    """(head, ids, tail) of a chunk: text before its first seam, ids up to its last seam, text
    after it. Without a seam all is head and ids are None."""
    at = [m.start() for m in _SEAM.finditer(chunk)]
    if not at:
        return chunk, None, ""
    return chunk[: at[0]], encode(chunk[at[0] : at[-1]]) if at[-1] > at[0] else _NONE, chunk[at[-1] :]


_NONE = np.zeros(0, np.uint32)


def join(encode, parts: list[tuple[str, np.ndarray | None, str]]) -> np.ndarray:
    """Ids of the whole text from the parts of its chunks."""
    out: list[np.ndarray] = []
    carry = ""
    for head, ids, tail in parts:
        carry += head
        if ids is not None:
            if carry:
                out.append(encode(carry))
            out.append(ids)
            carry = tail
    if carry:
        out.append(encode(carry))
    return np.concatenate(out) if out else _NONE


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """An array<int> column; None is null."""
    lens = [0 if r is None else len(r) for r in rows]
    flat = np.concatenate([r for r in rows if r is not None and len(r)] or [_NONE]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat), mask=pa.array([r is None for r in rows]))


def _slices(texts: list[str], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _cut(texts: list[str], cfg: Tokenizer) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All chunks of the texts, the number of each one's text, and their keys (chunks x 2)."""
    points, starts = _place(texts)
    ends = _ends(points, starts, cfg.chunk, cfg.longest)
    begins = np.concatenate([[0], ends[:-1]])
    whole = "".join(texts)
    pieces = [whole[i:j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p.encode("utf-8", "surrogatepass")) for p in pieces), np.int64).reshape(-1, 2)
    return pieces, np.searchsorted(starts, begins, "right") - 1, keys


def _probes(keys: np.ndarray) -> np.ndarray:
    """The filter's places for each key (keys x PROBES)."""
    a, b = keys[:, 0].astype(np.uint64), keys[:, 1].astype(np.uint64) | _U(1)
    return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % _U(BITS)).astype(np.int64)


def _keys(cfg: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _slices(texts):
                keys = _cut(texts[lo:hi], cfg)[2]
                at = _probes(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1])), *[pa.array(np.ascontiguousarray(at[:, i])) for i in range(PROBES)]], names=["h1", "h2", *[f"p{i}" for i in range(PROBES)]])

    return run


def _filter(keys: DataFrame) -> np.ndarray:
    """The Bloom filter of the keys that occur more than once: BITS / 8 bytes, whatever the corpus."""
    places = [f"p{i}" for i in range(PROBES)]
    again = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), *[F.first(p).alias(p) for p in places]).where("n > 1")
    at = again.select(F.explode(F.array(*places)).alias("bit")).select((F.col("bit") + 1).alias("bit"))  # buckets and positions count from 1
    parts = at.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in parts:
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bits)] |= np.frombuffer(bytes(bits), np.uint8)
    return out


def _shared(texts: list[str], cfg: Tokenizer, seen: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Whether each text has a chunk that occurs again, and its chunks as from ``_cut``."""
    pieces, owner, keys = _cut(texts, cfg)
    at = _probes(keys)
    hit = ((seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
    return np.bincount(owner, hit, len(texts)) > 0, pieces, owner, keys


def _direct(cfg: Tokenizer, seen):
    """(doc_id, ids) of the texts without a chunk that occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(f"{cfg.folder}/{cfg.file}")
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _slices(texts):
                alone = np.flatnonzero(~_shared(texts[lo:hi], cfg, seen.value)[0]) + lo
                if len(alone):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(alone)), _lists([encode(texts[i]) for i in alone.tolist()])], names=["doc_id", "ids"])

    return run


def _chunks(cfg: Tokenizer, seen, text: bool):
    """Chunks of the other texts: their keys with place (text=False) or with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _slices(texts):
                shared, pieces, owner, keys = _shared(texts[lo:hi], cfg, seen.value)
                use = np.flatnonzero(shared[owner])
                if not len(use):
                    continue
                h1, h2 = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
                if text:
                    once = list({(a, c): i for a, c, i in zip(h1[use].tolist(), h2[use].tolist(), use.tolist(), strict=True)}.values())
                    yield pa.RecordBatch.from_arrays([pa.array(h1[once]), pa.array(h2[once]), pa.array([pieces[i] for i in once], pa.string())], names=["h1", "h2", "piece"])
                else:
                    seq = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
                    at = pa.array(owner[use] + lo)
                    cols = [b.column("row").take(at), b.column("doc_id").take(at), pa.array(seq[use].astype(np.int32)), pa.array(h1[use]), pa.array(h2[use])]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "seq", "h1", "h2"])

    return run


def _encode(cfg: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(f"{cfg.folder}/{cfg.file}")
        for b in batches:
            got = [split(encode, x) for x in b.column("piece").to_pylist()]
            heads, ids, tails = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), pa.array(heads, pa.string()), _lists(list(ids)), pa.array(tails, pa.string())], names=["h1", "h2", "head", "ids", "tail"])

    return run


def _assemble(cfg: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(f"{cfg.folder}/{cfg.file}")
        for b in batches:
            parts = b.column("parts")
            flat = parts.flatten()
            heads, tails, ids = flat.field("head").to_pylist(), flat.field("tail").to_pylist(), flat.field("ids")
            if flat.field("head").null_count:
                raise ValueError("a chunk was not found again")
            none, at, values = ids.is_null().to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.values.to_numpy()
            cells = [(h, None if n else values[i:j], t) for h, n, i, j, t in zip(heads, none.tolist(), at[:-1].tolist(), at[1:].tolist(), tails, strict=True)]
            row = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists([join(encode, cells[i:j]) for i, j in zip(row[:-1], row[1:], strict=True)])], names=["doc_id", "ids"])

    return run


def corpus_ids(docs: DataFrame, key: Column, text: Column, cfg: Tokenizer = Tokenizer()) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``."""
    rows = docs.select(key.alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)["doc_id"]
    full = rows.where(F.length("text") > 0)
    seen = docs.sparkSession.sparkContext.broadcast(_filter(full.select("text").mapInArrow(_keys(cfg), f"h1 long, h2 long, {', '.join(f'p{i} long' for i in range(PROBES))}")))
    alone = full.select("doc_id", "text").mapInArrow(_direct(cfg, seen), f"doc_id {kind}, ids array<int>")
    # chunks are made once as keys with their place and once as text: cheaper than shuffling the text of all of them
    places = full.mapInArrow(_chunks(cfg, seen, False), f"row long, doc_id {kind}, seq int, h1 long, h2 long")
    pieces = full.select("text").mapInArrow(_chunks(cfg, seen, True), "h1 long, h2 long, piece string")
    encoded = pieces.groupBy("h1", "h2").agg(F.first("piece").alias("piece")).mapInArrow(_encode(cfg), "h1 long, h2 long, head string, ids array<int>, tail string")
    parts = places.join(encoded, ["h1", "h2"], "left").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "head", "ids", "tail"))).alias("parts"))
    whole = parts.select("doc_id", "parts").mapInArrow(_assemble(cfg), f"doc_id {kind}, ids array<int>")
    none = rows.where(F.col("text").isNull() | (F.length("text") == 0)).select("doc_id", F.array().cast("array<int>").alias("ids"))
    return alone.unionByName(whole).unionByName(none)


def _count(cfg: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(f"{cfg.folder}/{cfg.file}")
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c != "text"], pa.array(sizes, pa.int32())], names=[*[c for c in b.schema.names if c != "text"], "size"])

    return run


def corpus_sizes(docs: DataFrame, text: str, cfg: Tokenizer = Tokenizer()) -> DataFrame:
    """The other columns of ``docs`` and ``size``, the number of tokens of the text (0 for none), counted
    where it is read: no ids are made or moved."""
    keep = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)
    return docs.select(*keep, F.col(text).alias("text")).mapInArrow(_count(cfg), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", size int")
