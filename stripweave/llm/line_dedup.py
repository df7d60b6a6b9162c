"""Line deduplication with a once-seen and a twice-seen Bloom filter.

Every partition sets the bits of its line keys in two small filters: once-seen and twice-seen.
Merging two pairs of filters, bits that both have once become twice; filters are merged segment by
segment in two levels, so a task merges few of them however many partitions there are. A key of two documents always
has all its bits in the merged twice-seen filter, so only keys found there go through the shuffle
that confirms them by a 128-bit digest, counts their documents and picks the holder that keeps them.

The filter size follows the number of lines up to ``max_filter_bytes`` (the bound of what is
broadcast). Beyond that more keys are suspected and confirmed by the shuffle: slower, equally exact.

Defined results: a null or empty text is one empty line; a line without 20 code points in its key is
never dropped; repeated rows of one doc_id count as one document; documents with a null doc_id keep
all lines and count for none; empty tables give empty results; other columns are kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Filters are cut into segments of this many bits, merged by different tasks.
SEGMENT_BITS = 1 << 20
#: Partitions whose filters are merged by one task, before these are merged.
MERGE_GROUP = 256
HASHES = 4


def line_key(line: bytes) -> bytes:
    """A UTF-8 line stripped of ASCII white space, with A-Z in lower case."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for k in map(line_key, (text or b"").split(b"\n")) if _long_enough(k, min_chars)}


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64)


def _bits_of(h: np.ndarray, n_bits: int) -> np.ndarray:
    """Bit positions of each hash, one column for each hash function; n_bits is a power of two."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    k = np.arange(HASHES, dtype=np.uint64)
    return (low[:, None] + k * high[:, None]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (n_bits.bit_length() - 1))


def _set(filter_: np.ndarray, positions: np.ndarray) -> None:
    np.bitwise_or.at(filter_, positions >> np.uint64(3), np.left_shift(1, (positions & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _has(filter_: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (filter_[positions >> np.uint64(3)] >> (positions & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def twice_filter(docs: DataFrame, min_chars: int, n_bits: int) -> list[tuple[int, bytes]]:
    """Segments of the merged twice-seen filter, compressed; ``n_bits / 8`` bytes in all."""
    segment = min(SEGMENT_BITS, n_bits)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group = TaskContext.get().partitionId() // MERGE_GROUP
        once, twice = np.zeros(n_bits // 8, dtype=np.uint8), np.zeros(n_bits // 8, dtype=np.uint8)
        for frame in batches:
            # a batch at a time: what it holds twice is twice-seen at once
            h = _hashes(k for text in frame["text"] for k in _keys(text, min_chars))
            h, n = np.unique(h, return_counts=True)
            if len(h):
                at = _bits_of(h, n_bits)
                _set(twice, np.unique(at[(n > 1) | _has(once, at)]))
                _set(once, np.unique(at))
        size = segment // 8
        for k in range(n_bits // segment):
            o, t = once[k * size : (k + 1) * size], twice[k * size : (k + 1) * size]
            if o.any():
                yield pd.DataFrame({"segment": [k], "group": [group], "once": [zlib.compress(o.tobytes(), 1)], "twice": [zlib.compress(t.tobytes(), 1)]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        once, twice = (np.zeros(segment // 8, dtype=np.uint8) for _ in range(2))
        for o, t in zip(frame["once"], frame["twice"]):
            o, t = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (o, t))
            twice |= t
            twice |= once & o
            once |= o
        return pd.DataFrame({"segment": frame["segment"].iloc[:1], "group": [0], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    schema = "segment int, group int, once binary, twice binary"
    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(build, schema)
    some = parts.groupBy("segment", "group").applyInPandas(merge, schema)
    merged = some.groupBy("segment").applyInPandas(merge, schema).select("segment", "twice")
    return [(r["segment"], bytes(r["twice"])) for r in merged.collect()]  # at most max_filter_bytes


def suspects(docs: DataFrame, min_chars: int, n_bits: int) -> DataFrame:
    """``digest, doc_id``: keys that the twice-seen filter holds, once for each row of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(twice_filter(docs, min_chars, n_bits))
    segment = min(SEGMENT_BITS, n_bits)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = np.zeros(n_bits // 8, dtype=np.uint8)
        for k, blob in sent.value:
            twice[k * segment // 8 : (k + 1) * segment // 8] = np.frombuffer(zlib.decompress(blob), dtype=np.uint8)
        for frame in batches:
            keys, owners = [], []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                own = _keys(text, min_chars)
                keys += own
                owners += [doc_id] * len(own)
            hit = np.flatnonzero(_has(twice, _bits_of(_hashes(keys), n_bits))).tolist() if keys else []
            digests, ids = [_digest(keys[i]) for i in hit], [owners[i] for i in hit]
            yield pd.DataFrame({"digest": digests, "doc_id": pd.array(ids, dtype="int64")})

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInPandas(test, "digest binary, doc_id long")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_filter_bytes: int = 32 << 20, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the ``kept`` text (null text counts as empty).

    ``prefix`` goes before these names; columns of ``docs`` with the same names are replaced.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines except in the largest doc_id that holds them.
    """
    lines = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    expected = max(1024, lines["n"], (lines["chars"] or 0) // 100)  # keys
    n_bits = 1 << min((8 * max_filter_bytes).bit_length() - 1, max(16, (16 * expected - 1).bit_length()))
    held = materialise(suspects(docs, min_chars, n_bits).distinct())
    drop = held.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written first: the join then reads two plain shuffles, of which large keys are split
    drop = materialise(drop.select("digest", "keeper"))
    lost = (
        held.join(drop, "digest")
        .where("doc_id <> keeper")
        .groupBy("doc_id")
        .agg(F.collect_set("digest").alias("__lost"))  # keys of one document's own lines
        .withColumnRenamed("doc_id", "__doc")
    )
    out = docs.join(lost, docs["doc_id"].cast("long") == F.col("__doc"), "left").drop("__doc")

    @F.pandas_udf("n_lines long, n_dropped long, kept binary")
    def apply(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, digests in zip(texts, gone):
            parts = (text or b"").split(b"\n")
            kept = parts
            if digests is not None and len(digests):
                lost_keys = set(map(bytes, digests))
                kept = [x for x in parts if not (_long_enough(k := line_key(x), min_chars) and _digest(k) in lost_keys)]
            rows.append((len(parts), len(parts) - len(kept), b"\n".join(kept)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    return out.withColumn("__r", apply(F.col("text").cast("binary"), F.col("__lost"))).select(
        *[c for c in docs.columns if c not in [prefix + n for n in ("n_lines", "n_dropped", "kept")]],
        F.col("__r.n_lines").alias(prefix + "n_lines"),
        F.col("__r.n_dropped").alias(prefix + "n_dropped"),
        F.col("__r.kept").cast("string").alias(prefix + "kept"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines dropped from every document and the digest of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
