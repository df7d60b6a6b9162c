"""Benchmark decontamination by a broadcast set of n-gram hashes.

The windows of all benchmark items (``n`` consecutive words; an item of fewer words is one window) are
hashed, and tasks scan every word window of every whole document against the broadcast set. A hit counts
only once its text is equal to the benchmark's. Documents keep their marks, lose the hit spans, or go.

The set is broadcast only up to ``max_broadcast_bytes`` (windows with their texts and item ids). Beyond
that a bitmap of at most as many bytes is broadcast instead: windows that it lets through are joined by
text with the table of benchmark windows, so results are the same at any size of the benchmark.

Defined results: null text has no words; an item without words has no window; items that share an id count
once; an item without an id contaminates but is neither counted nor listed; repeated rows are judged alike;
empty tables give empty results (documents without benchmark: no hits); other columns pass through, and
``prefix`` keeps the new ones apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Fixed value: a word, once A-Z are lower case, is a run of 0-9, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

#: Odd multipliers of the 64-bit polynomials over bytes and over words; any odd numbers do, hits are verified.
_BYTE, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_UNDO = np.uint64(pow(int(_BYTE), -1, 1 << 64))
_STEP = 1 << 17  # bytes hashed at a time: keeps memory flat for any length of text
_AT_ONCE = 4 << 20  # bytes of texts scanned at a time
_COARSE = 22  # bits of the table that is asked first


def words_of(text: Column) -> Column:
    """Words of a text in lower case; null has none."""
    return F.regexp_extract_all(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``window`` (words joined by a space), ``words`` (their number), ``items`` (distinct item ids as strings)."""
    w = F.col("__w")
    starts = F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("__w"))
        .where(F.size("__w") > 0)
        .select("item", F.least(F.size("__w"), F.lit(n)).alias("words"), F.explode(windows).alias("window"))
        .groupBy("window", "words")
        .agg(F.collect_set("item").alias("items"))
    )


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word of lower-case texts that lie end to end."""
    inside = _IN_WORD[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each word, from running sums over all bytes."""
    at_start, at_end, scale = (np.empty(len(starts), dtype=np.uint64) for _ in range(3))
    total, power, undo = np.uint64(0), np.uint64(1), np.uint64(1)
    values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
    sums = np.zeros(_STEP + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):  # all modulo 2^64
        for low in range(0, len(data), _STEP):
            part = values[data[low : low + _STEP]] * up[: min(_STEP, len(data) - low)]
            m = len(part)
            np.cumsum(part, out=sums[1 : m + 1])
            a, b = np.searchsorted(starts, (low, low + m))
            at = starts[a:b] - low
            at_start[a:b], scale[a:b] = total + power * sums[at], undo * down[at]
            a, b = np.searchsorted(ends, (low + 1, low + m + 1))
            at_end[a:b] = total + power * sums[ends[a:b] - low]
            total, power, undo = total + power * sums[m], power * up[-1] * _BYTE, undo * down[-1] * _UNDO
    return (at_end - at_start) * scale


def _window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i in range(n if len(out) else 0):
        out = out * _NEXT + words[i : i + len(out)]
    return out ^ (out >> np.uint64(29))


class _Scanner:
    """Finds windows whose hash passes the filters, in texts that lie end to end."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        self.up, self.down = _powers(_BYTE, _STEP), _powers(_UNDO, _STEP)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows with their lower-case bytes and offsets; a null text has no bytes."""
        column = column.cast(pa.large_binary())
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
        first, ends = 0, np.cumsum(sizes)
        while first < len(sizes):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + _AT_ONCE, "right")))
            joined = b"".join(x for x in column.slice(first, last - first).to_pylist() if x)
            yield first, last, _TO_LOWER[np.frombuffer(joined, dtype=np.uint8)], np.concatenate(([0], ends[first:last] - done))
            first = last

    def windows(self, data: np.ndarray, offsets: np.ndarray, passes):
        """Word bounds, each word's text, and for each length the first words of windows that ``passes(length, hashes)``."""
        starts, ends = _words(data, offsets)
        owner = np.searchsorted(offsets, starts, "right") - 1
        hashes, found = _word_hashes(data, starts, ends, self.up, self.down), []
        for n in self.lengths:
            h = _window_hashes(hashes, n)
            if len(h):
                at = np.flatnonzero(passes(n, h))
                at = at[owner[at] == owner[at + n - 1]]
                found.append((n, at, h[at]))
        return starts, ends, owner, found


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n]))


def _runs(covered: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, offsets: np.ndarray):
    """Document, first and end byte of each longest run of covered words of one document."""
    at = np.flatnonzero(covered)
    if not len(at):
        return at, at, at
    new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0)))
    first, last = at[new], at[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1]))]
    return owner[first], starts[first] - offsets[owner[first]], ends[last] - offsets[owner[first]]


def _hash_set(windows: list[tuple[str, int, list[str]]]) -> dict:
    """Sorted hashes of windows by length, a coarse table before them, their texts and item ids."""
    scanner, out = _Scanner([]), {}
    for n in sorted({w[1] for w in windows}):
        own = [(text.encode(), items) for text, k, items in windows if k == n]
        data = np.frombuffer(b" ".join(t for t, _ in own), dtype=np.uint8)
        starts, ends = _words(data, np.array([0, len(data)]))
        h = _window_hashes(_word_hashes(data, starts, ends, scanner.up, scanner.down), n)[::n]
        order = np.argsort(h, kind="stable")
        out[n] = (h[order], [own[i] for i in order])
    return out


def _coarse(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _COARSE, dtype=bool)
    table[hashes >> np.uint64(64 - _COARSE)] = True
    return table


def _fields(prefix: str) -> list[T.StructField]:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": T.ArrayType(span)}
    return [T.StructField(prefix + name, kind) for name, kind in kinds.items()]


def _by_hash_set(docs: DataFrame, windows: DataFrame, prefix: str) -> DataFrame:
    """Scan against a broadcast set; the caller has checked its size."""
    known = docs.sparkSession.sparkContext.broadcast(_hash_set([tuple(r) for r in windows.select("window", "words", "items").collect()]))
    schema = T.StructType(docs.schema.fields + _fields(prefix))
    names = schema.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = known.value
        scanner, coarse = _Scanner(list(sets)), {n: _coarse(h) for n, (h, _) in sets.items()}
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            n_words, n_hit = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
            items, spans = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for first, last, data, offsets in scanner.texts(batch.column("text")):
                starts, ends, owner, found = scanner.windows(data, offsets, lambda n, h: coarse[n][h >> np.uint64(64 - _COARSE)])
                change = np.zeros(len(starts) + 1, dtype=np.int64)
                for n, at, h in found:
                    hashes, own = sets[n]
                    low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
                    for i, a, b in zip(*(x[low < high].tolist() for x in (at, low, high))):
                        text = _text(data, starts, ends, i, n)
                        for known_text, ids in own[a:b]:
                            if known_text == text:
                                change[i] += 1
                                change[i + n] -= 1
                                items[first + owner[i]].extend(ids)
                covered = np.cumsum(change[:-1]) > 0
                n_words[first:last] = np.bincount(owner, minlength=last - first)
                n_hit[first:last] = np.bincount(owner[covered], minlength=last - first)
                for d, a, b in zip(*(x.tolist() for x in _runs(covered, starts, ends, owner, offsets))):
                    spans[first + d].append({"start": a, "end": b})
            new = [pa.array(n_words), pa.array(n_hit), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return docs.mapInArrow(scan, schema)


def _bitmap(windows: DataFrame, lengths: list[int], bits: int) -> np.ndarray:
    """One bit for each hash prefix of a window; built by tasks, merged by Spark, of fixed size."""

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(lengths)
        for batch in batches:
            for _, _, data, offsets in scanner.texts(batch.column("window")):
                _, _, owner, found = scanner.windows(data, offsets, lambda n, h: np.ones(len(h), dtype=bool))
                size = np.bincount(owner)
                for n, at, h in found:
                    i = (h[size[owner[at]] == n] >> np.uint64(64 - bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(i >> 6), pa.array(np.left_shift(np.int64(1), i & 63))], names=["word", "bit"])

    merged = windows.select("window").mapInArrow(indices, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for row in merged.toLocalIterator():
        out[row["word"]] = row["bits"]
    return out.astype("<i8").view(np.uint8)


def _by_join(docs: DataFrame, windows: DataFrame, prefix: str, max_bytes: int) -> DataFrame:
    """Windows that a bitmap lets through are joined with the table of benchmark windows by their text."""
    windows = materialise(windows)
    lengths = sorted(r["words"] for r in windows.select("words").distinct().collect())  # at most n of them
    bits = max(10, (8 * max_bytes).bit_length() - 1)
    packed = docs.sparkSession.sparkContext.broadcast(_bitmap(windows, lengths, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = _Scanner(lengths), packed.value

        def passes(n: int, h: np.ndarray) -> np.ndarray:
            i = h >> np.uint64(64 - bits)
            return (table[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 > 0

        for batch in batches:
            keys = batch.column("digest")
            for first, _, data, offsets in scanner.texts(batch.column("text")):
                starts, ends, owner, found = scanner.windows(data, offsets, passes)
                before = np.searchsorted(owner, np.arange(len(offsets) - 1))
                for n, at, _ in found:
                    d = owner[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(first + d)), pa.array([_text(data, starts, ends, i, n).decode() for i in at.tolist()], pa.string()),
                            pa.array(at - before[d]), pa.array(np.full(len(at), n, dtype=np.int64)), pa.array(starts[at] - offsets[d]), pa.array(ends[at + n - 1] - offsets[d]),
                        ],
                        names=["digest", "window", "at", "n", "start", "end"],
                    )

    texts = docs.select(F.md5("text").alias("digest"), "text").where("digest is not null")
    seen = texts.mapInArrow(suspects, "digest string, window string, at long, n long, start long, end long").distinct()
    hits = (
        seen.join(windows.select("window", "items"), "window")
        .groupBy("digest")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n", "start", "end"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(f"{prefix}items"))
    )
    # runs of words: hits come by first word, so the last run either takes a hit in or ends before it
    none = F.array().cast("array<struct<at:long,stop:long,start:long,end:long>>")

    def take(runs: Column, x: Column) -> Column:
        last, stop = F.element_at(runs, -1), x["at"] + x["n"]
        new = F.struct(x["at"].alias("at"), stop.alias("stop"), x["start"].alias("start"), x["end"].alias("end"))
        both = F.struct(last["at"].alias("at"), F.greatest(last["stop"], stop).alias("stop"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["stop"] >= x["at"])
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(both))).otherwise(F.concat(runs, F.array(new)))

    runs = F.aggregate("hits", none, take)
    found = hits.withColumn("runs", runs).select(
        F.col("digest").alias("__digest"), f"{prefix}items",
        F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["at"]).alias(f"{prefix}n_hit"),
        F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias(f"{prefix}spans"),
    )
    joined = docs.join(found, F.md5(docs["text"]) == F.col("__digest"), "left")
    count = F.coalesce(F.regexp_count(F.translate(docs["text"], UPPER, LOWER), F.lit(WORD)), F.lit(0)).cast("long")
    empty = {f.name: F.array().cast(f.dataType) for f in _fields(prefix)[2:]}
    return joined.select(
        *[docs[c] for c in docs.columns], count.alias(f"{prefix}n_words"), F.coalesce(f"{prefix}n_hit", F.lit(0)).cast("long").alias(f"{prefix}n_hit"),
        *[F.coalesce(c, none).alias(c) for c, none in empty.items()],
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast_bytes: int = 32 << 20, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside benchmark windows), ``items`` (their ids as sorted strings)
    and ``spans`` (first and end byte, in UTF-8, of each run of hit words)."""
    windows = benchmark_windows(benchmark, n)
    cost = F.octet_length("window") + 64 + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 60)
    size = windows.agg(F.sum(cost.cast("long"))).first()[0] or 0
    if size <= max_broadcast_bytes:
        return _by_hash_set(docs, windows, prefix)
    return _by_join(docs, windows, prefix, max_broadcast_bytes)


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, runs in zip(text, spans):
        if t is None or not len(runs):
            out.append(t)
            continue
        data, at, rest = t.encode(), 0, []
        for r in runs:
            rest.append(data[at : r["start"]])
            at = r["end"]
        out.append(b"".join([*rest, data[at:]]).decode())
    return pd.Series(out, dtype=object)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the hit words of each text; what stood between and around the runs stays as it was."""
    found = find_contamination(docs, benchmark, n, max_broadcast_bytes, "__")
    cut = F.pandas_udf(_cut, "string")
    clean = F.when(F.size("__spans") > 0, cut("text", "__spans")).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, n: int = 10, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without those of which more than ``max_share`` of the words are hit."""
    found = find_contamination(docs, benchmark, n, max_broadcast_bytes, "__")
    return found.where(F.col("__n_hit") <= max_share * F.col("__n_words")).select(*docs.columns)


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words hit by the benchmark, items found and a digest of their ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
