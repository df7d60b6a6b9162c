"""Pack documents into fixed-size sequences by cutting-stock column generation.

Full-size pieces are cut off first; the rest of each document is one item of 1 to capacity - 1
tokens, counted in steps of ``grain`` tokens, rounded up. A linear program over the histogram of
these lengths chooses packing patterns: knapsack dynamic programming prices new patterns against the
duals until none improves, the fractional counts are rounded down, and what is left over is packed
best-fit. Only the histogram, one number for each possible length, reaches the driver. Documents are
ranked inside their length, and rank intervals lead each to its pattern copy and slot.

Defined results: null text counts as empty, and every document carries the end id, so each gives at
least one piece; very long texts are encoded whole and cut into full pieces; repeated rows are packed
one by one; empty tables give empty results; other columns are ignored. Ties in rank are ordered by
doc_id, start and checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tidy

CAPACITY = 1024


def knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Best total value of items that fit into ``capacity``, each usable many times."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    order = np.argsort(lengths, kind="stable")
    ls, vs = lengths[order], values[order]
    upto = np.searchsorted(ls, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = upto[c]
        if k:
            gain = best[c - ls[:k]] + vs[:k]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], choice[c] = gain[j], order[j]
    counts: dict[int, int] = {}
    c = capacity
    while c > 0:
        j = choice[c]
        if j < 0:
            c -= 1
            continue
        counts[j] = counts.get(j, 0) + 1
        c -= int(lengths[j])
    return float(best[capacity]), counts


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float, max_columns: int):
    """Patterns (columns of item counts) and their fractional multiplicities.

    Revised simplex on ``min sum x, A x = d, x >= 0`` from one pattern for each length. It ends when
    no pattern prices under the dual bound by more than ``tolerance``, or after ``max_columns``.
    """
    m = len(lengths)
    fill = capacity // lengths
    basis = np.diag(fill.astype(float))
    inverse = np.diag(1.0 / fill)
    x = demand / fill
    duals = 1.0 / fill
    for _ in range(max_columns):
        value, counts = knapsack(duals, lengths, capacity)
        if value <= 1 + tolerance:  # then the sum of x is within the factor value of the optimum
            break
        column = np.zeros(m)
        for j, k in counts.items():
            column[j] = k
        step = inverse @ column
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / step[ok]
        r = int(ratio.argmin())
        theta = ratio[r]
        x -= theta * step
        x[r] = theta
        np.maximum(x, 0, out=x)
        basis[:, r] = column
        row = inverse[r] / step[r]
        duals = duals + (1 - value) * row
        inverse -= np.outer(step, row)
        inverse[r] = row
    return basis.astype(np.int64), x


def plan_patterns(histogram: dict[int, int], capacity: int, tolerance: float = 0.001, max_columns: int = 4000) -> list[tuple[int, list[int]]]:
    """(copies, item lengths) for every pattern; together they hold each length exactly as often as
    ``histogram`` says."""
    plan: list[tuple[int, list[int]]] = []
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if left.get(capacity):
        plan.append((left.pop(capacity), [capacity]))
    lengths = np.array(sorted(left), dtype=np.int64)
    if len(lengths) and sum(left.values()) > len(lengths):
        demand = np.array([left[int(k)] for k in lengths], dtype=float)
        columns, x = column_generation(lengths, demand, capacity, tolerance, max_columns)
        for r in np.argsort(-x, kind="stable"):
            items = [int(k) for k, n in zip(lengths, columns[:, r]) for _ in range(n)]
            copies = int(x[r] + 1e-9)
            for k in set(items):
                copies = min(copies, left[k] // items.count(k))
            if copies > 0:
                plan.append((copies, items))
                for k in items:
                    left[k] -= copies
    # the rounding leaves about one copy of each pattern: longest first, then the best fit
    rest = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in left.items():
        rest[k] = n
    while rest.any():
        items, room = [], capacity
        while room:
            fits = np.flatnonzero(rest[: room + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            n = min(int(rest[k]), room // k)
            items += [k] * n
            rest[k] -= n
            room -= n * k
        copies = 1 + min(int(rest[k]) // items.count(k) for k in set(items))
        for k in items:
            rest[k] -= copies - 1
        plan.append((copies, items))
    return plan


class _Encoder:
    """Ids of the byte-level BPE file, equal to those of ``tokenizers`` for that file.

    Ordinary text goes through the rank file of the same vocabulary, which is several times faster;
    texts that spell out a special token, or hold a run of white space too long for the pattern
    engine behind it, go through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, rank_path: str | None):
        self.json_path, self.full, self.fast = json_path, None, None
        if rank_path:
            import base64

            import public_tokenizers
            import tiktoken.registry

            # a worker process runs many tasks: its registry holds one encoding for all of them
            known, name = tiktoken.registry.ENCODINGS, f"ranks of {rank_path}"
            if name not in known:
                with open(rank_path, "rb") as f:
                    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
                known[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fast = known[name]

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
            except ValueError:  # its pattern engine gives up on white space runs of about a million
                pass
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.json_path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cut_pieces(docs: DataFrame, capacity: int, json_path: str, rank_path: str | None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece."""
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _Encoder(json_path, rank_path)
        for frame in batches:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    row = (doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, part.astype(np.int32)) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": object})

    # ids as strings: pandas would turn whole numbers beside a null into doubles
    pieces = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(tidy(tokenize), schema)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("long"))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, grain: int = 8, pieces_per_run: int = 500) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens."""
    spark = pieces.sparkSession
    # the salt is written with the piece, so that every read of a piece puts it into the same run
    units = materialise(pieces.withColumn("units", F.expr(f"(length + {grain - 1}) div {grain}")).withColumn("__salt", F.rand(seed=5)))
    histogram = {r["units"]: r["n"] for r in units.groupBy("units").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots, first, used = [], 0, dict.fromkeys(histogram, 0)
    for copies, items in plan_patterns(histogram, capacity // grain):
        slot = 0
        for k in sorted(set(items), reverse=True):
            n = items.count(k)
            slots.append((k, used[k], used[k] + copies * n, n, first, slot))
            used[k] += copies * n
            slot += n
        first += copies
    # one row for each length of each pattern: bounded by capacity / grain, not by the data
    table = spark.createDataFrame(slots, "__units long, low long, high long, per_copy long, first long, base long")
    counts = spark.createDataFrame([(k, -(-n // pieces_per_run)) for k, n in histogram.items()], "units long, runs long")
    # ranks inside a length: runs dealt by the salt, each ranked on its own, shifted by the runs before it
    cut = units.join(F.broadcast(counts), "units")
    cut = cut.withColumn("run", F.floor(F.col("__salt") * F.col("runs")).cast("long")).drop("runs", "__salt")
    sums = cut.groupBy("units", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("units").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("units", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("units", "run").orderBy("doc_id", "start", "ids_crc32", "length")
    ranked = (
        cut.withColumn("rank", F.row_number().over(inside) - 1)
        .join(sums, ["units", "run"])
        .withColumn("rank", F.col("rank") + F.col("shift"))
    )
    hit = (F.col("units") == F.col("__units")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.join(F.broadcast(table), hit)
        .withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div per_copy"))
        .withColumn("slot", F.col("base") + F.expr("(rank - low) % per_copy"))
        .withColumn("offset", F.sum("length").over(order) - F.col("length"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``capacity`` tokens.

    Without paths the public byte-level vocabulary is used.
    """
    if json_path is None:
        import public_tokenizers

        json_path, rank_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return place_pieces(cut_pieces(docs, capacity, json_path, rank_path, with_ids=with_ids), capacity)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
