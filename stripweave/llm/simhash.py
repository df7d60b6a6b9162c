"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in few bits agree on at least one of a few bit blocks. Such a shared
masked pattern is an upper node; the members of a node are sorted by Gray rank and factored again
into runs with their shared bits, so that a whole run is pruned once the differences to its shared
bits exceed the limit. Nodes with too many members are split by the next shared pattern, which
loses no link. Nodes emit spanning links only, never all pairs.

Defined results: null text counts as empty; without words the fingerprint is zero and links like
any other; fewer words than a shingle form one shingle; repeated rows share fingerprint and
component; empty tables give empty results; other columns are ignored; rows with a null doc_id
keep a fingerprint and take the component of its other holders.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Fixed value: a word is a run of bytes other than ASCII white space.
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

_BIT_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def shingle_hashes(data: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text in lower case, in order, repeats included."""
    w = WORD_BYTES.findall(data.lower())
    if not w:
        return np.zeros(0, dtype=np.uint64)
    joined, size = b" ".join(w), max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:size].tolist()
    ends = ends[min(words, len(w)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), dtype="<u8", count=size)


def majority(h: np.ndarray) -> int:
    """Bit b is 1 if set in over half of the hashes; no hashes give zero."""
    total = np.zeros(64, dtype=np.int64)
    step = 1 << 16  # a slice at a time: long texts stay in bounded memory
    for at in range(0, len(h), step):
        total += np.unpackbits(h[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text: bit b is 1 if set in over half of the shingles' XXH64 values."""
    return majority(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), words, seed))


def add_fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number."""

    @F.pandas_udf(T.LongType())
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.col("text")).alias("fp"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in Gray order."""
    r = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


def bits(x: np.ndarray) -> np.ndarray:
    """Number of set bits of each 64-bit number."""
    x = np.ascontiguousarray(x)
    return _BIT_COUNT[x.view(np.uint8).reshape(*x.shape, 8)].sum(axis=-1, dtype=np.int64)


def _links_of_node(fp: np.ndarray, limit: int, fan: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of a node's codes at ``limit`` or fewer differing bits.

    fp is in Gray order. Runs of ``fan`` codes form a node above them that holds their shared bits;
    a code meets the members of a run only if its differences to the shared bits stay in the limit.
    """
    n = len(fp)
    heads = np.arange(0, n, fan)
    ones, zeros = np.bitwise_and.reduceat(fp, heads), np.bitwise_or.reduceat(fp, heads)
    shared = ~(ones ^ zeros)
    left, right = [], []
    rows = max(1, 2_000_000 // len(heads))
    for at in range(0, n, rows):
        part = fp[at : at + rows]
        i, run = np.nonzero(bits((part[:, None] ^ ones[None, :]) & shared[None, :]) <= limit)
        i = i + at
        for k in range(fan):
            j = heads[run] + k
            ok = (j < n) & (j > i)
            a, b = i[ok], j[ok]
            near = bits(fp[a] ^ fp[b]) <= limit
            left.append(a[near])
            right.append(b[near])
    return np.concatenate(left), np.concatenate(right)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over the links (a, b)."""
    root = np.arange(n)
    while True:
        one, other = root[a], root[b]
        if (one == other).all():
            return root
        # the larger root hangs under the smaller one; then all point at their root again
        np.minimum.at(root, np.maximum(one, other), np.minimum(one, other))
        while (root != root[root]).any():
            root = root[root]


def _blocks(mask: int, parts: int) -> list[int]:
    """The free bits of ``mask`` (ones) dealt to ``parts`` masks, highest bits first."""
    free = [b for b in range(63, -1, -1) if mask >> b & 1]
    return [sum(1 << b for b in chunk) for chunk in (free[len(free) * k // parts : len(free) * (k + 1) // parts] for k in range(parts))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_links(codes: DataFrame, max_bits: int = 2, node_size: int = 1024) -> DataFrame:
    """Spanning links ``a, b`` between distinct codes ``fp`` that differ in ``max_bits`` or fewer.

    Any two such codes are connected by the links of the nodes that hold both. A level of the
    index shares one of ``max_bits + 1`` blocks of the bits still free; every node over
    ``node_size`` codes goes on to the next level, which ends as codes in a node are distinct.
    """
    parts = max_bits + 1

    def child(frame: DataFrame, masks: list[int]) -> DataFrame:
        made = [F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("node")) for m in masks]
        return frame.withColumn("__c", F.explode(F.array(*made))).select("fp", "__c.mask", "__c.node")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(mask, node, fp) -> pd.DataFrame:
            heads = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (node[1:] != node[:-1])])
            sizes = np.diff(np.r_[heads, len(fp)])
            group = np.repeat(np.arange(len(heads)), sizes)
            left, right = [], []
            small = sizes <= 8
            for d in range(1, 8):  # small nodes, all of them at once
                i = np.arange(len(fp) - d)
                i = i[small[group[i]] & (group[i] == group[i + d])]
                near = bits(fp[i] ^ fp[i + d]) <= max_bits
                left.append(i[near])
                right.append(i[near] + d)
            for g in np.flatnonzero(~small):
                lo, hi = heads[g], heads[g] + sizes[g]
                a, b = _links_of_node(fp[lo:hi], max_bits)
                root = _spanning(hi - lo, a, b)
                own = np.flatnonzero(root != np.arange(hi - lo))
                left.append(root[own] + lo)
                right.append(own + lo)
            left, right = np.concatenate(left), np.concatenate(right)
            return pd.DataFrame({"a": fp[left].view(np.int64), "b": fp[right].view(np.int64)})

        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame.iloc[-1] if len(frame) else None
            if last is None:
                continue
            open_ = (frame["mask"] == last["mask"]) & (frame["node"] == last["node"])
            rest, frame = frame[open_], frame[~open_]  # a node may go on in the next batch
            if len(frame):
                yield run(frame, emit)
        if rest is not None and len(rest):
            yield run(rest, emit)

    def run(frame: pd.DataFrame, emit) -> pd.DataFrame:
        fp = frame["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((gray_rank(fp), frame["node"].to_numpy(), frame["mask"].to_numpy()))
        return emit(frame["mask"].to_numpy()[order], frame["node"].to_numpy()[order], fp[order])

    found = None
    todo = [(child(codes, _blocks((1 << 64) - 1, parts)), _blocks((1 << 64) - 1, parts))]
    free = 64
    while todo:
        level, masks = todo.pop()
        level = materialise(level)
        sizes = level.groupBy("mask", "node").agg(F.count(F.lit(1)).alias("n"))
        # codes in a node are distinct, so few free bits bound its size
        large = sizes.where(F.col("n") > node_size).select("mask", "node")
        used = materialise(large)
        many = used.count() if 2**free > node_size else 0
        held = sizes.where((F.col("n") > 1) & (F.col("n") <= node_size) if many else F.col("n") > 1).select("mask", "node")
        links = (
            level.join(held, ["mask", "node"], "left_semi")
            .repartition("mask", "node")
            .sortWithinPartitions("mask", "node")
            .mapInPandas(search, "a long, b long")
        )
        found = links if found is None else found.unionByName(links)
        if many:
            free = max(64 - bin(m).count("1") for m in masks)
            step = {m: _blocks(((1 << 64) - 1) & ~m, parts) for m in masks}
            case = F.lit(None).cast("array<bigint>")
            for m, kids in step.items():
                case = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(m | k)) for k in kids])).otherwise(case)
            split = (
                level.join(used, ["mask", "node"], "left_semi")
                .withColumn("mask", F.explode(case))
                .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("node"))
                .distinct()
            )
            todo.append((split, sorted({m | k for m, kids in step.items() for k in kids})))
    return found.distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: smallest node reachable over links ``a, b`` for every linked node.

    Large-star and small-star rounds: each is one aggregation of minima and one join, and the
    number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = materialise(small.where("u <> v").distinct())
        same = new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = new
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, seed: int = 42, node_size: int = 1024) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    prints = materialise(add_fingerprints(docs, words, seed))
    codes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    links = near_links(codes.select("fp"), max_bits, node_size)
    # components over codes; a second step turns the code groups into smallest doc ids
    groups = components(links)
    rooted = codes.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_code = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_code, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
