"""Groups of documents whose word shingles agree to a given share, found completely.

Two texts are near copies if the exact Jaccard similarity of their sets of five-word shingles is
``share`` percent or more. Candidates come from two searches:

* SimHash: fingerprints of the same shingles that differ in ``max_bits`` or fewer, through the
  Gray-order index of ``simhash``. It links most copies, but no bit limit holds all pairs.
* Prefix filtering holds the rest: with all shingles in one fixed order, two sets of that similarity
  share one of the first ``n - ceil(share * n) + 1`` shingles of each, so no pair is lost. Shingles
  that a sample of the texts holds often come last in the order, which is a matter of speed only.

Every candidate is confirmed before it links: by sizes and positions, by small bitmaps of both sets
that prove most false candidates wrong, and then on the whole sets.

Prefixes are sorted by shingle once. A text meets the first text that holds one of its shingles; shingles of
three texts or more are kept, and texts that share one and are still in different groups meet in
blocks of bounded size, twice with one likely partner each, then with all that bitmaps allow. A large group of copies so costs a number of comparisons that grows with its
size, not with the square of it.

Defined results: null text counts as empty; texts without words are one group; fewer words than a
shingle form one shingle; equal sets are one group; rows that share a doc_id, or have none, are
grouped by their own texts; very long texts are used whole; empty tables give empty results. Sets are
known by a 64-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, tidy
from .simhash import components, majority, near_links, shingle_hashes


def prefix_length(n: int, share: int) -> int:
    """Number of first shingles of which two sets of ``share`` percent or more have one in common."""
    return n - (share * n + 99) // 100 + 1 if n else 0


def bitmap(h: np.ndarray) -> bytes:
    """One bit for each range of hashes, set if ``h`` holds one in it; between one and two bits a hash."""
    k = max(3, (len(h) - 1).bit_length())
    bits = np.zeros(1 << k, dtype=np.uint8)
    bits[(h >> np.uint64(64 - k)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def may_agree(one: bytes, other: bytes, n: int, m: int, share: int) -> bool:
    """False if the bitmaps prove that sets of ``n`` and ``m`` hashes have less than ``share`` percent in common.

    A range in which only one set has a hash stands for a hash that the other lacks.
    """
    a, b = (np.unpackbits(np.frombuffer(x, dtype=np.uint8)) for x in (one, other))
    size = min(len(a), len(b))
    a, b = (x.reshape(size, -1).max(axis=1) for x in (a, b))
    need = -(-(n + m) * share // (100 + share))
    return n - int((a & ~b & 1).sum()) >= need and m - int((b & ~a & 1).sum()) >= need


def common_shingles(docs: DataFrame, words: int, seed: int, one_in: int = 16, most: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the distinct texts holds three times or more, rarest first, and about
    how many texts hold each. At most ``most``, so the sample only orders shingles."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [np.unique(shingle_hashes(t or b"", words, seed)) for t in frame["text"]]
            yield pd.DataFrame({"h": np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64)})

    sample = docs.select(F.col("text").cast("binary")).where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).dropDuplicates(["text"])
    counts = sample.mapInPandas(tidy(emit), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    rows = counts.orderBy(F.desc("n"), "h").limit(most).collect()[::-1]
    return np.array([r.h for r in rows], dtype=np.int64).view(np.uint64), np.array([r.n * one_in for r in rows], dtype=np.int64)


def add_sets(docs: DataFrame, common: np.ndarray, share: int, words: int, seed: int) -> DataFrame:
    """``doc_id``, ``text_key``, ``fp`` (digest of the set), ``sim`` (SimHash), ``n`` (size of the set),
    ``bits`` (its bitmap) and ``first``: its prefix, once in a task for each set."""
    by_value = np.argsort(common)
    sorted_common = common[by_value]

    def one(data: bytes | None, seen: set[int]) -> tuple:
        every = shingle_hashes(data or b"", words, seed)
        h = np.unique(every)
        digest = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), seed)).view(np.int64))
        first = None
        if digest not in seen:
            seen.add(digest)
            at = np.minimum(np.searchsorted(sorted_common, h), max(0, len(sorted_common) - 1))
            rank = np.where(sorted_common[at] == h, by_value[at] + 1, 0) if len(sorted_common) else np.zeros(len(h), dtype=np.int64)
            first = h[np.lexsort((h, rank))][: prefix_length(len(h), share)].view(np.int64)
        return digest, int(np.uint64(majority(every)).view(np.int64)), len(h), bitmap(h), first

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # one number for each row of the task at most
        for frame in batches:
            made = pd.DataFrame([one(t, seen) for t in frame["text"]], columns=["fp", "sim", "n", "bits", "first"])
            yield pd.concat([frame[["doc_id", "text_key"]].reset_index(drop=True), made], axis=1)

    # ids as strings: pandas would turn whole numbers beside a null into doubles
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary"))
    made = rows.mapInPandas(tidy(sets), "doc_id string, text_key long, fp long, sim long, n int, bits binary, first array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _position_allows(n: np.ndarray, pos: np.ndarray, m: np.ndarray, other: np.ndarray, share: int) -> np.ndarray:
    """If the first shingle that two sets share stands at these positions, all other shared ones are behind it."""
    most = 1 + np.minimum(n - pos - 1, m - other - 1)
    return (most * (100 + share) >= (n + m) * share) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * share)


def walk_prefixes(entries: DataFrame, share: int) -> DataFrame:
    """From ``key, fp, np`` (size and position) and ``salt``: rows of kind 0 are candidates ``x, y``; rows of
    kind 1 are the entries ``x`` (key), ``y`` (fp), ``z`` (np) of keys that three sets hold, or of salted ones, and rows
    of kind 2 candidates ``x, y`` among those, ``x`` the first holder of the key."""
    columns = ["key", "fp", "np", "salt"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, told = np.zeros((0, 4), dtype=np.int64), False  # of the open key: its first entry and its last
        for frame in batches:
            if not len(frame):
                continue
            rows = np.concatenate([carry, frame[columns].to_numpy(dtype=np.int64)])
            done = np.zeros(len(rows), dtype=bool)
            done[: len(carry)] = told
            fresh = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            rows, done = rows[fresh], done[fresh]
            key = rows[:, 0]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[heads, len(key)])
            head = np.repeat(heads, sizes)
            many = np.repeat((sizes > 2) | done[heads], sizes) | (rows[:, 3] >= 0)
            at = np.flatnonzero(head != np.arange(len(key)))
            a, b = rows[head[at]], rows[at]
            ok = _position_allows(a[:, 2] >> 32, a[:, 2] & 0xFFFFFFFF, b[:, 2] >> 32, b[:, 2] & 0xFFFFFFFF, share)
            held = rows[many & ~done]
            # pairs of keys that only two hold are all there is of them; of the others one for each text is tried first
            yield pd.DataFrame({"kind": np.where(many[at[ok]], 2, 0), "x": a[ok, 1], "y": b[ok, 1], "z": 0})
            yield pd.DataFrame({"kind": 1, "x": held[:, 0], "y": held[:, 1], "z": held[:, 2]})
            told = bool(many[-1])
            last = heads[-1]
            carry = rows[[last, len(rows) - 1]] if len(rows) - last > 1 else rows[last:]

    dealt = entries.repartition("key", "salt").sortWithinPartitions("key", "salt", "fp")
    return dealt.select(*columns).mapInPandas(tidy(walk), "kind int, x long, y long, z long")


def pairs_apart(held: DataFrame, sets: DataFrame, share: int, every: bool = True, block: int = 2048) -> DataFrame:
    """Pairs ``a, b`` that share a ``key`` in different groups ``root`` and may have the share in common, by sizes,
    positions and bitmaps; or one likely pair only for every text outside the group that most of a key are in.

    The entries of a key are dealt to chunks of about ``block``; every two chunks meet in one group.
    """

    def of_group(fp, np_, chunk, root, bits, two) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        order = np.lexsort((fp, np_ >> 32))
        fp, n, pos, chunk, root, bits = fp[order], np_[order] >> 32, np_[order] & 0xFFFFFFFF, chunk[order], root[order], bits[order]
        start, end = np.searchsorted(n, -(-n * share // 100)), np.searchsorted(n, n * 100 // share, side="right")
        # of two entries in different groups one at least is outside the group that most are in
        names, own = np.unique(root, return_inverse=True)
        most = np.bincount(own).argmax()
        for i in np.flatnonzero(own != most):
            j = np.arange(start[i], end[i])
            ok = (own[j] != own[i]) & ((own[j] == most) | (j > i)) & _position_allows(n[i], pos[i], n[j], pos[j], share)
            if two:
                ok &= chunk[j] != chunk[i]
            j = j[ok]
            if every:
                j = j[[may_agree(bits[i], bits[k], n[i], n[k], share) for k in j]] if len(j) else j
            elif len(j):
                room = (1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)) * (100 + share) - (n[i] + n[j]) * share
                j = j[[room.argmax()]]
            left.append(np.full(len(j), fp[i]))
            right.append(fp[j])
        return np.concatenate(left), np.concatenate(right)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in batches:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if len(frame) == 0:
                continue
            last = frame.iloc[-1]
            open_ = (frame["key"] == last["key"]) & (frame["x"] == last["x"]) & (frame["y"] == last["y"])
            rest, frame = frame[open_], frame[~open_]  # a group may go on in the next batch
            yield run(frame)
        if rest is not None:
            yield run(rest)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key, fp, np_, chunk, root, x, y = (frame[c].to_numpy(dtype=np.int64) for c in ("key", "fp", "np", "chunk", "root", "x", "y"))
        bits = frame["bits"].to_numpy() if every else np.zeros(len(key))
        new = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        heads = np.flatnonzero(np.r_[True, new]) if len(key) else np.zeros(0, dtype=np.int64)
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo, hi in zip(heads, np.r_[heads[1:], len(key)]):
            a, b = of_group(fp[lo:hi], np_[lo:hi], chunk[lo:hi], root[lo:hi], bits[lo:hi], x[lo] != y[lo])
            left.append(a)
            right.append(b)
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    # keys whose texts are all in one group have nothing left to compare
    many = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
    chunks = F.ceil(F.col("m") / F.lit(block)).cast("long")
    rows = held.join(many.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.expr("pmod(xxhash64(fp), chunks)"))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("key", "fp", "np", "chunk", "root", F.least("chunk", "__o").alias("x"), F.greatest("chunk", "__o").alias("y"))
    if every:
        rows = rows.join(sets.select("fp", "bits"), "fp")
    found = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(tidy(search), "a long, b long")
    if not every:
        found = found.groupBy("a").agg(F.min("b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirm(docs: DataFrame, sets: DataFrame, pairs: DataFrame, share: int, words: int, seed: int, broadcast_sets: int) -> DataFrame:
    """The pairs ``a, b`` of set digests whose whole sets have ``share`` percent or more in common.

    Up to ``broadcast_sets`` digests of the texts asked for are broadcast; more are joined by a shuffle.
    """

    @F.pandas_udf(T.BooleanType())
    def plausible(one: pd.Series, other: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_agree(*row, share) for row in zip(one, other, n, m)], dtype=bool)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t or b"", words, seed)).view(np.int64) for t in texts])

    def both(frame: DataFrame, facts: DataFrame, *names: str) -> DataFrame:
        for end in ("a", "b"):
            frame = frame.join(facts.select(F.col("fp").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in names]), end)
        return frame

    sized = both(pairs, sets, "n", "bits").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * share)
    left = materialise(sized.where(plausible("bits_a", "bits_b", "n_a", "n_b")).select("a", "b"))
    asked = left.select(F.col("a").alias("fp")).unionByName(left.select(F.col("b").alias("fp"))).distinct()
    keys = materialise(sets.join(asked, "fp", "left_semi").select("fp", "text_key"))
    keys = F.broadcast(keys) if keys.count() <= broadcast_sets else keys
    texts = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key")).join(keys, "text_key")
    full = materialise(texts.dropDuplicates(["fp"]).select("fp", whole(F.col("text")).alias("s")))
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return materialise(both(left, full, "s").where(shared * (100 + share) >= (F.size("s_a") + F.size("s_b")) * share).select("a", "b"))


def near_groups(
    docs: DataFrame, share: int = 80, words: int = 5, max_bits: int = 3, seed: int = 42, broadcast_sets: int = 1_000_000, hot_rows: int = 10_000
) -> DataFrame:
    """``doc_id, text_key, root`` for every row: ``text_key`` is the XXH64 of the text, ``root`` names its group."""
    common, holders = common_shingles(docs, words, seed)
    prints = materialise(add_sets(docs, common, share, words, seed))
    facts = [F.first(c).alias(c) for c in ("text_key", "sim", "n", "bits")]
    sets = materialise(prints.groupBy("fp").agg(*facts))
    entries = prints.where("first IS NOT NULL").select("fp", "n", F.posexplode("first").alias("pos", "key"))
    entries = entries.select("key", "fp", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    # shingles of very many texts, as far as the sample shows them, are dealt to several tasks
    wide = [(int(h), int(-(-m // hot_rows))) for h, m in zip(common.view(np.int64), holders) if m > hot_rows]
    entries = entries.withColumn("salt", F.lit(-1).cast("long"))
    if wide:
        table = docs.sparkSession.createDataFrame(wide, "key long, __parts long")
        entries = entries.join(F.broadcast(table), "key", "left").withColumn("salt", F.coalesce(F.expr("pmod(fp, __parts)"), "salt"))
    walked = materialise(walk_prefixes(entries, share))

    codes = materialise(sets.groupBy("sim").agg(F.min("fp").alias("of")))
    same = sets.join(codes, "sim").where("fp <> of").select(F.col("of").alias("a"), F.col("fp").alias("b"))
    near = near_links(codes.select(F.col("sim").alias("fp")), max_bits)
    for end in ("a", "b"):
        near = near.join(codes.select(F.col("sim").alias(end), F.col("of").alias(f"of_{end}")), end)
    tried = same.unionByName(near.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    tried = tried.unionByName(walked.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))
    tried = tried.unionByName(walked.where("kind = 2").groupBy(F.col("y").alias("b")).agg(F.min("x").alias("a")))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = confirm(docs, sets, materialise(tried), share, words, seed, broadcast_sets)
    held = walked.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("fp"), F.col("z").alias("np")).distinct()

    def rooted(frame: DataFrame) -> DataFrame:
        groups = components(links)
        return frame.join(groups, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")

    # the likeliest pairs first: most groups of copies are whole then, and few are left for all pairs
    for every in (False, False, True):
        more = materialise(pairs_apart(rooted(held), sets, share, every))
        if more.isEmpty():
            break
        links = materialise(links.unionByName(confirm(docs, sets, more, share, words, seed, broadcast_sets)))
    return rooted(prints.select("doc_id", "text_key", "fp")).select("doc_id", "text_key", "root")


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, component_id`` (smallest id of its group) for every row of ``docs``; options of ``near_groups``."""
    rows = materialise(near_groups(docs, **options))
    smallest = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(smallest, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: of smallest doc_id, rows without one last; then of smallest text digest."""
    rows = materialise(near_groups(docs, **options).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("__m")))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "__m")).alias("r"))
    best = materialise(best.select(F.col("r.doc_id").alias("__id"), F.col("r.text_key").alias("__key"), "r.__m"))
    keyed = docs.withColumn("__text", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key"))
    single = keyed.join(best.where("__m = 1"), same, "left_semi")
    repeated = keyed.join(best.where("__m > 1"), same, "left_semi").dropDuplicates(["doc_id", "__text"])
    return single.unionByName(repeated).drop("__text")
