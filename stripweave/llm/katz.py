"""Katz backoff language model of order n: count, discount, back off, score.

Texts are handled in batches of bounded size. A batch never sends single tokens: level by level it sends its
distinct words, word pairs, triples and so on, as sorted packed arrays, to the buckets of a hash space, and gets
one number back for each. The buckets are the partitioned count tables. The batches themselves are written once,
bucketed by batch, and are not shuffled again. Grams go by their history, so a bucket can normalise a history on
its own; the grams of a frequent history are dealt to several buckets, whose sums are added up in a small table.

    p1(w)         = d1(c) c / N for known words; the rest of the mass for the unknown word
    p_m(w | h)    = d_m(c) c / c(h)              if the gram was kept
                  = bow(h) p_{m-1}(w | h')       if the history was kept but not the gram
                  = p_{m-1}(w | h')              otherwise; h' is h without its first word

All pairs are kept; longer grams from ``min_count`` on, 2 by default, as usual for the highest orders. A gram can only be so
frequent if both grams one shorter inside it are, so batches ask for no others. d are Good-Turing discounts up to
count ``k``. bow(h) = (1 - sum of kept p(w | h)) / (1 - sum of lower p over the same words), so each history sums to
1 exactly. A history without discounted mass lends 1 / (c(h) + 1) of it.

Defined results: null text counts as empty and holds one end token; rows with a null doc_id are not
learned from; repeated rows are counted and scored one by one; very long texts are scored whole, in a batch of
their own; without training rows N is 0 and only the unknown word is left, with probability 1; empty tables give
empty results; other columns are ignored. A word is known by the 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PerWorker, discard, keep_bucketed, materialise

#: No word holds white space, so this stands for the end of a text.
END = xxhash.xxh64_intdigest(b"\n")
#: The start of a text as a history; in the place of a word it stands for none.
START_ID = NO_WORD = 0
UNKNOWN_ID, FIRST_ID = 1, 2
#: Grams of fewer words are all kept.
PRUNED_FROM = 3


_zstd = PerWorker()


def _packer() -> zstandard.ZstdCompressor:
    return _zstd.get("packer") or _zstd.setdefault("packer", zstandard.ZstdCompressor(level=1))


def _opener() -> zstandard.ZstdDecompressor:
    return _zstd.get("opener") or _zstd.setdefault("opener", zstandard.ZstdDecompressor())


def squeeze(a: np.ndarray, rising: bool = False) -> bytes:
    """Packed form of an array of 64-bit numbers: differences if rising, bytes by significance."""
    a = np.ascontiguousarray(a).view(np.uint64)
    if rising and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    return _packer().compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(blob: bytes, rising: bool = False, kind=np.int64) -> np.ndarray:
    """The array that ``squeeze`` packed."""
    raw = np.frombuffer(_opener().decompress(blob), dtype=np.uint8)
    a = np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1)
    if rising:
        a = np.cumsum(a, dtype=np.uint64)
    return a.view(kind)


def sorted_by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by keys that are not negative, the first one first, and which rows then begin a new combination.

    Keys that fit into 63 bits together are sorted as one number.
    """
    bits = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(bits) <= 63:
        whole = np.zeros(len(keys[0]), dtype=np.int64)
        for k, b in zip(keys, bits):
            whole = whole << b | k
        order = np.argsort(whole)
        whole = whole[order]
        return order, np.r_[np.ones(min(1, len(whole)), dtype=bool), whole[1:] != whole[:-1]]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, new


def good_turing(n: dict[int, int], k: int) -> np.ndarray:
    """Discount factor for counts 0 to k; larger counts are kept whole.

    ``n`` has the number of distinct items for counts 1 to k + 1. Where Good-Turing is undefined or
    not between 0 and 1, absolute discounting takes its place.
    """
    d = np.ones(k + 1)
    n1, n2 = n.get(1, 0), n.get(2, 0)
    shift = n1 / (n1 + 2 * n2) if n1 else 0.5
    common = (k + 1) * n.get(k + 1, 0) / n1 if n1 else 1.0
    for r in range(1, k + 1):
        d[r] = 0
        if n.get(r) and common < 1:
            d[r] = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common)
        if not 0 < d[r] < 1:
            d[r] = (r - min(max(shift, 0.05), 0.95)) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c for an array of counts."""
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


def kept_from(level: int, min_count: int) -> int:
    """Smallest count of a gram of ``level`` words that the model keeps."""
    return min_count if level >= PRUNED_FROM else 1


def conditional(c: np.ndarray, of: np.ndarray, d: np.ndarray) -> np.ndarray:
    """p of kept grams with count ``c`` after histories seen ``of`` times; negative where the history lends as a whole."""
    return np.where(c < 0, -c / (of + 1.0), discounted(np.abs(c), d) / np.maximum(of, 1))


def _counts_of_counts(c: np.ndarray, k: int) -> list[int]:
    """Sum of the counts, number of them, and how many are 1 to k + 1."""
    return [int(c.sum()), len(c), *np.bincount(np.minimum(c, k + 2), minlength=k + 3)[1 : k + 2].tolist()]


class _Unigrams:
    """What every task needs of the word counts: a few numbers."""

    def __init__(self, total: int, distinct: int, n: dict[int, int], k: int):
        self.total, self.distinct, self.d = total, distinct, good_turing(n, k)
        known = sum(n.get(r, 0) * r * self.d[r] for r in range(1, k + 1)) + total - sum(r * n.get(r, 0) for r in range(1, k + 1))
        if total and known >= total:  # nothing was discounted
            self.scale, self.unknown = total / (total + 1), 1 / (total + 1)
        else:
            self.scale, self.unknown = 1.0, (1 - known / total) if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        seen = discounted(c, self.d) * (self.scale / max(1, self.total))
        return np.where(c > 0, seen, self.unknown)


class _Model:
    """Numbers that all tasks share: word model, discounts of each level, bounds of buckets and of frequent histories."""

    def __init__(self, uni: _Unigrams, starts: int, buckets: int, hot: int, min_count: int):
        self.uni, self.starts, self.buckets, self.hot, self.min_count, self.d = uni, starts, buckets, hot, min_count, {}

    def parts(self, level: int, h: np.ndarray, hn: np.ndarray) -> np.ndarray:
        """To how many buckets the grams of each history are dealt."""
        return np.where(hn > self.hot, hn // self.hot + 1, 1)

    def lower(self, level: int, c: np.ndarray, of: np.ndarray) -> np.ndarray:
        """p of a level's gram without its first word, from that gram's count and its history's."""
        return self.uni.p(c) if level == 2 else conditional(c, of, self.d[level - 1])


TEXTS = "batch long, bucket int, kind int, a binary, b binary, c binary, e binary, ids array<string>, learned array<long>"


def _batches(docs: DataFrame, training: Column, order: int, buckets: int, batch_tokens: int) -> DataFrame:
    """Rows of kind 0: the texts of a batch as indexes into its distinct words, frequent ones first; kind 1: those
    words with their training counts, sorted and cut by bucket."""
    shift = np.uint64(64 - (buckets.bit_length() - 1)) if buckets > 1 else None

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        train: list[bool] = []
        hashes: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal made, held
            sizes, learn = np.array([len(h) for h in hashes], dtype=np.int64), np.array(train, dtype=bool)
            words, at = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(at[np.repeat(learn, sizes)], minlength=len(words)).astype(np.int64)
            often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[often] = np.arange(len(words))
            # how many learned tokens have at least 0, 1, ... words before them
            long = [int(np.maximum(sizes[learn] - j, 0).sum()) for j in range(order)]
            rows = [(part + made, -1, 0, squeeze(rank[at]), squeeze(sizes), squeeze(learn.astype(np.int64)), squeeze(often), ids.copy(), long)]
            bucket = (words >> shift).astype(np.int64) if shift is not None else np.zeros(len(words), np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.unique(bucket).tolist():
                own = slice(edges[b], edges[b + 1])
                rows.append((part + made, b, 1, squeeze(words[own], True), squeeze(counts[own]), None, None, None, None))
            made, held = made + 1, 0
            ids.clear(), train.clear(), hashes.clear()
            return pd.DataFrame(rows, columns=["batch", "bucket", "kind", "a", "b", "c", "e", "ids", "learned"])

        for frame in batches:
            for doc_id, text, learn in zip(frame["doc_id"], frame["text"], frame["learn"]):
                words = (text or b"").lower().split()
                h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
                ids.append(doc_id)
                train.append(bool(learn))
                hashes.append(np.append(h, np.uint64(END)))
                held += len(words) + 1
                if held >= batch_tokens:
                    yield flush()
        if ids:
            yield flush()

    # as strings: pandas would turn whole numbers beside a null into doubles
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(training, F.lit(False)).alias("learn"))
    return rows.mapInPandas(cut, TEXTS)


REPLIES = "batch long, level int, bucket int, c binary, bow binary, ids binary"


def _word_table(sent: DataFrame, buckets: int, k: int) -> DataFrame:
    """For each bucket of words: a reply to every batch (counts and ids) and one row of totals."""

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        bucket = int(frame["bucket"].iloc[0])
        words = [expand(a, True, np.uint64) for a in frame["a"]]
        counts = [expand(b) for b in frame["b"]]
        distinct, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(total, at, np.concatenate(counts))
        # frequent words get small ids: they pack well
        rank = np.empty(len(distinct), dtype=np.int64)
        rank[np.lexsort((distinct, -total))] = np.arange(len(distinct))
        ids = np.where(total > 0, FIRST_ID + rank * buckets + bucket, UNKNOWN_ID)
        rows, start = [], 0
        for batch, w in zip(frame["batch"], words):
            own = at[start : start + len(w)]
            rows.append((batch, 1, bucket, squeeze(total[own]), None, squeeze(ids[own]), None))
            start += len(w)
        rows.append((-1, 1, bucket, None, None, None, _counts_of_counts(total[total > 0], k)))
        return pd.DataFrame(rows, columns=["batch", "level", "bucket", "c", "bow", "ids", "totals"])

    return sent.groupBy("bucket").applyInPandas(count, REPLIES + ", totals array<long>")


class _Batch:
    """A batch with what it knows of its tokens, level by level: counts and ids of the grams that end there."""

    def __init__(self, text_row, replies: pd.DataFrame, model: _Model, level: int, scored: bool = False):
        self.model, self.logs = model, None
        tokens, self.sizes, self.train = expand(text_row.a), expand(text_row.b), expand(text_row.c).astype(bool)
        tokens = expand(text_row.e)[tokens]
        self.first = np.cumsum(self.sizes) - self.sizes
        own = replies[replies["level"] == 1].sort_values("bucket")
        counts, ids = (np.concatenate([expand(x) for x in own[c]]) for c in ("c", "ids"))
        self.word, self.seen = ids[tokens], counts[tokens]
        self.gram, self.count = self.word, self.seen
        if scored:
            self.logs = np.log10(model.uni.p(self.seen))
        for m in range(2, level + 1):
            self.ask(m)
            self.learn(m, replies[replies["level"] == m].sort_values("bucket"))

    def _before(self, a: np.ndarray, at_start: int) -> np.ndarray:
        out = np.r_[at_start, a[:-1]]
        out[self.first] = at_start
        return out

    def ask(self, m: int) -> None:
        """Distinct grams of level ``m`` that may be kept, by bucket, history and word."""
        model = self.model
        if m == 2:
            h, hn = self._before(self.word, START_ID), self._before(self.seen, model.starts)
            valid = h != UNKNOWN_ID
            likely, self.of_lower = valid, np.zeros(len(h), dtype=np.int64)
        else:
            h, hn = self._before(self.gram, -1), self._before(np.abs(self.count), 0)
            valid = h >= 0
            likely, self.of_lower = valid & (np.abs(self.count) >= model.min_count), self.of
        w = np.where(likely, self.word, NO_WORD)
        parts = model.parts(m, h, hn).astype(np.uint64)
        part = np.where(parts > 1, (w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)) % parts, np.uint64(0))
        mix = (h.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + part * np.uint64(0xD6E8FEB86659FD93)
        mix ^= mix >> np.uint64(29)
        # the number of buckets is a power of two
        bucket = (mix * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33) & np.uint64(model.buckets - 1)).astype(np.int64)
        rows = np.flatnonzero(valid)
        order, new = sorted_by(bucket[rows], h[rows], w[rows])
        order = rows[order]
        b, hs, ws = bucket[order], h[order], w[order]
        gram = np.cumsum(new) - 1
        self.at = np.full(len(h), -1, dtype=np.int64)
        self.at[order] = gram
        first = order[new]
        learned = np.repeat(self.train, self.sizes)[order] & (ws != NO_WORD)
        self.asked = {
            "bucket": b[new], "h": hs[new], "w": ws[new], "n": np.bincount(gram, weights=learned, minlength=len(first)).astype(np.int64),
            "ln": np.where(likely, self.count, 0)[first], "lh": np.where(likely, self.of_lower, 0)[first], "hn": hn[first],
        }
        self.of = hn

    def learn(self, m: int, replies: pd.DataFrame) -> None:
        """Take in the answers to ``ask``: counts, backoff weights of the histories and ids."""

        def joined(column: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *[expand(x, kind=kind) for x in replies[column] if x is not None]])

        c = joined("c", np.int64)
        bow, ids = np.zeros(len(c)), np.full(len(c), -1, dtype=np.int64)
        bow[c == 0] = joined("bow", np.float64)
        some = joined("ids", np.int64)
        if len(some):
            ids[np.abs(c) >= self.model.min_count] = some
        has = self.at >= 0
        at = self.at[has]
        count, gram = np.zeros(len(self.at), dtype=np.int64), np.full(len(self.at), -1, dtype=np.int64)
        count[has], gram[has] = c[at], ids[at]
        if self.logs is not None:
            own = count[has]
            p = np.where(own == 0, 1.0, conditional(own, self.of[has], self.model.d[m]))
            self.logs[has] = np.where(own == 0, bow[at] + self.logs[has], np.log10(p))
        self.count, self.gram = count, gram


MESSAGES = "batch long, bucket int, h binary, w binary, n binary, ln binary, lh binary, hn binary"


def _asked(texts: DataFrame, replies: DataFrame, model: _Model, m: int) -> DataFrame:
    """What batches send to the buckets of grams of level ``m``."""

    def send(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text_row in left.itertuples():
            x = _Batch(text_row, right, model, m - 1)
            x.ask(m)
            a = x.asked
            edges = np.searchsorted(a["bucket"], np.arange(model.buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[b], edges[b + 1])
                rows.append((int(text_row.batch), b, *(squeeze(a[c][own], c == "h") for c in ("h", "w", "n", "ln", "lh", "hn"))))
        return pd.DataFrame(rows, columns=["batch", "bucket", "h", "w", "n", "ln", "lh", "hn"])

    return texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(send, MESSAGES)


def _merged(sent: DataFrame, least: int, k: int) -> DataFrame:
    """One row for each bucket: its distinct grams with their counts, and which of them each batch asked for; the
    partitioned table of counts."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("batch")
        h = [expand(v, True) for v in frame["h"]]
        sizes = np.array([len(v) for v in h])
        h = np.concatenate(h)
        w, n, ln, lh, hn = (np.concatenate([expand(v) for v in frame[c]]) for c in ("w", "n", "ln", "lh", "hn"))
        order, new = sorted_by(h, w)
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        count = np.bincount(at, weights=n, minlength=len(first)).astype(np.int64)
        count[count < least] = 0
        # a batch's grams are sorted like the table, so their places rise
        asked, start = [], 0
        for size in sizes:
            asked.append(squeeze(at[start : start + size], True))
            start += size
        kept = count[count > 0]
        return pd.DataFrame(
            [(int(frame["bucket"].iloc[0]), squeeze(h[first], True), squeeze(ln[first]), squeeze(lh[first]), squeeze(hn[first]), squeeze(count), frame["batch"].tolist(), asked, _counts_of_counts(kept, k))],
            columns=["bucket", "h", "ln", "lh", "hn", "count", "batches", "asked", "totals"],
        )

    return sent.groupBy("bucket").applyInPandas(
        merge, "bucket int, h binary, ln binary, lh binary, hn binary, count binary, batches array<long>, asked array<binary>, totals array<long>"
    )


def _history_sums(row, model: _Model, m: int):
    h, ln, lh, hn, count = expand(row.h, True), expand(row.ln), expand(row.lh), expand(row.hn), expand(row.count)
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    p = np.where(count > 0, conditional(count, hn, model.d[m]), 0.0)
    lower = np.where(count > 0, model.lower(m, ln, lh), 0.0)
    sums = (np.add.reduceat(v, new) if len(new) else np.zeros(0) for v in (p, lower))
    return h, new, count, hn, *sums, model.parts(m, h[new], hn[new]) > 1


def _wide_sums(table: DataFrame, model: _Model, m: int) -> DataFrame:
    """``bucket, sums``: whole sums of the histories that are dealt to several buckets, for each bucket that holds some.

    A history has a row for each of its buckets, about its count by ``hot``: a few for each bucket in all.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                h, new, _, _, seen, lower, wide = _history_sums(row, model, m)
                yield pd.DataFrame({"h": h[new][wide], "bucket": row.bucket, "seen": seen[wide], "lower": lower[wide]})

    rows = materialise(table.select("bucket", "h", "ln", "lh", "hn", "count").mapInPandas(part, "h long, bucket int, seen double, lower double"))
    whole = rows.groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("lower").alias("lower"))
    both = rows.select("h", "bucket").join(whole, "h")
    return both.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("h", "seen", "lower"))).alias("sums"))


def _replies(table: DataFrame, model: _Model, m: int, with_ids: bool, broadcast_buckets: int = 100_000) -> DataFrame:
    """For each batch and bucket: counts (negative where the history lends mass as a whole, 0 if not kept), log10 bow
    where they are 0, and ids of the frequent ones."""

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples():
                h, new, count, hn, seen, lower, wide = _history_sums(row, model, m)
                if wide.any():
                    whole = {int(s["h"]): (s["seen"], s["lower"]) for s in row.sums}
                    for i in np.flatnonzero(wide):
                        seen[i], lower[i] = whole[int(h[new[i]])]
                lends = 1 - seen < 1e-9
                rest = np.where(lends, 1 / (hn[new] + 1.0), 1 - seen)
                # without kept grams all of the mass goes to the lower level
                bow = np.where(seen > 0, np.log10(np.maximum(rest, 1e-300) / np.maximum(1 - lower, 1e-300)), 0.0)
                sizes = np.diff(np.r_[new, len(h)])
                bow, signed = np.repeat(bow, sizes), np.where(np.repeat(lends, sizes), -count, count)
                ids = np.full(len(count), -1, dtype=np.int64)
                often = np.flatnonzero(count >= model.min_count)
                ids[often[np.lexsort((often, -count[often]))]] = np.arange(len(often)) * model.buckets + row.bucket
                for batch, asked in zip(row.batches, row.asked):
                    at = expand(asked, True)
                    c = signed[at]
                    made = squeeze(ids[at[np.abs(c) >= model.min_count]]) if with_ids else None
                    yield pd.DataFrame({"batch": [batch], "level": [m], "bucket": [row.bucket], "c": [squeeze(c)], "bow": [squeeze(bow[at[c == 0]])], "ids": [made]})

    sums = materialise(_wide_sums(table, model, m))
    sums = F.broadcast(sums) if sums.count() <= broadcast_buckets else sums
    rows = table.select("bucket", "h", "ln", "lh", "hn", "count", "batches", "asked").join(sums, "bucket", "left")
    return rows.mapInPandas(answer, REPLIES)


def katz_scores(docs: DataFrame, training: Column, order: int = 3, k: int = 5, batch_tokens: int = 800_000, bucket_tokens: int = 2_000_000, min_count: int = 2) -> DataFrame:
    """Scores of all ``docs`` under the model of ``order`` words learned from the rows where ``training`` holds:
    ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score``.

    Grams of three words or more are kept from ``min_count`` on: 1 keeps all, 2 leaves out those seen once.
    """
    if min_count not in (1, 2):
        raise ValueError("min_count must be 1 or 2")
    chars = docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0
    buckets = 1 << max(3, (chars // 6 // bucket_tokens).bit_length())
    sent = keep_bucketed(_batches(docs, training, order, buckets, batch_tokens), "batch", max(8, -(-chars // (6 * batch_tokens))))
    texts = sent.where("kind = 0")
    words = materialise(_word_table(sent.where("kind = 1").select("batch", "bucket", "a", "b"), buckets, k))

    def totals(rows: DataFrame) -> list[int]:
        return [int(v or 0) for v in rows.select(*[F.sum(F.get("totals", F.lit(i))).alias(f"t{i}") for i in range(k + 3)]).first()]

    total, distinct, *n = totals(words.where("batch = -1"))
    long = [int(v or 0) for v in texts.select(*[F.sum(F.get("learned", F.lit(j))).alias(f"l{j}") for j in range(order)]).first()]
    # tokens that start a text have the start for history: one for each learned text
    starts = long[0] - long[1] if order > 1 else 0
    model = _Model(_Unigrams(total, distinct, {r + 1: v for r, v in enumerate(n)}, k), starts, buckets, max(1, total // (4 * buckets)), min_count)
    replies = words.where("batch >= 0").drop("totals")
    for m in range(2, order + 1):
        table = materialise(_merged(_asked(texts, replies, model, m), kept_from(m, min_count), k))
        held, _, *n = totals(table)
        if kept_from(m, min_count) > 1:  # what is not kept occurs once
            n[0] = long[m - 2] - held
        model.d[m] = good_turing({r + 1: v for r, v in enumerate(n)}, k)
        replies = replies.unionByName(materialise(_replies(table, model, m, with_ids=m < order)))
        discard(table)
    floor = np.log10(total + distinct + 1)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        for text_row in left.itertuples():
            x = _Batch(text_row, right, model, order, scored=True)
            base = np.log10(x.seen + 1.0) - floor
            base, logs, known = (np.add.reduceat(v, x.first) for v in (base, x.logs, (x.seen > 0).astype(np.int64)))
            made.append(
                pd.DataFrame(
                    {"doc_id": pd.Series(list(text_row.ids), dtype=object), "learned": x.train, "n_tokens": x.sizes, "n_known": known, "train_tokens": total, "base_score": base, "score": logs}
                )
            )
        return pd.concat(made)

    scored = texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInPandas(
        score, "doc_id string, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def op2_katz_lm(spark, sf_dir: str) -> DataFrame:
    """Log probabilities of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scores = katz_scores(docs, ~held)
    return scores.select("doc_id", (~F.col("learned") & F.col("doc_id").isNotNull()).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
