"""Prefix trie of conversations, rolled up by centroid decomposition.

A node is a distinct sequence of first turns. Its name is (smallest member, depth), so the trie needs no string of
turns: each turn becomes a SHA-256 of role and text, and each prefix a polynomial of those modulo 2^127 - 1.
Positions and prefix digests are running values over ranges of (conversation, order); a conversation that spans
ranges is continued by what its earlier ranges carry over, one row for each range, so none needs one task.

Subtree sums come from a centroid decomposition of the parent-edge forest. The rows below a node, members times
turns left, are known when nodes are grouped; they are the weights. The deepest node that holds more than
half of its component's weight is the centroid. It is cut out: each branch below it becomes a component, the rest above keeps
its top, and the total of what hung on the centroid is added along the path from there to the top. Which nodes are on that
path, and to which branch a node goes, is one lookup in the conversations' own paths, whatever the depth. Weights
halve at each level. Components of at most ``max_nodes`` are decomposed the same way inside tasks.

Defined results: a null role or text is empty, a null turn comes first; turns that tie are taken in the order of their digests;
repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; an empty table
gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise

#: A prefix of turns t1 .. tn has the digest sum of t_i * BASE^(n - i) modulo PRIME.
PRIME = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix of turns").digest()[:15], "big")
_CHUNK = 1 << 20  # characters of joined ids that go through the shuffle as one row


def turn_tokens(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``token`` (digest of role and text) and ``n_bytes`` of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", token.alias("token"), F.octet_length(text).cast("long").alias("n_bytes"))


def _carries(edges: list) -> dict[int, tuple[int, bytes]]:
    """What each range continues: length and digest of the earlier part of its first conversation."""
    parts: dict[int, dict] = {}
    for r in edges:
        side = parts.setdefault(r["__part"], {})
        if r["__edge"] & 1:
            side["first"] = r["conv_id"]
        if r["__edge"] & 2:
            side |= {"last": r["conv_id"], "n": r["__n"], "digest": int.from_bytes(r["__digest"], "big"), "whole": r["__edge"] & 4}
    out, conv, n, digest = {}, None, 0, 0
    for part in sorted(parts):
        side = parts[part]
        if conv == side["first"] and n:
            out[part] = (n, digest.to_bytes(16, "big"))
        if side["whole"] and conv == side["first"]:
            digest = (digest * pow(BASE, side["n"], PRIME) + side["digest"]) % PRIME
            n += side["n"]
        else:
            conv, n, digest = side["last"], side["n"], side["digest"]
    return out


def running(df: DataFrame, order: list[str]) -> DataFrame:
    """Add to the rows of each ``conv_id`` their ``pos`` from 1 in ``order``, ``digest`` of the tokens up to them and
    ``before``, that of the tokens before them."""
    added = "__part int, __edge int, __n long, __digest binary, __before binary"
    schema = T.StructType(df.schema.fields + T.StructType.fromDDL(added).fields)
    names = schema.names

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, n, digest, held, first = TaskContext.get().partitionId(), None, 0, 0, None, True
        runs = 0
        for batch in batches:
            if not len(batch):
                continue
            ns, digests, befores, edges = [], [], [], []
            for c, token in zip(batch.column("conv_id").to_pylist(), batch.column("token").to_pylist()):
                if c != conv or not runs:
                    conv, n, digest, runs = c, 0, 0, runs + 1
                befores.append(digest.to_bytes(16, "big"))
                n, digest = n + 1, (digest * BASE + int.from_bytes(token, "big")) % PRIME
                ns.append(n)
                digests.append(digest.to_bytes(16, "big"))
                edges.append(8 if runs == 1 else 0)  # the run that earlier ranges may continue into
            edges[0] |= 1 if first else 0
            first = False
            if held is not None:
                yield held
            held = pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(ns), pa.int32()), pa.array(edges, pa.int32()), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(befores, pa.binary())],
                names=names,
            )
        if held is not None:
            edges = held.column("__edge").to_pylist()
            edges[-1] |= 2 | (4 if runs == 1 else 0)
            yield held.set_column(names.index("__edge"), "__edge", pa.array(edges, pa.int32()))

    kept = materialise(df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).mapInArrow(local, schema))
    # at most two rows for each range
    carries = _carries(kept.where("__edge & 3 > 0").select("__part", "__edge", "conv_id", "__n", "__digest").collect())
    out_schema = T.StructType(df.schema.fields + T.StructType.fromDDL("pos long, digest binary, before binary").fields)

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = len(out_schema) - 3
        for batch in batches:
            rest = [batch.column("__n"), batch.column("__digest"), batch.column("__before")]
            parts, edges = batch.column("__part").to_pylist(), batch.column("__edge").to_pylist()
            if any(p in carries and e & 8 for p, e in zip(parts, edges)):
                rows = [list(x) for x in zip(*(c.to_pylist() for c in rest))]
                for row, p, e in zip(rows, parts, edges):
                    if p in carries and e & 8:
                        n, digest = carries[p][0], int.from_bytes(carries[p][1], "big")
                        for i, k in ((1, row[0]), (2, row[0] - 1)):
                            row[i] = ((digest * pow(BASE, k, PRIME) + int.from_bytes(row[i], "big")) % PRIME).to_bytes(16, "big")
                        row[0] += n
                rest = [pa.array(x, c.type) for x, c in zip(zip(*rows), rest)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *rest], names=out_schema.names)

    return kept.mapInArrow(continued, out_schema)


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, convs)``: tokens of each conversation rebuilt from its family's first turns and its own later ones.

    The first h turns come from conversation c - c % 5, the rest from c itself; h is the unsigned CRC-32 of c's digits modulo 9.
    ``rows``: conv_id, depth, token, n_bytes, length; ``convs``: conv_id, length, turnless ones included.
    """
    ranked = materialise(running(turn_tokens(turns), ["turn", "token"]).drop("digest", "before"))
    own = ranked.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = materialise(
        own.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("length"))
    )
    first = ranked.where("pos <= 8").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "token", "n_bytes")
    shared = first.join(convs, "base").where("depth <= h")
    later = ranked.join(convs, "conv_id").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "depth", "token", "n_bytes", "length"]
    return shared.select(*columns).unionByName(later.select(*columns)), convs.select("conv_id", "length")


def _totals(parent: list[int], values: list[tuple]) -> list[list[int]]:
    """Subtree sums of one component by centroid decomposition; parents stand before their children, the top first."""
    out = [list(v) for v in values]
    size, branch = [0] * len(parent), [-1] * len(parent)
    work = [list(range(len(parent)))]
    while work:
        nodes = work.pop()
        if len(nodes) == 1:
            continue
        top = nodes[0]
        for i in nodes:
            size[i] = 1
        for i in reversed(nodes[1:]):
            size[parent[i]] += size[i]
        z = next(i for i in reversed(nodes) if 2 * size[i] > len(nodes))
        above, below, total = [], {}, list(values[z])
        for i in nodes:
            branch[i] = -1
            if i == z:
                continue
            p = parent[i] if i != top else -1
            branch[i] = i if p == z else branch[p] if p >= 0 else -1
            if branch[i] < 0:
                above.append(i)
            else:
                below.setdefault(branch[i], []).append(i)
                total = [a + b for a, b in zip(total, values[i])]
        out[z] = [o + t - v for o, t, v in zip(out[z], total, values[z])]
        i = z
        while i != top:
            i = parent[i]
            out[i] = [o + t for o, t in zip(out[i], total)]
        work += [x for x in [above, *below.values()] if x]
    return out


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], max_nodes: int = 4096) -> DataFrame:
    """``conv_id``, ``depth`` and the sum of each of ``values`` over each node's subtree.

    ``nodes``: conv_id, depth (together the name), parent_conv_id (null at a top), weight (all of the subtree) and ``values``.
    ``paths``: owner and parent_owner, the conv_ids of the node and of its parent, at each (conv_id, depth) of a conversation.
    """
    raw, acc = [f"__raw{i}" for i in range(len(values))], [f"__acc{i}" for i in range(len(values))]
    top = ["__top", "__top_depth"]
    tops = nodes.where("parent_conv_id is null").limit(2).collect()
    if len(tops) != 1:
        raise ValueError("the nodes must have one root")
    state = nodes.select(
        "conv_id", "depth", "parent_conv_id", F.col("weight").cast("decimal(38,0)").alias("weight"),
        *[F.lit(tops[0][c]).cast("long").alias(t) for c, t in zip(("conv_id", "depth"), top)],
        *[F.col(v).alias(r) for v, r in zip(values, raw)], *[F.col(v).alias(a) for v, a in zip(values, acc)],
    )
    small, used = None, []
    look = paths.select(F.col("conv_id").alias("__conv"), F.col("depth").alias("__depth"), F.col("owner").alias("__owner"), F.col("parent_owner").alias("__parent"))
    while True:
        state = materialise(state)
        used.append(state)
        big = state.groupBy(*top).agg(F.count(F.lit(1)).alias("__n"), F.max("weight").alias("__total")).where(F.col("__n") > max_nodes)
        heavy = state.join(big, top).where("2 * weight > __total").groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "weight")).alias("__z"))
        heavy = materialise(heavy.select(*top, F.col("__z.conv_id").alias("__zc"), F.col("__z.depth").alias("__zd"), F.col("__z.weight").alias("__zw")))
        used.append(heavy)
        rest = state.join(heavy, top, "left_anti")
        small = rest if small is None else small.unionByName(rest)
        if heavy.isEmpty():
            break
        # one lookup: deeper nodes ask for their own branch below the centroid, higher ones whether they are above it
        deeper = F.col("depth") > F.col("__zd")
        asked = state.join(heavy, top).withColumns(
            {"__c": F.when(deeper, F.col("conv_id")).when(F.col("depth") < F.col("__zd"), F.col("__zc")), "__d": F.when(deeper, F.col("__zd") + 1).otherwise(F.col("depth"))}
        )
        found = asked.join(look, (F.col("__c") == F.col("__conv")) & (F.col("__d") == F.col("__depth")), "left")
        is_z = (F.col("conv_id") == F.col("__zc")) & (F.col("depth") == F.col("__zd"))
        # the root is on no conversation's path, but a top is above all of its component
        is_top = (F.col("conv_id") == F.col("__top")) & (F.col("depth") == F.col("__top_depth"))
        above = is_top | (~deeper & (F.col("__owner") == F.col("conv_id")))
        role = F.when(is_z, 0).when(deeper & (F.col("__parent") == F.col("__zc")), 1).when(above, 2).otherwise(3)
        marked = materialise(found.withColumn("__role", role).drop("__c", "__d", "__conv", "__depth", "__parent"))
        used.append(marked)
        cut = marked.where("__role <= 1").groupBy(*top).agg(*[F.sum(r).alias(f"__t{i}") for i, r in enumerate(raw)])
        onto = F.col("__role").isin(0, 2)
        state = marked.join(cut, top).select(
            "conv_id", "depth", "parent_conv_id",
            F.when(F.col("__role") == 2, F.col("weight") - F.col("__zw")).otherwise(F.col("weight")).cast("decimal(38,0)").alias("weight"),
            F.when(F.col("__role") == 0, F.col("conv_id")).when(F.col("__role") == 1, F.col("__owner")).otherwise(F.col("__top")).alias("__top"),
            F.when(F.col("__role") == 0, F.col("depth")).when(F.col("__role") == 1, F.col("__zd") + 1).otherwise(F.col("__top_depth")).alias("__top_depth"),
            *raw,
            *[(F.col(a) + F.when(onto, F.col(f"__t{i}")).otherwise(0) - F.when(F.col("__role") == 0, F.col(raw[i])).otherwise(0)).alias(a) for i, a in enumerate(acc)],
        )
    schema = T.StructType.fromDDL("conv_id long, depth long, " + ", ".join(f"`{v}` long" for v in values))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, done = None, [], []

        def close() -> None:
            at = {(r[0], r[1]): i for i, r in enumerate(rows)}
            parent = [at.get((r[2], r[1] - 1), -1) if i else -1 for i, r in enumerate(rows)]
            own = [r[5 : 5 + len(raw)] for r in rows]
            for r, total, v in zip(rows, _totals(parent, own) if len(rows) > 1 else own, own):
                done.append((r[0], r[1], *[a + t - x for a, t, x in zip(r[5 + len(raw) :], total, v)]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(schema)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.names)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[3:5] != key:
                    if rows:
                        close()
                    key, rows = r[3:5], []
                rows.append(r)
            if done:
                yield flush()
        if rows:
            close()
        yield flush()

    # a component has at most max_nodes nodes
    together = small.select("conv_id", "depth", "parent_conv_id", *top, *raw, *acc).repartition(*top).sortWithinPartitions(*top, "depth", "conv_id")
    out = materialise(together.mapInArrow(inside, schema))
    discard(*used)
    return out


def _id_digests(ends: DataFrame) -> DataFrame:
    """``owner``, ``depth`` and SHA-256 of the decimal conv_ids of each node, ascending and joined by commas.

    Ranges of ids are joined to strings first, so that the hash of a node of many ends reads few long rows, one at a time.
    """
    schema = "owner long, depth long, first long, ids string"

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, done = None, [], 0, []
        for batch in batches:
            for owner, depth, c in zip(*(x.to_pylist() for x in batch.columns)):
                if (owner, depth) != key or size > _CHUNK:
                    if ids:
                        done.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids, size = (owner, depth), [], 0
                ids.append(c)
                size += 20
            if done:
                yield _rows(done, schema)
                done = []
        if ids:
            done.append((*key, ids[0], ",".join(map(str, ids))))
        yield _rows(done, schema)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for owner, depth, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if (owner, depth) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield _rows(done, out)
                done = []
        if key:
            done.append((*key, state.hexdigest()))
        yield _rows(done, out)

    out = "owner long, depth long, ends_sha256 string"
    joined = ends.select("owner", "depth", "conv_id").repartitionByRange("owner", "depth", "conv_id").sortWithinPartitions("owner", "depth", "conv_id").mapInArrow(chunks, schema)
    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(hashes, out)


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def build_trie(rows: DataFrame, convs: DataFrame, max_nodes: int = 4096) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, depth from 1 without gaps, token, n_bytes, length) of ``convs`` (conv_id, length).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    The depth-th turn of conversation conv_id is the node's last turn.
    """
    steps = materialise(running(rows, ["depth"]).drop("token", "pos"))
    whole = convs.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length").cast("decimal(38,0)") + 1).alias("w")).first()
    spark = rows.sparkSession
    root = spark.createDataFrame([(whole["c"], 0, None, whole["n"], 0, whole["w"])] if whole["n"] else [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_bytes long, weight decimal(38,0)")
    groups = materialise(
        steps.groupBy("depth", "digest").agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("n_bytes").alias("n_bytes"), F.first("before").alias("before"),
            F.sum((F.col("length") - F.col("depth") + 1).cast("decimal(38,0)")).alias("weight"),
        )
    )
    # the root's children know their parent; the others meet theirs
    parents = groups.select(F.col("digest").alias("before"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    first = groups.where("depth = 1").withColumn("parent_conv_id", F.lit(whole["c"]).cast("long"))
    deeper = groups.where("depth > 1").join(parents, ["depth", "before"])
    named = materialise(first.unionByName(deeper).drop("before"))
    owners = named.select("depth", "digest", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("parent_owner"))
    paths = materialise(steps.join(owners, ["depth", "digest"]).select("conv_id", "depth", "owner", "parent_owner", (F.col("depth") == F.col("length")).alias("ends")))
    nodes = named.drop("digest").unionByName(root.withColumn("weight", F.col("weight").cast(named.schema["weight"].dataType)))
    children = named.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialise(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes")))
    none = "conv_id long, depth long, n_leaves long, saved_tokens long"
    sums = rollup(nodes, paths, ["n_leaves", "saved_tokens"], max_nodes) if whole["n"] else spark.createDataFrame([], none)
    empty = convs.where("length = 0").select(F.lit(whole["c"]).cast("long").alias("owner"), F.lit(0).cast("long").alias("depth"), "conv_id")
    digests = _id_digests(paths.where("ends").select("owner", "depth", "conv_id").unionByName(empty)).withColumnRenamed("owner", "conv_id")
    done = nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(digests, ["conv_id", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    rows, convs = rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return build_trie(rows, convs)
