"""The trie of conversation prefixes, its counts gathered in node tables with minimal perfect hashes.

A prefix is named by a digest that grows with its turns, so every row of a conversation names one node and
distinct digests are the nodes. Nodes fall into levels by the logarithm of their members and into connected
parts of one level, which have less than 2 ** ``LEVEL_BITS`` nodes at each depth. Parts are dealt to shards; a shard gives
its digests slots by a minimal perfect hash, checks each slot against the digest in it, scatters counts into flat
arrays and adds them up through the array of parent slots, deepest nodes first. What the root of a part
has goes to its parent in a higher level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.common import saved

# The template of the rebuilt conversations: blocks of ids that share their first turns.
SHARED_BLOCK, SHARED_TURNS = 20, 4
# From one level to the next members grow by two to this power.
LEVEL_BITS = 10
SHARD_NODES = 100_000
LANES = ["s1", "s2", "s3", "s4"]
# Characters of one piece of a list of members.
PIECE = 1_000_000


class SlotTable:
    """A minimal perfect hash over distinct 16-byte digests: n digests get the slots 0 to n - 1.

    In each round the digests still without a slot are hashed to bits; those that are alone on their bit
    take it, the others go on to the next round. A slot is the rank of its bit over all rounds. The digest
    is kept at its slot, so a digest that was not put in is told from one that was.
    """

    def __init__(self, digests: np.ndarray, spread: float = 1.5):
        left, start, self.rounds = digests, 0, []
        self.kept = np.zeros((len(digests), 2), dtype=np.uint64)
        while len(left):
            bits = int(spread * len(left)) + 1
            at = self._hash(left, len(self.rounds), bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - alone + start
            won = alone[at]
            self.kept[rank[at[won]]] = left[won]
            self.rounds.append((bits, alone, rank))
            start, left = start + int(won.sum()), left[~won]
            if len(self.rounds) > 200:
                raise ValueError("equal digests")

    @staticmethod
    def _hash(digests: np.ndarray, turn: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = digests[:, 0] + np.uint64(2 * turn + 1) * (digests[:, 1] | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(bits)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are not in the table."""
        out = np.full(len(digests), -1, dtype=np.int64)
        for turn, (bits, alone, rank) in enumerate(self.rounds):
            open_ = np.flatnonzero(out < 0)
            at = self._hash(digests[open_], turn, bits)
            out[open_[alone[at]]] = rank[at[alone[at]]]
        if len(self.kept):
            out[(self.kept[out] != digests).any(axis=1)] = -1
        return out


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 2)


def _accumulated(table: pa.Table) -> pa.Table:
    """node, slot, n_leaves, saved_tokens of one shard: sums over each node's subtree."""
    nodes, parents = _digests(table["node"]), _digests(table["parent"])
    slots = SlotTable(nodes)
    at, up = slots.slots(nodes), slots.slots(parents)
    size = len(nodes)
    parent, depth = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    leaves, tokens = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    parent[at], depth[at] = up, np.asarray(table["depth"])
    leaves[at], tokens[at] = np.asarray(table["leaves"]), np.asarray(table["tokens"])
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for deep in np.split(order, cuts):
        np.add.at(leaves, parent[deep], leaves[deep])
        np.add.at(tokens, parent[deep], tokens[deep])
    return pa.table(
        {"node": table["node"], "slot": pa.array(at), "n_leaves": pa.array(leaves[at]), "saved_tokens": pa.array(tokens[at])}
    )


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Rows with running totals of long columns along each key (``sums``: new name to column).

    Rows are sorted by range, so a key with very many rows is spread over tasks: totals run within
    each partition first, and keys that go over several partitions, at most one or two for each
    partition, get what their earlier partitions add up to.
    """
    columns, names = list(sums.values()), list(sums)
    spread = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    spread = spread.withColumn("part", F.spark_partition_id())
    # One column with the place among the rows of a key and partition makes the totals readable later.
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in spread.schema] + [f"{n} bigint" for n in names])

    def totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros(len(columns), dtype=np.int64)
        for batch in batches:
            if not len(batch):
                continue
            keys = np.asarray(batch.column(key))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
            out = []
            for i, c in enumerate(columns):
                total = np.cumsum(np.asarray(batch.column(c)))
                before = np.concatenate([[0], total])[first]
                if keys[0] == last:
                    before[0] -= carried[i]
                out.append(total - before[place])
                carried[i] = out[-1][-1]
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, pa.int64()) for x in out)], names=[*batch.schema.names, *names]
            )

    local = saved(spread.mapInArrow(totalled, kinds), name)
    totals = local.groupBy(key, "part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    several = Window.partitionBy(key)
    before = several.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = totals.withColumn("_parts", F.count("*").over(several)).where("_parts > 1")
    starts = cut.select(key, "part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in names))
    # At most one key goes on from each partition to the next, so there are less than two rows for a partition.
    whole = local.join(F.broadcast(starts), [key, "part"], "left")
    return whole.select(*rows.columns, *((F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in names))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, content (digest of role and text), words of every row with a conversation id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = conversations.where("conv_id is not null")
    return rows.select("conv_id", "turn", F.unhex(content).alias("content"), words.cast("bigint").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, content, words) of the rebuilt conversations, and (conv_id) of all of them.

    Conversation c takes the first h = crc32(c) % 4 turns of conversation c - c % 20 and then its own turns after the
    first h. Only these first turns, at most three of a conversation, are copied to others.
    """
    numbered = running(turns.withColumn("one", F.lit(1).cast("bigint")), "conv_id", ["turn", "content"], {"n": "one"}, "turns")
    numbered = saved(numbered.drop("one", "turn"), "numbered-turns")
    convs = numbered.groupBy("conv_id").agg(F.max("n").alias("size"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).alias("h")
    convs = saved(convs.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % SHARED_BLOCK).alias("base"), taken), "convs")
    heads = numbered.where(F.col("n") < SHARED_TURNS).withColumnRenamed("conv_id", "base")
    shared = convs.drop("size").join(heads, "base").where("n <= h")
    shared = shared.select("conv_id", F.col("n").alias("depth"), "content", "words")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    # A base with fewer turns than h moves the conversation's own turns forward.
    moved = F.least("h", F.coalesce("base_size", F.lit(0))) - F.col("h")
    shifts = saved(convs.join(bases, "base", "left").select("conv_id", "h", moved.alias("shift")), "shifts")
    own = numbered.join(shifts, "conv_id").where("n > h")
    own = own.select("conv_id", (F.col("n") + F.col("shift")).alias("depth"), "content", "words")
    return shared.unionByName(own), convs.select("conv_id")


def _name(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *lanes)))


def members(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, words: one row for each prefix of each conversation, the root included.

    The digest of a prefix is four running sums of 32-bit hashes of (position, turn): each prefix has other
    summands, and a sum of any length can be taken up where another task has ended.
    """
    bits = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), F.col("content")), 256)
    lanes = {f"h{i}": F.conv(F.substring(bits, 8 * i - 7, 8), 16, 10).cast("bigint") for i in range(1, 5)}
    hashed = turns.withColumns(lanes).drop("content")
    chained = running(hashed, "conv_id", ["depth"], dict(zip(LANES, lanes, strict=True)), "prefixes")
    here = _name(F.col("depth"), [F.col(s) for s in LANES])
    above = _name(F.col("depth") - 1, [F.col(s) - F.col(h) for s, h in zip(LANES, lanes, strict=True)])
    rows = chained.select("conv_id", "depth", here.alias("node"), above.alias("parent"), "words")
    zero = F.lit(0).cast("bigint")
    root = convs.select(
        "conv_id", zero.alias("depth"), _name(zero, [zero] * 4).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("words")
    )
    return rows.unionByName(root)


def end_digests(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the sorted conversation ids that end at a node.

    A node may end a third of all conversations. Ids are sorted by range and joined to pieces of text in
    parallel; only pieces meet where they are hashed, one at a time.
    """
    depth = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node"))["node"].alias("node"))
    spread = depth.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])],
                names=["node", "first", "ids"],
            )

        for batch in batches:
            for here, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (here != node or size > PIECE):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    node, first = here, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def found(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())],
                names=["node", "ends_sha256"],
            )

        for batch in batches:
            done = []
            for here, ids in zip(batch.column("node"), batch.column("ids"), strict=True):
                if here.as_py() == node:
                    state.update(b"," + ids.as_py().encode())
                    continue
                if state:
                    done.append((node, state.hexdigest()))
                node, state = here.as_py(), hashlib.sha256(ids.as_py().encode())
            yield found(done)
        if state:
            yield found([(node, state.hexdigest())])

    joined = saved(spread.mapInArrow(pieces, "node binary, first bigint, ids string"), "end-pieces")
    alone = joined.repartition("node").sortWithinPartitions("node", "first")
    return alone.select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens: level by level from the fewest members to the most.

    The number of levels is the logarithm of the number of conversations, so a few turns do for any input.
    """
    counts = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
    extra, found = None, []
    for level in sorted(counts):
        here = nodes.where(F.col("level") == level)
        own = (F.col("n_convs") - 1) * F.col("words")
        leaf = (F.col("n_children") == 0).cast("bigint")
        if extra is None:
            here = here.withColumns({"leaves": leaf, "tokens": own})
        else:
            here = here.join(extra, "node", "left")
            here = here.withColumn("leaves", leaf + F.coalesce("more_leaves", F.lit(0)))
            here = here.withColumn("tokens", own + F.coalesce("more_tokens", F.lit(0)))
        shard = F.pmod(F.xxhash64("top"), F.lit(-(-counts[level] // SHARD_NODES)))
        parent = F.coalesce("parent", F.lit(bytes(16)))
        shards = here.select("node", parent.alias("parent"), "depth", "leaves", "tokens", shard.alias("shard"))
        summed = shards.groupBy("shard").applyInArrow(
            _accumulated, "node binary, slot bigint, n_leaves bigint, saved_tokens bigint"
        )
        summed = saved(summed, "subtree-sums")
        found.append(summed)
        tops = here.where("node = top and parent is not null").select("node", "parent").join(summed, "node")
        up = tops.select(F.col("parent").alias("node"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("t"))
        if extra is not None:
            higher = extra.join(here.select("node"), "node", "left_anti")
            up = up.union(higher.select("node", "more_leaves", "more_tokens"))
        extra = saved(up.groupBy("node").agg(F.sum("l").alias("more_leaves"), F.sum("t").alias("more_tokens")), "passed-up")
    out = nodes.where("false").selectExpr("node", "0L AS slot", "0L AS n_leaves", "0L AS saved_tokens")
    for other in found:
        out = out.union(other)
    return out.drop("slot")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first; rows of one number go by the digest of role and text, in whatever order they
    are stored, and repeated rows are repeated turns. Null roles and texts are empty. Rows without a conversation
    id belong to none and are left out. Other columns are ignored. An empty table has no conversations and
    gives no nodes.

    No step collects a key: conversations are sorted by range and numbered over partitions, counts of a node
    are added up before the shuffle, and the parts that a shard gets have less than 2 ** ``LEVEL_BITS`` nodes at each depth.
    """
    turns, convs = rebuilt(turn_digests(conversations))
    rows = saved(members(turns, convs), "prefix-rows")
    counted = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("words").alias("words"),
    )
    level = F.floor((F.length(F.bin("n_convs")) - 1) / LEVEL_BITS).cast("int")
    counted = saved(counted.withColumn("level", level), "node-counts")
    # Members never grow along a path, so the shallowest node of a level on any member's path is the top of the part.
    # The path of a node's smallest member is enough: prefixes of one level are taken from it.
    paths = rows.select("node", "conv_id", "depth").join(counted.select("node", "level"), "node")
    tops = saved(paths.groupBy("conv_id", "level").agg(F.min(F.struct("depth", "node"))["node"].alias("top")), "part-tops")
    children = counted.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = counted.join(tops, ["conv_id", "level"]).join(children.withColumnRenamed("parent", "node"), "node", "left")
    nodes = saved(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")

    parents = counted.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(subtree_sums(nodes), "node").join(parents, "parent", "left").join(end_digests(rows), "node", "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


TRIE_SQL = r"""
    WITH numbered AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT DISTINCT c, c - c % 20 AS base,
               xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
                   lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
                   lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
        FROM numbered),
    taken AS (
        SELECT convs.c, 0 AS part, n, role, text FROM convs JOIN numbered ON numbered.c = base WHERE n <= h
        UNION ALL SELECT convs.c, 1, n, role, text FROM convs JOIN numbered USING (c) WHERE n > h),
    paths AS (
        SELECT convs.c, coalesce(list({'role': role, 'text': text} ORDER BY part, n) FILTER (WHERE n IS NOT NULL), []) AS path
        FROM convs LEFT JOIN taken USING (c) GROUP BY convs.c),
    member AS (SELECT c, d, path[1:d] AS node, path[1:d - 1] AS parent, len(path) = d AS ends
               FROM paths, unnest(range(0, len(path) + 1)) u(d)),
    nodes AS (
        SELECT node, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
        FROM member GROUP BY node, d),
    costs AS (
        SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) END AS cost,
               (SELECT count(*) FROM nodes k WHERE k.d = nodes.d + 1 AND k.parent = nodes.node) AS n_children
        FROM nodes),
    sums AS (
        SELECT node[1:a] AS node, a AS d, sum(cost) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
        FROM costs, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
    SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves,
           s.saved::BIGINT AS saved_tokens, x.ends_sha256
    FROM costs x JOIN sums s ON s.node = x.node AND s.d = x.d LEFT JOIN nodes p ON p.d = x.d - 1 AND p.node = x.parent
"""
