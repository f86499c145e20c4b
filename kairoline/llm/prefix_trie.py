"""The prefix trie of conversations, by partition refinement.

All conversations start in one class. Each round takes the next block of turns (8, then 16, 32, ...) of the conversations that
are still active, and splits their classes turn by turn: a class's name after a turn is the SHA-256 of its name before and the
turn's own SHA-256. Each class is a node. Counting a round's classes, summed before the shuffle, tells which hold one
conversation only: those are retired, and what is left of them is emitted in the end as a unary chain, whose numbers are known
without looking. Conversations that end aren't active any more either. Rounds end when no conversation is active, so their number
is the logarithm of the longest prefix that two conversations share.

The fold back gives each node sums over its subtree. A node is represented by its smallest conversation, which belongs to
all nodes above it too; so each conversation sums the weights of the nodes that it represents from its end upwards, and
each node sums what its members bring, before the shuffle. The hashes of the conversations that end at a node are built from
sorted lots of ids, streamed through the hash.

Many conversations may share a node: members are never gathered by node, only counted. A node with many children is joined with
these in parts; there are at most four such nodes for each shuffle partition, as all others have fewer than a quarter of a
partition's share of nodes. The turns of one conversation are numbered in buckets of 256 turns. A block's digests of one
conversation, 72 bytes a turn, are gathered in a task; texts never are.

Turns are ordered by turn (null first), then role, then text, so ties have one order; repeated rows are repeated turns. A null
role or text is the empty one. Rows without conv_id belong to no conversation and are left out. Other columns are not read.
An empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship

FIRST_BLOCK = 8
#: Turns of a conversation that are numbered in one place, and ids that are sorted in one.
BUCKET = 256
LOT = 4096
ROOT = bytes(32)

_TURN = "conv_id long, i long, label binary, parent binary, n_bytes long, last boolean"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (a turn's digest) and n_bytes of the text, of conv_id, turn, role, text."""
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    named = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    named = named.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    own = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return named.select("conv_id", "bucket", own.alias("own"), key.alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))


def _positions(rows: DataFrame) -> DataFrame:
    """rows of numbered(), written, with the sizes of a conversation's earlier buckets added."""
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, -1))
    later = sizes.withColumn("before", before).where(F.col("before").isNotNull()).select(F.col("conv_id").alias("_c"), F.col("bucket").alias("_b"), "before")
    joined = rows.join(later, (F.col("conv_id") == F.col("_c")) & F.col("bucket").eqNullSafe(F.col("_b")), "left")
    return joined.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "key", "n_bytes")


def _block(i: Column) -> Column:
    """The block of the i-th turn: number b has FIRST_BLOCK * 2**b turns."""
    return F.length(F.bin(F.floor((i - 1) / FIRST_BLOCK) + 1)) - 1


def _with_ends(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    return turns.join(lengths, "conv_id").select("conv_id", "i", "key", "n_bytes", (F.col("i") == F.col("n_turns")).alias("last"))


def plain(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, n_turns) and their turns (conv_id, i, key, n_bytes, last)."""
    at = scratch.write(_positions(scratch.write(numbered(turns))))
    convs = scratch.write(at.groupBy("conv_id").agg(F.max("pos").alias("n_turns")))
    return convs, _with_ends(at.withColumnRenamed("pos", "i"), convs)


def branched(turns: DataFrame, scratch: Scratch, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another one does, as plain() gives them: conversation c begins with the first
    crc32(c) % most turns of conversation c - c % every (fewer, where that has fewer, or none) and goes on with its own turns after
    as many."""
    at = scratch.write(_positions(scratch.write(numbered(turns))))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = at.where(F.col("pos") < most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "n_bytes"))).alias("head"))
    convs = at.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    lent = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    lent = lent.withColumn("head", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)).cast("int"))))
    taken = F.coalesce(F.array_size("head"), F.lit(0)).cast("long")
    lent = lent.withColumn("n_turns", taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).withColumn("shift", taken - F.col("h"))
    lent = scratch.write(lent.select("conv_id", "n_turns", "shift", "h", "head"))
    first = lent.select("conv_id", "n_turns", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("i"), "t.key", "t.n_bytes", (F.col("t.pos") == F.col("n_turns")).alias("last"))
    rest = at.where(F.col("pos") > h).join(lent.select("conv_id", "n_turns", "shift"), "conv_id").withColumn("i", F.col("pos") + F.col("shift"))
    rest = rest.select("conv_id", "i", "key", "n_bytes", (F.col("i") == F.col("n_turns")).alias("last"))
    return lent.select("conv_id", "n_turns"), first.unionByName(rest)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, label, and a block's turns in order -> the class after each turn."""
    names = ["conv_id", "i", "label", "parent", "n_bytes", "last"]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(2)
        turns, sizes = lists.flatten(), lists.value_lengths().to_numpy()
        keys = turns.field("key").to_pylist()
        labels, parents, at = [], [], 0
        for label, n in zip(batch.column(1).to_pylist(), sizes.tolist(), strict=True):
            for key in keys[at : at + n]:
                parents.append(label)
                label = hashlib.sha256(label + key).digest()  # noqa: PLW2901
                labels.append(label)
            at += n
        convs = pa.array(np.repeat(batch.column(0).to_numpy(), sizes))
        yield pa.RecordBatch.from_arrays([convs, turns.field("i"), pa.array(labels, pa.binary()), pa.array(parents, pa.binary()), turns.field("n_bytes"), turns.field("last")], names)


def _classes(rows: DataFrame) -> DataFrame:
    """The nodes of labelled turns: label, depth, conv_id, n_convs, n_ends, parent and n_bytes."""
    shared = (F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends"), F.min("parent").alias("parent"), F.min("n_bytes").alias("n_bytes"))
    return rows.groupBy("label", F.col("i").alias("depth")).agg(*shared)


class _Refined:
    """The rounds' outcome: labelled turns, their classes, and the conversations retired with the block they were retired in."""

    def __init__(self, convs: DataFrame, turns: DataFrame, scratch: Scratch):
        root = F.lit(ROOT)
        start = convs.select("conv_id", F.lit(0).cast("long").alias("i"), root.alias("label"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"), (F.col("n_turns") == 0).alias("last"))
        labelled, classes, retired = [start], [scratch.write(_classes(start))], []
        active = convs.where("n_turns > 0").select("conv_id", root.alias("label"))
        n = 0
        while True:
            end = FIRST_BLOCK * (2 ** (n + 1) - 1)
            block = turns.where(F.col("block") == n).join(active, "conv_id") if n else turns.where("block = 0").withColumn("label", root)
            held = block.groupBy("conv_id").agg(F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("i", "key", "n_bytes", "last"))).alias("turns"))
            rows = scratch.write(held.mapInArrow(_split, _TURN))
            found = scratch.write(_classes(rows))
            labelled.append(rows)
            classes.append(found)
            single = found.where("n_convs = 1").select("conv_id").distinct().withColumn("retired", F.lit(n))
            goes_on = rows.where((F.col("i") == end) & ~F.col("last")).select("conv_id", "label")
            retired.append(single)
            active = scratch.write(goes_on.join(single, "conv_id", "left_anti"))
            if not active.limit(1).count():
                break
            n += 1
        self.labelled, self.classes, self.retired = (_union(x) for x in (labelled, classes, retired))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, lot, ids (text), in order of label and lot -> label and the hash of all its ids, comma-joined."""
    label, digest = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if at == label:
                digest.update(b",")
            else:
                if label is not None:
                    done.append((label, digest.hexdigest()))
                label, digest = at, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([y for _, y in done])], ["label", "ends_sha256"])
    if label is not None:
        yield pa.RecordBatch.from_arrays([pa.array([label], pa.binary()), pa.array([digest.hexdigest()])], ["label", "ends_sha256"])


def _ends(rows: DataFrame) -> DataFrame:
    """label, ends_sha256: of the conversations that end at a node."""
    lots = rows.where("last").groupBy("label", F.floor(F.col("conv_id") / LOT).alias("lot")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return lots.repartition("label").sortWithinPartitions("label", "lot").mapInArrow(_hash_ends, "label binary, ends_sha256 string")


def _fold(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """label, n_children, n_leaves, saved_tokens. n_children counts those that are classes here."""
    own = classes.select("conv_id", F.col("depth").alias("i"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), "n_convs", "n_ends")
    brought = rows.select("conv_id", "i", "label").join(own, ["conv_id", "i"], "left")
    w = Window.partitionBy("conv_id").orderBy(F.desc("i"))
    # a leaf is a class whose members all end there; of a retired conversation the chain that is emitted later has one
    tip = (F.row_number().over(w) == 1) & ((F.col("n_ends") == F.col("n_convs")) | (F.col("n_convs") == 1))
    summed = brought.select("label", F.sum(F.coalesce("saved", F.lit(0))).over(w).alias("saved"), F.max(F.coalesce(tip, F.lit(False)).cast("long")).over(Window.partitionBy("conv_id")).alias("leaf"))
    children = classes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("label"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaf"), F.lit(1).alias("child"))
    both = summed.withColumn("child", F.lit(0)).unionByName(children)
    return both.groupBy("label").agg(F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _with_parents(nodes: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """nodes with parent_conv_id. Nodes with many children are joined in parts."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(16, total // (4 * parts))
    # fewer than total / share rows, at most 4 for each shuffle partition
    many = nodes.where(F.col("n_children") > share).select(F.col("label").alias("parent"), F.ceil(F.col("n_children") / share).alias("parts"))
    salted = nodes.join(F.broadcast(many), "parent", "left").withColumn("salt", F.pmod(F.xxhash64("label"), F.coalesce("parts", F.lit(1)))).drop("parts")
    above = nodes.where("n_children > 0").select(F.col("label").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_children") / share) - 1)).alias("salt"))
    return salted.join(above, ["parent", "salt"], "left")


def trie(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of conversations (conv_id, n_turns) and their turns (conv_id, i, key, n_bytes, last), as plain() or branched()
    give them: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(convs.sparkSession)
    turns = scratch.write(turns.withColumn("block", _block(F.col("i"))), "block")
    refined = _Refined(convs, turns, scratch)
    rows, classes, retired = refined.labelled, refined.classes, refined.retired
    total = classes.count()
    nodes = classes.join(_fold(rows, classes), "label").join(_ends(rows), "label", "left")
    # the child of a class of one may be in the chain that is emitted later
    children = F.when(F.col("n_convs") == 1, 1 - F.col("n_ends")).otherwise(F.col("n_children"))
    nodes = scratch.write(nodes.withColumn("n_children", children))
    none = hashlib.sha256().hexdigest()
    shared = _with_parents(nodes, classes, total).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    one = F.lit(1).cast("long")
    chains = turns.where("block > 0").join(retired, "conv_id").where(F.col("block") > F.col("retired"))
    chains = chains.select("conv_id", F.col("i").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), (one * 0).alias("saved_tokens"), F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return shared.select(*columns).unionByName(chains)


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text) as they are."""
    scratch = Scratch(turns.sparkSession, "trie")
    return trie(*plain(turns, scratch), scratch)
