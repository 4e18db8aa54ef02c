"""A trie of conversation prefixes: chained digests name the nodes, sums reach all ancestors along each conversation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, written
from .skew import join_groups

#: Bytes of a SHA-256 digest that name a turn or a prefix.
DIGEST = 16
#: Neighbouring ids that are joined to one string before a node's ids are hashed.
BLOCK = 4096
#: Conversations c - c % FAMILY to that plus FAMILY - 1 share first turns, LENT - 1 at most.
FAMILY, LENT = 20, 4


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, words): the turns of each conversation in order, from 1, with a digest of role and text.

    The texts themselves are never shuffled.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "words")


def with_shared_starts(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, digest, words): every conversation with the first turns of the first one of its family.

    Conversation c takes the first h turns of c - c % 20 in place of its own first h, h = crc32(c) % 4.  A row of part 0 without a
    digest stands for each conversation itself, so that those without turns are not lost.
    """
    h = lambda c: (F.crc32(c.cast("string").cast("binary")) % LENT).cast("int")
    c = F.col("conv_id")
    first = turns.where((c % FAMILY == 0) & (F.col("pos") < LENT)).groupBy(c.alias("base")).agg(F.collect_list(F.struct("pos", "digest", "words")).alias("lent"))
    convs = turns.select("conv_id").distinct().withColumn("base", c - c % FAMILY).join(first, "base", "left")
    none = F.lit(None)
    own = F.struct(F.lit(0).alias("part"), F.lit(0).alias("pos"), none.cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    lent = F.transform(F.filter("lent", lambda t: t["pos"] <= h(c)), lambda t: F.struct(F.lit(1).alias("part"), t["pos"].alias("pos"), t["digest"].alias("digest"), t["words"].alias("words")))
    starts = convs.select("conv_id", F.explode(F.concat(F.array(own), F.coalesce(lent, F.array().cast("array<struct<part:int,pos:int,digest:binary,words:bigint>>")))).alias("t")).select("conv_id", "t.*")
    return starts.unionByName(turns.where(F.col("pos") > h(c)).select("conv_id", F.lit(2).alias("part"), "pos", "digest", "words"))


def whole_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, digest, words): the conversations as they are, each with a row of part 0 for itself."""
    own = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(turns.select("conv_id", F.lit(2).alias("part"), "pos", "digest", "words"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, words, last): every prefix of every conversation, named by the digest of the one before and its last turn.

    A conversation streams through one task in order; nothing of it is held but the last digest.
    """
    order = Window.partitionBy("conv_id").orderBy("part", "pos")
    placed = rows.select("conv_id", (F.row_number().over(order) - 1).alias("depth"), "digest", "words", F.lead("part").over(order).isNull().alias("last"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = b""
        for batch in batches:
            out = []
            for turn in batch.column("digest").to_pylist():
                state = b"" if turn is None else hashlib.sha256(state + turn).digest()[:DIGEST]
                out.append(state)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), pa.array(out, pa.binary()), batch.column("words"), batch.column("last")], ["conv_id", "depth", "digest", "words", "last"])

    return placed.mapInArrow(chain, "conv_id long, depth int, digest binary, words long, last boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, owner, ends_sha256) of nodes where conversations end: their ids, joined by commas, are hashed block by block."""
    block = F.floor(F.col("conv_id") / BLOCK)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.where("last").groupBy("depth", "owner", block.alias("block")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for d, o, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "owner", "ids")), strict=True):
                if (d, o) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, o), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _end_batch(done)
            done = []
        if node is not None:
            yield _end_batch([(*node, state.hexdigest())])

    return blocks.repartition("depth", "owner").sortWithinPartitions("depth", "owner", "block").mapInArrow(digest, "depth int, owner long, ends_sha256 string")


def _end_batch(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*done, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["depth", "owner", "ends_sha256"])


def _own(name: str) -> Column:
    return F.coalesce(F.col(name) == F.col("conv_id"), F.lit(False))


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, part, pos, digest, words), one row each.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).  Prefixes with one depth and
    digest are a node; its least conversation owns it.  What a conversation owns is its last stretch of nodes: within it sums run from
    the end, and the total is dealt to every prefix above, so each node reaches all its ancestors through one row for each of its
    owner's prefixes, whatever the depth.  A hot node's rows meet it in salted parts.
    """
    every = written(prefixes(rows))
    nodes = written(every.groupBy("depth", "digest").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends")))
    joined = join_groups(every, nodes, ["depth", "digest"], "n_convs", ["conv_id"], every.count())
    met = written(joined.select("conv_id", every["depth"], "owner", "n_convs", "last", (F.col("n_ends") == F.col("n_convs")).alias("childless"), "words"))
    drop(every, nodes)
    upward = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    sofar = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = F.when(_own("owner"), (F.col("n_convs") - 1) * F.col("words")).otherwise(F.lit(0).cast("long"))
    summed = met.select(
        "conv_id", "depth", "owner", "n_convs",
        F.lag("owner").over(upward).alias("below"),
        F.lead("owner").over(upward).alias("above"),
        F.max((_own("owner") & F.col("last") & F.col("childless")).cast("long")).over(sofar).alias("leaf"),
        F.sum(saved).over(sofar).alias("saved"),
    )
    sums = summed.groupBy("depth", "owner").agg(
        F.min("above").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        F.sum(_own("below").cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    nothing = hashlib.sha256(b"").hexdigest()
    out = sums.join(_ends(met), ["depth", "owner"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing)))
    return out.select(F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, shared_starts: bool = False, **columns: str) -> DataFrame:
    """The trie of all conversations; with ``shared_starts``, after with_shared_starts().

    Turns go by number, null first; equal numbers by the digest of role and text.  Null roles and texts are empty.  Rows without
    a conv_id belong to no conversation.  Repeated rows are turns of their own.  Texts of any length are hashed where they are read.
    Other columns are not read.  An empty table has no conversations and so no nodes, not even a root.
    """
    turns = written(turns_of(conversations, **columns))
    out = trie(with_shared_starts(turns) if shared_starts else whole_conversations(turns))
    drop(turns)
    return out
