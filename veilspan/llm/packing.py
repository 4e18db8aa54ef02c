"""Packing of token sequences: long texts are cut, pieces are placed by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import TEXT_BYTES, drop, written
from .tokens import flat, gathered, word_tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Pieces that one task packs at a time, and groups whose emptiest sequences meet at the next level.
SHARD, FAN_IN = 32_768, 4


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every text's ids followed by end_id, cut at each ``capacity`` ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        for batch in gathered(batches):
            ids, at = flat(batch.column(0)), 0
            for docs_ids in tokenizer.encode_all(flat(batch.column(1))):
                doc, piece, start, length, crc = [], [], [], [], []
                for own in docs_ids:
                    whole = np.append(own, np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(whole), capacity)):
                        part = whole[s : s + capacity]
                        doc.append(at)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                    at += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(rows, f"id {given.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class SumOfSquares:
    """Open bins by residual gap; an item goes where the sum of squared counts per gap becomes smallest.

    Items come longest first, and a new bin is opened only for an item that fits no open one: among bins with gap g,
    moving one to gap g - s changes the sum by 2 (n[g-s] - n[g] + 1), a perfect fit by 1 - 2 n[g].
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, new: int) -> int:
        """The bin that takes an item; ``new`` names a bin to open."""
        n = self.count
        change = 2 * (n[: self.capacity + 1 - size] - n[size:]) + 2
        change[0] = 1 - 2 * n[size]
        change[n[size:] == 0] = np.iinfo(np.int64).max
        gap = size + int(change.argmin())
        if n[gap]:
            bin_, n[gap] = self.bins[gap].pop(), n[gap] - 1
        else:
            bin_, gap = new, self.capacity
        left = gap - size
        if left:
            n[left] += 1
            self.bins[left].append(bin_)
        return bin_


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin (0, 1, ...) of each item; items are taken longest first."""
    order = np.argsort(-lengths, kind="stable")
    out, used, packer = np.empty(len(lengths), dtype=np.int64), 0, SumOfSquares(capacity)
    for i in order.tolist():
        size = int(lengths[i])
        if size >= capacity:
            out[i], used = used, used + 1
            continue
        out[i] = packer.place(size, used)
        used += out[i] == used
    return out


def _pack_group(capacity: int, carry: int):
    """Packs the pieces of one shard; of the sequences that stay open, the emptiest give back up to ``carry`` pieces."""

    def packed(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = shard["length"].to_numpy(np.int64)
        bins = pack_lengths(lengths, capacity)
        fill, size = np.bincount(bins, weights=lengths).astype(np.int64), np.bincount(bins)
        emptiest = np.argsort(fill, kind="stable")
        up = np.zeros(len(fill), dtype=bool)
        up[emptiest] = (np.cumsum(size[emptiest]) <= carry) & (fill[emptiest] < capacity)
        shard = shard.assign(bin=bins).sort_values("bin", kind="stable")
        ends = shard.groupby("bin", sort=False)["length"].cumsum()
        shard["offset"] = ends - shard["length"]
        shard["placed"] = ~up[shard["bin"].to_numpy()]
        shard["sequence"] = shard["bin"].astype("int64")
        return shard[["id", "piece", "start", "length", "ids_crc32", "shard", "sequence", "offset", "placed"]]

    return packed


def pack(pieces: DataFrame, capacity: int = 2048, shard_rows: int = SHARD, fan_in: int = FAN_IN) -> DataFrame:
    """Adds sequence_id and offset to rows of (id, piece, start, length, ids_crc32).

    Level by level: shards of about ``shard_rows`` pieces are packed on their own.  Most sequences are done then; the emptiest
    of each shard, with ``shard_rows / fan_in`` pieces at most, go to the next level, where ``fan_in`` shards form one,
    until one shard is left.  So no task holds more than about shard_rows pieces, whatever their lengths.  Pieces are dealt
    to shards by hash, so all shards have the same mix of lengths, and meeting again can gain little but for the emptiest.
    Rows are numbered first, so equal rows are dealt out as well.
    """
    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, shard long, sequence long, offset long, placed boolean"
    todo = written(pieces.withColumn("nr", F.monotonically_increasing_id()), TEXT_BYTES)
    shards, carry = max(1, -(-todo.count() // shard_rows)), max(1, shard_rows // fan_in)
    done, level = [], 0
    given = todo.withColumn("shard", F.pmod(F.xxhash64("nr", "piece", "ids_crc32"), F.lit(shards))).drop("nr")
    while True:
        got = written(given.groupBy("shard").applyInPandas(_pack_group(capacity, carry if shards > 1 else 0), schema))
        if not level:
            drop(todo)
        number = (F.lit(level).cast("long") * (1 << 58)) + F.col("shard") * (1 << 26) + F.col("sequence")
        done.append(got.where("placed").select("id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset"))
        if shards == 1:
            break
        level, shards = level + 1, -(-shards // fan_in)
        given = got.where("not placed").select("id", "piece", "start", "length", "ids_crc32", F.floor(F.col("shard") / fan_in).cast("long").alias("shard"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): every text's ids, ended by end_id, in sequences.

    A null or empty text is end_id alone.  Only texts over ``capacity`` ids are cut, into pieces of exactly that many
    and one last shorter one.  Repeated rows are packed as often as they occur; an empty table gives an empty result;
    columns other than id and text are not read.
    """
    return pack(token_pieces(docs, capacity, vocabulary, end_id, id_col, text_col), capacity, shard_rows).withColumnRenamed("id", id_col)
