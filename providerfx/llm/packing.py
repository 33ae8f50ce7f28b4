"""Sum-of-squares packing of token pieces into sequences of a fixed length.

Each piece goes where the sum over residual gaps of the squared number of open bins becomes smallest; a new bin is one
of the choices. Shards of a bounded number of pieces pack on their own, longest pieces first. Full bins stay; the
pieces of the bins that a level leaves open are packed again by fewer shards, as long as that takes fewer bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "item long, length long, bin long, base long, fill long"
#: Pieces that one task packs at most, about, and the fewest that are worth a task.
SHARD_ITEMS, LEAST_ITEMS = 20_000, 2_000
MOST_LEVELS = 16


def pieces(df: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and end_id, cut only if longer than `size`, the rest first."""

    B.small_batches(df.sparkSession)

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                s = b.slice(lo, 2048)
                ids, offs = encoder(tokenizer).encode(s.column("text"))
                docs, out = s.column("doc_id").to_pylist(), []
                for d, a, z in zip(docs, offs.tolist(), offs[1:].tolist()):
                    own = np.append(ids[a:z], np.uint32(end_id)).astype("<u4")
                    at, k = 0, 0
                    while at < len(own):
                        n = (len(own) % size or size) if not at else size
                        out.append((d, k, at, n, zlib.crc32(own[at : at + n].tobytes())))
                        at, k = at + n, k + 1
                yield from B.table_of(out, ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]).to_batches()
        encoder(tokenizer).reset()

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins; the longest items are placed first."""
    order = np.argsort(-lengths, kind="stable")
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)  # open bins by residual gap
    stack: list[list[int]] = [[] for _ in range(size + 1)]
    n = 0
    for i in order.tolist():
        s = int(lengths[i])
        # change of the sum of squares when a bin of gap g becomes one of gap g-s; an empty or a full bin counts nothing
        change = 1 - 2 * count[s:]
        change[1:] += 2 * count[1 : size - s + 1] + 1
        change[count[s:] == 0] = np.iinfo(np.int64).max
        k = int(np.argmin(change))
        if change[k] <= (2 * count[size - s] + 1 if s < size else 0):  # a new bin's; of equal ones an open bin is taken
            g = s + k
            b = stack[g].pop()
            count[g] -= 1
        else:
            g, b, n = size, n, n + 1
        bins[i], offset[i] = b, size - g
        if g > s:
            stack[g - s].append(b)
            count[g - s] += 1
    return bins, offset, n


def placed(items: DataFrame, shards: int, size: int, level: int) -> DataFrame:
    """(item, length) to PLACED: each shard packs its items."""

    def shard(key, table):
        order = np.argsort(table["item"].to_numpy(), kind="stable")
        lengths = table["length"].to_numpy()[order]
        bins, offset, n = sum_of_squares(lengths, size)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        first = (np.int64(level) << 58) + (np.int64(key[0].as_py()) << 24)
        return pa.table({"item": table["item"].take(pa.array(order)), "length": lengths, "bin": first + bins, "base": offset, "fill": fill[bins]})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(shard, PLACED)


def pack_sequences(items: DataFrame, size: int = 2048) -> DataFrame:
    """items (any columns, one of them `length`, 1 to size) with sequence_id and offset.

    Equal rows are items of their own. Lengths over `size` or below 1, or null, raise an error in the job. An
    empty df gives an empty result. Columns named sequence_id, offset or item are replaced.
    """
    spark = items.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.when((F.col("length") >= 1) & (F.col("length") <= size), F.col("length")).otherwise(F.raise_error(F.lit(f"a length is not in 1..{size}")).cast("long"))
    base = B.written(items.drop("sequence_id", "offset", "item").withColumn("length", length.cast("long")).withColumn("item", F.monotonically_increasing_id()), "items")
    left, settled, open_bins, n = base.select("item", "length"), [], None, base.count()
    for level in range(MOST_LEVELS):
        shards = max(1, -(-n // SHARD_ITEMS), min(most, n // LEAST_ITEMS))
        found = B.written(placed(left, shards, size, level), f"bins{level}")
        is_open = F.col("fill") < size
        bins, still_open, n = found.filter("base = 0").agg(F.count("*"), F.count(F.when(is_open, 1))).head() + found.filter(is_open).agg(F.count("*")).head()
        if open_bins is not None and bins >= open_bins[1]:  # the level before took no more bins
            settled.append(open_bins[0])
            break
        settled.append(found.filter(~is_open))
        open_bins, left = (found.filter(is_open), still_open), found.filter(is_open).select("item", "length")
        if not n:
            break
    else:
        settled.append(open_bins[0])
    total = settled[0]
    for more in settled[1:]:
        total = total.union(more)
    return base.join(total.select("item", F.col("bin").alias("sequence_id"), F.col("base").alias("offset")), "item").drop("item")


def pack_documents(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """PIECES with sequence_id and offset. A null text is packed as its end id alone; so is an empty one.

    Other columns are dropped; repeated rows and null ids are documents of their own; an empty df gives an empty result.
    """
    return pack_sequences(pieces(df, tokenizer, size, end_id, id_col, text), size)
