"""Token-ID output: ids in ascending order of the document id, as independent Huffman-coded blocks.

One range shuffle deals encoded documents to files in id order; global counts of ids come from the blocks
themselves; the code table has one entry for each id of the vocabulary. A block can be read by itself: it holds
its documents' ids and lengths, the bit stream, and the bit offset of every 256th token.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from providerfx.llm import blocks as B
from providerfx.llm import huffman as H
from providerfx.llm.tokens import encoder

BLOCK_TOKENS = 1 << 20
RAW = "part int, seg int, n_tokens long, docs binary, lens binary, seen binary, times binary, ids binary"
FILE = "part int, seg int, n_tokens long, docs binary, lens binary, marks binary, payload binary"


#: Stands for a null id, which comes before all others.
LOWEST = np.iinfo(np.int64).min


def split_points(df: DataFrame, key: str, n: int) -> list[int]:
    """n-1 ascending split points of a long column, from quantiles (a sketch, mergeable); a value of many rows is several of them."""
    if n < 2:
        return []
    return sorted(df.agg(F.percentile_approx(F.coalesce(key, F.lit(int(LOWEST))), [k / n for k in range(1, n)], 20 * n)).head()[0] or [])


def encode_blocks(df: DataFrame, tokenizer: str, end_id: int | None, points: list[int]) -> DataFrame:
    """RAW rows: documents of one range of ids, in order, in segments of about BLOCK_TOKENS."""
    edges = np.array(points, np.int64)

    def encoded(batches):
        def tables():
            for b in batches:
                enc = encoder(tokenizer)
                for lo in range(0, b.num_rows, 2048):
                    s = b.slice(lo, 2048)
                    ids, offs = enc.encode(s.column("text"))
                    n = np.diff(offs)
                    if end_id is not None:
                        out = np.full(len(ids) + len(n), end_id, np.uint32)
                        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                        ids, n = out, n + 1
                    doc = s.column("doc_id")
                    d = doc.fill_null(LOWEST).to_numpy()
                    first, last = (np.searchsorted(edges, d, side) for side in ("left", "right"))
                    # an id that is several split points has the parts between them to itself, and the last
                    part = (last - np.arange(len(d)) % np.maximum(last - first, 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part), doc, pa.array([x.view(np.uint8).tobytes() for x in np.split(narrow(ids), np.cumsum(n)[:-1])], pa.large_binary())], names=["part", "doc_id", "ids"])

        yield from B.packer(tables())

    def laid_out(key, table):
        t = B.from_ipc(table["blob"].to_pylist())
        t = t.take(pc.sort_indices(t, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))
        docs = t["doc_id"].combine_chunks()
        data, lens = t["ids"].combine_chunks(), pc.binary_length(t["ids"]).to_numpy() // WIDTH
        rows, lo, total = [], 0, np.cumsum(lens)
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_TOKENS, "right")))
            raw = b"".join(data[lo:hi].to_pylist())
            seen, times = np.unique(np.frombuffer(raw, f"<u{WIDTH}"), return_counts=True)
            rows.append((key[0].as_py(), len(rows), int(lens[lo:hi].sum()), B.to_ipc(pa.table({"doc_id": docs[lo:hi]})), lens[lo:hi].astype(np.int64).tobytes(), seen.astype(np.uint32).tobytes(), times.astype(np.int64).tobytes(), zipped(raw)))
            lo = hi
        return B.table_of(rows, ["part", "seg", "n_tokens", "docs", "lens", "seen", "times", "ids"], [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5])

    dealt = df.mapInArrow(encoded, B.BLOCK).repartition(len(points) + 1, "part")
    return dealt.groupBy("part").applyInArrow(laid_out, RAW)


#: Bytes of an id before it is coded.
WIDTH = 4


def narrow(ids: np.ndarray) -> np.ndarray:
    return ids.astype(f"<u{WIDTH}")


def zipped(raw: bytes) -> bytes:
    return pa.Codec("zstd", 1).compress(np.frombuffer(raw, np.uint8).reshape(-1, WIDTH).T.tobytes(), asbytes=True) if raw else b""


def unzipped(blob: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(blob, n * WIDTH, asbytes=True) if n else b""
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(WIDTH, -1).T.tobytes(), f"<u{WIDTH}").astype(np.int64)


def global_counts(raw: DataFrame) -> np.ndarray:
    """Occurrences of each id; what reaches the driver is bounded by the vocabulary."""

    def summed(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for seen, times in zip(b.column("seen").to_pylist(), b.column("times").to_pylist()):
                i, n = np.frombuffer(seen, np.uint32), np.frombuffer(times, np.int64)
                if len(i) and i[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(int(i[-1]) + 1 - len(total), np.int64)])
                total[i] += n
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["id", "n"])

    rows = raw.select("seen", "times").mapInArrow(summed, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_token_file(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = None) -> None:
    """Write `path`/blocks and `path`/lengths (the code length of each id, which fixes the canonical codes).

    A null text is encoded as an empty one. Rows with a null id come first; rows that share an id, or have none, stand in
    any order, each with its own ids, and very many of them are spread over several parts. Other columns are not written. An empty df gives files without blocks.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    raw_path = f"{path}/raw"
    B.write_plain(encode_blocks(docs, tokenizer, end_id, split_points(docs, "doc_id", B.parts_of(docs, "text"))), raw_path)
    raw = spark.read.schema(RAW).parquet(raw_path)
    lengths = H.code_lengths(global_counts(raw))

    def coded(batches):
        codes = H.canonical(lengths)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                payload, marks = H.pack(unzipped(r["ids"], r["n_tokens"]), codes, lengths)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seg"]], pa.int32()), pa.array([r["n_tokens"]]), *(pa.array([x], pa.binary()) for x in (r["docs"], r["lens"], marks.tobytes(), payload))], names=["part", "seg", "n_tokens", "docs", "lens", "marks", "payload"])

    B.write_plain(raw.drop("seen", "times").mapInArrow(coded, FILE), f"{path}/blocks", compression="none")
    B.write_plain(spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1), f"{path}/lengths")
    B.drop_path(spark, raw_path)


def read_token_file(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or ids_crc32 for ids; start: ids of all documents before it."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").head()[0], np.uint8)
    blocks = spark.read.schema(FILE).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each of the files
    before = np.concatenate([[0], np.cumsum([r["n"] for r in parts])]).tolist()
    starts = spark.createDataFrame([(r["part"], before[k]) for k, r in enumerate(parts)], "part int, before long")
    w = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    place = blocks.select("part", "seg", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("inner")).join(starts, "part").select("part", "seg", (F.col("before") + F.col("inner")).alias("start"))
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")

    def decoded(batches):
        table = H.decode_table(lengths, H.canonical(lengths))
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                ids = H.unpack(r["payload"], np.frombuffer(r["marks"], np.uint64), r["n_tokens"], table)
                docs, n = B.from_ipc([r["docs"]])["doc_id"].combine_chunks(), np.frombuffer(r["lens"], np.int64)
                offs = np.concatenate([[0], np.cumsum(n)])
                last = pa.array([zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(offs, offs[1:])], pa.int64()) if digest else pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(offs[:-1] + r["start"]), pa.array(n), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return blocks.join(place, ["part", "seg"]).mapInArrow(decoded, schema)
