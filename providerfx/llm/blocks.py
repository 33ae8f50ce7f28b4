"""Documents in blocks: one shuffle deals compressed batches of rows to blocks, kept in the shared folder.

All later passes of an operator read the same blocks. A block holds about BLOCK_BYTES of text, however large the
input is. What passes exchange are rows of hashes that Spark counts: spread evenly over the hash space whatever the
texts are, each hash once from a block.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INFO = "part int, kind int, key int, blob binary"
BLOCK = "part int, blob binary"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and (d := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = d.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="providerfx-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/providerfx-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: For file: paths: no side files of checksums. Hadoop starts a shell for the rights of every file and side file there.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_plain(df: DataFrame, path: str, **options: str) -> None:
    df.write.options(**PLAIN, **{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}, **options).parquet(path)


#: Tables that written() made and nobody dropped.
_MADE: list[str] = []


def made() -> int:
    """How many tables there are now, for drop_made()."""
    return len(_MADE)


def drop_made(spark: SparkSession, first: int = 0) -> None:
    """Drop the tables that operators wrote since; for when their results are stored elsewhere."""
    while len(_MADE) > first:
        drop_path(spark, _MADE.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and free of its lineage."""
    path = new_path(df.sparkSession, name)
    _MADE.append(path)
    write_plain(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in the shared folder, dealt as it was: a plan without adaptive steps tells its partitioning."""
    spark = df.sparkSession
    shared_dir(spark)
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    own = {k: hadoop.get(k) for k in PLAIN}
    for k, v in PLAIN.items():
        hadoop.set(k, v)
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
        for k, v in own.items():
            hadoop.unset(k) if v is None else hadoop.set(k, v)


#: Bytes of text in a block, about, and in the smallest that are made to use all of a cluster.
BLOCK_BYTES, LEAST_BYTES = 24 << 20, 1 << 20
#: Most Spark partitions of blocks; beyond, a partition holds several blocks, one after another.
MOST_PARTITIONS = 50_000


def parts_of(df: DataFrame, text: str) -> int:
    """Blocks for df: by the bytes of its texts, which are summed first; with little text, as many as the cluster shuffles to."""
    spark = df.sparkSession
    small_batches(spark)
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).head()[0] or 0
    return max(1, -(-size // BLOCK_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES)))


def murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash of 32-bit integers (public Murmur3, seed 42), which deals rows to partitions."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(odd)
    return h ^ (h >> np.uint32(16))


def labels(n: int) -> np.ndarray:
    """n numbers for blocks such that a shuffle to n partitions gives each partition one of them; beyond MOST_PARTITIONS any."""
    tries = 4 * n
    while n <= MOST_PARTITIONS:
        at = murmur(np.arange(tries)).view(np.int32).astype(np.int64) % n
        found, first = np.unique(at, return_index=True)
        if len(found) == n:
            return first.astype(np.int32)
        tries *= 2
    return np.arange(n, dtype=np.int32)


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def release() -> None:
    """Give freed memory back: Python workers live on between tasks, beside each other and the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def from_ipc(blobs) -> pa.Table:
    """The rows of all batches; the same batches give the same order, whatever order they come in."""
    release()
    blobs = sorted(blobs) if len(blobs) > 1 else blobs
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in blobs]).combine_chunks()


#: Bytes of an Arrow batch, about, which the JVM holds outside its heap; texts are rows of any length.
BATCH_BYTES = 4 << 20
#: Bytes of rows that are packed together.
PACK_BYTES = 24 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of an Arrow batch to BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def packer(batches):
    """Rows with a column `part` to one compressed batch for each part and PACK_BYTES."""
    held, size = [], 0
    for b in batches:
        held, size = [*held, b], size + b.nbytes
        if size >= PACK_BYTES:
            yield from packed(held)
            held, size = [], 0
    yield from packed(held)


def packed(held):
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    release()
    part = table["part"].to_numpy()
    order = np.argsort(part, kind="stable")
    table, part = table.drop_columns(["part"]).take(pa.array(order)), part[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, z in zip(at.tolist(), [*at[1:].tolist(), len(part)]):
        yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([to_ipc(table.slice(a, z - a).combine_chunks())], pa.binary())], names=["part", "blob"])


def to_blocks(df: DataFrame, n: int) -> DataFrame:
    """Blocks (part, blob) of df, whose column `part` (0 to n-1) is dropped; checkpointed in the shared folder.

    part becomes a label that gives each block a partition of its own.
    """
    label = labels(n)

    def labelled(batches):
        for b in batches:
            k = b.schema.get_field_index("part")
            yield b.set_column(k, "part", pa.array(label[b.column(k).to_numpy()]))

    return checkpointed(df.mapInArrow(lambda batches: packer(labelled(batches)), BLOCK).repartition(min(n, MOST_PARTITIONS), "part"))


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df with its block: by a hash of the row's id and text, so that copies spread evenly."""
    return df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


def table_of(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


INFO_NAMES, INFO_TYPES = ["part", "kind", "key", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def info(rows: list[tuple]) -> pa.Table:
    return table_of(rows, INFO_NAMES, INFO_TYPES)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(part, keys) of the rows (part, keys, n) whose keys' n sum to two or more; each block gives a key once."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return rows.withColumn("total", total).filter("total > 1").select("part", *keys)


# --- counts of 48-bit keys, packed ----------------------------------------------------------------------------
#
# Where a pass counts nearly one key for each few bytes of text, rows would weigh more than the texts. A block sends
# one row for each bucket of the key space in which it has keys, so never more rows than keys.

KEY_BITS = 48


def bucket_bounds(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (equal ranges of the key space) that the sorted keys are in, and where each begins, with the end."""
    own = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    return own[at].astype(np.int64), np.append(at, len(keys))


def send_keys(part: int, keys: np.ndarray, times: np.ndarray, buckets: int) -> pa.Table:
    """INFO rows (bucket, 0, part, blob) of the sorted distinct keys and how often the block has each (65535 at most)."""
    own, at = bucket_bounds(keys, buckets)
    rows = []
    for k, lo, hi in zip(own.tolist(), at.tolist(), at[1:].tolist()):
        raw = np.ascontiguousarray(keys[lo:hi]).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8].tobytes()
        rows.append((k, 0, part, np.minimum(times[lo:hi], 65535).astype("<u2").tobytes() + raw))
    return info(rows)


def count_keys(table: pa.Table, hot: int) -> pa.Table:
    """One bucket's rows to (part, 0, bucket, blob): which of a block's keys occur twice or more in all, and which more than `hot` times."""
    sent = []
    for blob in table["blob"].to_pylist():
        n = len(blob) // (2 + KEY_BITS // 8)
        keys = np.zeros((n, 8), np.uint8)
        keys[:, : KEY_BITS // 8] = np.frombuffer(blob, np.uint8, n * KEY_BITS // 8, 2 * n).reshape(n, -1)
        sent.append((keys.view(np.uint64).ravel(), np.frombuffer(blob, "<u2", n)))
    keys, times = np.concatenate([k for k, _ in sent]), np.concatenate([t for _, t in sent]).astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.empty(len(keys), np.int64)
    total[order] = np.add.reduceat(times[order], first).repeat(np.diff(np.append(first, len(keys))))
    at, bucket = np.cumsum([0, *(len(k) for k, _ in sent)]), table["part"][0].as_py()
    return info([(p, 0, bucket, np.packbits(total[a:z] > 1).tobytes() + np.packbits(total[a:z] > hot).tobytes()) for p, a, z in zip(table["key"].to_pylist(), at, at[1:]) if (total[a:z] > 1).any()])


def key_answers(keys: np.ndarray, table: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur twice or more, and those of them that are hot, from a block's sorted keys and its answers."""
    own, at = bucket_bounds(keys, buckets)
    place = {k: (lo, hi) for k, lo, hi in zip(own.tolist(), at.tolist(), at[1:].tolist())}
    many, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    for k, blob in zip(table["key"].to_pylist(), table["blob"].to_pylist()):
        lo, hi = place[k]
        raw = np.frombuffer(blob, np.uint8)
        for out, half in zip((many, hot), np.split(raw, 2)):
            out[lo:hi] = np.unpackbits(half, count=hi - lo).astype(bool)
    return keys[many], keys[hot]


def sorted_unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each occurs."""
    v = np.sort(values)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return v[at], np.diff(np.append(at, len(v)))


def pairs_unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.diff(np.append(at, len(a)))


#: Bits of a value that look it up in a table of what may be there.
SIEVE_BITS = 22


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def sieve(among: np.ndarray) -> np.ndarray:
    """A table of the lowest bits of values, for sifted()."""
    seen = np.zeros(1 << SIEVE_BITS, bool)
    seen[among & np.uint64((1 << SIEVE_BITS) - 1)] = True
    return seen


def sifted(values: np.ndarray, among: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the values that are in the sorted array; most others are passed over by their lowest bits."""
    at = np.flatnonzero(seen[values & np.uint64((1 << SIEVE_BITS) - 1)])
    return at[member(values[at], among)]


def sifted_pairs(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) among the sorted pairs (first, second); a first value may stand with several second ones."""
    at = sifted(a, first, seen)
    found, going = np.zeros(len(at), bool), np.arange(len(at))
    k = np.searchsorted(first, a[at])
    while len(going):
        found[going] |= second[k] == b[at[going]]
        k += 1
        more = ~found[going] & (k < len(first))
        more[more] = first[k[more]] == a[at[going[more]]]
        going, k = going[more], k[more]
    return at[found]
