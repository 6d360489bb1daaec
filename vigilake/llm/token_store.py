"""Token-id output: raw id shards with a minimal perfect hash index.

A store is a folder:

    data/shard-NNNNN.bin     ids as little-endian unsigned integers, documents one after
                             another in ascending id order; 16 bits an id where the
                             vocabulary has at most 65,536 ids, else 32
    data/shard-NNNNN.bounds  where each document of the shard starts and the last ends,
                             in ids, as little-endian unsigned 64-bit integers
    index/part-NNNNN.npz     for the keys of one hash part: the levels of a minimal
                             perfect hash with rank samples, and for its slots the
                             fingerprint, shard, offset, length and number of documents
    manifest/                Parquet, a row per shard: shard, n_docs, n_ids, start,
                             width (bytes an id), parts (of the index); written last

A document key is looked up in constant time: hash -> part -> slot -> fingerprint
check -> (shard, offset, length). Documents of one id stand next to each other, so an
id has one entry for each shard it reaches, however many documents it has: their
bounds are read from the shard. Files are written under a task's own name and then
renamed, so a task that is run again replaces them by equal ones.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilake.llm import bpe
from vigilake.llm.common import per_document
from vigilake.session import cut, scratch_path, ship

END_ID = 2
KEYS_PER_PART = 20_000
#: What the index holds of a run: the documents of one id in one shard.
RUN = ["fingerprint", "shard", "offset", "length", "ordinal", "n"]
RUN_KINDS = "shard int, offset long, length long, ordinal long, n long"
#: Documents and bytes that a reader gives out at a time.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def file_system(uri: str):
    """The file system and path of a URI, for tasks (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    if "://" not in uri:  # a local path, or Hadoop's short form file:/path
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str, name: str):
    """A stream into a file that gets its name only once it is whole."""
    store, base = file_system(uri)
    store.create_dir(base, recursive=True)
    own, target = f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"
    with store.open_output_stream(own) as f:
        yield f
    try:
        store.move(own, target)
    except OSError:  # some stores do not rename over a file
        store.delete_file(target)
        store.move(own, target)


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n-1. Each level is a bit array twice as long as
    the keys left; a key whose place no other key hits sets the bit and is done.
    Its slot is the number of bits set before its own: `levels` holds (size, words of
    64 bits, bits set before each word), so a slot is found in constant time."""

    levels: list[tuple[int, np.ndarray, np.ndarray]]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, base = [], np.unique(keys.astype(np.uint64)), 0
        while len(left):
            size = max(2 * len(left), 8)
            at = (mix64(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            padded = np.zeros(-(-size // 64) * 64, bool)
            padded[:size] = alone
            words = np.packbits(padded, bitorder="little").view("<u8").astype(np.uint64)
            counts = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            levels.append((size, words, base + np.r_[0, counts[:-1]]))
            base += int(counts[-1])
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; any slot or -1 for keys that were not built in."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        left = keys.astype(np.uint64)
        for n, (size, words, before) in enumerate(self.levels):
            at = mix64(left, n) % np.uint64(size)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = words[word] >> bit
            hit = (here & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (before[word] + np.bitwise_count(below))[hit]
            open_, left = open_[~hit], left[~hit]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        """What a file holds of it."""
        joined = lambda k: np.concatenate([x[k] for x in self.levels]) if self.levels else np.empty(0, np.uint64)
        return {"sizes": np.array([x[0] for x in self.levels], np.int64), "words": joined(1), "before": joined(2)}

    @classmethod
    def of(cls, sizes: np.ndarray, words: np.ndarray, before: np.ndarray) -> PerfectHash:
        ends = np.cumsum(-(-sizes // 64))[:-1]
        return cls(list(zip(sizes.tolist(), np.split(words, ends), np.split(before, ends), strict=True)))


def key_of(id_col: Column) -> Column:
    return F.xxhash64(F.coalesce(id_col.cast("string"), F.lit("")))


def fingerprint_of(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def write_store(docs: DataFrame, root: str, path: str | None = None, end_id: int = END_ID, keys_per_part: int = KEYS_PER_PART) -> DataFrame:
    """Encode `docs` (doc_id, text) into a store at `root`; returns its manifest.

    Null text has only the end id. Documents of equal id stand next to each other
    (ordered by a hash of the text, then by row, so that any number of equal rows is
    dealt over several shards) and are all found under that id. Null ids are one id,
    stored first; an empty table gives a store without shards.
    """
    spec = bpe.shared_spec(docs, path or bpe.default_path())
    width = bpe.id_width(spec.value, end_id)
    tail = np.array([end_id], f"<u{width}")

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(batches, None)
        if first is None:
            return
        c, shard, offset, ordinal, bounds = bpe.codec(spec.value), TaskContext.get().partitionId(), 0, 0, []
        with written(f"{root}/data", f"shard-{shard:05d}.bin") as f:
            for batch in chain([first], batches):
                lengths = []
                for pieces in c.encode(batch["text"].tolist()):
                    ids = [*pieces, tail]
                    lengths.append(sum(map(len, ids)))
                    for part in ids:
                        f.write(part.astype(tail.dtype).tobytes())
                ends = offset + np.cumsum(lengths, dtype=np.int64)
                bounds.append(ends - lengths)
                own = {"shard": np.int32(shard), "offset": ends - lengths, "length": np.array(lengths, np.int64)}
                yield pd.DataFrame({"key": batch["key"], "fingerprint": batch["fingerprint"], **own, "ordinal": ordinal + np.arange(len(lengths))})
                offset, ordinal = int(ends[-1]) if len(ends) else offset, ordinal + len(lengths)
        with written(f"{root}/data", f"shard-{shard:05d}.bounds") as f:
            f.write(np.concatenate([*bounds, [offset]]).astype("<u8").tobytes())

    tie = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    ordered = docs.select("doc_id", "text", key_of(F.col("doc_id")).alias("key"), fingerprint_of(F.col("doc_id")).alias("fingerprint"))
    ordered = ordered.withColumn("row", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(*tie).sortWithinPartitions(*tie).select("key", "fingerprint", "text")
    kinds = "key long, fingerprint long, shard int, offset long, length long, ordinal long"
    entries = cut(ordered.mapInPandas(shards, kinds), "entries")
    lowest = [F.min("offset").alias("offset"), F.sum("length").alias("length"), F.min("ordinal").alias("ordinal"), F.count("*").alias("n")]
    runs = cut(entries.groupBy("key", "fingerprint", "shard").agg(*lowest), "runs")
    parts = max(1, -(-runs.count() // keys_per_part))

    def index(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        keys = rows["key"].to_numpy(np.int64).view(np.uint64)
        hashed = PerfectHash.build(keys)
        slots = hashed.slots(keys)
        order = np.lexsort((rows["offset"], rows["shard"], slots))
        slots = slots[order]
        n = int(slots[-1]) + 1
        arrays = {k: rows[k].to_numpy()[order] for k in RUN}
        blob = io.BytesIO()
        np.savez(blob, first=np.searchsorted(slots, np.arange(n + 1)), **hashed.arrays(), **arrays)
        with written(f"{root}/index", f"part-{part:05d}.npz") as f:
            f.write(blob.getbuffer())
        return pd.DataFrame({"part": [part], "n": [n]})

    placed = runs.withColumn("part", F.pmod(F.col("key"), F.lit(parts)).cast("int"))
    placed.groupBy("part").applyInPandas(index, "part int, n long").agg(F.sum("n")).collect()
    totals = entries.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum("length").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    started = totals.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    started.withColumn("width", F.lit(width)).withColumn("parts", F.lit(parts)).write.parquet(f"{root}/manifest")
    return docs.sparkSession.read.parquet(f"{root}/manifest")


class IndexPart:
    def __init__(self, root: str, part: int):
        store, base = file_system(f"{root}/index")
        with store.open_input_file(f"{base}/part-{part:05d}.npz") as f, np.load(io.BytesIO(f.read())) as z:
            self.hash = PerfectHash.of(z["sizes"], z["words"], z["before"])
            self.first, self.runs = z["first"], {k: z[k] for k in RUN}

    def find(self, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among the keys, run) of every run whose fingerprint agrees."""
        slots = self.hash.slots(keys.view(np.uint64))
        known = np.flatnonzero(slots >= 0)
        lo, hi = self.first[slots[known]], self.first[slots[known] + 1]
        at = np.repeat(known, hi - lo)
        run = np.arange(len(at)) + np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) if len(at) else at
        same = self.runs["fingerprint"][run] == fingerprints[at]
        return at[same], run[same]


def lookup(ids: DataFrame, root: str) -> DataFrame:
    """(doc_id) -> (doc_id, shard, offset, length, ordinal, n): a row for each run of
    `n` documents stored under the id in a shard; ids that are not stored give none, ids
    asked for twice are answered once, a null id finds the documents stored under it, and
    an empty table or store gives an empty result."""
    spark: SparkSession = ids.sparkSession
    ship(spark)
    parts = (spark.read.parquet(f"{root}/manifest").select("parts").first() or [0])[0]
    kind = ids.schema["doc_id"].dataType.simpleString()

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        part = IndexPart(root, int(rows["part"].iloc[0]))
        at, run = part.find(rows["key"].to_numpy(np.int64), rows["fingerprint"].to_numpy(np.int64))
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[at]} | {k: part.runs[k][run] for k in RUN[1:]})

    if not parts:  # nothing is stored
        return spark.createDataFrame([], f"doc_id {kind}, {RUN_KINDS}")
    as_text = F.col("doc_id").cast("string").alias("doc_id")  # nulls beside them would turn long ids into floats
    keyed = ids.select(as_text, key_of(F.col("doc_id")).alias("key"), fingerprint_of(F.col("doc_id")).alias("fingerprint")).distinct()
    placed = keyed.withColumn("part", F.pmod(F.col("key"), F.lit(parts)).cast("int"))
    return placed.groupBy("part").applyInPandas(find, f"doc_id string, {RUN_KINDS}").withColumn("doc_id", F.col("doc_id").cast(kind))


class Shards:
    """The files of one store, one shard open at a time."""

    def __init__(self, root: str, width: int):
        self.store, self.base = file_system(f"{root}/data")
        self.width, self.shard, self.files = width, None, {}

    def _open(self, shard: int, kind: str):
        if shard != self.shard:
            self.close()
            self.shard = shard
        if kind not in self.files:
            self.files[kind] = self.store.open_input_file(f"{self.base}/shard-{shard:05d}.{kind}")
        return self.files[kind]

    def ids(self, shard: int, offset: int, length: int) -> np.ndarray:
        raw = self._open(shard, "bin").read_at(self.width * length, self.width * offset)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def spans(self, shard: int, offset: int, length: int, ordinal: int, n: int) -> Iterator[tuple[int, int]]:
        """(offset, length) of each document of a run, its bounds read part by part."""
        if n == 1:
            yield offset, length
            return
        for at in range(ordinal, ordinal + n, 10_000):
            many = min(10_000, ordinal + n - at)
            bounds = np.frombuffer(self._open(shard, "bounds").read_at(8 * (many + 1), 8 * at), "<u8").astype(np.int64)
            yield from zip(bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files = {}


def read_ids(found: DataFrame, root: str, digest: bool = False) -> DataFrame:
    """Runs, as `lookup` gives them, -> (doc_id, shard, offset, length) of each document
    with the ids read from the shards, or with their crc32 only (as unsigned 32-bit
    integers). Rows meet by shard, so that a shard is read forwards. An empty document
    has its end id only; repeated runs are read again; no runs give an empty result."""
    ship(found.sparkSession)
    width = (found.sparkSession.read.parquet(f"{root}/manifest").select("width").first() or [4])[0]
    last = "ids_crc32" if digest else "ids"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, out, size = Shards(root, width), [], 0
        table = lambda: pd.DataFrame(out, columns=["doc_id", "shard", "offset", "length", last])
        for batch in batches:
            for doc_id, *run in batch[["doc_id", "shard", "offset", "length", "ordinal", "n"]].itertuples(index=False):
                shard, *span = map(int, run)
                for offset, length in files.spans(shard, *span):
                    ids = files.ids(shard, offset, length)
                    out.append((doc_id, shard, offset, length, zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int32)))
                    size += 0 if digest else ids.nbytes
                    if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield table()
                        out, size = [], 0
        files.close()
        if out:
            yield table()

    more = "ids_crc32 long" if digest else "ids array<int>"
    dealt = found.repartition("shard").sortWithinPartitions("shard", "offset")
    return per_document(dealt, read, f"shard int, offset long, length long, {more}")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write `docs` to a store in the shared folder and report every document from
    its files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only; rows of equal id are all reported, and
    null ids are stored as one id, ordered first; an empty table gives an empty result.
    """
    root = scratch_path(docs.sparkSession, "tokens")
    manifest = write_store(docs, root, path)
    read = read_ids(lookup(docs.select("doc_id"), root), root, digest=True)
    start = F.broadcast(manifest.select("shard", "start"))  # a row per shard
    return read.join(start, "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), F.col("length").alias("n_tokens"), "ids_crc32")
