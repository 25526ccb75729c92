"""Token-ID output: flat unsigned integer files with 64-bit document offsets, written in ascending id order.

Documents are range-partitioned by id; each task encodes its range and writes one shard:

- ``.bin``: token ids, little-endian, unsigned 16-bit if every id of the vocabulary fits, else unsigned 32-bit;
- ``.idx``: the 8 bytes ``TRTOKIX1``, then as little-endian 64-bit integers the bytes per id, the number of documents n, n ids and n + 1 offsets.

The manifest, a Parquet table beside them, has a row per shard with its files, counts and base: the number of ids in all
shards before it, a prefix sum over shards. A document starts at base + offset. Shard names carry a fresh suffix for each
attempt and only those that the manifest names count, so lost executors, retries and speculative tasks are harmless.

Reading maps the .bin into memory where the folder is local and reads a whole shard where it is not.

Defined cases: null and empty texts are the end id alone; null ids come first and are stored as the least 64-bit integer, so a
real id of that value comes back as null; a very long text is encoded whole by one task, in memory for its pieces and ids;
rows of one id are ordered by a hash of their text; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trestle.llm._common import partitions

MAGIC, NULL_ID = b"TRTOKIX1", -(1 << 63)
#: A single space between two characters that are no white space: the byte-level pattern always starts a new piece there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s\s")
#: Pieces that a worker remembers; once it has so many, the ones it meets later, which are rare, are forgotten after each batch.
CACHE_PIECES = 400_000


class Encoder:
    """Encodes texts with a tokenizers file; each worker process keeps one.

    A byte-level pattern tokenizer without normaliser gives the same ids when a text is cut before single spaces, so
    those pieces are encoded once and remembered. Any other tokenizer gets whole texts.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        top = self.tokenizer.get_vocab_size()
        self.dtype, self.code = (np.dtype("<u2"), "H") if top <= 1 << 16 else (np.dtype("<u4"), "I")
        conf = json.loads(spec)
        pre = conf.get("pre_tokenizer") or {}
        self.by_piece = (
            not conf.get("normalizer") and not conf.get("truncation") and not conf.get("padding")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in conf.get("added_tokens") or [])
        )
        self.id_bytes = np.zeros(top, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.id_bytes[i] = len(token)
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str], lead: str) -> Iterator[tuple[str, bytes]]:
        """The ids of pieces that follow lead. Plain ones are encoded some thousand at a time in one text and told apart by the bytes that each id stands for."""
        plain = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()] if lead else []
        apart = set(pieces).difference(plain) if lead else pieces
        groups = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        coded = self.tokenizer.encode_batch_fast([lead + lead.join(g) for g in groups], add_special_tokens=False) if groups else []
        for group, encoding in zip(groups, coded, strict=True):
            ids = np.array(encoding.ids, self.dtype)
            ends = np.cumsum(self.id_bytes[ids])
            stops = np.cumsum([len(p.encode()) + 1 for p in group])
            cuts = np.searchsorted(ends, stops)
            if not (ends[cuts] == stops).all():
                raise ValueError("a token spans two words: this is no byte-level pattern tokenizer")
            flat, cuts = ids.tobytes(), ((cuts + 1) * self.dtype.itemsize).tolist()
            yield from zip(group, [flat[i:j] for i, j in zip([0, *cuts], cuts, strict=False)], strict=True)
        apart = list(apart)
        yield from zip(apart, self._bytes([lead + p for p in apart]), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of the file's integer type."""
        if not self.by_piece:
            return self._bytes(texts)
        cut = [_CUT.split(t) if _RUN.search(t) else t.split(" ") for t in texts]
        passing: list[tuple[dict[str, bytes], list[str]]] = []
        for cache, lead, new in ((self.first, "", {c[0] for c in cut}), (self.later, " ", set().union(*cut))):
            missing = list(new.difference(cache))
            if len(cache) > CACHE_PIECES:
                passing.append((cache, missing))
            cache.update(self._pieces(missing, lead))
        later = self.later.__getitem__
        out = [self.first[c[0]] + b"".join(map(later, c[1:])) for c in cut]
        for cache, missing in passing:
            for p in missing:
                del cache[p]
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to out_dir, each followed by end_id, and return the manifest, read from its table."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file of the driver; tasks get its content
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(partitions(spark), F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "tie").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), _encoder(spec.value)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        width = encoder.dtype.itemsize
        fs, root = pafs.FileSystem.from_uri(out_dir)
        name, ids, sizes, out = f"shard-{shard:06d}-{uuid.uuid4().hex}", [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.bin")
            ids.append(b.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
            texts = b.column("text").to_pylist()
            for i in range(0, len(texts), 1000):
                coded = [x + end for x in encoder.encode(texts[i : i + 1000])]
                sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)) // width)
                out.write(b"".join(coded))
        if out is not None:
            out.close()
            all_ids, all_sizes = np.concatenate(ids), np.concatenate(sizes)
            offsets = np.concatenate(([0], np.cumsum(all_sizes)))
            with fs.open_output_stream(f"{root}/{name}.idx") as idx:
                idx.write(MAGIC + np.array([width, len(all_ids)], "<i8").tobytes() + all_ids.astype("<i8").tobytes() + offsets.astype("<i8").tobytes())
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(all_ids)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], names=["shard", "name", "n_docs", "n_tokens"])

    written = ranged.mapInArrow(write, "shard int, name string, n_docs bigint, n_tokens bigint")
    path = f"{out_dir}/written"
    written.write.parquet(path)
    shards = spark.read.schema(written.schema).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, as many as partitions
    shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.parquet(f"{out_dir}/manifest")
    return read_manifest(spark, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema("shard int, name string, n_docs bigint, n_tokens bigint, base bigint").parquet(f"{out_dir}/manifest")


def _mapped(fs: pafs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    """A flat integer file: mapped into memory if it is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, out_dir: str, batch_ids: int = 4 << 20) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit)."""
    shards = read_manifest(spark, out_dir)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        for row in (r for b in batches for r in b.to_pylist()):
            with fs.open_input_file(f"{root}/{row['name']}.idx") as f:
                raw = f.read()
            width, n = np.frombuffer(raw, "<i8", 2, 8).tolist()
            if raw[:8] != MAGIC or n != row["n_docs"]:
                raise ValueError(f"{row['name']}.idx is not the index that the manifest names")
            ids, offsets = np.frombuffer(raw, "<i8", n, 24), np.frombuffer(raw, "<i8", n + 1, 24 + 8 * n)
            tokens = _mapped(fs, f"{root}/{row['name']}.bin", np.dtype(f"<u{width}"))
            i = 0
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + batch_ids)) - 1)
                block = tokens[offsets[i] : offsets[j]].astype("<u4").tobytes()
                cuts = ((offsets[i : j + 1] - offsets[i]) * 4).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(block)])
                doc = pa.array(ids[i:j], pa.int64(), mask=ids[i:j] == NULL_ID)
                yield pa.record_batch([doc, pa.array(row["base"] + offsets[i:j]), pa.array(np.diff(offsets[i : j + 1])), binary], names=["doc_id", "start", "n_tokens", "ids"])
                i = j

    return shards.repartition(partitions(spark)).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
