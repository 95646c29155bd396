"""Token identifiers of documents as binary files that can be read document by document.

A store is a folder of

* ``dictionary``: a zstandard dictionary, trained on serialised identifiers of a sample;
* ``<shard>.bin``: documents in ascending doc_id order, each compressed on its own with the dictionary;
* ``<shard>.idx``: of each document its doc_id, the place of its bytes and the number of identifiers before it;
* ``manifest.json``: the shards in order, each with its documents, identifiers, range of doc_id and place in the corpus.

Files begin with ``MAGIC``, the SHA-256 of the dictionary and the width of an
identifier (2 or 4 bytes, little-endian); readers refuse files of another
dictionary. A short document is read by its index entry: one range of bytes.

Spark orders the documents by range, each task encodes its range and writes
shards of bounded size, and the driver writes the manifest, one entry a shard,
once all tasks have committed. Names of shards are drawn anew by each attempt,
so a task that is lost or runs twice leaves at most files that no manifest
names; the commit deletes them. A store without a manifest can't be read.
Rows of one doc_id may go to several tasks and stay adjacent.

The dictionary is trained on ``sample_pieces`` pieces of ``PIECE`` identifiers
at most, of documents chosen by the hash of doc_id; it changes sizes, never results.

Results: null and empty texts are the closing identifier alone; documents of
null doc_id come first; repeated rows are stored each; other columns are
ignored; an empty table gives a store without shards, and no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .common import shared_dir, tokenizer_path
from .token_count import byte_symbols

MAGIC = b"SVLIDS1\n"
HEADER = len(MAGIC) + 32 + 1
#: Identifiers of a training piece of the dictionary.
PIECE = 1024
#: Bytes of text encoded at once.
BLOCK = 4 << 20
#: A space between other white space; there the pattern of byte-level vocabularies may reach across it.
INNER_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NO_SPACE = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: A Latin word, with the space before it. Byte-level vocabularies cut between its letters and a mark that isn't an apostrophe or a line end (before them, a single one).
LETTER, MARK = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]", "[!-&(-/:-@\\[-`{-~]"
WORD = re.compile(f" ?{LETTER}+")


class ChunkEncoder:
    """Identifiers of whole texts by the tokenizers library, little-endian 32-bit.

    A byte-level vocabulary's pattern takes a space with the word behind it,
    so texts are cut before spaces and the identifiers of a chunk are kept, up to
    ``bound`` chunks. Latin words end at marks and line ends, too, and new ones are
    encoded by the library's merges alone. Texts with special strings, or with a space inside other
    white space, go to the library whole.
    """

    def __init__(self, path: str, bound: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bound = bound
        self.chunks: dict[str, bytes] = {}
        self.merge, self.bytes = self.tokenizer.model.tokenize, byte_symbols()
        # Words end at marks where this pattern cuts texts that nothing has changed.
        spec = json.loads(self.tokenizer.to_str())
        cutter = spec["pre_tokenizer"] or {}
        self.cuts_simply = spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]

    @property
    def width(self) -> int:
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn_all(self, new: list[str]) -> None:
        """Add chunks: words by the library's merges alone, as the pattern doesn't cut them, others by all of its steps."""
        rest, chunks, merge, space = [], self.chunks, self.merge, self.bytes[32]
        chunks[""] = b""
        for chunk in filter(None, new):
            if not self.cuts_simply or not WORD.fullmatch(chunk):
                rest.append(chunk)
                continue
            symbols = chunk.replace(" ", space) if chunk.isascii() else "".join(map(self.bytes.__getitem__, chunk.encode()))
            chunks[chunk] = array("I", [t.id for t in merge(symbols)]).tobytes()
        if rest:
            self.learn(rest)

    def learn(self, new: list[str]) -> None:
        """Add chunks, encoded in one go with a special string between them."""
        if not self.marks:
            self.chunks.update((c, self.whole(c)) for c in new)
            return
        ids = np.array(self.tokenizer.encode_batch_fast([self.marks[0].join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.tokenizer.token_to_id(self.marks[0])) * 4
        raw = ids.tobytes()
        self.chunks.update(zip(new, map(raw.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)])), strict=True))

    def __call__(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Distinct chunks of all texts are looked up once; identifiers are gathered from theirs."""
        if len(self.chunks) > self.bound:
            self.chunks.clear()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        odd = pc.match_substring_regex(texts, INNER_SPACE)
        for mark in ["\0", *self.marks]:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        # Texts that go to the library whole, and null ones, have no words here.
        odd = pc.fill_null(odd, False)
        words = pc.replace_substring(pc.if_else(pc.or_(odd, pc.is_null(texts)), "", texts), " ", "\0 ")
        if self.cuts_simply:
            words = pc.replace_substring_regex(words, f"({LETTER})({MARK}|\n)", "\\1\0\\2")
            words = pc.replace_substring_regex(words, f"({MARK}|{NO_SPACE}\n)({LETTER})", "\\1\0\\2")
        words = pc.split_pattern(words, "\0")
        flat, bounds = words.flatten(), words.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        chunks, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        get = self.chunks.get
        known = list(map(get, chunks))
        if None in known:
            self.learn_all([c for c, x in zip(chunks, known, strict=True) if x is None])
            known = list(map(get, chunks))
        lengths = np.fromiter(map(len, known), np.int32, len(known)) // 4
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        n = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        at = np.repeat(starts[codes] - ends[:-1].astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        raw, cuts = np.frombuffer(b"".join(known), "<u4")[at].tobytes(), (4 * ends[bounds]).tolist()
        found = [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            found[i] = self.whole(texts[int(i)].as_py())
        return found


def blocks(batch: pa.RecordBatch, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (with a column text) in slices of about ``most`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if j > i:
            yield batch.slice(i, j - i)


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(vocabulary: str) -> ChunkEncoder:
    if vocabulary not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[vocabulary] = ChunkEncoder(tokenizer_path(vocabulary))
    return _ENCODERS[vocabulary]


def serialised(ids: bytes, width: int) -> bytes:
    """32-bit identifiers in ``width`` bytes each."""
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def widened(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")


def trained_dictionary(pieces: list[bytes], size: int) -> bytes:
    """A zstandard dictionary from serialised pieces; too few for training are the dictionary themselves."""
    if len(pieces) >= 64 and sum(map(len, pieces)) >= 8 * size:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    return b"".join(pieces)[-size:]


def codec_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_bytes(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as f:
        return f.read()


def write_bytes(store: fs.FileSystem, path: str, raw: bytes) -> None:
    with store.open_output_stream(path) as f:
        f.write(raw)


@dataclass
class Shard:
    name: str
    docs: int
    tokens: int
    first: int | None
    last: int | None
    start: int = 0


@dataclass
class Committed(WriterCommitMessage):
    partition: int
    shards: list[Shard]


class ShardFiles:
    """The open files of a shard; ``close`` writes its index."""

    def __init__(self, store: fs.FileSystem, folder: str, partition: int, header: bytes):
        self.store, self.header = store, header
        self.name = f"part-{partition:08d}-{uuid.uuid4().hex}"
        self.path = f"{folder}/{self.name}"
        self.file = store.open_output_stream(f"{self.path}.bin")
        self.file.write(header)
        self.ids, self.known, self.bytes, self.tokens = array("q"), bytearray(), array("Q", [HEADER]), array("Q", [0])

    def add(self, doc: int | None, frame: bytes, n: int) -> None:
        self.file.write(frame)
        self.ids.append(0 if doc is None else doc)
        self.known.append(doc is not None)
        self.bytes.append(self.bytes[-1] + len(frame))
        self.tokens.append(self.tokens[-1] + n)

    def close(self) -> Shard:
        self.file.close()
        write_bytes(self.store, f"{self.path}.idx", b"".join([self.header, len(self.ids).to_bytes(8, "little"), self.ids.tobytes(), bytes(self.known), self.bytes.tobytes(), self.tokens.tobytes()]))
        known = [i for i, k in ((self.ids[0], self.known[0]), (self.ids[-1], self.known[-1])) if k]
        return Shard(self.name, len(self.ids), self.tokens[-1], known[0] if len(known) == 2 else None, known[-1] if known else None)


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.vocabulary = options["path"], options["vocabulary"]
        self.closing, self.shard_bytes, self.level = int(options["closing"]), int(options["shardbytes"]), int(options["level"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        store, folder = place(self.path)
        raw = read_bytes(store, f"{folder}/dictionary")
        encode = chunk_encoder(self.vocabulary)
        compress = zstandard.ZstdCompressor(level=self.level, dict_data=codec_dictionary(raw)).compress
        header = MAGIC + hashlib.sha256(raw).digest() + bytes([encode.width])
        end = array("I", [self.closing]).tobytes()
        partition = TaskContext.get().partitionId()
        files, done = None, []
        for batch in iterator:
            for part in blocks(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text")), strict=True):
                    if files is None:
                        files = ShardFiles(store, folder, partition, header)
                    files.add(doc, compress(serialised(ids + end, encode.width)), len(ids) // 4 + 1)
                    if files.bytes[-1] >= self.shard_bytes:
                        done.append(files.close())
                        files = None
        if files is not None:
            done.append(files.close())
        return Committed(partition, done)

    def commit(self, messages: list[Committed | None]) -> None:
        store, folder = place(self.path)
        shards, start = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for shard in message.shards:
                shard.start, start = start, start + shard.tokens
                shards.append(vars(shard))
        named = {s["name"] for s in shards}
        for info in store.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith("part-") and info.base_name.rpartition(".")[0] not in named:
                store.delete_file(info.path)
        digest = hashlib.sha256(read_bytes(store, f"{folder}/dictionary")).hexdigest()
        manifest = {"dictionary_sha256": digest, "vocabulary": self.vocabulary, "closing_id": self.closing, "width": chunk_encoder(self.vocabulary).width, "tokens": start, "shards": shards}
        write_bytes(store, f"{folder}/manifest.json.new", json.dumps(manifest).encode())
        store.move(f"{folder}/manifest.json.new", f"{folder}/manifest.json")

    def abort(self, messages: list[Committed | None]) -> None:
        store, folder = place(self.path)
        for message in messages:
            for shard in message.shards if message is not None else []:
                for end in ("bin", "idx"):
                    store.delete_file(f"{folder}/{shard.name}.{end}")


@dataclass
class Index:
    """A shard's index: doc_ids (and which are known), places of bytes, identifiers before each document."""

    ids: np.ndarray
    known: np.ndarray
    bytes: np.ndarray
    tokens: np.ndarray

    @classmethod
    def read(cls, store: fs.FileSystem, path: str, header: bytes) -> Index:
        raw = read_bytes(store, path)
        if raw[:HEADER] != header:
            raise ValueError(f"{path} belongs to another dictionary")
        n, at, found = int.from_bytes(raw[HEADER : HEADER + 8], "little"), HEADER + 8, []
        for kind, length in (("<i8", n), ("u1", n), ("<u8", n + 1), ("<u8", n + 1)):
            found.append(np.frombuffer(raw, kind, length, at))
            at += found[-1].nbytes
        return cls(*found)


@dataclass
class TokenStore:
    """An opened store."""

    path: str
    store: fs.FileSystem = field(init=False)
    folder: str = field(init=False)

    def __post_init__(self):
        self.store, self.folder = place(self.path)
        self.manifest = json.loads(read_bytes(self.store, f"{self.folder}/manifest.json"))
        raw = read_bytes(self.store, f"{self.folder}/dictionary")
        if hashlib.sha256(raw).hexdigest() != self.manifest["dictionary_sha256"]:
            raise ValueError(f"{self.path}: the dictionary isn't the one that the documents were compressed with")
        self.width = self.manifest["width"]
        self.header = MAGIC + hashlib.sha256(raw).digest() + bytes([self.width])
        self.decompress = zstandard.ZstdDecompressor(dict_data=codec_dictionary(raw)).decompress
        self.shards = [Shard(**s) for s in self.manifest["shards"]]

    def index(self, shard: Shard) -> Index:
        return Index.read(self.store, f"{self.folder}/{shard.name}.idx", self.header)

    def documents(self, shard: Shard, wanted: set[int] | None = None, held: int = 8 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of a shard's documents, all or the wanted ones, about ``held`` bytes read at a time."""
        index = self.index(shard)
        rows = np.arange(len(index.ids)) if wanted is None else np.flatnonzero(np.isin(index.ids, list(wanted)) & (index.known > 0))
        with self.store.open_input_file(f"{self.folder}/{shard.name}.bin") as f:
            if f.read(HEADER) != self.header:
                raise ValueError(f"{shard.name}.bin belongs to another dictionary")
            base, block = HEADER, b""
            for i in rows:
                a, b = int(index.bytes[i]), int(index.bytes[i + 1])
                if b > base + len(block):
                    f.seek(a)
                    base, block = a, f.read(b - a if wanted is not None else max(b - a, held))
                ids = widened(self.decompress(block[a - base : b - base]), self.width)
                yield int(index.ids[i]) if index.known[i] else None, shard.start + int(index.tokens[i]), ids

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The identifiers of the documents of a doc_id, by index entries alone."""
        near = [s for s in self.shards if s.last is not None and s.last >= doc_id and (s.first is None or s.first <= doc_id)]
        return [ids for s in near for _, _, ids in self.documents(s, {doc_id})]


@dataclass
class ShardPartition(InputPartition):
    shard: Shard


class StoreReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names
        self.wanted: set[int] | None = None

    def partitions(self) -> list[ShardPartition]:
        shards = TokenStore(self.path).shards
        if self.wanted is not None:
            shards = [s for s in shards if s.last is not None and any(x <= s.last and (s.first is None or x >= s.first) for x in self.wanted)]
        return [ShardPartition(s) for s in shards] or [ShardPartition(Shard("", 0, 0, None, None))]

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        if not partition.shard.docs:
            return
        rows, size = [], 0
        for doc, start, ids in TokenStore(self.path).documents(partition.shard, self.wanted):
            values = {"doc_id": doc, "start": start, "n_tokens": len(ids)}
            if "ids_crc32" in self.names:
                values["ids_crc32"] = zlib.crc32(ids)
            if "ids" in self.names:
                values["ids"] = ids.astype(np.int64)
                size += len(ids)
            rows.append(values)
            if len(rows) >= 5000 or size > 1 << 20:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"ids": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in self.names], names=self.names)


class SelectiveReader(StoreReader):
    """A reader that answers equality with doc_ids by the indices: other shards and documents aren't read."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("doc_id",):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class TokenStoreSource(DataSource):
    """``format("token_store")``: documents are written from doc_id and text, and read as the columns of the schema given.

    Those are any of doc_id, start, n_tokens, ids_crc32 (all long) and ids (array<long>).
    """

    @classmethod
    def name(cls) -> str:
        return "token_store"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long"

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter({k.lower(): v for k, v in self.options.items()})

    def reader(self, schema) -> StoreReader:
        kind = SelectiveReader if self.options.get("pushdown") == "true" else StoreReader
        return kind(self.options["path"], schema.names)


def sampled_pieces(docs: DataFrame, vocabulary: str, pieces: int) -> list[bytes]:
    """At most ``pieces`` serialised pieces of the identifiers of documents chosen by the hash of doc_id."""
    total = docs.count()
    share = min(1.0, 2.0 * pieces / total) if total else 0.0
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(vocabulary)
        step = PIECE * 4
        for batch in rows:
            for part in blocks(batch):
                cut = [serialised(x[i : i + step], encode.width) for x in encode(part.column("text")) for i in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], names=["piece"])

    found = chosen.mapInArrow(batches, "piece binary").orderBy(F.xxhash64("piece"), "piece").limit(pieces)
    return [bytes(r.piece) for r in found.collect()]


def write_store(docs: DataFrame, path: str, *, vocabulary: str = "byte_bpe_50k.json", closing_id: int = 0, sample_pieces: int = 2000, dictionary_bytes: int = 65_536, level: int = 3, shard_bytes: int = 256 << 20, ranges: int | None = None) -> None:
    """Write the identifiers of ``docs`` (doc_id, text) and ``closing_id`` after each document as a store at ``path``.

    ``ranges``: of doc_id, written by one task each (default: Spark's shuffle partitions).
    """
    spark = docs.sparkSession
    store, folder = place(path)
    store.create_dir(folder, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    write_bytes(store, f"{folder}/dictionary", trained_dictionary(sampled_pieces(rows, vocabulary, sample_pieces), dictionary_bytes))
    # Rows of one doc_id may be very many: they are told apart by their place in the input.
    order = ["doc_id", "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    spark.dataSource.register(TokenStoreSource)
    options = {"path": path, "vocabulary": vocabulary, "closing": str(closing_id), "level": str(level), "shardBytes": str(shard_bytes)}
    dealt.select("doc_id", "text").write.format("token_store").options(**options).mode("append").save()


def read_store(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The documents of a store; ``schema``: the columns to read, as TokenStoreSource has them.

    Filters by doc_id are pushed into the reader where Spark allows that of Python sources.
    """
    spark.dataSource.register(TokenStoreSource)
    reader = spark.read.format("token_store").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.schema(schema) if schema else reader).load(path)


def stored_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from a new store in the shared folder."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write_store(docs, path, **options)
    return read_store(docs.sparkSession, path)
