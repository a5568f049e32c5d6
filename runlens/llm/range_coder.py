"""Token ids in binary files: adaptive context mixing of order 0 to 2, and range coding in blocks that start anew."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import checkpoint_dir, ship, stored
from runlens.llm.tokens import byte_encoder, vocabulary_path

U = np.uint64
MAGIC = b"TIDS0002"
BLOCK = 1 << 20  # ids of a block; all its lanes share one set of tables, which starts empty
LANES, LEAST_STEPS = 4096, 64  # lanes of a block at most, and the ids that each has at least where there are so many
SCALE = 24  # a step of the coder shares out 2**24
ORDER0 = 18  # the order-0 distribution shares out 2**18
SLOTS = 18
LEVELS = 16  # confidence of a prediction
LEAST = 1 << 18  # weight that order 0 always has, so that each id has a part of one unit at least
TOP = U(1 << 32)
NULL = (1 << 32) - 1  # in place of a length: a null identifier


class _Mixer:
    """The model of one block, shared by its lanes, which hold consecutive stretches of the block and move side by side.

    Order 1 and 2 each predict one id, the last that followed the same one or two ids, with a confidence that grows
    with its hits in a row. How often the two have come true in this block at their joint confidence gives their
    weights; order 0 (counts of the block so far, renewed when the steps have doubled) has the rest of the weight. An
    id's part is the sum of what the three give it. All is integer arithmetic, so both sides see the same numbers.
    """

    def __init__(self, lanes: int, alphabet: int):
        self.alphabet = alphabet
        self.one = np.zeros(alphabet, np.int32)  # id * LEVELS + confidence; confidence 0: nothing seen
        self.two = np.zeros(1 << SLOTS, np.int32)
        self.last, self.last2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        kinds = 2 * LEVELS * LEVELS  # joint confidence, and whether the two agree
        self.hits = np.zeros(3 * kinds, np.int64)  # neither, order 1 alone, order 2
        self.kinds = kinds
        self.counts = np.zeros(alphabet, np.int64)
        self.seen: list[np.ndarray] = []
        self.steps, self.renew_at = 0, 1
        self._renew()

    def _renew(self) -> None:
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.alphabet)
        self.seen = []
        total, rest = int(self.counts.sum()), (1 << ORDER0) - self.alphabet
        size = 1 + (self.counts * rest) // total if total else np.ones(self.alphabet, np.int64)
        size[int(size.argmax())] += (1 << ORDER0) - int(size.sum())
        self.shares = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        self.holder = np.repeat(np.arange(self.alphabet, dtype=np.int32), size)  # the id of each unit of order 0

    def _weigh(self) -> None:
        """Weights of order 2 and 1 at each joint confidence, of 2**SCALE."""
        h = self.hits.reshape(3, self.kinds)
        n = h.sum(axis=0) + 2
        room = (1 << SCALE) - LEAST
        w2, w1 = (2 * h[2] + 1) * room // (2 * n), (2 * h[1] + 1) * room // (2 * n)
        half = self.kinds // 2
        w1[half:] = 0  # where they agree there is one prediction
        w2[0] = w2[half] = w1[0] = 0
        self.w2_of, self.w1_of = w2, w1

    def predict(self, k: int) -> None:
        """For the first k lanes: predicted ids p1, p2 and the weights w0, w1, w2, which add up to 2**SCALE."""
        if not self.steps & 3 or self.steps < 16:
            self._weigh()
        self.at1 = self.last[:k]
        self.at2 = ((self.at1 * 0x9E3779B1 + self.last2[:k]) * 0x2545F491 & 0xFFFFFFFF) >> (32 - SLOTS)
        e1, e2 = self.one[self.at1], self.two[self.at2]
        self.c1, self.c2 = e1 & (LEVELS - 1), e2 & (LEVELS - 1)
        self.p1, self.p2 = e1 >> 4, e2 >> 4
        self.kind = (self.c2 << 4) + self.c1 + (self.p1 == self.p2) * (LEVELS * LEVELS)
        self.w1, self.w2 = self.w1_of[self.kind], self.w2_of[self.kind]
        self.w0 = (1 << SCALE) - self.w1 - self.w2

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of each id's part of 2**SCALE."""
        low = self.shares[ids] * self.w0 >> ORDER0
        size = (self.shares[ids + 1] * self.w0 >> ORDER0) - low
        self.hit1, self.hit2 = self.p1 == ids, self.p2 == ids
        size += self.w1 * self.hit1 + self.w2 * self.hit2
        low += self.w1 * (self.p1 < ids) + self.w2 * (self.p2 < ids)
        return low, size

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose part holds v, with the part's begin and size."""
        swap = self.p1 > self.p2
        a, b = np.where(swap, self.p2, self.p1), np.where(swap, self.p1, self.p2)
        wa, wb = np.where(swap, self.w2, self.w1), np.where(swap, self.w1, self.w2)
        over_a = v >= (self.shares[a + 1] * self.w0 >> ORDER0) + wa
        v = v - wa * over_a
        start_b = self.shares[b] * self.w0 >> ORDER0
        in_a = ~over_a & (v >= self.shares[a] * self.w0 >> ORDER0)
        over_b = v >= (self.shares[b + 1] * self.w0 >> ORDER0) + wb
        in_b = over_a & ~over_b & (v >= start_b)
        v = v - wb * (over_b & over_a)
        ids = self.holder[np.minimum((((v + 1) << ORDER0) - 1) // self.w0, (1 << ORDER0) - 1)]
        ids = np.where(in_a, a, np.where(in_b, b, ids))
        return (ids, *self.interval(ids))

    def learn(self, ids: np.ndarray, k: int) -> None:
        self.hits += np.bincount(self.kind + self.kinds * np.where(self.hit2, 2, self.hit1), minlength=3 * self.kinds)
        new = ids.astype(np.int32) << 4
        self.one[self.at1] = new + np.where(self.hit1, np.minimum(self.c1 + 1, LEVELS - 1), 1)
        self.two[self.at2] = new + np.where(self.hit2, np.minimum(self.c2 + 1, LEVELS - 1), 1)
        self.last2[:k] = self.last[:k]
        self.last[:k] = ids
        self.seen.append(ids)
        self.steps += 1
        if self.steps == self.renew_at:
            self._renew()
            self.renew_at = self.renew_at * 3 // 2 + 1


def _lanes(n: int) -> np.ndarray:
    """Lengths of the lanes of a block of n ids; the longer ones come first, and they differ by one at most."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return n // lanes + (np.arange(lanes) < n % lanes)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """One block: the 32-bit words of each lane (their numbers come first), coded with a model that starts empty."""
    lengths = _lanes(len(ids))
    lanes, steps = len(lengths), int(lengths[0])
    begin = np.cumsum(lengths) - lengths
    mixer = _Mixer(lanes, alphabet)
    low, size = np.zeros(lanes, U), np.full(lanes, ~U(0))
    out, used = np.zeros((lanes, steps + 2), "<u4"), np.zeros(lanes, np.int64)
    for t in range(steps):
        k = lanes if t < lengths[-1] else int((lengths > t).sum())
        own = ids[begin[:k] + t].astype(np.int64)
        mixer.predict(k)
        a, part = mixer.interval(own)
        l, s = low[:k], size[:k]
        r = s >> U(SCALE)
        a = a.view(U) * r
        l += a
        np.multiply(part.view(U), r, out=s)
        for w in np.flatnonzero(l < a).tolist():  # a carry goes into the words that are out
            at = int(used[w]) - 1
            while out[w, at] == 0xFFFFFFFF:
                out[w, at] = 0
                at -= 1
            out[w, at] += 1
        w = np.flatnonzero(s < TOP)
        out[w, used[w]] = l[w] >> U(32)
        used[w] += 1
        l[w] <<= U(32)
        s[w] <<= U(32)
        mixer.learn(own, k)
    last = low + U(0xFFFFFFFF)  # the end of each lane: a word whose number lies in the lane's last part
    for w in np.flatnonzero(last < low).tolist():
        at = int(used[w]) - 1
        while out[w, at] == 0xFFFFFFFF:
            out[w, at] = 0
            at -= 1
        out[w, at] += 1
    out[np.arange(lanes), used] = last >> U(32)
    used += 1
    return used.astype("<u4").tobytes() + out[np.arange(out.shape[1]) < used[:, None]].tobytes()


def decode_block(coded: bytes, n: int, alphabet: int) -> np.ndarray:
    """The n ids of a block coded by encode_block."""
    lengths = _lanes(n)
    lanes, steps = len(lengths), int(lengths[0])
    begin = np.cumsum(lengths) - lengths
    many = np.frombuffer(coded, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(coded, "<u4", offset=4 * lanes), np.zeros(2, "<u4")).astype(U)
    at = np.cumsum(many) - many
    end = at + many
    words[-2:] = 0

    def take(w: np.ndarray | slice) -> np.ndarray:
        got = np.where(at[w] < end[w], words[np.minimum(at[w], len(words) - 1)], U(0))
        at[w] += 1
        return got

    code = take(slice(None)) << U(32)
    code |= take(slice(None))
    mixer = _Mixer(lanes, alphabet)
    size = np.full(lanes, ~U(0))
    out = np.zeros(n, np.uint32)
    for t in range(steps):
        k = lanes if t < lengths[-1] else int((lengths > t).sum())
        mixer.predict(k)
        c, s = code[:k], size[:k]
        r = s >> U(SCALE)
        v = np.minimum(c // r, U((1 << SCALE) - 1)).astype(np.int64)
        ids, a, part = mixer.find(v)
        c -= a.view(U) * r
        np.multiply(part.view(U), r, out=s)
        w = np.flatnonzero(s < TOP)
        c[w] = c[w] << U(32) | take(w)
        s[w] <<= U(32)
        mixer.learn(ids, k)
        out[begin[:k] + t] = ids
    return out


def write_stream(ids: np.ndarray, docs: list[tuple[str | None, int]], alphabet: int) -> bytes:
    """One file: the documents' identifiers (as text, or null) and lengths, then the blocks.

    Each block has its number of ids and bytes and the checksums of both, and is coded without regard to the others.
    """
    n_blocks = -(-len(ids) // BLOCK)
    blocks = np.array_split(ids, n_blocks) if n_blocks else []
    names = ((NULL, n, b"") if d is None else (len(i := d.encode()), n, i) for d, n in docs)
    index = zlib.compress(b"".join(struct.pack("<IQ", wide, n) + i for wide, n, i in names))
    parts = [MAGIC, struct.pack("<IQIQI", alphabet, len(docs), n_blocks, len(index), zlib.crc32(index)), index]
    for b in blocks:
        c = encode_block(b, alphabet)
        parts += [struct.pack("<IIII", len(b), len(c), zlib.crc32(c), zlib.crc32(b.astype("<u4"))), c]
    return b"".join(parts)


def read_stream(raw: bytes | pa.Buffer) -> tuple[list[tuple[str | None, int]], np.ndarray]:
    """The documents and ids of a file; a wrong checksum raises ValueError."""
    raw = memoryview(raw)
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    alphabet, n_docs, n_blocks, size, crc = struct.unpack_from("<IQIQI", raw, 8)
    at = 8 + struct.calcsize("<IQIQI")
    if zlib.crc32(raw[at : at + size]) != crc:
        raise ValueError("the index is damaged")
    index, docs, p = zlib.decompress(raw[at : at + size]), [], 0
    for _ in range(n_docs):
        wide, n = struct.unpack_from("<IQ", index, p)
        docs.append((None if wide == NULL else index[p + 12 : p + 12 + wide].decode(), n))
        p += 12 + (0 if wide == NULL else wide)
    at += size
    out = []
    for k in range(n_blocks):
        n, wide, crc, of_ids = struct.unpack_from("<IIII", raw, at)
        coded = raw[at + 16 : at + 16 + wide]
        at += 16 + wide
        if zlib.crc32(coded) != crc:
            raise ValueError(f"block {k} is damaged")
        out.append(decode_block(coded, n, alphabet))
        if zlib.crc32(out[-1].astype("<u4")) != of_ids:
            raise ValueError(f"block {k} decodes to other ids")
    return docs, np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_token_files(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, files: int | None = None, file_chars: int = 24_000_000) -> DataFrame:
    """Writes the ids of all documents to binary files in `to`, a folder that all executors share, in ascending order of
    the identifier (nulls first) over the files' names, and returns (file, n_docs, n_ids).

    Rows are dealt by ranges of the identifier and sorted within them. A file is written under a name of its own and
    then moved, so an attempt that is lost or repeated leaves a whole file or none. `files`: ranges; unset, the number
    follows the session's shuffle partitions. A range writes more than one file if it has more than file_chars
    characters, so memory is bounded by that and the longest text.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = byte_encoder(path or vocabulary_path())
        system, folder = fs.FileSystem.from_uri(to)
        part, made = TaskContext.get().partitionId(), []
        ids: list[np.ndarray] = []
        held: list[tuple[str | None, int]] = []

        def put() -> None:
            name = f"{part:06d}-{len(made):06d}.ids"
            stream = np.concatenate(ids)
            raw = write_stream(stream, held, encoder.size)
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as f:
                f.write(raw)
            system.move(own, f"{folder}/{name}")
            made.append((name, len(held), len(stream)))

        system.create_dir(folder, recursive=True)
        chars = 0
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, t, x in zip(b.column(0).cast(pa.string()).to_pylist(), texts, encoder.batch(texts)):
                ids.append(np.append(x, np.uint32(end_id)))
                held.append((i, len(x) + 1))
                chars += len(t)
                if chars >= file_chars:
                    put()
                    ids, held, chars = [], [], 0
        if held:
            put()
        names, docs_in, n = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(docs_in, pa.int64()), pa.array(n, pa.int64())], names=["file", "n_docs", "n_ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("_t")]  # equal identifiers may be dealt to several files
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(run, "file string, n_docs long, n_ids long")


def file_starts(written: DataFrame) -> DataFrame:
    """(file, first): the number of ids in all files before, in the order of their names. Running sums are taken within
    groups of a thousand ranges, then over the groups' sums, so no window holds more than a thousandth of the files."""
    rows = written.select("file", "n_ids", F.expr("cast(substring(file, 1, position('-' in file) - 1) as long) div 1000").alias("group"))
    before = F.sum("n_ids").over(Window.partitionBy("group").orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    groups = rows.groupBy("group").agg(F.sum("n_ids").alias("n"))
    of_group = groups.select("group", F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)).alias("g"))
    return rows.withColumn("own", before).join(of_group, "group").select("file", (F.coalesce("own", F.lit(0)) + F.coalesce("g", F.lit(0))).alias("first"))


def read_token_files(spark: SparkSession, folder: str, starts: DataFrame, kind: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of all documents in the files; starts: (file, first), see `file_starts`.

    Files are dealt by their bytes, as Spark reads them; a task holds one file at a time. with_ids=False leaves out ids."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                docs, ids = read_stream(raw.as_buffer())
                n = np.array([n for _, n in docs], np.int64)
                at = np.cumsum(n) - n
                crc = [zlib.crc32(ids[a : a + m]) for a, m in zip(at.tolist(), n.tolist())]
                columns = [pa.array([i for i, _ in docs], pa.string()), pa.array([name.rsplit("/", 1)[-1]] * len(docs), pa.string()), pa.array(at), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "doc_id string, file string, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return rows.join(starts, "file").select(F.col("doc_id").cast(kind), (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"][: int(with_ids)])


def file_system_uri(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark's configuration gives it, as the executors' file writer names it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(conf).makeQualified(path).toUri().toString()
    scheme, rest = uri.split(":", 1)
    names = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3a": "s3", "s3": "s3", "gs": "gs", "abfss": "abfss"}
    if scheme not in names:
        raise ValueError(f"token files cannot be written to {scheme} folders")
    rest = rest if rest.startswith("//") else f"//{rest}"
    return f"{names[scheme]}:{rest}"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes the token-id files of all documents and reads them back: doc_id, start, n_tokens, ids_crc32, ids.

    start counts the ids of all documents before in ascending order of the identifier. Files go to `folder`, else to
    the shared checkpoint folder. Null and empty texts are the end id alone. A null identifier comes first and is
    null again; repeated rows are written each, equal identifiers in the order of their texts' hashes. An empty table
    gives no rows. Other columns are ignored. A very long text is coded in many blocks; memory follows its own length.
    """
    spark = docs.sparkSession
    folder = file_system_uri(spark, folder or f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}")
    written = stored(write_token_files(docs, folder, id_col, text_col, path, end_id), "token-files")
    kind = docs.schema[id_col].dataType.simpleString()
    columns = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if written.isEmpty():
        return spark.createDataFrame([], columns)
    return read_token_files(spark, folder, file_starts(written), kind, with_ids)
