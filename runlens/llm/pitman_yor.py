"""Scoring of texts by a hierarchical Pitman-Yor model over words: bigram restaurants, one unigram restaurant, uniform base."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.llm.common import checkpoint_dir, fold, ship, stored

U = np.uint64
END = 1  # the hash of the end token; hashes of words are made even
LONG = 64  # bytes; longer words are hashed one by one
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_VALUES = np.random.default_rng(5).integers(1, 2**63, 256, np.int64).astype(U)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, base, U)]))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; whole numbers that are not negative take the narrowest type."""
    out = []
    for x in arrays:
        if x.dtype.kind in "iu" and len(x) and x.min() >= 0:
            x = x.astype(np.min_scalar_type(x.max()))
        out.append(x)
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays; all whole numbers as int64 (hashes of 64 bits are taken back with astype)."""
    return [x.astype(np.int64) if x.dtype.kind in "iu" else x for x in pickle.loads(zstandard.ZstdDecompressor().decompress(blob))]


def steps(x: np.ndarray) -> np.ndarray:
    """A rising array as its first value and its steps; np.cumsum gives it back."""
    return np.diff(x, prepend=x.dtype.type(0))


class WordHasher:
    """64-bit hashes of the words of many texts, with an end token after each text."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, U)

    def words(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each token, tokens of each text); END follows each text's words."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        flat = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        n = len(flat)
        if len(self.power) < n:
            self.power, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        word = ~_WHITE[flat]
        change = np.flatnonzero(np.diff(np.concatenate([[False], word])))  # starts and ends in turn, as the last byte is white
        start, end = change[::2], change[1::2]
        sums = np.zeros(n + 1, U)
        np.cumsum(_VALUES[flat] * self.power[:n], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93)
        long = np.flatnonzero(end - start > LONG)  # a polynomial modulo 2**64 can confuse very long words
        h[long] = [xxhash.xxh64_intdigest(flat[a:z].tobytes()) for a, z in zip(start[long].tolist(), end[long].tolist())]
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        h <<= U(1)
        stops = np.cumsum([len(b) + 1 for b in raw])
        after = np.searchsorted(start, stops)  # words before the end of each text
        return np.insert(h, after, U(END)), np.diff(np.concatenate([[0], after])) + 1


def _chunks(docs: DataFrame, id_col: str, text_col: str, chars: int, modulus: int) -> DataFrame:
    """One row for each chunk of about `chars` characters: its distinct words in the order of their hashes, with their
    training counts, and its documents as places in that list. The texts are read once, here."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        ids, held, hashes, counts, size = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            own, back = np.unique(np.concatenate(hashes), return_inverse=True)
            n, out = np.concatenate(counts), np.concatenate(held)
            train = np.bincount(back[np.repeat(~out, n)], minlength=len(own))
            columns = [pa.array([uuid.uuid4().int & (1 << 62) - 1]), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(ids)), pa.array([packed(own, train)], pa.binary()), pa.array([packed(out, n, back)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "words", "tokens"])

        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            out = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            part, chars_in = [], 0
            for k in range(len(texts)):
                part.append(k)
                chars_in += len(texts[k])
                if chars_in >= 1 << 19 or k + 1 == len(texts):
                    h, n = hasher.words([texts[i] for i in part])
                    hashes.append(h)
                    counts.append(n)
                    ids.append(b.column(0).slice(part[0], len(part)))
                    held.append(out[part])
                    size += chars_in
                    part, chars_in = [], 0
                    if size >= chars:
                        yield row()
                        ids, held, hashes, counts, size = [], [], [], [], 0
        if hashes:
            yield row()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), (fold(id_col, modulus) == 0).alias("held_out"))
    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, words binary, tokens binary")


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Written as a table in the shared checkpoint folder, dealt into buckets by a key, so that later groupings by it move only
    the other side. Only the catalogue can say how files are dealt, so the table is entered there, looked up and taken out again;
    the files stay, and the DataFrame knows them."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{checkpoint_dir(spark)}/{table}").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of files with a path of their own: the entry goes alone
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive numbers, by Stirling's series from x + 8 on."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= np.minimum(x, 1e30) + k if k else np.minimum(x, 1e30)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


class Seatings:
    """Where tables were opened in many rows of customers who all want one dish each: row k's customers come one after the
    other, the first opens a table, and `opened` lists the numbers of later customers who opened one, row by row."""

    def __init__(self, customers: np.ndarray, many: np.ndarray, opened: np.ndarray):
        self.customers, self.many, self.opened = customers, many, opened  # later tables of each row, and who opened them

    def tables(self) -> np.ndarray:
        return np.where(self.customers > 0, 1 + self.many, 0)

    def log_weight(self, theta: np.ndarray, p: np.ndarray, d: float) -> np.ndarray:
        """log of the seating's probability over the chance that customers who come one by one sit so.

        A customer after j others at t tables opens a table with weight (theta + d t) p and joins one with weight j - d t.
        The weights' product is the seating's probability, the chance of the walk divides each by their sum; so what
        is left is the product of the sums, a ratio of gamma functions for each stretch between two openings.
        """
        row = np.repeat(np.arange(len(self.many)), self.many)
        t = np.arange(len(row)) - np.repeat(np.cumsum(self.many) - self.many, self.many) + 1  # tables before each opening
        last = np.ones(len(self.many), np.int64)
        out = np.zeros(len(self.many))
        before = np.ones(len(row), np.int64)
        before[t > 1] = self.opened[np.flatnonzero(t > 1) - 1] + 1
        c = (theta[row] + d * t) * p[row] - d * t
        np.add.at(out, row, log_gamma(self.opened + 1 + c) - log_gamma(before + c))  # the one who opens counts too
        ends = np.flatnonzero(self.many)
        last[ends] = self.opened[np.cumsum(self.many)[ends] - 1] + 1
        t = 1 + self.many
        c = (theta + d * t) * p - d * t
        more = np.flatnonzero(self.customers > last)
        out[more] += log_gamma(self.customers[more] + c[more]) - log_gamma(last[more] + c[more])
        return out

    def pick(self, own: np.ndarray, other: Seatings) -> Seatings:
        """These seatings, or the other's where `own` is false."""
        many = np.where(own, self.many, other.many)
        opened = np.zeros(int(many.sum()), np.int64)
        to = np.repeat(own, many)
        opened[to], opened[~to] = self.opened[np.repeat(own, self.many)], other.opened[np.repeat(~own, other.many)]
        return Seatings(self.customers, many, opened)


def walk(customers: np.ndarray, theta: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator, start: Seatings | None = None) -> Seatings:
    """Customers come one by one (see Seatings.log_weight); with `start`, after those who are seated already.

    The wait for the next new table is geometric with a Beta-distributed chance, so a row takes as many steps as it has
    tables, not customers.
    """
    n = len(customers)
    tables, at = np.ones(n, np.int64), np.ones(n, np.int64)
    rows, opened = [], []
    if start is not None:
        keep = start.opened < np.repeat(customers, start.many)  # those who left are the last ones
        row = np.repeat(np.arange(n), start.many)[keep]
        rows.append(row)
        opened.append(start.opened[keep])
        tables += np.bincount(row, minlength=n)
        at = np.maximum(np.minimum(start.customers, customers), 1)
    alive = np.flatnonzero(customers > at)
    while len(alive):
        t = tables[alive]
        chance = rng.beta((theta[alive] + d * t) * p[alive], at[alive] - d * t)
        wait = np.log(1 - rng.random(len(alive))) / np.log1p(-np.minimum(np.maximum(chance, 1e-300), 1 - 1e-16))
        go = wait < customers[alive] - at[alive]
        alive = alive[go]
        who = at[alive] + wait[go].astype(np.int64)
        rows.append(alive)
        opened.append(who)
        at[alive], tables[alive] = who + 1, t[go] + 1
        alive = alive[customers[alive] > at[alive]]
    row, who = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, opened))
    return Seatings(customers, np.bincount(row, minlength=n), who[np.lexsort((who, row))])


def gibbs(now: Seatings, theta: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator, tries: int = 2) -> Seatings:
    """One Gibbs step of every row's seating, all else held fixed: fresh walks take the place of the row's seating with the
    chance that their weights give (Metropolis' rule for independent proposals), so the exact law stays as it is."""
    old = now.log_weight(theta, p, d)
    for _ in range(tries):
        new = walk(now.customers, theta, p, d, rng)
        w = new.log_weight(theta, p, d)
        take = np.log(1 - rng.random(len(w))) < w - old
        now, old = new.pick(take, now), np.where(take, w, old)
    return now


def discount(n1: float, n2: float) -> float:
    """n1 / (n1 + 2 n2) of the counts, within 0.1 and 0.9."""
    return float(np.clip(n1 / max(n1 + 2 * n2, 1), 0.1, 0.9))


HOT = 1 << 21  # training tokens: a context with more is dealt over several parts
STEP = 1e-4  # probabilities go back to the chunks as whole numbers of so much log10
MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], U)


def _scaled(h: np.ndarray, parts: int) -> np.ndarray:
    """Hashes to parts, in the order of the hashes."""
    return (((h >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _rows(t: pa.Table, *names: str) -> list[tuple]:
    return list(zip(*(t[n].to_pylist() for n in names)))


def _out(schema: StructType | str, **columns: list) -> pa.Table:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.table({n: pa.array(columns[n], types[k]) for n, k in (f.split() for f in schema.split(", "))})


def count_words(chunks: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, blob, n, v): for each chunk and part the training count of its words and their numbers in the part,
    in the order of the hashes; and a row without a chunk for each part, with its training tokens and distinct words.

    A chunk sends each of its words once, with a count, so a frequent word is one entry a chunk.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, train = unpacked(blob)
                words = words.astype(U)
                edges = np.searchsorted(_scaled(words, parts), np.arange(parts + 1))
                own = np.flatnonzero(np.diff(edges)).tolist()
                blobs = [packed(steps(words[edges[p] : edges[p + 1]]), train[edges[p] : edges[p + 1]]) for p in own]
                yield _out("part int, chunk long, blob binary", part=own, chunk=[chunk] * len(own), blob=blobs).to_batches()[0]

    out = "chunk long, part int, blob binary, n long, v long"

    def count(t: pa.Table) -> pa.Table:
        rows = _rows(t, "chunk", "blob")
        part = t["part"][0].as_py()
        found = [unpacked(b) for _, b in rows]
        words, back = np.unique(np.concatenate([np.cumsum(w.astype(U)) for w, _ in found]), return_inverse=True)
        c = np.bincount(back, np.concatenate([n for _, n in found]), len(words)).astype(np.int64)
        cuts = np.cumsum([0, *(len(n) for _, n in found)])
        blobs = [packed(c[own], own) for a, z in zip(cuts, cuts[1:]) for own in (back[a:z],)]
        total = len(rows)
        return _out(out, chunk=[*(k for k, _ in rows), None], part=[part] * (total + 1), blob=[*blobs, b""], n=[0] * total + [int(c.sum())], v=[0] * total + [int((c > 0).sum())])

    return chunks.select("chunk", "words").mapInArrow(split, "part int, chunk long, blob binary").groupBy("part").applyInArrow(count, out)


class _Chunk:
    """A chunk's words and its pairs of a word and the one before it (END before the first), in the order of the hashes."""

    def __init__(self, words: bytes, tokens: bytes):
        self.words, self.train = unpacked(words)
        self.words = self.words.astype(U)
        held, self.n, self.tokens = unpacked(tokens)
        self.held = held.astype(bool)
        self.at = np.cumsum(self.n) - self.n
        before = np.zeros_like(self.tokens)  # END has the least hash, so it is the first word of every chunk
        before[1:] = self.tokens[:-1]
        before[self.at] = 0
        keys, self.pair = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.first, self.second = np.divmod(keys, len(self.words))

    def add(self, x: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each document."""
        return np.add.reduceat(x, self.at)

    def parts(self, shares: np.ndarray, parts: int) -> np.ndarray:
        """The part of each pair: by its first word; one that has several shares is dealt by the second word too."""
        h = self.words[self.first] * MIX[0] + (self.words[self.second] * MIX[1] >> U(40)) % shares[self.first].astype(U) * MIX[2]
        h ^= h >> U(31)
        return _scaled(h * MIX[1], parts)


def send_pairs(chunks: DataFrame, words: DataFrame, n: int, v: int, parts: int, hot: int) -> DataFrame:
    """(part, chunk, kind, blob): for each chunk and part the pairs with their training counts, as kind 0; and for each chunk,
    as kind 1, what its documents get from the words alone, and the words that are dealt over several parts."""
    out = "part int, chunk long, kind int, blob binary"

    def send(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _out(out, part=[], chunk=[], kind=[], blob=[])
        own = _Chunk(chunk["words"][0].as_py(), chunk["tokens"][0].as_py())
        back = [(p, *unpacked(b)) for p, b in sorted(_rows(counts, "part", "blob"))]
        c = np.concatenate([x for _, x, _ in back])
        number = np.concatenate([p << 32 | x for p, _, x in back])
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        shares = 1 + c // hot
        train = np.bincount(own.pair[np.repeat(~own.held, own.n)], minlength=len(own.first))
        part = own.parts(shares, parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(edges)).tolist()
        blobs = []
        for p in used:
            k = order[edges[p] : edges[p + 1]]
            u, w = number[own.first[k]], number[own.second[k]]
            blobs.append(packed(u >> 32, u & 0xFFFFFFFF, w >> 32, w & 0xFFFFFFFF, train[k], np.unique(u[shares[own.first[k]] > 1])))
        several = np.flatnonzero(shares > 1)
        docs = packed(own.add(base[own.tokens]), own.add((c > 0)[own.tokens].astype(np.int64)), several, shares[several])
        chunk_id = chunk["chunk"][0].as_py()
        return _out(out, part=[*used, chunk_id % parts], chunk=[chunk_id] * (len(used) + 1), kind=[0] * len(used) + [1], blob=[*blobs, docs])

    return chunks.select("chunk", "words", "tokens").groupBy("chunk").cogroup(words.where("chunk is not null").select("chunk", "part", "blob").groupBy("chunk")).applyInArrow(send, out)


def merge_pairs(sent: DataFrame) -> DataFrame:
    """(part, chunk, kind, blob, n1, n2): the restaurants of each part as kind 2 (contexts, their numbers of dishes, dishes,
    customers, contexts that other parts have too), and for each chunk the places of its pairs among them as kind 0."""
    out = "part int, chunk long, kind int, blob binary, n1 long, n2 long"

    def merge(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        rows = _rows(t, "chunk", "kind", "blob")
        keep = [(c, k, b) for c, k, b in rows if k == 1]
        chunks = [c for c, k, _ in rows if k == 0]
        found = [unpacked(b) for _, k, b in rows if k == 0]
        if found:
            u, w = (np.concatenate([x[k] << 32 | x[k + 1] for x in found]) for k in (0, 2))
            contexts, of = np.unique(u, return_inverse=True)
            dishes, dish = np.unique(w, return_inverse=True)
            keys, back = np.unique(of * len(dishes) + dish, return_inverse=True)
            c = np.bincount(back, np.concatenate([x[4] for x in found]), len(keys)).astype(np.int64)
            own, dish = np.divmod(keys, len(dishes))
            shared = np.flatnonzero(np.isin(contexts, np.unique(np.concatenate([x[5] for x in found]))))
            cuts = np.cumsum([0, *(len(x[0]) for x in found)])
            asked = [packed(steps(back[a:z])) for a, z in zip(cuts, cuts[1:])]
            keep += [(k, 0, b) for k, b in zip(chunks, asked)]
            keep.append((None, 2, packed(steps(contexts), np.bincount(own, minlength=len(contexts)), steps(dishes), dish, c, shared)))
        few = [int((c == k).sum()) if found else 0 for k in (1, 2)]
        zeros = [0] * (len(keep) - 1)
        return _out(out, part=[part] * len(keep), chunk=[x[0] for x in keep], kind=[x[1] for x in keep], blob=[x[2] for x in keep], n1=[few[0], *zeros], n2=[few[1], *zeros])

    return sent.groupBy("part").applyInArrow(merge, out)


class _Restaurants:
    """The context restaurants of a part."""

    def __init__(self, blob: bytes):
        contexts, many, dishes, self.dish, self.c, self.shared = unpacked(blob)
        self.contexts, self.dishes = np.cumsum(contexts), np.cumsum(dishes)
        self.context = np.repeat(np.arange(len(many)), many)

    def per_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts))

    def messages(self, t: np.ndarray) -> list[tuple[int, bytes]]:
        """(word part, blob) of what the unigram restaurant is told: new customers by dish, and the tables and customers of
        contexts that other parts have too."""
        tables = np.bincount(self.dish, t, len(self.dishes)).astype(np.int64)
        shared = self.contexts[self.shared]
        sums = [self.per_context(x)[self.shared].astype(np.int64) for x in (t, self.c)]
        out = []
        for p in np.unique(np.concatenate([self.dishes >> 32, shared >> 32])).tolist():
            a, z = np.searchsorted(self.dishes, [p << 32, (p + 1) << 32])
            b, y = np.searchsorted(shared, [p << 32, (p + 1) << 32])
            out.append((p, packed(steps(self.dishes[a:z]), tables[a:z], steps(shared[b:y]), *(x[b:y] for x in sums))))
        return out


ROOM = "part int, word_part int, kind int, blob binary, customers long, tables long, n1 long, n2 long"


def _room(part: list, word_part: list, kind: list, blob: list, **sums: int) -> pa.Table:
    zeros = [0] * (len(part) - 1)
    return _out(ROOM, part=part, word_part=word_part, kind=kind, blob=blob, **{k: ([sums.get(k, 0), *zeros] if part else []) for k in ("customers", "tables", "n1", "n2")})


def seat_root(told: DataFrame, d: float, theta: float, tables: float, v: int, seed: int) -> DataFrame:
    """The unigram restaurant, a word part a task: its customers are the tables of the context restaurants. Returns to each part
    (kind 1) customers less discount of its dishes, and tables and customers of shared contexts; and its own seating (kind 2)."""

    def seat(t: pa.Table) -> pa.Table:
        word_part = t["word_part"][0].as_py()
        rows = sorted(_rows(t, "kind", "part", "blob"), key=lambda r: r[:2])
        came, old = [(p, unpacked(b)) for k, p, b in rows if k == 0], [unpacked(b) for k, _, b in rows if k == 2]
        dishes, back = np.unique(np.concatenate([np.cumsum(x[0]) for _, x in came]), return_inverse=True)
        c = np.bincount(back, np.concatenate([x[1] for _, x in came]), len(dishes)).astype(np.int64)
        rng = np.random.default_rng([seed, word_part])
        p = np.full(len(c), 1 / (v + 1))
        if old:
            now = Seatings(*old[0])
            strength = theta + d * np.maximum(tables - now.tables(), 0)
            now = gibbs(walk(c, strength, p, d, rng, now), strength, p, d, rng)
        else:
            now = walk(c, np.full(len(c), theta + d * tables), p, d, rng)
        rest = (c - d * now.tables()).astype(np.float32)
        shared, at = np.unique(np.concatenate([np.cumsum(x[2]) for _, x in came]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([x[k] for _, x in came]), len(shared)).astype(np.int64) for k in (3, 4)]
        blobs, a, b = [], 0, 0
        for _, x in came:
            blobs.append(packed(rest[back[a : a + len(x[0])]], *(s[at[b : b + len(x[2])]] for s in sums)))
            a, b = a + len(x[0]), b + len(x[2])
        n = len(came)
        return _room([*(q for q, _ in came), None], [word_part] * (n + 1), [1] * n + [2], [*blobs, packed(now.customers, now.many, now.opened)], customers=int(c.sum()), tables=int(now.tables().sum()), n1=int((c == 1).sum()), n2=int((c == 2).sum()))

    return told.groupBy("word_part").applyInArrow(seat, ROOM)


class _Level:
    """What the unigram restaurant says to one part: P of each dish, and the shared contexts' tables and customers."""

    def __init__(self, r: _Restaurants, blobs: list[bytes], d: float, theta: float, customers: float, tables: float, v: int):
        got = [unpacked(b) for b in blobs]
        rest, t, c = (np.concatenate([x[k] for x in got]) for k in range(3))
        self.p = ((rest.astype(float) + (theta + d * tables) / (v + 1)) / (theta + customers))[r.dish]
        self.t, self.c = t, c

    def totals(self, r: _Restaurants, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables and customers of each context, in all parts."""
        tables, customers = r.per_context(t), r.per_context(r.c)
        others = self.t.astype(float)
        tables[r.shared] = np.maximum(others, tables[r.shared]) if len(others) else tables[r.shared]
        customers[r.shared] = self.c if len(self.c) else customers[r.shared]
        return tables, customers


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, theta: float = 1.0, sweeps: int = 5, burn_in: int = 2, chars: int = 8_000_000, hot: int = HOT, seed: int = 11) -> DataFrame:
    """Scores of all whole texts under a hierarchical Pitman-Yor bigram model learned from the training fold.

    Tokens are the words, A-Z lower-cased, and one end for each text; documents whose crc32(identifier) mod `modulus`
    is 0 are held out of learning. Every word that is followed by another is a restaurant of its own, every word is a
    dish; all context restaurants have one parent, the unigram restaurant, whose base is uniform over the known words
    and one unknown word. So each pair that the corpus has is counted and seated, and the model grows with it.

    Chunks of texts are written once, as lists of distinct words and places in them. Word counts and then pairs go from
    the chunks to parts by their hashes (each once a chunk, with a count); a part holds whole context restaurants,
    but a context with more than `hot` training tokens is dealt over several. A sweep seats all pairs of every part
    given the unigram probabilities, and tells the unigram restaurant the numbers of tables; that is seated by word
    parts and answers with new probabilities. Seats are drawn by `gibbs`, whose law is exact for each pair with all
    else held fixed; pairs that are drawn side by side see each other's tables of the sweep before. Predictive
    probabilities are averaged over the sweeps after `burn_in`, and go back to the chunks in steps of 0.0001 of
    log10. The driver sees sums alone.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity, one row per input row.
    Null and empty texts are one end token. A null identifier hashes as empty text and is kept; repeated rows count
    each; the order of rows does not matter but for the random draws. With no training row every token is unknown. An
    empty table gives no rows. Other columns are ignored. Memory follows `chars` and the longest text.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    chunks = bucketed(_chunks(docs, id_col, text_col, chars, modulus), "chunk", "lm_chunks")
    parts = chunks.count()
    if not parts:
        return spark.createDataFrame([], result)
    words = stored(count_words(chunks, max(1, parts // 4)), "lm-words")
    n, v = words.where("chunk is null").agg(F.sum("n"), F.sum("v")).first()
    state = bucketed(merge_pairs(send_pairs(chunks, words, n, v, parts, hot)), "part", "lm_pairs")
    n1, n2 = state.agg(F.sum("n1"), F.sum("n2")).first()
    d = discount(n1, n2)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = _Restaurants(blob)
                out = r.messages(np.minimum(r.c, 1))
                yield _room([part] * len(out), [p for p, _ in out], [0] * len(out), [b for _, b in out]).to_batches()[0]

    def sweep_of(sweep: int, level: tuple):
        def sweep_part(own: pa.Table, got: pa.Table) -> pa.Table:
            blobs = [b for k, b in _rows(own, "kind", "blob") if k == 2]
            if not blobs:
                return _room([], [], [], [])
            part, r = own["part"][0].as_py(), _Restaurants(blobs[0])
            got_rows = sorted(_rows(got, "kind", "word_part", "blob"), key=lambda x: (x[0], x[1] or 0))
            said = _Level(r, [b for k, _, b in got_rows if k == 1], *level)
            old = [pickle.loads(b) for k, _, b in got_rows if k == 3]
            rng = np.random.default_rng([seed, sweep, part])
            some = np.flatnonzero(r.c >= 2)
            t, samples = np.minimum(r.c, 1), []
            now = None
            if old:
                many, opened, samples = unpacked(old[0][0]) + [old[0][1]]
                now = Seatings(r.c[some], many, opened)
                t[some] = now.tables()
            all_tables, _ = said.totals(r, t)
            strength = theta + d * (all_tables[r.context[some]] - t[some])
            now = gibbs(now or walk(r.c[some], strength, said.p[some], d, rng), strength, said.p[some], d, rng)
            t[some] = now.tables()
            if sweep >= burn_in:
                samples = [*samples, packed(now.many)]
            out = r.messages(t)
            mine = pickle.dumps((packed(now.many, now.opened), samples))
            return _room([part] * (len(out) + 1), [*(p for p, _ in out), None], [0] * len(out) + [3], [*(b for _, b in out), mine])

        return sweep_part

    told = state.where("kind = 2").select("part", "blob").mapInArrow(open_, ROOM)
    seated, answers, d0, tables = None, [], 0.5, float(v)
    for sweep in range(sweeps):
        if sweep:
            told = seated.where("kind = 0").unionAll(answers[-1][0].where("kind = 2"))
        answer = stored(seat_root(told, d0, theta, tables, v, seed + sweep), "lm-root")
        customers, tables, one, two = (float(x or 0) for x in answer.agg(*[F.sum(c) for c in ("customers", "tables", "n1", "n2")]).first())
        answers.append((answer, (d0, theta, customers, tables, v)))
        before = answer.where("kind = 1")
        before = before.unionAll(seated.where("kind = 3")) if seated is not None else before
        seated = stored(state.where("kind = 2").select("part", "kind", "blob").groupBy("part").cogroup(before.groupBy("part")).applyInArrow(sweep_of(sweep, answers[-1][1]), ROOM), "lm-seats")
        d0 = discount(one, two)

    levels = [x for _, x in answers[burn_in:]]

    def predict(own: pa.Table, got: pa.Table) -> pa.Table:
        rows = _rows(own, "kind", "chunk", "blob")
        out = [(c, -1, b) for k, c, b in rows if k == 1]
        blobs = [b for k, _, b in rows if k == 2]
        if blobs:
            part, r = own["part"][0].as_py(), _Restaurants(blobs[0])
            got_rows = sorted(_rows(got, "kind", "word_part", "blob", "sample"), key=lambda x: (x[0], x[3], x[1] or 0))
            samples = [pickle.loads(b)[1] for k, _, b, _ in got_rows if k == 3][0]
            some, p = np.flatnonzero(r.c >= 2), np.zeros(len(r.c))
            for k, (level, many) in enumerate(zip(levels, samples)):
                said = _Level(r, [b for x, _, b, s in got_rows if x == 1 and s == k], *level)
                t = np.minimum(r.c, 1)
                t[some] += unpacked(many)[0]
                tables, customers = said.totals(r, t)
                p += (np.maximum(r.c - d * t, 0) + (theta + d * tables[r.context]) * said.p) / (theta + customers[r.context])
            cost = np.round(-np.log10(p / len(levels)) / STEP).astype(np.int64)
            out += [(c, part, packed(cost[np.cumsum(unpacked(b)[0])])) for k, c, b in rows if k == 0]
        return _out("chunk long, part int, blob binary", chunk=[x[0] for x in out], part=[x[1] for x in out], blob=[x[2] for x in out])

    columns = ["part", "word_part", "kind", "blob"]
    said = seated.where("kind = 3").select(*columns, F.lit(-1).alias("sample"))
    for k, (answer, _) in enumerate(answers[burn_in:]):
        said = said.unionAll(answer.where("kind = 1").select(*columns, F.lit(k).alias("sample")))
    costs = state.select("part", "chunk", "kind", "blob").groupBy("part").cogroup(said.groupBy("part")).applyInArrow(predict, "chunk long, part int, blob binary")

    def give(chunk: pa.Table, got: pa.Table) -> pa.Table:
        own = _Chunk(chunk["words"][0].as_py(), chunk["tokens"][0].as_py())
        back = dict(_rows(got, "part", "blob"))
        base, known, several, many = unpacked(back.pop(-1))
        shares = np.ones(len(own.words), np.int64)
        shares[several] = many
        order, cost = np.argsort(own.parts(shares, parts), kind="stable"), np.zeros(len(own.first), np.int64)
        cost[order] = np.concatenate([unpacked(back[p])[0] for p in sorted(back)])
        score = -STEP * own.add(cost[own.pair])
        columns = [chunk["ids"][0].values, own.held, own.n, known, np.full(len(own.n), n), base, score, 10 ** np.minimum(-score / own.n, 300)]
        return pa.table([pa.array(x) if not isinstance(x, pa.Array) else x for x in columns], names=[c.split()[0] for c in result.split(", ")])

    return chunks.groupBy("chunk").cogroup(costs.groupBy("chunk")).applyInArrow(give, result)
