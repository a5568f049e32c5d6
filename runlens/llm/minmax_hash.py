"""Near duplicates by min-max hashing: both ends of every permutation are signature values, links are confirmed on full sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ship, stored
from runlens.llm.simhash import connected

U = np.uint64
PERMUTATIONS, BANDS = 64, 32  # a band: the minimum and maximum of two permutations, four values
_draw = np.random.default_rng(12).integers(0, 1 << 64, (2, PERMUTATIONS), U)
FLIP, TIMES = _draw[0][:, None], (_draw[1] | U(1))[:, None]
_PLACE = (np.random.default_rng(5).integers(0, 1 << 64, 64, U)) | U(1)
PERCENT = 85


class _Words(dict):
    """XXH64 of words; emptied when it holds a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def shingles(text: str | None, width: int, words: _Words) -> np.ndarray:
    """64-bit hashes of the distinct word shingles of a text, rising; one of the whole sequence for fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] alone
    if not found:
        return np.zeros(0, U)
    h = np.fromiter(map(words.__getitem__, found), U, len(found))
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, U)
    for k in range(size):
        out += h[k : len(h) - size + 1 + k] * _PLACE[k % len(_PLACE)]
    return np.unique(_mixed(out))


def signature(x: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a non-empty set under each permutation; one evaluation serves both."""
    low, high = np.full(PERMUTATIONS, ~U(0)), np.zeros(PERMUTATIONS, U)
    for a in range(0, len(x), block):
        v = (x[None, a : a + block] ^ FLIP) * TIMES
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One hash a band of its four values and its number."""
    v = np.stack([low[0::2], high[0::2], low[1::2], high[1::2]])
    return _mixed((_mixed(v) * _PLACE[8:12, None]).sum(axis=0, dtype=U) + np.arange(1, BANDS + 1, dtype=U) * _PLACE[12])


def short(low: np.ndarray, high: np.ndarray) -> bytes:
    """One byte of each of the 128 values: enough to estimate a similarity."""
    return ((np.concatenate([low, high]) >> U(16)) & U(255)).astype(np.uint8).tobytes()


def least_agreement(percent: int, lost: float = 1e-9) -> int:
    """The number of equal values below which two sets of this similarity fall with a chance of at most `lost`."""
    n, p, tail = 2 * PERMUTATIONS, percent / 100, 0.0
    for k in range(n):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail > lost:
            return k
    return n


def prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n, s, sig, keys) of every row: size, digest, short signature and band keys of its set; s is null for none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            n, s, sig, keys = [], [], [], []
            for t in b.column(1):
                x = shingles(t.as_py(), width, words)
                n.append(len(x))
                if len(x):
                    low, high = signature(x)
                    s.append(xxhash.xxh3_128_digest(x.tobytes()))
                    sig.append(short(low, high))
                    keys.append(band_keys(low, high).view(np.int64))
                else:
                    s.append(None)
                    sig.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "s", "sig", "keys"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n long, s binary, sig binary, keys array<long>")


def confirm(edges: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 256) -> DataFrame:
    """(a, b, linked) of edges (a, b) between sets, decided on the full sets of their texts (s, text).

    The edges of one a are worked on in blocks, each with a's text once before the others; so an a with very many edges
    is spread over many tasks, and a task holds one set and the present row.
    """
    heads = edges.groupBy("a").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rows = edges.join(heads, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    rows = rows.join(texts.withColumnRenamed("s", "b"), "b").select("a", "part", "b", "text")
    first = heads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(texts.withColumnRenamed("s", "a"), "a")
    met = rows.unionByName(first.select("a", "part", F.lit(None).cast("binary").alias("b"), "text"))
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, own = _Words(), np.zeros(0, U)
        for batch in batches:
            a, b, linked = [], [], []
            for x, y, t in zip(batch.column(0), batch.column(2), batch.column(3)):
                s = shingles(t.as_py(), width, words)
                if not y.is_valid:
                    own = s
                    continue
                at = np.searchsorted(own, s)
                both = int((own[np.minimum(at, len(own) - 1)] == s).sum())
                a.append(x.as_py())
                b.append(y.as_py())
                linked.append(100 * both >= percent * (len(own) + len(s) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return met.mapInArrow(run, "a binary, b binary, linked boolean")


def _places(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs work on the rows of each (key, place), which must lie together; a task holds the rows of one place and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            place, key = b["place"].to_numpy(), b["key"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(place) != 0)) + 1).tolist(), b.num_rows]
            if held and (held[-1]["place"][-1] != b["place"][0] or held[-1]["key"][-1] != b["key"][0]):
                yield from work(pa.Table.from_batches(held))
                held = []
            for x, y in zip(cuts, cuts[1:]):
                if x:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(x, y - x))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _components(t: pa.Table) -> np.ndarray:
    return np.unique(np.array(t["comp"].to_pylist(), object), return_inverse=True)[1]


def _open_ends(percent: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """The sets of a place that size and signature do not rule out to be linked with one of another component there."""
    least = least_agreement(percent)

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        comp = _components(t)
        if comp.max(initial=0) == 0:
            return
        n, sig = t["n"].to_numpy(), np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
        step = max(1, (8 << 20) // sig.size)
        open_ = np.zeros(len(n), bool)
        for a in range(0, len(n), step):
            part = slice(a, a + step)
            agree = (sig[part, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.int16)
            low, high = np.minimum(n[part, None], n), np.maximum(n[part, None], n)
            open_[part] = ((agree >= least) & (100 * low >= percent * high) & (comp[part, None] != comp)).any(axis=1)
        if open_.any():
            yield from t.select(["key", "place", "s", "comp"]).filter(pa.array(open_)).combine_chunks().to_batches()

    return work


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of two different sets. What one set alone holds is left out, the rest goes through products of
    blocks of a 0/1 matrix."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[column] > 1
    owner, column = owner[use], shared[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        x, y = np.searchsorted(column, (a, a + columns))
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[x:y], column[x:y] - a] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _links(width: int, percent: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    """Links (a, b) between the components of a place's sets, found on the full sets of their texts: all that are needed to join
    the components that any link joins, and no more."""
    words = _Words()

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        comp = _components(t)
        if comp.max(initial=0) == 0:
            return
        sets = [shingles(x.as_py(), width, words) for x in t["text"]]
        both = overlaps(sets)
        n = np.array([len(x) for x in sets])
        i, j = np.nonzero(np.triu((100 * both >= percent * (n[:, None] + n - both)) & (comp[:, None] != comp)))
        _, first = np.unique(np.minimum(comp[i], comp[j]) * len(n) + np.maximum(comp[i], comp[j]), return_index=True)
        up = list(range(len(n)))
        a, b, s = [], [], t["s"].to_pylist()
        for x, y in zip(i[first].tolist(), j[first].tolist()):
            p, q = comp[x], comp[y]
            while up[p] != p:
                p = up[p]
            while up[q] != q:
                q = up[q]
            if p != q:
                up[max(p, q)] = min(p, q)
                a.append(s[x])
                b.append(s[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return work


def _dealt(rows: DataFrame, sizes: DataFrame, hot: int) -> DataFrame:
    """Rows (key, s, ...) with a `place`: buckets of more than `hot` sets (sizes: key, members) are dealt in parts, and
    each pair of parts is a place of its own; exact, with bounded memory."""
    rows = rows.join(sizes.select("key", F.ceil(F.col("members") / hot).cast("long").alias("parts")), "key")
    own = F.pmod(F.xxhash64("s"), F.col("parts"))
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda t: F.least(t, F.col("own")) * F.lit(1 << 30) + F.greatest(t, F.col("own")))
    return rows.withColumn("own", own).withColumn("place", F.explode(places)).drop("own", "parts")


def linked_sets(sets: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, hot: int) -> DataFrame | None:
    """(fp, root): the smallest set that links of `percent` or more lead to, for all sets (s, least, n, sig, keys) with a link.

    Sets that share a band key meet in its bucket. First each set is held against one other, the first of the bucket that
    it shares most bands with: groups of copies are mostly connected by that. Then within each bucket all pairs of sets in
    different components count: sets whose sizes and signatures rule out any such link drop out, the texts of the others go
    to the bucket, where all pairs are decided at once and only links that join components leave the task. So the rows that
    are moved follow the sets and their bands, never the pairs, and no link between components is left out but by the
    bands' and the signatures' chance (see near_duplicates).
    """
    places = sets.select("s", F.explode("keys").alias("key"))
    first = places.groupBy("key").agg(F.min("s").alias("first"), F.count("*").alias("members")).where("members > 1")
    met = stored(places.join(first, "key"), "minmax-buckets")
    stars = met.where("s <> first").groupBy("s", "first").agg(F.count("*").alias("bands"))
    stars = stars.groupBy("s").agg(F.min(F.struct((-F.col("bands")).alias("bands"), F.col("first").alias("a"))).alias("e")).select("e.a", F.col("s").alias("b"))

    wanted = met.select("s").distinct().join(sets.select("s", "least"), "s")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = own.join(wanted, own["id"].eqNullSafe(wanted["least"])).select("s", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # an identifier may stand for several texts
        words = _Words()
        for b in batches:
            yield b.filter(pa.array([xxhash.xxh3_128_digest(shingles(t.as_py(), width, words).tobytes()) == s.as_py() for s, t in zip(b.column(0), b.column(1))], pa.bool_()))

    texts = stored(own.mapInArrow(same, "s binary, text string").dropDuplicates(["s"]), "minmax-texts")
    links = stored(confirm(stars, texts, width, percent).where("linked").select(F.col("a").alias("fp"), F.col("b").alias("to")), "minmax-stars")
    roots = None if links.isEmpty() else connected(links)

    rows = met.select("key", "s")
    if roots is not None:
        rows = rows.join(roots.select(F.col("fp").alias("s"), F.col("root").alias("comp")), "s", "left").withColumn("comp", F.coalesce("comp", "s"))
    else:
        rows = rows.withColumn("comp", F.col("s"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members")).where("x <> y").select("key", "members")
    at_place = lambda x: x.repartition("key", "place").sortWithinPartitions("key", "place", "s")
    rows = at_place(_dealt(rows.join(sets.select("s", "n", "sig"), "s"), mixed, hot)).select("key", "place", "s", "comp", "n", "sig")
    open_ = rows.mapInArrow(_places(_open_ends(percent)), "key long, place long, s binary, comp binary")
    found = at_place(open_.join(texts, "s")).select("key", "place", "s", "comp", "text").mapInArrow(lambda batches: _places(_links(width, percent))(batches), "a binary, b binary")
    more = stored(found.select(F.col("a").alias("fp"), F.col("b").alias("to")).distinct(), "minmax-links")
    return roots if more.isEmpty() else connected(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = PERCENT, hot: int = 1024) -> DataFrame:
    """Components of near-duplicate texts: doc_id, n_shingles, component_id (the smallest identifier reachable), kept.

    A text's set holds its distinct shingles of `width` words, lower-cased in A-Z, as 64-bit hashes. Texts link if the
    sets' intersection is at least `percent` % of their union, which is always decided on the full sets. Candidates come
    from min-max hashing: of 64 permutations both the minimum and the maximum are kept, 128 values from 64 evaluations,
    each pair of which agrees with a chance of the similarity, and varies less than 128 minima would. 32 bands of four
    values: a pair at 85 % shares none with a chance of (1 - 0.85 ** 4) ** 32 = 6e-11, nearer ones with less. Equal sets
    are worked on once. Buckets of more than `hot` sets are dealt in parts, each pair of which is worked on by itself.
    A pair at 85 % agrees in too few of the 128 values with a chance of 1e-9 (`least_agreement`).

    Fewer words than `width`: one shingle, the whole sequence. Null, empty and blank texts have no shingle and are linked
    with nothing. A null identifier is never the smallest, unless all of a component are null (then component_id is null).
    kept: doc_id is component_id, so repeated rows of one identifier are all kept. A very long text is worked on as a
    whole in memory that follows its own length. An empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = stored(prints(docs, id_col, text_col, width), "minmax-prints")
    some = rows.where(F.col("s").isNotNull())
    sets = some.groupBy("s").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    sets = stored(sets, "minmax-sets")
    roots = linked_sets(sets, docs, id_col, text_col, width, percent, hot)
    of = sets.select("s", "least").join(roots.withColumnRenamed("fp", "s"), "s", "left").select("s", "least", F.coalesce("root", "s").alias("root")) if roots is not None else sets.select("s", "least", F.col("s").alias("root"))
    ids = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s", "component_id")
    # Rows of one set are dealt over 64 keys, so that a text with very many copies is no hot key.
    dealt = rows.select("doc_id", F.col("n").alias("n_shingles"), "s", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("run"))
    down = dealt.where(F.col("s").isNotNull()).select("s", "run").distinct().join(ids, "s")
    out = dealt.join(down, ["s", "run"], "left")
    component_id = F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def keep_representatives(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that near_duplicates keeps, with all their columns."""
    ids = groups.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_kept_id"]), "left_semi")
