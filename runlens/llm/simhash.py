"""SimHash fingerprints of word shingles, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut, ship

BITS, BLOCKS = 64, 5
#: First bit and width of each of the five blocks: two fingerprints at 4 or fewer differing bits agree in one block at least.
SPANS = tuple((BITS * k // BLOCKS, BITS * (k + 1) // BLOCKS - BITS * k // BLOCKS) for k in range(BLOCKS))
MAX_DIFF = 4
U = np.uint64


def fingerprint(text: str | None, width: int = 4, seed: int = 42, step: int = 1 << 15) -> int:
    """The 64-bit majority of the XXH64 hashes of a text's word shingles, repeats included; 0 for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for a in range(0, n, step):  # bounded memory for very long texts
        h = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts[a : min(n, a + step)], last[a : a + step])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the Gray order: the prefix xor of its bits."""
    x = x.astype(U)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class _Forest:
    """Disjoint sets over positions, with the smallest position as the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return self.up
            self.up = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        r = self.roots()
        a, b = r[a], r[b]
        far = a != b
        if not far.any():
            return
        pairs = np.unique(np.stack([np.minimum(a[far], b[far]), np.maximum(a[far], b[far])], 1), axis=0)
        up = self.up
        for x, y in pairs.tolist():
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)


def gray_index(words: np.ndarray, group: np.ndarray, fan_out: int = 8) -> list[dict]:
    """Levels of the index over words that are sorted by (group, Gray rank), from the leaves' parents up to one root a group.

    A node covers neighbours of one group and holds the bits on which all of them agree (`mask`, `bits`). `rest` is
    what its mask adds to its parent's: on the way down differences are counted on these bits only and summed up.
    """
    n = len(words)
    lo, hi, bits, mask = np.arange(n), np.arange(1, n + 1), words.copy(), np.full(n, ~U(0))
    levels = [{"lo": lo, "hi": hi, "bits": bits, "mask": mask}]
    while True:
        g = group[lo]
        place = np.arange(len(lo)) - np.searchsorted(g, g)
        first = np.flatnonzero(place % fan_out == 0)
        if len(first) == len(lo):
            break
        common = np.bitwise_and.reduceat(mask, first)
        every, some = np.bitwise_and.reduceat(bits, first), np.bitwise_or.reduceat(bits & mask, first)
        same = common & ~(every ^ some)
        below = np.append(first, len(lo))
        parent = np.repeat(np.arange(len(first)), np.diff(below))
        levels[-1]["rest"] = mask & ~same[parent]
        lo, hi, bits, mask = lo[first], hi[below[1:] - 1], every & same, same
        levels.append({"lo": lo, "hi": hi, "bits": bits, "mask": mask, "child": below[:-1], "children": np.diff(below)})
    levels[-1]["rest"] = mask
    return levels


def link(words: np.ndarray, group: np.ndarray, max_diff: int = MAX_DIFF, queries: int = 1 << 15) -> np.ndarray:
    """For each word the position of the smallest-placed word that links of max_diff or fewer bits within its group lead to.

    Words must be sorted by (group, Gray rank). Neighbours are linked first; then blocks of words go down the
    index as queries. A node is left out as soon as its accumulated differences exceed the limit, or if all that it
    covers is already connected with the query: dense clusters cost little, and no link between components is lost.
    """
    n = len(words)
    forest = _Forest(n)
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(words[1:] ^ words[:-1]) <= max_diff))
    forest.join(near, near + 1)
    levels = gray_index(words, group)
    top = len(levels) - 1
    root_of = np.searchsorted(levels[top]["lo"], np.arange(n), side="right") - 1
    at = 0
    while at < n:
        q = np.arange(at, min(n, at + queries))
        at += queries
        comp = forest.roots()
        node, diff = root_of[q], np.zeros(len(q), np.int64)
        for k in range(top, -1, -1):
            x = levels[k]
            diff = diff + np.bitwise_count((words[q] ^ x["bits"][node]) & x["rest"][node])
            least, most = np.minimum.reduceat(comp, x["lo"]), np.maximum.reduceat(comp, x["lo"])
            open_ = (diff <= max_diff) & ~((least[node] == comp[q]) & (most[node] == comp[q])) & (x["lo"][node] < q)
            q, node, diff = q[open_], node[open_], diff[open_]
            if k:
                times = x["children"][node]
                first = np.repeat(x["child"][node], times)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                node, q, diff = first + step, np.repeat(q, times), np.repeat(diff, times)
        forest.join(q, node)
    return forest.roots()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, key, fp) of one partition, sorted by (part, key, rank) -> (fp, to): each word with the first of its set."""
    held: list[pa.RecordBatch] = []

    def run(tables: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(tables)
        fp = t["fp"].to_numpy().view(U)
        part, key = t["part"].to_numpy(), t["key"].to_numpy()
        group = np.concatenate([[0], np.cumsum((part[1:] != part[:-1]) | (key[1:] != key[:-1]))])
        to = link(fp, group)
        own = to != np.arange(len(fp))
        if own.any():
            return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[to[own]].view(np.int64))], names=["fp", "to"])
        return None

    size = 0
    for b in batches:  # whole groups are worked on together, about a million words at a time
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= 1_000_000:
            t = pa.Table.from_batches(held).combine_chunks()
            part, key = t["part"].to_numpy(), t["key"].to_numpy()
            change = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1]))
            if len(change):
                at = int(change[-1]) + 1
                if (out := run(t.slice(0, at).to_batches())) is not None:
                    yield out
                held, size = t.slice(at).to_batches(), t.num_rows - at
    if held and (out := run(held)) is not None:
        yield out


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(fp, root) for every end of the edges (fp, to): the smallest end that is reachable.

    Large-star and small-star rounds as joins and aggregations, each round written to the shared checkpoint folder.
    """
    edges = cut(edges.where("fp <> to").select(F.greatest("fp", "to").alias("a"), F.least("fp", "to").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(small.where("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        if now == seen:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, hot: int = 100_000) -> DataFrame:
    """Fingerprint and component of every row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest identifier reachable. Equal
    fingerprints are worked on once. Each distinct fingerprint goes to five places, one for each of five blocks of
    bits, keyed by that block's value: any linked pair meets in one of them. In a place the words are sorted by the
    Gray rank of the rotated fingerprint and linked by the hierarchical index (see `link`); only a star of each set
    found there leaves the task. A place with more than `hot` words is dealt in S parts, and each pair of parts is a
    place of its own: exact, with bounded memory.

    A text with fewer than `width` words has one shingle, the whole sequence; null, empty and blank texts have
    fingerprint 0, which links like any other. A null identifier never is the smallest unless all are null. Repeated
    rows are returned as often as they are given. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    rows = cut(rows.mapInArrow(prints, f"doc_id {kind.simpleString()}, fp long"))
    words = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))

    turned = lambda s: F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", BITS - s)) if s else F.col("fp")
    places = F.array(*[
        F.struct(F.lit(k).alias("part"), turned((BITS - a - w) % BITS).alias("turned"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1).cast("long")).alias("key"))
        for k, (a, w) in enumerate(SPANS)
    ])
    placed = words.select("fp", F.explode(places).alias("p")).select("fp", "p.*")
    large = placed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("part", "key", F.ceil(F.col("n") / hot).cast("long").alias("s"))
    dealt = placed.join(large, ["part", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("s", F.lit(1)))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("s", F.lit(1)) - 1), lambda t: F.least(t, F.col("own")) * F.lit(1 << 20) + F.greatest(t, F.col("own")))
    dealt = dealt.withColumn("own", own).withColumn("pair", F.explode(pairs))
    dealt = dealt.select((F.col("part") + F.lit(BLOCKS) * F.col("pair")).alias("part"), "key", "turned", "fp")
    met = dealt.repartition("part", "key").sortWithinPartitions("part", "key", F.shiftrightunsigned(_gray(F.col("turned")), 1), "fp")
    found = met.select("part", "key", "fp").mapInArrow(_linked, "fp long, to long")

    root = connected(found)
    labelled = words.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    word_ids = labelled.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(word_ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _gray(x: Column) -> Column:
    """gray_rank as a column, on the signed form; steps nest, so each reuses the one before through a bound variable."""
    step = lambda s: lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, s))
    steps = F.array(x)
    for s in (1, 2, 4, 8, 16, 32):
        steps = F.transform(steps, step(s))
    return steps[0]


def keep_representatives(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose identifier is the smallest of their component: one document of each group stays."""
    ids = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_id"]), "left_semi")
