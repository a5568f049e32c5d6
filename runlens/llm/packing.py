"""Best-fit packing: a configuration linear program over the histogram of lengths, rounded to whole sequences."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from runlens.llm.common import cut, ship
from runlens.llm.tokens import byte_encoder, vocabulary_path


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `size` tokens but the first, which may be shorter."""
    first = n % size or size
    return [(0, first)] + [(a, size) for a in range(first, n, size)]


Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first
Plan = list[tuple[Pattern, int]]  # pattern and number of sequences


class Knapsack:
    """The pricing problem: pieces of most value for every room up to `size`, by dynamic programming over the lengths."""

    def __init__(self, price: np.ndarray, lengths: np.ndarray, size: int):
        self.size, self.lengths, self.price = size, lengths, price[lengths]
        worth = np.full(size + 1, -np.inf)
        worth[lengths] = self.price
        back = worth[::-1]  # back[size - l] = price[l]
        best = self.best = np.zeros(size + 1)
        for c in range(1, size + 1):
            best[c] = max(best[c - 1], (best[:c] + back[size - c : size]).max())  # index j: length c - j on top of the best for j

    def draw(self, room: np.ndarray, weight: np.ndarray, counts: np.ndarray, slack: float, rng: np.random.Generator) -> np.ndarray:
        """For each room one filling, as copies by length, drawn from those whose value is the best up to `slack`.

        One length after the other is drawn with the given weights from those that keep the value; of one that
        leaves room for more, a quarter of what fits is taken at once, so the steps are few.
        """
        out, room, alive = np.zeros((len(room), self.size + 1), np.int32), room.copy(), np.arange(len(room))
        weight = weight[self.lengths]
        while len(alive):
            c = room[alive]
            rest = c[:, None] - self.lengths
            ok = rest >= 0
            lost = self.best[c][:, None] - self.price - self.best[np.maximum(rest, 0)]
            w = np.cumsum(np.where(ok & (lost <= slack), weight, 0.0), axis=1)
            go = w[:, -1] > 0
            alive, c, w = alive[go], c[go], w[go]
            k = (w < rng.random((len(w), 1)) * w[:, -1:]).sum(axis=1)
            k = np.minimum(k, len(self.lengths) - 1)
            l = self.lengths[k]
            many = np.minimum(np.maximum(c // l // 4, 1), np.maximum(counts[l], 1))
            several = (many > 1) & (self.best[c] - many * self.price[k] - self.best[np.maximum(c - many * l, 0)] <= slack)
            many = np.where(several, many, 1)
            out[alive, l] += many
            room[alive] -= l * many
        return out


@dataclass
class Solution:
    """Patterns with how often each is used, as fractions that cover every length alike, and what that is worth."""

    patterns: np.ndarray  # rows of copies by length
    uses: np.ndarray
    value: float  # sequences that the fractions need to cover all
    bound: float  # no packing has fewer sequences: the best dual value


def solve(counts: np.ndarray, size: int, rounds: int = 24, steps: int = 120, gap: float = 0.01, eta: float = 0.02, slack: float = 0.0006, seed: int = 3) -> Solution:
    """The configuration linear program (cover all pieces by as few patterns as can be) by multiplicative weights.

    A length's price is its size times exp(eta * lag of its cover behind the mean). Each round solves the pricing
    knapsack; each length whose cover lags gets a column, drawn from the patterns that hold it and whose value is
    the best up to `slack` (many are: the draw by what is not covered yet spreads the use over all lengths). Columns
    are used by what their length lacks, an equal share of all tokens a round. Then the columns' uses are evened out in
    `steps` of the same kind over all columns at once (`even_out`). Prices over the best pattern's value are a dual
    solution, which bounds the number of sequences from below; `gap` below it, the steps end. The work depends on the
    number of lengths, not on the counts.
    """
    lengths, sizes, rng = np.flatnonzero(counts), np.arange(size + 1), np.random.default_rng(seed)
    if not len(lengths):
        return Solution(np.zeros((0, size + 1), np.int16), np.zeros(0), 0.0, 0.0)
    need, tokens = counts.astype(float), float((counts * sizes).sum())
    cover, bound = np.zeros(size + 1), 0.0
    rows, uses = [], []
    for r in range(rounds):
        mean = (cover * need * sizes).sum() / tokens
        price = sizes / size * np.exp(np.maximum(eta * (mean - cover), -20))
        sack = Knapsack(price, lengths, size)
        bound = max(bound, float((need * price).sum() / sack.best[size]))
        lag = np.maximum((r + 1) / rounds - cover[lengths], 0)
        worth = price[lengths] + sack.best[size - lengths]
        own = np.flatnonzero((lag > 0) & (worth >= sack.best[size] - slack))
        if len(own) < 8 or not r:  # a column for each length at first, and where no best pattern holds those that lag
            own = np.flatnonzero(lag > 0)
        weight = need * sizes * np.maximum((r + 1.5) / rounds - cover, 0.02 / rounds)
        columns = sack.draw(size - lengths[own], weight, counts, slack, rng)
        columns[np.arange(len(own)), lengths[own]] += 1
        fits = (columns <= counts).all(axis=1)
        own, columns = own[fits], columns[fits]
        if not len(own):
            continue
        use = need[lengths[own]] * lag[own] / columns[np.arange(len(own)), lengths[own]]
        use *= tokens / rounds / max((use * (columns @ sizes)).sum(), 1e-9)
        rows.append(columns.astype(np.int16))
        uses.append(use)
        cover += (use @ columns) / np.maximum(need, 1)
    for l in np.flatnonzero((sum(x.any(axis=0) for x in rows) if rows else np.zeros(size + 1)) == 0):
        if counts[l]:  # no column holds it yet: one of its own
            rows.append((sizes == l)[None].astype(np.int16))
            uses.append(np.full(1, 1e-6))
    patterns, x = np.concatenate(rows), np.concatenate(uses)
    x, value = even_out(patterns, x, counts, size, bound, steps, gap)
    return Solution(patterns, x, value, bound)


def even_out(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray, size: int, bound: float, steps: int, gap: float) -> tuple[np.ndarray, float]:
    """Uses of the given columns after multiplicative steps, scaled to the bound's number of sequences, and the value of
    the cover of all lengths that they give: a column's use follows what its pieces are worth at the prices
    size * exp(beta * (1 - cover)), with beta growing from step to step."""
    column, l = np.nonzero(patterns)
    k, need, lengths = patterns[column, l].astype(float), np.maximum(counts, 1).astype(float), np.flatnonzero(counts)
    best, x, value = x, x + 1e-6, np.inf
    for step in range(steps):
        cover = np.bincount(l, k * x[column], size + 1) / need
        now = x.sum() / max(cover[lengths].min(), 1e-12)
        if now < value:
            best, value = x, now
        if value <= (1 + gap) * bound:
            break
        price = np.arange(size + 1) / size * np.exp(np.clip((4 + 0.1 * step) * (1 - cover), -6, 6))
        worth = np.bincount(column, k * price[l], len(x))
        x = x * np.clip((worth * x.sum() / (x * worth).sum()) ** 0.3, 0.7, 1.4)
        x = x * bound / x.sum()
    return best * bound / best.sum(), value


def best_fit(counts: np.ndarray, size: int) -> Plan:
    """Best-fit decreasing over the histogram: equal sequences are filled together, so the work depends on the number
    of lengths, not on the counts. A length goes, as often as it fits, to the sequences with the least room for it."""
    room: list[list[list]] = [[] for _ in range(size + 1)]  # by room: [pattern, number of sequences]
    open_ = np.zeros(size + 1, bool)
    for l in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[l])
        while n:
            fit = np.flatnonzero(open_[l:])
            r = l + int(fit[0]) if len(fit) else size
            pattern, many = room[r].pop() if len(fit) else ((), -(-n // (size // l)))
            open_[r] = bool(room[r])
            k = r // l
            full, rest = min(many, n // k), 0
            if full < many:
                rest = n - full * k if full * k < n else 0
            for copies, bins in ((k, full), (rest, 1 if rest else 0), (0, many - full - (1 if rest else 0))):
                if bins:
                    own = (*pattern, (l, copies)) if copies else pattern
                    room[r - copies * l].append([own, bins])
                    open_[r - copies * l] = True
            n -= full * k + rest
    return [(pattern, n) for stack in room for pattern, n in stack if pattern]


def rounded(counts: np.ndarray, solution: Solution, size: int) -> tuple[Plan, np.ndarray]:
    """Whole numbers of sequences from the program's fractions, and the counts that are left.

    Whole parts are taken first; then the fractions are shared out: the patterns go, those of the largest fractions
    first, as often as their fraction rounded up, while all their pieces are there.
    """
    left = counts.astype(np.int64).copy()
    out: Plan = []
    whole = np.floor(solution.uses).astype(np.int64)
    order = np.argsort(-(solution.uses - whole), kind="stable")
    for k, n in [*((k, int(whole[k])) for k in np.flatnonzero(whole).tolist()), *((k, 1) for k in order.tolist())]:
        row = solution.patterns[k]
        at = np.flatnonzero(row)
        n = min(n, int((left[at] // row[at]).min()))
        if n > 0:
            out.append((tuple(zip(at[::-1].tolist(), row[at][::-1].tolist())), n))
            left[at] -= n * row[at].astype(np.int64)
    return out, left


def given_back(patterns: Plan, counts: np.ndarray, part: float) -> tuple[Plan, np.ndarray]:
    """The plan without a part of its sequences, those with the smallest pieces first, and the counts with their pieces."""
    want, kept, counts = int(np.ceil(part * sum(n for _, n in patterns))), [], counts.copy()
    for p, n in sorted(patterns, key=lambda x: min(l for l, _ in x[0])):
        back = min(n, want)
        want -= back
        for l, k in p:
            counts[l] += back * k
        if n > back:
            kept.append((p, n - back))
    return kept, counts


def plan(counts: np.ndarray, size: int, passes: int = 6, fill: float = 0.99, parts: tuple[float, ...] = (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1)) -> tuple[Plan, int]:
    """(plan, tokens that the program's patterns hold) for pieces by length.

    The program is solved and rounded; what is left is solved and rounded again, while that places pieces, at most
    `passes` times. Patterns that are less than `fill` as full as the program's sequences are on the whole are given back, as
    others may use their pieces better, and best fit packs what no pattern holds. Small pieces are what fills gaps, so the
    rounding is repaired by giving back growing parts of the sequences with the smallest ones: the part that ends in the
    fewest sequences is taken, of equal ones the smallest. The last part is all of them, so the plan never has more sequences
    than best fit alone.
    """
    out: Plan = []
    left, usual = counts.astype(np.int64).copy(), 0.0
    for k in range(passes):
        program = solve(left, size, rounds=24 if not k else 10)
        got, rest = rounded(left, program, size)
        usual = usual or float((left * np.arange(size + 1)).sum()) / max(program.value, 1)
        placed = False
        for p, n in got:
            if sum(l * c for l, c in p) >= fill * usual:
                out.append((p, n))
                placed = True
            else:
                for l, c in p:
                    rest[l] += n * c
        left = rest
        if not placed or not left.any():
            break
    tries = []
    for part in parts:
        kept, rest = given_back(out, left, part)
        tries.append((kept, kept + best_fit(rest, size)))
    kept, best = min(tries, key=lambda t: sum(n for _, n in t[1]))
    return best, sum(n * l * c for p, n in kept for l, c in p)


def slots(plan: list, size: int, base: int) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """For each length the places that its pieces take in order -> (first rank, first sequence, copies in a sequence, offset)."""
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    for pattern, n in plan:
        offset = 0
        for l, k in pattern:
            places.setdefault(l, []).append((taken[l], base, k, offset))
            taken[l] += k * n
            offset += l * k
        base += n
    return {l: tuple(np.array(x, np.int64) for x in zip(*rows)) for l, rows in places.items()}, base


def encode_pieces(docs: DataFrame, id_col: str, text_col: str, size: int, path: str | None, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; texts are encoded once, ids stay in the task."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path or vocabulary_path())
        for b in batches:
            owner, rows = [], []
            for k, ids in enumerate(encoder.batch([x or "" for x in b.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for p, (a, n) in enumerate(pieces_of(len(ids), size)):
                    owner.append(k)
                    rows.append((p, a, n, zlib.crc32(ids[a : a + n])))
            piece, start, length, crc = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
            columns = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, path: str | None = None, end_id: int = 0, salts: int = 256) -> DataFrame:
    """Packs documents into sequences of at most `size` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and `end_id`; only longer ones are cut, into pieces of `size` tokens of which the first
    may be shorter. Only the histogram of lengths (at most `size` numbers) reaches the driver. There the
    configuration linear program is solved (see `solve`) and rounded (`plan`); the plan, bounded by the number of
    lengths too, goes to the tasks, which give the k-th piece of a length the k-th place for that length. Ranks come
    from windows over (length, salt) and a prefix sum over the salts, so a length that a third of all pieces have
    is dealt over `salts` keys.

    Null and empty texts are one token, the end. A null identifier is kept; repeated rows are packed each. An empty
    table gives no rows. Other columns are ignored. Sequences that hold one whole piece come after the others.
    """
    pieces = encode_pieces(docs, id_col, text_col, size, path, end_id)
    pieces = cut(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        counts[r["length"]] = r["n"]
    whole, counts[size] = int(counts[size]), 0
    where, base = slots(plan(counts, size)[0], size, 0)
    where[size] = (np.array([0]), np.array([base]), np.array([1]), np.array([0]))

    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    firsts = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("nth", nth).join(firsts, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            length, rank = t["length"].to_numpy(), t["rank"].to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, start, copies, offset = where[int(length[part[0]])]
                k = np.searchsorted(first, rank[part], side="right") - 1
                i = rank[part] - first[k]
                seq[part] = start[k] + i // copies[k]
                off[part] = offset[k] + i % copies[k] * length[part]
            keep = [t[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield from pa.Table.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
