"""How filters overlap, for every order in which they could be applied: decision diagrams of failure masks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ship, stored

#: The filters of `interaction_audit`, by letter; bit k of a mask is set where filter k fails.
FILTERS = "ABCDE"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = "#$%&*|"

Weight = tuple[int, ...]


def text_mask(text: str) -> int:
    """Bits of the filters that look at a text alone: under 200 words, under half of them distinct, over 3 % capitals, a symbol."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: [\x20\x09-\x0D] alone
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * len(text)) << 2 | any(c in text for c in SYMBOLS) << 3


class Node:
    """A test of one filter: where documents that pass and that fail go on, and the weights of all below."""

    __slots__ = ("passed", "failed", "weight")

    def __init__(self, passed: Node | None, failed: Node | None, weight: Weight):
        self.passed, self.failed, self.weight = passed, failed, weight


class Diagram:
    """A decision diagram over failure masks, one level a filter, whose leaves and nodes carry weights (counts).

    Equal parts are shared. `swap` exchanges two neighbouring levels in place, so nodes above stay as they are; the
    weights of the new lower nodes are sums of their leaves' weights. `all_pass` walks the path on which nothing fails.
    """

    def __init__(self, counts: Mapping[int, Weight], filters: int):
        self.order = list(range(filters))
        width = len(next(iter(counts.values()), ()))
        self.levels: list[list[Node]] = [[] for _ in range(filters)]
        shared: dict = {}

        def build(level: int, mask: int) -> Node:
            if level == filters:
                w = counts.get(mask, (0,) * width)
                return shared.setdefault(w, Node(None, None, w))
            return self._node(shared, level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _node(self, shared: dict, level: int, passed: Node, failed: Node) -> Node:
        key = level, id(passed), id(failed)
        if key not in shared:
            shared[key] = Node(passed, failed, tuple(map(sum, zip(passed.weight, failed.weight))))
            self.levels[level].append(shared[key])
        return shared[key]

    def swap(self, level: int) -> None:
        """Exchanges the filters of this level and the next; what the diagram counts stays the same."""
        shared: dict = {}
        self.levels[level + 1] = []
        for node in self.levels[level]:
            p, f = node.passed, node.failed
            node.passed, node.failed = self._node(shared, level + 1, p.passed, f.passed), self._node(shared, level + 1, p.failed, f.failed)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> list[tuple[int, Weight, Weight]]:
        """(filter, weights kept, weights removed) of each step of the present order."""
        node, out = self.root, []
        for v in self.order:
            out.append((v, node.passed.weight, node.failed.weight))
            node = node.passed
        return out

    def only(self, v: int) -> Weight:
        """Weights of what fails filter v and passes all others."""
        node = self.root
        for x in self.order:
            node = node.failed if x == v else node.passed
        return node.weight


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places of neighbours to exchange, one after the other, so that all orders of n things are met once each
    (plain changes: each thing runs through the orders of those before it, to and fro)."""
    if n < 2:
        return
    inner, down = neighbour_swaps(n - 1), True
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        at = next(inner, None)
        if at is None:
            return
        yield at + down  # while the last thing stands in front, the others lie one further on
        down = not down


def audit_orders(counts: Mapping[int, Weight], names: Sequence[str]) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of the filters.

    counts: weights (documents, good, toxic) of each failure mask. One diagram goes through all orders by level swaps.
    """
    d = Diagram(counts, len(names))
    steps = {tuple(d.order): d.all_pass()}
    for level in neighbour_swaps(len(names)):
        d.swap(level)
        steps[tuple(d.order)] = d.all_pass()
    fails = {order[0]: path[0][2][0] for order, path in steps.items()}  # whoever comes first removes all that fail it
    only = {v: d.only(v)[0] for v in range(len(names))}
    share = {v: sum(gone[0] for path in steps.values() for x, _, gone in path if x == v) for v in range(len(names))}
    return [
        ("".join(names[v] for v in order), k + 1, kept[0], gone[0], fails[v] - gone[0], only[v], gone[1], gone[2], share[v])
        for order, path in sorted(steps.items())
        for k, (v, kept, gone) in enumerate(path)
    ]


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_masks(masks: DataFrame, names: Sequence[str] = FILTERS) -> DataFrame:
    """All orders and steps of each part, from rows (part, mask, n, good, toxic): a row a part and failure mask, so at
    most 2 ** len(names) of a part, which one task turns into one diagram."""
    ship(masks.sparkSession)

    def audit(rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(rows["mask"], rows["n"], rows["good"], rows["toxic"])}
        out = pd.DataFrame(audit_orders(counts, names), columns=["filter_order", "step", *COLUMNS])
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)
    return masks.select("part", "mask", "n", "good", "toxic").groupBy("part").applyInPandas(audit, schema)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: which of the filters A to E its whole text fails, as bits 0 to 4.

    E needs the whole table: a digest's smallest identifier comes from an aggregation that combines before it
    shuffles, and meets the rows by (identifier, digest), so that a text which a third of all rows share is no hot key.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            masks = pa.array([text_mask(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), masks, digests], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("t"))
    rows = stored(rows.mapInArrow(masked, f"doc_id {kind.simpleString()}, part string, mask int, digest binary"), "filter-masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "text")
    same = rows["doc_id"].eqNullSafe(first["least"]) & (rows["digest"] == first["text"])
    return rows.join(first, same, "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("text").isNull(), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What filters A to E keep and remove at each step of all 120 orders, for each part (language) of the documents.

    A: under 200 words. B: under half of the words are distinct. C: over 3 % of the code points are A-Z. D: holds one of
    `#$%&*|`. E: the text equals that of a row with a smaller identifier, wherever in the table that is. Per part,
    documents are counted by failure mask, and one diagram of these counts goes through all orders (`audit_orders`).
    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is empty (it fails A, and E if an earlier text is empty). A null part is the empty string. A null
    identifier is larger than any other. Rows that repeat one identifier and text are no copies of each other, and each
    counts. A document is good (toxic) if any of its label rows says quality (toxic) 1; unlabelled ones and null labels are
    neither. A very long text is looked at as a whole in memory that follows its own length. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.groupBy(F.col(id_col).alias("label_of")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    rows = failure_masks(docs, id_col, text_col, part_col)
    rows = rows.join(known, rows["doc_id"] == known["label_of"], "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    return audit_masks(rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic")))
