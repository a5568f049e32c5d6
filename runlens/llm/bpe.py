"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import ship
from runlens.llm.pieces import PLAIN, PieceTable, Splitter, spread
from runlens.llm.tokens import byte_of_char, vocabulary_path

#: The pre-tokenisation pattern of the word vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
NONE = np.int64(1) << 62


class MergeTable:
    """Rank and result of merging two adjacent symbols, from the vocabulary's merges in their order."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]]):
        self.n = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in merges], np.int64)
        result = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys, first = np.unique(keys, return_index=True)  # of a repeated pair the lowest rank counts
        self.keys, self.ranks, self.result = keys, first, result
        self.pairs = dict(zip(keys.tolist(), first.tolist()))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE for pairs without a merge (a negative symbol is none)."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE)


def merge_rows(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> np.ndarray:
    """Merges rows of symbols in place, each row through its own segment tree; returns which places still hold one.

    Leaf i of a row's tree is rank * width + i for the pair that starts at place i; each node holds the least of its
    two children, so the root is the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, the
    pair before it and the one that it swallows); each is brought up to the root in log2(width) steps.
    """
    rows, width = symbols.shape
    place = np.arange(width)
    alive = place < lengths[:, None]
    after = np.where(place + 1 < lengths[:, None], place + 1, -1)
    before = np.broadcast_to(place - 1, symbols.shape).copy()
    tree = np.full((rows, 2 * width), NONE, np.int64)
    rank = table.rank(symbols[:, :-1], np.where(alive[:, 1:], symbols[:, 1:], -1))
    tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + place[:-1], NONE)
    level = width
    while level > 1:
        half = level // 2
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
        level = half
    r = np.arange(rows)
    while True:
        root = tree[r, 1]
        r, root = r[root < NONE], root[root < NONE]
        if not len(r):
            return alive
        i, merged = root % width, table.result[root // width]
        j = after[r, i]
        k, h = after[r, j], before[r, i]
        symbols[r, i], alive[r, j], after[r, i] = merged, False, k
        behind, ahead = k >= 0, h >= 0
        before[r[behind], k[behind]] = i[behind]
        right = table.rank(merged, np.where(behind, symbols[r, k], -1))
        left = table.rank(np.where(ahead, symbols[r, h], -1), merged)
        tree[r, width + j] = NONE
        tree[r, width + i] = np.where(right < NONE, right * width + i, NONE)
        tree[r[ahead], width + h[ahead]] = np.where(left < NONE, left * width + h, NONE)[ahead]
        nodes = [width + i, width + j, width + np.where(ahead, h, i)]
        while nodes[0][0] > 1:
            nodes = [n >> 1 for n in nodes]
            for n in nodes:
                tree[r, n] = np.minimum(tree[r, 2 * n], tree[r, 2 * n + 1])


def merge_one(symbols: list[int], table: MergeTable) -> list[int]:
    """The same for one long word, with plain numbers: n log n steps."""
    n = len(symbols)
    width = 1 << max(1, (n - 1).bit_length())
    none, pairs, base, result = int(NONE), table.pairs, table.n, table.result.tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    tree = [none] * (2 * width)

    def leaf(i: int) -> int:
        rank = pairs.get(symbols[i] * base + symbols[after[i]]) if after[i] >= 0 else None
        return none if rank is None else rank * width + i

    for i in range(n):
        tree[width + i] = leaf(i)
    for x in range(width - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])
    alive = [True] * n
    while tree[1] < none:
        rank, i = divmod(tree[1], width)
        j = after[i]
        symbols[i], alive[j], after[i] = result[rank], False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for x in (i, j, before[i]) if before[i] >= 0 else (i, j):
            tree[width + x] = leaf(x) if alive[x] else none
            x = (width + x) >> 1
            while x:
                tree[x] = min(tree[2 * x], tree[2 * x + 1])
                x >>= 1
    return [s for s, a in zip(symbols, alive) if a]


class WordEncoder:
    """Encodes and decodes with a vocabulary of word ends: NFC, lower case, white space dropped, merges by `merge_rows`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = MergeTable(vocab, merges)
        chars = {b: c for c, b in byte_of_char().items()}
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + self.end] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.find = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.decimals = [str(i) for i in range(len(self.names))]
        self.splitter, self.pieces = Splitter(keep_space=False), PieceTable(self.words)

    def words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(b) for b in raw])
        ends = np.cumsum(lengths)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        first = self.inner[flat]
        first[ends - 1] = self.last[flat[ends - 1]]
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (words, their ids in order)
        low, width = 0, 4
        while low < lengths.max():
            own = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(own), max(1, (1 << 19) // width)):
                w = own[at : at + max(1, (1 << 19) // width)]
                if width > 64 and len(w) < 32:
                    got = [merge_one(first[ends[k] - lengths[k] : ends[k]].tolist(), self.table) for k in w.tolist()]
                    counts[w] = [len(x) for x in got]
                    parts.append((np.repeat(w, counts[w]), np.array([i for x in got for i in x], np.int64)))
                    continue
                place = np.arange(width)
                rows = first[np.minimum((ends - lengths)[w][:, None] + place, len(first) - 1)]
                rows[place >= lengths[w][:, None]] = -1
                alive = merge_rows(rows, lengths[w], self.table)
                counts[w] = alive.sum(axis=1)
                parts.append((np.repeat(w, counts[w]), rows[alive]))
            width *= 2
        owner, ids = (np.concatenate(x) for x in zip(*parts))
        return ids[np.argsort(owner, kind="stable")].astype(np.uint32), counts

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character lower-cased on its own."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def batch(self, texts: Sequence[str], chars: int = 1 << 18) -> list[np.ndarray]:
        """uint32 ids of whole texts."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held: list[tuple[int, str]] = []
        size = 0
        for k, t in enumerate(texts):
            if not t:
                continue
            if "<|" in t and self.find.search(t):
                out[k] = np.concatenate([np.array([self.special[x]], np.uint32) if x in self.special else self.batch([x])[0] for x in self.find.split(t) if x])
                continue
            t = self.normal(t)
            if not PLAIN.fullmatch(t):
                words = WORDS.findall(t)
                out[k] = self.words(words)[0] if words else out[k]
                continue
            held.append((k, t))
            size += len(t)
            if size >= chars:
                self._together(held, out)
                held, size = [], 0
        if held:
            self._together(held, out)
        return out

    def _together(self, held: list[tuple[int, str]], out: list[np.ndarray]) -> None:
        text = "".join([t for _, t in held])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for _, t in held])
        firsts = np.cumsum(lengths) - lengths
        start, end = self.splitter.split(codes, firsts)
        if not len(start):
            return
        pool, at, n = self.pieces.look_up(codes, text, start, end)
        ids = spread(pool, at, n)
        done = np.concatenate([[0], np.cumsum(n)])
        cuts = done[np.searchsorted(start, np.append(firsts, len(codes)))]
        for (k, _), a, b in zip(held, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[k] = ids[a:b]

    def decode(self, ids: np.ndarray) -> str:
        """The names of all ids, special ones too, with a space between."""
        names = self.names
        return " ".join([names[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker and vocabulary."""
    return WordEncoder(path)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Ids and decoded text of every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` ids and decoded.

    One pass without a shuffle: each distinct word of a batch is merged once by the segment tree (`merge_rows`), and
    a bounded table holds the ids of words seen before. Results equal the tokenizers library with this vocabulary,
    add_special_tokens=False, and its decode with special tokens kept.

    Null, empty and blank texts have no ids (the digests are those of the empty string). Special tokens' strings in a
    text become their ids. Very long texts and words cost n log n. A null identifier is kept, repeated rows are
    encoded each, an empty table gives no rows, other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path or vocabulary_path("word_bpe_49k.json"))
        digest, decimals = hashlib.sha256, encoder.decimals
        for b in batches:
            all_ids = encoder.batch([x or "" for x in b.column(1).to_pylist()])
            n, a, d, texts = [], [], [], []
            for ids in all_ids:
                own = ids.tolist()
                n.append(len(own))
                a.append(digest(" ".join([decimals[i] for i in own]).encode()).hexdigest())
                text = encoder.decode(ids)
                d.append(digest(text.encode()).hexdigest())
                if with_ids:
                    texts.append(text)
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([x.astype(np.int32) for x in all_ids], pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(run, schema)
