"""Token ids of the public byte-level vocabulary inside tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from runlens.llm.pieces import PLAIN, PieceTable, Splitter, spread

#: The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteEncoder:
    """Ids of the tokenizers library for byte-level vocabularies, with special tokens in texts recognised as it does.

    Plain texts are split together and each distinct piece is encoded once, in the rank form of the same
    vocabulary; a text with a special token's string, or with characters whose Unicode classes are less settled,
    goes through the tokenizers library as it is.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        table = byte_of_char()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        ranks = {bytes(table[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = self.library.get_vocab_size()
        self.widths = np.zeros(self.size, np.int64)  # bytes of each id
        for b, i in ranks.items():
            self.widths[i] = len(b)
        for t in spec["added_tokens"]:
            self.widths[t["id"]] = len(t["content"].encode())
        self.splitter, self.table = Splitter(keep_space=True), PieceTable(self._pieces)

    def _pieces(self, pieces: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.ranks.encode_ordinary(p) for p in pieces]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def batch(self, texts: Sequence[str], chars: int = 1 << 18) -> list[np.ndarray]:
        """uint32 ids of whole texts; texts are laid together up to about `chars` characters."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        held, size = [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            if not PLAIN.fullmatch(t) or (self.special and self.special.search(t)):
                out[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            held.append(k)
            size += len(t)
            if size >= chars:
                self._together(texts, held, out)
                held, size = [], 0
        if held:
            self._together(texts, held, out)
        return out

    def _together(self, texts: Sequence[str], held: list[int], out: list[np.ndarray]) -> None:
        text = "".join([texts[k] for k in held])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(texts[k]) for k in held])
        firsts = np.cumsum(lengths) - lengths
        start, end = self.splitter.split(codes, firsts)
        pool, at, n = self.table.look_up(codes, text, start, end)
        ids = spread(pool, at, n)
        done = np.concatenate([[0], np.cumsum(n)])
        cuts = done[np.searchsorted(start, np.append(firsts, len(codes)))]
        for k, a, b in zip(held, cuts[:-1].tolist(), cuts[1:].tolist()):
            out[k] = ids[a:b]


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each worker and vocabulary."""
    return ByteEncoder(path)
