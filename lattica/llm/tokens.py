"""Byte-level BPE ids of whole texts, quickly and exactly.

Merges never cross the borders of the pieces that the tokenizer's own pattern cuts, and a space
before a visible character always begins a piece. So a text is cut at such spaces, the ids of what
lies between are kept in a bounded table, and the ids of a text are theirs in a row. What is not in
the table is cut to pieces with ``re`` and encoded piece by piece. Texts that hold a special token,
or a character on which the classes of ``re`` could differ from the tokenizer's, go to the
tokenizer whole.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: The tokenizer's split pattern, letters first; the alternatives exclude each other.
_PIECE = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: All but ASCII, Latin, Greek and Cyrillic letters and common punctuation.
_ODD = re.compile("[^\x00-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ϿЀ-ҁҊ-ԯ‐-‧€]")
_GAP = re.compile(r" (?:\s|\Z)")
MEMO = 500_000


def _byte_characters() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids(texts): little-endian unsigned 32-bit ids of each text, as bytes; path is the tokenizer's JSON file."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo = Tokenizer.from_file(path), memo, {}
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.single = self._ranked(path)

    def _ranked(self, path: str):
        """The encoder of single pieces, if the vocabulary's ids are the merges' ranks; else None, and pieces go to the tokenizer."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary, of = model["vocab"], _byte_characters()
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
        core = getattr(tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)
        return getattr(core, "encode_single_piece", None)  # no public name; without it pieces go to the tokenizer

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> bytes:
        if not self.single:
            return self._whole([text])[0]
        ids: list[int] = []
        for p in _PIECE.findall(text):
            ids += self.single(p.encode())
        return np.array(ids, "<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        memo = self.memo
        for text in texts:
            if _ODD.search(text) or any(s in text for s in self.special):
                out += self._whole([text])
                continue
            if _GAP.search(text):
                out.append(self._pieces(text))
                continue
            first, *rest = text.split(" ")
            head = self._pieces(first)
            try:
                out.append(head + b"".join(map(memo.__getitem__, rest)))
            except KeyError:
                new = {w for w in rest if w not in memo}
                if len(memo) + len(new) > self.most:
                    memo.clear()
                    new = set(rest)
                for w in new:
                    memo[w] = self._pieces(" " + w)
                out.append(head + b"".join(map(memo.__getitem__, rest)))
        return out

    def byte_lengths(self) -> np.ndarray:
        """UTF-8 bytes that each id stands for."""
        special = {k: v.content for k, v in self.tokenizer.get_added_tokens_decoder().items()}
        # a byte-level vocabulary writes each byte as one character
        return np.array([len(special[i].encode()) if i in special else len(self.tokenizer.id_to_token(i)) for i in range(self.tokenizer.get_vocab_size())], "i8")


_open: dict[tuple, Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    """One encoder for each worker process."""
    if (path, memo) not in _open:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _open[path, memo] = Encoder(path, memo)
    return _open[path, memo]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
