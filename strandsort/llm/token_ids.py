"""Token ids of whole texts by a byte-level BPE tokenizer file, as the ``tokenizers`` library gives them.

The file's vocabulary is handed to ``tiktoken``, which merges by rank: ids of a byte-level BPE vocabulary are in the
order of its merges. That takes a fifth of the time. The few texts whose runs of white space are too long for its
pattern matcher are encoded by the library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: the splitting pattern of byte-level tokenizers that set ``use_regex``.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenIds:
    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        splitting = told["pre_tokenizer"] or {}
        if told["model"]["type"] != "BPE" or told["normalizer"] or splitting.get("type") != "ByteLevel" or splitting.get("add_prefix_space") or not splitting.get("use_regex"):
            raise ValueError(f"Not a plain byte-level BPE tokenizer: {path}")
        byte_of = byte_characters()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.encoding = Encoding("of-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def whole(self, text: str) -> bytes:
        """By the library."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; strings of special tokens inside the text are those tokens, as in the library."""
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except ValueError:  # the pattern matcher's stack is full
            return self.whole(text)


@lru_cache(1)
def token_ids(path: str) -> TokenIds:
    """Kept for the next task in this Python worker."""
    return TokenIds(path)
