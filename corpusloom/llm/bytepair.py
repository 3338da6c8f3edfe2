"""Byte-level BPE vocabularies of public tokenizer files, loaded once per worker."""

from __future__ import annotations

import base64
import json
import os
from functools import lru_cache

import numpy as np

MERGES_JSON = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in such a vocabulary: itself, or the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of a text as the file's own library gives them, and how many bytes each id stands for.

    A byte-level vocabulary whose ids follow its merges is the same thing as a table of ranks, so texts go through
    the faster rank encoder; any other file is left to its own library. Special strings in a text become special ids.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.own = None
        if path.endswith(".tiktoken"):
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            special: dict[str, int] = {}
        else:
            with open(path, encoding="utf-8") as file:
                model = json.load(file)
            special = {t["content"]: t["id"] for t in model["added_tokens"]}
            letters = _byte_of_letter()
            vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
            made = [vocab[a + b] for a, b in merges]
            if made != sorted(made) or model["pre_tokenizer"]["type"] != "ByteLevel" or model.get("normalizer"):
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_file(path)
        self.ranked = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.bytes = np.zeros(self.size, np.int64)
        for token, i in ranks.items():
            self.bytes[i] = len(token)
        for token, i in special.items():
            self.bytes[i] = len(token.encode())

    def ids(self, text: str) -> list[int]:
        if self.own is not None:
            return self.own.encode(text, add_special_tokens=False).ids
        return self.ranked.encode(text, allowed_special="all")

    def plain_ids(self, text: str) -> list[int]:
        """Special strings are ordinary text."""
        return self.ranked.encode_ordinary(text)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
