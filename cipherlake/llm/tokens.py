"""Token ids of whole texts with the public byte-level vocabulary.

The vocabulary file (a parameter) is the JSON of a byte-level BPE tokenizer whose ids follow its merge order. Ids are
computed by a second library from the ranks in that file, which is several times faster and gives the same ids; texts
with extreme runs of white space, which its pattern engine can't take, go through the first library."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

SEPARATOR = 0
_LONG_BLANK = re.compile(r"\s{2000,}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = _byte_alphabet()
        ranks = {bytes(letters[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.plain = Tokenizer.from_file(path)

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text (none for null) and the separator id after them."""
        if not text:
            found = np.empty(0, np.uint32)
        elif _LONG_BLANK.search(text):
            found = np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            found = self.fast.encode_to_numpy(text, allowed_special="all")
        return np.append(found, np.uint32(SEPARATOR)).astype("<u4")


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: one if it fits, else a first piece with the remainder and
    full pieces after it, so that only one piece of a long document is shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]
