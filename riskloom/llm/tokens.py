"""Token ids of texts under a public byte-level BPE vocabulary.

The vocabulary is a parameter (the ``tokenizers`` JSON file). ``tiktoken`` applies the same
merges and splitting pattern several times faster, so it encodes every text except those that
spell out a special token, which go through ``tokenizers`` itself. Tests hold the two equal.
"""

from __future__ import annotations

import json
import re

_cache: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        import tiktoken
        import public_tokenizers
        spec = json.load(open(path, encoding="utf-8"))
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # byte-level vocabularies spell byte values as printable characters
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in printable]
        char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(char[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.path, self._slow = path, None

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.special is not None and self.special.search(text):
            if self._slow is None:
                from tokenizers import Tokenizer
                self._slow = Tokenizer.from_file(self.path)
            return self._slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _cache:
        _cache[path] = Encoder(path)
    return _cache[path]
