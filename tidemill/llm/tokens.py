"""Tokenizer helpers used inside tasks. Tokenizers are read from public vocabulary files and are never trained."""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np

#: Distinct chunks that a worker's memo of token counts may hold before it starts anew, and bytes of a chunk in it.
MEMO_CHUNKS, MEMO_BYTES = 500_000, 64


def public_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=8)
def file_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of ``path`` as its library loads it, on one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=4)
def ranked(path: str, special: tuple[tuple[str, int], ...]):
    """The same byte-level BPE vocabulary through the faster ranks library."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


class ByteBPE:
    """Ids of a byte-level BPE file, equal to ``tokenizers`` without added special tokens.

    ``tokenizers`` splits with the public pattern and merges by rank; the ranks file beside it holds
    the same vocabulary, so the ranks library gives the same ids about five times as fast. A text that
    holds a special string goes through ``tokenizers`` itself. Tests compare both on whole tables.
    """

    def __init__(self, path: str):
        import json

        with open(path) as f:
            added = json.load(f)["added_tokens"]
        self.special = [t["content"] for t in added]
        self.path = path
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = ranked(ranks, ()) if os.path.exists(ranks) else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


class Counter:
    """Token counts of whole texts as the library of ``path`` gives them, without added special tokens.

    Where the tokenizer drops white space (``by_chunk``), no token spans it, so a text's count is the sum
    over its chunks between ASCII white space, and each distinct chunk is encoded once per memo.
    """

    def __init__(self, path: str):
        self.path, self.memo = path, {}
        self.by_chunk = path.endswith(".json") and drops_white_space(path)

    def _library(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in library(self.path).encode(texts, num_threads=1)]
        return [len(x) for x in library(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.by_chunk:
            return self._library(texts)
        chunks = [t.encode("utf-8").split() for t in texts]
        if len(self.memo) > MEMO_CHUNKS:
            self.memo = {}
        memo, long_ones = self.memo, {}
        new = list({c for cs in chunks for c in cs if c not in memo})
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            for chunk, n in zip(part, self._library([c.decode("utf-8") for c in part]), strict=True):
                (memo if len(chunk) <= MEMO_BYTES else long_ones)[chunk] = n
        if long_ones:
            return [sum(memo[c] if c in memo else long_ones[c] for c in cs) for cs in chunks]
        return [sum(map(memo.__getitem__, cs)) for cs in chunks]


def drops_white_space(path: str) -> bool:
    """Whether the file's own settings squeeze white space and then keep only what its split pattern matches outside it."""
    import json

    with open(path) as f:
        d = json.load(f)
    normal = (d.get("normalizer") or {}).get("normalizers", [])
    split = ((d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    squeezes = any(n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
    outside = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    return bool(squeezes and outside and all(not any(ch.isspace() for ch in t["content"]) for t in d["added_tokens"]))


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)
