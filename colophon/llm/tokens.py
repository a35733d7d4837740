"""The public tokenisers, as tasks use them.

The rank file of the byte-level vocabulary serves a faster library than its
``tokenizers`` file.  The two agree wherever a text is Latin; the faster one is not
asked for other scripts, nor for runs of white space that are long enough to
exhaust its stack.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

BYTE_BPE, PIECE_BPE = "byte_bpe_50k", "piece_bpe_32k"
SPECIAL = "<|endoftext|>"
#: White-space characters in a row that the faster library is trusted with.
LONGEST_SPACE = 10_000
_UNUSUAL = re.compile("[^\x00-ɏ]")
_SPACES = re.compile(r"\s+")


def tokenizer_folder() -> str:
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{BYTE_BPE}.json"))


def byte_ranks(folder: str) -> dict[bytes, int]:
    with open(f"{folder}/{BYTE_BPE}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def _byte_bpe(folder: str, plain: bool) -> tuple:
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(f"{folder}/{BYTE_BPE}.json")
    full.encode_special_tokens = plain
    return tiktoken.Encoding(BYTE_BPE, pat_str=PATTERN, mergeable_ranks=byte_ranks(folder), special_tokens={}), full


def _needs_full(text: str, plain: bool) -> bool:
    if _UNUSUAL.search(text) or (not plain and SPECIAL in text):
        return True
    return len(text) > LONGEST_SPACE and max((m.end() - m.start() for m in _SPACES.finditer(text)), default=0) > LONGEST_SPACE


def byte_ids(texts: list[str], folder: str, plain: bool = False) -> list[list[int]]:
    """Ids as the ``tokenizers`` file gives them; ``plain`` reads the special token's name as text."""
    fast, full = _byte_bpe(folder, plain)
    return [full.encode(t, add_special_tokens=False).ids if _needs_full(t, plain) else fast.encode_ordinary(t) for t in texts]


@lru_cache(maxsize=1)
def piece_model(folder: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECE_BPE}.model")


def piece_ids(texts: list[str], folder: str) -> list[list[int]]:
    return piece_model(folder).encode(texts, num_threads=1)
