"""Token ids of whole texts for the packing operators.

Ids are those of the ``tokenizers`` file ``byte_bpe_50k.json``.  The same
vocabulary exists as ranks for ``tiktoken``, whose encoder is about four
times as fast; the two differ at most where their Unicode tables do.  So
texts made of characters below U+0250 and general punctuation go through
``tiktoken``, all others through ``tokenizers`` itself, and so do texts that
contain an added token of the file: it has its own id there.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np

from tablewright.llm.common import quiet_threads, vocabulary

#: Characters whose class is the same in every Unicode version that the libraries may carry.
_OTHER = re.compile(r"[^\x00-ɏ‐-‧‰-⁞€™]")
END_ID = 2


@functools.cache
def _exact(name: str):
    quiet_threads()
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary(f"{name}.json"))


@functools.cache
def _added(name: str) -> re.Pattern:
    """Finds the contents of the file's added tokens."""
    words = [t.content for t in _exact(name).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, words)) or r"(?!)", re.I)


@functools.cache
def _fast(name: str):
    import public_tokenizers
    import tiktoken
    with open(vocabulary(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    if _OTHER.search(text) is None and _added(name).search(text) is None:
        return np.asarray(_fast(name).encode_ordinary(text), "<u4")
    return np.asarray(_exact(name).encode(text, add_special_tokens=False).ids, "<u4")


def document_ids(text: str | None, name: str = "byte_bpe_50k", end_id: int | None = END_ID) -> np.ndarray:
    """Ids of a document, ended by ``end_id``; null text is the empty text."""
    ids = encode(text, name) if text else np.zeros(0, "<u4")
    return ids if end_id is None else np.append(ids, np.uint32(end_id)).astype("<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only longer ones are cut, the first piece may be shorter."""
    first = n % size or size
    return [(0, n)] if n <= size else [(0, first), *((k, size) for k in range(first, n, size))]
