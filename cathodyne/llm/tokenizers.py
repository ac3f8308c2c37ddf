"""Encoders of whole texts, made on each executor from a vocabulary file's bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from importlib.metadata import version

import numpy as np

#: The splitting pattern of byte-level BPE; a fixed value that must equal the vocabulary's own.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Unicode's white space, as the pattern means it, in runs that the pattern's look-ahead can't walk back over.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def version_digest(path: str, model: bytes) -> str:
    """Names the vocabulary and the version of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers" if path.endswith(".json") else "tiktoken"
    return f"{hashlib.sha256(model).hexdigest()}-{library}-{version(library)}"


def _by_ranks(e, text: str) -> list[int]:
    """Ids of a text. By the pattern a run of blanks is one piece, but for its last blank where something follows; long runs are cut out so."""
    ids, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += e.encode_ordinary(text[at : run.start()])
        ids += e._encode_single_piece(text[run.start() : end])
        at = end
    return ids + e.encode_ordinary(text[at:])


class Encoder:
    """Token ids of whole texts without begin, end or added special tokens, by the suffix of the file's name.

    ``.model``: sentencepiece; ``.json``: tokenizers, special strings in texts handled as by default;
    ``.tiktoken``: byte-level BPE ranks, special strings are ordinary text.
    """

    def __init__(self, path: str, model: bytes):
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.size, self.end = sp.get_piece_size(), sp.eos_id()
            self.encode = lambda texts: sp.encode(texts, num_threads=1)
            self.decode = sp.decode
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_buffer(model)
            t.no_truncation()
            t.no_padding()
            self.size, self.end = t.get_vocab_size(), t.get_vocab_size() - 1
            self.encode = lambda texts: [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]
            self.decode = t.decode
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model.splitlines())}
            e = tiktoken.Encoding("ranks", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 2
            self.end = self.size - 1
            self.encode = lambda texts: [_by_ranks(e, t) for t in texts]
            self.decode = e.decode
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def array(self, ids: list[int]) -> np.ndarray:
        return np.frombuffer(array("H" if self.dtype.itemsize == 2 else "I", ids), self.dtype)
