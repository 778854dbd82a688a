"""Token ids of whole texts with a byte-level BPE vocabulary.

The vocabulary is a file of ranks. Its pattern looks ahead in one place only, where several
white-space characters meet; texts without such a place are split by the pattern without
that part, which is faster and finds the same. Ids equal those of the same vocabulary in
other libraries (tested): a special token that stands in a text is that token.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

_AHEAD = r"\s+(?!\S)|"


# --- fixed value: the special token of the vocabulary ---
SPECIAL = {"<|endoftext|>": 50256}
# --- end of fixed value ---


class Encoder:
    """``encode`` gives the ids of a text as an array."""

    def __init__(self, path: str | None = None, special: dict[str, int] = SPECIAL) -> None:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        make = lambda pattern: tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = tuple(special)
        self.bpe = make(public_tokenizers.PATTERN)
        self.plain = make(public_tokenizers.PATTERN.replace(_AHEAD, ""))
        # Wider than the pattern's white space, so that no text is wrongly split plainly.
        self.runs = re.compile(r"[\s\x85]{2}")

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.bpe.encode(text, allowed_special="all"), np.uint32)
        bpe = self.bpe if self.runs.search(text) else self.plain
        return np.frombuffer(array("I", bpe.encode_ordinary(text)), np.uint32)

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its text ends a sentence or a line."""
        out = np.zeros(self.bpe.n_vocab, bool)
        for i in range(self.bpe.n_vocab):
            try:
                out[i] = self.bpe.decode_single_token_bytes(i)[-1:] in (b".", b"!", b"?", b"\n")
            except KeyError:
                pass
        return out


def token_blocks(batches, encoder: Encoder, most: int, extra: list[str]):
    """Documents of Arrow ``batches`` as blocks of about ``most`` tokens: ids of all documents
    one after the other, each with id 0 at its end, where each begins, and a dict of lists
    with the ``extra`` columns. A document is never split between blocks."""
    ids, columns, size = [], {c: [] for c in extra}, 0
    for batch in batches:
        texts = batch.column("text")
        own = {c: batch.column(c).to_pylist() for c in extra}
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            ids += [encoder.encode(text) if text else _NONE, _END]
            for c in extra:
                columns[c].append(own[c][i])
            size += len(ids[-2]) + 1
            if size >= most:
                yield _block(ids, columns)
                ids, columns, size = [], {c: [] for c in extra}, 0
    if ids:
        yield _block(ids, columns)


_NONE, _END = np.zeros(0, np.uint32), np.zeros(1, np.uint32)


def _block(ids: list, columns: dict):
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(lengths[0::2] + lengths[1::2])]), columns
