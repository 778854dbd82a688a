"""Fill-in-middle: documents cut into prefix, middle and suffix at token borders, and rearranged.

A token is a run of ASCII letters or one other character. Texts are never tokenised as a whole:
a rolling hash over the last ``WINDOW`` bytes cuts them into chunks by content, so passages that
documents share give equal chunks. The summary of a chunk - tokens that start in it, its
characters, whether a letter stands at either border - is taken once per task and found again
in a cache whose entries are compared by content, not by hash. Two chunks join by one rule: a letter
on both sides of the border means that the right one's first token has begun before. Running sums
of the joined counts lead to the chunk that a cut falls into, and only that chunk is looked at closely.

The cache is bounded by ``CACHE_BYTES`` and forgets what it has not met for longest, which
changes the time a text takes, never its result. Tasks hold one batch of texts and the cache;
nothing is shuffled.

Null text counts as empty, and empty text stays as it is (form ``plain``, no tokens). Cuts
are drawn from the id alone, a null id as an empty one, so rows that share an id are cut alike by
their own lengths, and repeated rows give repeated results. A text that holds a marker stays as it
is. Cuts may leave parts empty. An empty table gives no rows; other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

WINDOW = 32  # bytes the rolling hash sees, a power of two
CHUNK_BITS = 9  # a chunk has about 2**CHUNK_BITS bytes
LONGEST = 8192  # bytes of a chunk at most
CACHE_BYTES = 32 << 20
ROWS = 256  # outputs held at a time
SEED = "1"

# --- fixed values: markers and shares (of 100) of the forms ---
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
# --- end of fixed values ---

PLAIN, PSM, SPM = "plain", "psm", "spm"

# One 32-bit number per byte value, by a multiplicative rule; sums of shifted ones tell windows apart.
_GEAR = ((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.uint32)


def _letters(data: np.ndarray) -> np.ndarray:
    low = data | 0x20
    return (low >= 97) & (low <= 122)


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash of the ``WINDOW`` bytes that end at each byte, by doubling."""
    total, width = _GEAR[data], 1
    while width < WINDOW:
        total[width:] += total[:-width] << np.uint32(width)
        width *= 2
    return total


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text: where the hash says so, between whole characters."""
    top = np.uint32(32 - CHUNK_BITS)
    ends = np.flatnonzero((window_hashes(data) >> top) == 0) + 1
    ends = ends[ends >= WINDOW]  # earlier windows are not full
    ends = np.append(ends[ends < data.size], data.size)
    wide = np.flatnonzero(np.diff(ends, prepend=0) > LONGEST)
    if wide.size:  # no cut by content for long: cut by length
        starts = np.concatenate([[0], ends[:-1]])
        ends = np.union1d(ends, np.concatenate([np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in wide]))
    inside = ends[:-1]  # not within a character: at most three bytes of one follow
    for _ in range(3):
        follows = (inside < data.size) & ((data[np.minimum(inside, data.size - 1)] & 0xC0) == 0x80)
        inside = inside + follows
    return np.unique(np.append(inside, data.size))


class Summary(NamedTuple):
    """What a chunk tells of itself, taken alone."""

    tokens: int
    characters: int
    letter_first: bool
    letter_last: bool


def token_starts(data: np.ndarray) -> np.ndarray:
    """Bytes at which tokens start, of whole characters taken alone."""
    letter = _letters(data)
    goes_on = letter.copy()
    goes_on[0] = False
    goes_on[1:] &= letter[:-1]
    return np.flatnonzero(~goes_on & ((data & 0xC0) != 0x80))


def summary(chunk: bytes) -> Summary:
    data = np.frombuffer(chunk, np.uint8)
    letter = _letters(data[[0, -1]])
    return Summary(token_starts(data).size, int(((data & 0xC0) != 0x80).sum()), bool(letter[0]), bool(letter[1]))


class Cache:
    """Summaries by content; those not met for longest leave first."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.limit, self.held, self.known, self.found = limit, 0, OrderedDict(), 0

    def __call__(self, chunk: bytes) -> Summary:
        known = self.known.get(chunk)
        if known is not None:
            self.known.move_to_end(chunk)
            self.found += 1
            return known
        known = self.known[chunk] = summary(chunk)
        self.held += len(chunk) + 200
        while self.held > self.limit:
            old, _ = self.known.popitem(last=False)
            self.held -= len(old) + 200
        return known


class Chunked:
    """A text by the summaries of its chunks."""

    def __init__(self, text: bytes, cache: Cache) -> None:
        self.text = text
        data = np.frombuffer(text, np.uint8)
        self.ends = chunk_ends(data).tolist() if text else []
        self.starts = [0, *self.ends[:-1]]
        parts = [cache(text[a:b]) for a, b in zip(self.starts, self.ends)]
        self.joined = [bool(i and p.letter_first and parts[i - 1].letter_last) for i, p in enumerate(parts)]
        begun = [p.tokens - j for p, j in zip(parts, self.joined)]
        self.tokens_before = np.concatenate([[0], np.cumsum(begun, dtype=np.int64)])
        self.characters_before = np.concatenate([[0], np.cumsum([p.characters for p in parts], dtype=np.int64)])

    @property
    def tokens(self) -> int:
        return int(self.tokens_before[-1])

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and characters before token number ``units``, counted from 0."""
        if units >= self.tokens:
            return len(self.text), int(self.characters_before[-1])
        i = int(np.searchsorted(self.tokens_before, units, side="right")) - 1
        chunk = np.frombuffer(self.text, np.uint8)[self.starts[i]:self.ends[i]]
        place = int(token_starts(chunk)[units - int(self.tokens_before[i]) + self.joined[i]])
        before = int(((chunk[:place] & 0xC0) != 0x80).sum())
        return self.starts[i] + place, int(self.characters_before[i]) + before


def draws(doc_id: int | None, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(doc_id: int | None, text: bytes, cache: Cache, seed: str = SEED) -> tuple:
    """(tokens, form, characters of prefix and of middle, output) of one document."""
    chunked = Chunked(text, cache)
    first, second, kept, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or kept % 100 >= TRANSFORMED:
        return chunked.tokens, PLAIN, None, None, text
    low, high = sorted((first % (chunked.tokens + 1), second % (chunked.tokens + 1)))
    (a, a_characters), (b, b_characters) = chunked.cut(low), chunked.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SUFFIX_FIRST:
        form, output = SPM, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, output = PSM, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return chunked.tokens, form, a_characters, b_characters - a_characters, output


def restored(output: bytes, form: str) -> bytes:
    """The text behind an output. Texts with markers are never rearranged, so each is there once."""
    if form == PLAIN:
        return output
    lead, other = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    head, rest = output[len(lead):].split(other, 1)
    tail, middle = rest.split(MIDDLE, 1)
    return head + middle + tail if form == PSM else tail + middle + head


def fill_in_middle(docs: DataFrame, seed: str = SEED, digests: bool = False) -> DataFrame:
    """A row per row of ``docs``: doc_id, n tokens, form, prefix_chars, middle_chars, output.

    ``digests`` gives output_sha256 and restored_sha256, the hash of the text rebuilt from
    output and form, in place of the output.
    """
    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches):
        import pyarrow as pa

        cache = Cache()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * (1 + digests)
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"] + (
            ["output_sha256", "restored_sha256"] if digests else ["output"])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):  # outputs of a few texts at a time
                part = batch.slice(at, ROWS)
                found = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    *head, output = rearranged(doc_id, (text or "").encode(), cache, seed)
                    last = [sha(output), sha(restored(output, head[1]))] if digests else [output.decode()]
                    found.append((doc_id, *head, *last))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=names)

    last = "output_sha256 string, restored_sha256 string" if digests else "output string"
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        run, f"doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, {last}")
