"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can't be merged across,
so every place between two such bytes is a token boundary for certain. Texts are cut
there with one table lookup for each byte; the fragments (words with their space, as
a rule, since a byte-level vocabulary has no token with a space behind a letter) are
encoded on their own, equal ones once, and their ids put in a row again.

A cut must not change how the tokenizer splits a text before merging, either. Its split
pattern reads from the left, looks ahead only behind white space, and takes contractions
(an apostrophe and letters) apart. So no cut is made behind white space, within a
character, or in front of an apostrophe that follows neither an ASCII letter nor a digit.
At any other place the pattern either ends a piece anyway, or stands inside a run of one
class (letters, digits, others), which it would find in two halves: then both halves
merge as they do together, for nothing is merged across the place.

Strings of special tokens are found before all that, as the tokenizer does.

Decoding joins the bytes of all ids and reads them as UTF-8; bytes that aren't UTF-8
(ids from elsewhere may make such) become U+FFFD.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated
rows are encoded repeatedly; a null doc_id stays null; other columns are ignored; no
documents give no rows. A fragment is as long as the text has it: a text without any
forced boundary is one fragment.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_worker, map_chunks, spans_of

#: Fragments whose ids a Python worker keeps (some 150 bytes each); all are forgotten beyond that number, or 64 bytes or 8 ids for each.
CACHE_FRAGMENTS = 400_000
#: New fragments encoded in one text.
JOINED = 256


def byte_of_letter() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Ids of texts, and texts of ids, by a byte-level vocabulary of the ``tokenizers`` library."""

    def __init__(self, path: str, cache: int = CACHE_FRAGMENTS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {x.content: i for i, x in added.items()}
        if any(x.lstrip or x.rstrip or x.single_word for x in added.values()):
            raise ValueError("special tokens that take in what is around them are not supported")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_of_letter()
        self.tokens: dict[int, bytes] = {i: t.encode() for t, i in self.special.items()}
        inside = np.zeros((256, 256), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            data = bytes(letters[c] for c in token)
            self.tokens[i] = data
            raw = np.frombuffer(data, np.uint8)
            inside[raw[:-1], raw[1:]] = True
        self.forced = ~inside
        # pairs of which the second byte goes on with a character, or the first is ASCII white space or a control character
        self.forced[:, 0x80:0xC0] = False
        self.forced[:0x21] = self.forced[0x7F] = False
        word = np.zeros(256, bool)
        word[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        self.forced[~word, 0x27] = False
        self.opens = self.forced[:, 0x20].tolist()
        sizes = np.array([len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)], np.int64)
        self.token_ends = np.cumsum(sizes)
        self.token_sizes = sizes
        self.token_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(sizes))), np.uint8)
        self.clear()

    def clear(self) -> None:
        """Forget all fragments."""
        self.rows: dict[bytes, int] = {}
        self.at, self.n, self.ids, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32), 0
        self.held = 0

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        """Places of UTF-8 bytes in front of which the text may be cut."""
        at = np.flatnonzero(self.forced[raw[:-1], raw[1:]]) + 1
        before = raw[at - 1]
        far = at[before >= 0x80]  # white space beyond ASCII: two bytes from C2, three from E1 to E3
        a, b, c = raw[far - 1], raw[np.maximum(far - 2, 0)], raw[np.maximum(far - 3, 0)]
        blank = ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((c >= 0xE1) & (c <= 0xE3) & ((b == 0x80) | (b == 0x81) | (b == 0x9A)))
        fine = np.ones(len(at), bool)
        fine[before >= 0x80] = ~blank
        return at[fine]

    def _learn(self, fragments: list[bytes]) -> None:
        """Encode new fragments and keep their ids.

        Many with a space in front are encoded in one text: between them is a forced boundary again, so ids end where they end.
        """
        # fragments that end in ASCII, which is neither white space nor a control character as the table has it
        joined = [f[0] == 32 and f[-1] < 0x80 and self.opens[f[-1]] for f in fragments]
        fragments = [f for f, j in zip(fragments, joined) if j] + [f for f, j in zip(fragments, joined) if not j]
        together = sum(joined)
        texts = [b"".join(fragments[k : min(k + JOINED, together)]).decode("utf-8") for k in range(0, together, JOINED)]
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(texts + [f.decode("utf-8") for f in fragments[together:]], add_special_tokens=False)]
        found = np.fromiter((i for x in coded for i in x), np.uint32, sum(map(len, coded)))
        last = np.cumsum(np.fromiter(map(len, fragments), np.int64, len(fragments)))
        ends = np.searchsorted(np.cumsum(self.token_sizes[found]), last) + 1
        n = np.diff(ends, prepend=0)
        first, total = len(self.rows), len(found)
        while first + len(n) > len(self.n):
            self.at, self.n = np.concatenate([self.at, self.at]), np.concatenate([self.n, self.n])
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + total, np.uint32)])
        self.n[first : first + len(n)] = n
        self.at[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + total] = found
        self.used += total
        self.held += int(last[-1])
        self.rows.update(zip(fragments, range(first, first + len(n))))

    def _plain(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        data = b"".join(parts)
        if not data:
            return [np.zeros(0, np.uint32)] * len(parts)
        raw, edges = np.frombuffer(data, np.uint8), np.cumsum([0] + [len(p) for p in parts])
        ends = np.zeros(len(raw) + 1, bool)
        ends[self.cuts(raw)] = True
        ends[edges] = True
        places = np.flatnonzero(ends)
        spans = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)])
        coded = spans.dictionary_encode()
        fragments, code = spans_of(coded.dictionary), coded.indices.to_numpy()
        if len(self.rows) > self.cache or self.used > 8 * self.cache or self.held > 64 * self.cache:
            self.clear()
        new = [f for f in fragments if f not in self.rows]
        if new:
            self._learn(new)
        row = np.fromiter(map(self.rows.__getitem__, fragments), np.int64, len(fragments))[code]
        counts = self.n[row]
        total = np.cumsum(counts)
        ids = self.ids[np.repeat(self.at[row] - total + counts, counts) + np.arange(total[-1])]
        last = np.concatenate([[0], total])[np.searchsorted(places, edges)]
        return [ids[a:b] for a, b in zip(last[:-1].tolist(), last[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        pieces: list[bytes] = []
        owners: list[list] = []
        for text in texts:
            split = self.marks.split(text) if self.marks else [text]
            owners.append([self.special[x] if k % 2 else len(pieces) + k // 2 for k, x in enumerate(split)])
            pieces += [x.encode("utf-8") for x in split[::2]]
        coded = self._plain(pieces)
        out = []
        for owner in owners:
            found = [np.array([x], np.uint32) if k % 2 else coded[x] for k, x in enumerate(owner)]
            out.append(found[0] if len(found) == 1 else np.concatenate(found))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens; ids that the vocabulary lacks have none."""
        ids = ids[ids < len(self.token_sizes)]
        counts = self.token_sizes[ids]
        total = np.cumsum(counts)
        return self.token_bytes[np.repeat(self.token_ends[ids] - total, counts) + np.arange(total[-1] if len(total) else 0)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def bpe(path: str) -> ForcedBoundaryBPE:
    """The encoder of this Python worker, kept from task to task."""
    return in_worker(f"bpe {path}", lambda: ForcedBoundaryBPE(path))


def encode_documents(docs: DataFrame, tokenizer_path: str, column: str = "text") -> DataFrame:
    """doc_id and the ids (array of int) of every row's whole text."""

    def encode(columns: list[list]) -> list:
        ids = bpe(tokenizer_path).encode([t or "" for t in columns[1]])
        offsets = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
        return [columns[0], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))]

    return map_chunks(docs.selectExpr("cast(doc_id as bigint) doc_id", f"`{column}` text"), "doc_id bigint, ids array<int>", encode, rows=4096)


def decode_documents(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of the ids of every row; a null array is an empty text, null ids in it have no bytes."""

    def decode(columns: list[list]) -> list[list]:
        coder = bpe(tokenizer_path)
        return [columns[0], [coder.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in columns[1]]]

    return map_chunks(coded.selectExpr("cast(doc_id as bigint) doc_id", "ids"), "doc_id bigint, text string", decode)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``: encoded, then decoded from the ids."""

    def digest(columns: list[list]) -> list[list]:
        coder = bpe(tokenizer_path)
        coded = coder.encode([t or "" for t in columns[1]])
        return [
            columns[0],
            [len(ids) for ids in coded],
            [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in coded],
            [hashlib.sha256(coder.decode(ids).encode("utf-8")).hexdigest() for ids in coded],
        ]

    return map_chunks(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", digest, rows=4096)
