"""Byte-pair encoding by forced boundaries, and decoding.

Merges only ever build tokens of the vocabulary. Two neighbouring bytes that stand side
by side in no token can therefore never be joined: between them a cut is certain. A
word is cut at all such places, the fragments are encoded independently, and their ids
are put one after the other. A fragment is short, whatever the length of the word, so
most of them are found in a table of fragments already encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallymark.llm.tables import map_rows, slices, worker_state

#: Fixed values of the vocabulary file: its word pattern, with white space spelled out, and
#: the white space that its normaliser collapses.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+"
WORD_END = "</w>"

#: Words kept in a worker's table; it is emptied when full.
CACHED_WORDS = 500_000
#: Longer words are encoded each time they occur.
CACHED_LENGTH = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(printable)))
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and forced cuts of one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        if spec["model"].get("end_of_word_suffix") != WORD_END or spec.get("decoder") is not None:
            raise ValueError("expected a vocabulary with word ends and no decoder")
        tokens = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in tokens.items()} | {i: t for t, i in self.special.items()}
        letters = byte_alphabet()
        self.first = [tokens[c] for c in letters]
        self.last = [tokens[c + WORD_END] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((tokens[left], tokens[right]), (rank, tokens[left + right]))
        byte_of = {c: b for b, c in enumerate(letters)}
        # joined[0]: pairs inside a token; joined[1]: pairs whose second byte ends the word.
        self.joined = np.zeros((2, 256, 256), bool)
        for token in tokens:
            ends = token.endswith(WORD_END)
            held = [byte_of[c] for c in (token[: -len(WORD_END)] if ends else token)]
            for i in range(len(held) - 1):
                self.joined[int(ends and i == len(held) - 2), held[i], held[i + 1]] = True
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def fragments(self, word: bytes) -> Iterator[tuple[bytes, bool]]:
        """Pieces between forced cuts, each with whether it ends the word."""
        if len(word) < 2:
            yield word, True
            return
        held = np.frombuffer(word, np.uint8)
        joined = self.joined[0, held[:-1], held[1:]]
        joined[-1] = self.joined[1, held[-2], held[-1]]
        cuts = [0, *(np.flatnonzero(~joined) + 1).tolist(), len(word)]
        for i in range(len(cuts) - 1):
            yield word[cuts[i] : cuts[i + 1]], i == len(cuts) - 2

    def encode_fragment(self, fragment: bytes, ends: bool) -> list[int]:
        """Lowest-ranked merges first, the leftmost of equal ones, by a heap over linked symbols."""
        ids = [self.first[b] for b in fragment]
        if ends:
            ids[-1] = self.last[fragment[-1]]
        if len(ids) == 1:
            return ids
        merges = self.merges
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []
        for i in range(len(ids) - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        size = len(ids)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
                if found := merges.get((merged, ids[after[i]])):
                    heapq.heappush(heap, (found[0], i, merged, ids[after[i]], found[1]))
            if before[i] >= 0 and (found := merges.get((ids[before[i]], merged))):
                heapq.heappush(heap, (found[0], before[i], ids[before[i]], merged, found[1]))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: str) -> bytes:
        """Ids of a word as little-endian unsigned 32-bit integers."""
        ids = []
        for fragment, ends in self.fragments(word.encode("utf-8", "surrogatepass")):
            ids += self.encode_fragment(fragment, ends)
        return np.array(ids, "<u4").tobytes()


class Words(dict):
    """Encoded words, filled as they are met and emptied when full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        found = self.vocabulary.encode_word(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    # A sigma at the end of a word becomes the same letter as any other.
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


_wide, _ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)


def encode_text(words: Words, text: str) -> bytes:
    """Ids of a whole text, packed; strings of special tokens become those tokens."""
    special = words.vocabulary.split_special
    if special is None or "<|" not in text:
        parts, marks = [text], []
    else:
        parts, marks = special.split(text), special.findall(text)
    packed = []
    for i, part in enumerate(parts):
        part = normalise(part)
        found = (_ascii if part.isascii() else _wide).findall(part)
        packed.extend(map(words.__getitem__, found))
        if i < len(marks):
            packed.append(np.array([words.vocabulary.special[marks[i]]], "<u4").tobytes())
    return b"".join(packed)


def decode_ids(vocabulary: Vocabulary, packed: bytes) -> str:
    """Tokens of packed ids, special ones too, with one space between them; unknown ids are left out."""
    token = vocabulary.token
    ids = np.frombuffer(packed, "<u4").tolist()
    try:
        return " ".join(map(token.__getitem__, ids))
    except KeyError:
        return " ".join(token[i] for i in ids if i in token)


def words_of(source: str) -> Words:
    """The worker's table for this vocabulary."""
    state = worker_state("bpe")
    key = hashlib.sha256(source.encode()).digest()
    if key not in state:
        state.clear()
        state[key] = Words(Vocabulary(source))
    return state[key]


def encode_documents(df: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, tokens, their ids and the text they decode to.

    ``id``, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit), ``decoded``. A null
    text counts as empty: no tokens, empty strings. Null ids stay null, repeated rows are
    encoded each, further columns are left out, an empty table gives none. The driver reads
    the vocabulary file, which bounds what is broadcast.
    """
    return _encoded(df, vocabulary_path, id_column, text_column, digests=False)


def encode_digests(df: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with lower-case SHA-256 of the ids and of the decoded text in their place."""
    return _encoded(df, vocabulary_path, id_column, text_column, digests=True)


def _encoded(df: DataFrame, vocabulary_path: str, id_column: str, text_column: str, digests: bool) -> DataFrame:
    with open(vocabulary_path, encoding="utf-8") as file:
        source = df.sparkSession.sparkContext.broadcast(file.read())

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words = words_of(source.value)
        for piece in slices(batch, 1):
            counts, ids, decoded = [], [], []
            for text in piece.column(1).to_pylist():
                packed = encode_text(words, text or "")
                plain = decode_ids(words.vocabulary, packed)
                counts.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest() if digests else packed)
                decoded.append(hashlib.sha256(plain.encode()).hexdigest() if digests else plain)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["id", "n_tokens", "ids", "decoded"]
            kinds = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, kinds), pa.array(decoded, pa.string())], names
            )

    schema = (
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        if digests
        else "id long, n_tokens long, ids binary, decoded string"
    )
    return map_rows(df, [id_column, text_column], encode, schema)
