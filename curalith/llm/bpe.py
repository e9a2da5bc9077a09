"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last bytes hits a pattern, so that
documents with common passages get common chunks.  A worker encodes a chunk
once and remembers it, within a bound of bytes and beyond the task.  A cut may fall inside a word, so the word that spans a join is
left out of both chunks' results and encoded again from both sides; the window
of that repair grows until white space bounds it on either side, which is
where the encodings agree for certain: the tokenizer's normaliser (NFC, white
space to a space, lower case by character) and its pre-tokenizer never look
across ASCII white space, and its special tokens hold none.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curalith.llm.text import sha256_hex, slices, texts
from curalith.llm.workers import remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of words, pieces and their results that a worker remembers at most before it forgets them all.
MEMO_WORD_BYTES = 96 << 20
#: What an entry weighs beside its key and values: objects, and a place in the table.
ENTRY_BYTES = 280
#: Bytes of chunks and of their results that a worker remembers at most.
MEMO_CHUNK_BYTES = 48 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """key -> (ids as little-endian uint32 bytes, decoded bytes) with a function for what is missing."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.held = 0

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        self.held += ENTRY_BYTES + len(key) + len(value[0]) + len(value[1])
        return value

    def clear(self):
        super().clear()
        self.held = 0


class Encoder:
    """Word-wise exact encoder of one tokenizer file whose pre-tokenizer never crosses ASCII white space.

    Words of printable Latin characters are split by the file's own pattern and
    each piece goes to the BPE model alone; other words go through the whole
    tokenizer, so NFC and every rare script are the library's own work.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if spec["decoder"] is not None or spec["post_processor"] is not None or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError(f"{path} isn't a tokenizer of the kind that this encoder knows")
        self.pieces_of = regex.compile(split["pattern"]["Regex"]).findall
        #: Below U+0250 nothing composes and lower case goes by character in any Unicode version.
        self.plain = regex.compile("[!-~¡-ɏ]+").fullmatch
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda text: None
        self.names = {i: t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = {i: i.to_bytes(4, "little") for i in self.names}
        # the public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: b for b in shown} | {b: 0x100 + k for k, b in enumerate(rest)}
        self.words = _Memo(self._word)
        self.pieces = _Memo(self._piece)

    def _pack(self, ids: list[int]) -> tuple[bytes, bytes]:
        if len(ids) == 1:
            return self.bytes_of[ids[0]], self.names[ids[0]]
        return b"".join([self.bytes_of[i] for i in ids]), b" ".join([self.names[i] for i in ids])

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _word(self, word: bytes) -> tuple[bytes, bytes]:
        text = word.decode()
        if self.plain(text) and not self.special(text):
            found = self.pieces_of(text.lower())
            if len(found) == 1:
                return self.pieces[found[0]]
            parts = [self.pieces[p] for p in found]
            return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[1]])
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        """Called between batches: bounds what the worker holds."""
        if self.words.held + self.pieces.held > MEMO_WORD_BYTES:
            self.words.clear()
            self.pieces.clear()

    def run(self, words: list[bytes]) -> tuple[bytes, bytes]:
        got = [self.words[w] for w in words]
        return b"".join([g[0] for g in got]), b" ".join([g[1] for g in got if g[1]])

    def ids(self, text: bytes) -> bytes:
        """The ids of a whole text as little-endian uint32 bytes."""
        memo = self.words
        return b"".join([memo[w][0] for w in text.split()])


def encoder(path: str) -> Encoder:
    return remembered(("words", path), lambda: Encoder(path))


WINDOW = 16  # bytes that the rolling hash sees


def cuts(data: np.ndarray, bits: int) -> np.ndarray:
    """Ends of content-defined chunks: positions after which the hash of the last WINDOW bytes has ``bits`` zero bits."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64)
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    width, factor = 1, 0x100000001B3
    while width < WINDOW:  # h[i] becomes the hash of data[i : i + 2 * width]
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return np.flatnonzero((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) == 0) + WINDOW


class ChunkEncoder:
    """Encodes texts through remembered chunks; see the module's docstring."""

    def __init__(self, words: Encoder, bits: int):
        self.words, self.bits = words, bits
        self.memo: dict[bytes, tuple[bytes, tuple[bytes, bytes], bytes] | None] = {}
        self.held = 0

    def chunk(self, data: bytes):
        """(bytes before the first white space, result of what lies between, bytes after the last); None without white space."""
        try:
            return self.memo[data]
        except KeyError:
            pass
        parts = data.split()
        if not parts or len(parts) == 1 and len(parts[0]) == len(data):
            entry = None if parts else (b"", (b"", b""), b"")
        else:
            head = b"" if data[:1].isspace() else parts.pop(0)
            tail = b"" if data[-1:].isspace() or not parts else parts.pop()
            entry = (head, self.words.run(parts), tail)
        self.held += len(data) + 200 + (sum(map(len, entry[1])) if entry else 0)
        if self.held > MEMO_CHUNK_BYTES:
            self.memo.clear()
            self.held = 0
        self.memo[data] = entry
        return entry

    def encode(self, text: bytes, at: np.ndarray) -> tuple[bytes, bytes]:
        """ids and decoded bytes of a text that is cut at the given offsets."""
        ids: list[bytes] = []
        decoded: list[bytes] = []

        def add(result: tuple[bytes, bytes]) -> None:
            ids.append(result[0])
            if result[1]:
                decoded.append(result[1])

        open_join, start = b"", 0
        for end in [*at.tolist(), len(text)]:
            if end <= start:
                continue
            data = text[start:end]
            start = end
            entry = self.chunk(data)
            if entry is None:  # the join's window grows over a chunk without white space
                open_join += data
                continue
            head, inner, tail = entry
            if repaired := open_join + head:
                add(self.words.words[repaired])
            add(inner)
            open_join = tail
        if open_join:
            add(self.words.words[open_join])
        return b"".join(ids), b" ".join(decoded)


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary: str, *, chunk_bits: int = 9, outputs: bool = False) -> DataFrame:
    """Encode and decode every whole text; one row per row of ``docs``.

    ``vocabulary`` is the path of a tokenizers file that every executor has,
    ``chunk_bits`` the logarithm of the mean chunk length in bytes.  With
    ``outputs`` the row also carries the ids (``array<int>``) and the decoded
    text.  A null or empty text, or one of white space only, has no token.
    Map-only: memory is bounded by a slice of texts, one long text at most, and
    the worker's memos; a lost executor's tasks simply run again.
    """
    schema = SCHEMA + (", ids array<int>, decoded string" if outputs else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = remembered(("chunks", vocabulary, chunk_bits), lambda: ChunkEncoder(Encoder(vocabulary), chunk_bits))
        for b in slices(batches):
            chunks.words.forget()
            rows: dict[str, list] = {"n": [], "i": [], "d": [], "ids": [], "decoded": []}
            for text in texts(b.column(1)):
                ids, decoded = chunks.encode(text, cuts(np.frombuffer(text, np.uint8), chunk_bits))
                rows["n"].append(len(ids) // 4)
                rows["i"].append(sha256_hex(ids))
                rows["d"].append(sha256_hex(decoded))
                if outputs:
                    rows["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    rows["decoded"].append(decoded.decode())
            out = [b.column(0), pa.array(rows["n"], pa.int64()), pa.array(rows["i"], pa.string()), pa.array(rows["d"], pa.string())]
            if outputs:
                out += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, schema)
