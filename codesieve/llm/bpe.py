"""BPE encoding and decoding of whole texts by forced-boundary splitting.

White space lies inside no token of the vocabulary, and pairs of bytes that stand side by side in no token can't be
joined by any merge. Both mark cuts that hold for certain: what lies between cuts is encoded on its own and the ids
are concatenated. The same words and fragments come again and again, so each Python worker keeps those it has seen, up
to a bound. The merges themselves are the tokenizers library's. Ids are decoded from the vocabulary, a word's at once: a file
that names no decoder joins tokens by blanks, so what words decode to is joined in the same way.

Defined cases: a null text is empty and has no ids; strings of special tokens inside a text get their special id, as
the library does; documents are encoded as they come, so ties and repeated rows don't matter; a null doc_id is passed
on; other columns are ignored; a tokenizer file that names a decoder is refused. A file with another normaliser or
pre-tokenizer than the one that plain words are read for has every word read by the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches

#: Words and fragments a worker remembers before it starts anew, and characters of all that it remembers.
REMEMBERED, REMEMBERED_CHARS = 120_000, 8_000_000
#: Words that normalise to their plain lower case and split into letters and marks: most words, read without the library.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?*#%&$|()-]*)")
#: The usual byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: chr(b) for b in SEEN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in SEEN)}


class ForcedBoundaryEncoder:
    """Encodes words (texts without plain white space) for a BPE tokenizer file with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder"):
            raise ValueError(f"{path} names a decoder; only files without one can be encoded here")
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=model.get("end_of_word_suffix"))
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        joined: set[str] = set()
        for token in model["vocab"]:
            plain = token.removesuffix(self.end) if self.end else token
            joined.update(plain[i : i + 2] for i in range(len(plain) - 1))
        self.joined = joined
        self.token = {i: t for t, i in self.library.get_vocab().items()}
        self.decimal = {i: str(i) for i in self.token}
        self.plain = PLAIN if self.reads_plain() else None
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.in_fragments = self.in_words = 0

    def cuts(self, piece: str) -> list[str]:
        """Fragments of a pre-token between byte pairs that no token holds."""
        joined, out, start = self.joined, [], 0
        if joined.issuperset(map(add, piece, piece[1:])):
            return [piece]
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in joined:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def reads_plain(self) -> bool:
        """Whether the library reads words as `pieces` does plain ones: a sample of every letter and mark, alone and
        between others."""
        letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
        marks = ".,;:!?*#%&$|()-"
        samples = [*letters, *marks, *(f"a{x}B{x}" for x in letters), *(f"aB{x}{y}" for x in marks for y in marks), "".join(letters) + marks]
        return all(self.read(w) == self.split_plain(m) for w in samples if (m := PLAIN.fullmatch(w)))

    def split_plain(self, plain: re.Match) -> list[str]:
        return [p.lower() if p.isascii() else p.lower().encode().decode("latin-1").translate(ALPHABET) for p in plain.groups() if p]

    def read(self, word: str) -> list[str]:
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word) if self.library.normalizer else word)]

    def pieces(self, word: str) -> list[str]:
        """Pre-tokens of a word in the byte-level alphabet."""
        if self.plain and word.isascii() and word.isalpha():
            return [word.lower()]
        plain = self.plain and self.plain.fullmatch(word)
        return self.split_plain(plain) if plain else self.read(word)

    def fragment(self, text: str, last: bool) -> list[int]:
        got = self.fragments.get((text, last))
        if got is None:
            if len(self.fragments) >= REMEMBERED // 3 or self.in_fragments >= REMEMBERED_CHARS // 3:
                self.fragments.clear()
                self.in_fragments = 0
            got = self.fragments[text, last] = [t.id for t in (self.last if last else self.inner).tokenize(text)]
            self.in_fragments += len(text) + 8 * len(got)
        return got

    def ids(self, word: str) -> list[int]:
        if "<|" in word and any(s in word for s in self.special):
            return self.library.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for piece in self.pieces(word):
            *inner, last = self.cuts(piece)
            for part in inner:
                out += self.fragment(part, False)
            out += self.fragment(last, True)
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library does: ids without a token are passed over."""
        return " ".join([t for i in ids if (t := self.token.get(i)) is not None])

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids in decimal joined by spaces, what they decode to)."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= REMEMBERED or self.in_words >= REMEMBERED_CHARS:
                self.older, self.words, self.in_words = self.words, {}, 0
            got = self.older.get(word)
            if got is None:
                ids, decimal = self.ids(word), self.decimal
                got = (len(ids), " ".join([decimal[i] for i in ids]), self.decode(ids))
            self.words[word] = got
            self.in_words += len(word) + len(got[1]) + len(got[2])
        return got

    def text(self, text: str) -> tuple[int, str, str]:
        """As word(), of a whole text."""
        known = self.words.get
        parts = [known(w) or self.word(w) for w in text.replace("\n", " ").split(" ") if w]
        ids = [p[1] for p in parts]
        if "" in ids:  # of words without ids nothing is joined
            parts = [p for p in parts if p[0]]
            ids = [p[1] for p in parts]
        joined = " ".join(ids)
        return joined.count(" ") + 1 if ids else 0, joined, " ".join([p[2] for p in parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryEncoder:
    return ForcedBoundaryEncoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            rows = []
            for text in b.column("text"):
                n, ids, decoded = e.text(text.as_py() or "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, ids, dec = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(dec, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its ids array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = [[int(i) for i in e.text(t.as_py() or "")[1].split()] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the library's decode gives for ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for b in batches:
            texts = library.decode_batch([i or [] for i in b.column("ids").to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
