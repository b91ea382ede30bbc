"""BPE encoding and decoding with a public vocabulary file.

Each pre-token is merged with a priority queue of merge ranks over a doubly linked list of
symbols; entries whose symbols have changed since they were queued are stale and skipped.
Blank-separated pieces of text encode independently of their neighbours, so each Python
worker remembers the ids of the pieces it met lately (two bounded generations) and a text
is the concatenation of its pieces' ids.  Decoding concatenates vocabulary strings.

The vocabulary path is a parameter; the file is read once per worker (it must exist on
every executor), never copied.  One pass over the documents, no shuffle.

Defined cases: a null text counts as empty and has no tokens; repeated rows are encoded
alike; further columns are carried by :func:`encode` and ignored by the query's digest.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tempora.llm import textops as T
from tempora.llm.shared import free_name

CACHE = 120_000  # pieces per generation and worker


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it prints, else the next code point from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file with word-end suffix ``</w>``."""

    _loaded: dict[str, Codec] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*self.vocab.values(), *special.values()]))
        for s, i in (self.vocab | special).items():
            self.strings[i] = s
        ids = self.vocab
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        symbols = _byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + suffix] for s in symbols]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pretokens = regex.compile(split).findall
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.begins = sorted({x[:2] for x in self.special})  # what special tokens begin with
        self.words, self.old_words = {}, {}
        self.pieces, self.old_pieces = {}, {}

    def forget(self) -> None:
        """Gives up what was remembered: the worker process outlives its task."""
        self.words, self.old_words, self.pieces, self.old_pieces = {}, {}, {}, {}

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers."""
        raw = word.encode()
        inner = self.inner
        sym = [inner[b] for b in raw]
        sym[-1] = self.final[raw[-1]]
        n = len(sym)
        if n > 1:
            ranks = self.merges.get
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            queue = [(*m, i, sym[i], sym[i + 1]) for i in range(n - 1) if (m := ranks((sym[i], sym[i + 1])))]
            heapify(queue)
            while queue:
                _, new, i, a, b = heappop(queue)
                if sym[i] != a:
                    continue  # stale: the left symbol was merged
                j = after[i]
                if j >= n or sym[j] != b:
                    continue  # stale: the right symbol was merged
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                h = before[i]
                if k < n:
                    before[k] = i
                    if m := ranks((new, sym[k])):
                        heappush(queue, (*m, i, new, sym[k]))
                if h >= 0 and (m := ranks((sym[h], new))):
                    heappush(queue, (*m, h, sym[h], new))
            sym = [s for s in sym if s >= 0]
        return np.array(sym, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece without blanks that is not in the young generation."""
        got = self.old_pieces.get(piece)
        if got is None:
            norm = piece if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            out = []
            for w in self.pretokens(norm.lower()):
                ids = self.words.get(w)
                if ids is None:
                    ids = self.old_words.get(w)
                    if ids is None:
                        ids = self.merge(w)
                    if len(w) < 64:
                        if len(self.words) >= CACHE:
                            self.old_words, self.words = self.words, {}
                        self.words[w] = ids
                out.append(ids)
            got = b"".join(out)
        if len(piece) < 64:
            if len(self.pieces) >= CACHE:
                self.old_pieces, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        pieces = _BLANKS.findall(text) if _ODD.search(text) else text.split()
        get, slow = self.pieces.get, self._piece
        return b"".join([get(p) or slow(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers; special tokens in it keep their ids."""
        if not any(x in text for x in self.begins):
            return self._plain(text)
        return b"".join(self.special.get(p) or self._plain(p) for p in self.marks.split(text))

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


_ODD = regex.compile("[\x1c-\x1f]")  # blanks to str.split, none to the tokenizer
_BLANKS = regex.compile(r"[^\p{White_Space}]+")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids``: the token ids as little-endian 32-bit integers.

    Where ``docs`` has a column of that name, that of the ids takes underscores before it.
    """
    path, columns, out = path or default_path(), docs.columns, free_name(docs, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for b in T.slices(batches, len(columns)):
            ids = pa.array([codec.encode(t) for t in T.as_strings(b.column(b.num_columns - 1)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*columns, out])
        codec.forget()

    return docs.select(*columns, F.col(text).alias(free_name(docs, "encoded"))).mapInArrow(run, StructType([*docs.schema.fields, StructField(out, BinaryType())]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Replaces ``ids`` by ``decoded``, the text of the vocabulary strings."""
    path = path or default_path()
    columns = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for b in T.slices(batches, len(columns)):
            out = pa.array([codec.decode(i or b"") for i in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*columns, "decoded"])

    return encoded.select(*columns, "ids").mapInArrow(run, encoded.select(*columns).schema.add("decoded", "string"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of a text's ids and of what they decode to."""
    path = path or default_path()
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for b in T.slices(batches, 1):
            n, one, two = [], [], []
            for text in T.as_strings(b["text"]).to_pylist():
                ids = codec.encode(text)
                n.append(len(ids) // 4)
                one.append(sha(ids))
                two.append(sha(codec.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
