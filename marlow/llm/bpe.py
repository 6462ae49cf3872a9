"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marlow.llm.common import slices

# Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

CACHE_PIECES = 120_000  # of each of two generations, which a worker keeps from task to task


def byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in the vocabulary file: printable Latin-1 characters
    stand for themselves, the other bytes follow from code point 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_id = [vocab[c] for _, c in sorted(byte_letters().items())]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = _Pieces(self)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Merge by lowest rank, leftmost first. Queue entries whose pair has changed are stale and skipped."""
        n = len(piece)
        sym = [self.byte_id[b] for b in piece]
        if n == 1:
            return (sym[0],)
        merges, shift = self.merges, n.bit_length()
        mask = (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get(sym[i] << 32 | sym[i + 1])
            if m:
                queue.append(m[0] << shift | i)
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & mask
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            m = merges.get(sym[i] << 32 | sym[j])
            if not m or m[0] != top >> shift:
                continue
            sym[i], sym[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if x := merges.get(m[1] << 32 | sym[k]):
                    heapq.heappush(queue, x[0] << shift | i)
            h = before[i]
            if h >= 0 and (x := merges.get(sym[h] << 32 | m[1])):
                heapq.heappush(queue, x[0] << shift | h)
        return tuple(s for s in sym if s >= 0)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text. Strings of special tokens in the text are those tokens."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.grow_old()
        if self.at_special and any(t in text for t in self.special):
            out: list[int] = []
            for part in self.at_special.split(text):
                out += [self.special[part]] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.split.findall(text))))

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings concatenated; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class _Pieces(dict):
    """piece -> ids, in two generations: when the new one is full, the old one goes and it takes its place. A piece
    that is met again moves to the new one, so common pieces stay."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self[piece] = self.old.pop(piece, None) or self.bpe.encode_piece(piece.encode("utf-8", "replace"))
        return ids

    def grow_old(self) -> None:
        self.old = dict(self)
        self.clear()


_LOADED: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One vocabulary for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


def bpe_map(docs: DataFrame, tokenizer: str, derive: Callable[[ByteBPE, list[list[int]]], list], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and what ``derive(bpe, ids of each text)`` returns, a list of columns as ``schema`` names them.

    Texts are encoded whole; a null text counts as empty and has no tokens. Row for row, no shuffle:
    repeated rows and null ids stay as they are, further columns are not read, an empty table gives none.
    ``tokenizer`` is a path that every worker can open.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in slices(batches, 500):
            ids = [bpe.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *derive(bpe, ids)], [id_col, *(x.split()[0] for x in schema.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, {schema}")


def encode_documents(docs: DataFrame, tokenizer: str, **cols) -> DataFrame:
    """Token ids of every text: ``doc_id, token_ids``."""
    return bpe_map(docs, tokenizer, lambda bpe, ids: [pa.array(ids, pa.list_(pa.int32()))], "token_ids array<int>", **cols)


def decode_documents(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The text of every list of ids: ``doc_id, text``; a null list gives the empty text."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def digests(bpe: ByteBPE, ids: list[list[int]]) -> list[pa.Array]:
    """n_tokens, sha256 of the comma-joined ids, sha256 of the decoded text."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    digits = bpe.digits.__getitem__
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha(",".join(map(digits, x)).encode()) for x in ids], pa.string()),
        pa.array([sha(bpe.decode(x).encode()) for x in ids], pa.string()),
    ]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
