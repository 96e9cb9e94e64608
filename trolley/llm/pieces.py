"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is cut into marked words (their leading spaces, then the rest). The distinct words of a batch are
sorted, which lays them out as a trie in depth-first order: going from one word to the next, the forward
entries of their common prefix are kept and only the new characters are scored.

Forward entry of a prefix: for a unigram model the best sum of piece scores and the last piece of that path.
A BPE model has no sums to maximise: its segmentation of every prefix is unique, a piece may end it exactly
if it is what BPE makes of its own characters and BPE leaves the pair (last piece before, piece) unmerged. So
the entry is that last piece, and reading back from the end gives the model's own segmentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from trolley.llm.words import groups_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXT_AT_ONCE = 1 << 22
#: Pairs of pieces whose verdict a worker remembers; a cache, not data.
MOST_PAIRS = 400_000


#: Numbers from here on stand for characters that are no piece.
UNKNOWN = 1 << 28


class Pieces:
    """A model's pieces: read once on the driver, sent to the tasks as plain lists (its size is the vocabulary's)."""

    def __init__(self, model_file: str = MODEL, kind: str = "bpe"):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.kind = kind
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        self.id_of: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain = piece.replace("▁", " ")
                self.id_of[plain], self.rank[plain] = i, model.get_score(i)
                self.bytes_of.append(plain.encode())
        self.longest = max(map(len, self.id_of), default=1)
        used = set("".join(self.id_of))
        cuts = "".join(c for c in "\n\t\r" if c not in used)  # in no piece, so a word may end there
        self.words = re.compile(f" *[^ {cuts}]+| +|[{cuts}]" if cuts else " *[^ ]+| +")
        self.unknown = min(self.rank.values(), default=0.0) - 10.0
        self._apart: dict[int, bool] = {}
        if kind == "bpe":  # a piece that BPE does not make of its own characters never occurs
            self.usable = {p: (p, i, (i,)) for p, i in self.id_of.items() if self.merged(p) == [p]}
        else:
            self.usable = {p: (p, i, (i,)) for p, i in self.id_of.items()}
        self._ends: dict[str, set[int]] = {}
        for piece in self.usable:
            self._ends.setdefault(piece[-3:], set()).add(len(piece))
        self._sizes: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE from single characters: the best-scored pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (at < 0 or r > best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _meets(self, pair: int, before: str, piece: str) -> bool:
        """Whether BPE leaves these two pieces side by side; remembered under a number for the pair."""
        if len(self._apart) >= MOST_PAIRS:
            self._apart.clear()
        known = self._apart[pair] = self.merged(before + piece) == [before, piece]
        return known

    def _sizes_at(self, tail: str) -> list[int]:
        """Lengths of the pieces that may end in these last (up to three) characters, longest first; 1 is always one."""
        tails = (tail, tail[-2:], tail[-1:])
        sizes = self._sizes[tail] = sorted({1}.union(*[self._ends.get(t, ()) for t in tails]), reverse=True)
        return sizes

    def _spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_id[b] for b in char.encode())

    def _strange(self, char: str) -> tuple[str, int, tuple[int, ...]]:
        """The entry of a character that is no piece: it is spelled in bytes."""
        return char, UNKNOWN + ord(char), self._spelled(char)

    def encoded(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct word, in one walk over the sorted words.

        A prefix keeps only its last piece, an entry shared by all prefixes that end in it, so memory is linear in
        the longest word; ids are read backwards from a word's end.
        """
        return self._bpe(sorted(words)) if self.kind == "bpe" else self._unigram(sorted(words))

    def _bpe(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        before, last = "", [("", 0, ())]  # per prefix: its last piece, a number for it, and its ids
        sizes_of, entry_of, apart = self._sizes, self.usable, self._apart
        for word in words:
            shared = _shared(before, word)
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                tail = word[end - 3 : end] if end > 2 else word[:end]
                for size in sizes_of.get(tail) or self._sizes_at(tail):
                    start = end - size
                    if start < 0:
                        continue
                    piece = word[start:end]
                    entry = entry_of.get(piece)
                    if entry is None:
                        if size > 1:
                            continue
                        entry = self._strange(piece)
                    if start:
                        left = last[start]
                        pair = left[1] << 32 | entry[1]
                        fits = apart.get(pair)
                        if not (self._meets(pair, left[0], piece) if fits is None else fits):
                            continue
                    last.append(entry)
                    break
            out[word] = _read_back(last)
            before = word
        return out

    def _unigram(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        before, sums, last = "", [0.0], [("", 0, ())]  # per prefix: the best sum and the last piece of its path
        for word in words:
            shared = _shared(before, word)
            del sums[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, chosen = -np.inf, None
                for start in range(max(0, end - self.longest), end):
                    piece = word[start:end]
                    entry = self.usable.get(piece)
                    if entry is None and end - start > 1:
                        continue
                    total = sums[start] + (self.unknown if entry is None else self.rank[piece])
                    if total > best:
                        best, chosen = total, entry or self._strange(piece)
                sums.append(best)
                last.append(chosen)
            out[word] = _read_back(last)
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        cut = [self.words.findall(" " + t) if t else [] for t in texts]
        ids = self.encoded(set(chain.from_iterable(cut)))
        return [np.fromiter(chain.from_iterable(map(ids.__getitem__, c)), np.int32) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids; the space put before the first word is taken off again."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _read_back(last: list[tuple[str, int, tuple[int, ...]]]) -> tuple[int, ...]:
    """The ids of a whole word from the last pieces of its prefixes."""
    end, path = len(last) - 1, []
    while end:
        path.append(last[end][2])
        end -= len(last[end][0])
    return tuple(chain.from_iterable(reversed(path)))


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            return n
        n += 1
    return n


def encode(docs: DataFrame, pieces: Pieces | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text, with `decoded` also the text its ids give back.

    Ids equal those of the SentencePiece library, but for texts that hold U+2581 itself: that character is
    spelled in bytes here, so that it is not decoded to a space. Null and empty texts get an empty list;
    repeated rows each give a row; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces or Pieces())  # the vocabulary: bounded by the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Pieces = shared.value
        for batch in groups_of(batches, "text", TEXT_AT_ONCE):
            ids = model.encode([t.decode() for t in batch.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns = [batch.column("doc_id"), column]
            if decoded:
                columns.append(pa.array([model.decode(i.tolist()) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", text string" * decoded
    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, ids, text) for rows of (doc_id, ids); a null list is an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(pieces or Pieces())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Pieces = shared.value
        for batch in batches:
            texts = []
            for row in batch.column("ids"):
                ids = row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []
                texts.append(model.decode(ids))
            columns = [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
