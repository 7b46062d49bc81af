"""BPE encoding and decoding: batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs at once, by
binary search in the sorted keys of the merge rules, takes the lowest rank in each word and merges its
occurrences from left to right. A merge only makes symbols whose own rules rank later, so merging all
occurrences of the lowest pair in one round gives what one merge at a time gives.

Edge cases: a null or empty text has no tokens and decodes to the empty text; the special token's string
in a text is that one token; an unpaired byte sequence cannot occur, as texts are UTF-8.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kit

_BITS = np.int64(17)
_NEVER = np.int64(1 << 40)
#: How byte-level tokenizers cut a text into words; a fixed value of the file's format. White space is
#: the Unicode property, as in the library that defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """A byte-level BPE tokenizer read from a file of the tokenizers library.

    known: about how many bytes a worker spends at most on words that it remembers; all are forgotten beyond that.
    block: how many words are taken at a time, so that a very long text is not held as words.
    """

    def __init__(self, path: str, known: int = 24 << 20, block: int = 1 << 16):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        text = [b""] * size
        for token, i in vocab.items():
            text[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            text[i] = token.encode()
        self.text, self.digits = _Strings(text), _Strings([b"%d," % i for i in range(size)])
        self.from_byte = np.array([vocab[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 17) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.cut = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.most, self.block = known, block
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.ids, self.at, self.len = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        for token, i in self.special.items():  # under a key that no word can have
            self._add([("\0special", token)], np.array([i]), np.array([1]))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has. Words are not empty."""
        size = np.array([len(w) for w in words], np.int64)
        ids = self.from_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            key = (ids[:-1] << _BITS) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], _NEVER)
            rank = np.append(rank, _NEVER)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            low_of = np.repeat(low, np.diff(np.append(first, len(ids))))
            hit = np.flatnonzero((rank == low_of) & (rank < _NEVER))
            run = np.append(True, np.diff(hit) != 1)[: len(hit)]
            begun = hit[run][np.cumsum(run) - 1]
            hit = hit[(hit - begun) % 2 == 0]
            ids[hit] = self.merged[at[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            over = low_of >= _NEVER
            if over.any():
                done.append((word[over], ids[over]))
                stay &= ~over
            ids, word = ids[stay], word[stay]
        words_of = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([i for _, i in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(words_of, kind="stable")
        return flat[order], np.bincount(words_of, minlength=len(words))

    def _add(self, keys: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(keys, range(self.at.n, self.at.n + len(keys)), strict=True))
        self.at.add(self.ids.n + np.cumsum(counts) - counts)
        self.len.add(counts)
        self.ids.add(ids)
        # a word with its entry in the dictionary takes some 180 bytes beside its characters
        self.held += 180 * len(keys) + sum(map(len, keys)) + 4 * len(ids)

    def _words(self, text: str) -> Iterator[list]:
        """The words of a text, in lists of at most ``block``."""
        at = 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            yield from self._cut(text[at : m.start()])
            yield [("\0special", m.group())]
            at = m.end()
        yield from self._cut(text[at:] if at else text)

    def _cut(self, text: str) -> Iterator[list]:
        if len(text) <= self.block:
            yield self.cut.findall(text)
        else:
            found = self.cut.finditer(text)
            while part := [m.group() for m in itertools.islice(found, self.block)]:
                yield part

    def _blocks(self, texts: list[str]) -> Iterator[tuple[list, list[int], list[int]]]:
        """Words of several texts, or a part of one, and how many of them belong to which text."""
        words, of, sizes = [], [], []
        for i, text in enumerate(texts):
            for part in self._words(text):
                words += part
                of.append(i)
                sizes.append(len(part))
                if len(words) >= self.block:
                    yield words, of, sizes
                    words, of, sizes = [], [], []
        if words:
            yield words, of, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other; how many each text has."""
        out, total = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for words, of, sizes in self._blocks(texts):
            if self.held > self.most:
                self._forget()
            if new := list(set(words) - self.known.keys()):
                self._add(new, *self.merge([w.encode() for w in new]))
            index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            size = self.len.data[index].astype(np.int64)
            out.append(self.ids.data[_ranges(self.at.data[index].astype(np.int64), size)])
            total += np.bincount(np.repeat(of, sizes), size, len(texts)).astype(np.int64)
        return np.concatenate(out), total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ids; special tokens are not skipped."""
        return [x.decode("utf-8", "replace") for x in self.text.joined(ids, counts)]

    def written(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each row, joined by commas."""
        return [x[:-1] for x in self.digits.joined(ids, counts)]


class _Strings:
    """Byte strings one after the other, taken by number."""

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, numbers: np.ndarray, counts: np.ndarray, most: int = 1 << 18) -> Iterator[bytes]:
        """For each row of ``counts`` numbers its strings joined; ``most`` numbers at a time."""
        ends = np.cumsum(counts)
        for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            parts = [numbers[i : min(b, i + most)] for i in range(a, b, most)]
            yield b"".join(self.data[_ranges(self.at[p], self.size[p])].tobytes() for p in parts)


class _Grown:
    """An array that others are appended to."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            more = np.zeros(max(2 * len(self.data), self.n + len(x)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then those of the next entry, and so on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


_loaded: dict[str, ByteBPE] = {}


def _tokenizer(path: str) -> ByteBPE:
    """One for each worker process and file."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int; null where ``ids`` is false), n_tokens, ids_sha256, decoded_sha256 and same (decoding gave the text back).

    path: the vocabulary file, there on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(path)
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        for piece in kit.pieces(batches):
            texts = piece.texts.to_pylist()
            flat, counts = bpe.encode(texts)
            back = bpe.decode(flat, counts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)) if ids else pa.nulls(len(texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), rows, pa.array(counts), sha(bpe.written(flat, counts)), sha(x.encode() for x in back), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())],
                ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256", "same"],
            )

    return kit.map_texts(kit.base_columns(docs), run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
