"""Encoding of whole texts with a public tokenizer file, by distinct words.

The tokenizer of word_bpe_49k.json never joins across white space: white space is dropped, and
no merge, normalisation or special token spans it. A text's ids are therefore those of its
white-space separated pieces in order, and each distinct piece needs encoding once. Pieces are
cut at ASCII white space, which any such tokenizer treats as white space.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import zlib
from itertools import chain, islice
from unicodedata import is_normalized, normalize

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

WORD_BPE = "word_bpe_49k.json"
#: Distinct pieces that a worker keeps before it starts anew, and text bytes it takes at once.
KEEP, TAKE = 700_000, 4 << 20
#: Pieces that are encoded in one string.
GROUP = 200
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def default_path() -> str:
    return public_tokenizers.path(WORD_BPE)


def _letters(word: str) -> bool:
    """Whether a piece is letters only, and stays so when it is composed and lower-cased."""
    return word.isalpha() and (word.isascii() or is_normalized("NFC", word) and "\u0130" not in word)


def _pretokens(word: str) -> int:
    """How many units the tokenizer cuts a piece into, after its normalisation."""
    if _letters(word):
        return 1
    if word[-1] in ".," and _letters(word[:-1]):
        return 2
    return len(_PRETOKEN.findall(normalize("NFC", word).lower()))


def _folded(text: bytes) -> bytes:
    """A-Z in lower case, so that fewer pieces are distinct; not where that could change the ids:
    before combining marks, or where a special token's string could arise."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


class _Index(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


class WordEncoder:
    """Encodes batches of UTF-8 texts to one flat id array and the texts' lengths in ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if getattr(self.tokenizer.model, "end_of_word_suffix", None) != "</w>":
            raise ValueError(f"{path} doesn't mark the ends of words, so its ids can't be put together from pieces")
        unchanged, letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        unchanged.normalizer = letters.normalizer = None
        letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.variants = (letters, unchanged, self.tokenizer)
        for t in self.variants:
            if hasattr(t.model, "_resize_cache"):
                t.model._resize_cache(0)  # our own index takes its place
        size = self.tokenizer.get_vocab_size()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(size, 1 + max(vocabulary.values(), default=0)), bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.known = 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.uses = np.zeros(1 << 14, np.int64)
        self.starts, self.sizes = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    def _learn(self) -> None:
        """Encodes the pieces that the index has new, in groups whose boundaries are checked.

        Pieces that normalisation leaves alone go to copies of the tokenizer without it, and of these
        the ones of letters alone, which are one unit each, to a copy that only splits at spaces.
        """
        words = [w.decode("utf-8", "replace") for w in islice(self.index, self.known, None)]
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        for k, w in enumerate(words):
            own = w == w.lower() and "<" not in w and (w.isascii() or is_normalized("NFC", w))
            kinds[2 if not own else 0 if w.isalpha() else 1].append(k)
        flat, size, start = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = self.used
        for tokenizer, order in zip(self.variants, kinds, strict=True):
            ids, sizes = self._grouped(tokenizer, [words[k] for k in order], tokenizer is self.variants[0])
            flat.append(ids)
            size[order] = sizes
            start[order] = at + np.cumsum(sizes) - sizes
            at += len(ids)
        if at > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(at, 2 * self.used) - self.used, np.uint32)))
        if len(self.index) > len(self.sizes):
            grow = np.empty(2 * len(self.index), np.int32)
            self.sizes, self.starts = (np.concatenate((x[: self.known], grow[self.known :])) for x in (self.sizes, self.starts))
        self.flat[self.used : at] = np.concatenate(flat)
        self.sizes[self.known : len(self.index)] = size
        self.starts[self.known : len(self.index)] = start
        self.used, self.known = at, len(self.index)

    def _grouped(self, tokenizer, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, each one's number of ids); letters: the words are one unit each."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        groups = [words[k : k + GROUP] for k in range(0, len(words), GROUP)]
        flat, sizes = [], []
        for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            counts = np.ones(len(group), np.int64) if letters else np.fromiter(map(_pretokens, group), np.int64, len(group))
            if len(last) == counts.sum() and not any(s in w for s in self.special for w in group if "<" in w):
                sizes.append(np.diff(np.concatenate(([0], last))[np.concatenate(([0], np.cumsum(counts)))]))
            else:  # a special token, or units that were counted otherwise: word by word then
                each = self.tokenizer.encode_batch_fast(group, add_special_tokens=False)
                sizes.append(np.array([len(x.ids) for x in each], np.int64))
                ids = np.array([i for x in each for i in x.ids], np.uint32)
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(sizes)

    def _trim(self) -> None:
        """Starts anew with the pieces that occurred again, the most frequent half at most."""
        uses = self.uses[: self.known]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > KEEP // 2:
            keep = np.sort(keep[np.argpartition(-uses[keep], KEEP // 2)[: KEEP // 2]])
        words = list(self.index)
        size, start = self.sizes[keep], self.starts[keep]
        end = np.cumsum(size, dtype=np.int64)
        total = int(end[-1]) if len(end) else 0
        flat = self.flat[np.repeat(start - (end - size), size) + np.arange(total)]
        self._clear()
        self.index.update(zip((words[k] for k in keep.tolist()), range(len(keep))))
        self.flat, self.used, self.known = np.concatenate((flat, self.flat)), total, len(keep)
        self.sizes = np.concatenate((size, self.sizes)).astype(np.int32)
        self.starts = np.concatenate((end - size, self.starts)).astype(np.int32)
        self.uses = np.concatenate((np.zeros(len(keep), np.int64), self.uses))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """texts: at most a few MB together, but for single long ones."""
        if len(self.index) > KEEP:
            self._trim()
        pieces = [_folded(t).split() for t in texts]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        get = self.index.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(pieces)), np.int32, int(n.sum()))
        if len(self.index) > self.known:
            self._learn()
        if self.known > len(self.uses):
            self.uses = np.concatenate((self.uses, np.zeros(2 * self.known - len(self.uses), np.int64)))
        self.uses[: self.known] += np.bincount(codes, minlength=self.known)
        size = self.sizes[codes]
        total = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        if total[-1] < 1 << 31:  # 32-bit positions, which halves what is moved
            at = np.repeat(self.starts[codes] - total[:-1].astype(np.int32), size)
            at += np.arange(len(at), dtype=np.int32)
        else:
            at = np.repeat(self.starts[codes] - total[:-1], size) + np.arange(total[-1])
        return self.flat[at], np.diff(total[np.concatenate(([0], np.cumsum(n)))])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Gives an encoder's memory back, in a worker that goes on to other stages."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def encoded(column: pa.Array, path: str):
    """(first row, ids, lengths) of bounded runs of a string column; null is an empty text."""
    texts, first, held = [], 0, 0
    data = column.cast(pa.large_binary())
    for k in range(len(data)):
        text = data[k].as_py() or b""
        texts.append(text)
        held += len(text)
        if held >= TAKE or k == len(data) - 1:
            yield first, *encoder(path).encode(texts)
            texts, first, held = [], k + 1, 0


def crc32(ids: np.ndarray) -> int:
    """Unsigned, of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
