"""Ids of a public tokenizer with a bounded memory of pieces that were encoded before.

A text is cut only where the tokenizer would cut anyhow, so ids equal those of the whole text: for the byte-level
vocabulary before a space that a visible ASCII character or letter follows, for the word vocabulary at spaces and line feeds.
Within a piece, a run of letters and the ASCII punctuation after it are apart for either, and each is remembered by itself.
Pieces are parted, and their ids put together, by Arrow and NumPy. New letter runs go to the tokenizer's model together, as it
would get them; the ids of each are found again by the marks that its vocabulary gives to word limits. When the memory is
full, the half that was met in most calls stays.
"""

from __future__ import annotations

import ctypes
import gc
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import one_thread

_CUT = re.compile(r" (?=[\w!-~])")
_TAIL = string.punctuation.replace("'", "").replace("_", "")
#: Runs of letters up to U+024F: the libraries agree on these, and composing leaves them as they are. U+0130 is two code points in lower case.
_RUN = "[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]+"
_IS_RUN = re.compile(_RUN).fullmatch
#: Letter runs that go to the tokenizer at a time.
_RUNS = 20_000
#: Byte-level vocabularies write each byte as a character: visible ones of Latin-1 as they are, the others from U+0100 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)}.difference(_SEEN)))}


def trim() -> None:
    """Gives back what a reused worker's earlier tasks left unused: in Arrow's pool, and in the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def _gather(store: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of store that begin at starts and have n values, one after another, and where each begins and ends there."""
    ends = np.concatenate([[0], np.cumsum(n)])
    return store[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])], ends


class Encoder:
    def __init__(self, path: str, spaced: bool, most: int = 300_000):
        """spaced: a piece keeps the space before it (byte-level BPE); otherwise white space is dropped, and case. most: letter runs and other pieces remembered."""
        one_thread()
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        #: The same model, for letter runs that are written in its alphabet already.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.spaced, self.most = spaced, most
        self.alphabet = _BYTES | {32: " " + _BYTES[32] if spaced else " "}
        vocab = self.tokenizer.get_vocab()
        self.limit = np.zeros(max(vocab.values()) + 1, bool)  # of ids: starts a spaced word, or ends a word
        for token, i in vocab.items():
            self.limit[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")
        #: Of each known letter run or other piece, and of punctuation (after a space here), the slot, in ascending order; of slots,
        #: ids, where they start, how many they are (-1: here the text can't be cut), and the calls that met them, halved as others went.
        self.known, self.store = {}, np.empty(0, "<u4")
        self.starts, self.lengths, self.met = (np.empty(0, np.int64) for _ in range(3))

    def _raw(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of letter runs, and how many each has."""
        text = " " + " ".join(runs) if self.spaced else " ".join(runs).lower()
        ids = np.array(self.bare.encode_batch_fast([text.encode().decode("latin-1").translate(self.alphabet)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.limit[ids])
        if len(at) == len(runs):
            return ids, np.diff(at, append=len(ids)) if self.spaced else np.diff(at, prepend=-1)
        each = [self._raw(" " * self.spaced + r) for r in runs]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _learn(self, new: list[str]) -> None:
        runs = [x for x in new if _IS_RUN(x)]
        rest = [x for x in new if not _IS_RUN(x)] if len(runs) < len(new) else []
        ids, lengths = [self.store], []
        for i in range(0, len(runs), _RUNS):
            some, n = self._runs(runs[i : i + _RUNS])
            ids.append(some)
            lengths.append(n)
        for x in rest:
            if x[:1] == " ":
                ids.append(self._raw(x[1:]))
            elif self.spaced and not _CUT.match(" " + x):
                lengths.append([-1])
                continue
            else:
                ids.append(self._raw(" " * self.spaced + x))
            lengths.append([len(ids[-1])])
        more, at = np.concatenate(lengths).astype(np.int64), len(self.store)
        n = np.maximum(more, 0)
        self.known.update(zip([*runs, *rest], range(len(self.starts), len(self.starts) + len(more)), strict=True))
        self.starts = np.concatenate([self.starts, at + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, more])
        self.met = np.concatenate([self.met, np.zeros(len(more), np.int64)])
        self.store = np.concatenate(ids)

    def _forget(self) -> None:
        """Keeps the half that was met in most calls."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: self.most // 2])
        names = list(self.known)
        self.known = {names[i]: slot for slot, i in enumerate(keep.tolist())}
        self.lengths, self.met = self.lengths[keep], self.met[keep] >> 1
        self.store, ends = _gather(self.store, self.starts[keep], np.maximum(self.lengths, 0))
        self.starts = ends[:-1]

    def _slots(self, names: list[str]) -> np.ndarray:
        """The slots of distinct names."""
        if new := [x for x in names if x not in self.known]:
            self._learn(new)
        out = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.met[out] += 1
        return out

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after another; where each piece begins and ends there; whether the text can't be cut at it."""
        if len(self.known) > self.most:
            self._forget()
        runs = pc.utf8_rtrim(pieces, _TAIL)
        plain = pc.match_substring_regex(runs, f"^{_RUN}$")
        tailed = np.flatnonzero(pc.and_(plain, pc.not_equal(pc.binary_length(runs), pc.binary_length(pieces))).to_numpy(zero_copy_only=False))
        sizes = pc.utf8_length(runs.take(pa.array(tailed))).to_pylist()
        tails = pa.array([" " + p[n:] for p, n in zip(_strings(pieces.take(pa.array(tailed))), sizes, strict=True)], pa.large_string()).dictionary_encode()
        heads = pc.if_else(plain, runs if self.spaced else pc.ascii_lower(runs), pieces).dictionary_encode()
        slots = self._slots(_strings(heads.dictionary) + _strings(tails.dictionary))
        n = len(heads.dictionary)
        head, tail = slots[:n][heads.indices.to_numpy()], slots[n:][tails.indices.to_numpy()]
        # two runs of ids a piece, of which the second is empty where there is no punctuation
        starts, lengths = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        starts[:, 0], lengths[:, 0] = self.starts[head], np.maximum(self.lengths[head], 0)
        starts[tailed, 1], lengths[tailed, 1] = self.starts[tail], self.lengths[tail]
        ids, ends = _gather(self.store, starts.ravel(), lengths.ravel())
        return ids, ends[::2], self.lengths[head] < 0

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's start and end: one more than there are texts. Null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts if self.spaced else pc.replace_substring(texts, "\n", " "), " ")
        offsets = cut.offsets.to_numpy()
        words = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        store, limits, uncut = self._pieces(words.dictionary)
        slots = words.indices.to_numpy()
        n, starts, own = np.diff(limits)[slots], limits[slots], {}
        if self.spaced:
            heads = offsets[:-1][offsets[1:] > offsets[:-1]]
            stuck = uncut[slots]
            stuck[heads] = False
            n[heads] = 0
            slow = set((np.searchsorted(offsets, np.flatnonzero(stuck), "right") - 1).tolist())
            for i, text in enumerate(texts.to_pylist() if slow else [None] * len(texts)):
                if i in slow:
                    own[i] = self._raw(text)
                    n[offsets[i] : offsets[i + 1]] = 0
                else:
                    own[i] = self._raw(words[int(offsets[i])].as_py()) if offsets[i + 1] > offsets[i] else np.empty(0, "<u4")
        ids, ends = _gather(store, starts, n)
        at = ends[offsets]
        if not own:
            return ids, at
        pieces = [x for i in range(len(texts)) for x in (own[i], ids[at[i] : at[i + 1]])]
        return np.concatenate(pieces), at + np.concatenate([[0], np.cumsum([len(own[i]) for i in range(len(texts))])])

    def encode(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about that many bytes of the column; a longer row is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += size
    if len(sizes) > a:
        yield batch.slice(a)
