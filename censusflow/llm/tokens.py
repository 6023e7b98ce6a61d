"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

The library splits a text at fixed places before it merges, so pieces cut at such places give the ids of the whole. For
texts of printable Latin characters, tabs and line breaks such places are known: before a single space between words and
around a line break (byte-level vocabulary) or at any white space (word vocabulary, which also lets texts be put in lower
case first), and between a word and the signs after it. All other texts, and texts that hold the string of a special token,
as they are or in lower case, go to the library whole. Arrow cuts a step's texts and numbers its distinct pieces; only those
are looked up, and new ones go to the library many at a time: those after a space (byte-level vocabulary) as one line, parted
again at ids that start with a space, others with a special token between them. The cache has two generations of about `limit`
pieces; when the younger is full, it becomes the older one. `forget` gives the worker's memory back to the system.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-įı-ɏ]*")
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Both vocabularies end a word before a sign that starts no contraction.
_SIGN = rf"([{_L}])([^{_L}0-9²³¹¼-¾'\s])"
_ASCII = re.compile(r"[\t\n\r\x20-\x7e]*")
LONGEST = 64  # characters of a piece that the cache keeps
_WIDE = re.compile(r"[\t\n\r ][\t\n\r ]")


class Encoder:
    """ids(texts): one uint32 array per text."""

    def __init__(self, path: str, limit: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would take its neighbours'
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.mark_id, self.mark = max((i, t.content) for i, t in added.items())
        self.keeps_spaces = len(self.library.encode("a  a", add_special_tokens=False).ids) > 2
        self.spaced = np.zeros(self.library.get_vocab_size() + 1, bool)  # ids that start with a space
        self.spaced[[i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]] = self.keeps_spaces
        self.limit, self.known, self.old = limit, {}, {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _ready(self, text: str) -> str | None:
        """The text with a space (or, for the word vocabulary, any white space) at each place where it is cut into pieces whose
        ids may be joined; a line break marks a piece without the space before it. None if no cut is known to be safe."""
        if not (_ASCII if text.isascii() else _PLAIN).fullmatch(text):
            return None
        low = text if self.keeps_spaces else text.lower()
        if any(s in text or s in low for s in self.special):
            return None
        if not self.keeps_spaces:
            return low
        if text[:1].isspace() or text[-1:].isspace() or _WIDE.search(text):
            return None
        return "\n" + text.replace("\n", " \n\n \n")

    def _joined(self, texts: list[str]) -> np.ndarray:
        """Ids of texts one after another."""
        return np.concatenate([np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def _learned(self, pieces: list[str], apart: bool) -> list[bytes]:
        """Ids of pieces as they stand in a text; unless they are kept apart by the special token, each starts with its only space."""
        out: list[bytes] = []
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            mark = self.mark if apart else ""
            ids = self._joined([mark.join(part[i : i + 64]) + mark for i in range(0, len(part), 64)])
            cut = np.flatnonzero(ids == self.mark_id if apart else self.spaced[ids])
            if len(cut) != len(part) or not apart and cut[0]:  # a piece reads as the special token: one by one then
                out += [x.tobytes() for x in self.whole(part)]
                continue
            ends = 4 * cut if apart else 4 * np.append(cut[1:], len(ids))
            starts = [0, *(ends[:-1] + 4 * apart).tolist()]
            out += map(ids.tobytes().__getitem__, map(slice, starts, ends.tolist()))
        return out

    def _encode(self, new: list[str]) -> list[bytes]:
        if not self.keeps_spaces:
            return self._learned(new, True)
        bare = [p[:1] == "\n" for p in new]
        after = iter(self._learned([" " + p for p, x in zip(new, bare, strict=True) if not x], False))
        alone = iter(self._learned([p[1:] for p, x in zip(new, bare, strict=True) if x], True))
        return [next(alone if x else after) for x in bare]

    def _lookup(self, wanted: list[str]) -> list[bytes]:
        """Ids of distinct pieces. Pieces of the older generation move to the younger one, new ones are learned."""
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        out = list(map(self.known.get, wanted))
        lack = [i for i, x in enumerate(out) if x is None]
        names = [wanted[i] for i in lack]
        found = list(map(self.old.get, names)) if self.old else [None] * len(names)
        new = iter(self._encode([p for p, x in zip(names, found, strict=True) if x is None]))
        found = [next(new) if x is None else x for x in found]
        for i, x in zip(lack, found, strict=True):
            out[i] = x
        self.known.update(zip(names, found, strict=True))
        for p in names:
            if len(p) > LONGEST:
                del self.known[p]
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        ready = [self._ready(t) for t in texts]
        odd = iter(self.whole([t for t, r in zip(texts, ready, strict=True) if r is None]))
        whole = pa.array([r for r in ready if r is not None], pa.large_string())
        whole = pc.replace_substring_regex(whole, _SIGN, r"\1 %s\2" % ("\n" if self.keeps_spaces else ""))
        cut = pc.split_pattern(whole, " ") if self.keeps_spaces else pc.ascii_split_whitespace(whole)
        pieces = cut.flatten().dictionary_encode()
        blobs = self._lookup(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(blobs), "<u4")
        which, size = pieces.indices.to_numpy(), np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
        del blobs, pieces
        at = np.cumsum(size) - size
        size = size[which]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = ends[np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))))].tolist()
        small = np.int32 if max(ends[-1], len(ids)) < 1 << 31 else np.int64
        where = np.repeat((at[which] - ends[:-1]).astype(small), size)
        where += np.arange(len(where), dtype=small)
        ids = ids[where]
        spans = iter(zip(bounds[:-1], bounds[1:], strict=True))
        return [next(odd) if r is None else ids[slice(*next(spans))] for r in ready]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _trim() -> None:
    """Give memory that is free in Arrow's pool and in the C library's heap back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """Drop the worker's encoders; what comes after them in the same worker needs their memory."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        _trim()


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows with the ids of their texts, `end` appended; null reads as empty."""
    from censusflow.llm.common import pieces

    enc = encoder(path)
    for batch, texts in pieces(batches, column, limit):
        yield batch, [np.append(x, np.uint32(end)) for x in enc.ids([t.decode() for t in texts])]
        _trim()
