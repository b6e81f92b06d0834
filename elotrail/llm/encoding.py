"""Encode texts with a public tokenizer inside tasks: pieces, cache, byte-balanced batches.

A byte-level BPE tokenizer first cuts a text into pre-tokens and encodes each
alone.  Some places between two characters always part two pre-tokens, whatever
stands around them (see ``Encoder._cuts``), so a text may be split there without
changing its ids.  Texts are cut into such pieces (mostly words and marks) in
groups of about ``GROUP_BYTES``, Arrow numbers the different pieces of a group, a
bounded per-worker cache keeps what the library gave for a piece, the missing
pieces are encoded in batches of about ``BATCH_BYTES``, and Arrow puts the ids in
the pieces' places.  For a tokenizer of another kind whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 13      # bytes of missing pieces given to the library at once
GROUP_CHARS = 1 << 20      # whole texts go to the library by about so many characters
GROUP_BYTES = 1 << 22      # texts are cut into pieces in groups of about so many bytes
SEGMENT_CHARS = 1 << 20    # longer texts are split at safe boundaries
CACHE_PIECES = 500_000     # entries; at half as many, those not met since the last time go
CACHE_BYTES = 100          # longer pieces are not kept
SAFE = re.compile(r"(?<=\S) (?=\S)")

#: classes of bytes: letters, digits, ASCII marks, the apostrophe, plain white space, the
#: line end, what may be white space, and anything else (not white space)
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _LINE, _BLANK, _OTHER = range(8)


def _classes() -> np.ndarray:
    c = np.full(256, _OTHER, np.uint8)
    c[33:48] = c[58:65] = c[91:97] = c[123:127] = _MARK
    c[48:58], c[65:91], c[97:123] = _DIGIT, _LETTER, _LETTER
    c[[9, 13, 32]], c[[11, 12, *range(28, 32)]] = _SPACE, _BLANK
    c[10], c[39] = _LINE, _QUOTE
    return c


def _pairs() -> np.ndarray:
    """For two neighbours' classes (first * 8 + second): does a pre-token always end between?

    White space never follows another character inside a pre-token.  Letters, digits
    and marks are pre-tokens of their own; only an apostrophe may draw letters to it."""
    p = np.zeros((8, 8), bool)
    p[np.ix_([_LETTER, _DIGIT, _MARK, _QUOTE, _OTHER], [_SPACE, _LINE])] = True
    p[_LETTER, [_DIGIT, _MARK, _QUOTE]] = p[_DIGIT, [_LETTER, _MARK, _QUOTE]] = True
    p[_MARK, [_LETTER, _DIGIT]] = True
    return p.reshape(-1)


CLASSES, PAIRS = _classes(), _pairs()


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a text at the first safe boundary after every ``limit`` characters.

    The parts joined give the text; all but the first begin with the one space
    of their boundary.  Without a boundary the rest stays whole."""
    at = 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


def byte_batches(pieces: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Deal pieces into lists of about ``limit`` UTF-8 bytes, at least one piece each."""
    batch, size = [], 0
    for p in pieces:
        batch.append(p)
        size += len(p.encode())
        if size >= limit:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; one per worker and file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cut_safely = False
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_batch = lambda xs: sp.encode(xs, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.encode_batch = lambda xs: [
            e.ids for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.cut_safely = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") and not pre.get("add_prefix_space")
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"]
                        or re.search(r"\s", a["content"]) for a in added))
        if self.cut_safely:  # a byte-level token has one character for each of its bytes
            n = tok.get_vocab_size(with_added_tokens=True)
            self.width = np.zeros(n, np.int64)
            for t, i in tok.get_vocab(with_added_tokens=True).items():
                self.width[i] = len(t)
            for a in added:
                self.width[a["id"]] = len(a["content"].encode())
            self.added = [a["content"].encode() for a in added if a["content"]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes of little-endian unsigned 32-bit integers."""
        if not self.cut_safely:
            for batch in byte_batches(texts, GROUP_CHARS):
                yield from (np.array(x, dtype="<u4").tobytes() for x in self.encode_batch(batch))
            return
        begun: list[bytes] = []  # ids so far of a text that goes on in the next group
        parts, ends, size = [], [], 0  # segments as bytes, places where texts end
        for text in texts:
            for part in segments(text):
                if size >= GROUP_BYTES:
                    yield from self._group(parts, ends, begun)
                    parts, ends, size = [], [], 0
                parts.append(part.encode())
                size += len(parts[-1])
            ends.append(size)
        yield from self._group(parts, ends, begun)

    def _group(self, parts: list[bytes], ends: list[int], begun: list[bytes]) -> Iterator[bytes]:
        """The ids of each text that ends in these segments; ``begun`` is used and kept up."""
        data = b"".join(parts)
        starts = self._cuts(data, np.cumsum([0, *map(len, parts)]))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [
            None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        found = self._find(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(pieces.indices)
        _, at, raw = ids.buffers()
        raw = memoryview(raw or b"")
        at = np.frombuffer(at, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        a = 0
        for b in at[np.searchsorted(starts, ends)].tolist():
            yield b"".join((*begun, raw[a:b]))
            begun.clear()
            a = b
        begun.append(bytes(raw[a:at[-1]]))

    def _cuts(self, data: bytes, parts: np.ndarray) -> np.ndarray:
        """Places where a pre-token always begins, with those of ``parts`` and both ends.

        Between the classes of ``PAIRS``, and after a line end that is all the white
        space there; never inside the text of an added token."""
        b = np.frombuffer(data, np.uint8)
        c = CLASSES[b]
        if not data.isascii():
            at = np.flatnonzero(b == 0xC3)  # U+00C0 to U+00FF, letters but two
            at = at[(b[at + 1] != 0x97) & (b[at + 1] != 0xB7)]
            c[at] = c[at + 1] = _LETTER
            at = np.flatnonzero(b == 0xC2)
            at = at[(b[at + 1] == 0x85) | (b[at + 1] == 0xA0)]
            c[at] = c[at + 1] = _BLANK
            at = np.flatnonzero((b >= 0xE1) & (b <= 0xE3))
            u = (b[at] & 15).astype(np.int32) << 12 | (b[at + 1] & 63).astype(np.int32) << 6 | b[at + 2] & 63
            at = at[np.isin(u, [0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                0x205F, 0x3000])]
            c[at] = c[at + 1] = c[at + 2] = _BLANK
        cut = np.zeros(len(b) + 1, bool)
        cut[1:-1] = PAIRS[c[:-1] << 3 | c[1:]]
        for x in self.added:
            at = data.find(x)
            while at >= 0:
                cut[at + 1:at + len(x)] = False
                at = data.find(x, at + 1)
        cut[parts] = True
        at = np.flatnonzero(b[:-1] == 10)
        at = at[cut[at]] + 1
        cut[at[(c[at] < _SPACE) | (c[at] == _OTHER)]] = True
        return np.flatnonzero(cut)

    def _find(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces, from the cache or else the library.

        A full cache becomes the older one, from which pieces are taken over as they
        are met, so that what is still in use stays."""
        found = list(map(self.cache.get, pieces))
        lost = [i for i, x in enumerate(found) if x is None]
        older = [self.older.get(pieces[i]) for i in lost]
        new = [pieces[i] for i, x in zip(lost, older) if x is None]
        made = self._pieces(new)
        for i, x in zip(lost, older):
            found[i] = x = next(made) if x is None else x
            if len(pieces[i]) <= CACHE_BYTES:
                self.cache[pieces[i]] = x
        if len(self.cache) >= CACHE_PIECES // 2:
            self.older, self.cache = self.cache, {}
        return found

    def _pieces(self, pieces: list[bytes]) -> Iterator[bytes]:
        """The library's ids of pieces: many in one run where they cannot touch each other,
        after a space as they come or else parted by line ends."""
        kinds: tuple[list[str], ...] = [], [], []
        order = []
        for text in map(bytes.decode, pieces):
            k = text[0] == " "
            if len(text) == k or text[k].isspace() or text[-1].isspace():
                k = 2
            kinds[k].append(text)
            order.append(k)
        runs = [iter([x for batch in byte_batches(kind) for x in self._run(batch, sep)])
                for kind, sep in zip(kinds, ("\n", "", None))]
        return (next(runs[k]) for k in order)

    def _run(self, pieces: list[str], sep: str | None) -> list[bytes]:
        """Ids of pieces; with ``sep`` the library is called once for the run, and its ids
        are cut where the pieces' bytes end."""
        if sep is not None:
            ids = np.array(self.encode_batch([sep.join(pieces)])[0], dtype="<u4")
            sizes = np.array([len(p.encode()) for p in pieces])
            ends = np.cumsum(sizes + len(sep)) - len(sep)
            at = np.concatenate(([0], np.cumsum(self.width[ids])))
            a, b = np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)
            if at[-1] == ends[-1] and np.array_equal(at[a], ends - sizes) and np.array_equal(at[b], ends):
                raw = ids.tobytes()
                return [raw[i:j] for i, j in zip((4 * a).tolist(), (4 * b).tolist())]
        return [np.array(x, dtype="<u4").tobytes() for x in self.encode_batch(pieces)]
