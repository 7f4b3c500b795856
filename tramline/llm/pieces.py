"""Whole texts through the tokenizers library, with frequent pieces of text remembered.

A piece ends where no merge can cross, so a text's ids are its pieces' ids in a row. Two rules of cutting:

* ``words``: at each space and line feed; for vocabularies that drop white space before they merge.
* ``spaces``: before each single space that stands between two characters that are no white space; for byte-level
  vocabularies, whose pattern takes a space with the word after it. A text with other runs of spaces is encoded whole.

A piece of letters and punctuation alone, and for ``spaces`` single line feeds between them, is cut on into its runs of
either, as no merge crosses from one to the next. All cuts of a batch are found at once, from the classes of its bytes, so
Python sees distinct pieces only. Pieces not yet known are encoded many at a time. The memory has two halves of at most
``limit`` pieces: a full young half becomes the old one, and what is asked for again moves back.

Strings of special tokens in a text are ordinary text, as the notes beside the tokenizer files have it
(``encode_special_tokens``); with ``special`` they become the special ids, and texts that hold one are encoded whole.
"""

from __future__ import annotations

import os
import pickle
import posixpath
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import file_system

_ENCODERS: dict[tuple, "PieceEncoder"] = {}
#: Objects read from files, by name.
_LOADED: dict[str, object] = {}
#: A character that stands alone between the pieces of a ``words`` batch.
MARK = "\x01"
#: Pieces in half of the memory: some 200 bytes each.
REMEMBERED = 500_000
#: Pieces encoded at a time.
TOGETHER = 1000
#: Classes of bytes. Letters are of blocks in which all characters are letters (U+00C0 to U+023F), and only those that stay
#: letters under each vocabulary's normaliser: U+0130 is left out (``_classes``), as its lower case ends in a combining mark,
#: which goes with punctuation after it. The apostrophe is no mark, as it may go with what follows. A piece with a byte of
#: another kind is odd and not cut on.
ODD, LETTER, SIGN, SPACE, FEED = range(5)
CLASS = np.zeros(256, np.uint8)
CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = LETTER
CLASS[[b for b in range(ord("!"), 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = SIGN
CLASS[ord(" ")], CLASS[ord("\n")] = SPACE, FEED
LOWER = np.array([ord(chr(b).lower()) if b < 128 else b for b in range(256)], np.uint8)
CAPITALS = "".join(c for c in map(chr, [*range(ord("A"), ord("Z") + 1), *range(0xC0, 0xDF)]) if c != "\u00D7")


def encoder(load: Callable, cut: str, *key: str, limit: int = REMEMBERED, special: bool = False) -> "PieceEncoder":
    """The encoder for ``key`` of this process; tasks in one Python worker share it."""
    if (cut, limit, special, *key) not in _ENCODERS:
        _ENCODERS[cut, limit, special, *key] = PieceEncoder(load, cut, limit, special=special)
    return _ENCODERS[cut, limit, special, *key]


def _strings(of: pa.Array) -> list[str]:
    """As ``to_pylist``, by one conversion of the whole array."""
    return of.to_numpy(zero_copy_only=False).tolist()


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8."""
    kind = CLASS[data]
    for lead, *second in ((0xC3, 0x97, 0xB7), (0xC4, 0xB0)):  # the signs of multiplication and division, and U+0130
        for b in second:
            kind[:-1][(data[:-1] == lead) & (data[1:] == b)] = ODD
    return kind


def forget(keep: str | None = None) -> None:
    """Give up what a worker remembers, but the object of the file ``keep``; tasks that encode nothing call it, as workers outlive their tasks."""
    _ENCODERS.clear()
    for name in [n for n in _LOADED if n != keep]:
        del _LOADED[name]


def loaded(uri: str) -> object:
    """The object that ``store`` wrote; a worker keeps the last one, and gives up all else."""
    forget(uri)
    if uri not in _LOADED:
        fs, inner = file_system(uri)
        with fs.open_input_file(inner) as f:
            _LOADED[uri] = pickle.load(f)
    return _LOADED[uri]


def store(made: object, folder: str) -> str:
    """Write an object to a new file of the folder, by a name of its own, so that attempts of a task don't meet."""
    uri = posixpath.join(folder, uuid.uuid4().hex)
    fs, inner = file_system(uri)
    fs.create_dir(posixpath.dirname(inner))
    with fs.open_output_stream(inner) as f:
        pickle.dump(made, f, protocol=5)
    return uri


class PieceEncoder:
    """Encodes texts to little-endian unsigned ids."""

    def __init__(self, load: Callable, cut: str, limit: int = REMEMBERED, longest: int = 48, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = load()
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cut, self.limit, self.longest, self.young, self.old = cut, limit, longest, {}, {}
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that end a word (``words``), that begin with a space (``spaces``).
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        if cut == "words":
            self.mark = np.frombuffer(self.whole([MARK])[0], self.dtype)
            suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
            self.edge[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
            #: Whether capitals have the ids of small letters.
            self.folds = self.whole([*CAPITALS]) == self.whole([*CAPITALS.lower()])
        else:
            self.feed = np.frombuffer(self.whole(["\n"])[0], self.dtype)
            self.edge[[i for t, i in vocabulary.items() if t[0] == "Ġ"]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _together(self, pieces: list[str], join: str, edges: Callable, last: bool) -> list[bytes]:
        """Ids of each piece, from texts of many. ``edges``: which ids stand at a piece's edge, as its ``last`` or first one;
        an id between two pieces is the first's."""
        n, out = self.dtype.itemsize, []
        chunks = [pieces[k : k + TOGETHER] for k in range(0, len(pieces), TOGETHER)]
        for chunk, coded in zip(chunks, self.whole([join.join(c) for c in chunks])):
            at = np.nonzero(edges(np.frombuffer(coded, self.dtype)))[0] + last
            if len(at) != len(chunk):
                out += self.whole(chunk)
                continue
            cuts = (np.append(at, len(coded) // n) if not last else np.insert(at, 0, 0)) * n
            cuts = cuts.tolist()
            out += [coded[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _between(self, pieces: list[str], join: str, mark: np.ndarray) -> list[bytes]:
        """Ids of each piece, from texts of many with one id ``mark`` between two of them."""
        n, out = self.dtype.itemsize, []
        for k in range(0, len(pieces), TOGETHER):
            chunk = pieces[k : k + TOGETHER]
            coded = self.whole([join.join(chunk)])[0]
            ids = np.frombuffer(coded, self.dtype)
            at = np.nonzero(ids == mark[0])[0]
            if len(mark) == 1 and len(at) == len(chunk) - 1:
                out += [coded[i * n : j * n] for i, j in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)])]
            else:  # a piece that holds the mark
                out += self.whole(chunk)
        return out

    def _new(self, pieces: list[str], odd: bool) -> list[tuple[str, bytes]]:
        """Pieces with their ids; odd ones are more than a run of letters or marks."""
        if self.cut == "words":
            return list(zip(pieces, self._between(pieces, f" {MARK} ", self.mark) if odd else self._together(pieces, " ", self.edge.__getitem__, True)))
        spaced, bare = [p for p in pieces if p[0] == " "], [p for p in pieces if p[0] != " "]
        return [*zip(spaced, self._together(spaced, "", self.edge.__getitem__, False)), *zip(bare, self.whole(bare) if odd else self._between(bare, "\n", self.feed))]

    def _look_up(self, pieces: list[str], odd: np.ndarray) -> list[bytes | None]:
        """Ids of each of these distinct pieces; with the cut ``spaces``, None for odd ones that are a space alone or have white space at an end."""
        young, old = self.young, self.old
        got = list(map(young.get, pieces))
        missed = [k for k, b in enumerate(got) if b is None]
        again = list(map(old.get, map(pieces.__getitem__, missed)))
        young.update((pieces[k], b) for k, b in zip(missed, again) if b is not None)
        new: tuple[list[str], list[str]] = [], []
        for k, b, other in zip(missed, again, odd[missed].tolist()):
            if b is not None:
                got[k] = b
            elif not other:
                new[0].append(pieces[k])
            elif self.cut == "words" or ((p := pieces[k].removeprefix(" ")) and p.strip() == p):
                new[1].append(pieces[k])
        coded = dict(self._new(new[0], False) + self._new(new[1], True))
        for k in missed:
            if got[k] is None:
                got[k] = coded.get(pieces[k])
        young.update((p, b) for p, b in coded.items() if len(p) <= self.longest)
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return got

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of all texts in a row, where each text's begin (one more at the end), and which are odd."""
        words = self.cut == "words"
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        heads = ends[:-1][ends[:-1] < ends[1:]]
        kind = _classes(data)
        first = np.zeros(len(data), bool)
        first[heads] = True
        if words:
            kind[kind == FEED] = SPACE
            outer = first.copy()
            outer[1:] |= kind[:-1] == SPACE
            first[1:] |= kind[1:] != kind[:-1]
            # What remains are the pieces' bytes.
            kept = kind != SPACE
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(kept, dtype=np.int32)])[ends]
            data, kind, first, outer = data[kept], kind[kept], first[kept], outer[kept]
        else:
            run = (kind == LETTER) | (kind == SIGN)
            feeds = np.nonzero(kind == FEED)[0]
            inside = feeds[(feeds > 0) & (feeds < len(data) - 1)]
            inside = inside[run[inside - 1] & run[inside + 1] & ~first[inside] & ~first[inside + 1]]
            kind[feeds], kind[inside] = ODD, FEED
            space = kind == SPACE
            outer = first | space
            alone = np.nonzero(space & np.append(outer[1:], True))[0] if len(data) else feeds
            kind[alone] = ODD
            first[1:] |= (kind[1:] != kind[:-1]) & ~space[:-1]
            first |= space
        at = np.nonzero(outer)[0]
        odd = np.minimum.reduceat(kind, at) == ODD if len(at) else np.zeros(0, bool)
        within = np.repeat(odd, np.diff(np.append(at, len(data)))) if odd.any() else None
        if within is not None:
            first &= outer | ~within
        if words and self.folds:
            low = LOWER[data]
            low[1:][(data[:-1] == 0xC3) & (data[1:] < 0x9F)] += 0x20
            data = low if within is None else np.where(within, data, low)
        starts = np.nonzero(first)[0]
        cuts = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data)))
        return pieces, np.searchsorted(starts, ends), np.zeros(len(starts), bool) if within is None else within[starts]

    def _special(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold the string of a special token that counts."""
        hit = np.zeros(len(texts), bool)
        for s in self.special:
            hit |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False).astype(bool)
        return hit

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more at the end). No text may be null."""
        flat, at, odd = self._cut(texts)
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy()
        other = np.zeros(len(coded.dictionary), bool)
        other[index[odd]] = True
        found = self._look_up(_strings(coded.dictionary), other)
        whole = self._special(texts)
        if lost := [k for k, b in enumerate(found) if b is None]:
            other[:] = False
            other[lost] = True
            whole[np.searchsorted(at, np.nonzero(other[index])[0], "right") - 1] = True
            for k in lost:
                found[k] = b""
        found.append(b"")
        if whole.any():
            # Such a text has a piece at least.
            rows = np.nonzero(whole)[0]
            index = index.copy()
            for k in rows.tolist():
                index[at[k] : at[k + 1]] = len(found) - 1
            index[at[rows]] = len(found) + np.arange(len(rows))
            found += self.whole(_strings(texts.take(pa.array(rows))))
        size = np.array([len(b) for b in found], np.int32) // self.dtype.itemsize
        data = np.frombuffer(b"".join(found), self.dtype)
        start = np.cumsum(size, dtype=np.int32) - size
        n = size[index]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int32)]).astype(np.int32)
        take = np.repeat(start[index] - ends[:-1], n)
        take += np.arange(ends[-1], dtype=np.int32)
        return data[take], ends[at].astype(np.int64)
