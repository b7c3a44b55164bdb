"""Whole-text encoding with the tokenizers library, each distinct piece of text encoded once.

Both supported vocabularies cut a text where a single blank stands between two other characters, whatever follows, so a
text's ids are its parts' ids in a row. Parts recur (words do), so they are kept in a bounded table. Parts of plain
Latin letters skip the library's slow normaliser and go to its model as ready pieces; all others go through the
unchanged tokenizer.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netfell.llm.arrow import buffer
from netfell.llm.workers import kept, trim

#: Bytes of parts and their ids kept per Python worker where the caller names no other bound, counting PART_BYTES for each part's objects and its place in the
#: table; beyond it only parts that came again in the latest texts stay. A part of more than KEPT_CHARS characters is not kept.
KEPT_BYTES, PART_BYTES, KEPT_CHARS = 112 << 20, 200, 256

#: Bytes of text to hand to encode() at a time, where memory allows: the more, the fewer times a part is looked up.
TEXT_BYTES = 12 << 20
#: New parts that are encoded at a time; the library's answers take many times the room of the ids.
LEARN_PARTS = 1 << 15

#: Longer texts are encoded a segment at a time.
SEGMENT = 1 << 20

_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = " \t\n\r\f\v"
_CUT_LOWER = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_BLANK}{_LETTERS}0-9]+")
_CUT_SPACED = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANK}{_LETTERS}0-9]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
#: Stands between plain parts or pieces, which cannot hold it.
_JOINT = "\u2016"
_TWO_BLANKS = re.compile(r"\s\s")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?=[ \n]\S)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _segments(text: str) -> Iterator[str]:
    """Runs of about half a SEGMENT that end where a part ends; a text with no such place stays whole."""
    at = 0
    while at < len(text):
        cut = _BEFORE_BLANK.search(text, at + SEGMENT // 2)
        end = cut.start() if cut and len(text) - at > SEGMENT else len(text)
        yield text[at:end]
        at = end


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned ``dtype`` bytes, as encode(text,
    add_special_tokens=False) of the whole text would, with the special tokens' strings as ordinary text."""

    def __init__(self, vocabulary: str, dtype: str = "<u2", most: int | None = None):
        self.most = most or KEPT_BYTES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.whole.encode_special_tokens = True
        self.lower = spec["normalizer"] is not None
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.letters = _byte_letters()
        self.joint = _JOINT.encode().decode("latin-1").translate(self.letters)
        self.dtype = np.dtype(dtype)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Nothing here makes cycles, so Python need not look for them among millions of parts."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode_all(texts)
        finally:
            if was:
                gc.enable()

    def _encode_all(self, texts: list[str | None]) -> list[bytes]:
        long = [i for i, t in enumerate(texts) if t and len(t) > SEGMENT]
        out = self._encode([None if t and len(t) > SEGMENT else t for t in texts] if long else texts)
        for i in long:
            out[i] = b"".join(self._encode([piece])[0] for piece in _segments(texts[i]))
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        uneven = {i: self._split_uneven(t) for i, t in enumerate(texts) if t and not self.lower and self._uneven(t)}
        regular = [i for i, t in enumerate(texts) if t and i not in uneven]
        parts, places, ends = self._distinct_parts([texts[i] for i in regular])
        fresh = list({p for p in chain(parts, *uneven.values()) if p not in self.known})
        for at in range(0, len(fresh), LEARN_PARTS):
            self._learn(fresh[at : at + LEARN_PARTS])
        get, out = self.known.__getitem__, [b""] * len(texts)
        if regular:
            joined = pa.array(map(get, parts), pa.binary()).take(places)
            raw, starts = buffer(joined)
            raw, cuts = raw.tobytes(), starts[ends].tolist()
            for i, start, end in zip(regular, [0, *cuts], cuts, strict=False):
                out[i] = raw[start:end]
        for i, own in uneven.items():
            out[i] = b"".join(map(get, own))
        for p in fresh:
            if len(p) > KEPT_CHARS:
                del self.known[p]
            else:
                self.held += PART_BYTES + len(p)
        if self.held > self.most:
            self._keep(set(chain(parts, *uneven.values())).difference(fresh))
        return out

    def _keep(self, parts: set[str]) -> None:
        """Forget all but these parts, or if they are too many as well, all."""
        if (held := sum(map(len, parts)) + PART_BYTES * len(parts)) > self.most // 2:
            parts, held = set(), 0
        self.known, self.held = {p: self.known[p] for p in parts}, held
        trim()

    def _distinct_parts(self, texts: list[str]) -> tuple[list[str], pa.Array, np.ndarray]:
        """The parts of even texts, each once but for those that begin a text, where every place's part is among them,
        and how many places there are up to the end of each text. A first part is marked by a blank where the others
        go without the blank before them."""
        blanks = pc.replace_substring(pa.array(texts, pa.string()), "\n", " " if self.lower else " \n")
        split = pc.split_pattern(blanks, " ")
        coded, starts = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        parts, places = coded.dictionary.to_pylist(), coded.indices
        if not self.lower and texts:
            own = places.to_numpy().copy()
            first = own[starts[:-1]]
            own[starts[:-1]] = len(parts) + np.arange(len(texts))
            parts += [f" {parts[i]}" for i in first.tolist()]
            places = pa.array(own)
        return parts, places, starts[1:]

    @staticmethod
    def _uneven(text: str) -> bool:
        """Whether blanks stand elsewhere than singly between other characters."""
        return text[0].isspace() or text[-1].isspace() or _TWO_BLANKS.search(text) is not None

    @staticmethod
    def _split_uneven(text: str) -> list[str]:
        """Parts, without the blank before each but the first. The first is marked by a blank, which no other has."""
        first, *rest = _BEFORE_BLANK.split(text)
        return [f" {first}", *[p[1:] if p[0] == " " else p for p in rest]]

    def _literal(self, part: str) -> str:
        if self.lower or part[0] == "\n":
            return part
        return part[1:] if part[0] == " " else f" {part}"

    def _learn(self, parts: list[str]) -> None:
        known, match = self.known, _PLAIN.fullmatch
        plain = [p for p in parts if p.isascii() or match(p)]
        if len(plain) < len(parts):
            odd = list(set(parts).difference(plain))
            got = self.whole.encode_batch_fast([self._literal(p) for p in odd], add_special_tokens=False)
            known.update((p, np.array(x.ids, self.dtype).tobytes()) for p, x in zip(odd, got, strict=True))
        if not plain:
            return
        alpha = [p for p in plain if p.isalpha()]  # a piece of its own, with the blank that may go before it
        mixed = [p for p in plain if not p.isalpha()]
        if self.lower:
            spelt = _JOINT.join(alpha).lower().split(_JOINT) if alpha else []
            cuts = list(map(_CUT_LOWER.findall, map(str.lower, mixed)))
        else:
            spelt = [f" {p}" for p in alpha]
            cuts = list(map(_CUT_SPACED.findall, map(self._literal, mixed)))
        pieces = set(chain.from_iterable(cuts))
        skip = 0 if self.lower else 1
        of = {x: ids for x in pieces if (skip == 0 or x[0] == " ") and x[skip:].isalpha() and (ids := known.get(x[skip:])) is not None}
        pieces = list(pieces.difference(of).union(spelt))
        if pieces:
            of.update(self._model_ids(pieces))
        known.update(zip(alpha, map(of.__getitem__, spelt), strict=True))
        known.update((p, b"".join([of[x] for x in c])) for p, c in zip(mixed, cuts, strict=True))

    def _model_ids(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each plain piece with its ids, from one call of the library."""
        spelt = _JOINT.join(pieces).encode().decode("latin-1").translate(self.letters).split(self.joint)
        got = self.model.encode_batch([spelt], is_pretokenized=True, add_special_tokens=False)[0]
        ids, size = np.array(got.ids, self.dtype).tobytes(), self.dtype.itemsize
        ends = (np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(pieces))) * size).tolist()
        return zip(pieces, map(ids.__getitem__, map(slice, [0, *ends], ends)), strict=False)


def encoder(vocabulary: str, dtype: str = "<u2", most: int | None = None) -> PieceEncoder:
    """This worker's encoder, with ``most`` bytes of parts, kept until the worker runs another operator."""
    return kept(("piececache", vocabulary, dtype, most), lambda: PieceEncoder(vocabulary, dtype, most))
