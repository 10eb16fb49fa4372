"""Encoding of whole texts by the ``tokenizers`` library, with a cache of units.

The library spends 10 to 30 microseconds on a word, most of it on words that it
has seen before. A text is therefore cut at places that its pre-tokenizer cuts
too, each distinct piece is encoded once by the library (a plain word by its model
alone, as the library's own pre-tokenizer would hand it on), and the ids are joined.
Texts with white space of another kind than single spaces and line feeds between
words (where the byte-level pre-tokenizer looks ahead) are encoded whole, and so are texts
that may have the string of a special token, which the library then takes as that token.

Rows of an Arrow array are cut together, on their bytes; each distinct unit is looked up once for all
of them, and its ids are put in all its places by Arrow's take.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

from rasterloom.llm.common import tidy

END_ID = 1
#: Bytes of units kept by a worker process, and about what an entry takes besides its unit and ids.
#: It only saves time.
KEPT_BYTES, ENTRY_BYTES = 48_000_000, 190
#: Rows and bytes of text that are cut together, and the bytes from which a text is encoded on its own.
ROWS, TOGETHER, LONG = 2000, 8_000_000, 64_000_000

_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z")
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Punctuation that both pre-tokenizers cut off the letters before it, as one piece.
_TAIL = ".,;:!?%$*#&|"
_LOADED: dict[tuple[str, str], "Encoder"] = {}


def vocabulary(name: str) -> str:
    """Where the installed public vocabulary of that name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: What a byte is where texts are cut: a letter, punctuation of _TAIL, a space, a line feed, or one that other white
#: space begins with.
_LETTER, _PUNCTUATION, _BLANK, _FEED, _MAY_BE_SPACE = 1, 2, 4, 8, 16


def _kinds_of_bytes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for kind, octets in (
        (_LETTER, [b for b in range(128) if chr(b).isalpha()]),
        (_PUNCTUATION, _TAIL.encode()),
        (_BLANK, b" "),
        (_FEED, b"\n"),
        (_MAY_BE_SPACE, [9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]),
    ):
        kinds[list(octets)] = kind
    return kinds


_KINDS = _kinds_of_bytes()


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts of an Arrow array of strings, where each begins, and the end). A null text is empty."""
    column = column.fill_null("")
    begins = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    octets = np.frombuffer(column.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
    return octets, begins - begins[0]


def cut(octets: np.ndarray, begins: np.ndarray):
    """(the units of all texts as an Arrow array, how many each text has, the texts that can't be cut, which have none).

    A unit is a line feed, or runs up to the next space or line feed; a space belongs to what follows. Punctuation
    of _TAIL behind a letter (ASCII or Latin-1, so that no normalisation takes it away) is a unit of its own.
    """
    import pyarrow as pa

    kinds, n = _KINDS[octets], len(begins) - 1
    white = (kinds & (_BLANK | _FEED)) > 0
    odd = np.diff(begins) > LONG

    def of(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(begins, places, "right") - 1

    full = np.flatnonzero(np.diff(begins))
    odd[full] |= white[begins[full + 1] - 1] | (kinds[begins[full]] == _FEED)
    odd[of(np.flatnonzero(white[1:] & white[:-1]))] = True  # or of two texts, of which the first is odd by its last
    for k in np.unique(of(np.flatnonzero(kinds == _MAY_BE_SPACE))).tolist():
        odd[k] = odd[k] or _OTHER_SPACE.search(octets[begins[k] : begins[k + 1]].tobytes().decode()) is not None
    marks = np.zeros(len(octets) + 1, bool)
    marks[begins] = True
    marks[:-1] |= white
    marks[1:] |= kinds == _FEED
    tails = np.flatnonzero(kinds == _PUNCTUATION)
    tails = tails[tails > 1]
    last = octets[tails - 1]
    marks[tails[(kinds[tails - 1] == _LETTER) | (octets[tails - 2] == 0xC3) & (last != 0x97) & (last != 0xB7)]] = True
    places = np.flatnonzero(marks)
    units = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(octets)])
    counts = np.diff(np.searchsorted(places, begins))
    if odd.any():
        units = units.filter(pa.array(np.repeat(~odd, counts)))
    return units, np.where(odd, 0, counts), odd


def slices(column, rows: int = 0, together: int = 0) -> Iterator[tuple[int, int]]:
    """(from, to) of so many rows of an Arrow array of strings that they are cut together."""
    rows, together = rows or ROWS, together or TOGETHER
    start, held = 0, 0
    for k, n in enumerate(np.diff(joined(column)[1]).tolist()):
        if k > start and (held + n > together or k - start == rows):
            yield start, k
            start, held = k, 0
        held += n
    if len(column):
        yield start, len(column)


class Kept:
    """The ids of units, as bytes, in two generations: when the younger is full, it becomes the
    older, whose units go unless they are asked for again. So memory is bounded by bytes, and
    what is frequent stays. Long units are of no use here."""

    def __init__(self, limit: int = KEPT_BYTES):
        self.limit, self.held, self.young, self.old = limit // 2, 0, {}, {}

    def get(self, unit: str) -> bytes | None:
        ids = self.young.get(unit)
        if ids is None and (ids := self.old.get(unit)) is not None:
            self.put(unit, ids)
        return ids

    def put(self, unit: str, ids: bytes) -> None:
        if len(unit) < 100:
            self.young[unit] = ids
            self.held += ENTRY_BYTES + len(unit) + len(ids)
            if self.held > self.limit:
                self.old, self.young, self.held = self.young, {}, 0


class Encoder:
    """kind "word": white space only separates (word_bpe); "byte": byte-level BPE."""

    def __init__(self, path: str, kind: str, kept_bytes: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = kind
        self.letters = _byte_letters()
        #: The first two letters of added tokens' strings.
        self.marks = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.known = Kept(kept_bytes)

    def ids_of(self, unit: str) -> bytes:
        ids = self.known.get(unit)
        if ids is None:
            ids = self._encode_unit(unit) if unit else b""
            self.known.put(unit, ids)
        return ids

    def _encode_unit(self, unit: str) -> bytes:
        core = unit.rstrip(_TAIL)
        bare = core[1:] if self.kind == "byte" and core[:1] == " " else core
        if len(core) < len(unit) and bare:
            return self.ids_of(core) + self.ids_of(unit[len(core) :]) if self._ends_in_letter(bare) else self._whole(unit)
        if bare.isalpha() and max(bare) < "\u0100":
            # One pre-token of Latin letters, to which normalisation does nothing but lower them: straight to the model.
            if self.kind == "word":
                core = core.lower()
            return array("I", [t.id for t in self.model.tokenize(core.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return self._whole(unit)

    def _ends_in_letter(self, bare: str) -> bool:
        """Whether punctuation behind is a piece of its own: as the library sees the text, so for "word" after
        normalisation, which may leave a mark at the end of what was a letter."""
        seen = unicodedata.normalize("NFC", bare) if self.kind == "word" and not bare.isascii() else bare
        return seen[-1].isalpha() and (self.kind == "byte" or seen[-1].lower()[-1].isalpha())

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _units(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if "\x00" in text or _ODD_SPACE.search(text):
            return [text]
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if any(m in text for m in self.marks):
            return self._whole(text)
        young, ids_of = self.known.young, self.ids_of
        return b"".join([young.get(u) or ids_of(u) for u in self._units(text)])

    def encode_all(self, column) -> list[bytes]:
        """encode() for each text of an Arrow array of strings; a null text is empty."""
        import pyarrow as pa

        octets, begins = joined(column)
        units, counts, whole = cut(octets, begins)
        if self.marks:
            found = re.finditer(b"|".join(re.escape(m.encode()) for m in self.marks), octets)
            marked = np.zeros(len(whole), bool)
            marked[np.searchsorted(begins, np.array([m.start() for m in found], np.int64), "right") - 1] = True
            if marked.any():
                units = units.filter(pa.array(np.repeat(~marked, counts)))
                counts, whole = np.where(marked, 0, counts), whole | marked
        coded = units.dictionary_encode()
        often = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).tolist()
        ids = pa.array(self._ids_of_all(coded.dictionary.to_pylist(), often), pa.binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1] or bytes(4), np.int32)[np.cumsum([0, *counts])].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        found = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
        for k in np.flatnonzero(whole).tolist():
            found[k] = self.encode(octets[begins[k] : begins[k + 1]].tobytes().decode())
        return found

    def _ids_of_all(self, units: list[bytes], often: list[int]) -> list[bytes]:
        """The ids of distinct units. One that is seen once is kept only while there is room for all."""
        found, known = list(map(self.known.young.get, units)), self.known
        for k, ids in enumerate(found):
            if ids is None:
                ids = known.get(units[k])
                if ids is None:
                    unit = units[k].decode()
                    unit = unit.strip() if self.kind == "word" else unit
                    ids = self._encode_unit(unit) if unit else b""
                    if often[k] > 1 or not known.old:
                        known.put(units[k], ids)
                found[k] = ids
        return found


def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Encoder(path, kind)
    return _LOADED[path, kind]


def encoded_rows(batches, path: str, kind: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id) of Arrow batches (doc_id, text); a null text is empty."""
    enc, end = encoder(path, kind), END_ID.to_bytes(4, "little")
    for batch in batches:
        for x, y in slices(batch.column(1)):
            part = batch.slice(x, y - x)
            for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1))):
                yield doc_id, ids + end
    tidy()
