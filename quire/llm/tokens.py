"""Whole-text encoding by the ``tokenizers`` library, with a bounded cache of text segments.

Both public vocabularies split a text before they merge bytes, so a text may be cut at a blank or
line feed between two non-blank characters and its segments encoded apart: the byte-level
vocabulary starts a new pre-token at that blank, the word vocabulary drops it.  Words repeat, so
most segments come out of the cache as ready bytes; only new ones reach the library.

Ids travel as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import re
import sys
from array import array

#: Bytes that cached segments, their ids and bookkeeping may take in a Python worker; a full cache is
#: emptied.
CACHE_BYTES = 96 << 20
_ENTRY_BYTES = 190
#: Texts longer than this are cut into windows at safe blanks before they are split.
WINDOW_CHARS = 1 << 20

_SAFE_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
#: Every blank that is neither a space nor a line feed, and the mark that cuts segments.
OTHER_BLANK = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_encoders: dict = {}


def single_blanks(text: str) -> bool:
    """Whether every blank of a text is one space or line feed between two other characters."""
    return not (text[:1] in ("", " ", "\n") or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text
                or "\n " in text or OTHER_BLANK.search(text))


def windows(text: str, size: int = WINDOW_CHARS):
    """The text in consecutive parts that end at a blank between two non-blank characters."""
    at = 0
    while len(text) - at > size:
        m = _SAFE_CUT.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def cut_before_blanks(text: str) -> list[str]:
    """Segments that keep their leading blank; blanks next to other blanks are no cut."""
    if single_blanks(text):
        return text.replace("\n", "\x00\n").replace(" ", "\x00 ").split("\x00")
    parts, at = [], 0
    for m in _SAFE_CUT.finditer(text):
        parts.append(text[at:m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


def cut_at_blanks(text: str) -> list[str]:
    """Segments without the blanks between them."""
    return text.replace("\n", " ").split(" ")


#: A word of plain Latin letters, perhaps a blank before it, and ASCII punctuation behind it.
_PLAIN_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The visible stand-in of each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the others follow from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


_TO_LETTERS = dict(enumerate(_byte_letters()))
_SPACE = _TO_LETTERS[32]


def _id_bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class SegmentEncoder(dict):
    """Encode whole texts to id bytes.  The dictionary is the cache: segment -> id bytes.  A special
    token's own string in a text is ordinary text, or with ``plain_specials`` off its id, the library's
    default."""

    def __init__(self, path: str, style: str, plain_specials: bool = True):
        from tokenizers import Tokenizer
        super().__init__()
        self.held = 0
        self.marks: dict[str, bytes] = {}  # runs of punctuation
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.model = self.tokenizer.model
        self.lower = style == "words"
        self.cut = cut_at_blanks if style == "words" else cut_before_blanks

    def __missing__(self, segment: str) -> bytes:
        """A new segment.  Plain words go to the merge model directly -- its pre-tokenizer would
        only split off the punctuation -- and any other segment through the whole tokenizer."""
        m = _PLAIN_WORD.fullmatch(segment)
        if m is None or self.lower and segment.startswith(" "):
            out = _id_bytes(self.tokenizer.encode(segment, add_special_tokens=False).ids)
        elif m[2]:
            if (mark := self.marks.get(m[2])) is None:
                if len(self.marks) >= 10_000:
                    self.marks.clear()
                self.marks[m[2]] = mark = self._ids(m[2])
            out = self[m[1]] + mark
        else:
            out = self._ids(segment.lower() if self.lower else segment)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.held += _ENTRY_BYTES + len(segment) + len(out)
        self[segment] = out
        return out

    def _ids(self, pretoken: str) -> bytes:
        letters = pretoken.replace(" ", _SPACE) if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(_TO_LETTERS)
        return _id_bytes([t.id for t in self.model.tokenize(letters)])

    def encode(self, text: str | None) -> bytes:
        """The ids of the whole text as little-endian unsigned 32-bit bytes; none for null."""
        if not text:
            return b""
        get = self.__getitem__
        return b"".join([b"".join(map(get, self.cut(part))) for part in windows(text)])


def encoder(path: str, style: str, plain_specials: bool = True) -> SegmentEncoder:
    """One encoder per worker process; ``style``: ``bytes`` (blank-led words) or ``words``."""
    if (path, plain_specials) not in _encoders:
        _encoders[path, plain_specials] = SegmentEncoder(path, style, plain_specials)
    return _encoders[path, plain_specials]
