"""Encoding whole texts with a public tokenizer file, each distinct stretch of text once.

Both tokenizers first cut texts in runs of letters, of digits and of other characters; a single space between two
other characters always starts a run. So a text may be cut at single spaces and line ends, and before a comma or full
stop that ends a word, and its parts encoded apart; equal parts are encoded once per worker while they stay in a
bounded memory. Parts of Latin letters alone are one run and go straight to the tokenizer's merges.
"""

from __future__ import annotations

import array
import re
import zlib

MEMORY = 400_000    # parts of a generation; a worker remembers the newest one and the one before
LETTERS = 16 << 20  # characters of a generation, which bounds its bytes
PART = 256          # longer parts are not remembered

# where cutting at every space, line end, comma and full stop would not do: white space beside white space or at an
# end, other white space, a comma or full stop after something else than a letter or digit
_TWO = ("  ", "\n\n", " \n", "\n ", "\0")
_BLANK = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_STOP = re.compile(r"[,.][ \n](?<=[\W_]..)", re.S)
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"[^\x00-\u024f]")
# the visible stand-ins of bytes in byte-level vocabularies: printable ones themselves, the others from 256 on
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
_VISIBLE = {**{b: chr(b) for b in _PLAIN}, **{b: chr(256 + k) for k, b in enumerate(_OTHER)}}
_encoders: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _plain(text: str) -> bool:
    return not (text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _TWO)
                or any(x in text for x in _BLANK) or _STOP.search(text))


class _Memory(dict):
    """Ids of parts as little-endian unsigned 32-bit bytes, made when first asked for.

    A full generation becomes the old one, and parts that are asked for again move from there to the new one: common
    parts stay, also within one very long text.
    """

    def __init__(self, tokenizer, lower: bool):
        super().__init__({"": b""})
        self.tokenizer, self.merges, self.lower = tokenizer, tokenizer.model, lower
        self.old: dict[str, bytes] = {}
        self.letters = 0

    def __missing__(self, part: str) -> bytes:
        code = self.old.get(part)
        if code is None:
            code = self.ids(part)
        if len(part) <= PART:
            if len(self) >= MEMORY or self.letters >= LETTERS:
                self.old, self.letters = dict(self), 0
                self.clear()
                self[""] = b""
            self[part] = code
            self.letters += len(part)
        return code

    def ids(self, part: str) -> bytes:
        word = part[1:] if part[0] == " " else part
        if not word.isalpha() or (not word.isascii() and _WIDE.search(word)):
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        else:
            shown = word.lower() if self.lower else part
            shown = shown.replace(" ", _VISIBLE[32]) if word.isascii() else "".join(map(_VISIBLE.__getitem__, shown.encode()))
            ids = [t.id for t in self.merges.tokenize(shown)]
        return array.array("I", ids).tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; one memory per worker process and file."""

    def __new__(cls, path: str):
        if path not in _encoders:
            _encoders[path] = super().__new__(cls)
        return _encoders[path]

    def __init__(self, path: str):
        if hasattr(self, "tokenizer"):
            return
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.lower = bool(self.tokenizer.normalizer)  # that file folds case and drops white space
        self.memory = _Memory(self.tokenizer, self.lower)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None

    crc = staticmethod(zlib.crc32)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Exactly the ids of tokenizer.encode(text, add_special_tokens=False), for null those of an empty text."""
        code = self.memory.__getitem__
        return [b"".join(map(code, self._parts(t))) if t else b"" for t in texts]

    def _parts(self, text: str) -> list[str]:
        if self.special and "<" in text and self.special.search(text):
            return [text]
        if not _plain(text) or (self.lower and not text.isascii() and _WIDE.search(text)):
            first, *rest = _SAFE.split(text)
            return [first, *[" " + r for r in rest]]
        if self.lower:
            cut = text.lower().replace(" ", "\0").replace("\n", "\0")
        else:
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return cut.replace(",\0", "\0,\0").replace(".\0", "\0.\0").split("\0")
