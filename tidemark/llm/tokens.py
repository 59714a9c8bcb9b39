"""Token ids of whole texts, by a public tokenizer and a bounded memory of words."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from itertools import islice
from operator import attrgetter

from tidemark.llm._common import REMEMBERED, UNICODE_SPACE, split_words

#: Words remembered by a Python worker, for each tokenizer, at most.
WORDS_HELD = 500_000

#: A byte-level vocabulary keeps white space: one space goes with the word after it, the rest stands alone.
#: Its blank is written Ġ, as in all byte-level vocabularies (fixed value).
_BLANK = chr(288)
_SPACED = re.compile(f" ?[^{UNICODE_SPACE}]+|[{UNICODE_SPACE}]+(?![^{UNICODE_SPACE}])|[{UNICODE_SPACE}]+")
#: Where a text holds none of these, and at most one of blank and line feed at its end, each of both begins a piece, and a line feed ends it, too.
_NOT_SIMPLE = ("\0", *(c for c in UNICODE_SPACE if c not in " \n"), *(a + b + c for a in " \n" for b in " \n" for c in " \n"))

#: How both vocabularies cut a piece of printable ASCII and Latin letters (fixed values); the second lower-cases it and takes digits one by one.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_PLAIN = re.compile(f" ?[!-~{_LATIN}]+")
_PLAIN_CUTS = {
    True: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+"),
    False: re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s0-9{_LATIN}]+"),
}


def _byte_letters() -> str:
    """What byte-level vocabularies write for each byte: printable Latin-1 characters stand for themselves, the others for those from 256 on, in turn."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    shown = {b: 256 + n for n, b in enumerate(others)}
    return "".join(chr(shown.get(b, b)) for b in range(256))


def _spaced(text: str) -> list[str]:
    """The matches of ``_SPACED``, and empty strings; simple texts without the regular expression."""
    if any(c in text for c in _NOT_SIMPLE) or not text[-2:].strip(" \n"):
        return _SPACED.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


_LETTERS = _byte_letters()
_ids_of = attrgetter("id")


class WordEncoder:
    """The ids that ``tokenizers`` gives a text with ``add_special_tokens=False``, as little-endian uint32 bytes.

    No token of these tokenizers crosses the cuts used here (``keeps_space``:
    before the space that leads a word, and around other white space;
    otherwise: at white space, which is dropped), so a text's ids are those of
    its pieces in turn, and a piece is encoded when it is first met.  A text
    that holds the string of a special token goes to the library whole, which
    takes that string for the token.
    """

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._specials = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._pieces = _spaced if keeps_space else split_words
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # words that come again are held here
        self._keeps_space, self._cut = keeps_space, _PLAIN_CUTS[keeps_space].findall
        self._held: dict[str, bytes] = {}
        REMEMBERED.append(self._held)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if any(s in text or s in text.lower() for s in self._specials if s[0] in text):
                out.append(_packed(self._tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            pieces = self._pieces(text)
            try:
                out.append(b"".join(map(self._held.__getitem__, pieces)))
            except KeyError:
                self._learn(pieces)
                out.append(b"".join(map(self._held.__getitem__, pieces)))
        return out

    def _learn(self, pieces: list[str]) -> None:
        held = self._held
        if len(held) > WORDS_HELD:  # those learned first go; what is common among them comes back soon
            for piece in list(islice(held, WORDS_HELD // 2)):
                del held[piece]
        rest = []
        for piece in set(pieces).difference(held):
            if _PLAIN.fullmatch(piece):
                held[piece] = self._plain(piece)
            else:
                rest.append(piece)
        for piece, found in zip(rest, self._tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            held[piece] = _packed(found.ids)

    def _plain(self, piece: str) -> bytes:
        """Straight to the tokenizer's model, without the offsets that its encodings carry."""
        if not self._keeps_space:
            piece = piece.lower()
        tokenize = self._model.tokenize
        if piece.isalpha():
            return _packed(map(_ids_of, tokenize(_shown(piece))))
        held, out = self._held, b""
        for part in self._cut(piece):
            ids = held.get(part)
            if ids is None:
                ids = _packed(map(_ids_of, tokenize(_shown(part))))
                if self._keeps_space:
                    held[part] = ids
            out += ids
        return out


def _shown(part: str) -> str:
    """A part as the vocabulary writes it."""
    if part.isascii():
        return part.replace(" ", _BLANK)
    return part.encode().decode("latin-1").translate(_LETTERS)


def _packed(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """The worker's encoder; it outlives a task."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[key] = WordEncoder(path, keeps_space)
    return _ENCODERS[key]
