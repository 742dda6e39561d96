"""Token ids of texts by the tokenizers library, with the ids of words remembered in each worker."""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer, pre_tokenizers

END = 2
#: Texts of these characters need no Unicode rules: printable ASCII, white space, Latin-1 letters.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Marks of one piece, if they stand together after a word (an apostrophe may begin one).
_MARKS = "!#$%&()*+,-./:;=?@_~"
#: Runs between blanks that a worker remembers, about 220 bytes each.
MAX_WORDS = 500_000
#: Characters of the longest of them.
MAX_LENGTH = 64


class WordIds(dict):
    """The ids of a run between blanks, in lower case and of plain characters, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, specials_as_text: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        #: Beginnings of the strings of added tokens; texts that hold one are the library's own.
        self.added = () if specials_as_text else tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.merge = self.tokenizer.model.tokenize
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (*range(0x21, 0x7F), *range(0xDF, 0x100))
        self.alphabet = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in letters if c != 0xF7}

    def __missing__(self, run: str) -> bytes:
        if run.isalpha():
            ids = self.merged(run if run.isascii() else run.translate(self.alphabet))
        elif (word := run.rstrip(_MARKS)) != run and word.isalpha():  # a word and marks, which may have been seen
            ids = self[word] + self[run[len(word) :]]
        else:
            ids = b"".join([self.merged(p.translate(self.alphabet)) for p in _PIECES.findall(run)])
        if len(run) <= MAX_LENGTH:
            self[run] = ids
        return ids

    def merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merge(piece)]).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_known: dict[tuple[str, bool], WordIds] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


def encode(text: str | None, path: str, specials_as_text: bool = False) -> bytes:
    """The text's ids as the library gives them (null: none), little-endian unsigned 32-bit.

    The string of an added token in a text is that token, as in the library's plain call;
    ``specials_as_text``: it is ordinary text.

    This tokenizer cuts texts into words, numbers and marks, none of them with a blank, before it
    merges, so a text's ids are those of its runs between blanks in order. Where plain characters
    make the cut certain, each different run is merged by the library's model once; other texts go
    to the library whole.
    """
    words = _known.get((path, specials_as_text))
    if words is None:
        words = _known[path, specials_as_text] = WordIds(path, specials_as_text)
    if not text:
        return b""
    if not _PLAIN.fullmatch(text) or any(a in text for a in words.added):
        return words.whole(text)
    if len(words) > MAX_WORDS:
        words.clear()
    return b"".join(map(words.__getitem__, text.lower().split()))


def forget(path: str) -> None:
    """Frees the runs that this worker remembers, as it goes on to tasks of other stages."""
    for (known, _), words in _known.items():
        if known == path:
            words.clear()
