"""Token ids of whole texts with a public tokenizer, by way of a table of known words.

A text is cut where the tokenizer cuts for certain, each distinct piece is encoded once
with the tokenizers library, and the ids of a text are the joined ids of its pieces.  A text
that holds the string of a special token goes to the library whole.  The table of pieces is emptied when it is full, which costs time but changes nothing.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces remembered in one Python worker.
REMEMBERED = 1_200_000
#: New pieces encoded in one go.
TOGETHER = 400

#: A single blank between two characters that are no white space: a byte-level tokenizer
#: always starts a new piece at such a blank.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Bytes after which not every blank is of that kind.
_OTHER_SPACE = re.compile(rb" [\x09-\x0D\x1C-\x20]|[\x09-\x0D\x1C-\x1F] |\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80|\xE2\x81\x9F|\xE3\x80\x80")


_LETTER_BEFORE = bytes.isalpha


class WordIds:
    """Ids of texts as bytes of little-endian unsigned 32-bit integers.

    ``blank_joins`` tells how the tokenizer treats white space: True if the blank belongs to
    the word after it (byte-level), False if white space only separates words.
    """

    def __init__(self, file: str, blank_joins: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.blank_joins = blank_joins
        #: The library takes these strings, wherever they stand in a text, as one id; a text that
        #: holds one (in any case) is left to the library as it is.
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What these start with, up to their first letter, is the same in any case.
        self.starts = {re.match(rb"[^a-z\x80-\xff]*", s).group() for s in self.special}
        one = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        #: Whether the tokenizer itself lower-cases, so that words may be looked up in lower case.
        self.folds = one("Az") == one("az")
        #: A comma or full stop after a letter, at the end of a word, is a piece of its own.
        self.marks = {mark: one(chr(mark)) for mark in b",."}
        self.known: dict = {}
        self.heads: dict = {}

    def _learn(self, table: dict, pieces: list[bytes], prefix: str) -> None:
        """Encode new pieces, many in one text: a blank before each keeps them apart, and
        each token's place in the text tells whose it is."""
        marked = [p for p in pieces if p[-1:] in (b",", b".") and _LETTER_BEFORE(p[-2:-1])]
        if marked:
            pieces = list(set(pieces).difference(marked).union(p[:-1] for p in marked if p[:-1] not in table))
        alone = []
        for at in range(0, len(pieces), TOGETHER):
            few, texts, starts, size = [], [], [], 0
            for piece in pieces[at:at + TOGETHER]:
                text = piece.decode()
                if not text or text[0].isspace() or text[-1].isspace():
                    alone.append((piece, text))
                    continue
                few.append(piece)
                texts.append(text)
                starts.append(size)
                size += len(text) + 1
            if not few:
                continue
            e = self.tokenizer.encode(" " + " ".join(texts), add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            # A token's end never leaves its piece, its start may be the blank before it.
            ends = np.array([b for _, b in e.offsets], np.int64)
            cuts = np.searchsorted(ends, np.array(starts[1:] + [size]) + 1)
            blob, here = ids.tobytes(), 0
            for piece, cut in zip(few, cuts.tolist()):
                table[piece] = blob[4 * here:4 * cut]
                here = cut
        if alone:
            for (piece, _), e in zip(alone, self.tokenizer.encode_batch_fast([prefix + t for _, t in alone], add_special_tokens=False)):
                table[piece] = np.array(e.ids, "<u4").tobytes()
        for piece in marked:
            table[piece] = table[piece[:-1]] + self.marks[piece[-1]]

    def _look_up(self, pieces: list[list[bytes]], prefix: str) -> list[bytes]:
        """Joined ids of each list of pieces."""
        new = set().union(*pieces).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*pieces)
            self._learn(self.known, list(new), prefix)
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def _head(self, first: bytes) -> bytes:
        """The first piece of a text, which has no blank before it."""
        if first not in self.heads:
            if len(self.heads) > REMEMBERED // 8:
                self.heads.clear()
            self.heads[first] = np.array(self.tokenizer.encode(first.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return self.heads[first]

    def many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, those that ``encode(text, add_special_tokens=False)`` gives."""
        marked = [k for k, t in enumerate(texts) if any(a in t for a in self.starts) and any(s in t.lower() for s in self.special)]
        if marked:
            left = set(marked)
            plain = iter(self._plain([t for k, t in enumerate(texts) if k not in left]))
            whole = iter(self.tokenizer.encode_batch_fast([texts[k].decode() for k in marked], add_special_tokens=False))
            return [np.array(next(whole).ids, "<u4").tobytes() if k in left else next(plain) for k in range(len(texts))]
        return self._plain(texts)

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        if not self.blank_joins:
            return self._look_up([(t.lower() if self.folds else t).split() for t in texts], "")
        cut = [[p.encode() for p in _BETWEEN.split(t.decode())] if _OTHER_SPACE.search(t) else t.split(b" ") for t in texts]
        return [self._head(p[0]) + ids for p, ids in zip(cut, self._look_up([p[1:] for p in cut], " "))]

    def __call__(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text."""
        return self.many([text])[0]


_loaded: dict = {}


def word_ids(file: str, blank_joins: bool) -> WordIds:
    """One per Python worker and tokenizer file."""
    key = (file, blank_joins)
    if key not in _loaded:
        _loaded[key] = WordIds(*key)
    return _loaded[key]
