"""Token ids of whole texts, by word.

Both tokenizer files used here split a text into words first and encode each
word by itself, so the ids of a text are the joined ids of its words. Words
repeat: a slice of texts is cut and its distinct words are found in Arrow,
each distinct word is encoded, and the ids are put together in numpy.

Most words are letters and then marks (``prose.``). The library's word
pattern makes two words of such a one, so letters and marks go straight to
the library's BPE model, and the first ``cache_words`` of them that a Python
worker sees are kept. All other words go through the library's whole pipeline.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import Words, plain, words_of

#: About 200 bytes each.
CACHE_WORDS = 500_000
#: Longer words are encoded each time.
CACHE_CHARS = 64

#: White space of the byte-level tokenizer's word pattern (Unicode White_Space).
_SPACE = "\t-\r \x85\xa0" + chr(0x1680) + chr(0x2000) + "-" + chr(0x200A) + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: Marks the first piece of a text.
_FIRST = "\x01"
#: Texts with white space after white space, or with that mark.
_ODD = f"[{_SPACE}][{_SPACE}]|{_FIRST}"
#: Latin letters; they are lower-cased one by one and never composed.
_LETTERS = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: ASCII marks without the apostrophe, which starts contractions.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: The printable character that stands for each byte in byte-level vocabularies: bytes that are printable stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b if b in _PRINTABLE else None for b in range(256)}
_BYTE_CHARS |= {b: 256 + i for i, b in enumerate(b for b in range(256) if _BYTE_CHARS[b] is None)}


def space_led(texts: pa.Array) -> Words:
    """Cuts before each blank and line feed, where the byte-level word pattern
    always cuts if no white space follows other white space. A piece stands
    for a blank and itself, unless it starts with a line feed or, as a text's
    first, with ``_FIRST``."""
    marked = pc.binary_join_element_wise(_FIRST, texts, "")
    lists = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], coded.dictionary)


class Encoder:
    def __init__(self, path: str, byte_level: bool, cache_words: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.model = self.tokenizer.model
        self.byte_level, self.cache_words = byte_level, cache_words
        self.known: dict[str, bytes] = {}  # letters, marks, and whole other words after a zero character

    def _model(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable() or " " in word:
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _pipeline(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, key: str, ids: bytes) -> bytes:
        if len(self.known) < self.cache_words and len(key) <= CACHE_CHARS:
            self.known[key] = ids
        return ids

    def _letters(self, core: str) -> bytes | None:
        """Ids of letters, with what stands before them; null if it is
        something else."""
        if not self.byte_level:
            return self._keep(core, self._model(core.lower())) if _LETTERS.fullmatch(core) else None
        word = core[1:] if core[:1] in ("\n", _FIRST) else core
        if not _LETTERS.fullmatch(word):
            return None
        if word is core:
            return self._keep(core, self._model(" " + word))
        return self._keep(core, (self._model("\n") if core[0] == "\n" else b"") + self._model(word))

    def _other(self, piece: str) -> bytes:
        key = "\0" + piece
        if key in self.known:
            return self.known[key]
        if not self.byte_level or piece[:1] == "\n":
            return self._keep(key, self._pipeline(piece))
        return self._keep(key, self._pipeline(piece[1:] if piece[:1] == _FIRST else " " + piece))

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(_MARKS)
        ids = self.known.get(core)
        if ids is None and (ids := self._letters(core) if core else None) is None:
            return self._other(piece)
        if len(core) == len(piece):
            return ids
        marks = piece[len(core) :]
        tail = self.known.get("\0\0" + marks)
        return ids + (self._keep("\0\0" + marks, self._model(marks)) if tail is None else tail)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (no nulls) and the offsets of each text's.
        A text with a special token's string goes through the library whole."""
        texts = plain(texts)
        special = np.zeros(len(texts), bool)
        for s in self.special:  # in any case of letters: some files compare after normalising
            special |= pc.match_substring(texts, s, ignore_case=True).to_numpy(zero_copy_only=False)
        if special.any():
            return self._mixed(texts, np.flatnonzero(special), self._pipeline)
        if self.byte_level:
            odd = np.nonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))[0]
            if len(odd):
                # the pattern also cuts after the last character before white space
                return self._mixed(texts, odd, lambda text: b"".join(map(self._run, _CHUNK.findall(text))))
        words = space_led(texts) if self.byte_level else words_of(pc.ascii_lower(texts))
        ids = [self._piece(w) for w in words.vocabulary.to_pylist()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        counts = lengths[words.codes]
        upto = np.concatenate([[0], np.cumsum(counts)])
        place = np.repeat(starts[words.codes] - upto[:-1], counts) + np.arange(upto[-1])
        return flat[place], upto[words.offsets]

    def _mixed(self, texts: pa.Array, odd: np.ndarray, one: Callable[[str], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``one`` gives the ids of the ``odd`` texts."""
        usual = np.setdiff1d(np.arange(len(texts)), odd)
        ids, offsets = self.encode(texts.take(pa.array(usual)))
        parts: list = [None] * len(texts)
        for i, a, e in zip(usual.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            parts[i] = ids[a:e]
        for i in odd.tolist():
            parts[i] = np.frombuffer(one(texts[i].as_py()), "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _run(self, chunk: str) -> bytes:
        key = "\0\0\0" + chunk
        found = self.known.get(key)
        return self._keep(key, self._pipeline(chunk)) if found is None else found


#: Whether the tokenizer file cuts words before white space and keeps it, or ends words and drops it.
KINDS = {"byte_level": True, "word_end": False}


@cache
def encoder(path: str, kind: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One per Python worker and tokenizer file; ``path`` must be readable on
    every executor (tokenizer files are installed with the workers)."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
    return Encoder(path, KINDS[kind], cache_words)
