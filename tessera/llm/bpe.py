"""Token ids by the `tokenizers` library, with each piece between spaces encoded once and kept for a while."""

from __future__ import annotations

import os
import re
from array import array

#: A space between white space, or between white space and the end, isn't a boundary of the byte-level pre-tokenizer.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Letters of the Latin blocks; a run of them after a space is one piece of the pre-tokenizer.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]*")


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """Encodes texts as `Tokenizer.encode(text, add_special_tokens=False)` does.

    The byte-level pre-tokenizer always starts a new piece at a space that follows or precedes a character other
    than white space, and where a run of letters ends; merges never cross pieces. So a text is cut at such spaces,
    each distinct cut is encoded by the library, and its ids are kept. The table of kept cuts has two generations of
    `keep` cuts; cuts in use move to the young one. Texts with other spaces are encoded whole.
    """

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chars = byte_chars()
        self.keep = keep
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}

    def _ids(self, strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _word(self, letters: str) -> bytes:
        """Ids of a space and letters, which are one piece."""
        text = f"Ġ{letters}" if letters.isascii() else f" {letters}".encode().decode("latin1").translate(self.chars)
        return array("I", [x.id for x in self.model.tokenize(text)]).tobytes()

    def _learn(self, w: str) -> bytes:
        """Ids of a cut that isn't in the young generation, which gets it."""
        if (ids := self.old.get(w)) is None:
            head = LETTERS.match(w)[0]
            if not head:
                ids = self._ids([f" {w}"])[0]
            elif head == w:
                ids = self._word(w)
            else:
                ids = self.known.get(head) or self._learn(head)
                rest = w[len(head) :]
                if (more := self.rests.get(rest)) is None:
                    if len(self.rests) > self.keep // 4:
                        self.rests.clear()
                    self.rests[rest] = more = self._ids([rest])[0]
                ids += more
        self.known[w] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            if UNSAFE.search(text):
                out += self._ids([text])
                continue
            if len(self.known) > self.keep:
                self.known, self.old = {}, self.known
            cuts = text.split(" ")
            first, cuts[0] = cuts[0], None
            ids = list(map(self.known.get, cuts))
            ids[0] = self._ids([first])[0] if first else b""
            for k, x in enumerate(ids):
                if x is None:
                    # a cut may have come in since, as the same document repeats it
                    ids[k] = self.known.get(cuts[k]) or self._learn(cuts[k])
            out.append(b"".join(ids))
        return out
