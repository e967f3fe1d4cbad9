"""Token ids of whole texts by a public tokenizer file, fast where the tokenizer drops white space."""

from __future__ import annotations

import re
import sys
import types

import numpy as np

# Words kept per worker process; beyond that the memory starts anew. About 60 MB.
REMEMBERED = 300_000
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # letters whose lower case is one letter
# An apostrophe may begin a word ending, so it is never cut off.
MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]
SURE_SPACE = re.compile("[ \t\n\r\f\v]+")


class WordEncoder:
    """Encodes texts word by word if the tokenizer drops white space, so that each distinct word is encoded once. Words of letters,
    digits and runs of marks are cut apart where the tokenizer does so too."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = not self._ids("  \n\t") and self._ids("ab cd.") == self._ids("ab") + self._ids("CD") + self._ids(".")
        self.known: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.uneven, self.marked, self.pieces = self._classes()
        self.last = None
        if self.by_word and suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_word:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        known, words, even, odd = self.known, [], set(), set()
        if len(known) > REMEMBERED:
            known.clear()
        for text in texts:
            own: list[str] = []
            for part in [text] if not self.uneven(text) else text.split("\n"):
                small = part.lower()
                marked = self.marked(small)
                # A control token that is written out in a text is one token, so it must not be cut.
                if self.uneven(part) or marked and any(token in part or token in small for token in self.added):
                    some = SURE_SPACE.split(part)
                    odd.update(some)
                else:
                    # Case is dropped, and marks and digits are words of their own: fewer distinct words.
                    some = self.pieces(small) if marked else small.replace(".", " . ").replace(",", " , ").split()
                    even.update(some)
                own += some
            words.append(own)
        self._learn_even([*even.difference(known)])
        self._learn([*odd.difference(known)])
        return [b"".join(map(known.__getitem__, own)) for own in words]

    def _classes(self):
        """Searches for characters that no rule here covers, for marks and digits besides single full stops and commas, and a function
        that cuts a part into letters, single digits and runs of marks. A mark belongs to the rule only if this tokenizer cuts
        around it."""
        def cuts(mark: str) -> bool:
            between = lambda left, right: self._ids(left + mark * 2 + right) == self._ids(left) + self._ids(mark * 2) + self._ids(right)
            return between("ab", "cd") and between("1", "2")

        marks = re.escape("".join(m for m in MARKS if self.by_word and cuts(m)))
        digits = "0-9" if self.by_word and self._ids("ab12cd") == self._ids("ab") + self._ids("1") + self._ids("2") + self._ids("cd") else ""
        simple = re.compile(f"[{digits}{re.escape(''.join(m for m in MARKS if m not in '.,'))}]").search
        pieces = re.compile(f"[{LETTERS}]+|[0-9]|[{marks}]+").findall if marks else str.split

        def marked(part: str) -> bool:
            return bool(simple(part) or ".." in part or ",," in part or ".," in part or ",." in part)

        return re.compile(f"[^{LETTERS}{marks}{digits} \n]").search, marked, pieces

    def _learn_even(self, words: list[str], together: int = 1000) -> None:
        """Words of letters, and marks: each ends with the only token in it that can end a word."""
        if self.last is None:
            return self._learn(words)
        for at in range(0, len(words), together):
            some = words[at : at + together]
            # Without offsets, which this rule needs not.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            data, begin = ids.tobytes(), 0
            for word, cut in zip(some, cuts, strict=True):
                self.known[word] = data[begin:cut]
                begin = cut

    def _learn(self, words: list[str], together: int = 1000) -> None:
        for at in range(0, len(words), together):
            some = words[at : at + together]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in some])
            places = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded.ids))
            cuts = np.searchsorted(places, ends).tolist()
            data, begin = np.array(encoded.ids, "<u4").tobytes(), 0
            for word, cut in zip(some, cuts):
                self.known[word] = data[4 * begin : 4 * cut]
                begin = cut


def kept_encoder(path: str, kind: type):
    """The encoder ``kind(path)`` of this worker process: loaded once, with what it has seen in earlier tasks."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    name = f"{kind.__name__} {path}"
    if name not in kept.__dict__:
        kept.__dict__[name] = kind(path)
    return kept.__dict__[name]


def encoder(path: str) -> WordEncoder:
    return kept_encoder(path, WordEncoder)


def forget_encoders() -> None:
    """Free what ``kept_encoder`` keeps: a worker process that turns to other work needs the memory for it."""
    sys.modules.pop("_kept_encoders", None)
