"""Encoding with the tokenizers library, one white-space word at a time behind a bounded cache.

Both vocabularies cut texts before single white space and around closing commas and full stops, so a
text cut there has the ids of its parts.  Texts with other white space (runs of it, white space at the
ends, control separators) go through the library whole.

Texts are cut and their words numbered by Arrow; only distinct words are looked up, and the ids of the
texts are gathered from the words' ids by number.  A word of Latin letters is a single piece of text to
the library's cutting patterns, so it goes to the library's BPE model without them.
"""

from __future__ import annotations

import codecs
import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import claim

#: Texts that go through the library whole: white space at the ends or in runs, odd kinds of it, the
#: separator used below, letters that don't lower-case alone, and empty texts.
_WHOLE = r"  |\n\n| \n|\n |\A[ \n]|[ \n]\z|\A\z|[\x01\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{130}\x{3a3}\x{1680}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Words of letters that are composed and that every Unicode version knows as letters.
_letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
#: Words of a generation: those of the one before are looked up there before they are forgotten.
_CACHE_WORDS, _WORD_CHARS, _JOIN = 420_000, 48, 4_000
_encoders: dict[str, "Encoder"] = {}


def _spelling() -> str:
    """The character that stands for each byte in byte-level vocabularies; the line end stands for itself here."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    table = [chr(b if b in visible else next(hidden)) for b in range(256)]
    table[10] = "\n"
    return "".join(table)


_SPELLING = _spelling()
_END_OF_LINE = "\u010a"  # how a line end is spelled


def token_path(name: str) -> str:
    """The place of a public tokenizer file; anything with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.thresholds = gc.get_threshold()
        gc.set_threshold(1_000_000, 20, 100)  # the words of a batch are many and hold no cycles
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(token_path(path))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[str, bytes] = {}  # words as they follow a blank, with what stands at their end
        self.old: dict[str, bytes] = {}
        self.words = _CACHE_WORDS
        self.bare: dict[str, bytes] = {}  # words after a line end or at the start
        # A separator that the vocabulary gives one id of its own between words: a line end where white
        # space has ids, else a control character between blanks.
        end = self.ids(["a\n b"])[0]
        self.between = "\n" if len(end) == 12 else " \x01 "
        self.mark = int(np.frombuffer(end, "<u4")[1]) if self.between == "\n" else int(np.frombuffer(self.ids(["\x01"])[0], "<u4")[0])
        self.lower = self.between != "\n" and self.ids(["A"]) == self.ids(["a"])
        self.model = Tokenizer(self.tokenizer.model)  # without the patterns that cut texts
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.close = dict(zip(",.", self.ids([",", "."])))
        self.line = np.array([self.mark] if self.between == "\n" else [], "<u4").tobytes()
        probe = ["a", "the", "zürich", "straße", "œuvre", "éèàçñ", "ŝipo", "ſtadt", "internationalisation"]
        self.direct = all(self._direct(probe, blank) == self.ids([blank + w for w in probe]) for blank in ("", " "))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _cut(ids: np.ndarray, mark: int, n: int) -> list[bytes] | None:
        """ids of n words between marks; None if there are not as many marks as that."""
        ends = np.flatnonzero(ids == mark)
        if len(ends) != n - 1:
            return None
        data, starts, ends = ids.tobytes(), (np.append(0, ends + 1) * 4).tolist(), (np.append(ends, len(ids)) * 4).tolist()
        return list(map(data.__getitem__, map(slice, starts, ends)))

    def _direct(self, words: list[str], blank: str) -> list[bytes] | None:
        """ids of words of letters, spelled as the vocabulary spells bytes, by the model alone."""
        between = f"\n{_END_OF_LINE}\n" + (_SPELLING[32] if blank and self.line else "")
        spelled = codecs.charmap_decode("\n".join(words).encode(), "strict", _SPELLING)[0].replace("\n", between)
        ids = np.array(self.model.encode_batch_fast([between[1:] + spelled], add_special_tokens=False)[0].ids, "<u4")
        return self._cut(ids[1:], ids[0], len(words)) if len(ids) else None

    def _learn(self, words: list[str], into: dict[str, bytes], blank: str) -> None:
        """ids of words, many to a call of the library."""
        hard = [] if self.direct else words
        if self.direct:
            easy = []
            for w in words:
                (easy if _letters(w) else hard).append(w)
            for k in range(0, len(easy), _JOIN):
                some = easy[k : k + _JOIN]
                if (found := self._direct(some, blank)) is None:
                    hard += some
                else:
                    into.update(zip(some, found))
        for k in range(0, len(hard), _JOIN):
            some = hard[k : k + _JOIN]
            ids = np.array(self.tokenizer.encode_batch_fast([blank + (self.between + blank).join(some)], add_special_tokens=False)[0].ids, "<u4")
            found = self._cut(ids, self.mark, len(some))
            into.update(zip(some, self.ids([blank + w for w in some]) if found is None else found))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """For each text its ids; a null text has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = pc.fill_null(pc.match_substring_regex(texts, _WHOLE), True)
        rest = iter(self.ids([t or "" for t in texts.filter(whole).to_pylist()]))
        plain = iter(self._gather(texts.filter(pc.invert(whole))))
        return [next(rest if w else plain) for w in whole.to_pylist()]

    def _gather(self, texts: pa.Array) -> list[bytes]:
        """ids of texts that are words between single blanks or line ends."""
        if not len(texts):
            return []
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.line else " "), " ")
        numbered = lists.flatten().dictionary_encode()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        codes, words = np.array(numbered.indices), numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        del lists, numbered
        if self.lower:
            words = [w.lower() for w in words]
        first, own = np.unique(codes[bounds[:-1]], return_inverse=True)
        codes[bounds[:-1]] = len(words) + own  # words that start a text follow no blank
        used = np.zeros(len(words) + len(first), bool)
        used[codes] = True
        units = self._units([w if u else None for w, u in zip(words, used.tolist())], [words[k] for k in first.tolist()])
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        ids = np.frombuffer(b"".join(units), "<u4")
        sizes_here = sizes[codes]
        ends = np.append(0, np.cumsum(sizes_here))
        shift = (np.cumsum(sizes) - sizes)[codes] - ends[:-1]
        data = memoryview(ids[np.repeat(shift, sizes_here) + np.arange(ends[-1])].tobytes())
        edges = (ends[bounds] * 4).tolist()
        return [bytes(data[a:b]) for a, b in zip(edges, edges[1:])]

    def _units(self, words: list[str | None], firsts: list[str]) -> list[bytes]:
        """ids of words as they follow a blank or, with it, a line end (none for None), then those of words that start a text."""
        if len(self.known) > self.words:
            self.old, self.known = self.known, {}
        if len(self.bare) > self.words:
            self.bare.clear()
        known, old, bare, new, lined = self.known, self.old, self.bare, [], []
        for w in words:
            if w is not None and w not in known:
                if (there := old.get(w)) is not None:
                    known[w] = there
                else:
                    (lined if w[0] == "\n" else new).append(w)
        starts = {w for w in [*[w[1:] for w in lined], *firsts] if w not in bare}
        added = (self._add(dict.fromkeys(new), known, " "), self._add(starts, bare, ""))
        for w in lined:
            known[w] = self.line + bare[w[1:]]
        out = [b"" if w is None else known[w] for w in words]
        out += [bare[w] for w in firsts]
        for some, there in ((added[0] + lined, known), (added[1], bare)):
            for w in some:
                if len(w) > _WORD_CHARS:
                    there.pop(w, None)
        return out

    def _add(self, words, into: dict[str, bytes], blank: str) -> list[str]:
        """Learn words, those with a comma or full stop that closes them from what stands before it; returns what was learned."""
        ended = [w for w in words if w[-1] in ",." and len(w) > 1 and w[-2].isalpha()]
        plain = list(set(words).difference(ended).union(w for w in [x[:-1] for x in ended] if w not in into))
        self._learn(plain, into, blank)
        for w in ended:
            into[w] = into[w[:-1]] + self.close[w[-1]]
        return plain + ended


def _forget(path: str) -> None:
    if there := _encoders.pop(path, None):
        gc.set_threshold(*there.thresholds)  # the worker goes on to other operators


def encoder(path: str, words: int = _CACHE_WORDS) -> Encoder:
    """One encoder for each Python worker and vocabulary; it keeps so many words in a generation."""
    claim(f"encoder {path}", lambda: _forget(path))
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].words = words
    return _encoders[path]
