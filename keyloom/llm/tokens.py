"""Fast exact encoding with the ``tokenizers`` library inside Spark tasks.

A byte-pair tokenizer works on stretches of text one by one, and prose repeats its words: a
stretch is encoded once by the library and looked up after that.  Where a text may be cut
follows from the tokenizer's own pre-tokenizer; a tokenizer of another kind, and a text where
the cut would not be certain, is encoded whole.  The result always equals encoding the whole
text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARK = "!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~"
TWO_SPACES = re.compile(f"[{_SPACE}][{_SPACE}]")
#: Letters of one word, then marks: a tokenizer of either kind never joins the two.
WORD_AND_MARKS = re.compile(f"([{_LETTER}]+)([{_MARK}]*)")
MARKS = re.sub(r"\\(.)", r"\1", _MARK)
#: Entries of each generation of a lookup; the older of two goes when the newer is full.
REMEMBERED = 350_000
LONGEST = 48
#: Characters of the texts that are split and looked up at once.
CHARACTERS = 1 << 22


def _kind(spec: dict) -> str | None:
    """``spaced``: a blank clings to the next word; ``words``: white space is dropped; None: unknown."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "spaced"
    first = (pre.get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "[^\\s\\p{L}\\p{N}]+" in first["pattern"].get("Regex", "")
    plain = {n["type"] for n in norm.get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}
    return "words" if drops and plain and spec["model"].get("end_of_word_suffix") == "</w>" else None


class _Lookup:
    """Ids of pieces, each encoded as ``lead + piece``."""

    def __init__(self, owner: Encoder, lead: str):
        self.owner, self.lead = owner, lead
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def turn(self, coming: int) -> bool:
        """Begin a new generation of pieces if so many more would not fit."""
        if len(self.pieces) + coming <= self.owner.room:
            return False
        self.old_pieces, self.pieces = self.pieces, {}
        return True

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Add pieces that are not known; long ones are returned, not remembered."""
        known, words, marks = self.pieces, self.words, self.owner.marks
        if self.old_pieces:
            old = self.old_pieces
            back = {p: old[p] for p in pieces if p in old}
            known.update(back)
            pieces = [p for p in pieces if p not in back]
        if len(words) + len(pieces) > self.owner.room:
            self.old_words, self.words = words, {}
            words = self.words
        plain, split, odd, new = [], [], [], set()
        match, old = WORD_AND_MARKS.fullmatch, self.old_words
        for p in pieces:
            if len(p) > LONGEST:
                odd.append(p)
                continue
            word = p.rstrip(MARKS)
            if not (word.isalpha() and word.isascii() or match(word)):
                odd.append(p)
                continue
            if len(word) == len(p):
                plain.append(p)
            else:
                split.append((p, word, p[len(word) :]))
            if word not in words:
                if word in old:
                    words[word] = old[word]
                else:
                    new.add(word)
        words.update(self.owner.encode_words(list(new), self.lead))
        known.update(zip(plain, map(words.__getitem__, plain)))
        for p, word, mark in split:
            if mark not in marks:
                if len(marks) > self.owner.room:
                    marks.clear()
                    marks[""] = b""
                marks[mark] = self.owner.whole(mark)
            known[p] = words[word] + marks[mark]
        own = {}
        for p, ids in zip(odd, self.owner.batch([self.lead + p for p in odd])):
            (self.pieces if len(p) <= LONGEST else own)[p] = ids
        return own


class Encoder:
    """Token ids of texts as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str, remembered: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.remembered = remembered
        self.marks: dict[str, bytes] = {"": b""}
        self.bare, self.spaced = _Lookup(self, ""), _Lookup(self, " ")
        self.border = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.startswith("Ġ") if self.kind == "spaced" else token.endswith("</w>")
        self.line = self.whole("\n") if self.kind == "spaced" else b""

    @property
    def room(self) -> int:
        """Entries of each generation of a lookup."""
        return REMEMBERED if self.remembered is None else self.remembered

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str], lead: str) -> dict[str, bytes]:
        """Ids of single words of letters, many in one call: word borders show in the ids."""
        out = {}
        if lead or self.kind == "words":
            groups = [words[i : i + 500] for i in range(0, len(words), 500)]
            joined = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
            for group, got in zip(groups, joined):
                ids = np.array(got.ids, np.uint32)
                cuts = np.flatnonzero(self.border[ids]) + (self.kind == "words")
                cuts = np.append(cuts, len(ids)) if self.kind == "spaced" else np.insert(cuts, 0, 0)
                if len(cuts) == len(group) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                    raw = ids.tobytes()
                    at = (cuts * 4).tolist()
                    out.update(zip(group, [raw[a:b] for a, b in zip(at[:-1], at[1:])]))
        rest = [w for w in words if w not in out]
        out.update(zip(rest, self.batch([lead + w for w in rest])))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text; a null text has none."""
        out, some, held = [], [], 0
        for text in texts:
            if some and held + len(text or "") > CHARACTERS:
                out += self._some(some)
                some, held = [], 0
            some.append(text)
            held += len(text or "")
        return out + self._some(some)

    def _some(self, texts: list[str | None]) -> list[np.ndarray]:
        cut, uncut = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            doubt = TWO_SPACES.search(text) if self.kind == "spaced" else "\u0130" in text  # the one letter that grows in lower case
            (uncut if self.kind is None or doubt or any(s in text for s in self.special) else cut).append(i)
        out = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(uncut, self.batch([texts[i] for i in uncut])):
            out[i] = np.frombuffer(ids, np.uint32)
        if cut:
            for i, ids in zip(cut, self._looked_up([texts[i] for i in cut])):
                out[i] = ids
        return out

    def _looked_up(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that may be cut: pieces are numbered by Arrow, and their ids gathered by those numbers."""
        column = pa.array(texts, pa.string())
        if self.kind == "words":
            lines, line_at = pc.replace_substring(column, "\n", " "), np.arange(len(texts) + 1)
        else:
            split = pc.split_pattern(column, "\n")
            lines, line_at = split.flatten(), split.offsets.to_numpy()
        split = pc.split_pattern(lines, " ")
        at, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "words":
            blobs = self._ids(self.spaced, names)
        else:  # three forms of a piece: after a blank, first of a text, first of a later line
            code[at[:-1]] += 2 * len(names)
            code[at[line_at[:-1]]] -= len(names)
            used = np.zeros(3 * len(names), bool)
            used[code] = True
            code = (np.cumsum(used) - 1)[code]
            inner, first, later = ([names[i] for i in np.flatnonzero(u).tolist()] for u in np.split(used, 3))
            blobs = self._ids(self.spaced, inner) + self._ids(self.bare, first) + [self.line + ids for ids in self._ids(self.bare, later)]
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        start, lengths = np.cumsum(size) - size, size[code]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        ids = np.frombuffer(b"".join(blobs), np.uint32)[np.repeat(start[code] - ends[:-1], lengths) + np.arange(ends[-1])]
        return np.split(ids, ends[at[line_at]][1:-1])

    @staticmethod
    def _ids(lookup: _Lookup, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        found = list(map(lookup.pieces.get, pieces))
        missing = [p for p, ids in zip(pieces, found) if ids is None]
        if not missing:
            return found
        if lookup.turn(len(missing)):
            missing = pieces
        own = lookup.learn(missing)
        known = lookup.pieces
        new = iter([own[p] if p in own else known[p] for p in missing])
        return list(new) if missing is pieces else [next(new) if ids is None else ids for ids in found]


@lru_cache(maxsize=4)
def encoder(path: str, remembered: int | None = None) -> Encoder:
    """One encoder per worker process, file and size of its lookups; smaller ones give the same ids, more slowly."""
    return Encoder(path, remembered)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
