"""Encoding word by word, for vocabularies whose files prove that no token reaches over white space."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from unicodedata import is_normalized

import numpy as np

WHITE = frozenset(" \t\n\x0b\x0c\r")
#: Bytes of words whose ids a worker remembers, twice at most.
REMEMBERED = 100_000_000
#: New words of letters that are encoded in one text.
AT_ONCE = 200
#: A splitting pattern that keeps letters and what is neither letter nor digit apart, looking at single
#: characters, and ASCII characters of the latter kind that no contraction begins with and no added token holds.
APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = b'.,;:!?&#*$%()[]{}"-_=+/\\@~^`'


#: What a vocabulary file calls the steps that look at no more than a word, and those that cut at white space.
_WORDWISE = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "BertNormalizer"}
_CUTTING = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def _within_words(step: dict) -> bool:
    """Whether a normaliser changes words by themselves; runs of white space may become other white space."""
    if step["type"] != "Replace":
        return step["type"] in _WORDWISE
    return step["pattern"].get("Regex") in (r"\s", r"\s+") and bool(step["content"]) and set(step["content"]) <= WHITE


def _cuts(step: dict) -> bool:
    """Whether a splitter cuts at white space and drops it: by its kind, or as it keeps nothing but matches of a pattern
    that has no look-around and can't match white space, by the classes in it."""
    if step["type"] != "Split":
        return step["type"] in _CUTTING
    pattern = step["pattern"].get("Regex", " ")
    rest = re.sub(r"\[\^\\s[^\]]*\]", "", pattern)
    return step["behavior"] == "Removed" and step["invert"] and not re.search(r"\s|\.|\^|\$|\(\?|\\(?!p\{[LNMPS])", rest)


def splits_at_space(vocabulary: str) -> bool:
    """Whether a text's tokens are those of its words between ASCII white space, one after the other, by what the file
    says: all normalisers work within words, the first splitter cuts at white space and drops it, and no added token
    holds white space or takes any that stands beside it."""
    read = json.loads(vocabulary)
    normalisers, splitters = _steps(read.get("normalizer"), "normalizers"), _steps(read.get("pre_tokenizer"), "pretokenizers")
    added = read.get("added_tokens") or []
    return all(map(_within_words, normalisers)) and bool(splitters) and _cuts(splitters[0]) and not any(t.get("lstrip") or t.get("rstrip") or WHITE & set(t["content"]) for t in added)


class Encoder:
    """vocabulary: the text of a tokenizers file. Where its tokens are those of its words one after the other, words
    are encoded once and remembered up to a bound. Where its file also says so, words are told apart in lower case
    alone, but in texts that hold an added token in whatever case, a new word's punctuation is encoded by itself, and new words
    of letters are encoded many to a text."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = splits_at_space(vocabulary)
        read = json.loads(vocabulary)
        self.added = [t["content"].lower().encode() for t in read.get("added_tokens") or []]
        steps = _steps(read.get("normalizer"), "normalizers")
        self.lowers = any(s["type"] == "Lowercase" for s in steps)
        splits = _steps(read.get("pre_tokenizer"), "pretokenizers")
        self.apart = bool(splits) and splits[0].get("pattern", {}).get("Regex") == APART and not any(set(a) & set(TAIL) for a in self.added)
        self.kind = id_type(vocabulary)
        self.ends = self._ends(read["model"])
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.kind == "<u2" else "I"
        found = [array(code, e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for ids in found:
                ids.byteswap()
        return [ids.tobytes() for ids in found]

    def _ends(self, model: dict) -> np.ndarray | None:
        """Which ids end a run of letters; None where the file doesn't prove that each run has one such id, its last."""
        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
        if not (self.apart and suffix and model.get("type") == "BPE" and not model.get("dropout")):
            return None
        if sum(len(t) == len(suffix) + 1 and t.endswith(suffix) for t in vocab) < 256:
            return None  # a byte that has no id at a word's end could end a word without one
        ends = np.zeros(1 << 16 if self.kind == "<u2" else max(vocab.values()) + 1, bool)
        ends[[k for t, k in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words. Words of letters alone are encoded AT_ONCE in a text and told apart by the ids that end them."""
        texts = [w.decode() for w in words]
        if self.ends is None:
            return dict(zip(words, self._ids(texts), strict=True))
        letters = [t.isalpha() and is_normalized("NFC", t) for t in texts]
        alone, found = [w for w, x in zip(words, letters) if not x], {}
        runs, own = [t for t, x in zip(texts, letters) if x], [w for w, x in zip(words, letters) if x]
        size = np.dtype(self.kind).itemsize
        for k, raw in zip(range(0, len(runs), AT_ONCE), self._ids([" ".join(runs[k : k + AT_ONCE]) for k in range(0, len(runs), AT_ONCE)])):
            part = own[k : k + AT_ONCE]
            cuts = (size * (np.flatnonzero(self.ends[np.frombuffer(raw, self.kind)]) + 1)).tolist()
            if len(cuts) == len(part):
                found.update((w, raw[a:b]) for w, a, b in zip(part, [0, *cuts], cuts))
            else:  # a letter that isn't one in lower case
                alone += part
        found.update(zip(alone, self._ids([w.decode() for w in alone]), strict=True))
        return found

    def _words(self, text: bytes) -> list[bytes]:
        low = text.lower() if self.lowers else text  # ASCII alone; the vocabulary lowers the rest
        return (text if self.lowers and any(a in low for a in self.added) else low).split()

    def _parts(self, word: bytes) -> tuple[bytes, bytes] | None:
        """A word that ends in punctuation as what comes before it and the punctuation."""
        stem = word.rstrip(TAIL) if self.apart else word
        return (stem, word[len(stem) :]) if stem != word and stem[-1:].isalnum() else None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self._ids([t.decode() for t in texts])
        return [b"".join(own) for own in self.by_word(texts)]

    def by_word(self, texts: list[bytes]) -> list[list[bytes]]:
        """For each text the ids of each of its words."""
        if self.held > REMEMBERED:  # words that don't come again until the next time are forgotten
            self.before, self.known, self.held = self.known, {}, 0
        known, split = self.known, [self._words(t) for t in texts]
        found = [list(map(known.get, words)) for words in split]
        holes = [_holes(own) for own in found]
        missing = {words[k] for words, at in zip(split, holes) for k in at}
        again = missing & self.before.keys()
        known.update((w, self.before[w]) for w in again)
        cut = {w: p for w in missing - again if (p := self._parts(w))}
        new = list({x for w in missing - again for x in cut.get(w, (w,)) if x not in known})
        known.update(self._new(new))
        known.update((w, known[stem] + known[tail]) for w, (stem, tail) in cut.items())
        for kept in (missing, new):  # a word has no more ids than bytes
            self.held += 3 * sum(map(len, kept)) + 160 * len(kept)
        for words, own, at in zip(split, found, holes):
            for k in at:
                own[k] = known[words[k]]
        return found


def _holes(found: list) -> list[int]:
    """Where a list holds None."""
    out, k = [], -1
    try:
        while True:
            k = found.index(None, k + 1)
            out.append(k)
    except ValueError:
        return out


def id_type(vocabulary: str) -> str:
    read = json.loads(vocabulary)
    ids = [*read["model"]["vocab"].values(), *(t["id"] for t in read.get("added_tokens") or [])]
    return "<u2" if max(ids, default=0) < 1 << 16 else "<u4"
