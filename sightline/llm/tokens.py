"""Token ids of whole texts by a ``tokenizers`` vocabulary file, word by word.

For a vocabulary whose normalizer and pre-tokenizer never join characters
across white space, the ids of a text are those of its words in order; a word
of letters and then signs is two units if the vocabulary's pattern always
splits them. Each distinct unit of a slice of text is encoded once. Ids of
units met before are kept for the next slices of the Python worker, in Arrow
and numpy arrays up to a fixed number of units; then those of the current
slice are kept and the others forgotten. Words, units and ids are found and
put together by Arrow and numpy kernels: only units that are new go through
Python.
``separable`` says from the file whether that holds; other vocabularies
encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

#: Units that a worker keeps; words of letters encoded in one call; bytes of
#: text taken at a time.
KEPT, JOINED, SLICE = 1 << 18, 200, 2 << 20

#: Letters and then only ASCII signs other than the apostrophe: no pattern of
#: the pre-tokenizer spans the two.
_STEM = r"^(?P<a>\p{L}+)(?P<b>[!-&(-/:-@\[-`{-~]+)$"
_LETTERS = r"^\p{L}+$"


def gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``code`` of the pool in a row, and their lengths."""
    n = size[code]
    before = np.cumsum(n) - n
    return pool[np.repeat(first[code] - before, n) + np.arange(int(n.sum()))], n


class WordTokenizer:
    """Ids of texts as a flat array and offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.path = path
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.words = separable(spec)
        self.lower = "Lowercase" in _types(spec["normalizer"], "normalizers")
        end = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        if end:
            for piece, i in self.tok.get_vocab(False).items():
                self.ends[i] = piece.endswith(end)
        # Pieces that end a word tell apart the words of a joined text.
        self.marked = bool(self.ends.any())
        self.split = self.words and splits_signs(spec)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.pool, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words of letters only, and how many each has. One piece run
        each, so a run ends at the piece with the end-of-word mark. Checked by
        their number; where it differs (letters that normalize to something
        else), word by word."""
        flat, size = [], []
        groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        for group, ids in zip(groups, self._whole([" ".join(g) for g in groups])):
            ids = np.array(ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group) and stops[-1] == len(ids):
                flat.append(ids)
                size.append(np.diff(stops, prepend=0))
            else:
                each, n = self._others(group)
                flat, size = flat + each, size + n
        return flat, size

    def _others(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        per = self._whole(words)
        return [np.array([i for ids in per for i in ids], np.uint32)], [np.fromiter(map(len, per), np.int64, len(per))]

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The stem and the signs of each word; words that are not of that
        kind are their own stem."""
        m = pc.extract_regex(words, _STEM)
        stem, signs = pc.struct_field(m, "a"), pc.struct_field(m, "b")
        plain = pc.string_is_ascii(words)
        odd = pc.and_(pc.is_valid(m), pc.invert(plain))
        if pc.any(odd).as_py():  # a mark that splits off would join the signs
            fine = np.ones(len(words), bool)
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            fine[at] = [normalize("NFC", x).lower().isalpha() for x in stem.take(pa.array(at)).to_pylist()]
            stem, signs = pc.if_else(pa.array(fine), stem, None), pc.if_else(pa.array(fine), signs, None)
        stem, signs = pc.coalesce(stem, words), pc.fill_null(signs, "")
        return (pc.if_else(plain, pc.ascii_lower(stem), stem) if self.lower else stem), signs

    def _codes(self, units: pa.Array) -> np.ndarray:
        """Places of distinct units in the kept arrays; new ones are encoded."""
        at = pc.index_in(units, value_set=self.known)
        fresh = pc.is_null(at)
        new = units.filter(fresh)
        if not len(new):
            return at.to_numpy()
        if len(self.known) + len(new) > KEPT:
            old = at.drop_null()
            self.known = self.known.take(old)
            self.pool, self.size = gather(self.pool, self.first, self.size, old.to_numpy())
            self.first = np.cumsum(self.size) - self.size
            at = pc.index_in(units, value_set=self.known)
        base = len(self.known)
        word = pc.match_substring_regex(new, _LETTERS) if self.marked else pa.array(np.zeros(len(new), bool))
        letters, others = new.filter(word), new.filter(pc.invert(word))
        ids, sizes = self._letters(letters.to_pylist())
        more, n = self._others(others.to_pylist())
        place = np.empty(len(new), np.int64)
        word = word.to_numpy(zero_copy_only=False)
        place[np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])] = np.arange(base, base + len(new))
        self.known = pa.concat_arrays([self.known, letters, others])
        self.pool = np.concatenate([self.pool, *ids, *more])
        self.size = np.concatenate([self.size, *sizes, *n])
        self.first = np.cumsum(self.size) - self.size
        out = at.fill_null(0).to_numpy().astype(np.int64)
        out[fresh.to_numpy(zero_copy_only=False)] = place
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids and n + 1 offsets for a large_string array, with
        ``end_id`` after each text if given."""
        ids, counts = [], []
        for i, j in slices(texts, SLICE):
            a, n = self._slice(texts.slice(i, j - i))
            if end_id is not None:
                a = np.insert(a, np.cumsum(n), end_id)
                n = n + 1
            ids.append(a)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return flat, np.concatenate([[0], np.cumsum(n)])

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            per = self._whole(texts.to_pylist())
            return np.array([i for ids in per for i in ids], np.uint32), np.array([len(p) for p in per], np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        vocab = words.dictionary
        if self.split:  # two units a word, the second often empty
            both = pa.concat_arrays(self._parts(vocab)).dictionary_encode()
            unit = np.asarray(both.indices, np.int64).reshape(2, -1).T.ravel()
            unit = self._codes(both.dictionary)[unit]
            pool, size = gather(self.pool, self.first, self.size, unit)
            size = size[0::2] + size[1::2]
        else:
            pool, size = gather(self.pool, self.first, self.size, self._codes(vocab))
        flat, n = gather(pool, np.cumsum(size) - size, size, np.asarray(words.indices, np.int64))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(np.asarray(split.value_lengths(), np.int64))]
        return flat, np.diff(np.concatenate([[0], ends]))


def _steps(part: dict | None, key: str) -> list[dict]:
    return part[key] if part and part["type"] == "Sequence" else [part] if part else []


def _types(part: dict | None, key: str) -> set[str]:
    return {s["type"] for s in _steps(part, key)}


def splits_signs(spec: dict) -> bool:
    """Whether the first split takes a run of letters and a run of signs
    after it apart: both are alternatives of their own."""
    kinds = _steps(spec["pre_tokenizer"], "pretokenizers")[0].get("pattern", {}).get("Regex", "").split("|")
    return {r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"} <= set(kinds)


def separable(spec: dict) -> bool:
    """Whether words can be encoded on their own: white space is dropped by
    the split, which keeps what its pattern matches and whose pattern matches
    no white space; no special token holds white space or takes it in."""
    norm, pre = _types(spec["normalizer"], "normalizers"), _steps(spec["pre_tokenizer"], "pretokenizers")
    tokens = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"])
                 for t in spec["added_tokens"])
    if not (pre and norm <= {"NFC", "Replace", "Lowercase"} and tokens):
        return False
    split = pre[0]
    pattern = split.get("pattern", {}).get("Regex", "")
    return (split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
            and r"[^\s" in pattern and r"\s+" not in pattern and " " not in pattern)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]
