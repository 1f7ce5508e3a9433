"""Token ids of whole texts, in blocks, with a public tokenizer.

The ids are those the tokenizers library gives for the whole text. Byte-level pre-tokenization always
starts a new piece at a space or a lone line feed before a character that isn't white space, so a text may be cut there,
and each distinct word is encoded once per cache. The cache is emptied when it is full. A text that holds
one of the tokenizer's added tokens is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from grantlens.llm.common import row_blocks, utf8

#: The id that ends each document.
END = 0
#: Distinct words, and characters in them, that a worker remembers.
CACHE_WORDS, CACHE_CHARS = 500_000, 8_000_000
#: Bytes of text that are encoded together, and new words that go to the tokenizer in one string.
ENCODE_BYTES, JOINED_WORDS = 4 << 20, 500

_SPACE = "\u0120"
#: How byte-level models spell the bytes that aren't printable: by the characters from 256 on, in order.
_SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
_SPELLED = np.array([_SPELLING.get(b, b) for b in range(256)], "<u4")
_CUT = re.compile(r" (?=\S)")
_MARKS = ".,;:!?"
#: The letters up to U+00FF, with or without a mark after them.
_LATIN = f"^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+[{_MARKS}]?$"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes with one tokenizer file. `cuts` says that texts may be cut before a space and a non-space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        given = self.tokenizer.pre_tokenizer
        pre = json.loads(given.__getstate__()) if given else {}
        self.cuts = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and self.tokenizer.normalizer is None and isinstance(self.tokenizer.model, BPE)
        if self.cuts:
            # The same model for strings of words in the spelling of bytes, each one with its space.
            self.joined = Tokenizer(self.tokenizer.model)
            self.joined.pre_tokenizer = Split(_SPACE, "merged_with_next")
            self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith(_SPACE) for i in range(self.tokenizer.get_vocab_size())])
            self.marks = np.full(256, -1, np.int64)
            for m in _MARKS:
                self.marks[ord(m)], = self.tokenizer.encode(m, add_special_tokens=False).ids
        self._empty()

    def _empty(self) -> None:
        self.words: dict[str, int] = {}
        self.chars, self.n, self.used = 0, 0, 0
        self.starts, self.lengths, self.seen = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)

    def _forget(self) -> None:
        """Keep the words that were met in several blocks, at most half of the cache."""
        seen, old, least = self.seen[:self.n], self.words, 2
        while int((seen >= least).sum()) > CACHE_WORDS // 2:
            least *= 2
        words = [w for w, i in old.items() if seen[i] >= least]
        if sum(map(len, words)) > CACHE_CHARS // 2:
            words = []
        ids = [self.flat[self.starts[i]:self.starts[i] + self.lengths[i]] for i in map(old.__getitem__, words)]
        self._empty()
        if words:
            self._put(words, np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(words), self.used + len(ids)
        if n > len(self.starts):
            self.starts, self.lengths, self.seen = (np.concatenate([x, np.zeros(n - len(x) // 2, np.int32)]) for x in (self.starts, self.lengths, self.seen))
        if used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(used, np.uint32)])
        self.flat[self.used:used] = ids
        self.lengths[self.n:n] = lengths
        self.starts[self.n:n] = self.used + np.cumsum(lengths) - lengths
        self.words.update(zip(words, range(self.n, n)))
        self.n, self.used, self.chars = n, used, self.chars + sum(map(len, words))

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of Latin words that follow a space each: many go to the model in one string, which is cut at the
        spaces again, and only an id that begins with a space begins a word. A mark behind letters is a piece of its own."""
        data, at = utf8(words)
        marks = self.marks[data[at[1:] - 1]]
        data, at = utf8(pc.utf8_rtrim(words, _MARKS))
        spelled = _SPELLED[np.insert(data[at[0]:at[-1]], at[:-1] - at[0], 32)]
        cuts = [*(at[:-1] - at[0] + np.arange(len(words)))[::JOINED_WORDS].tolist(), len(spelled)]
        strings = [spelled[a:b].tobytes().decode("utf-32-le") for a, b in zip(cuts, cuts[1:])]
        # One string at a time: the tokenizer's own results take a hundred bytes an id.
        ids = np.concatenate([np.array(self.joined.encode_batch_fast([x], add_special_tokens=False)[0].ids, np.uint32) for x in strings])
        starts = np.flatnonzero(self.begins[ids])
        ends, marked = np.append(starts[1:], len(ids)), marks >= 0
        return np.insert(ids, ends[marked], marks[marked].astype(np.uint32)), ends - starts + marked

    def _add(self, words: list[str]) -> None:
        """Encode words. Keys with a leading space are heads of texts, those with a line feed begin with it, the others follow a space.

        Latin letters, with or without one mark after them, go straight to the tokenizer's model, as its
        pre-tokenizer would hand them over; all else goes through the whole tokenizer.
        """
        array = pa.array(words, pa.string())
        latin = pc.match_substring_regex(array, _LATIN)
        rest = array.filter(pc.invert(latin)).to_pylist()
        if len(rest) < len(words):
            plain = array.filter(latin)
            self._put(plain.to_numpy(zero_copy_only=False).tolist(), *self._spaced(plain))
        if rest:
            forms = [w[1:] if w[0] == " " else w if w[0] == "\n" else " " + w for w in rest]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(forms, add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self._put(rest, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def _places(self, keys: list[str]) -> np.ndarray:
        """Places of keys in the cache, where they are put if they aren't there."""
        at = np.fromiter(map(self.words.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            missing = list(dict.fromkeys(map(keys.__getitem__, unknown)))
            self._add(missing)
            at[unknown] = np.fromiter(map(self.words.__getitem__, map(keys.__getitem__, unknown)), np.int64, len(unknown))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each one followed by END; null is empty."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        texts = texts.fill_null("")
        whole = np.ones(n, bool) if not self.cuts else np.zeros(n, bool)
        for token in self.added if self.cuts else ():
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._by_words(texts)
        which = np.flatnonzero(whole)
        rows = [np.array([*e.ids, END], np.uint32) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(which)).to_pylist(), add_special_tokens=False)]
        if len(which) < n:
            ids, at = self._by_words(texts.filter(pa.array(~whole)))
            rows += np.split(ids, at[1:-1])
        order = np.argsort(np.concatenate([which, np.flatnonzero(~whole)]))
        rows = [rows[i] for i in order.tolist()]
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() for texts without nulls and added tokens, of which there is at least one."""
        n = len(texts)
        if self.n > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        first = np.asarray(split.offsets)
        coded = split.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
        first = first - first[0]
        which, pieces = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = first[:-1]
        inner = np.ones(len(which), bool)
        inner[heads] = False
        used = np.flatnonzero(np.bincount(which[inner], minlength=len(pieces)))
        # Pieces that are empty or hold white space alone at their head don't stand at a cut; their texts are cut by the pattern.
        odd = [i for i in used.tolist() if not (w := pieces[i]) or w[0].isspace() and (w[0] != "\n" or w == "\n" or w[1].isspace())]
        others: dict[int, list[str]] = {}
        if odd:
            used = np.setdiff1d(used, odd)
            spots = np.flatnonzero(np.isin(which, odd) & inner)
            for row in np.unique(np.searchsorted(first, spots, side="right") - 1).tolist():
                cut = _CUT.split(texts[row].as_py())
                others[row] = [" " + cut[0], *cut[1:]]
        keys = [pieces[i] for i in used.tolist()] + [" " + pieces[i] for i in which[heads].tolist()] + list(chain.from_iterable(others.values()))
        places = self._places(keys)
        table = np.zeros(len(pieces), np.int64)
        table[used] = places[:len(used)]
        at = table[which]
        at[heads] = places[len(used):len(used) + n]
        last = first[1:]
        if others:
            parts, k = np.split(at, first[1:-1]), len(used) + n
            for row, cut in others.items():
                parts[row] = places[k:k + len(cut)]
                k += len(cut)
            at, last = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        self.seen[at] += 1
        # One more entry per text, for its end.
        starts, sizes = np.insert(self.starts[at], last, -1), np.insert(self.lengths[at], last, 1)
        ends = np.cumsum(sizes)
        # Places in the cache and in a block of texts fit into 32 bits.
        narrow = np.int32 if ends[-1] < 1 << 31 else np.int64
        where = np.repeat((starts - (ends - sizes)).astype(narrow), sizes)
        where += np.arange(len(where), dtype=narrow)
        closing = ends[last + np.arange(n)] - 1
        where[closing] = 0
        ids = self.flat[where]
        ids[closing] = END
        return ids, np.concatenate([[0], closing + 1])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, ids, offsets) for blocks of rows; null is empty."""
    _, at = utf8(column)
    own = encoder(path)
    for a, b in row_blocks(np.diff(at.astype(np.int64)), ENCODE_BYTES):
        yield a, b, *own.encode(column.slice(a, b - a))
