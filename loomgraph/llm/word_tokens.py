"""Ids of the public word-end BPE, by the tokenizers library with a cache of word parts held in arrays."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer, normalizers, pre_tokenizers  # noqa: E402

from loomgraph.llm.words import BASE, BASE_INVERSE, FOLD, Words, mix, powers, slices, texts_of  # noqa: E402

MODEL_FILE = "word_bpe_49k.json"
END_ID = 1
CACHE_PARTS = 400_000
JOINED_PARTS = 200
RUN_BYTES = 1 << 20
WORD_END = "</w>"
SECOND = 0xC2B2AE3D27D4EB4F
SECOND_INVERSE = pow(SECOND, -1, 1 << 64)
# Letters of Latin-1 in UTF-8: ASCII ones, and 0xC3 with a byte of LATIN behind it; SIGNS are ASCII signs but the apostrophe.
LETTER, LATIN, SIGNS = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
SIGNS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True


class WordTokenizer:
    """Encodes texts to little-endian unsigned 32-bit ids in bytes, as the library does with add_special_tokens=False.

    The model drops white space and no pre-token crosses it, so a text's ids are those of its words one after
    another. A Latin-1 word with signs behind it is two pre-tokens, of which the normaliser only lower-cases the
    first; any other word goes to the library as it is. Each distinct part (told by two 64-bit hashes) is encoded
    once while it stays in the cache. Names of special tokens that stand in a text become those tokens' ids, which is
    the library's own reading.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, "<u4")
        self.clock = 0

    def _pre_tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pre-tokens and how many each has, many in one call; each ends with its only word-end token."""
        lines = ["\n".join(parts[i : i + JOINED_PARTS]) for i in range(0, len(parts), JOINED_PARTS)]
        ids = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            each = [e.ids for e in self.bare.encode_batch_fast(parts, add_special_tokens=False)]
            return np.array([i for e in each for i in e], "<u4"), np.array([len(e) for e in each], np.int64)
        return ids, np.diff(ends, prepend=0)

    def _trim(self) -> None:
        """Keep the half of the cache that was used last."""
        keep = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :])
        size = self.size[keep]
        to = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(self.at[keep] - to, size) + np.arange(int(size.sum()))]
        self.key, self.check, self.used, self.at, self.size = self.key[keep], self.check[keep], self.used[keep], to, size

    def _look_up(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, bool]:
        """Place of each key in the cache, -1 where it is none; and whether another part stands in the place of one."""
        if not len(self.key):
            return np.full(len(key), -1), False
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found, same = self.key[at] == key, self.check[at] == check
        return np.where(found, at, -1), bool((found & ~same).any())

    def _learn(self, key: np.ndarray, check: np.ndarray, plain: np.ndarray, spans: list[bytes]) -> None:
        some = np.flatnonzero(plain)
        ids, size = self._pre_tokens([spans[i].decode() for i in some.tolist()])
        other = np.flatnonzero(~plain)
        each = [e.ids for e in self.full.encode_batch_fast([spans[i].decode("utf-8", "surrogatepass") for i in other.tolist()], add_special_tokens=False)]
        size = np.concatenate((size, np.array([len(e) for e in each], np.int64)))
        order = np.concatenate((some, other))
        ids = np.concatenate((ids, np.array([i for e in each for i in e], "<u4")))
        key, check = np.concatenate((self.key, key[order])), np.concatenate((self.check, check[order]))
        at = np.concatenate((self.at, np.cumsum(size) - size + len(self.pool)))
        self.pool = np.concatenate((self.pool, ids))
        by = np.argsort(key)
        self.key, self.check, self.at = key[by], check[by], at[by]
        self.size = np.concatenate((self.size, size))[by]
        self.used = np.concatenate((self.used, np.full(len(order), self.clock)))[by]

    def _run(self, w: Words) -> list[bytes]:
        if not len(w.start):
            return [b""] * w.n_docs
        data, start, end = w.data, w.start, w.end
        lead = np.zeros(len(data), bool)
        lead[:-1] = (data[:-1] == 0xC3) & LATIN[data[1:]]
        tail = np.zeros(len(data), bool)
        tail[1:] = lead[:-1]
        folded = FOLD[data]
        folded[tail & (data < 0x9F)] += 0x20
        letters, signs = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        np.cumsum(LETTER[data] | lead | tail, out=letters[1:])
        np.cumsum(SIGNS[data], out=signs[1:])
        core = letters[end] - letters[start]
        plain = (core > 0) & (core + signs[end] - signs[start] == end - start) & (letters[start + core] - letters[start] == core)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start[~plain]] += 1
        inside[end[~plain]] -= 1
        folded = np.where(np.cumsum(inside[:-1], dtype=np.int8).astype(bool), data, folded)
        # one part a word, and a second one for the signs behind a plain word
        signed = plain & (core < end - start)
        first = np.arange(len(start)) + np.cumsum(signed) - signed
        n = len(start) + int(signed.sum())
        a, b, whole = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
        a[first], b[first], whole[first] = start, np.where(plain, start + core, end), ~plain
        a[first[signed] + 1], b[first[signed] + 1] = start[signed] + core[signed], end[signed]
        values = folded.astype(np.uint64) + np.uint64(1)
        key, check = (self._hashes(values, a, b, *p) for p in ((BASE, BASE_INVERSE), (SECOND, SECOND_INVERSE)))
        key ^= whole.astype(np.uint64) << np.uint64(62)
        distinct, sample, back = np.unique(key, return_index=True, return_inverse=True)
        marks = check[sample]
        if not (marks[back] == check).all():
            return self._plainly(w)
        self.clock += 1
        place, taken = self._look_up(distinct, marks)
        if taken:
            return self._plainly(w)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = folded.tobytes()
            at = sample[new]
            self._learn(distinct[new], marks[new], ~whole[at], [raw[i:j] for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)])
            place = np.searchsorted(self.key, distinct)
        self.used[place] = self.clock
        place = place[back]
        size = self.size[place]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.at[place] - total[:-1], size) + np.arange(total[-1])].tobytes()
        if len(self.key) > CACHE_PARTS:
            self._trim()
        cuts = (4 * total[np.append(first, n)[w.first]]).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]

    @staticmethod
    def _hashes(values: np.ndarray, a: np.ndarray, b: np.ndarray, base: int, inverse: int) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=total[1:])
        return mix((total[b] - total[a]) * powers(inverse, len(values))[a])

    def _plainly(self, w: Words) -> list[bytes]:
        """The library on whole texts, where two different parts share a hash."""
        cuts, raw = w.bounds.tolist(), w.data.tobytes()
        texts = [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(cuts, cuts[1:])]
        return [np.array(e.ids, "<u4").tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        data, bounds = texts_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        out: list[bytes] = []
        for i, j in slices(bounds, RUN_BYTES):
            out += self._run(Words(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a model file: a path, or the name of one of the installed public tokenizers. Kept by each worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path if "/" in path else public_tokenizers.path(path))
    return _tokenizers[path]
