"""Encoding whole texts with a tokenizers file; words that were met before are not encoded again.

For tokenizers that drop white space and lower-case (BPE with word ends), no token crosses white space, so a text's
ids are those of its words. Words of up to 16 bytes are looked up, all of a batch at once, in a numpy table by their exact
bytes; the rest, each different word once, goes through the tokenizers library. The table has a fixed number of places
(a word takes the place of another one with its hash) and a pool of ids of fixed size, so what it holds is bounded. Any
other tokenizer encodes each text as a whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_CACHE: dict[str, Encoder] = {}

#: The normaliser and splitter for which words can be encoded one by one.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def encoder(path: str) -> Encoder:
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


class Encoder:
    def __init__(self, path: str, place_bits: int = 20, pool_ids: int = 1 << 22):
        """The table has 2 ** place_bits places (22 bytes each) and pool_ids ids (4 bytes each)."""
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.shift, self.pool, self.used = np.uint64(64 - place_bits), np.zeros(pool_ids, np.uint32), 0
        places = 1 << place_bits
        self.key_lo, self.key_hi, self.key_size = np.zeros(places, np.uint64), np.zeros(places, np.uint64), np.zeros(places, np.uint8)
        self.first, self.count = np.zeros(places, np.int32), np.zeros(places, np.uint8)
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in norm.get("normalizers", [])]
        first = (pre.get("pretokenizers") or [{}])[0]
        self.by_word = steps == _NORMALISERS and first.get("pattern") == {"Regex": _SPLIT} and spec["model"].get("end_of_word_suffix") == "</w>"
        if self.by_word:
            import regex

            self.special = [x["content"] for x in spec["added_tokens"]]
            self.split = regex.compile(_SPLIT.replace(r"\s", r"\p{White_Space}")).findall
            byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            one = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, byte_level]}}
            self.words = Tokenizer.from_str(json.dumps(one))
            vocab = spec["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        texts = ["" if t is None else t for t in texts]
        if not self.by_word:
            return self._whole(texts)
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        ids, counts = self._by_word(["" if i in set(odd) else t for i, t in enumerate(texts)] if odd else texts)
        if not odd:
            return ids, counts
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in odd:
            parts[i], n = self._whole([texts[i]])
            counts[i] = n[0]
        return np.concatenate(parts), counts

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x.ids, np.uint32) for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        low = [self._lower(t) for t in texts]
        sizes = np.array([len(x) for x in low], np.int64)
        buf = b"\n".join(low) + b"\n" * 17
        a = np.frombuffer(buf, np.uint8)
        gap = _SPACE[a]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(edge) and not gap[0] or not len(edge) and not gap[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        n_words = np.diff(np.searchsorted(starts, bounds))
        size = ends - starts
        eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        lo = eight[starts] & _MASK[np.minimum(size, 8)]
        hi = eight[np.minimum(starts + 8, len(buf) - 8)] & _MASK[np.clip(size - 8, 0, 8)]
        with np.errstate(over="ignore"):
            h = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        place = (h >> self.shift).astype(np.int64)
        known = (self.key_lo[place] == lo) & (self.key_hi[place] == hi) & (self.key_size[place] == np.minimum(size, 17))
        at, per = self.first[place].astype(np.int64), self.count[place].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            words, which = self._different(buf, starts[new], ends[new], lo[new], hi[new], h[new])
            flat, n = self._ids([buf[starts[i] : ends[i]] for i in new[words].tolist()])
            if self.used + len(flat) > len(self.pool):  # full: begin anew, with what this batch needs of it
                self.key_size[:] = 0
                keep = self.pool[np.repeat(at - (np.cumsum(per * known) - per * known), per * known) + np.arange((per * known).sum())]
                at[known] = (np.cumsum(per * known) - per * known)[known]
                self.used = len(keep)
                if self.used + len(flat) > len(self.pool):
                    self.pool = np.zeros(self.used + len(flat), np.uint32)
                self.pool[: self.used] = keep
            begin = self.used + np.cumsum(n) - n
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            at[new], per[new] = begin[which], n[which]
            short = np.flatnonzero((size[new[words]] <= 16) & (n < 256))
            to, of = place[new[words[short]]], new[words[short]]
            self.key_lo[to], self.key_hi[to], self.key_size[to] = lo[of], hi[of], size[of]
            self.first[to], self.count[to] = begin[short], n[short]
        upto = np.cumsum(per)
        ids = self.pool[np.repeat(at - (upto - per), per) + np.arange(upto[-1] if len(upto) else 0)]
        ends_at = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(n_words)])]
        return ids, np.diff(ends_at)

    @staticmethod
    def _different(buf: bytes, starts, ends, lo, hi, h) -> tuple[np.ndarray, np.ndarray]:
        """Places of one of each different word, and for every word its number among them."""
        size = ends - starts
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(size > 16).tolist():  # the number of a long word stands for its bytes
            hi[i] = seen.setdefault(buf[starts[i] : ends[i]], len(seen))
            lo[i] = 0
            h[i] = hi[i]
        size = np.minimum(size, 17)
        order = np.argsort(h)
        lo, hi, size = lo[order], hi[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (size[1:] != size[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which

    @staticmethod
    def _lower(t: str) -> bytes:
        t = unicodedata.normalize("NFC", t)
        # one character at a time: no final form of sigma
        return ("".join(c.lower() for c in t) if "Σ" in t else t.lower()).encode("utf-8", "surrogatepass")

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each has."""
        # A-Z and a-z alone are one piece, and a point or comma after them another; the pattern would find the same
        cut = [
            [w.decode()] if w.isalpha() else [w[:-1].decode(), w[-1:].decode()] if w[-1] in b".," and w[:-1].isalpha() else self.split(w.decode("utf-8", "surrogatepass"))
            for w in words
        ]
        pieces = list(dict.fromkeys(p for c in cut for p in c))
        ids = np.array(self.words.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32) if pieces else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(pieces):
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            of = {p: raw[i:j] for p, i, j in zip(pieces, [0, *ends], ends)}
        else:
            of = {p: np.array(e.ids, np.uint32).tobytes() for p, e in zip(pieces, self.words.encode_batch_fast(pieces, add_special_tokens=False))}
        got = [of[c[0]] if len(c) == 1 else b"".join([of[p] for p in c]) for c in cut]
        return np.frombuffer(b"".join(got), np.uint32), np.array([len(x) for x in got], np.int64) // 4


def strings(column) -> list[str | None]:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_pylist()
