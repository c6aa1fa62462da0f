"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

Both vocabularies split a text by a fixed pattern before byte pairs are merged, and merges never cross a
piece.  Here a batch of texts is split at once with NumPy on code points, and the library encodes only the
batch's distinct pieces, of which it has not seen most before; ids are gathered from that.  A text that
holds anything the vectorised split is not known to match (code points from LIMIT, characters whose lower case is longer,
text that is not in NFC where the normalizer composes it, a literal of an added token) goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
import regex

from . import words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LIMIT = 0x3000
SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
#: The token that both vocabularies end texts with, and what may follow an apostrophe as a piece of its own.
BETWEEN = "<|endoftext|>"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pieces that a process keeps; beyond, it starts anew.
KEPT = 1_500_000
#: Pieces are known by a 64-bit hash of their code points; longer ones by a hash that no text can be made to collide on.
SHORT = 64


def _classes() -> np.ndarray:
    out = np.full(LIMIT, OTHER, np.uint8)
    chars = "".join(map(chr, range(LIMIT)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for m in regex.finditer(pattern, chars):
            out[m.start()] = kind
    return out


def _odd_lower() -> np.ndarray:
    return np.array([len(chr(c).lower()) != 1 or len(chr(c).upper()) != 1 and chr(c) != chr(c).lower() for c in range(LIMIT)])


class Encoder:
    """encode(texts) -> (ids as uint16 end to end, their bounds) for one tokenizer file.

    kind "byte": GPT-2's pattern, a space before a piece belongs to it.  kind "word": lower-cased, white
    space dropped, numbers digit by digit.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind = kind
        self.library = Tokenizer.from_file(path)
        # as the file says: literals of added tokens become those tokens; BETWEEN, being one, cuts what _learn() encodes
        self.between = self.library.token_to_id(BETWEEN)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.classes = _classes()
        self.odd = _odd_lower() if kind == "word" else np.zeros(LIMIT, bool)
        self.clear()

    def clear(self) -> None:
        self.keys, self.place, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0  # sorted, and where each is
        self.begin = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.store = np.zeros(8192, np.uint16)
        self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Where each piece is, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1).astype(np.int64)

    def _learn(self, pieces: list[str], keys: np.ndarray) -> None:
        """Encodes new pieces; they follow the known ones in their order."""
        for lo in range(0, len(pieces), 20_000):
            part = pieces[lo : lo + 20_000]
            texts = [BETWEEN.join(part[i : i + 500]) + BETWEEN for i in range(0, len(part), 500)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.between)
            n = np.diff(ends, prepend=-1).astype(np.int32) - 1
            ids = ids[ids != self.between]
            assert len(n) == len(part)
            at = self.known
            while at + len(part) > len(self.begin):
                self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
            total = len(ids)
            while self.used + total > len(self.store):
                self.store = np.resize(self.store, 2 * len(self.store))
            self.count[at : at + len(part)] = n
            self.begin[at : at + len(part)] = self.used + np.cumsum(n) - n
            self.store[self.used : self.used + total] = ids
            self.used += total
            self.known += len(part)
        order = np.argsort(keys)
        into = np.searchsorted(self.keys, keys[order])
        first = self.known - len(pieces)
        self.keys, self.place = np.insert(self.keys, into, keys[order]), np.insert(self.place, into, (first + order).astype(np.int32))

    def _starts(self, cps: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and where they end, in code points of texts with a break after each."""
        n = len(cps)
        prev = np.empty(n, np.uint8)
        prev[0], prev[1:] = BREAK, kind[:-1]
        new = kind != prev
        if self.kind == "word":
            new |= kind == NUMBER
        else:
            # a run of white space before something gives its last space to it, or is cut before its last character
            after = np.empty(n, np.uint8)
            after[-1], after[:-1] = BREAK, kind[1:]
            last = (kind == SPACE) & (after != SPACE) & (after != BREAK)
            joins = last & (cps == 32)
            new |= last
            follows = np.flatnonzero(joins) + 1
            new[follows] = False
        # an apostrophe and the letters of a contraction
        for at in np.flatnonzero(cps == 39):
            if not new[at]:
                continue  # within a run of others, or after a space that it joins
            tail = "".join(map(chr, cps[at + 1 : at + 3].tolist()))
            tail = tail.lower() if self.kind == "word" else tail
            for c in CONTRACTIONS:
                if tail.startswith(c):
                    stop = at + 1 + len(c)
                    new[at + 1 : stop] = False
                    if kind[stop] != BREAK:
                        new[stop] = True
                        if self.kind == "byte" and kind[stop] == SPACE and stop + 1 < n and kind[stop + 1] not in (SPACE, BREAK) and cps[stop] == 32:
                            new[stop + 1] = False
                    break
        new[kind == BREAK] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        keep = kind[start] != BREAK
        if self.kind == "word":
            keep &= kind[start] != SPACE
        return start[keep], end[keep]

    def _whole(self, texts: list[str], big: str, cps: np.ndarray, stops: np.ndarray) -> list[int]:
        """Texts that go to the library whole."""
        bad = cps >= LIMIT
        if self.kind == "word":
            bad |= self.odd[np.minimum(cps, LIMIT - 1)]
        found = set(np.searchsorted(stops, np.flatnonzero(bad)).tolist())
        if self.kind == "word":
            found |= {i for i, t in enumerate(texts) if not unicodedata.is_normalized("NFC", t)}
        lower = big.lower()
        if any(a in lower for a in self.added):
            found |= {i for i, t in enumerate(texts) if any(a in t.lower() for a in self.added)}
        return sorted(found)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        got: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in words.slices(texts, 4 * words.SLICE):
            got.append(self._encode([t or "" for t in texts[lo:hi]]))
        if not got:
            return np.zeros(0, np.uint16), np.zeros(1, np.int64)
        bounds = [np.zeros(1, np.int64)]
        for ids, b in got:
            bounds.append(b[1:] + bounds[-1][-1])
        return np.concatenate([g[0] for g in got]), np.concatenate(bounds)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        stops = np.cumsum(size + 1) - 1
        big = "\n".join(texts) + "\n"
        cps = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
        whole = self._whole(texts, big, cps, stops)
        if whole:
            own = {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint16) for i in whole}
            ids, bounds = self._encode(["" if i in own else t for i, t in enumerate(texts)])
            parts = [own.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))
        kind = self.classes[cps]
        kind[stops] = BREAK
        start, end = self._starts(cps, kind)
        key = words.span_hashes(cps, start, end)
        for i in np.flatnonzero(end - start > SHORT).tolist():
            key[i] = hash(big[start[i] : end[i]]) & 0xFFFFFFFFFFFFFFFF
        piece, names = pd.factorize(key)
        if self.known + len(names) > KEPT:
            self.clear()
        index = self._find(names)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            first = np.empty(len(names), np.int64)
            first[piece[::-1]] = np.arange(len(piece) - 1, -1, -1)
            at = first[missing]
            index[missing] = self.known + np.arange(len(missing))
            self._learn([big[s:e] for s, e in zip(start[at].tolist(), end[at].tolist())], names[missing])
        index = index[piece]
        count = self.count[index].astype(np.int64)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.store[np.repeat(self.begin[index] - (upto - count), count) + np.arange(total)]
        return ids, np.append(0, np.append(0, upto)[np.searchsorted(start, stops)])


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The process's encoder for a file; Python workers keep it between tasks."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
