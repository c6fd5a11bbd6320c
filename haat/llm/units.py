"""Whole texts to token ids with a tokenizer file of the tokenizers library,
unit by unit.

A tokenizer first splits a text into pre-tokens and never merges across them.
Where a text may be cut without changing a pre-token is found for all bytes of
a chunk at once, from classes of bytes: at single spaces (or, where white
space is dropped, at every blank), and between letters, digits and signs.
Parts that hold anything but basic and extended Latin or an apostrophe are
taken whole, from cut to cut.  Each different unit is encoded by the library;
its ids are kept in a table of fixed size (a slot holds one unit; a newer one
takes it over), found by a 64-bit hash and proved by 32 further bits.  Ids of
a text are those of its units, gathered as arrays.

Two ways of splitting are known, by what the file says of itself; any other
tokenizer gets its texts whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

SLOTS = 1 << 21      # units kept by a worker
MOST = 12            # ids of a unit that is kept
LONGEST = 64         # bytes of a unit that is kept
AT_ONCE = 1_000      # units joined to one text for the library

SPACE, BREAK, LETTER, DIGIT, SIGN, SOLID, DOUBT = range(7)


def _classes(blanks: str, breaks: str) -> np.ndarray:
    """The class of each byte that begins a character.  SOLID: not blank, and
    not to be split.  DOUBT: may begin a blank, or is rare."""
    c = np.full(256, SOLID, np.uint8)
    c[:128] = SIGN
    c[:32] = c[127] = DOUBT
    c[ord("'")] = SOLID
    for first, last in ("AZ", "az"):
        c[ord(first):ord(last) + 1] = LETTER
    c[ord("0"):ord("9") + 1] = DIGIT
    c[0xC3:0xCA] = LETTER                     # U+00C0 to U+027F, but for the pairs below
    c[[0xC2, 0xE1, 0xE2, 0xE3]] = DOUBT       # these begin the blanks beyond ASCII
    c[list(map(ord, breaks))] = BREAK
    c[list(map(ord, blanks))] = SPACE
    return c


# Not letters (multiplication and division sign), or not one letter in lower case.
PAIRS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]

WORD_ENDS = "</w>"
KNOWN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocab = self.lib.get_vocab(with_added_tokens=True)
        top = max(vocab.values())
        split = said["pre_tokenizer"] or {}
        first = (split.get("pretokenizers") or [{}])[0]
        if split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] \
                and not said["normalizer"]:
            self.units, self.classes = self._byte_units, _classes(" ", "\n")
            self.glue, self.last = "\n", np.zeros(top + 1, bool)
            self.last[self._ids(["\n"])[0]] = True
        elif first.get("pattern") == {"Regex": KNOWN_WORDS} and said["model"]["end_of_word_suffix"] == WORD_ENDS:
            self.units, self.classes = self._word_units, _classes(" \n\t\r", "")
            self.glue, self.last = " ", np.zeros(top + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(WORD_ENDS)]] = True
        else:
            self.units = None
        rng = np.random.default_rng(20)
        self.mix = rng.integers(0, 1 << 64, LONGEST * 256, np.uint64)
        self.mix_check = rng.integers(0, 1 << 32, LONGEST * 256, np.uint32)
        self.keys = np.zeros(SLOTS, np.uint64)
        self.checks = np.zeros(SLOTS, np.uint32)
        self.n = np.zeros(SLOTS, np.uint8)                     # ids + 1; 0: empty
        self.kept = np.zeros((SLOTS, MOST), np.uint16 if top < 1 << 16 else np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    # Where units begin: starts in the bytes, which are plain (may be joined
    # for the library), and which stand for nothing.

    def _class_of(self, b: np.ndarray) -> np.ndarray:
        cls = self.classes[b]
        inner = (b & 0xC0) == 0x80
        if inner.any():
            cls = cls[np.maximum.accumulate(np.where(inner, 0, np.arange(len(b), dtype=np.int32)))]
            for x, y in PAIRS:
                at = np.flatnonzero((b[:-1] == x) & (b[1:] == y))
                cls[at] = cls[at + 1] = SOLID
        return cls

    def _byte_units(self, b, opens):
        """Pieces begin at a text's start and at each single space between two
        bytes that are not blank."""
        cls = self._class_of(b)
        closes = np.append(opens[1:], True)
        firm = (cls >= LETTER) & (cls <= SOLID)
        amid = ~opens & ~closes
        amid[1:] &= firm[:-1]
        amid[:-1] &= firm[1:]
        cut = (cls == SPACE) & amid
        begins = opens | cut
        plain = ((cls >= LETTER) & (cls <= SIGN)) | cut | ((cls == BREAK) & amid)
        pieces = np.flatnonzero(begins)
        simple = np.logical_and.reduceat(plain, pieces)
        inside = np.repeat(simple, np.diff(np.append(pieces, len(b))))
        change = np.zeros(len(b), bool)
        change[1:] = (cls[1:] != cls[:-1]) & ~cut[:-1]
        starts = np.flatnonzero(begins | (change & inside))
        return starts, inside[starts] & (cls[starts] != BREAK), None

    def _word_units(self, b, opens):
        """Pieces are what stands between blanks; digits stand alone."""
        cls = self._class_of(b)
        blank = cls == SPACE
        begins = opens.copy()
        begins[1:] |= blank[1:] != blank[:-1]
        pieces = np.flatnonzero(begins)
        simple = np.logical_and.reduceat(blank | ((cls >= LETTER) & (cls <= SIGN)), pieces)
        inside = np.repeat(simple, np.diff(np.append(pieces, len(b))))
        change = cls == DIGIT
        change[1:] |= cls[1:] != cls[:-1]
        starts = np.flatnonzero(begins | (change & inside))
        return starts, inside[starts], blank[starts]

    def _learn(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after the other, and how many each has."""
        texts = [u.decode() for u in units]
        counts = np.zeros(len(units), np.int64)
        parts: list = [None] * len(units)
        joined = np.flatnonzero(plain)
        flat, where = [], []
        for a in range(0, len(joined), AT_ONCE):
            some = joined[a:a + AT_ONCE]
            ids = np.array(self._ids([self.glue.join([texts[i] for i in some])])[0], np.int64)
            last = np.flatnonzero(self.last[ids])
            if self.glue == "\n":
                # The glue's own id ends each unit but the last of all.
                n = np.diff(np.concatenate([[-1], last, [len(ids)]])) - 1
                ids = np.delete(ids, last)
            else:
                n = np.diff(np.concatenate([[-1], last]))
            if len(n) != len(some) or n.sum() != len(ids) or (n < 1).any():
                plain[some] = False
                continue
            counts[some] = n
            flat.append(ids)
            where.append(some)
        alone = np.flatnonzero(~plain)
        for a in range(0, len(alone), AT_ONCE):
            some = alone[a:a + AT_ONCE]
            for i, ids in zip(some.tolist(), self._ids([texts[i] for i in some])):
                parts[i] = ids
                counts[i] = len(ids)
        starts = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for some, ids in zip(where, flat):
            out[_spread(starts[some], counts[some])] = ids
        for i in alone.tolist():
            out[starts[i]:starts[i] + counts[i]] = parts[i]
        return out, counts

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts one after the other, each
        followed by ``end`` if given, and the n + 1 places where texts begin."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data, tail = b"".join(raw), int(end is not None)
        if self.units is None or not data:
            ids = self._ids(texts)
            n = np.fromiter(map(len, ids), np.int64, len(ids)) + tail
            out = np.concatenate([np.array([], np.uint32), *[np.array(x + [end] * tail, np.uint32) for x in ids]])
            return out, np.concatenate([[0], np.cumsum(n)])
        b, at = np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes
        opens = np.zeros(len(b), bool)
        opens[at[sizes > 0]] = True
        s, plain, void = self.units(b, opens)
        e = np.append(s[1:], len(b))
        place = np.minimum(np.arange(len(b)) - np.repeat(s, e - s), LONGEST - 1) * 256 + b
        key, check = np.add.reduceat(self.mix[place], s), np.add.reduceat(self.mix_check[place], s, dtype=np.uint32)
        del place
        if void is not None:
            s, e, plain, key, check = (x[~void] for x in (s, e, plain, key, check))
        slot = (key >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        short = e - s <= LONGEST
        found = self.n[slot]
        hit = short & (found > 0) & (self.keys[slot] == key) & (self.checks[slot] == check)
        counts = np.where(hit, found.astype(np.int64) - 1, 0)
        # Every different unit that is not in the table, once.
        miss = np.flatnonzero(~hit)
        units: dict[bytes, int] = {}
        which = np.array([units.setdefault(data[a:z], len(units))
                          for a, z in zip(s[miss].tolist(), e[miss].tolist())], np.int64)
        first = np.zeros(len(units), np.int64)
        first[which[::-1]] = miss[::-1]
        learnt, n_learnt = self._learn(list(units), plain[first].copy())
        learnt_at = np.cumsum(n_learnt) - n_learnt
        counts[miss] = n_learnt[which]
        # Where each unit's ids go.
        doc = np.searchsorted(at, s, "right") - 1
        n = np.bincount(doc, counts, len(raw)).astype(np.int64) + tail
        starts = np.concatenate([[0], np.cumsum(n)])
        goes = np.cumsum(counts) - counts + doc * tail
        out = np.zeros(int(starts[-1]), np.uint32)
        if tail:
            out[starts[1:] - 1] = end
        row = np.flatnonzero(hit)
        for j in range(MOST):
            row = row[counts[row] > j]
            if not len(row):
                break
            out[goes[row] + j] = self.kept[slot[row], j]
        out[_spread(goes[miss], counts[miss])] = learnt[_spread(learnt_at[which], counts[miss])]
        # Keep the new ones, one a slot.
        new = np.flatnonzero(short[first] & (n_learnt <= MOST))
        taken, new_at = np.unique(slot[first[new]], return_index=True)
        new = new[new_at]
        self.keys[taken], self.checks[taken] = key[first[new]], check[first[new]]
        self.n[taken] = n_learnt[new] + 1
        for j in range(MOST):
            has = n_learnt[new] > j
            self.kept[taken[has], j] = learnt[learnt_at[new[has]] + j]
        return out, starts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of ``counts``."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)
