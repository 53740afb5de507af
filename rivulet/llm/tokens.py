"""Token ids of whole texts by a public tokenizer, each distinct word encoded once in a worker."""

from __future__ import annotations

import json
import os

import numpy as np

from .common import run_hashes

_SAME = np.arange(256, dtype=np.uint8)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13, 32]] = True
#: Classes of ASCII bytes: 1 letters, 2 digits, 3 signs but the apostrophe, which begins the tokenizer's contractions.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = 3

# How the tokenizer normalises and splits, as its file says it. pieces() and folded() rely on it.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLITS = [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a Latin letter from U+00C0 to U+00FF are letters, other bytes have none."""
    out = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = 1
    return out


def pieces(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pieces that the tokenizer treats apart: it drops white space and starts a new word where
    letters, digits and signs meet, and with each digit."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m, first = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
    np.logical_not(_GAP[buf], out=m[1:-1])
    first[offsets[:-1][offsets[:-1] < n] + 1] = True
    a, b = kind[:-1], kind[1:]
    first[2:-1] |= ((a != b) & (a > 0) & (b > 0)) | ((a == 2) & (b == 2))
    starts = np.flatnonzero(m[1:-1] & (~m[:-2] | first[1:-1]))
    ends = np.flatnonzero(m[:-1] & (~m[1:] | first[1:]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def folded(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased where no byte of another character follows: with a mark behind it, a letter may compose."""
    up = (buf >= 65) & (buf <= 90)
    up[:-1] &= buf[1:] < 128
    return buf + (up.astype(np.uint8) << 5)


def _splits_known(tokenizer) -> bool:
    """Whether the tokenizer normalises and splits as pieces() takes for granted."""
    own = json.loads(tokenizer.to_str())
    steps = (own.get("normalizer") or {}).get("normalizers") or []
    pre = (own.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = own.get("model") or {}
    return (
        [x.get("type") for x in steps] == NORMALIZERS
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in pre] == ["Split", "ByteLevel"]
        and [x.get("pattern", {}).get("Regex") for x in pre[:1]] == SPLITS
        and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True)
        and (pre[1].get("use_regex"), pre[1].get("add_prefix_space")) == (False, False)
        and (model.get("type"), model.get("dropout"), model.get("end_of_word_suffix")) == ("BPE", None, "</w>")
    )


class Encoder:
    """Encodes batches of texts; holds at most about cap distinct words, told apart by 64 bits.

    A tokenizer whose file says that it splits otherwise than pieces() encodes each text whole.
    """

    def __init__(self, path: str, cap: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap
        # a special token with white space inside could not be told by pieces
        special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {x[:2].encode() for x in special}
        self.whole = not _splits_known(self.tokenizer) or any(x != "".join(x.split()) or len(x) < 2 or not x.isascii() for x in special)
        vocab = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.closing[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and their words' numbers
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray, kind: np.ndarray) -> None:
        """Adds words, given by new hashes in order and the bytes of one occurrence each."""
        other = np.concatenate(([0], np.cumsum(kind != 1)))
        plain = other[s] == other[e]
        size, ids = np.zeros(len(hashes), np.int64), []
        parts = [np.flatnonzero(plain)[i : i + 4096] for i in range(0, int(plain.sum()), 4096)]
        for own in parts:
            got, ends = self._together(buf, s[own], e[own])
            if got is None:
                plain[own] = False
                continue
            ids.append((own, got))
            size[own] = np.diff(np.append(0, ends))
        rest = np.flatnonzero(~plain)
        for i in range(0, len(rest), 4096):
            own = rest[i : i + 4096]
            found = [x.ids for x in self._encode([buf[a:z].tobytes().decode() for a, z in zip(s[own].tolist(), e[own].tolist(), strict=True)])]
            size[own] = [len(x) for x in found]
            ids.append((own, np.array([i for x in found for i in x], np.uint32)))
        order = np.concatenate([own for own, _ in ids]) if ids else np.zeros(0, np.int64)
        new = np.concatenate([x for _, x in ids]) if ids else np.zeros(0, np.uint32)
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), np.uint32)))
        self.flat[self.used : self.used + len(new)] = new
        at = np.empty(len(hashes), np.int64)
        at[order] = self.used + np.cumsum(size[order]) - size[order]
        self.used += len(new)
        slot = len(self.at) + np.arange(len(hashes))
        self.at, self.size = np.concatenate((self.at, at)), np.concatenate((self.size, size))
        both = np.concatenate((self.known, hashes))
        by = np.argsort(both, kind="stable")
        self.known, self.slot = both[by], np.concatenate((self.slot, slot))[by]

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _together(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """Words of letters alone, encoded as one text: each ends with a closing token. None if that doesn't tell them."""
        n = e - s + 1
        ends = np.cumsum(n)
        line = buf[np.minimum(np.repeat(s - ends + n, n) + np.arange(int(ends[-1])), len(buf) - 1)]
        line[ends - 1] = 32
        ids = np.array(self._encode([line[:-1].tobytes().decode()])[0].ids, np.uint32)
        cut = np.flatnonzero(self.closing[ids]) + 1
        if len(cut) != len(s) or cut[-1] != len(ids):
            return None, cut
        return ids, cut

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and where each row's begin in them (one more entry than rows)."""
        rows = len(offsets) - 1
        odd = np.full(rows, self.whole)
        if self.whole:
            s = e = row = np.zeros(0, np.int64)
            kind = np.zeros(0, np.uint8)
        else:
            kind = classes(buf)
            s, e, row = pieces(buf, offsets, kind)
            for a, b in self.marks:
                hit = np.flatnonzero((buf[:-1] == a) & (buf[1:] == b))
                odd[np.searchsorted(offsets, hit, "right") - 1] = True
        if odd.any():
            keep = ~odd[row]
            s, e, row = s[keep], e[keep], row[keep]
        if len(self.known) > self.cap:
            self.clear()
        h = run_hashes(folded(buf), s, e, _SAME)
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        if len(self.known):
            new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != distinct)
        else:
            new = np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], buf, s[where[new]], e[where[new]], kind)
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at][inverse.ravel()] if len(distinct) else np.zeros(0, np.int64)
        size = self.size[slot]
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.at[slot] - ends + size, size) + np.arange(n)]
        counts = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
        if odd.any():
            cut = np.concatenate(([0], np.cumsum(counts)))
            out = []
            for k in range(rows):
                if odd[k]:
                    text = buf[offsets[k] : offsets[k + 1]].tobytes().decode()
                    out.append(np.array(self._encode([text])[0].ids, np.uint32))
                    counts[k] = len(out[-1])
                else:
                    out.append(ids[cut[k] : cut[k + 1]])
            ids = np.concatenate(out) if out else ids
        return ids, np.concatenate(([0], np.cumsum(counts)))

    def encode_ended(self, buf: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with id end behind each row's ids."""
        ids, at = self.encode(buf, offsets)
        rows = len(at) - 1
        out = np.empty(len(ids) + rows, np.uint32)
        marks = at[1:] + np.arange(rows)
        inside = np.ones(len(out), bool)
        inside[marks] = False
        out[marks], out[inside] = end, ids
        return out, at + np.arange(rows + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
