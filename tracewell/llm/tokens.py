"""Token ids by the tokenizers library, with each distinct pre-token encoded once per worker as long as it is remembered."""

from __future__ import annotations

import json
import os

import numpy as np

from .shared import mixed

#: Pre-tokens and ids that a worker remembers.
MOST_PARTS, MOST_IDS = 400_000, 4_000_000
#: Pre-tokens of so many bytes at most are keyed by their bytes as two 64-bit numbers; longer ones by a dictionary.
SHORT = 16
WHITE, LETTER, NUMBER, OTHER, ODD = range(5)
_KNOWN: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    key = (path, specials_as_text)
    if key not in _KNOWN:
        _KNOWN[key] = Encoder(path, specials_as_text)
    return _KNOWN[key]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of ASCII bytes, and of the characters U+0080 to U+00FF."""
    one = np.full(256, OTHER, np.uint8)
    one[[0x20, *range(0x09, 0x0E)]] = WHITE
    one[0x30:0x3A] = NUMBER
    one[0x41:0x5B] = one[0x61:0x7B] = LETTER
    two = np.full(128, OTHER, np.uint8)
    two[0x40:] = LETTER
    two[[0xD7 - 0x80, 0xF7 - 0x80]] = OTHER
    two[[0xAA - 0x80, 0xB5 - 0x80, 0xBA - 0x80]] = LETTER
    two[[x - 0x80 for x in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE)]] = NUMBER
    return one, two


_ONE, _TWO = _classes()
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


class Table:
    """Codes of 128-bit keys: open addressing, looked up and filled array by array."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.code = np.full(1 << bits, -1, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mixed(low ^ mixed(high + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each key's code; -1 where there is none."""
        slot = self._slots(low, high)
        out = self.code[slot]
        open_ = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            code = self.code[slot]
            out[open_] = code
            left = (code >= 0) & ((self.low[slot] != low[open_]) | (self.high[slot] != high[open_]))
            open_, slot = open_[left], slot[left]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> None:
        """Distinct keys that the table has not."""
        self.used += len(code)
        if 2 * self.used > 1 << self.bits:
            old = np.flatnonzero(self.code >= 0)
            keep = self.low[old], self.high[old], self.code[old]
            used = self.used
            self.__init__(max(self.bits + 1, int(2 * used).bit_length()))
            self._place(*keep)
            self.used = used
        self._place(low, high, code)

    def _place(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> None:
        slot = self._slots(low, high)
        while len(code):
            free = self.code[slot] < 0
            self.code[slot[free]] = code[free]  # of several for one slot the last stays
            done = free & (self.code[slot] == code)
            self.low[slot[done]], self.high[slot[done]] = low[done], high[done]
            left = ~done
            low, high, code, slot = low[left], high[left], code[left], (slot[left] + 1) & ((1 << self.bits) - 1)


class Ids:
    """Ids of many pre-tokens in one array, by code."""

    def __init__(self) -> None:
        self.short, self.long = Table(), {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = self.count = 0
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def forget(self, most: int, most_ids: int) -> None:
        if self.count > most or self.used > most_ids:
            self.__init__()

    def add(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The codes of pre-tokens whose ids these are."""
        first, total = self.count, len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(size) > len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.flat[self.used : self.used + total] = flat
        self.n[first : first + len(size)] = size
        self.at[first : first + len(size)] = self.used + np.cumsum(size) - size
        self.used += total
        self.count += len(size)
        return np.arange(first, self.count, dtype=np.int32)

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the codes in a row, and the number of each."""
        size = self.n[code]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.at[code] - (end - size), size) + np.arange(total)], size


class Encoder:
    """encode() gives the ids of tokenizers' encode(text, add_special_tokens=False).

    Two kinds of files are read pre-token by pre-token: byte-level BPE with its own pattern, and BPE with word ends whose
    normalizer only composes, lower-cases and drops white space and whose pattern takes the same classes of characters. Their
    pre-tokens are found in all bytes of a batch at once: runs of letters, numbers or other characters, told apart by the class
    of each byte. Between white space, what holds characters of unknown class (beyond Latin-1) goes to the library as it is.
    So do whole texts that hold an added token or white space beyond ASCII, and all texts of any other kind of file.

    With specials_as_text, strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = specials_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = [t for t in spec["added_tokens"] if not (specials_as_text and t["special"])]
        self.added = [t["content"].encode() for t in added]
        self.size = max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1 if model["type"] == "BPE" else 1 << 31
        self.kind = "whole"
        if any(t["normalized"] or not t["content"].isascii() for t in added):
            pass  # such a token may be found in other strings than its own
        elif model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            self.kind = "byte"
        elif model.get("end_of_word_suffix") == "</w>" and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
            ends = np.zeros(self.size, bool)
            ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
            self.ends = ends
        self.newline = -1
        if self.kind == "byte":
            ids = self.plain.encode("\n", add_special_tokens=False).ids
            self.newline = ids[0] if len(ids) == 1 else -1
        self.ids = Ids()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *got]), np.array([len(g) for g in got], np.int64)

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """Codes of new pre-tokens. Hundreds go to the library in one call: joined by line feeds, which are dropped (word) or have one id (byte)."""
        codes = []
        for i in range(0, len(fresh), 500):
            some = fresh[i : i + 500]
            flat, size = np.zeros(0, np.int32), np.zeros(0, np.int64)
            if self.kind == "word" or self.newline >= 0:
                ids = np.array(self.plain.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int32)
                if self.kind == "word":
                    flat, size = ids, np.diff(np.r_[0, np.flatnonzero(self.ends[ids]) + 1])
                else:
                    cut = np.flatnonzero(ids == self.newline)
                    flat, size = np.delete(ids, cut), np.diff(np.r_[-1, cut, len(ids)]) - 1
            if len(size) != len(some) or not size.all():  # white space, and what has more or fewer ends than one
                flat, size = self._whole(some)
            codes.append(self.ids.add(flat, size))
        return np.concatenate([np.zeros(0, np.int32), *codes])

    def _classed(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character; ODD where it isn't known here."""
        kind = _ONE[data]
        high = np.flatnonzero(data >= 0x80)
        if len(high):
            byte = data[high]
            kind[high] = ODD
            lead = (byte == 0xC2) | (byte == 0xC3)
            at = high[lead]
            kind[at] = kind[at + 1] = _TWO[(byte[lead] - np.uint8(0xC2)).astype(np.int64) * 64 + (data[at + 1] & 0x3F)]
            if self.kind == "byte":  # all of U+0100 to U+024F are letters
                at = high[(byte >= 0xC4) & (byte <= 0xC8)]
                kind[at] = kind[at + 1] = LETTER
        return kind

    @staticmethod
    def _far_white(data: np.ndarray) -> np.ndarray:
        """Places of white space beyond ASCII."""
        at = np.flatnonzero(np.isin(data, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)))
        after = lambda k: data[np.minimum(at + k, len(data) - 1)].astype(np.int64)
        a, b, c = data[at], after(1), after(2)
        low = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        return at[low | general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]

    def _parts(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of pre-tokens, whether their class is unknown, and the bytes they are in (lower-cased where the file does so)."""
        kind = self._classed(data)
        first = np.zeros(len(data), bool)
        first[begin[begin < len(data)]] = True
        if (kind == ODD).any():
            white = kind == WHITE
            run = np.flatnonzero(first | (white != np.r_[True, white[:-1]]))
            odd = np.add.reduceat((kind == ODD).astype(np.int64), run) > 0
            kind[np.repeat(odd, np.diff(np.r_[run, len(data)]))] = ODD
        edge = first | (kind != np.r_[kind[:1], kind[:-1]])
        if self.kind == "word":
            edge |= (kind == NUMBER) & ((data & 0xC0) != 0x80)
            known = kind != ODD
            upper = known & (data >= 0x41) & (data <= 0x5A)
            far = known & (data >= 0x80) & (data <= 0x9E) & (data != 0x97) & (np.r_[np.uint8(0), data[:-1]] == 0xC3)
            data = data + ((upper | far).view(np.uint8) << np.uint8(5))
        start = np.flatnonzero(edge)
        end = np.r_[start[1:], len(data)]
        what = kind[start]
        joined = np.zeros(len(start), bool)
        if self.kind == "byte":
            # the last of a run of white space goes with what follows if it is a space, else it stands alone
            inner = np.flatnonzero((what[:-1] == WHITE) & ~first[start[1:]])
            last = end[inner] - 1
            space = data[last] == 0x20
            to = inner[space]
            end[to] -= 1
            start[to + 1] -= 1
            joined[to + 1] = True
            rest = inner[~space]
            rest = rest[end[rest] - start[rest] > 1]
            if len(rest):
                where = end[rest] - 1
                end[rest] -= 1
                start, end = np.insert(start, rest + 1, where), np.insert(end, rest + 1, where + 1)
                what, joined = np.insert(what, rest + 1, WHITE), np.insert(joined, rest + 1, False)
        # an apostrophe by itself takes s, t, m, d, re, ve or ll along
        mark = np.flatnonzero((what[:-1] == OTHER) & (end[:-1] - start[:-1] == 1) & (what[1:] == LETTER) & ~joined[:-1] & (end[:-1] == start[1:]))
        mark = mark[(data[start[mark]] == 0x27) & ~first[start[mark + 1]]]
        if len(mark):
            a = data[end[mark]]
            b = np.where(end[mark + 1] - start[mark + 1] > 1, data[np.minimum(end[mark] + 1, len(data) - 1)], 0)
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            more = one.astype(np.int64) + 2 * two
            end[mark] += more
            start[mark + 1] += more
        keep = end > start
        if self.kind == "word":
            keep &= what != WHITE
        return start[keep], end[keep], what[keep] == ODD, data

    def _codes(self, start: np.ndarray, end: np.ndarray, odd: np.ndarray, data: np.ndarray) -> np.ndarray:
        size = end - start
        code = np.empty(len(start), np.int32)
        short = np.flatnonzero((size <= SHORT) & ~odd)
        # the bytes of each short one as two numbers: they are its key
        buffer = np.concatenate([data, np.zeros(2 * SHORT, np.uint8)])
        eight = np.ndarray((len(data) + SHORT,), "<u8", buffer, 0, (1,))
        s, n = start[short], size[short]
        low, high = eight[s] & _MASK[np.minimum(n, 8)], eight[s + 8] & _MASK[np.maximum(n - 8, 0)]
        # bytes of value 0 would make keys of different lengths alike
        high = np.where(n == SHORT, high, high | (n.astype(np.uint64) << np.uint64(56)))
        plain = np.ones(len(short), bool)
        plain[n == SHORT] = high[n == SHORT] >> np.uint64(56) >= SHORT
        rest = np.r_[np.flatnonzero((size > SHORT) | odd), short[~plain]]
        short, low, high = short[plain], low[plain], high[plain]
        got = self.ids.short.find(low, high)
        new = np.flatnonzero(got < 0)
        if len(new):
            order = new[np.lexsort((low[new], high[new]))]
            lead = np.r_[True, (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])]
            one = order[lead]
            raw = data.tobytes()
            fresh = [raw[a:b].decode() for a, b in zip(start[short[one]].tolist(), end[short[one]].tolist(), strict=True)]
            white = np.fromiter((x.isspace() for x in fresh), bool, len(fresh))
            codes = np.empty(len(one), np.int32)
            codes[~white] = self._learn([x for x, w in zip(fresh, white.tolist(), strict=True) if not w])
            if white.any():
                codes[white] = self.ids.add(*self._whole([x for x, w in zip(fresh, white.tolist(), strict=True) if w]))
            self.ids.short.add(low[one], high[one], codes)
            got[order] = codes[np.cumsum(lead) - 1]
        code[short] = got
        if len(rest):
            raw, long = data.tobytes(), self.ids.long
            keys = [raw[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
            fresh = list(set(keys).difference(long))
            for white in (False, True):
                some = [x for x in fresh if x.isspace() == white]
                texts = [x.decode() for x in some]
                codes = self.ids.add(*self._whole(texts)) if white and some else self._learn(texts)
                long.update(zip(some, codes.tolist(), strict=True))
            code[rest] = np.fromiter(map(long.__getitem__, keys), np.int32, len(keys))
        return code

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's number of ids."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.kind == "whole":
            return self._whole([t.decode("utf-8") for t in texts])
        self.ids.forget(MOST_PARTS, MOST_IDS)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.r_[0, np.cumsum(length)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        apart = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        apart |= set((np.searchsorted(begin, self._far_white(data), "right") - 1).tolist())
        if apart:
            flat, size = self.encode([b"" if i in apart else t for i, t in enumerate(texts)])
            other, count = self._whole([texts[i].decode("utf-8") for i in sorted(apart)])
            at = np.r_[0, np.cumsum(size)][sorted(apart)]
            size[sorted(apart)] = count
            return np.insert(flat, np.repeat(at, count), other), size
        start, end, odd, data = self._parts(data, begin)
        ids, each = self.ids.of(self._codes(start, end, odd, data))
        total = np.r_[0, np.cumsum(each)]
        return ids, np.diff(total[np.searchsorted(start, begin)])
