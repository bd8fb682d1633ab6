"""Token ids by the tokenizers library, with the ids of each distinct part of text kept.

A byte-pair tokenizer first splits a text into pieces and merges within each, so a text's
ids are those of its parts, wherever no piece crosses from one to the next. Texts repeat
their parts; each is encoded once and kept. Parts are found and looked up by array
operations on the bytes of many texts at once.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from careflow.llm.common import mixed

# Parts of up to KEY bytes kept per Python worker; bytes kept of longer ones and of pieces, and of an entry besides its text and ids.
ENTRIES, LONG_BYTES, PIECE_BYTES, ENTRY_BYTES = 1 << 20, 16 << 20, 32 << 20, 200
KEY = 24
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Bytes of the characters that every regular expression library classes alike: \t, \n, \r, ASCII from
# the blank on, U+00A1 to U+017F. A text with any other, or with what may be the name of a special
# token, is encoded whole by the library.
PLAIN = np.zeros(256, bool)
PLAIN[[9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xC6)]] = True
# How a text falls apart where no piece of the vocabulary's own splitting crosses: words
# with the blank before them and runs of white space (true), or words without white space.
BLANKS = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
# How the two vocabularies split a text into pieces.
PIECES = {
    "byte_bpe_50k.json": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
LOWERED = {"word_bpe_49k.json"}
# Marks that never join the letters before them, and together make one piece.
MARKS = ",.;:!?"


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as
    themselves, the others in turn from code point 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


LETTERS = byte_letters()
CODES = np.array([ord(LETTERS[b]) for b in range(256)], "<u4")
# Bytes of letters among the plain characters; U+00D7 and U+00F7 are none. The words merged at once.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC6)]] = True
IS_MARK = np.zeros(256, bool)
IS_MARK[[*MARKS.encode()]] = True
JOINED = 12


class Kept(dict):
    """A store that works out what it has not got. It holds at most so many bytes: half of them
    what came last, the other half what came before, of which only entries asked for again stay."""

    def __init__(self, work, most: int):
        self.work, self.most, self.size, self.before = work, most // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.work(key)
        self[key] = value
        self.size += len(key) + len(value) + ENTRY_BYTES
        if self.size >= self.most:
            self.before, self.size = dict(self), 0
            self.clear()
        return value


class Parts:
    """Ids of parts of at most KEY bytes, by their bytes: an open hash table in arrays.

    When it is full, parts that were asked for again since the last time stay, at most half of them all.
    """

    def __init__(self, most: int):
        self.most, self.mask = most, (1 << max(4, (2 * most - 1).bit_length())) - 1
        self.slots = np.full(self.mask + 1, -1, np.int32)
        self.keys = [np.zeros(most, np.uint64) for _ in range(KEY // 8)]
        self.asked = np.zeros(most, bool)
        self.at, self.counts = np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.flat, self.n, self.used = np.zeros(1 << 16, np.uint32), 0, 0

    def slot(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0]
        for key in keys[1:]:
            h = h * np.uint64(0x9E3779B97F4A7C15) ^ key
        return (mixed(h) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The entry of each key, -1 for those not kept."""
        slot, out = self.slot(keys), None
        entry = self.slots.take(slot)
        same = self._same(entry, keys)
        out = np.where(same, entry, -1)
        left = np.flatnonzero(~same & (entry >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            entry = self.slots.take(slot[left])
            same = self._same(entry, [k[left] for k in keys])
            out[left[same]] = entry[same]
            left = left[~same & (entry >= 0)]
        self.asked[out[out >= 0]] = True
        return out

    def _same(self, entry: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        same = entry >= 0
        for own, key in zip(self.keys, keys):
            same &= own.take(entry, mode="clip") == key
        return same

    def _place(self, first: int, last: int) -> None:
        slot, entry = self.slot([k[first:last] for k in self.keys]), np.arange(first, last, dtype=np.int32)
        while len(entry):
            free = self.slots.take(slot) < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots.take(slot) != entry
            slot, entry = (slot[left] + 1) & self.mask, entry[left]

    def add(self, keys: list[np.ndarray], ids: np.ndarray, counts: np.ndarray) -> None:
        """New keys, each once and at most `most`, with their ids one after the other."""
        n = len(counts)
        if self.n + n > self.most:
            self._make_room(n)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        new = slice(self.n, self.n + n)
        for own, key in zip(self.keys, keys):
            own[new] = key
        self.counts[new], self.at[new] = counts, self.used + np.cumsum(counts) - counts
        self.asked[new] = False
        self.flat[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + n, self.used + len(ids)
        self._place(new.start, new.stop)

    def _make_room(self, n: int) -> None:
        keep = np.flatnonzero(self.asked[: self.n])
        keep = keep[max(0, len(keep) - min(self.most // 2, self.most - n)) :]
        counts = self.counts[keep]
        flat = gathered(self.flat, self.at[keep], counts)
        keys = [k[keep] for k in self.keys]
        self.slots.fill(-1)
        self.n = self.used = 0
        self.add(keys, flat, counts)


def gathered(flat: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of `flat` from `at`, of `counts` numbers each, one after the other."""
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat.take(np.repeat(at - (ends - counts), counts) + np.arange(total), mode="clip")


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, entries: int = ENTRIES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        name = os.path.basename(path)
        self.blanks = BLANKS.get(name)
        self.cut = regex.compile(PIECES[name]).findall if name in PIECES else None
        self.lowered = name in LOWERED
        self.parts = Parts(entries)
        self.long = Kept(self._part, LONG_BYTES)
        self.pieces = Kept(self._piece, PIECE_BYTES)
        # Where the ends of pieces are not marked and zero bytes merge with nothing, pieces
        # are merged many at once with a zero byte between them: it is in no plain text.
        model = json.loads(self.library.to_str())["model"]
        plain = not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token", "dropout"))
        alone = model["vocab"].get(LETTERS[0])
        merged = any(LETTERS[0] in x for pair in model["merges"] for x in pair)
        self.apart = alone if plain and not merged else None

    def _piece(self, piece: str) -> bytes:
        letters = "".join(map(LETTERS.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _part(self, part: str) -> bytes:
        part = part.lower() if self.lowered else part
        word = part.rstrip(MARKS)
        # Most parts are a word, with the blank before it, or marks, or both: known without the regular expression.
        if word in ("", " ") and word != part:
            return self.pieces[part]
        if (word[1:] if word[:1] == " " else word).isalpha():
            at, pieces = len(word), self.pieces
            return pieces[word] + pieces[part[at:]] if at < len(part) else pieces[word]
        return b"".join(map(self.pieces.__getitem__, self.cut(part)))

    def _words(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that are one piece each, from their bytes one after the other."""
        ends = np.cumsum(lengths)
        codes = np.insert(CODES.take(data), ends, CODES[0])
        letters, ends = codes.tobytes().decode("utf-32-le"), (ends + np.arange(1, len(ends) + 1)).tolist()
        cuts = [0, *ends[JOINED - 1 : -1 : JOINED], ends[-1]]
        ids = np.array([t.id for a, b in zip(cuts, cuts[1:]) for t in self.merge(letters[a:b])], np.uint32)
        between = ids == self.apart
        return ids[~between], np.diff(np.flatnonzero(between), prepend=-1) - 1

    def _new(self, buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the parts; in it their ids one after the other, and how many each has."""
        ends = np.cumsum(lengths)
        begins = ends - lengths
        data = gathered(buf, at, lengths)
        other = ~WORD_BYTES[data]
        other[begins] &= data[begins] != 32
        other[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        word = np.add.reduceat(other, begins, dtype=np.int64) == 0 if self.apart is not None else np.zeros(len(at), bool)
        words, rest = np.flatnonzero(word), np.flatnonzero(~word)
        ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(words):
            ids, counts = self._words(data[np.repeat(word, lengths)], lengths[words])
        spans = zip(begins[rest].tolist(), ends[rest].tolist())
        coded = [self._part(data[a:b].tobytes().decode()) for a, b in spans]
        ids = np.concatenate([ids, np.frombuffer(b"".join(coded), np.uint32)])
        return np.concatenate([words, rest]), ids, np.concatenate([counts, np.array([len(c) // 4 for c in coded], np.int64)])

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.arrays(pa.array(texts, pa.large_string()))
        data, ends = ids.tobytes(), np.cumsum(counts) * 4
        return [data[a:b] for a, b in zip((ends - counts * 4).tolist(), ends.tolist())]

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has. Null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        first, size = int(bounds[0]), int(bounds[-1] - bounds[0])
        # Room for reading a key from every byte on.
        buf = np.zeros((size + 15 >> 3) + KEY // 8 << 3, np.uint8)
        if size:
            buf[:size] = np.frombuffer(data, np.uint8, size, first)
        bounds = bounds - first
        odd = self._odd(buf[:size], bounds)
        at, lengths = self._cut(buf[:size], bounds, odd)
        out, counts = [], np.zeros(len(at) + 1, np.int64)
        stretch = max(1, min(1 << 16, self.parts.most // 4))
        for i in range(0, len(at), stretch):
            some = slice(i, i + stretch)
            ids, counts[1 + i : 1 + i + stretch] = self._stretch(buf, at[some], lengths[some], bounds[odd])
            out.append(ids)
        sums = np.cumsum(counts)
        per_text = np.diff(sums[np.searchsorted(at, bounds)])
        return np.concatenate(out) if out else np.zeros(0, np.uint32), per_text

    def _odd(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The numbers of the texts that the library encodes whole."""
        if self.blanks is None:
            return np.flatnonzero(np.diff(bounds))
        odd = ~PLAIN[buf]
        odd[:-1] |= (buf[:-1] == 0xC2) & (buf[1:] < 0xA1) | (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
        return np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1)

    def _cut(self, buf: np.ndarray, bounds: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts begin, and their bytes. A text encoded whole is one part."""
        begins, ends = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0]
        space = buf <= 32
        # A text begins after, and ends before, a space of another kind than the blank.
        first, last = ~space, ~space
        before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        before[begins], after[ends - 1] = True, True
        if self.blanks:
            first &= before
            first[1:] &= buf[:-1] != 32
            # A run of white space, and its last character if a word follows.
            first[1:] |= space[1:] & ~space[:-1]
            first |= space & ~after
            first[begins] = True
        else:
            first &= before
        last &= after
        # Every splitting cuts between a letter and the mark after it.
        marked = (((buf[:-1] | 32) - np.uint8(97)) < 26) & IS_MARK[buf[1:]]
        first[1:] |= marked
        last[:-1] |= marked
        for number in odd.tolist():
            a, b = bounds[number : number + 2]
            first[a:b] = last[a:b] = False
            first[a] = last[b - 1] = True
        at = np.flatnonzero(first)
        return at, np.diff(at, append=len(buf)) if self.blanks else np.flatnonzero(last) + 1 - at

    def _keys(self, buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The bytes of parts of at most KEY bytes as numbers, zeros after them."""
        words, number, shift = buf.view("<u8"), at >> 3, ((at & 7) << 3).astype(np.uint64)
        keys, low = [], words.take(number)
        for i in range(0, KEY, 8):
            high = words.take(number + (i // 8 + 1))
            key = (low >> shift) | ((high << np.uint64(1)) << (np.uint64(63) - shift))
            keys.append(key & FIRST_BYTES.take(np.clip(lengths - i, 0, 8)))
            low = high
        return keys

    def _stretch(self, buf: np.ndarray, at: np.ndarray, lengths: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some parts one after the other, and how many each has."""
        alone = lengths > KEY
        if len(odd):
            alone |= np.isin(at, odd)
        short = np.flatnonzero(~alone)
        entry = self._entries(buf, at[short], lengths[short])
        counts, begin = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[short], begin[short] = self.parts.counts.take(entry), self.parts.at.take(entry)
        others = {}
        for i in np.flatnonzero(alone).tolist():
            text = buf[at[i] : at[i] + lengths[i]].tobytes().decode()
            whole = len(odd) and at[i] in odd
            others[i] = np.frombuffer(self.whole(text) if whole else self.long[text], np.uint32)
            counts[i] = len(others[i])
        ids = gathered(self.parts.flat, begin, counts)
        ends = np.cumsum(counts)
        for i, own in others.items():
            ids[ends[i] - len(own) : ends[i]] = own
        return ids, counts

    def _entries(self, buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        keys = self._keys(buf, at, lengths)
        entry = self.parts.find(keys)
        while len(missing := np.flatnonzero(entry < 0)):
            own = [k[missing] for k in keys]
            order = np.lexsort(own)
            own = [k[order] for k in own]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in own])
            places = missing[order[new]]
            order, ids, counts = self._new(buf, at[places], lengths[places])
            # Making room may drop entries found before, which are then looked for again.
            self.parts.add([k[new][order] for k in own], ids, counts)
            entry = self.parts.find(keys)
        return entry


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
