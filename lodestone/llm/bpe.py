"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge list has a *sufficient lookahead*: a number of bytes such that a token boundary with at least so many bytes after
it stays where it is, whatever follows. ``MergeTable.lookahead`` computes a bound from the merges alone, ``Transducer``
emits tokens as soon as they are that far from the end of what it has read, or the word ends, and so keeps a window of constant
size however long a word is. Every token comes from it: words are its lanes, which step together in numpy, and a bounded memo
remembers what it emitted for short words. Long texts are read in chunks, of which only the unsettled end is held back.
"""

from __future__ import annotations

import bisect
import codecs
import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
#: Fixed value: the published pattern that cuts a text into words before byte-level merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self._set(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    @classmethod
    def of(cls, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None) -> MergeTable:
        self = cls.__new__(cls)
        self._set(vocab, merges, added or {})
        return self

    def _set(self, vocab: dict[str, int], merges: list, added: dict[str, int]) -> None:
        alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(alphabet)}
        self.byte_id = np.array([vocab.get(c, -1) for c in alphabet], dtype=np.int32)
        self.bytes_of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_of.update({i: t.encode() for t, i in added.items()})
        self.sizes = np.zeros(max(self.bytes_of, default=0) + 1, np.int64)
        self.sizes[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.added = added
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self._hashed()

    def _hashed(self) -> None:
        """Pairs in an open-addressed table, for lookups of many pairs at once."""
        bits = max(4, len(self.pairs).bit_length() + 2)
        self._mask, self._shift = np.int64(2**bits - 1), np.uint64(64 - bits)
        self._multiplier = np.uint64(0x9E3779B97F4A7C15)
        self._keys = np.full(2**bits, self._empty)
        self._rank, self._made = np.full(2**bits, NONE, np.int32), np.zeros(2**bits, np.int32)
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.uint64)
        for key, slot, (rank, made) in zip(keys, ((keys * self._multiplier) >> self._shift).tolist(), self.pairs.values()):
            while self._keys[slot] != self._empty:
                slot = slot + 1 & int(self._mask)
            self._keys[slot], self._rank[slot], self._made[slot] = key, rank, made

    _empty = np.uint64(2**64 - 1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the two don't merge) and merged token of each pair."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = ((key * self._multiplier) >> self._shift).astype(np.int64)
        there = self._keys[slot]
        hit = there == key
        on = np.flatnonzero(~hit & (there != self._empty))
        while len(on):
            slot[on] = slot[on] + 1 & self._mask
            there = self._keys[slot[on]]
            same = there == key[on]
            hit[on[same]] = True
            on = on[~same & (there != self._empty)]
        return np.where(hit, self._rank[slot], NONE), self._made[slot]

    @functools.cached_property
    def lookahead(self) -> int:
        """Bytes after a boundary that suffice to settle it.

        Whether merge r = (a, b) takes place after a depends on whether b forms there undisturbed. It is disturbed only if
        some token c at b's right edge (b itself, its right part, that one's right part, ...) is taken by a merge (c, d) of
        lower rank than the merge that would have taken c into b (or b into r). That merge in turn depends on d, by merges of
        lower rank still. So need(r) = |b| + max need(c, d) over such merges, and ranks fall along the chain, which makes
        this a pass over the merges in rank order.
        """
        parts = {made: (pair, rank) for pair, (rank, made) in self.pairs.items()}
        ranks: dict[int, list[int]] = {}
        needs: dict[int, list[int]] = {}
        most = 0
        for (a, b), (rank, _) in sorted(self.pairs.items(), key=lambda x: x[1][0]):
            need, c, limit = 0, b, rank
            while True:
                if c in ranks and (k := bisect.bisect_left(ranks[c], limit)):
                    need = max(need, needs[c][k - 1])
                if c not in parts:
                    break
                (_, right), limit = parts[c]
                c = right
            need += len(self.bytes_of[b])
            most = max(most, need)
            ranks.setdefault(a, []).append(rank)
            needs.setdefault(a, []).append(max(need, needs[a][-1] if needs.get(a) else 0))
        return most + max((len(self.bytes_of[i]) for i in self.bytes_of), default=1)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the words, and where each word's tokens begin and how many they are.

        Words of like length are merged together, a merge of each word at a time.
        """
        size = np.zeros(len(words), np.int64)
        blocks: list[np.ndarray] = []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        start = 0
        while start < len(order):
            width = int(lengths[order[start]])
            end = min(int(np.searchsorted(lengths[order], width + max(2, width // 8), "right")), start + max(1, 400_000 // (width + 8)))
            chosen = order[start:end]
            tokens, size[chosen] = self._merge_block([words[i] for i in chosen.tolist()], lengths[chosen])
            blocks.append(tokens)
            start = end
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(blocks) if blocks else np.empty(0, np.int32), begin, size

    def _merge_block(self, words: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, wide = len(words), int(n.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        inside = np.arange(wide)[None, :] < n[:, None]
        tokens = np.full((m, wide + 1), -1, np.int32)
        tokens[:, :wide][inside] = self.byte_id[flat]
        after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int32), (m, 1))
        rank = np.full((m, wide + 1), NONE, np.int32)
        made = np.zeros((m, wide + 1), np.int32)
        r, c = np.nonzero(np.arange(wide)[None, :] < n[:, None] - 1)
        rank[r, c], made[r, c] = self.look_up(tokens[r, c], tokens[r, c + 1])
        live = np.arange(m)
        while len(live):
            at = rank[live].argmin(axis=1)  # the leftmost of the best
            go = rank[live, at] < NONE
            live, at = live[go], at[go]
            if not len(live):
                break
            gone = after[live, at]
            nxt = after[live, gone]
            tokens[live, at], tokens[live, gone] = made[live, at], -1
            after[live, at], rank[live, gone] = nxt, NONE
            has_next = nxt < n[live]
            x, p, q = live[has_next], at[has_next], nxt[has_next]
            before[x, q] = p
            rank[live, at] = NONE
            rank[x, p], made[x, p] = self.look_up(tokens[x, p], tokens[x, q])
            prev = before[live, at]
            has_prev = prev >= 0
            x, p, q = live[has_prev], prev[has_prev], at[has_prev]
            rank[x, p], made[x, p] = self.look_up(tokens[x, p], tokens[x, q])
        keep = tokens >= 0
        return tokens[keep], keep.sum(axis=1)

    def merge_window(self, data: bytes) -> list[int]:
        """Tokens of one window, by a heap of the pairs that can merge."""
        tokens = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n = len(tokens)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(hit[0], i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (hit := self.pairs.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != left or j >= n or tokens[j] != right:
                continue
            tokens[i], tokens[j] = self.pairs[left, right][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if hit := self.pairs.get((tokens[i], tokens[k])):
                    heapq.heappush(heap, (hit[0], i, tokens[i], tokens[k]))
            if (h := before[i]) >= 0 and (hit := self.pairs.get((tokens[h], tokens[i]))):
                heapq.heappush(heap, (hit[0], h, tokens[h], tokens[i]))
        return [t for t in tokens if t >= 0]


def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` with these begins and sizes, one after the other."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return pool[np.arange(total) + np.repeat(begin - (stop - size), size)]


class Transducer:
    """Bytes in, tokens out as soon as they are stable.

    ``feed`` and ``finish`` serve one open word, of which at most one window and what one call feeds are held. ``run`` takes whole
    words, a lane for each: all lanes read a window, emit what is stable in it (everything, where the word ends there) and go on
    behind it. ``emitted`` counts tokens.
    """

    def __init__(self, table: MergeTable, window: int | None = None):
        self.table, self.held, self.emitted = table, b"", 0
        self.window = max(window or 0, 4 * table.lookahead)

    def _stable(self, tokens: np.ndarray, read: int) -> tuple[int, int]:
        """How many tokens of a full window are stable, and how many bytes they are."""
        ends = np.cumsum(self.table.sizes[tokens])
        n = int(np.searchsorted(ends, read - self.table.lookahead, "right"))
        return n, int(ends[n - 1]) if n else 0

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        out: list[int] = []
        while len(self.held) > self.window:
            tokens = self.table.merge_window(self.held[: self.window])
            n, size = self._stable(np.array(tokens, np.int64), self.window)
            out += tokens[:n]
            self.held = self.held[size:]
        self.emitted += len(out)
        return out

    def finish(self) -> list[int]:
        out = self.table.merge_window(self.held)
        self.held = b""
        self.emitted += len(out)
        return out

    def run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the words, and where each word's tokens begin and how many they are."""
        first = self.table.merge_many([w[: self.window] for w in words])
        long = [i for i, w in enumerate(words) if len(w) > self.window]
        if not long:
            self.emitted += int(first[2].sum())
            return first
        tokens, begin, size = first
        lanes = {i: [] for i in long}
        at = dict.fromkeys(long, 0)
        step = {i: tokens[begin[i] : begin[i] + size[i]] for i in long}
        while step:
            for i, made in step.items():
                n, skip = self._stable(made, self.window) if len(words[i]) - at[i] > self.window else (len(made), len(words[i]) - at[i])
                lanes[i].append(made[:n])
                at[i] += skip
            on = [i for i in step if at[i] < len(words[i])]
            made, b, n = self.table.merge_many([words[i][at[i] : at[i] + self.window] for i in on])
            step = {i: made[b[k] : b[k] + n[k]] for k, i in enumerate(on)}
        pieces = [np.concatenate(lanes[i]) if i in lanes else tokens[begin[i] : begin[i] + size[i]] for i in range(len(words))]
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.emitted += int(size.sum())
        return np.concatenate(pieces), np.cumsum(size) - size, size


class StreamDecoder:
    """Token ids in, text out; bytes that don't yet complete a character are held back, ill-formed ones become U+FFFD."""

    def __init__(self, table: MergeTable):
        self.bytes_of, self.state = table.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        got = self.bytes_of.get
        return self.state.decode(b"".join([got(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


@functools.cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    # All but the surrogates, which are none of these, decoded at once: a list of the characters would take 100 MB in every worker.
    points = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")])
    text = points.tobytes().decode("utf-32-le")
    out = np.full(len(text), 3, np.uint8)
    for kind, pattern in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for match in regex.finditer(pattern, text):
            out[match.start() : match.end()] = kind
    return np.insert(out, 0xD800, np.full(0x800, 3, np.uint8))


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where words begin in code points, as ``WORDS`` cuts them, with texts beginning at ``begins``."""
    n = len(points)
    kind = _kinds()[points]
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    space = kind == 0
    same = np.zeros(n, bool)  # goes on as the one before
    same[1:] = (kind[1:] == kind[:-1]) & ~first[1:n]
    start = ~same
    blank = points == 32
    # The last white space before a word stands alone; a blank goes with the word.
    last = space.copy()
    last[:-1] &= ~space[1:]
    last &= ~first[1:]
    start |= last
    start[1:] &= ~((blank & last)[:-1] & ~space[1:])
    # Contractions, where the apostrophe begins a word of its own.
    mark = np.flatnonzero((points == 39) & start)
    if len(mark):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[mark + 1], padded[mark + 2]
        # Within one text only.
        has_one, has_two = ~first[np.minimum(mark + 1, n)], ~first[np.minimum(mark + 2, n)] & ~first[np.minimum(mark + 1, n)]
        short = np.isin(one, [ord(c) for c in "stmd"]) & has_one
        long = ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & has_two
        start[mark[short | long] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[after[after < n]] = True
    return np.flatnonzero(start)


class WordMemo:
    """Tokens of words by a hash of their bytes, in numpy arrays; the bytes are kept and compared."""

    def __init__(self, bits: int = 20):
        self.keys, self.slot_of = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.pool, self.used = np.empty(1 << 18, np.int32), 0
        self.text, self.text_used = np.empty(1 << 18, np.uint8), 0
        self.begin, self.size, self.text_begin, self.text_size = (np.zeros(1 << 16, np.int64) for _ in range(4))
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it isn't there."""
        at = (keys >> self.shift).astype(np.int64)
        slots = self.slot_of[at]
        on = np.flatnonzero((slots >= 0) & (self.keys[at] != keys))
        while len(on):
            at[on] = at[on] + 1 & self.mask
            slots[on] = self.slot_of[at[on]]
            on = on[(slots[on] >= 0) & (self.keys[at[on]] != keys[on])]
        return slots.astype(np.int64)

    def add(self, keys: np.ndarray, words: list[bytes], tokens: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Put in words with distinct keys that aren't there yet."""
        n, m = self.n, len(words)
        text = np.frombuffer(b"".join(words), np.uint8)
        tokens = gathered(tokens, begin, size)
        while self.used + len(tokens) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.text_used + len(text) > len(self.text):
            self.text = np.concatenate([self.text, np.empty_like(self.text)])
        while n + m > len(self.begin):
            for name in ("begin", "size", "text_begin", "text_size"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        lengths = np.fromiter(map(len, words), np.int64, m)
        self.pool[self.used : self.used + len(tokens)] = tokens
        self.text[self.text_used : self.text_used + len(text)] = text
        self.begin[n : n + m], self.size[n : n + m] = self.used + np.cumsum(size) - size, size
        self.text_begin[n : n + m], self.text_size[n : n + m] = self.text_used + np.cumsum(lengths) - lengths, lengths
        self.used, self.text_used, self.n = self.used + len(tokens), self.text_used + len(text), n + m
        at, left = (keys >> self.shift).astype(np.int64), np.arange(m)
        while len(left):
            free = self.slot_of[at[left]] < 0
            spot, which = np.unique(at[left[free]], return_index=True)
            taken = left[free][which]
            self.slot_of[spot], self.keys[spot] = n + taken, keys[taken]
            left = np.setdiff1d(left, taken, assume_unique=True)
            stuck = left[self.slot_of[at[left]] >= 0]
            at[stuck] = at[stuck] + 1 & self.mask


class Encoder:
    """Encodes batches of texts. Words are cut, hashed and looked up in numpy; the tokens that ``machine`` emitted for words of at most
    SHORT bytes are remembered, of at most about ``limit`` words. Texts over ``chunk`` characters are read in chunks."""

    SHORT = 256

    def __init__(self, table: MergeTable, limit: int = 350_000, chunk: int = 1 << 19):
        self.table, self.limit, self.chunk, self.memo, self.machine = table, limit, chunk, WordMemo(), Transducer(table)
        self._added = re.compile("|".join(map(re.escape, sorted(table.added, key=len, reverse=True)))) if table.added else None
        self._powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64),) * 2

    def _word_keys(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each word, for the memo, which compares the words themselves."""
        if len(self._powers[0]) <= len(raw):
            n = max(1 << 20, len(raw) + 1)
            self._powers = tuple(_power_table(base, n) for base in (HASH_BASE, pow(HASH_BASE, -1, 2**64)))
        up, down = self._powers
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        x = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the texts, and where each text's tokens end."""
        if not (self._added and any(map(self._added.search, texts))):
            return self._plain(texts)
        # Added tokens are cut out first; what lies between is encoded on its own.
        segments, plan = [], []
        for text in texts:
            at, own = 0, []
            for match in self._added.finditer(text):
                segments.append(text[at : match.start()])
                own += [len(segments) - 1, -1 - self.table.added[match.group()]]
                at = match.end()
            segments.append(text[at:])
            plan.append([*own, len(segments) - 1])
        ids, ends = self._plain(segments)
        begins = np.concatenate([[0], ends[:-1]])
        rows = [np.concatenate([ids[begins[p] : ends[p]] if p >= 0 else np.array([-1 - p], np.int32) for p in own]) for own in plan]
        return np.concatenate(rows), np.cumsum([len(r) for r in rows])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(len(t) > self.chunk for t in texts):
            parts = [self._streamed(t) if len(t) > self.chunk else self._plain([t])[0] for t in texts]
            return np.concatenate(parts), np.cumsum([len(p) for p in parts])
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.concatenate([[0], text_ends[:-1]])
        data = joined.encode("utf-8")
        raw, points = _points(joined, data)
        starts = word_starts(points, begins[begins < len(points)])
        begin = _byte_places(raw, points, starts)
        out, size = self._words(data, raw, begin, np.append(begin[1:], len(raw)))
        return out, np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, text_ends)]

    def _streamed(self, text: str) -> np.ndarray:
        """Tokens of one text, chunk by chunk. Where a word begins is settled once two more words have begun behind it; a word longer
        than a chunk is fed to a machine of its own."""
        out: list[np.ndarray] = []
        at, open_word = 0, None
        while at < len(text):
            piece = text[at : at + self.chunk]
            final = at + len(piece) == len(text)
            data = piece.encode("utf-8")
            raw, points = _points(piece, data)
            starts = word_starts(points, np.zeros(1, np.int64))
            if not final and len(starts) == 1:
                open_word = open_word or Transducer(self.table)
                out.append(np.array(open_word.feed(piece[:-4].encode("utf-8")), np.int32))
                at += len(piece) - 4
                continue
            settled = len(starts) if final else max(1, len(starts) - 3)
            begin = _byte_places(raw, points, starts)
            end = np.append(begin[1:], len(raw))[:settled]
            begin = begin[:settled]
            if open_word is not None:
                out.append(np.array([*open_word.feed(data[: end[0]]), *open_word.finish()], np.int32))
                self.machine.emitted += open_word.emitted
                begin, end, open_word = begin[1:], end[1:], None
            if len(begin):
                out.append(self._words(data, raw[: end[-1]], begin, end)[0])
            at = len(text) if final else at + int(starts[settled])
        return np.concatenate(out)

    def _words(self, data: bytes, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of words that follow each other up to the end of ``raw``, and how many each has."""
        if self.memo.n > self.limit:
            self.memo = WordMemo()
        memo, lengths = self.memo, end - begin
        keys = self._word_keys(raw, begin, end)
        slots = memo.find(keys)
        unknown = np.flatnonzero(slots < 0)
        if len(unknown):
            fresh, which = np.unique(keys[unknown], return_index=True)
            which = unknown[which]
            brief = lengths[which] <= self.SHORT
            fresh, which = fresh[brief], which[brief]
            words = [data[a:b] for a, b in zip(begin[which].tolist(), end[which].tolist())]
            memo.add(fresh, words, *self.machine.run(words))
            slots[unknown] = memo.find(keys[unknown])
        # What is remembered must be the very word.
        held = np.flatnonzero(slots >= 0)
        same = memo.text_size[slots[held]] == lengths[held]
        slots[held[~same]] = -1
        held = held[same]
        odd = np.flatnonzero(gathered(memo.text, memo.text_begin[slots[held]], lengths[held]) != gathered(raw, begin[held], lengths[held]))
        slots[held[np.unique(np.searchsorted(np.cumsum(lengths[held]), odd, "right"))]] = -1
        size = np.where(slots >= 0, memo.size[slots], 0)
        lone = np.flatnonzero(slots < 0)
        known = slots >= 0
        if not len(lone):
            return gathered(memo.pool, memo.begin[slots], size), size
        tokens, first, size[lone] = self.machine.run([data[a:b] for a, b in zip(begin[lone].tolist(), end[lone].tolist())])
        out = np.empty(int(size.sum()), np.int32)
        of_known = np.repeat(known, size)
        out[of_known] = gathered(memo.pool, memo.begin[slots[known]], size[known])
        out[~of_known] = gathered(tokens, first, size[lone])
        return out, size


def _points(text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and code points of a text."""
    raw = np.frombuffer(data, np.uint8)
    return raw, raw if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _byte_places(raw: np.ndarray, points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where code points begin in bytes."""
    if points is raw:
        return at
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    return (np.cumsum(width) - width)[at]


HASH_BASE = 0x9E3779B97F4A7C15


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One encoder a Python worker, kept from task to task."""
    return Encoder(MergeTable(path))


def text_runs(texts: list[str], most_chars: int = 1 << 19) -> Iterator[list[str]]:
    """Successive texts together up to ``most_chars``, so that the working arrays stay small."""
    run: list[str] = []
    chars = 0
    for text in texts:
        if run and chars + len(text) > most_chars:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def encoded(path: str, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Tokens of each text, null as empty."""
    encoder = _encoder(path)
    for run in text_runs(["" if t is None else t for t in texts]):
        ids, ends = encoder.batch(run)
        begin = 0
        for end in ends.tolist():
            yield ids[begin:end]
            begin = end


def encode(text: Column | str, path: str) -> Column:
    """Token ids (array<int>) of a text column; null and empty texts give an empty array."""

    @F.pandas_udf("array<int>")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encoded(path, texts)), dtype=object)

    return bpe_encode(text)


def decode(ids: Column | str, path: str) -> Column:
    """Text of a token id column; null and empty arrays give an empty text, unknown ids are skipped."""

    @F.pandas_udf("string")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _encoder(path).table
        for rows in batches:
            out = []
            for row in rows:
                machine, parts = StreamDecoder(table), []
                for i in range(0, 0 if row is None else len(row), 65536):
                    parts.append(machine.feed(row[i : i + 65536].tolist() if isinstance(row, np.ndarray) else row[i : i + 65536]))
                out.append("".join([*parts, machine.finish()]))
            yield pd.Series(out, dtype=object)

    return bpe_decode(ids)


def transcoded(path: str, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, str]]:
    """Token ids of each text and their decoding, by both machines, for use within a task."""
    table = _encoder(path).table
    for ids in encoded(path, texts):
        machine = StreamDecoder(table)
        parts = [machine.feed(ids[i : i + 65536].tolist()) for i in range(0, len(ids), 65536)]
        yield ids, "".join(parts) + machine.finish()


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` added (a column of that name is replaced)."""
    return docs.withColumn(ids_col, encode(F.col(text_col), path))
