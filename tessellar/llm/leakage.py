"""Evaluation texts inside training documents, found by an FM-index over each shard of the documents."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_SYMBOLS = 400_000
SEED_WORDS = 4
MIN_WORDS = 15
WORDS_AN_EDIT = 6
BLOCK_MB = 32
KNOWN_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")
# Scripts that put no blanks between words: each of their characters counts as a word.
_DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_HAS_DENSE = re.compile(f"[{_DENSE}]")
_DENSE_WORD = re.compile(f"[{_DENSE}]|(?:(?![{_DENSE}])[^\\W_])+")
# Invisible characters and soft breaks that may stand inside a word.
_INVISIBLE = dict.fromkeys([0xAD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)])
END, SEPARATOR, OTHER, FIRST = 0, 1, 2, 3


def words(text: str) -> list[str]:
    """The words without regard to case, punctuation, spacing, layout marks, compatibility forms and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
        if _HAS_DENSE.search(text):
            return _DENSE_WORD.findall(text.lower())
    return _WORD.findall(text.lower())


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end of each of ``words(text)`` in the original text."""
    chars, at = [], []
    for i, c in enumerate(text):
        if ord(c) in _INVISIBLE:
            continue
        for x in unicodedata.normalize("NFKC", c).lower():
            chars.append(x)
            at.append(i)
    whole = "".join(chars)
    pattern = _DENSE_WORD if _HAS_DENSE.search(whole) else _WORD
    return [(at[m.start()], at[m.end() - 1] + 1) for m in pattern.finditer(whole)]


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Start positions in suffix order, by prefix doubling from a packed first key."""
    n = len(text)
    bits = max(int(sigma).bit_length(), 1)
    width = max(62 // bits, 1)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(width, np.int64)])
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(key, kind="stable" if width == 0 else None)
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]) if n else order
        if not n or rank[order[-1]] == n - 1:
            return order
        shifted = np.zeros(n, np.int64)
        if width < n:
            shifted[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + shifted
        width *= 2


class WaveletMatrix:
    """Rank of any symbol before any position; one bit row and its running counts a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(int(sigma - 1).bit_length(), 1)
        self.ones, self.zeros = [], []
        row = symbols
        for level in range(self.levels):
            bit = (row >> (self.levels - 1 - level)) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(row) - self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        lo, hi = np.zeros_like(at), at
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            a, b = ones[lo], ones[hi]
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Backward search and location in one shard's symbols."""

    STEP = 8

    def __init__(self, text: np.ndarray, sigma: int):
        """text must not hold END, which is put behind it: only with an end of its own does each step back hit its row."""
        text = np.append(text, END)
        order = suffix_array(text, sigma)
        self.n, self.bwt = len(text), text[order - 1].astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = WaveletMatrix(self.bwt, sigma)
        sampled = order % self.STEP == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-order range of each phrase (rows of equal length), all searched at once from their last words."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for i in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, i]
            lo, hi = self.before[c] + self.wavelet.rank(c, lo), self.before[c] + self.wavelet.rank(c, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows in suffix order, walked back to the next sampled one."""
        rows = rows.copy()
        result = np.full(len(rows), -1, np.int64)
        walked, active = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(self.STEP):
            r = rows[active]
            hit = self.sampled[r]
            done = active[hit]
            result[done] = self.positions[self.sample_rank[r[hit]]] + walked[done]
            active = active[~hit]
            c = self.bwt[rows[active]]
            rows[active] = self.before[c] + self.wavelet.rank(c, rows[active])
            walked[active] += 1
        return result


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Vocabulary:
    """Ids of the words that any item holds, by a sorted array of 64-bit hashes: eight bytes a distinct word."""

    def __init__(self, texts: Iterable[str]):
        found: set[str] = set()
        for t in texts:
            found.update(words(t))
        self.hashes = np.unique(np.fromiter((word_hash(w) for w in found), np.uint64, len(found)))
        self.sigma = len(self.hashes) + FIRST

    def finder(self) -> Callable[[list[str]], np.ndarray]:
        """Words to ids, OTHER for those no item has; the words met last are kept."""
        known: dict[str, int] = {}

        def ids(found: list[str]) -> np.ndarray:
            out = list(map(known.get, found))
            if None in out:
                if len(known) > KNOWN_WORDS:
                    known.clear()
                fresh = list({w for w in found if w not in known})
                h = np.fromiter((word_hash(w) for w in fresh), np.uint64, len(fresh))
                at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
                hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
                known.update(zip(fresh, np.where(hit, at + FIRST, OTHER).tolist(), strict=True))
                out = list(map(known.__getitem__, found))
            return np.array(out, np.int32)

        return ids


class Items:
    """A block of test items in arrays: their words' ids one after another, the distinct phrases of ``seed`` words with
    their places, and the items too short for a phrase of that length."""

    def __init__(self, items: list[tuple[int, str]], vocabulary: Vocabulary, seed: int = SEED_WORDS):
        find, rows = vocabulary.finder(), []
        for _, t in items:
            rows.append(find(words(t)))
        self.ids = np.array([i for i, _ in items], np.int64)
        lengths = np.array([len(r) for r in rows], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.text = np.concatenate([*rows, np.empty(0, np.int32)])
        self.seed = seed
        self.phrases: dict[int, np.ndarray] = {}  # by length
        self.first: dict[int, np.ndarray] = {}  # of each phrase, where its places begin
        self.places: dict[int, np.ndarray] = {}  # places in text, phrase after phrase
        for n in range(1, seed + 1):
            which = np.flatnonzero(lengths >= seed if n == seed else lengths == n)
            at = np.concatenate([np.arange(self.starts[k], self.starts[k + 1] - n + 1) for k in which]) if len(which) else np.empty(0, np.int64)
            if len(at):
                rank = np.zeros(len(at), np.int64)  # the same number for the same phrase, word by word
                for i in range(n):
                    rank = np.unique(rank * (vocabulary.sigma + 1) + self.text[at + i], return_inverse=True)[1]
                order = np.argsort(rank, kind="stable")
                first = np.flatnonzero(np.diff(rank[order], prepend=-1))
                self.first[n] = np.append(first, len(at))
                self.places[n] = at[order].astype(np.int32 if len(self.text) < 1 << 31 else np.int64)
                self.phrases[n] = np.stack([self.text[at[order[first]] + i] for i in range(n)], axis=1).astype(np.int32)

    def words_of(self, k: int) -> list[int]:
        return self.text[self.starts[k] : self.starts[k + 1]].tolist()

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.ids, self.starts, self.text, *self.phrases.values(), *self.first.values(), *self.places.values()))


def _runs(hits: list[tuple[int, int]], seed: int) -> list[list[int]]:
    """[start, end, shift] of maximal exact runs from (word place, item place) seeds."""
    by_shift: dict[int, list[int]] = defaultdict(list)
    for w, p in hits:
        by_shift[p - w].append(w)
    runs = []
    for shift, places in by_shift.items():
        places.sort()
        start, last = places[0], places[0]
        for w in places[1:]:
            if w > last + seed:
                runs.append([start, last + seed, shift])
                start = w
            last = w
        runs.append([start, last + seed, shift])
    return sorted(runs)


def _reach(doc: list[int], item: list[int], w: int, p: int, step: int, most: int) -> list[tuple[int, int]]:
    """How far a match goes on from word w and item place p: for 0, 1, .. ``most`` words altered, missing or added, the item's
    and the document's words that can be passed at best (furthest-reaching points of each diagonal).

    What is reached by an alteration ends in at least two matching words. Stops when two more alterations match nothing.
    """
    room_w, room_p = (len(doc) - w, len(item) - p) if step > 0 else (w + 1, p + 1)

    def slide(dp: int, dw: int) -> int:
        n = 0
        while dp + n < room_p and dw + n < room_w and doc[w + (dw + n) * step] == item[p + (dp + n) * step]:
            n += 1
        return n

    far = slide(0, 0)
    reached, at, idle = [(far, far)], {0: far}, 0
    for e in range(1, most + 1):
        best, after, top = reached[-1], {}, max(at.values())
        for k in range(-e, e + 1):  # k words more of the document than of the item
            dp = max(at.get(k, -2) + 1, at.get(k + 1, -2) + 1, at.get(k - 1, -2))
            if dp < 0 or dp > room_p or not 0 <= dp + k <= room_w:
                continue
            n = slide(dp, dp + k)
            after[k] = dp + n
            if n >= 2 and dp + n > best[0]:
                best = (dp + n, dp + n + k)
        if not after:
            break
        reached.append(best)
        idle = idle + 1 if max(after.values()) <= top + 1 else 0
        if idle == 2:
            break
        at = after
    return reached


def edits_allowed(span: int) -> int:
    """Words that may be altered, missing or added in a passage of so many words.

    One in WORDS_AN_EDIT; fewer in short items, so that whatever is allowed leaves SEED_WORDS words in a row untouched:
    with e alterations the longest untouched run has at least (span - e) / (e + 1) words, rounded up.
    """
    return 0 if span < 8 else 1 if span < 12 else (span + 2) // WORDS_AN_EDIT


def passages(doc: list[int], item: list[int], hits: list[tuple[int, int]], seed: int, least: int) -> list[tuple[int, int]]:
    """Word ranges of the document that hold a passage of at least ``least`` of the item's words (or all it has).

    The exact check of the index's finds: runs are stretched both ways over altered, missing or added words, as many as
    ``edits_allowed`` for the span; of all ways the longest span is taken. Sentences built alike have more alterations.
    """
    least = min(least, len(item))
    most = edits_allowed(len(item))
    found: list[tuple[int, int]] = []
    reached = -1
    for start, end, shift in _runs(hits, seed):
        if end <= reached:
            continue
        n = end - start
        later = _reach(doc, item, end, end + shift, 1, most)
        earlier = _reach(doc, item, start - 1, start + shift - 1, -1, most)
        if n + later[-1][0] + earlier[-1][0] < least:
            continue
        best = max(((n + a[0] + b[0], -x - y, a[1], b[1]) for x, a in enumerate(earlier) for y, b in enumerate(later) if x + y <= edits_allowed(n + a[0] + b[0])), default=(0,))
        if best[0] >= least:
            found.append((start - best[2], end + best[3]))
            reached = end + best[3]
    return found


class Shard:
    """Documents gathered until they are large enough for an index, which every block of items is searched in."""

    def __init__(self, vocabulary: Vocabulary, least: int = MIN_WORDS):
        self.vocabulary, self.least = vocabulary, least
        self.find = vocabulary.finder()
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int, str, int]] = []
        self.symbols: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, text: str) -> None:
        ids = self.find(words(text))
        if not len(ids):
            return
        # a stretch of words that no item has is one symbol; the words' own places are kept beside
        keep = np.flatnonzero((ids != OTHER) | np.concatenate([[True], ids[:-1] != OTHER]))
        self.symbols += [ids[keep], np.full(1, SEPARATOR, np.int32)]
        self.words += [keep.astype(np.int32), np.array([-1], np.int32)]
        self.docs.append((doc_id, text, self.size))
        self.size += len(keep) + 1

    def search(self, blocks: Iterable[Items]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(place among the documents, item, word ranges) of each leak."""
        if not self.docs:
            return
        text = np.concatenate(self.symbols)
        places = np.concatenate(self.words)
        starts = np.array([d[2] for d in self.docs], np.int64)
        ends = [*starts[1:].tolist(), self.size]
        index = FMIndex(text, self.vocabulary.sigma)

        @lru_cache(maxsize=64)
        def whole(d: int) -> list[int]:
            a, b = int(starts[d]), ends[d] - 1
            out = np.full(int(places[b - 1]) + 2, OTHER, np.int64)
            out[places[a:b]] = text[a:b]
            return out.tolist()

        for items in blocks:
            for n, phrases in items.phrases.items():
                lo, hi = index.search(phrases)
                held = np.flatnonzero(hi > lo)
                if not len(held):
                    continue
                counts = (hi - lo)[held]
                phrase = np.repeat(held, counts)
                rows = np.repeat(lo[held], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                position = index.locate(rows)
                doc = np.searchsorted(starts, position, "right") - 1
                of = items.first[n][phrase + 1] - items.first[n][phrase]  # places of the phrase in the items
                found = items.places[n][np.repeat(items.first[n][phrase], of) + np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)]
                item = np.searchsorted(items.starts, found, "right") - 1
                doc, word = np.repeat(doc, of), np.repeat(places[position], of)
                place = found - items.starts[item]
                order = np.lexsort((word, item, doc))
                doc, item, word, place = doc[order], item[order], word[order], place[order]
                cuts = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(item, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=True):
                    d, k = int(doc[a]), int(item[a])
                    if n < items.seed:  # an item shorter than a seed, held whole
                        ranges = [(w, w + n) for w in word[a:b].tolist()]
                    else:
                        ranges = passages(whole(d), items.words_of(k), list(zip(word[a:b].tolist(), place[a:b].tolist(), strict=True)), n, self.least)
                    if ranges:
                        yield d, int(items.ids[k]), ranges


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_id: str, item_text: str, block_mb: float) -> Iterator[list[tuple[int, str]]]:
    texts, size = [], 0
    for r in items.where(F.col(item_text).isNotNull()).select(item_id, item_text).toLocalIterator():
        texts.append((r[0], r[1]))
        size += len(r[1])
        if size > block_mb * (1 << 20):
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def leaks(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = MIN_WORDS, shard: int = SHARD_SYMBOLS, block_mb: float = BLOCK_MB, by_item: bool = True
) -> DataFrame:
    """doc_id, item_id, start_pos, end_pos: every passage of at least ``least`` of an item's words in a document; without
    ``by_item`` the removal spans: doc_id, start_pos, end_pos, merged over all items of a document.

    Each task indexes its own documents, shard after shard (an FM-index of about ``shard`` words; a longer document is a
    shard by itself), and searches all phrases of SEED_WORDS words of all items in it at once; the finds are checked word
    by word and merged into removal spans. One narrow pass: no shuffle, and memory is bounded by the shard and a block of
    items. Letter case, punctuation, spacing, layout marks and invisible characters don't matter; words may be altered,
    missing or added as ``edits_allowed`` says, and every passage within that holds a phrase, so none is missed. In
    scripts without blanks each character is a word. An item of under ``least`` words must be held whole; an item shorter
    than a phrase is searched for as it is. Items without words, and null texts, match nothing. Equal documents under
    other ids each give their rows; items of equal text too. Words are compared by 64-bit hashes.

    The items are broadcast as arrays, about seven times the text, in blocks of ``block_mb`` of text, which bounds what a task
    loads at a time; every block is searched in the one index of a shard.
    """
    context = documents.sparkSession.sparkContext
    vocabulary = Vocabulary(t for block in _blocks(items, item_id, item_text, block_mb) for _, t in block)
    shared = [context.broadcast(Items(block, vocabulary)) for block in _blocks(items, item_id, item_text, block_mb)]
    words_of_items = context.broadcast(vocabulary)
    schema = "doc_id long, item_id long, start_pos int, end_pos int" if by_item else "doc_id long, start_pos int, end_pos int"
    types = [pa.int64(), *([pa.int64()] if by_item else []), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in schema.split(", ")]

    def load(block: Broadcast) -> Items:
        """A lone block stays in the worker; of several only the one in use is held."""
        if len(shared) == 1:
            return block.value
        value = block.value
        block.__dict__.pop("_value", None)
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = Shard(words_of_items.value, least)

        def flush() -> pa.RecordBatch:
            spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
            for d, item, ranges in current.search(map(load, shared)):
                spans[d, item if by_item else 0] += ranges
            at: dict[int, list[tuple[int, int]]] = {}
            rows = []
            for (d, item), ranges in sorted(spans.items()):
                doc_id, text, _ = current.docs[d]
                if d not in at:
                    at = {d: word_places(text)}
                rows += [(doc_id, *([item] if by_item else []), at[d][a][0], at[d][b - 1][1]) for a, b in merged(ranges)]
            current.clear()
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    current.add(doc_id, text)
                    if current.size >= shard:
                        yield flush()
        if current.docs:
            yield flush()

    return documents.select(id_col, text_col).mapInArrow(run, schema)
