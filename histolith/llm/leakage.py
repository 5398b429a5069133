"""Evaluation texts leaking into training text.

A document carries an item if it holds ``LEAST`` words of it in one or two *stretches*, up to one word in eight of each differing. A
stretch is a run of ``RUN`` equal words or more, extended to both sides over any words that differ, are missing or are inserted (edits) up to
another equal word; edits are at most one in eight of its words, of which it has ``STRETCH`` or more. Each word of an item and of a document counts once, words of stock
sentences don't count, and the two stretches may stand in any order. One of two stretches has ``LEAST / 2`` words, so documents and items meet by
windows of that size:

1. *Words*: case, punctuation, markup, invisible characters and layout are dropped; words become numbers of the items'
   vocabulary (0: in no item). A document without enough known words can't carry an item and is left out, exactly.
2. *Stock sentences*: sentences of items that many different texts hold out of the item's context are counted over all documents and masked. A text
   that goes on as the item does, on either side of the sentence, is a leak and doesn't make it stock; copies of a text count once.
   A short stretch also needs a run of ``RUN`` words that few texts hold outside of a longer equal part, or it is a common phrase.
3. *Embedding*: the CGK random walk writes a window of w words as 3 w symbols, staying on a word or moving on by a random bit of
   (step, word), so that few word edits become few differing symbols (Hamming distance). Windows without a run of ``RUN`` words of any item
   are skipped: a window of two edits has one.
4. *Bit sampling*: under each of ``WALKS`` walks, ``SAMPLES`` samples of ``BITS`` positions are keys; windows that
   share a key and are within ``NEAR`` edits admit their pair of document and item. One met window is enough, if the document's runs of
   ``RUN`` words cover enough words of the item for a case at all (a proven bound).
5. *Verification*: every run of ``RUN`` words that document and item share is extended as far as 0, 1, ... ``EDITS`` edits allow, exactly (the furthest
   cell of each diagonal of the edit matrix), and the best one or two stretches are taken. ``EDITS`` edits of a stretch are enough to decide: a
   longer passage has a part with fewer that is a case itself.

Items are the query set: they are taken in blocks of ``ITEM_BLOCK`` and held by every task; documents are encoded once and never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from histolith.session import spread, written

LEAST, DIFFER = 24, 8
WINDOW = LEAST // 2
WALKS, SAMPLES, BITS = 6, 4, 9
#: Most edits between a window of a document and of an item that admit a pair: a passage has a window with two or less, and an
#: insertion costs a window one more at its end.
NEAR = 4
#: Equal words in a row that every stretch has, and every window of up to two edits: 7 words in two runs, 14 or 10 in three.
RUN = 4
#: Items that a task holds at a time.
ITEM_BLOCK = 1000
#: A stretch has at least so many words: the least of which one in eight may differ.
STRETCH = 8
#: Edits of the best stretches. A passage of 64 words or more can be halved, and one half is no worse, so fewer than 64 / DIFFER decide.
EDITS = 7
#: A sentence is stock if more than one text in STOCK_SHARE holds it, and STOCK_LEAST or more do.
STOCK_SHARE, STOCK_LEAST = 100, 4
#: A stretch under PHRASE words counts only with a run of RUN words that at most one text in PHRASE_SHARE holds.
PHRASE, PHRASE_SHARE = 2 * LEAST // 3, 1000
#: Words on either side of a sentence that tell a leak from a stock sentence.
CONTEXT = 2
#: Windows that are embedded at a time; bytes of text that are split into words at a time.
CHUNK, BYTES = 1 << 18, 1 << 23

# Elements of HTML; anything else between angle brackets is text ------------------------
ELEMENTS = (
    "a abbr address article aside audio b bdi bdo blockquote body br button canvas caption center cite code col colgroup data dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav ol "
    "option p picture pre q rp rt ruby s samp script section select small source span strike strong style sub summary sup table tbody td template "
    "textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
_INVISIBLE = "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿ﾠ￹-￻]"
_TAG = r"(?is)<!--.*?-->|</?(?:" + "|".join(ELEMENTS) + r")(?:[\s/](?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?>"
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
_BROKEN = r"(\p{L})-[ \t]*\r?\n[ \t>]*(\p{L})"
_NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


# texts to words ---------------------------------------------------------------------------------------


def _where(texts: pa.Array, mask: pa.Array, change) -> pa.Array:
    """``change`` applied to the texts under a mask."""
    return pc.replace_with_mask(texts, mask, change(texts.filter(mask))) if pc.any(mask).as_py() else texts


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, as they are compared, in a row, and the number of words of each text. Null texts have none."""
    t = pc.fill_null(texts.cast(pa.string()), "")
    t = _where(t, pc.match_substring(t, "<"), lambda x: pc.replace_substring_regex(x, _TAG, " "))
    t = _where(t, pc.match_substring_regex(t, _ENTITY), lambda x: pa.array([html.unescape(s) for s in x.to_pylist()], pa.string()))
    t = _where(t, pc.invert(pc.string_is_ascii(t)), lambda x: pa.array([unicodedata.normalize("NFKC", s) for s in pc.replace_substring_regex(x, _INVISIBLE, "").to_pylist()], pa.string()))
    for _ in range(2):  # a match takes the letter after it, which may end one more line
        t = _where(t, pc.match_substring_regex(t, _BROKEN), lambda x: pc.replace_substring_regex(x, _BROKEN, r"\1\2"))
    parts = pc.split_pattern_regex(pc.utf8_lower(t), _NO_WORD)
    words = pc.list_flatten(parts)
    real = pc.not_equal(words, "")
    of = pc.list_parent_indices(parts).filter(real).to_numpy()
    return words.filter(real), np.bincount(of, minlength=len(t))


def _word_lists(texts: list[str]) -> list[list[str]]:
    words, sizes = split_words(pa.array(texts, pa.string()))
    words, ends = words.to_pylist(), np.cumsum(sizes).tolist()
    return [words[lo:hi] for lo, hi in zip([0, *ends], ends)]


def words_of(text: str) -> list[str]:
    return _word_lists([text])[0]


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` by the sizes of its rows, so that long texts don't add up."""
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """Codes of the runs of n words."""
    u, m = words.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    k = max(0, len(u) - n + 1)
    code = u[:k].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            code = (code ^ (code >> np.uint64(29))) * m + u[j : j + k]
    return code


class Items:
    """Items as numbers of a vocabulary, and their sentences."""

    def __init__(self, rows: list[tuple[int, str | None]], vocabulary: dict[str, int]):
        rows = [(i, t) for i, t in rows if t]
        self.ids = {i: np.array([vocabulary[w] for w in ws], np.int32) for (i, _), ws in zip(rows, _word_lists([t for _, t in rows]))}
        #: sentence -> contexts (words before, words after) in the items
        self.sentences: dict[tuple[int, ...], list[tuple[tuple[int, ...], tuple[int, ...]]]] = defaultdict(list)
        self._at: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        parts = [(i, s) for i, t in rows for s in _SENTENCE.split(t)]
        of, at = None, 0
        for (i, _), ws in zip(parts, _word_lists([s for _, s in parts])):
            of, at = i, at if i == of else 0
            own, size = self.ids[i].tolist(), len(ws)
            words = tuple(own[at : at + size])
            if size >= RUN:
                self.sentences[words].append((tuple(own[max(0, at - CONTEXT) : at]), tuple(own[at + size : at + size + CONTEXT])))
                self._at[words].append((i, at))
            at += size
        self.stock = {i: np.zeros(len(x), bool) for i, x in self.ids.items()}

    def mask(self, stock: list[tuple[int, ...]]) -> None:
        """Mark the words of stock sentences."""
        for s in stock:
            for i, at in self._at.get(s, ()):
                self.stock[i][at : at + len(s)] = True


# documents to numbers ---------------------------------------------------------------------------------


def _encode(vocabulary: dict[str, int], sentences: dict, runs: np.ndarray):
    """(id, h, text) to (id, h, words, held): numbers of words, empty without enough known ones, and what the text holds: numbers of sentences out of
    context, and of runs after them."""
    names = list(sentences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(sorted(vocabulary, key=vocabulary.get), pa.string())
        by_head: dict[int, list[int]] = defaultdict(list)
        for n, s in enumerate(names):
            by_head[int(_runs(np.array(s[:RUN]), RUN)[0])].append(n)
        heads = np.array(sorted(by_head), np.uint64)
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column("text")), BYTES):
                text, sizes = split_words(part.column("text"))
                words = (pc.fill_null(pc.index_in(text, value_set=values), -1).to_numpy(zero_copy_only=False) + 1).astype(np.int32)
                ends = np.cumsum(sizes)
                held: list[set[int]] = [set() for _ in sizes]
                codes = _runs(words, RUN)
                whole = np.arange(len(codes)) + RUN <= np.repeat(ends, sizes)[: len(codes)]
                at = np.flatnonzero(whole & np.isin(codes, heads))
                for k, doc in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist()):
                    lo, hi = int(ends[doc] - sizes[doc]), int(ends[doc])
                    for n in by_head[int(codes[k])]:
                        s = names[n]
                        end = k + len(s)
                        if end <= hi and tuple(words[k:end].tolist()) == s:
                            before, after = tuple(words[max(lo, k - CONTEXT) : k].tolist()), tuple(words[end : min(hi, end + CONTEXT)].tolist())
                            if not any(len(x) == CONTEXT and x == before or len(y) == CONTEXT and y == after for x, y in sentences[s]):
                                held[doc].add(n)
                nearest = np.minimum(np.searchsorted(runs, codes), max(0, len(runs) - 1))
                at = np.flatnonzero(whole & (runs[nearest] == codes)) if len(runs) else np.zeros(0, np.int64)
                # runs in a row that make half a passage are a leak rather than a common phrase
                streak = np.cumsum(np.r_[True, np.diff(at) > 1][: len(at)])
                at = at[np.bincount(streak)[streak] <= WINDOW - RUN] if len(at) else at
                phrase = np.unique(np.searchsorted(ends, at, "right") * (len(runs) + 1) + nearest[at])
                sentence = np.array([[doc, n] for doc, own in enumerate(held) for n in own], np.int64).reshape(-1, 2)
                of = np.r_[sentence[:, 0], phrase // (len(runs) + 1)]
                what = np.r_[sentence[:, 1], phrase % (len(runs) + 1) + len(names)][np.argsort(of, kind="stable")]
                held_lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(of, minlength=len(sizes)))].astype(np.int32)), pa.array(what.astype(np.int32)))
                known = np.bincount(np.repeat(np.arange(len(sizes)), sizes), words > 0, len(sizes))
                enough = known >= LEAST - LEAST // DIFFER
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(enough, sizes, 0))].astype(np.int32)), pa.array(words[np.repeat(enough, sizes)]))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), lists, held_lists], names=["id", "h", "words", "held"])

    return run


# CGK embedding and bit sampling -----------------------------------------------------------------------


def _walks(vocabulary: int, seed: int) -> tuple[np.ndarray, np.ndarray, list]:
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 1 << 63, (WALKS, vocabulary + 2), dtype=np.int64)
    symbols = rng.integers(1, 1 << 62, vocabulary + 2, dtype=np.int64)
    samples = [[sorted(rng.choice(2 * WINDOW, BITS, replace=False).tolist()) for _ in range(SAMPLES)] for _ in range(WALKS)]
    return bits, symbols, samples


def _keys(words: np.ndarray, starts: np.ndarray, bits: np.ndarray, symbols: np.ndarray, samples: list) -> Iterator[np.ndarray]:
    """Keys of the windows that start at ``starts``: one array per walk and sample."""
    pad = len(symbols) - 1
    source = np.append(words, np.int32(pad))
    end = len(words)
    for r in range(WALKS):
        at = np.zeros(len(starts), np.int64)
        keys = [np.full(len(starts), r * SAMPLES + s + 1, np.int64) for s in range(SAMPLES)]
        last = max(max(s) for s in samples[r])
        for j in range(last + 1):
            word = source[np.where(at < WINDOW, starts + at, end)]
            for s in range(SAMPLES):
                if j in samples[r][s]:
                    k = keys[s]
                    k *= 6364136223846793005
                    k ^= symbols[word]
                    k ^= k >> 29
            at += (bits[r][word] >> j) & 1
        yield from keys


def recall(edits: int, seed: int = 0, trials: int = 400) -> float:
    """Share of random windows with so many random substitutions that share a key with the original."""
    rng = np.random.default_rng(seed)
    bits, symbols, samples = _walks(5000, seed)
    a = rng.integers(1, 5000, (trials, WINDOW)).astype(np.int32)
    b = a.copy()
    for row in b:
        row[rng.choice(WINDOW, edits, replace=False)] = rng.integers(1, 5000, edits)
    starts = np.arange(trials) * WINDOW
    met = np.zeros(trials, bool)
    with np.errstate(over="ignore"):
        for x, y in zip(_keys(a.ravel(), starts, bits, symbols, samples), _keys(b.ravel(), starts, bits, symbols, samples)):
            met |= x == y
    return float(met.mean())


def window_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the rows of two arrays of windows, all at once."""
    n, w = a.shape
    row = np.repeat(np.arange(w + 1, dtype=np.int8)[None, :], n, 0)
    for i in range(w):
        diagonal = row[:, 0].copy()
        row[:, 0] = i + 1
        for j in range(w):
            cost = diagonal + (a[:, i] != b[:, j])
            diagonal = row[:, j + 1].copy()
            row[:, j + 1] = np.minimum(cost, np.minimum(diagonal, row[:, j]) + 1)
    return row[:, w]


# verification -----------------------------------------------------------------------------------------


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges lo..hi - 1 in a row, and the range of each."""
    many = hi - lo
    of = np.repeat(np.arange(len(lo)), many)
    return np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(of)), of


class _Texts:
    """Two texts, each many in a row, whose equal words are followed from given places to one side."""

    def __init__(self, words: np.ndarray, text: np.ndarray, step: int):
        self.words, self.text, self.step = words, text, step

    def equal(self, d: np.ndarray, i: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Equal words in a row from each place, at most ``room``."""
        n = np.zeros(len(d), np.int64)
        on = np.flatnonzero(room > 0)
        k = 0
        while len(on):
            on = on[self.words[d[on] + self.step * k] == self.text[i[on] + self.step * k]]
            k += 1
            n[on] = k
            on = on[room[on] > k]
        return n

    def reach(self, d: np.ndarray, i: np.ndarray, d_room: np.ndarray, i_room: np.ndarray) -> np.ndarray:
        """Words from each place to the last equal word, of the item and of the document, for 0 to EDITS edits: the furthest cell of each
        diagonal is carried from one number of edits to the next."""
        n, width, none = len(d), 2 * EDITS + 1, -(1 << 40)
        shift = np.arange(width) - EDITS  # words of the document more than of the item
        far = np.full((n, width + 2), none)
        far[:, EDITS + 1] = 0
        out = np.zeros((EDITS + 1, n), np.int64)
        for e in range(1, EDITS + 1):
            now = np.maximum(np.maximum(far[:, 1:-1], far[:, 2:]) + 1, far[:, :-2])  # another word, a missing one, one more
            at = now + shift
            now[(now < 0) | (at < 0) | (now > i_room[:, None]) | (at > d_room[:, None])] = none
            seed, g = np.nonzero(now >= 0)
            r = now[seed, g]
            more = self.equal(d[seed] + self.step * (r + shift[g]), i[seed] + self.step * r, np.minimum(i_room[seed] - r, d_room[seed] - r - shift[g]))
            r += more
            now[seed, g] = r
            far[:, 1:-1] = now
            out[e] = out[e - 1]
            np.maximum.at(out[e], seed[more > 0], ((r << 32) + r + shift[g])[more > 0])
        return out >> 32, out & 0xFFFFFFFF


class Index:
    """The runs of RUN words of items, to find and to extend them in documents."""

    def __init__(self, items: Items, vocabulary: int, common: np.ndarray = np.zeros(0, np.uint64)):
        own, none = list(items.ids.values()), np.zeros(0, np.int32)
        self.text = np.concatenate([*own, none])
        stock = np.concatenate([*items.stock.values(), np.zeros(0, bool)])
        self.ends = np.cumsum([len(x) for x in own]).astype(np.int64)
        self.begins = np.r_[0, self.ends[:-1]].astype(np.int64)[: len(own)]
        self.live = np.r_[0, np.cumsum(~stock)]
        item = np.repeat(np.arange(len(own)), self.ends - self.begins)
        at = np.flatnonzero(np.arange(len(self.text)) + RUN <= self.ends[item]) if len(own) else np.zeros(0, np.int64)
        self.runs, number = np.unique(_runs(self.text, RUN)[at], return_inverse=True)
        #: number of the run that begins at each word; the last words of an item begin none
        self.number = np.full(len(self.text), len(self.runs))
        self.number[at] = number
        rare = np.zeros(len(self.text), np.int64)
        rare[at] = ~np.isin(self.runs, common)[number]
        self.rare = np.r_[0, np.cumsum(rare)]
        # places of runs by item, run and the word before (0: none); a run that continues one before it is no beginning
        self.width = vocabulary + 2
        before = np.where(at == self.begins[item[at]], 0, self.text[at - 1] + 1)
        key = (item[at] * len(self.runs) + number) * self.width + before
        order = np.argsort(key, kind="stable")
        self.key, self.place = key[order], at[order]

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of runs, -1 for those of no item."""
        if not len(self.runs):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.runs, codes), len(self.runs) - 1)
        return np.where(self.runs[at] == codes, at, -1)

    def enough(self, of_doc: np.ndarray) -> np.ndarray:
        """Per item, whether these runs (numbers) cover enough of its words. Of T words up to T / DIFFER differ, and each of them leaves up to
        RUN - 1 words outside of runs: T - RUN T / DIFFER are covered, also of the words that count."""
        has = np.zeros(len(self.runs) + 1, bool)
        has[of_doc] = True
        begun = has[self.number]
        covered = begun.copy()
        for j in range(1, RUN):
            covered[j:] |= begun[:-j]
        counts = np.r_[0, np.cumsum(covered & (np.diff(self.live) > 0))]
        return (counts[self.ends] - counts[self.begins]) * DIFFER >= LEAST * (DIFFER - RUN)

    def seeds(self, words: np.ndarray, pos: np.ndarray, run: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where maximal runs of equal words begin: (pair, place in the documents, place in the items)."""
        at, pair = _ranges(np.searchsorted(pos, first[doc]), np.searchsorted(pos, ends[doc]))
        d = pos[at]
        base = (item[pair] * len(self.runs) + run[at]) * self.width
        before = base + np.where(d == first[doc[pair]], 1, words[d - 1] + 1)
        out = []
        for lo, hi in ((base, before), (before + 1, base + self.width)):
            entry, of = _ranges(np.searchsorted(self.key, lo), np.searchsorted(self.key, hi))
            out.append((pair[of], d[of], self.place[entry]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def carried(self, words: np.ndarray, first: np.ndarray, ends: np.ndarray, pos: np.ndarray, run: np.ndarray, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Words that documents carry of items (pairs of numbers); ``pos`` and ``run``: places and numbers of the items' runs in the documents."""
        pair, d, i = self.seeds(words, pos, run, first, doc, item, ends)
        right, left = _Texts(words, self.text, 1), _Texts(words, self.text, -1)
        d_end, i_end = ends[doc[pair]], self.ends[item[pair]]
        size = right.equal(d, i, np.minimum(d_end - d, i_end - i))
        after, d_after = right.reach(d + size, i + size, d_end - d - size, i_end - i - size)
        ahead, d_ahead = left.reach(d - 1, i - 1, d - first[doc[pair]], i - self.begins[item[pair]])
        least = np.where(self.rare[np.maximum(i, i + size - RUN + 1)] > self.rare[i], STRETCH, PHRASE)
        found = []
        for k in range(EDITS + 1):
            for e in range(k + 1):
                start, stop = i - ahead[k - e], i + size + after[e]
                n = self.live[stop] - self.live[start]
                ok = (n >= least) & (n >= k * DIFFER)
                if e:
                    ok &= after[e] > after[e - 1]
                if k > e:
                    ok &= ahead[k - e] > ahead[k - e - 1]
                found.append(np.stack([pair[ok], start[ok], stop[ok], np.full(ok.sum(), k), n[ok], (d - d_ahead[k - e])[ok], (d + size + d_after[e])[ok]]))
        pair, start, stop, k, n, d_start, d_stop = np.unique(np.concatenate(found, axis=1), axis=1)
        out = np.zeros(len(doc), np.int64)
        np.maximum.at(out, pair, n)
        cuts = np.searchsorted(pair, np.arange(len(doc) + 1))
        for p in np.flatnonzero(2 * out >= LEAST).tolist():
            own = slice(cuts[p], cuts[p + 1])
            a, b, e, m, c, f = start[own], stop[own], k[own], n[own], d_start[own], d_stop[own]
            # nor may they share words of the document; where they overlap in the item, one gives way in both
            apart = (f[:, None] <= c + np.maximum(0, b[:, None] - a) + EDITS) | (f <= c[:, None])
            # a second stretch counts from the end of the first, or the first up to the second
            second = self.live[b] - self.live[np.minimum(b, np.maximum(a, b[:, None]))]
            head = self.live[np.maximum(a[:, None], np.minimum(b[:, None], a))] - self.live[a[:, None]]
            both = [np.where(apart & (x >= STRETCH) & (x >= y * DIFFER), x + z, 0) for x, y, z in ((second, e, m[:, None]), (head, e[:, None], m))]
            out[p] = max(out[p], both[0].max(), np.where(a > a[:, None], both[1], 0).max())
        return out


def _search(items: Items, vocabulary: int, seed: int, common: np.ndarray = np.zeros(0, np.uint64)):
    bits, symbols, samples = _walks(vocabulary, seed)
    index = Index(items, vocabulary, common)
    keys, places = [], []
    with np.errstate(over="ignore"):
        for lo, hi in zip(index.begins.tolist(), index.ends.tolist()):
            starts = np.arange(lo, max(lo, hi - WINDOW + 1))
            starts = starts[index.live[starts + WINDOW] - index.live[starts] >= WINDOW // 2]
            for k in _keys(index.text[:hi], starts, bits, symbols, samples):
                keys.append(k)
                places.append(starts)
    names, text = np.array(list(items.ids), np.int64), index.text
    key, place = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    item_of = np.repeat(np.arange(len(names)), index.ends - index.begins)
    mask = (1 << 24) - 1  # a key table of many times fewer entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.zeros(mask + 1, bool)
        present[key & mask] = True
        reach = np.arange(WINDOW)
        for batch in (part for b in batches for part in _slices(b, pc.list_value_length(b.column("words")), BYTES // 4)):
            lists = batch.column("words")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.list_flatten(lists).to_numpy()
            ends = np.cumsum(sizes)
            begins = ends - sizes
            of = np.repeat(np.arange(len(sizes)), sizes)  # the document of each word
            number = index.numbers(_runs(words, RUN))
            pos = np.flatnonzero(number >= 0)
            pos = pos[pos + RUN <= ends[of[pos]]]
            # items that each document may carry for all its runs say; the others need no windows
            may = np.zeros((len(sizes), len(names)), bool)
            cuts = np.searchsorted(pos, np.r_[begins, len(words)])
            for n in np.flatnonzero(np.diff(cuts) * RUN * DIFFER >= LEAST * (DIFFER - RUN)).tolist():
                may[n] = index.enough(number[pos[cuts[n] : cuts[n + 1]]])
            seeds = np.zeros(len(words) + 1, np.int64)
            seeds[pos + 1] = 1
            seeds = np.cumsum(seeds)
            unknown = np.r_[0, np.cumsum(words == 0)]
            start = np.arange(max(0, len(words) - WINDOW + 1))
            start = start[(seeds[start + WINDOW - RUN + 1] > seeds[start]) & (unknown[start + WINDOW] - unknown[start] <= NEAR)]
            start = start[(start + WINDOW <= ends[of[start]]) & may.any(axis=1)[of[start]]]
            met: list[np.ndarray] = []
            with np.errstate(over="ignore"):
                for lo in range(0, len(start), CHUNK):
                    part = start[lo : lo + CHUNK]
                    near = []
                    for k in _keys(words, part, bits, symbols, samples):
                        hit = np.flatnonzero(present[k & mask])
                        left = np.searchsorted(key, k[hit], "left")
                        real = key[np.minimum(left, len(key) - 1)] == k[hit]
                        hit, left = hit[real], left[real]
                        entry, which = _ranges(left, np.searchsorted(key, k[hit], "right"))
                        d, i = part[hit[which]], place[entry]
                        ok = may[of[d], item_of[i]]
                        near.append(d[ok] * len(text) + i[ok])
                    near = np.unique(np.concatenate(near))
                    for at in range(0, len(near), CHUNK):
                        d, i = np.divmod(near[at : at + CHUNK], len(text))
                        good = window_distances(words[d[:, None] + reach], text[i[:, None] + reach]) <= NEAR
                        met.append(np.unique(of[d[good]] * len(names) + item_of[i[good]]))
            both = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            doc, item = np.divmod(both, max(1, len(names)))
            # pairs are compared in groups of about CHUNK places of runs
            weight = np.cumsum(np.searchsorted(pos, ends[doc]) - np.searchsorted(pos, begins[doc]))
            cuts = np.flatnonzero(np.diff(weight // CHUNK)) + 1
            n = [index.carried(words, begins, ends, pos, number[pos], doc[lo:hi], item[lo:hi]) for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]) if hi > lo]
            n = np.concatenate([*n, np.zeros(0, np.int64)])
            yes = n >= LEAST
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc[yes])), pa.array(names[item[yes]]), pa.array(n[yes].astype(np.int32))], names=["id", "item", "carried"])

    return run


def leaked(documents: DataFrame, items: DataFrame, seed: int = 11) -> DataFrame:
    """``documents(id, text)``, ``items(id bigint, text)`` to ``(id, item, carried)``: the items that each document carries and how
    many of their words (``carried``).

    Null, empty and short texts carry nothing and are never carried; texts that stand under several ids are reported under each;
    an empty table gives no rows; other columns are ignored. Whole texts are compared, of any length.
    """
    spark, kind = documents.sparkSession, dict(documents.dtypes)["id"]
    blocks: list[list[tuple[int, str | None]]] = []
    while True:
        block = items.where("id IS NOT NULL").select("id", "text")
        block = block.where(F.col("id") > blocks[-1][-1][0]) if blocks else block
        rows = [(r.id, r.text) for r in block.orderBy("id").limit(ITEM_BLOCK).collect()]  # ITEM_BLOCK rows at most
        if not rows:
            break
        blocks.append(rows)
    vocabulary: dict[str, int] = {}
    for rows in blocks:
        for w in split_words(pa.array([t for _, t in rows], pa.string()))[0].unique().to_pylist():
            vocabulary.setdefault(w, len(vocabulary) + 1)
    own = [Items(rows, vocabulary) for rows in blocks]
    sentences: dict = defaultdict(list)
    for x in own:
        for s, contexts in x.sentences.items():
            sentences[s] += contexts
    if not vocabulary:
        return spark.createDataFrame([], f"id {kind}, item long, carried int")
    runs = np.unique(np.concatenate([_runs(w, RUN) for x in own for w in x.ids.values()]))
    names = list(sentences)
    texts = spread(documents.where("text IS NOT NULL")).select("id", F.xxhash64("text").alias("h"), "text")
    encoded = written(texts.mapInArrow(_encode(vocabulary, dict(sentences), runs), f"id {kind}, h long, words array<int>, held array<int>"), "encoded")
    n_texts = encoded.select("h").distinct().count()
    held = encoded.select("h", F.explode("held").alias("what")).distinct().groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    many = held.where((F.col("n") >= STOCK_LEAST) & (F.col("n") * F.when(F.col("what") < len(names), STOCK_SHARE).otherwise(PHRASE_SHARE) > n_texts))
    many = [r.what for r in many.select("what").collect()]  # sentences and runs of items at most
    stock, common = [names[n] for n in many if n < len(names)], runs[[n - len(names) for n in many if n >= len(names)]]
    found = []
    for x in own:
        x.mask(stock)
        found.append(encoded.where(F.size("words") > 0).select("id", "words").mapInArrow(_search(x, len(vocabulary), seed, common), f"id {kind}, item long, carried int"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
