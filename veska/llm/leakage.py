"""Passages of evaluation texts found in a training corpus."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veska.llm.names import ALIKE

#: Words of a k-gram and k-grams of a window: every shared span of K + WINDOW - 1 words
#: leaves a common fingerprint.  A dozen words with two of them changed keep four in a row.
K, WINDOW = 3, 2
#: Least words of a passage, and of them least words in common.
PASSAGE, COMMON = 12, 10
#: A run of K or more words that more than STOCK different texts of the whole list have is a
#: stock phrase; a word that more than STOCK of them and more than COMMON_SHARE of them have
#: tells nothing by itself.
STOCK, COMMON_SHARE = 4, 0.02
#: Hits of a passage lie this near to each other: words between them, words lost or added.
APART, SHIFT = 16, 3
#: Most items that one task holds (some MB); more are taken in blocks.
BLOCK = 20_000

_TAG = re.compile(r"</?[a-z][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});|\]\([^()\s]*\)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[­​‌‍⁠﻿̀-ͯ]")
_CYR, _LAT, _GREEK = re.compile("[а-яё]"), re.compile("[a-z]"), re.compile("[α-ω]")
# Greek and Cyrillic letters that look like Latin ones.
TO_LATIN = {v: k for k, v in ALIKE.items()} | dict(zip("αβεικνορτυχіјѕ", "abeiknoptyxijs")) | {"ԁ": "d", "ո": "n", "һ": "h", "ӏ": "l"}


def plain_words(text: str) -> list[str]:
    """Lower-case words without markup, invisible characters, line-end hyphens and
    look-alike letters."""
    t = text.lower()
    if _UNSEEN.search(t):
        t = _UNSEEN.sub("", t)
    if "<" in t or "&" in t or "](" in t:
        t = _TAG.sub(" ", t)
    if "-" in t:
        t = _HYPHEN.sub("", t)
    return _WORD.findall(t)


def unify(word: str) -> str:
    """The word in one alphabet: that of most of its letters."""
    if (_CYR.search(word) and _LAT.search(word)) or _GREEK.search(word):
        cyr, lat = len(_CYR.findall(word)), len(_LAT.findall(word))
        table = ALIKE if cyr > lat or (cyr == lat and any(c not in TO_LATIN for c in word if "а" <= c <= "я")) else TO_LATIN
        word = "".join(table.get(c, c) for c in word)
    return word.replace("ё", "е")


def code_of(word: str) -> int:
    """The same number for a word in every block of the list; 0 is no word's."""
    return (xxhash.xxh3_64_intdigest(word) >> 1) | 1


def coded(text: str) -> np.ndarray:
    return np.array([code_of(unify(w)) for w in plain_words(text)], np.int64)


class Items:
    """Fingerprints and words of test items; ``stock`` k-grams, ``common`` words and
    ``phrases`` are of the whole list."""

    def __init__(self, items: list[tuple[int, str]], stock: np.ndarray, common: np.ndarray, phrases: Phrases | None = None):
        self.ids = [i for i, _ in items]
        self.coded = [coded(t or "") for _, t in items]
        self.rare = [~np.isin(a, common) for a in self.coded]
        self.code = {w: code_of(w) for _, t in items for w in map(unify, plain_words(t or ""))}
        apart = np.concatenate([np.zeros(0, np.int64), *[np.r_[a, 0] for a in self.coded]])
        lengths = (phrases or Phrases()).lengths(apart, np.sort(stock))
        starts = np.cumsum([0, *[len(a) + 1 for a in self.coded]])
        self.phrase = [lengths[k : k + len(a)] for k, a in zip(starts, self.coded)]
        grams = [kgrams(a) for a in self.coded]
        hashes = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], item[order], at[order]
        self.words = np.concatenate([np.zeros(0, np.int64), *[p[: len(g)] for p, g in zip(self.phrase, grams)]])[order]  # of the stock phrase that begins there


def among(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    if not len(held):
        return np.zeros(len(hashes), bool)
    return held[np.minimum(np.searchsorted(held, hashes), len(held) - 1)] == hashes


def stretches(codes: np.ndarray, stock: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of words all of whose k-grams are stock."""
    edge = np.diff(np.r_[False, among(kgrams(codes), stock), False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + K - 1


def run_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for each run of words [start, end)."""
    base = 0x9E3779B97F4A7C15
    powers = np.full(len(codes) + 1, base, np.uint64)
    inverse = np.full(len(codes) + 1, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
    sums = np.r_[np.zeros(1, np.uint64), np.add.accumulate(codes.astype(np.uint64) * powers[:-1])]
    return (sums[end] - sums[start]) * inverse[start]


class Phrases:
    """Stretches of the whole list by hash, and for every word of them the length of the
    longest stock phrase that begins there."""

    def __init__(self, runs: list[np.ndarray] = (), texts: list[list[int]] = ()):
        longest = longest_shared(runs, texts)
        keys = np.array([run_hash(a, np.array([0]), np.array([len(a)]))[0] for a in runs], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.starts = np.cumsum([0, *[len(runs[k]) for k in order]])
        self.longest = np.concatenate([np.zeros(0, np.int32), *[longest[k].astype(np.int32) for k in order]])

    def lengths(self, codes: np.ndarray, stock: np.ndarray) -> np.ndarray:
        """Words of the longest stock phrase that begins at each word, 0 where none does."""
        out = np.zeros(len(codes), np.int64)
        if len(self.keys):
            start, end = stretches(codes, stock)
            for a, b, k in zip(start, end, np.searchsorted(self.keys, run_hash(codes, start, end))):
                out[a:b] = self.longest[self.starts[k] : self.starts[k + 1]]
        return out


def longest_shared(runs: list[np.ndarray], texts: list[list[int]]) -> list[np.ndarray]:
    """For every word of the runs the length of the longest run of K or more words from it on
    that more than STOCK different texts have, given the texts of each run: suffixes are
    sorted by doubling, and neighbours that enough texts have share a phrase."""
    if not len(runs):
        return []
    starts = np.cumsum([0, *[len(a) + 1 for a in runs]])
    of = np.repeat(np.arange(len(runs)), np.diff(starts))
    stop = starts[of + 1] - 1  # a place without a word behind each run
    here = np.arange(starts[-1])
    words = np.zeros(starts[-1], np.int64)
    words[here != stop] = np.concatenate(runs)
    rank = np.unique(words, return_inverse=True)[1] + 1
    rank[here == stop] = 0
    levels, step = [rank.astype(np.int32)], 1
    while step < max(map(len, runs)):
        rank = np.unique(rank * (len(rank) + 2) + rank[np.minimum(here + step, stop)], return_inverse=True)[1] + 1
        rank[here == stop] = 0
        levels.append(rank.astype(np.int32))
        step *= 2
    order = np.flatnonzero(stop - here >= K)
    order = order[np.argsort(rank[order], kind="stable")]
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), np.int64)  # words that neighbours have in common
    for j in reversed(range(len(levels))):
        fits = np.minimum(stop[a] - a, stop[b] - b) - same >= 1 << j
        same += np.where(fits & (levels[j][np.minimum(a + same, stop[a])] == levels[j][np.minimum(b + same, stop[b])]), 1 << j, 0)
    longest = np.zeros(starts[-1], np.int64)
    longest[order] = _shared(order, (stop - here)[order].tolist(), same.tolist(), of[order].tolist(), texts)
    return [longest[s : s + len(a)] for s, a in zip(starts, runs)]


def _shared(order: np.ndarray, left: list[int], same: list[int], run: list[int], texts: list[list[int]]) -> list[int]:
    """The longest beginning of each sorted suffix that more than STOCK texts have."""
    best = [0] * len(order)
    held: dict[int, int] = defaultdict(int)
    least: deque[int] = deque()  # ends of the window's gaps, the least words in common first
    first = 0
    for k in range(len(order)):
        while least and same[least[-1] - 1] >= same[k - 1]:
            least.pop()
        if k:
            least.append(k)
        for t in texts[run[k]]:
            held[t] += 1
        while len(held) - sum(held[t] == 1 for t in texts[run[first]]) > STOCK and first < k:
            for t in texts[run[first]]:
                held[t] -= 1
                if not held[t]:
                    del held[t]
            first += 1
        while least and least[0] <= first:
            least.popleft()
        if len(held) > STOCK:
            best[k] = same[least[0] - 1] if least else left[k]
    for k in range(1, len(order)):
        best[k] = max(best[k], min(best[k - 1], same[k - 1]))
    for k in reversed(range(1, len(order))):
        best[k - 1] = max(best[k - 1], min(best[k], same[k - 1]))
    return best


def stock_of(rows: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of stock k-grams and codes of common words, counted over the different texts
    of the whole list.  Each is in more than STOCK texts, so they are a part of the list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            held = [(k, x) for a in map(coded, df["t"]) for k, xs in ((True, kgrams(a).view(np.int64)), (False, a)) for x in set(xs.tolist())]
            yield pd.DataFrame(held, columns=["gram", "h"])

    texts = rows.select(F.col(text).cast("string").alias("t")).distinct()
    most = max(STOCK, COMMON_SHARE * texts.count())
    counts = texts.mapInPandas(run, "gram boolean, h bigint").groupBy("gram", "h").agg(F.count("*").alias("n"))
    many = counts.where(F.col("n") > F.when(F.col("gram"), STOCK).otherwise(most)).select("gram", "h").collect()
    return np.array([r["h"] for r in many if r["gram"]], np.int64).view(np.uint64), np.array([r["h"] for r in many if not r["gram"]], np.int64)


def phrases_of(rows: DataFrame, text: str, stock: np.ndarray) -> Phrases:
    """Stock phrases of the whole list.  Its different stretches of stock k-grams, a part of
    the list, come to the driver, each once with at most STOCK + 1 of its texts."""
    if not len(stock):
        return Phrases()
    stock = np.sort(stock)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            held = []
            for t in df["t"]:
                codes = coded(t)
                held += [(a, code_of(t)) for a in {tuple(codes[x:y].tolist()) for x, y in zip(*stretches(codes, stock))}]
            yield pd.DataFrame(held, columns=["run", "t"])

    texts = rows.select(F.col(text).cast("string").alias("t")).distinct()
    found = texts.mapInPandas(run, "run array<bigint>, t bigint").groupBy("run").agg(F.slice(F.collect_list("t"), 1, STOCK + 1).alias("t")).collect()
    return Phrases([np.array(r["run"], np.int64) for r in found], [r["t"] for r in found])


class Coder(dict):
    """Codes of words as written, 0 for those no item has; forgets when it grows large."""

    MOST = 1_000_000

    def __init__(self, code: dict[str, int]):
        super().__init__()
        self.code = code

    def __missing__(self, word: str) -> int:
        got = self.code.get(word)
        if got is None:
            got = 0 if word.isascii() else self.code.get(unify(word), 0)
        if len(self) >= self.MOST:
            self.clear()
        self[word] = got
        return got


def kgrams(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of K codes; codes of words no item has are 0."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(K):
            h = (h + codes[j : j + n].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the least hash of every WINDOW successive ones."""
    if len(hashes) < WINDOW:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(windows.argmin(axis=1) + np.arange(len(windows)))


def _walk(doc: np.ndarray, item: np.ndarray, d: int, i: int, step: int) -> tuple[list[tuple[int, int]], int]:
    """Aligned (doc, item) positions from (d, i) on, single words changed, lost or added
    (whatever lets the next two words agree, or the next one), up to the last position almost
    worth its gaps, and how many of them go up to the last one fully worth them; a changed
    word counts as (-1, item position)."""
    out: list[tuple[int, int]] = []
    score = best = kept = sure = 0
    nd, ni = len(doc), len(item)
    same = lambda x, y: 0 <= x < nd and 0 <= y < ni and doc[x] == item[y]
    while 0 <= i < ni and 0 <= d < nd and best - score < 6:
        if doc[d] == item[i]:
            out.append((d, i))
            score += 1
            d, i = d + step, i + step
            if score >= best - 2:  # a word that agrees after a changed one still belongs to the passage
                kept = len(out)
                if score > best:
                    best, sure = score, kept
            continue
        score -= 2
        ways = [(1, 1), (0, 1), (1, 0)]  # changed, lost, added
        after = [w for w in ways if same(d + step * w[0], i + step * w[1])]
        twice = [w for w in after if same(d + step * (w[0] + 1), i + step * (w[1] + 1))]
        dd, di = (twice or after or ways)[0]
        score -= 0 if after else 1
        if di:
            out.append((-1, i))
        d, i = d + step * dd, i + step * di
    return out[:kept], sure


def is_passage(doc: np.ndarray, item: np.ndarray, rare: np.ndarray, phrase: np.ndarray, d: int, i: int) -> tuple[bool, int, int]:
    """Whether the k-gram at (d, i) extends to a passage; the item span it covers."""
    back, ahead = _walk(doc, item, d - 1, i - 1, -1), _walk(doc, item, d, i, 1)
    good, first, last = _judged(back[0][::-1] + ahead[0], rare, phrase, i)
    if good or (back[1] == len(back[0]) and ahead[1] == len(ahead[0])):
        return good, first, last
    # Words beyond the last changed ones may be chance: without them it may be a passage.
    return _judged(back[0][: back[1]][::-1] + ahead[0][: ahead[1]], rare, phrase, i)


def _judged(aligned: list[tuple[int, int]], rare: np.ndarray, phrase: np.ndarray, i: int) -> tuple[bool, int, int]:
    if not aligned:
        return False, i, i + K
    at = [y for _, y in aligned]
    first, last = min(at), max(at) + 1
    agree = np.zeros(last - first, bool)
    agree[[y - first for x, y in aligned if x >= 0]] = True
    common = int(agree.sum())
    if last - first < PASSAGE or common < COMMON:
        return False, first, last
    telling = rare[first:last]
    told, else_ = int((telling & agree).sum()), int((telling & ~agree).sum())
    if told < 2 * else_:
        return False, first, last
    return _is_own(aligned, agree, phrase, first, told), first, last


def _is_own(aligned: list[tuple[int, int]], agree: np.ndarray, phrase: np.ndarray, first: int, told: int) -> bool:
    """Whether a passage as a whole is more than stock phrases of the list: a run of words in
    it is no stock phrase and a word of few texts tells, or K of its words lie beyond its
    longest stock phrase.  Where no word tells, those beyond tell instead: twice as many are
    kept as changed, and they are more than one other stock phrase (a lead-in and a question,
    a lead-in and a usual beginning)."""
    if told:
        start = last = None
        for x, y in [*aligned, (-1, -1)]:
            if start is not None and x >= 0 and (x, y) == (last[0] + 1, last[1] + 1):
                last = x, y
                continue
            if start is not None and last[1] - start + 1 >= K and phrase[start] < last[1] - start + 1:
                return True
            start, last = (y, (x, y)) if x >= 0 else (None, None)
    ends = np.minimum(np.arange(len(agree)) + phrase[first : first + len(agree)], len(agree))
    beyond = np.ones(len(agree), bool)
    for taken in range(2):
        sums = np.r_[0, np.cumsum(agree & beyond)]
        k = int((sums[ends] - sums[:-1]).argmax())
        beyond[k : max(ends[k], k + 1)] = False
        kept, lost = int((beyond & agree).sum()), int((beyond & ~agree).sum())
        if not taken and (kept < K or not told and kept < 2 * lost):
            return False
    return bool(told or kept)


def leaks_of(doc: np.ndarray, items: Items) -> list[tuple[int, int]]:
    """(item index, longest passage in words) of the items a document leaks."""
    known = doc != 0
    run = known[2:] & known[1:-1] & known[:-2]
    hit = np.flatnonzero(run)
    if not len(hit):  # no run of K words that items have
        return []
    h = kgrams(doc)
    there = among(h[hit], items.hashes)
    if not there.any():
        return []
    hit = hit[there]
    left, right = np.searchsorted(items.hashes, h[hit], "left"), np.searchsorted(items.hashes, h[hit], "right")
    own = items.words[left] == 0
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    if own.any():
        mark = np.zeros(len(h), bool)
        mark[winnow(h)] = True
        for k in np.flatnonzero(own & mark[hit]):
            for e in range(left[k], right[k]):
                seeds[int(items.item[e])].append((int(hit[k]), int(items.at[e])))
    longest: dict[int, int] = defaultdict(int)
    for found in (seeds, {} if own.all() else _among_phrases(hit, left, right, items)):
        for item, pairs in found.items():
            done: dict[int, int] = {}  # diagonal: item position up to which it is extended
            for d, i in pairs:
                if done.get(d - i, -1) >= i:
                    continue
                good, first, last = is_passage(doc, items.coded[item], items.rare[item], items.phrase[item], d, i)
                done[d - i] = last
                if good:
                    longest[item] = max(longest[item], last - first)
    return list(longest.items())


def _among_phrases(hit: np.ndarray, left: np.ndarray, right: np.ndarray, items: Items) -> dict[int, list[tuple[int, int]]]:
    """Seeds by item where stock phrases meet: hits near each other that no one stock phrase
    holds.  Of the many items that share a phrase, those with nothing beyond it are set aside
    together."""
    near = np.diff(hit, prepend=-2 * APART, append=hit[-1] + 2 * APART) <= APART
    k = np.flatnonzero(near[:-1] | near[1:])
    many = right[k] - left[k]
    total = int(many.sum())
    if not total:
        return {}
    e = np.repeat(left[k] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)
    d, item, i = np.repeat(hit[k], many), items.item[e], items.at[e]
    order = np.lexsort((d - i, item))  # near diagonals of an item make a band
    e, d, item, i = e[order], d[order], item[order], i[order]
    band = np.cumsum(np.r_[True, (np.diff(item) != 0) | (np.diff(d - i) > SHIFT)])
    order = np.lexsort((d, band))  # near hits of a band make a group
    e, d, item, i, band = e[order], d[order], item[order], i[order], band[order]
    start = np.flatnonzero(np.r_[True, (np.diff(band) != 0) | (np.diff(d) > APART)])
    end = np.r_[start[1:], len(d)]
    first, last = np.minimum.reduceat(i, start), np.maximum.reduceat(i, start) + K
    reach = np.maximum.reduceat(np.where(i == np.repeat(first, end - start), items.words[e], 0), start)
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for g in np.flatnonzero((d[end - 1] > d[start]) & (reach < last - first)):
        seeds[int(item[start[g]])].extend(zip(d[start[g] : end[g]].tolist(), i[start[g] : end[g]].tolist()))
    return seeds


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Documents that contain a passage of an item: (doc_id, item_id, words), the last the
    length of the longest passage in words of the item.

    Texts are compared as words without case, punctuation, markup, line breaks and
    look-alike letters.  Winnowed K-word fingerprints of whole documents are joined with
    the items' fingerprints, and each hit is extended both ways over single words
    changed, lost or added.  A passage has at least PASSAGE words, COMMON of them in
    common, and as a whole it is no stock phrase (a lead-in or question of many items),
    whatever its parts are; of the words that few items have (numbers, places) the passage
    must keep twice as many as it changes.  Null and blank texts on either side leak nothing; repeated rows give
    repeated results on the documents' side only; empty tables give no row.

    The items are counted first: up to BLOCK go to every task with their fingerprints, a
    longer list is taken in blocks of that size.  Documents are read once per block and
    never shuffled.
    """
    schema = f"{doc_id} bigint, {item_id} bigint, words int"
    rows = items.select(item_id, item_text).dropna().dropDuplicates()
    docs = documents.select(documents[doc_id].cast("bigint").alias(doc_id), documents[text].cast("string").alias(text))
    blocks = max(1, -(-rows.count() // BLOCK))
    stock, common = stock_of(rows, item_text)
    phrases = phrases_of(rows, item_text, stock)
    result = None
    for b in range(blocks):
        held = [(r[0], r[1]) for r in rows.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b).collect()]

        def run(batches: Iterator[pa.RecordBatch], held=held, stock=stock, common=common, phrases=phrases) -> Iterator[pa.RecordBatch]:
            known = Items(held, stock, common, phrases)
            code = Coder(known.code)
            for batch in batches:
                ids, found, length = [], [], []
                for key, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    words = plain_words(t.as_py() or "")
                    if len(words) < K:
                        continue
                    codes = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
                    for item, n in leaks_of(codes, known):
                        ids.append(key)
                        found.append(known.ids[item])
                        length.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(length, pa.int32())], names=[doc_id, item_id, "words"])

        one = docs.mapInArrow(run, schema)
        result = one if result is None else result.unionByName(one)
    return result
