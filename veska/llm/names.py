"""Freely typed names mapped to the entries of a canonical list."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters that look like Cyrillic ones, and a transliteration.
ALIKE = dict(zip("aceopxykmhtbirn", "асеорхукмнтвігп"))
LATIN = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")) | {
    "ё": "e", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya",
}
# Words and abbreviations of kinds of units, by what they say of the unit.
TOWN = "городской город городского города городе го г gorodskoy gorodskogo gorod g go town city"
DISTRICT = "район района районе районом р-н рн мр м.р-н мр-н м.р rayon rayona rayone district mr m.r r-n"
AREA = "округ округа округе мо м.о okrug okruga mo m.o"
OTHER = "муниципальный муниципального муниципальном муниц munitsipalnyy munitsipalnogo municipal of the in"
SEAT = "рп пгт с пос п село поселок rp pgt s pos village settlement"
REGION = (
    "область области обл край края крае кр республика республики республике респ "
    "oblast oblasti obl kray kraya krai kr respublika respubliki resp region republic"
)
KINDS = {w: k for k, ws in (("town", TOWN), ("district", DISTRICT), ("area", AREA), ("other", OTHER), ("seat", SEAT), ("region", REGION)) for w in ws.split()}
_ENDINGS = ("ий", "ый", "ой", "ого", "ому", "ом", "им", "ая", "ую", "ое", "iy", "yy", "y", "ij", "oy", "ogo", "omu", "om", "im", "aya", "uyu", "oe")
_NOUN_ENDINGS = ("", "а", "у", "е", "ом", "a", "u", "e", "om")
_WORD = re.compile(r"[^\W\d_]+(?:[-.][^\W\d_]+)*")
_CYRILLIC = re.compile(r"[а-яё]")


def fold(text: str) -> str:
    """Lower case, one kind of blank and look-alike letters in words that mix alphabets
    returned to Cyrillic."""
    def word(m: re.Match) -> str:
        w = m.group(0)
        if _CYRILLIC.search(w) and re.search(r"[a-z]", w):
            return "".join(ALIKE.get(c, c) for c in w).replace("і", "и")
        return w

    text = text.lower().replace("ё", "е")
    return re.sub(r"[^\W\d_]+", word, re.sub(r"\s+", " ", text))


def latin(text: str) -> str:
    return "".join(LATIN.get(c, c) for c in text)


def words(text: str) -> list[str]:
    return [w.strip(".-") for w in _WORD.findall(text)]


def stem(word: str) -> tuple[str, bool]:
    """(stem, is it an adjective).  Only '...sk' adjectives carry names."""
    for e in sorted(_ENDINGS, key=len, reverse=True):
        if word.endswith(e) and word[: -len(e)].endswith(("ск", "цк", "sk", "tsk")) and len(word) - len(e) > 3:
            return word[: -len(e)], True
    return word, False


def near(a: str, b: str) -> bool:
    """Whether one letter lost, added, changed or swapped with the next turns a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[:2][::-1] and x[2:] == y[2:])


def grams(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


_INFLECTED = re.compile(
    "(?:ого|его|ому|ему|ыми|ими|ая|яя|ое|ее|ой|ей|ый|ий|ую|юю|ом|ем|ым|им|ою|ею|ам|ям|ах|ях|ов|а|я|о|е|у|ю|ы|и|ь|й"
    "|ogo|ego|omu|emu|aya|yaya|oye|oe|oy|ey|yy|iy|uyu|om|em|ym|im|ya|yu|a|o|e|u|y|i)$"
)


def base(word: str) -> str:
    """A word of a name of several words without its inflection."""
    cut = _INFLECTED.sub("", word)
    return cut if len(cut) > 2 else word


class Names:
    """A canonical list with aliases: entries are (code, words), the words of one alias as
    (word, kind), kind 'adjective' (by its stem) or 'noun'.

    Embedded mentions are found by an Aho-Corasick automaton over the aliases' first words;
    an alias of several words needs all of them in order.  The longest mention wins (ties:
    the first).  A text without a mention goes to the similarity of token sets: the share of
    an alias's words that the text holds, a word one slip of the keyboard apart counting as
    1 - 1 / its length.
    """

    def __init__(self, entries: Iterable[tuple[int, tuple[tuple[str, str], ...]]]):
        self.codes: dict[tuple[str, str], set[int]] = defaultdict(set)
        self.many: dict[str, list[tuple[tuple[str, ...], int]]] = defaultdict(list)
        self.sets: list[tuple[tuple[str, ...], int]] = []
        self.within: dict[str, set[int]] = defaultdict(set)
        for code, parts in entries:
            if len(parts) == 1:
                for form in {parts[0][0], latin(parts[0][0])}:
                    self.codes[form, parts[0][1]].add(code)
                continue
            for alias in {tuple(base(w) for w, _ in parts), tuple(base(latin(w)) for w, _ in parts)}:
                self.many[alias[0]].append((alias[1:], code))
                for w in alias:
                    self.within[w].add(len(self.sets))
                self.sets.append((alias, code))
        self.single = {f for f, _ in self.codes}
        self.auto = ahocorasick.Automaton()
        self.index: dict[str, set[str]] = defaultdict(set)
        self.size: dict[str, int] = {}
        self.seen: dict[tuple[str, str], set] = {}
        for form in self.single | set(self.many):
            self.auto.add_word(form, form)
        for form in self.single | set(self.within):
            self.size[form] = len(grams(form))
            for g in grams(form):
                self.index[g].add(form)
        self.longest = max(map(len, self.size), default=0)
        if self.size:
            self.auto.make_automaton()

    def mentions(self, text: str) -> list[tuple[int, int, str, str, int | None]]:
        """(from, to, form, ending, code of a name of several words), the longest first."""
        if not self.size:
            return []
        found = []
        for end, form in self.auto.iter(text):
            start = end + 1 - len(form)
            if start and (text[start - 1].isalpha()):
                continue
            rest = re.match(r"[^\W\d_]*", text[end + 1 :]).group(0)
            if form in self.single and (rest in _ENDINGS or rest in _NOUN_ENDINGS):
                found.append((start, end + 1 + len(rest), form, rest, None))
            if form in self.many and base(form + rest) == form:
                after = [m for _, m in zip(range(max(len(w) for w, _ in self.many[form])), _WORD.finditer(text, end + 1 + len(rest)))]
                for others, code in self.many[form]:
                    if len(after) >= len(others) and all(base(m.group(0).strip(".-")) == w for m, w in zip(after, others)):
                        found.append((start, after[len(others) - 1].end(), form, rest, code))
        return sorted(found, key=lambda m: (m[0] - m[1], m[0]))

    def near_forms(self, word: str, ends: tuple[str, ...]) -> set[str]:
        """Forms that the word equals, with one of the endings, up to one slip; found among
        those that share most letter pairs."""
        if len(word) > self.longest + 6:
            return set()
        count: dict[str, int] = defaultdict(int)
        for x in grams(word):
            for form in self.index.get(x, ()):
                count[form] += 1
        return {f for f, n in count.items() if n >= self.size[f] - 5 and abs(len(word) - len(f)) < 5 and any(near(word, f + e) for e in ends)}

    def similar(self, word: str, kind: str) -> set[int]:
        """Codes of the aliases of one word of a kind one slip away from the inflected word."""
        if (word, kind) not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            forms = self.near_forms(word, _ENDINGS if kind == "adjective" else ("",))
            self.seen[word, kind] = {c for f in forms for c in self.codes.get((f, kind), ())}
        return self.seen[word, kind]

    def similar_sets(self, ws: list[str]) -> tuple[set[int], float]:
        """Codes of the aliases of several words with the largest share of their words in the
        text, and the share; nothing below LEAST."""
        if not self.sets:
            return set(), 0.0
        share: dict[int, dict[str, float]] = defaultdict(dict)
        for w in map(base, ws):
            for f in self.near_forms(w, ("",)):
                score = 1.0 if f == w else 1 - 1 / len(w)
                for k in self.within.get(f, ()):
                    share[k][f] = max(share[k].get(f, 0.0), score)
        scores = {k: sum(x.values()) / len(self.sets[k][0]) for k, x in share.items()}
        top = max(scores.values(), default=0.0)
        return ({self.sets[k][1] for k, x in scores.items() if x == top}, top) if top >= LEAST else (set(), 0.0)

    def lookup(self, form: str, adjective: bool, unit: set[str]) -> set[int]:
        got = self.codes.get((form, "adjective" if adjective else "noun"), set())
        if not got and adjective and "town" in unit and "district" not in unit:
            got = self.codes.get((form, "noun"), set())
        return got

    def resolve(self, text: str) -> tuple[set[int], float, int, int]:
        """Codes of the text's longest mention, a score (1 found, below 1 similar, 0 none), and
        the mention's length and place."""
        t = fold(text)
        ws = words(t)
        unit = {KINDS[w] for w in ws if w in KINDS}
        best: tuple[set[int], int, int] | None = None
        for start, end, form, rest, code in self.mentions(t):
            if best and (end - start, start) != best[1:]:
                break
            if code is not None:
                best = ((best[0] if best else set()) | {code}, end - start, start)
                continue
            if form in KINDS:
                continue
            adjective = rest in _ENDINGS and (rest != "ом" and rest != "om" or bool(unit & {"district", "area"}))
            if not adjective and rest not in _NOUN_ENDINGS:
                continue
            got = self.lookup(form, adjective, unit)
            if got:
                best = ((best[0] if best else set()) | got, end - start, start)
        if best:
            return best[0], 1.0, best[1], best[2]
        first = "noun" if unit & {"town", "seat"} else "adjective"
        own = [w for w in ws if w not in KINDS]
        codes, score = self.similar_sets(own)
        size = at = 0
        for k, w in enumerate(own):
            if 1 - 1 / len(w) < LEAST:
                continue
            for kind in (first, "adjective" if first == "noun" else "noun"):
                got = self.similar(w, kind)
                if got:
                    if not codes or (1 - 1 / len(w)) > score:
                        codes, score, size, at = got, 1 - 1 / len(w), len(w), k
                    break
        return codes, score, size, at


#: Least similarity of token sets: one slip in a word of five letters is just enough.
LEAST = 0.8
#: Most canonical rows that one automaton holds (some 100 MB); more are taken in blocks.
BLOCK = 100_000
_ASIDE = re.compile(r"\(([^()]*)\)|,\s*([^,()]+)$")


def parted(text: str) -> tuple[str, str]:
    """(name, region written beside it in brackets or after a comma)."""
    t = re.sub(r"[\^$*\\«»\"“”„]|\.\*", " ", text)
    region = ""
    for m in _ASIDE.finditer(t):
        aside = m.group(1) or m.group(2) or ""
        if any(KINDS.get(w) == "region" for w in words(fold(aside))):
            region, t = aside, t.replace(m.group(0), " ")
    return t, region


def match_batch(df: pd.DataFrame, names: Names, regions: Names, region_of: dict[int, int]) -> pd.DataFrame:
    rows = []
    cache: dict[str, set[int]] = {}
    for text, beside in zip(df["text"], df["beside"]):
        name, inside = parted(text)
        codes, score, size, at = names.resolve(name)
        agree = 0  # 2: the region inside the text decides, 1: the one beside it
        for weight, place in ((2, inside), (1, beside)) if codes else ():
            if isinstance(place, str) and place:
                if place not in cache:
                    cache[place] = regions.resolve(place)[0]
                here = {c for c in codes if region_of.get(c) in cache[place]}
                if here:
                    codes, agree = here, weight
                    break
        rows.append((text, beside, sorted(codes), score, size, -at, agree))
    return pd.DataFrame(rows, columns=["text", "beside", "codes", "score", "size", "at", "agree"])


def _alias(name: str) -> list[tuple[tuple[str, str], ...]]:
    """The alias a canonical name gives: its words without those of its kind of unit."""
    own = [w for w in words(fold(name)) if w not in KINDS]
    if len(own) > 1:
        return [tuple((w, "noun") for w in own)]
    return [((stem(w)[0], "adjective" if stem(w)[1] else "noun"),) for w in own]


def match_names(values: DataFrame, canonical: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct (text, beside) of ``values`` with ``codes`` (ARRAY<BIGINT>) and ``score``.

    ``canonical``: (code, region_code, names ARRAY<STRING>), the aliases of each entry;
    ``regions``: (region_code, region_name).  ``beside`` is the region given beside a
    text, or null; a region inside the text goes first.  A text names the entries of its
    longest embedded mention (score 1; ties: the first), or those whose token sets are most
    similar (LEAST to 1), or none: empty ``codes``, score 0.  Null texts are dropped, blank ones name none;
    without canonical entries nothing is named.  An entry that several codes share gives
    all codes unless a region decides.

    Values are reduced to distinct ones before they meet the list.  The list is counted
    first: up to BLOCK rows go to every task as one automaton, a longer list is taken in
    blocks of that size, and the best score and longest mention of all blocks win.  More than
    BLOCK regions raise a ValueError.
    """
    spark = values.sparkSession
    distinct = values.select(F.col("text").cast("string"), F.col("beside").cast("string")).where("text is not null").distinct()
    # Few bytes, much work: spread over all cores, not over as few tasks as the bytes would fill.
    distinct = distinct.repartition(3 * spark.sparkContext.defaultParallelism, "text", "beside")
    region_rows = [(r[0], r[1]) for r in regions.select("region_code", "region_name").dropna().distinct().limit(BLOCK + 1).collect()]
    if len(region_rows) > BLOCK:
        raise ValueError(f"more than {BLOCK} regions")
    region_entries = [(c, a) for c, n in region_rows for a in _alias(n)]
    n = canonical.count()
    blocks = max(1, -(-n // BLOCK))
    part = F.pmod(F.xxhash64("code"), F.lit(blocks))
    got = None
    for b in range(blocks):
        entries, region_of = [], {}
        for code, region, aliases in canonical.where(part == b).select("code", "region_code", "names").collect():
            region_of[code] = region
            entries += [(code, a) for name in aliases or [] if name for a in _alias(name)]

        def run(batches: Iterator[pd.DataFrame], entries=entries, region_of=region_of) -> Iterator[pd.DataFrame]:
            names, places = Names(entries), Names(region_entries)
            for df in batches:
                yield match_batch(df, names, places, region_of)

        one = distinct.mapInPandas(run, "text string, beside string, codes array<bigint>, score double, size int, at int, agree int")
        got = one if got is None else got.unionByName(one)
    if blocks == 1:
        return got.drop("size", "at", "agree")
    rank = F.struct("score", "size", "at", "agree")
    best = got.groupBy("text", "beside").agg(F.max(rank).alias("r")).select(F.col("text").alias("t"), F.col("beside").alias("b"), "r")
    return (
        got.join(best, F.col("text").eqNullSafe(F.col("t")) & F.col("beside").eqNullSafe(F.col("b")) & (rank == F.col("r")))
        .groupBy("text", "beside", "score").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("codes"))
        .select("text", "beside", "codes", "score")
    )


def unmatched(matched: DataFrame, by: list[str]) -> DataFrame:
    """Values without an entry and how many rows hold each: (by, text, rows)."""
    return matched.where(F.size("codes") == 0).groupBy(*by, "text").agg(F.count("*").alias("rows"))
