"""Full-text search: a query language, an inverted index, variants, BM25-based ranks, snippets.

``TextIndex`` is built by one scan of the texts and kept as tables: postings
(word, row, field, positions), and the vocabulary with document counts. Postings
are written where the texts are read, by segments of some thousand rows: a row a
word of a segment, sorted by word, so no posting is shuffled. A query is expanded
on the driver and matched against the vocabulary, that is against distinct words;
the words that match pick their postings. Ranks of words are Column arithmetic;
those of one term are reduced by Spark, and how the words of several terms add up
in a row (distances, phrases, synonyms) depends on their order and is folded a row
at a time in Arrow batches.

Differences by design: all matching rows are ranked, without a limit on merged
rows; stop words are dropped from queries (unless marked by +, -, * or ~) but are in
the index, so phrases of them can be found; an index is rebuilt as a whole when its namespace changes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import QueryError
from ..storage import written
from .stemming import STEMMERS

#: The default English stop words.
STOP_WORDS = set(
    """a about above after again against all am an and any are aren as at be because been before being below between both but by can cannot could couldn
    did didn do does doesn doing dont down during each few for from further had hadn hadnt has hasn hasnt have havent having he hed hell hes her here hers
    herself him himself his how hows i id im if in into is it its itself ll me more most must my myself no nor not of off on once only or other ought our
    ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too
    under until up ve very was we were what when where which while who whom why with will would you your yours yourself yourselves""".split()
)
#: So many words that a query matches, the most frequent ones, are looked up by value; further ones are joined.
WORDS_BY_VALUE = 1000
#: Characters of the texts that make a segment of an index, at most (one text at least).
SEGMENT_CHARACTERS = 4_000_000


@dataclass
class Config:
    """Of a text index; shares (``typo``, ``concat``, ...) are in percent of a full match."""

    stop_words: set[str] = field(default_factory=lambda: set(STOP_WORDS))
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    terms_boost: dict[str, float] = field(default_factory=dict)
    stemmers: tuple[str, ...] = ("en", "ru")
    bm25: str = "rx"  # rx classic word_count
    k1: float = 2.0
    b: float = 0.75
    bm25_weight: float = 0.1
    length_weight: float = 0.3
    position_weight: float = 0.1
    distance_weight: float = 0.5
    full_match_boost: float = 1.1
    sum_ranks_by_fields: float = 0.0
    concat_share: float = 90.0
    split_share: float = 90.0
    typo: float = 85.0
    typo_penalty: float = 15.0
    prefix_min: int = 20
    suffix_min: int = 10
    step: int = 15
    stem_penalty: int = 15
    min_rank: float = 5.0
    max_typos: int = 2
    max_typo_len: int = 15
    max_missing_letters: int = 2
    max_extra_letters: int = 2
    max_typo_distance: int = 0
    max_permutation_distance: int = 1
    min_part: int = 3
    translit: bool = True
    stemming: bool = True
    keyboard: bool = True
    concat: bool = True
    split: bool = True
    numbers: bool = False
    preselect: bool = False
    splitter: str = "fast"  # or mmseg_cn, with a dictionary of words and how often they are used
    dictionary: dict[str, int] = field(default_factory=dict)
    diacritics: bool = True  # kept; else a letter and its marks are the letter
    extra_symbols: str = "-+/'"  # of words, between letters

    def splitting(self) -> tuple:
        """What an index's words hang on."""
        return (self.splitter, self.diacritics, self.extra_symbols, len(self.dictionary))


@dataclass
class Term:
    word: str
    op: str = "or"  # or, must, not
    exact: bool = False
    prefix: bool = False
    suffix: bool = False
    typos: bool = False
    boost: float = 1.0
    phrase: int = -1
    gap: int = 1
    length: float = 1.0  # of the longest term's


@dataclass(frozen=True)
class Variant:
    """A pattern that stands for a term, how well, and what may still be derived from it."""

    word: str
    proc: float
    prefix: bool = False
    suffix: bool = False
    typos: bool = False
    stem: bool = True
    synonyms: bool = True
    split: bool = True


@dataclass
class Parsed:
    fields: dict[str, float] = field(default_factory=dict)
    terms: list[Term] = field(default_factory=list)


WORD = re.compile(r"[^\W_]+(?:[-+/'][^\W_]+)*")


def parse(text: str, config: Config | None = None) -> Parsed:
    """``@field^2,other =exact *suffix prefix* typo~ word^2 +must -not "a phrase"~3 \\escape``."""
    config, out, at, phrase = config or Config(), Parsed(), 0, 0
    m = re.match(r"\s*@([\w.*+,^]+)", text)
    if m:
        for part in m[1].split(","):
            name, _, boost = part.lstrip("+").partition("^")
            out.fields[name] = float(boost or 1)
        at = m.end()
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
            continue
        op = "or"
        if c in "+-" and at + 1 < len(text) and not text[at + 1].isspace():
            op, at = ("must" if c == "+" else "not"), at + 1
            c = text[at]
        if c in "\"'":
            end = text.find(c, at + 1)
            if end < 0:
                raise QueryError("a quote isn't closed")
            words, at = words_in(text[at + 1 : end], config), end + 1
            m = re.match(r"~(\d+)", text[at:])
            gap = int(m[1]) if m else 1
            at += m.end() if m else 0
            out.terms += [Term(w, op, phrase=phrase, gap=gap) for w in words]
            phrase += 1
            continue
        m = re.match(r"(=?)(\*?)((?:\\.|[^\s\"~^*])+)([*~]*)(?:\^(\d+(?:\.\d+)?))?([*~]*)", text[at:])
        if not m:
            at += 1
            continue
        at += m.end()
        words = words_in(re.sub(r"\\(.)", r"\1", m[3]), config)
        marks = m[4] + m[6]
        for w in words:
            if w not in config.stop_words or op != "or" or marks or m[2]:  # as it stands, not asked for by name or as a part
                out.terms.append(Term(w, op, bool(m[1]), "*" in marks, bool(m[2]), "~" in marks, float(m[5] or 1)))
    if out.terms and all(t.op == "not" for t in out.terms):
        raise QueryError("a query of excluded words alone finds nothing")
    longest = max((len(t.word) for t in out.terms), default=1)
    for t in out.terms:
        t.length = len(t.word) / longest
    return out


RU = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdezijklmnoprstufye", strict=True)) | {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ё": "e", "ь": "", "ъ": ""}
KEYS_EN, KEYS_RU = "qwertyuiop[]asdfghjkl;'zxcvbnm,.", "йцукенгшщзхъфывапролджэячсмитьбю"
EN = {v: k for k, v in RU.items() if v and k != "ё"}


def translit(word: str) -> str:
    if re.search("[а-яё]", word):
        return "".join(RU.get(c, c) for c in word)
    out, at = "", 0
    while at < len(word):
        for n in (4, 2, 1):
            if word[at : at + n] in EN:
                out += EN[word[at : at + n]]
                at += n
                break
        else:
            out += word[at]
            at += 1
    return out


def other_layout(word: str) -> str:
    table = str.maketrans(KEYS_EN + KEYS_RU, KEYS_RU + KEYS_EN)
    return word.translate(table)


def numbers_as_words(word: str) -> list[str]:
    """English and Russian words of a whole number below a million, digit groups in order."""
    if not word.isdigit() or len(word) > 6:
        return []
    return [w for names in NUMBERS.values() for w in _spelled(int(word), names)]


#: Names of 0 to 19, of tens, and of hundreds by language (fixed values); thousands are left out as a word of their own.
NUMBERS = {
    "en": ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), "twenty thirty forty fifty sixty seventy eighty ninety".split(), []),
    "ru": ("ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split(), "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split(), "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()),
}


def _spelled(n: int, names: tuple[list[str], list[str], list[str]]) -> list[str]:
    small, tens, hundreds = names
    if n >= 1000:
        return _spelled(n // 1000, names) + (_spelled(n % 1000, names) if n % 1000 else [])
    out = []
    if n >= 100:
        out += [hundreds[n // 100 - 1]] if hundreds else [small[n // 100], "hundred"]
        n %= 100
        if not n:
            return out
    if n < 20:
        return [*out, small[n]]
    return [*out, tens[n // 10 - 2], *([small[n % 10]] if n % 10 else [])]


class Typos:
    """Words that a pattern turns into by deleting letters in both.

    Up to half of ``max_typos`` (rounded up) in each, ``max_typos`` in sum. Where
    letters go in both, they have to stand at about the same place, or to be
    the same letter moved.
    """

    def __init__(self, pattern: str, proc: float, c: Config):
        self.pattern, self.proc, self.c = pattern, proc, c
        self.most = -(-c.max_typos // 2)
        self.cuts: dict[str, list[tuple[int, ...]]] = {}
        for text, at in self.deletions(pattern):
            self.cuts.setdefault(text, []).append(at)

    def deletions(self, word: str) -> Iterator[tuple[str, tuple[int, ...]]]:
        yield word, ()
        n = len(word)
        if self.most < 1 or n < 3 or n > self.c.max_typo_len:
            return
        for i in range(n):
            yield word[:i] + word[i + 1 :], (i,)
        if self.most > 1 and n > 3:
            for i in range(n):
                for j in range(i + 1, n):
                    yield word[:i] + word[i + 1 : j] + word[j + 1 :], (i, j)

    def proc_of(self, word: str) -> float | None:
        """How well ``word`` matches, if it does."""
        if abs(len(word) - len(self.pattern)) > self.most:
            return None
        best = None
        for text, at in self.deletions(word):
            for own in self.cuts.get(text, ()):
                if len(at) + len(own) <= self.c.max_typos and self.allowed(own, at, word):
                    typos = max(len(own), len(at))
                    loss = typos * self.c.typo_penalty / max((len(word.encode()) - typos) / 3, 1.0)
                    best = max(best or 0.0, self.proc * self.c.typo / 100 - loss, 1.0)
        return best

    def allowed(self, own: tuple[int, ...], other: tuple[int, ...], word: str) -> bool:
        c = self.c
        if 0 <= c.max_extra_letters < len(own) - len(other) or 0 <= c.max_missing_letters < len(other) - len(own):
            return False
        if not own or not other or c.max_typo_distance < 0:
            return True
        near = lambda a, b: abs(a - b) <= c.max_typo_distance
        moved = lambda a, b: self.pattern[a] == word[b] and (c.max_permutation_distance < 0 or abs(a - b) <= c.max_permutation_distance)
        wide = c.max_permutation_distance < 0 or c.max_permutation_distance > c.max_typo_distance
        if len(own) == 1 and len(other) == 1:
            return near(own[0], other[0]) or (wide and moved(own[0], other[0]))
        if len(own) == 2 and len(other) == 2:
            pairings = [((own[0], other[0]), (own[1], other[1])), ((own[0], other[1]), (own[1], other[0]))]
            if any(near(*x) and near(*y) for x, y in pairings):
                return True
            return wide and any((moved(*x) or near(*x)) and (moved(*y) or near(*y)) and (moved(*x) or moved(*y)) for x, y in pairings)
        one, two = (own[0], other) if len(own) == 1 else (other[0], own)
        if near(one, two[1] - 1) or near(one, two[0]):
            return True
        return wide and any(moved(one, t) if len(own) == 1 else moved(t, one) for t in two)


def wanted_typos(q: Parsed, c: Config) -> list[Typos]:
    """What has to be looked for in the vocabulary before the query can be expanded."""
    return [Typos(v.word, v.proc, c) for i, t in enumerate(q.terms) if t.typos and c.max_typos > 0 for v in _begun(q, i, c)]


def wanted_parts(q: Parsed, c: Config) -> set[str]:
    """Halves of terms, that count only if both are words of the vocabulary."""
    return {p for t in q.terms if _splits(t, c) for i in range(2, len(t.word) - 2) for p in (t.word[:i], t.word[i:])}


def _splits(t: Term, c: Config) -> bool:
    return c.split and t.op == "or" and t.phrase < 0 and not t.exact


def _added(variants: list[Variant], new: list[Variant], c: Config) -> list[Variant]:
    return variants + [v for v in new if v.word and v.word not in c.stop_words]


def _begun(q: Parsed, i: int, c: Config) -> list[Variant]:
    """The term, what it makes with the term before it, and both in the other keyboard layout."""
    t = q.terms[i]
    out = [Variant(t.word, 100.0, t.prefix, t.suffix, t.typos)]
    if t.exact and t.phrase < 0:
        return out
    if c.concat and i and t.phrase < 0:
        p = q.terms[i - 1]
        if t.op == p.op == "or" and not p.exact and p.phrase < 0:
            out.append(Variant(p.word + t.word, c.concat_share, t.prefix, p.suffix, t.typos and p.typos, split=False))
    if c.keyboard:
        out = _added(out, [_like(v, o, v.proc * 0.9) for v in out if (o := other_layout(v.word)) != v.word], c)
    return out


def _like(v: Variant, word: str, proc: float, **changes) -> Variant:
    return Variant(**(v.__dict__ | {"word": word, "proc": proc} | changes))


def _parted(v: Variant, phrase: bool, c: Config) -> list[Variant]:
    """Parts of a word with delimiters, and the word without them."""
    parts = [p for p in re.split(r"[-+/'_`]", v.word) if p]
    if len(parts) < 2:
        return []
    out, proc = [], v.proc * 0.8
    for k, p in enumerate(parts):
        if not phrase and len(p) >= c.min_part:
            last = k == len(parts) - 1
            out.append(_like(v, p, proc, synonyms=False, stem=last and v.stem and len(p) >= 5, prefix=last and v.prefix, suffix=last and v.suffix))
    joined = "".join(parts)
    return [*out, _like(v, joined, proc, stem=v.stem and len(joined) >= 5)]


def _stemmed(variants: list[Variant], t: Term, c: Config) -> list[Variant]:
    new, out = [], []
    for v in variants:
        if v.stem and c.stemming and not (t.op == "not" and v.suffix):
            for language in c.stemmers:
                root = STEMMERS[language](v.word)
                if root != v.word and len(root) > 1:
                    new.append(_like(v, root, max(1.0, v.proc - c.stem_penalty), prefix=True, stem=False))
        out.append(_like(v, v.word, v.proc, stem=False))
    return _added(out, new, c)


def _transliterated(variants: list[Variant], c: Config) -> list[Variant]:
    return _added(variants, [_like(v, w, v.proc * 0.9) for v in variants if (w := translit(v.word)) != v.word], c) if c.translit else variants


def _synonyms(variants: list[Variant], t: Term, c: Config) -> list[Variant]:
    if t.op == "not":
        return variants
    new = [_like(v, s, v.proc * 0.95, synonyms=False, stem=True, prefix=False, suffix=False) for v in variants if v.synonyms for s in c.synonyms.get(v.word, []) if " " not in s]
    return _added(variants, new, c)


def variants(q: Parsed, i: int, c: Config, typos: dict[str, float] | None = None) -> list[Variant]:
    """All patterns of term ``i``; ``typos`` are the vocabulary's words that it turns into."""
    t = q.terms[i]
    out = _begun(q, i, c)
    first = out[0]
    fixed = [_like(first, w, p, stem=first.stem and len(w) >= 5, typos=False) for w, p in (typos or {}).items()]
    if t.exact and t.phrase < 0:
        return _added(out, fixed, c)
    out = _added(out, fixed, c)
    out = _added(out, [n for v in out for n in _parted(v, t.phrase >= 0, c)], c)
    if c.numbers and t.phrase < 0:
        out = _added(out, [_like(first, w, 95.0, synonyms=False, stem=False) for w in numbers_as_words(t.word)], c)
    if t.phrase >= 0:
        out = _synonyms(out, t, c)
        return out if t.exact else _stemmed(_transliterated(out, c), t, c)
    out = _stemmed(_transliterated(out, c), t, c)
    return _stemmed(_synonyms(out, t, c), t, c)


@dataclass
class Group:
    """Words that stand for terms only if a row holds all of them: halves of a term, or a synonym of several words."""

    parts: list[list[Variant]]
    boost: float = 1.0
    length: float = 1.0


def groups(q: Parsed, c: Config, known: set[str]) -> list[Group]:
    out = []
    for t in q.terms:
        if _splits(t, c):
            for i in range(2, len(t.word) - 2):
                head, tail = t.word[:i], t.word[i:]
                if {head, tail} <= known and not {head, tail} & c.stop_words:
                    proc = 50.0 * c.split_share / 100
                    first, second = ([Variant(w, proc, pre, suf, stem=len(w) >= 5)] for w, pre, suf in ((head, t.prefix, False), (tail, False, t.suffix)))
                    out.append(Group([_stemmed(_transliterated(part, c), t, c) for part in (first, second)], t.boost, t.length))
    plain = [t for t in q.terms if t.op == "or" and t.phrase < 0 and not t.exact]
    words = [t.word for t in plain]
    for key, others in c.synonyms.items():
        tokens = key.split()
        if {*tokens} <= {*words}:
            boost, length = (sum(getattr(plain[words.index(w)], a) for w in tokens) / len(tokens) for a in ("boost", "length"))
            for other in others:
                alternative = [w for w in other.split() if w not in c.stop_words]
                if len(tokens) > 1 or len(alternative) > 1:
                    out.append(Group([_stemmed([Variant(w, 95.0)], plain[0], c) for w in alternative], boost, length))
    return out


class Matcher:
    """Which numbered pattern lists a word matches, and how well."""

    def __init__(self, lists: list[list[Variant]], c: Config):
        self.c = c
        self.exact: dict[str, list[tuple[int, Variant]]] = {}
        self.heads: dict[str, list[tuple[int, Variant]]] = {}
        self.tails: dict[str, list[tuple[int, Variant]]] = {}
        self.inner: list[tuple[int, Variant]] = []
        for i, some in enumerate(lists):
            for v in some:
                if v.prefix and v.suffix:
                    self.inner.append((i, v))
                else:
                    (self.heads if v.prefix else self.tails if v.suffix else self.exact).setdefault(v.word, []).append((i, v))
        self.head_sizes, self.tail_sizes = ({len(w) for w in x} for x in (self.heads, self.tails))

    def may_match(self, word: Column) -> Column:
        """The same test on a column, which reaches scans: true for just the words that match."""
        tests = [word.isin(*sorted(self.exact))] if self.exact else []
        if len(self.heads) <= 10:
            tests += [word.startswith(w) for w in self.heads]
        else:
            tests += [F.substring(word, 1, n).isin(*sorted(w for w in self.heads if len(w) == n)) for n in self.head_sizes]
        if len(self.tails) <= 10:
            tests += [word.endswith(w) for w in self.tails]
        else:
            tests += [F.substring(word, -n, n).isin(*sorted(w for w in self.tails if len(w) == n)) for n in self.tail_sizes]
        tests += [word.contains(v.word) for _, v in self.inner]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def __call__(self, word: str) -> dict[int, float]:
        out: dict[int, float] = {}

        def met(found: list[tuple[int, Variant]], before: int) -> None:
            for i, v in found:
                size = len(v.word.encode())
                off = abs(len(word.encode()) - size + len(word[:before].encode()))
                proc = min(v.proc, max(v.proc - self.c.step * off / max(size, 3), self.c.suffix_min if before else self.c.prefix_min)) if off else v.proc
                boost = max(self.c.terms_boost.get(word, 0.0), self.c.terms_boost.get(v.word, 0.0))
                out[i] = max(out.get(i, 0.0), proc * boost if boost > 0 else proc)

        met(self.exact.get(word, []), 0)
        for n in self.head_sizes:
            met(self.heads.get(word[:n], []) if n <= len(word) else [], 0)
        for n in self.tail_sizes:
            met(self.tails.get(word[len(word) - n :], []) if n <= len(word) else [], len(word) - n)
        for i, v in self.inner:
            at = word.find(v.word)
            if at >= 0:
                met([(i, v)], at)
        return out


def bound(k, weight: float, boost: float = 1.0):
    return k * (boost * weight) + (1.0 - weight)


def position_rank(pos: Column) -> Column:
    p = pos.cast("double")
    return F.when(p <= 10, 1 - p / 100).when(p <= 100, 0.9 - p / 1e3).when(p <= 1000, 0.8 - p / 1e4).when(p <= 10000, 0.7 - p / 1e5).when(p <= 100000, 0.6 - p / 1e6).otherwise(0.5)


def bm25(tf: Column, length: Column, average: Column, total: Column, matched: Column, c: Config) -> Column:
    if c.bm25 == "word_count":
        return tf.cast("double")
    if c.bm25 == "classic":
        idf, f = F.ln(total / (matched + 1)) + 1, tf / length
    else:
        idf, f = F.greatest(F.lit(0.2), F.ln((total - matched + 1) / matched) / F.ln(total + 1)), tf.cast("double")
    return idf * f * (c.k1 + 1) / (f + c.k1 * (1 - c.b + c.b * length / average))


def tokens(text: Column, config: Config | None = None) -> Column:
    """The words of a text in lower case."""
    c = config or Config()
    if c.splitter == "fast" and c.diacritics and c.extra_symbols == "-+/'":
        return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[-+/'][\p{L}\p{N}]+)*)"), 1)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words_in(t, c), na_action="ignore")

    return split(text)


def words_in(text: str, c: Config) -> list[str]:
    return splitter(c)(text)


def splitter(c: Config) -> Callable[[str], list[str]]:
    """The words of a text by a config's rules."""
    inside = f"[{re.escape(c.extra_symbols)}]" if c.extra_symbols else "(?!)"
    words_of = re.compile(rf"[^\W_]+(?:{inside}[^\W_]+)*").findall
    longest = max(map(len, c.dictionary), default=1)

    def split(text: str) -> list[str]:
        text = text.lower()
        if not c.diacritics:
            text = "".join(ch for ch in unicodedata.normalize("NFD", text) if not unicodedata.combining(ch))
        words = words_of(text)
        if c.splitter == "mmseg_cn":
            words = [w for run in words for part in re.findall(r"[\u3400-\u9fff]+|[^\u3400-\u9fff]+", run) for w in (segment(part, c.dictionary, longest) if part[0] >= "\u3400" else [part])]
        return words

    return split


def segment(text: str, dictionary: dict[str, int], longest: int) -> list[str]:
    """Words of a run of Chinese by the published MMSEG rules.

    Of all chunks of three words at a place: the longest in sum, then the largest
    average length, the least variance, the most usual one-character words. The
    chunk's first word is taken.
    """

    def words_at(i: int) -> list[str]:
        return [text[i:j] for j in range(min(len(text), i + longest), i + 1, -1) if text[i:j] in dictionary] + [text[i : i + 1]]

    out, at = [], 0
    while at < len(text):
        best = None
        for a in words_at(at):
            for b in words_at(at + len(a)) if at + len(a) < len(text) else [""]:
                end = at + len(a) + len(b)
                for c in words_at(end) if b and end < len(text) else [""]:
                    chunk = [w for w in (a, b, c) if w]
                    total, mean = sum(map(len, chunk)), sum(map(len, chunk)) / len(chunk)
                    rank = (total, mean, -sum((len(w) - mean) ** 2 for w in chunk), sum(math.log(dictionary.get(w, 0) + 1) for w in chunk if len(w) == 1))
                    if best is None or rank > best[0]:
                        best = (rank, a)
        out.append(best[1])
        at += len(best[1])
    return out


@dataclass
class TextIndex:
    """Postings ``word, f, first, keys.., len, pos``, vocabulary ``word, docs``, and what a rank needs of the whole."""

    postings: DataFrame
    words: DataFrame
    fields: list[str]
    keys: list[str]
    total: int
    average: list[float]


def _names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def build(df: DataFrame, keys: list[str], fields: list[str], config: Config | None = None) -> TextIndex:
    """One scan of ``df``; nothing but counts of words by task is shuffled."""
    c, ks = config or Config(), _names(keys)
    kinds = [df.select(F.col(f"`{k}`")).schema.fields[0].dataType.simpleString() for k in keys]
    rows = df.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks, strict=True)), *(F.col(f).cast("string").alias(f"_t{i}") for i, f in enumerate(fields)))
    hit = ", ".join(["first: boolean", *(f"{a}: {t}" for a, t in zip(ks, kinds, strict=True)), "len: int, pos: array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.asarray(pc.fill_null(pc.utf8_length(batch.column(f"_t{i}")), 0), np.int64) for i in range(len(fields)))
            before, at = np.concatenate([[0], np.cumsum(sizes)]), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(before, before[at] + SEGMENT_CHARACTERS, "right")) - 1)
                yield from segment_of(batch.slice(at, end - at), ks, len(fields), c)
                at = end

    stored = written(rows.mapInArrow(run, f"word string, f int, docs long, hits array<struct<{hit}>>"), "postings")
    words = written(stored.where("word <> ''").groupBy("word").agg(F.sum("docs").alias("docs")), "words")
    postings = stored.select("word", "f", F.inline("hits"))
    sizes = {r["f"]: r for r in postings.where("word = ''").groupBy("f").agg(F.count("*").alias("n"), F.avg("len").alias("a")).collect()}  # a row a field
    return TextIndex(postings, words, fields, keys, sizes[0]["n"] if sizes else 0, [sizes[f]["a"] if sizes else 0.0 for f in range(len(fields))])


@lru_cache(4)
def _classes(symbols: str) -> np.ndarray:
    """By code point: 1 in words, 2 within them, else 0."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000)
    out[[ord(ch) for ch in symbols]] = 2
    return out


def words_of_all(texts: list[str], c: Config) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts one after another, and how many each has; the same as ``words_in`` of each."""
    if c.splitter != "fast" or not c.diacritics or any(ch.isalnum() for ch in c.extra_symbols):
        split = splitter(c)
        spoken = [split(t) if t else [] for t in texts]
        return pa.array([w for own in spoken for w in own], pa.string()), np.array([len(own) for own in spoken], np.int32)
    lower = [t.lower() for t in texts]
    joined = "\n".join(lower) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    of = _classes(c.extra_symbols)[points]
    inside = of == 1
    between = inside[:-2] & inside[2:] & (of[1:-1] == 2)
    inside[1:-1] |= between
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))  # a word's start and end in turn
    wide = np.ones(len(points) + 1, np.uint8)
    for limit in (0x80, 0x800, 0x10000):
        wide[:-1] += points >= limit
    at = np.cumsum(wide, dtype=np.int32) - wide  # of a code point in the bytes
    data = joined.encode()
    offsets = np.append(at[edge], np.int32(len(data)))
    pieces = pa.StringArray.from_buffers(len(edge), pa.py_buffer(offsets), pa.py_buffer(data))  # words, and what is between
    ends = np.cumsum([len(t) + 1 for t in lower])
    counts = np.diff(np.searchsorted(edge[::2], ends), prepend=0).astype(np.int32)
    return pieces.take(pa.array(np.arange(0, len(edge), 2))), counts


def segment_of(rows: pa.RecordBatch, ks: list[str], n_fields: int, c: Config) -> Iterator[pa.RecordBatch]:
    """An inverted index of some rows, words in order; the empty word tells of the fields themselves."""
    n = rows.num_rows
    spoken, counts = words_of_all([t or "" for f in range(n_fields) for t in rows.column(f"_t{f}").to_pylist()], c)
    counts = counts.reshape(n_fields, n)
    coded = spoken.dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary), np.int64)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    word = place[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int32)
    text = np.repeat(np.arange(n_fields * n, dtype=np.int32), counts.ravel())  # field * n + row
    spot = np.arange(len(word), dtype=np.int32) - np.repeat((np.cumsum(counts.ravel()) - counts.ravel()).astype(np.int32), counts.ravel())
    by_word = np.argsort(word, kind="stable")  # then by field, row and place, as they come
    word, text, spot = word[by_word], text[by_word], spot[by_word]
    fresh = np.flatnonzero(np.concatenate([np.ones(min(len(word), 1), bool), (word[1:] != word[:-1]) | (text[1:] != text[:-1])]))  # a posting each
    word, text, ends = word[fresh], text[fresh], np.append(fresh, len(spot))
    field_of, row = text // n, text % n
    first = field_of == 0
    if n_fields > 1:
        first = np.zeros(len(word), bool)
        first[np.unique(word.astype(np.int64) * n + row, return_index=True)[1]] = True
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(word), 1), bool), (word[1:] != word[:-1]) | (field_of[1:] != field_of[:-1])]))  # a row each
    docs = np.add.reduceat(first.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
    # the empty word's rows come first
    every = np.tile(np.arange(n), n_fields)
    names = pa.concat_arrays([pa.array([""] * n_fields, pa.string()), coded.dictionary.take(pa.array(order[word[heads]]))])
    taken = pa.array(np.concatenate([every, row]))
    spots = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n_fields * n, np.int32), ends.astype(np.int32)])), pa.array(spot))
    hits = pa.StructArray.from_arrays(
        [pa.array(np.concatenate([np.repeat(np.arange(n_fields) == 0, n), first])), *(rows.column(a).take(taken) for a in ks), pa.array(np.concatenate([counts.ravel(), counts[field_of, row]])), spots],
        names=["first", *ks, "len", "pos"],
    )
    starts = np.concatenate([np.arange(n_fields) * n, heads + n_fields * n, [n_fields * n + len(word)]]).astype(np.int32)
    out = [names, pa.array(np.concatenate([np.arange(n_fields), field_of[heads]]), pa.int32()), pa.array(np.concatenate([np.zeros(n_fields, np.int64), docs])), pa.ListArray.from_arrays(pa.array(starts), hits)]
    made = pa.RecordBatch.from_arrays(out, names=["word", "f", "docs", "hits"])
    for at in range(0, made.num_rows, 8192):
        yield made.slice(at, 8192)


def changed(index: TextIndex, delta: DataFrame, config: Config | None = None) -> TextIndex:
    """The index after changes: ``delta`` holds the new rows, and the keys of deleted ones (``_gone``).

    Postings of changed rows are left out when they are read; counts are
    corrected by what these rows held. Costs the size of the changes, and one
    scan of postings by key.
    """
    ks = _names(index.keys)
    gone = delta.select(*(F.col(f"`{k}`").alias(a) for k, a in zip(index.keys, ks, strict=True)))
    fresh = build(delta.where("not _gone"), index.keys, index.fields, config)
    lost = index.postings.join(gone, ks, "left_semi").groupBy("word", "f").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.count("*").alias("n"), F.sum("len").alias("len"))
    lost = written(lost, "lost")
    less = lost.where("word <> ''").groupBy("word").agg((-F.sum("docs")).alias("docs"))
    words = index.words.unionByName(less).unionByName(fresh.words).groupBy("word").agg(F.sum("docs").alias("docs")).where("docs > 0")
    out = {r["f"]: r for r in lost.where("word = ''").collect()}  # a row a field
    total, average = index.total + fresh.total - (out[0]["n"] if out else 0), []
    for f in range(len(index.fields)):
        length = index.average[f] * index.total + fresh.average[f] * fresh.total - (out[f]["len"] if out else 0)
        average.append(length / total if total else 0.0)
    postings = index.postings.join(gone, ks, "left_anti").unionByName(fresh.postings)
    return TextIndex(postings, written(words, "words"), index.fields, index.keys, total, average)


@dataclass
class Expanded:
    """A query with everything that it matches: pattern lists of its terms, then those of its groups' parts."""

    q: Parsed
    lists: list[list[Variant]]
    of_groups: list[Group]


def expand(index: TextIndex, q: Parsed, c: Config) -> Expanded:
    """Look up typos and halves of terms among the distinct words, then list all patterns."""
    looked, parts = wanted_typos(q, c), wanted_parts(q, c)
    owner = [i for i, t in enumerate(q.terms) if t.typos and c.max_typos > 0 for _ in _begun(q, i, c)]
    typos: dict[int, dict[str, float]] = {}
    known: set[str] = set()
    if looked:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(w, k, p) for w in batch.column(0).to_pylist() for k, x in enumerate(looked) if (p := x.proc_of(w)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.float64())], names=["w", "k", "p"])

        sizes = [len(x.pattern) + d for x in looked for d in (-x.most, x.most)]
        near = index.words.where(F.length("word").between(min(sizes), max(sizes))).select("word").mapInArrow(run, "w string, k int, p double")
        for r in near.collect():  # distinct words within a few letters of the query's
            if r["w"] not in c.stop_words:
                own = typos.setdefault(owner[r["k"]], {})
                own[r["w"]] = max(own.get(r["w"], 0.0), r["p"])
    if parts:
        known = {r["word"] for r in index.words.where(F.col("word").isin(*parts)).collect()}  # halves of the query's terms
    lists = [variants(q, i, c, typos.get(i)) for i in range(len(q.terms))]
    return Expanded(q, lists, groups(q, c, known))


def search(df: DataFrame, keys: list[str], fields: list[str], text: str, config: Config | None = None) -> DataFrame:
    """``keys`` and ``_ft`` (rank, 0 to 255) of the rows of ``df`` that match, by an index made for this."""
    return ask(build(df, keys, fields, config), text, config)


def ask(index: TextIndex, text: str, config: Config | None = None, only: DataFrame | None = None, debug: bool = False) -> DataFrame:
    """``_k0, ..`` (the keys) and ``_ft`` (rank, 0 to 255) of the rows that match, among those of ``only`` (keys) if given.

    With ``debug`` also ``_why``, how the rank came about.
    """
    c = config or Config()
    q = parse(text, c)
    fields, ks = index.fields, _names(index.keys)
    boosts = [1.0] * len(fields) if not q.fields or "*" in q.fields else [q.fields.get(f, 0.0) for f in fields]
    if not q.terms:
        return index.postings.limit(0).select(*ks, F.lit(0.0).alias("_ft"))
    full = expand(index, q, c)
    parts = [(g, k) for g, group in enumerate(full.of_groups) for k in range(len(group.parts))]
    match = Matcher([*full.lists, *(p for group in full.of_groups for p in group.parts)], c)
    owners = [*q.terms, *(full.of_groups[g] for g, _ in parts)]

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [[*match(w).items()] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[{"t": i, "proc": p} for i, p in x] for x in met], HITS)], names=["word", "docs", "as"])

    met = index.words.where(match.may_match(F.col("word"))).mapInArrow(matching, "word string, docs long, as array<struct<t: int, proc: double>>")
    postings = index.postings.where("word <> ''")
    if only is not None:
        postings = postings.join(only, ks, "left_semi")
    few = met.orderBy(F.col("docs").desc(), "word").limit(WORDS_BY_VALUE + 1).collect()
    often = sorted(r["word"] for r in few[:WORDS_BY_VALUE])
    # the filter reaches the scan, and what is broadcast has this many rows at most
    hits = postings.where(F.col("word").isin(*often)).join(F.broadcast(df_of(index.words.sparkSession, few[:WORDS_BY_VALUE])), "word")
    if len(few) > WORDS_BY_VALUE:  # of the rarer words, those postings alone are shuffled that match
        rarer = postings.where(match.may_match(F.col("word")) & ~F.col("word").isin(*often))
        hits = hits.unionByName(rarer.join(met.where(~F.col("word").isin(*often)), "word"))
    hits = hits.where(F.element_at(F.array(*map(F.lit, boosts)), F.col("f") + 1) > 0).select("word", "f", *ks, "len", "pos", "docs", F.inline("as"))
    pick = lambda values, at: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(at) + 1)
    rank = (
        pick(boosts, "f")
        * bound(bm25(F.size("pos"), F.col("len"), pick(index.average, "f"), F.lit(float(index.total)), F.col("docs"), c), c.bm25_weight)
        * bound(pick([x.length for x in owners], "t"), c.length_weight)
        * bound(position_rank(F.get("pos", F.lit(0))), c.position_weight)
        * pick([x.boost for x in owners], "t")
        * F.col("proc")
    )
    if len(q.terms) == 1 and q.terms[0].phrase < 0 and not parts and c.sum_ranks_by_fields <= 0 and not debug:
        folded = best_of(hits, ks, rank, c)
    else:
        by_row = hits.groupBy(*ks).agg(F.collect_list(F.struct("t", "word", "f", rank.alias("r"), "proc", "len", "pos")).alias("hits"))
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in by_row.schema.fields[: len(ks)]]
        folded = by_row.mapInArrow(fold_rows(q, len(q.terms), parts, full.of_groups, boosts, c, debug), ", ".join([*kinds, "_ft double, _why string"]))
    folded = written(folded.where(F.col("_ft") >= c.min_rank), "ranks")  # read twice
    top = folded.agg(F.max("_ft").alias("_top"))
    out = folded.crossJoin(F.broadcast(top))  # a row of the maximum
    scaled = F.floor(F.col("_ft") * F.when(F.col("_top") > 255, 255.0 / F.col("_top")).otherwise(1.0)).cast("double")
    return out.select(*ks, scaled.alias("_ft"), *(["_why"] if debug else []))


HITS = pa.list_(pa.struct([("t", pa.int32()), ("proc", pa.float64())]))


def df_of(spark, rows: list) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], "word string, docs long, as array<struct<t: int, proc: double>>")


def best_of(hits: DataFrame, ks: list[str], rank: Column, c: Config) -> DataFrame:
    """What ``fold_rows`` makes of a single term: a row's best word, of equal ones that which matches best, then the first."""
    best = hits.withColumn("r", rank).where("r > 0").groupBy(*ks).agg(F.min(F.struct((-F.col("r")).alias("r"), (-F.col("proc")).alias("proc"), "word", "f", "len")).alias("x"))
    return best.select(*ks, (-F.col("x.r") * F.when(F.col("x.len") == 1, c.full_match_boost).otherwise(1.0)).alias("_ft"))


def apart(last: dict[int, list[int]], now: dict[int, list[int]]) -> int:
    """The least distance of positions in one field; 0 if they share none."""
    best = None
    for f, own in now.items():
        i = j = 0
        other = last.get(f, [])
        while i < len(own) and j < len(other):
            gap = abs(own[i] - other[j])
            best = gap if best is None else min(best, gap)
            if own[i] > other[j]:
                j += 1
            else:
                i += 1
    return best or 0


def fold_rows(q: Parsed, n_terms: int, parts: list[tuple[int, int]], of_groups: list[Group], boosts: list[float], c: Config, debug: bool = False):
    """Batches of keys and word hits to keys, rank before scaling (null if a row doesn't match), and with ``debug`` what made it."""
    steps: list[tuple[str, list[int]]] = []  # terms and phrases in order
    for i, t in enumerate(q.terms):
        if t.phrase >= 0 and steps and q.terms[steps[-1][1][0]].phrase == t.phrase:
            steps[-1][1].append(i)
        else:
            steps.append((t.op, [i]))

    def subterms(hits: list[dict]) -> dict[int, list[tuple[float, float, dict[int, list[int]], int, str]]]:
        """Of each term: (rank, proc, positions by field, words of the best field, word), best matches first."""
        words: dict[tuple[int, str], list[dict]] = {}
        for h in hits:
            words.setdefault((h["t"], h["word"]), []).append(h)
        out: dict[int, list] = {}
        for (t, word), some in words.items():
            ranks = sorted((h["r"] for h in some), reverse=True)
            best = max(some, key=lambda h: (h["r"], -h["f"]))
            rank, k = ranks[0], c.sum_ranks_by_fields
            for r in ranks[1:] if k > 0 else ():
                rank += k * r
                k *= c.sum_ranks_by_fields
            out.setdefault(t, []).append((rank, best["proc"], {h["f"]: [*h["pos"]] for h in some}, best["len"], word))
        for some in out.values():
            some.sort(key=lambda x: (-x[1], x[4]))
        return out

    def near(distance: int) -> float:
        return bound(1.0 / max(distance, 1), c.distance_weight)

    def phrase(found: dict, members: list[int]) -> tuple[float, dict, int] | None:
        """Rank and last positions of words in order, each at most the gap behind the one before."""
        total, last, length = 0.0, None, 0
        for i in members:
            rank, following = 0.0, {}
            for r, _, pos, n, _ in found.get(i, []):
                if last is None:
                    if r > rank:
                        rank, length = r, n
                    for f, own in pos.items():
                        following.setdefault(f, set()).update(own)
                    continue
                gaps = []
                for f, own in pos.items():
                    before = last.get(f, [])
                    for p in own:
                        k = bisect_left(before, p)
                        if k and p - before[k - 1] <= q.terms[i].gap:
                            gaps.append(p - before[k - 1])
                            following.setdefault(f, set()).add(p)
                if following:
                    rank = max(rank, near(min(gaps) if gaps else 1) * r)
            if not following:
                return None
            total, last = total + rank, {f: sorted(p) for f, p in following.items()}
        return total, last, length

    def one(hits: list[dict]) -> tuple[float | None, str | None]:
        found = subterms(hits)
        rank, last, met, length, why = 0.0, {}, 0, None, []

        def term(i: int) -> bool:
            nonlocal rank, last, length
            best, pos, word = 0.0, None, ""
            for r, _, p, n, w in found.get(i, []):
                final = r * (near(apart(last, p)) if last else 1.0)
                if final > best:
                    best, pos, word = final, p, w
                    length = n if length is None or not last else length
            if pos is None:
                return False
            rank, last = rank + best, pos
            if debug:
                why.append(f"{word}: {best:.3f}")
            return True

        matched = False
        for op, members in steps:
            if q.terms[members[0]].phrase >= 0:
                got = phrase(found, members)
                if op == "not":
                    if got is not None:
                        return None, None
                    continue
                if got is None:
                    if op == "must":
                        return None, None
                    continue
                rank, last, matched, met = rank + got[0], got[1], True, met + 1
                length = got[2] if length is None else length
                why.append(f"phrase: {got[0]:.3f}")
            elif op == "not":
                if members[0] in found:
                    return None, None
            elif term(members[0]):
                matched, met = True, met + 1
            elif op == "must":
                return None, None
        whole = False
        for g, group in enumerate(of_groups):
            own = [n_terms + k for k, (of, _) in enumerate(parts) if of == g]
            whole |= all(k in found for k in own)
            for k in own if matched or all(k in found for k in own) else ():
                term(k)
        if not matched and (not whole or any(op == "must" for op, _ in steps)):
            return None, None
        if met == len(steps) and length == len(q.terms):  # a query with excluded words has no full match
            rank *= c.full_match_boost
            why.append(f"full match: {c.full_match_boost}")
        return rank, ", ".join(why)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                told = [one(hits) for hits in part.column("hits").to_pylist()]
                ranks, whys = pa.array([r for r, _ in told], pa.float64()), pa.array([w if debug else None for _, w in told], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ranks, whys], names=[*part.schema.names[:-1], "_ft", "_why"])

    return run


# what is shown of a text


def areas(text: str, patterns: list[str] | Callable[[str], dict]) -> list[tuple[int, int]]:
    """Where words stand that match: any of some patterns, or a test."""
    test = patterns if callable(patterns) else lambda w: any(re.fullmatch(p, w) for p in patterns)
    return joined((m.start(), m.end()) for m in WORD.finditer(text) if test(m[0].lower()))


def joined(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in order, as one where they touch."""
    out: list[tuple[int, int]] = []
    for s, e in found:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def highlight(text: str, found: list[tuple[int, int]], pre: str, post: str) -> str:
    out, at = [], 0
    for s, e in found:
        out += [text[at:s], pre, text[s:e], post]
        at = e
    return "".join(out) + text[at:]


def snippet(text: str, found: list[tuple[int, int]], pre: str, post: str, before: int, after: int, pre_delim: str = "", post_delim: str = " ", with_area: bool = False, left_bound: str = "", right_bound: str = "") -> str:
    """The found areas with some text on either side; overlapping pieces join."""
    pieces: list[list] = []
    for s, e in found:
        lo, hi = max(0, s - before), min(len(text), e + after)
        if left_bound:
            stop = max((i for i in range(lo, s) if text[i] in left_bound), default=None)
            lo = lo if stop is None else stop + 1
        if right_bound:
            stop = next((i for i in range(e, hi) if text[i] in right_bound), None)
            hi = hi if stop is None else stop
        if pieces and lo <= pieces[-1][1]:
            pieces[-1][1] = max(hi, pieces[-1][1])
            pieces[-1][2].append((s, e))
        else:
            pieces.append([lo, hi, [(s, e)]])
    out = ""
    for lo, hi, own in pieces:
        body = highlight(text[lo:hi], [(s - lo, e - lo) for s, e in own], pre, post)
        out += pre_delim + (f"[{lo},{hi}]" if with_area else "") + body + post_delim
    return out


def show(df: DataFrame, column: str, text: str, function: str, config: Config | None = None, index: TextIndex | None = None) -> DataFrame:
    """Replace ``column`` by ``highlight``, ``snippet`` or ``snippet_n`` of it, in Arrow batches."""
    c = config or Config()
    q = parse(text, c)
    full = expand(index, q, c) if index is not None else Expanded(q, [variants(q, i, c) for i in range(len(q.terms))], [])
    main = [some for t, some in zip(q.terms, full.lists, strict=True) if t.op != "not"]
    match = Matcher(main + [p for g in full.of_groups for p in g.parts], c)
    ends = [len(main) + sum(len(x.parts) for x in full.of_groups[: k + 1]) for k in range(len(full.of_groups))]
    whole = [{*range(end - len(g.parts), end)} for g, end in zip(full.of_groups, ends, strict=True)]

    def shown(t: str, meant: Callable[[str], frozenset]) -> list[tuple[int, int]]:
        """Where words of terms stand, and of groups that the text holds as a whole."""
        met = [(m.start(), m.end(), x) for m in WORD.finditer(t) if (x := meant(m[0].lower()))]
        held = frozenset().union(*(x for *_, x in met))
        counts = {*range(len(main))}.union(*(g for g in whole if g <= held))
        return joined((s, e) for s, e, x in met if x & counts)

    m = re.search(r"(highlight|snippet_n|snippet)\s*\((.*)\)\s*$", function, re.S)
    if not m:
        raise QueryError(f"unknown function {function!r}")
    kind, named, args = m[1], {}, []
    for part in re.findall(r"""(?:"?(\w+)"?\s*=\s*)?('(?:[^']*)'|[^,]*)(?:,|$)""", m[2]):
        if part[0]:
            named[part[0]] = part[1].strip().strip("'")
        elif part[1].strip() or len(args) < 2:
            args.append(part[1].strip().strip("'"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        meant = lru_cache(100_000)(lambda w: frozenset(match(w)))

        def one(t: str) -> str:
            found = shown(t, meant)
            if kind == "highlight":
                return highlight(t, found, args[0], args[1])
            extra = {"pre_delim": args[4] if len(args) > 4 else "", "post_delim": args[5] if len(args) > 5 else " "} if kind == "snippet" else {k: v if k != "with_area" else v == "1" for k, v in named.items()}
            return snippet(t, found, args[0], args[1], int(args[2]), int(args[3]), **extra)

        return texts.map(one, na_action="ignore")

    return df.withColumn(column, run(column))

