"""Stems of English and Russian words by the published Snowball algorithms (English also known as Porter 2)."""

from __future__ import annotations

import re
from collections.abc import Callable

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant that follows a vowel, and once more."""

    def behind(at: int) -> int:
        m = re.compile(f"[{VOWELS}][^{VOWELS}]").search(word, at)
        return m.end() if m else len(word)

    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else behind(0)
    return r1, behind(r1)


def _short(word: str, r1: int) -> bool:
    """Does the word end in a short syllable, with nothing in R1?"""
    return r1 >= len(word) and bool(re.search(f"(?:^|[^{VOWELS}])[{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$", word))


#: Endings of the second and third step with what replaces them in R1 (fixed values of the algorithm).
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _ending(word: str, among) -> str:
    return max((e for e in among if word.endswith(e)), key=len, default="")


def english(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = word.removeprefix("'")
    word = re.sub(f"^y|(?<=[{VOWELS}])y", "Y", word)
    r1, r2 = _regions(word)
    word = re.sub("'s'$|'s$|'$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{VOWELS}]", word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    if end := _ending(word, ("eed", "eedly")):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif (end := _ending(word, ("ed", "edly", "ing", "ingly"))) and re.search(f"[{VOWELS}]", word[: len(word) - len(end)]):
        word = word[: len(word) - len(end)]
        if word.endswith(("at", "bl", "iz")) or _short(word, r1):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
    word = re.sub(f"(?<=.[^{VOWELS}])[yY]$", "i", word)
    end = _ending(word, (*STEP2, "ogi", "li"))
    base = word[: len(word) - len(end)]
    if end and len(base) >= r1:
        if end in STEP2:
            word = base + STEP2[end]
        elif end == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif base.endswith(tuple("cdeghkmnrt")):
            word = base
    end = _ending(word, (*STEP3, "ative"))
    base = word[: len(word) - len(end)]
    if end and len(base) >= r1:
        if end != "ative":
            word = base + STEP3[end]
        elif len(base) >= r2:
            word = base
    end = _ending(word, (*STEP4, "ion"))
    base = word[: len(word) - len(end)]
    if end and len(base) >= r2 and (end != "ion" or base.endswith(("s", "t"))):
        word = base
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not re.search(f"(?:^|[^{VOWELS}])[{VOWELS}][^{VOWELS}wxY]$|^[{VOWELS}][^{VOWELS}]$", word[:-1]))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


#: Endings by class; those that start with - need an а or я before them (fixed values of the algorithm).
GERUND = "-в -вши -вшись ив ивши ившись ыв ывши ывшись".split()
ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
PARTICIPLE = "-ем -нн -вш -ющ -щ ивш ывш ующ".split()
REFLEXIVE = ["ся", "сь"]
VERB = "-ла -на -ете -йте -ли -й -л -ем -н -ло -но -ет -ют -ны -ть -ешь -нно ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _cut(word: str, rv: int, endings: list[str]) -> str | None:
    """The word without the longest of the endings that stands in RV; None if none does."""
    for e in sorted(endings, key=lambda e: -len(e.lstrip("-"))):
        plain = e.lstrip("-")
        base = word[: len(word) - len(plain)]
        if word.endswith(plain) and len(base) >= rv and (e == plain or (len(base) > rv and base[-1] in "ая")):
            return base
    return None


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    first = re.search("[аеиоуыэюя]", word)
    if not first or not re.fullmatch("[а-я]+", word):
        return word
    rv = first.end()
    r1 = re.compile("[аеиоуыэюя][^аеиоуыэюя]").search(word)
    r2 = re.compile("[аеиоуыэюя][^аеиоуыэюя]").search(word, r1.end()) if r1 else None
    r2_at = r2.end() if r2 else len(word)
    if (cut := _cut(word, rv, GERUND)) is not None:
        word = cut
    else:
        word = _cut(word, rv, REFLEXIVE) or word
        if (cut := _cut(word, rv, ADJECTIVE)) is not None:
            word = cut
            word = _cut(word, rv, PARTICIPLE) or word
        else:
            for endings in (VERB, NOUN):
                if (cut := _cut(word, rv, endings)) is not None:
                    word = cut
                    break
    if word.endswith("и") and len(word) > rv:
        word = word[:-1]
    m = re.search("ость?$", word)
    if m and m.start() >= r2_at:
        word = word[: m.start()]
    if m := re.search("(ейше?)$", word):
        if m.start() >= rv:
            word = word[: m.start()]
    if word.endswith("нн") and len(word) - 1 > rv:
        word = word[:-1]
    elif word.endswith("ь") and len(word) > rv:
        word = word[:-1]
    return word


STEMMERS: dict[str, Callable[[str], str]] = {"en": english, "ru": russian}
