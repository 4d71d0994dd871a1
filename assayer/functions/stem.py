"""An English stemmer: the published second version of the suffix-stripping algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the algorithm: whole words with a stem of their own, words that stay as they are once a plural is off, and the suffixes of its steps.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SETTLED = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
LI_BEFORE = "cdeghkmnrt"


def _regions(word: str) -> tuple[int, int]:
    """Where the first and the second region begin: each behind the first consonant that follows a vowel."""

    def behind(start: int) -> int:
        found = re.search("[aeiouy][^aeiouy]", word[start:])
        return start + found.end() if found else len(word)

    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    first = len(prefix) if prefix else behind(0)
    return first, behind(first)


def _short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch("[aeiouy][^aeiouy]", word))


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of two letters or fewer stay."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = word.removesuffix("'s'") if word.endswith("'s'") else word.removesuffix("'s") if word.endswith("'s") else word.removesuffix("'")

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in SETTLED:
        return word

    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, (*SECOND, "ogi", "li"))
    if end and len(word) - len(end) >= r1:
        if end == "ogi":
            word = word[:-1] if word.endswith("logi") else word
        elif end == "li":
            word = word[:-2] if len(word) > 2 and word[-3] in LI_BEFORE else word
        else:
            word = word[: -len(end)] + SECOND[end]
    end = _longest(word, (*THIRD, "ative"))
    if end and len(word) - len(end) >= r1:
        if end != "ative":
            word = word[: -len(end)] + THIRD[end]
        elif len(word) - len(end) >= r2:
            word = word[:-5]
    end = _longest(word, (*FOURTH, "ion"))
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1]))) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
