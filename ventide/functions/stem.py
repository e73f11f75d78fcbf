"""Porter's suffix stripping (M. F. Porter, An algorithm for suffix stripping, 1980), for index tokens."""

from __future__ import annotations

import functools
import re

# The suffixes of the published steps 2, 3 and 4.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
          "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
          "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous",
          "ive", "ize")


def _kinds(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel and a consonant other than w, x and y."""
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _doubled(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem).endswith("cc")


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    ending = _longest(word, ("ed", "ing"))
    if ending is None or "v" not in _kinds(word[: -len(ending)]):
        return word
    stem = word[: -len(ending)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _doubled(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _replaced(word: str, table: dict[str, str]) -> str:
    ending = _longest(word, table)
    if ending is None or _measure(word[: -len(ending)]) == 0:
        return word
    return word[: -len(ending)] + table[ending]


def _stripped(word: str) -> str:
    ending = _longest(word, STEP_4)
    if ending is None:
        return word
    stem = word[: -len(ending)]
    return word if _measure(stem) < 2 or (ending == "ion" and not stem.endswith(("s", "t"))) else stem


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case token. Tokens of one or two characters and those with a digit stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _stripped(_replaced(_replaced(word, STEP_2), STEP_3))
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word
