"""English stemmer after the published definition of Porter2 (Snowball English)."""

from __future__ import annotations

import re

# Fixed values of the published algorithm.
_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
    ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
_STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic",
)
_R1 = re.compile(r"^(?:gener|commun|arsen)|[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = re.compile(r"[aeiouy][^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    """Ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def stem_english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    word = word.replace("’", "'").removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    first = _R1.search(word)
    r1 = first.end() if first else len(word)
    r2 = _region(word, r1)
    short = lambda w: _short_syllable(w) and r1 >= len(w)
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    if word.endswith(("eed", "eedly")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                if any(c in _VOWELS for c in word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif word.endswith(_DOUBLES):
                        word = word[:-1]
                    elif short(word):
                        word += "e"
                break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                before = word[: -len(end)]
                if not (end == "ogi" and not before.endswith("l")) and not (end == "li" and before[-1:] not in _LI):
                    word = before + new
            break
    # 3
    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
                word = word[: -len(end)] + new
            break
    # 4
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
                word = word[: -len(end)]
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
