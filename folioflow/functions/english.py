"""English words to stems: the Porter2 rules (the published English stemmer with its regions, in the form that full-text search uses) and stop words."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that English search leaves out.
STOP = frozenset((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those"
    " am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below"
    " to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split())

#: Fixed values of the published rules: words with stems of their own, words that stay, words that stop after the plural step, ends by step, letters before -li.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
PLURAL_ONLY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
PREFIXES = ("gener", "commun", "arsen")
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
LI = "cdeghkmnrt"
#: The ends that a step looks for, longest first.
ENDS1, ENDS2, ENDS3, ENDS4 = (tuple(sorted(e, key=len, reverse=True)) for e in (("eedly", "eed", "ingly", "edly", "ing", "ed"), (*STEP2, "ogi", "li"), (*STEP3, "ative"), (*STEP4, "ion")))
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL = re.compile(r"[aeiouy]")


def _after_region(w: str, start: int) -> int:
    m = _REGION.search(w, start)
    return m.end() if m else len(w)


def _end(w: str, ends: tuple[str, ...]) -> str | None:
    """The first of the ends, longest first, that w has."""
    return next(e for e in ends if w.endswith(e)) if w.endswith(ends) else None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2 or word in STAY:
        return word
    if word in OWN:
        return OWN[word]
    w = re.sub(r"([aeiouy])y", r"\1Y", re.sub("^y", "Y", word)) if "y" in word else word  # y that is a consonant
    prefix = next(p for p in PREFIXES if w.startswith(p)) if w.startswith(PREFIXES) else None
    r1 = len(prefix) if prefix else _after_region(w, 0)
    r2 = _after_region(w, r1)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in PLURAL_ONLY:
        return w
    # past and present participles
    e = _end(w, ENDS1)
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and _VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # derivational ends, each in its region
    e = _end(w, ENDS2)
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w.endswith("logi") else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in LI else w
        else:
            w = w[: -len(e)] + STEP2[e]
    e = _end(w, ENDS3)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + STEP3.get(e, "")
    e = _end(w, ENDS4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def lexeme(word: str) -> str:
    """The lexeme of a lower-case word: '' for a stop word; words of other characters than letters stay as they are."""
    return "" if word in STOP else stem(word) if word.isalpha() else word
