"""English stems by the published Porter2 algorithm, and stop words."""

from __future__ import annotations

import re
from functools import lru_cache

#: English stop words.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by "
    "for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words with stems of their own, and words that step 1a leaves final.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_FINAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings of steps 2, 3 and 4 of the algorithm.
_STEP2 = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less"
_STEP3 = "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _longest(pairs: str) -> list[tuple[str, str]]:
    return sorted((tuple(p.split(":")) for p in pairs.split()), key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _longest(_STEP2), _longest(_STEP3), sorted(_STEP4, key=len, reverse=True)
_REGION, _VOWEL = re.compile("[aeiouy][^aeiouy]"), re.compile("[aeiouy]")
_SHORT = re.compile(r"(?:.*[^aeiouy])?[^aeiouy][aeiouy][^aeiouywxY]\Z|[aeiouy][^aeiouy]\Z")


def _after(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(1 << 17)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(r"(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) or _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub(r"'s?'?\Z", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _FINAL:
        return w
    m = re.search(r"(eedly|ingly|edly|eed|ing|ed)\Z", w)
    if m:
        end = m[0]
        if end.startswith("eed"):
            w = w[: m.start()] + "ee" if m.start() >= r1 else w
        elif _VOWEL.search(w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z", w):
                w = w[:-1]
            elif r1 >= len(w) and _SHORT.match(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, to in _TWO:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, to in _THREE:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _FOUR:
        if w.endswith(end):
            w = w[: -len(end)] if len(w) - len(end) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT.match(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexeme(word: str, language: str) -> str:
    """The indexed form of a lower-case word; empty for a stop word, whose place still counts."""
    if language == "simple":
        return word
    return "" if word in STOP_WORDS else stem(word)
