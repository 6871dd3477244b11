"""English stemming after the published Porter2 algorithm, and the English stop list."""

from __future__ import annotations

import re
from functools import lru_cache

#: The English stop words.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)
#: Fixed values of Porter2: irregular forms and words that step 1a leaves alone.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOP_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("ousness", "ous"), ("iveness", "ive"), ("fulness", "ful"), ("tional", "tion"),
    ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("fulli", "ful"), ("ousli", "ous"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"),
    ("ness", ""), ("ful", ""),
)
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
_V = "[aeiouy]"
_R = re.compile(f"{_V}[^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    head = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), "")
    r1 = len(head) if head else (m.end() if (m := _R.search(word)) else len(word))
    return r1, m.end() if (m := _R.search(word, r1)) else len(word)


def _short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(rf"(^|{_V})y", lambda m: m[1] + "Y", word.lstrip("'"))
    r1, r2 = _regions(w.replace("Y", "\x01"))
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in STOP_AFTER_1A:
        return w
    # 1b: past and progressive forms
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(_V, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c: final y
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    # 2 and 3: derivational endings
    for old, new in STEP2:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r1 and not (old == "ogi" and w[at - 1] != "l") and not (old == "li" and w[at - 1] not in "cdeghkmnrt"):
                w = w[:at] + new
            break
    for old, new in STEP3:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r1 and (old != "ative" or at >= r2):
                w = w[:at] + new
            break
    # 4: endings that go altogether
    for old in STEP4:
        if w.endswith(old):
            at = len(w) - len(old)
            if at >= r2 and (old != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    # 5: final e and double l
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()
