"""English stems by the published Porter2 algorithm."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the algorithm and of the common English stop list.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
R1_PREFIXES = ("gener", "commun", "arsen")
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now".split()
)


_NOT_AFTER = re.compile(r"[aeiouy][^aeiouy]")
_CONSONANT_Y = re.compile(r"(^|[aeiouy])y")
_OWNER = re.compile(r"'s'$|'s$|'$")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_VOWEL, _VOWEL_BEFORE = re.compile(r"[aeiouy]"), re.compile(r"[aeiouy].")


def _endings(pairs: dict[str, str]) -> dict[str, list[tuple[int, dict[str, str]]]]:
    """By last letter, endings by length, longest first."""
    out = {}
    for last in {e[-1] for e in pairs}:
        own = {e: r for e, r in pairs.items() if e[-1] == last}
        out[last] = [(n, {e: r for e, r in own.items() if len(e) == n}) for n in sorted({len(e) for e in own}, reverse=True)]
    return out


_PAST = _endings(dict.fromkeys(("eed", "eedly", "ed", "edly", "ing", "ingly"), ""))
_SECOND, _THIRD, _FOURTH = _endings(dict(STEP2)), _endings(dict(STEP3)), _endings(dict.fromkeys(STEP4, ""))


def _first(word: str, endings: dict[str, list[tuple[int, dict[str, str]]]]) -> tuple[str, str] | tuple[None, None]:
    """The longest ending that a word has, and what takes its place."""
    for n, own in endings.get(word[-1:], ()):
        end = word[-n:]
        if end in own:
            return end, own[end]
    return None, None


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = _NOT_AFTER.search(word, start)
        return m.end() if m else len(word)

    prefix = next(p for p in R1_PREFIXES if word.startswith(p)) if word.startswith(R1_PREFIXES) else None
    r1 = len(prefix) if prefix else after(0)
    return r1, after(r1)


def _short_end(w: str) -> bool:
    return _SHORT.search(w) is not None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'")
    if "y" in w:
        w = _CONSONANT_Y.sub(r"\1Y", w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = _OWNER.sub("", w)
    # plurals
    if w[-1:] not in ("s", "d"):
        pass
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL_BEFORE.search(w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # past and -ing
    end, _ = _first(w, _PAST)
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and _VOWEL.search(w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    # an ending is looked for where the region is long enough for one
    end, put = _first(w, _SECOND) if len(w) - r1 > 1 else (None, None)
    if end and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in LI_ENDINGS):
            w = before + put
    end, put = _first(w, _THIRD) if len(w) - r1 > 2 else (None, None)
    if end and len(w) - len(end) >= r1 and (end != "ative" or len(w) - 5 >= r2):
        w = w[: -len(end)] + put
    end, _ = _first(w, _FOURTH) if len(w) - r2 > 1 else (None, None)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.replace("Y", "y")
