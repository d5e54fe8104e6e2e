"""English stems by the published Snowball rules ("Porter2"), and stop words."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the published English list.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but
    if or because as until while of at by for with about against between into through during before after above below to from up down in out on off
    over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than
    too very s t can will just don should now""".split()
)

#: Words with a stem of their own, words that end after the plural, and the endings of each step with what takes their place.
OWN = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
HEADS = ("gener", "commun", "arsen")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
VOWELS, DOUBLES, BEFORE_LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"


def _after(word: str, start: int) -> int:
    """Where the part begins that follows the first consonant after a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


def _short_end(part: str) -> bool:
    """Whether it ends in a short syllable."""
    if len(part) == 2:
        return part[0] in VOWELS and part[1] not in VOWELS
    return len(part) > 2 and part[-1] not in VOWELS + "wxY" and part[-2] in VOWELS and part[-3] not in VOWELS


def _ending(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    ending = _ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    part = word[: len(word) - len(ending)]
    if ending in ("eed", "eedly"):
        return part + "ee" if len(part) >= r1 else word
    if not ending or not _has_vowel(part):
        return word
    if part.endswith(("at", "bl", "iz")):
        return part + "e"
    if part.endswith(DOUBLES):
        return part[:-1]
    return part + "e" if r1 >= len(part) and _short_end(part) else part


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in OWN:
        return OWN[word]
    word = word.removeprefix("'")
    if word.startswith("y"):
        word = "Y" + word[1:]
    for i in range(1, len(word)):
        if word[i] == "y" and word[i - 1] in VOWELS:
            word = word[:i] + "Y" + word[i + 1 :]
    head = next((h for h in HEADS if word.startswith(h)), "")
    r1 = len(head) or _after(word, 0)
    r2 = _after(word, r1)
    word = _plural(word.removesuffix("'").removesuffix("'s"))
    if word in DONE:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    ending = _ending(word, SECOND)
    part = word[: len(word) - len(ending)]
    if ending and len(part) >= r1 and not (ending == "ogi" and not part.endswith("l")) and not (ending == "li" and part[-1:] not in tuple(BEFORE_LI)):
        word = part + SECOND[ending]
    ending = _ending(word, THIRD)
    part = word[: len(word) - len(ending)]
    if ending and len(part) >= (r2 if ending == "ative" else r1):
        word = part + THIRD[ending]
    ending = _ending(word, FOURTH)
    part = word[: len(word) - len(ending)]
    if ending and len(part) >= r2 and (ending != "ion" or part.endswith(("s", "t"))):
        word = part
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])) or word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1))


def stems(terms: Column) -> Column:
    """An array of words as stems, null in the place of a stop word; each distinct word of a batch is stemmed once."""

    @F.pandas_udf("array<string>")
    def each(rows: pd.Series) -> pd.Series:
        known: dict[str, str | None] = {}
        out = []
        for row in rows:
            for w in row:
                if w not in known:
                    known[w] = None if w in STOP else stem(w)
            out.append([known[w] for w in row])
        return pd.Series(out, dtype=object)

    return each.asNondeterministic()(terms)  # so that it is computed once, not in each place that uses it


def english(text: Column) -> Column:
    """The stems of a text without its stop words, for an index of texts."""
    return F.filter(stems(words(text)), lambda w: w.isNotNull())
