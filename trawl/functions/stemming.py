"""English stems: the Porter2 suffix rules, run once per distinct word of an Arrow batch."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

# The suffix tables, exceptions and letter classes of the public Porter2 algorithm.
VOWELS = "aeiouy"
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
UNCHANGED_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP_4 = dict.fromkeys(
    ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism",
     "ate", "iti", "ous", "ive", "ize", "ion"], "")

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SPECIAL_REGION = re.compile(r"^(?:gener|commun|arsen)")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")
_HAS_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    special = _SPECIAL_REGION.match(word)
    first = special or _REGION.search(word)
    r1 = first.end() if first else len(word)
    second = _REGION.search(word, r1)
    return r1, second.end() if second else len(word)


@lru_cache
def _suffixes(table: tuple[str, ...]) -> tuple[frozenset, range]:
    return frozenset(table), range(max(map(len, table)), min(map(len, table)) - 1, -1)


def _longest(word: str, table: tuple[str, ...]) -> str | None:
    if not word.endswith(table):  # so most words are told at once
        return None
    known, sizes = _suffixes(table)
    return next(word[-n:] for n in sizes if word[-n:] in known)


def _swap(word: str, table: dict, region: int, refuse) -> str:
    """Replace the longest suffix of the table if it lies in the region and is not refused."""
    suffix = _longest(word, tuple(table))
    if suffix is None:
        return word
    cut = len(word) - len(suffix)
    if cut < region or refuse(suffix, word[:cut], cut):
        return word
    return word[:cut] + table[suffix]


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _HAS_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _verb_ending(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    base = word[:-len(suffix)]
    if suffix.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not _HAS_VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return base[:-1]
    if _SHORT_END.search(base) and len(base) <= r1:
        return base + "e"
    return base


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of one lower-case word; words with digits are left as they are."""
    if len(word) < 3 or not word.isalpha() and any(c.isdigit() for c in word):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A consonant y is written Y while the rules run.
    word = re.sub(r"(?<=[aeiouy])y|^y", "Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in UNCHANGED_AFTER_PLURAL:
        return word
    word = _verb_ending(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    word = _swap(word, STEP_2, r1, lambda s, base, cut:
                 (s == "ogi" and not base.endswith("l"))
                 or (s == "li" and base[-1:] not in tuple("cdeghkmnrt")))
    word = _swap(word, STEP_3, r1, lambda s, base, cut: s == "ative" and cut < r2)
    word = _swap(word, STEP_4, r2, lambda s, base, cut:
                 s == "ion" and not base.endswith(("s", "t")))
    last = len(word) - 1
    if word.endswith("e"):
        if last >= r2 or (last >= r1 and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


@arrow_udf(ArrayType(StringType()))
def stem_all(lists: pa.Array) -> pa.Array:
    """Stem arrays of words. A batch is dictionary-encoded, so each word is stemmed once."""
    coded = lists.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), stems.take(coded.indices))
