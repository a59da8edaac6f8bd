"""English stems by the published Porter2 rules, for searches that take inflected words as one."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the algorithm.
WHOLE = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
    sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes",
)
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
REGION = re.compile(r"[aeiouy][^aeiouy]")
SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins, from a place on."""
    m = REGION.search(word, start)
    return m.end() if m else len(word)


def longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = re.sub(r"(?:^|(?<=[aeiouy]))y", "Y", word.removeprefix("'"))
    head = re.match(r"gener|commun|arsen", word)
    r1 = head.end() if head else region(word, 0)
    r2 = region(word, r1)
    word = re.sub(r"'(?:s'?)?$", "", word)

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word

    ending = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and re.search(r"[aeiouy]", word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
            word = word[:-1]
        elif r1 >= len(word) and SHORT.search(word):
            word += "e"
    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)

    ending = longest(word, STEP2)
    if ending and len(word) - len(ending) >= r1:
        before = word[: -len(ending)]
        if (ending != "ogi" or before.endswith("l")) and (ending != "li" or before[-1:] in tuple("cdeghkmnrt")):
            word = before + STEP2[ending]
    ending = longest(word, STEP3)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word[: -len(ending)] + STEP3[ending]
    ending = longest(word, STEP4)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(rows: pa.Array) -> pa.Array:
    """The stems of lists of words: each different word of a batch is stemmed once."""
    flat = rows.flatten().dictionary_encode()
    known = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    return pa.ListArray.from_arrays(ends, known.take(flat.indices), mask=rows.is_null())


def stems(words: str | Column) -> Column:
    """The stems of an array of words, in order; null of null."""

    @F.arrow_udf("array<string>")
    def convert(rows: pa.Array) -> pa.Array:
        return stemmed(rows)

    return convert(words)
