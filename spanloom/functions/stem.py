"""The second English Snowball stemmer (Porter 2), and terms for lexical models: words, less stop words, stemmed.

Words are stemmed in Arrow batches, each distinct word of a batch once.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stop words, and the endings, exceptions and letters of the published algorithm.
STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
VOWELS, DOUBLES, LI = "aeiouy", ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"), "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
WHOLE |= {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


def _after(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def _ends_short(word: str) -> bool:
    """A vowel and a non-vowel after a non-vowel, not w, x or a consonant y; or a vowel and a non-vowel as the whole word."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    word = word.removeprefix("'")
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    letters = list(word)  # a consonant y becomes Y
    for k, x in enumerate(letters):
        if x == "y" and (k == 0 or letters[k - 1] in VOWELS):
            letters[k] = "Y"
    w = "".join(letters)
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(x in VOWELS for x in w[:-2]):
        w = w[:-1]
    if w in AFTER_PLURAL:
        return w
    # past and progressive forms
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(x in VOWELS for x in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _ends_short(w) and r1 >= len(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    e = _longest(w, SECOND)
    if e and len(w) - len(e) >= r1 and (e != "ogi" or w[-4:-3] == "l") and (e != "li" or w[-3:-2] in tuple(LI)):
        w = w[: -len(e)] + SECOND[e]
    e = _longest(w, THIRD)
    if e and len(w) - len(e) >= (r2 if e == "ative" else r1):
        w = w[: -len(e)] + THIRD[e]
    e = _longest(w, FOURTH)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def analysed_terms(rows: DataFrame, key: str, name: str, text: str = "text", stemmer=stem) -> DataFrame:
    """(name, term), one row an occurrence: runs of a-z and 0-9 in the lower-cased text, less STOP, each through
    `stemmer`. A null text has no terms."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    each = rows.select(F.col(key).alias(name), F.filter(found, lambda w: ~w.isin(*STOP)).alias("terms"))
    kind = each.schema[name].dataType.simpleString()

    def run(batches):
        for b in batches:
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            stems = pa.array([stemmer(w) for w in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.compute.list_parent_indices(lists)), stems.take(coded.indices)], names=[name, "term"])

    return each.mapInArrow(run, f"`{name}` {kind}, term string")
