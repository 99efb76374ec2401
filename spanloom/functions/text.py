"""Text functions on columns: normalization, canonical forms, claim references, IPC codes, formatting.

Patterns use (?U) where word and space classes have to be Unicode ones. Nulls give nulls.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEP = " [SEP] "
#: Models that take text without section markers.
PLAIN_MODELS = ("allenai/specter2_base", "patentbert", "mpi-inno-comp/paecter", "datalyes/patembed-large", "patembed-large")
#: Words cut from both ends of a canonical span.
EDGE_WORDS = ("a", "an", "the", "this", "that", "these", "those", "any")

#: Patterns of reference numerals, claim references and classification tags. Repeated groups are
#: possessive: Java loops over these, but recurses once a round over greedy ones, and a long text ends the executor.
_REF = r"(?:\d+[a-zA-Z]?|[ivxlcdmIVXLCDM]+)"
_REFS = rf"{_REF}(?:\s*[,;]\s*{_REF})*+"
_PRECEDING = r"(?i)\b(?:any\s+(?:one\s+)?of\s+the\s+preceding\s+claims?|the\s+preceding\s+claim|each\s+of\s+the\s+preceding\s+claims?|preceding\s+claims?)\b"
_CLAIM_LIST = r"(?i)\bclaims?\s+(\d+(?:\s*(?:to|through|and|or|,|-|–)\s*\d+)*+)"
_IPC_TAGS = ("<(?:main|further)-classification>([^<]+)</(?:main|further)-classification>", "<classification-ipcr[^>]*>([A-Z][^<]+)</classification-ipcr>")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s(?<!\s\s)\s*$", "")


def let(value: Column, f) -> Column:
    """f(value), with the value computed once, however often and in whatever branch `f` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def drop_zero_width(c: Column) -> Column:
    return F.regexp_replace(c, "[​‌‍﻿]", "")


@F.pandas_udf(StringType())
def _unescape_twice(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(html.unescape(t)))


def decode_entities(c: Column) -> Column:
    """HTML entities, decoded twice. Only texts with an ampersand reach Python, in Arrow batches."""
    return F.when(F.contains(c, F.lit("&")), _unescape_twice(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def space_semicolons(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(?<=\S);(?=\S)", " ; ")


def drop_reference_numerals(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?U)\({_REFS}\)", " ")
    c = F.regexp_replace(c, rf"(?U)\[{_REFS}\]", " ")
    return collapse(F.regexp_replace(c, r"(?mU)^\s*\d+\s*[.):\-]\s*", ""))


def normalize(c: Column, entities: bool = True) -> Column:
    c = drop_zero_width(c)
    return drop_reference_numerals(space_semicolons(decode_entities(c) if entities else c))


def drop_escapes(c: Column, entities: bool = True) -> Column:
    c = F.regexp_replace(c, r"""(?s)\\[^nrtbfav"'\\\n]""", "")
    c = F.replace(F.replace(c, F.lit("\\/"), F.lit("/")), F.lit(" -->"), F.lit(""))
    return decode_entities(c) if entities else c


def canonical(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s/.+-]", " ")
    c = collapse(F.regexp_replace(c, r"([-/.+])[-/.+]+", "$1"))
    edge = "|".join(EDGE_WORDS)
    # the look back starts the last run at its first word only, so a run within the text is read once
    c = F.regexp_replace(c, rf"^(?:(?:{edge})(?: |$))++", "")
    return F.regexp_replace(c, rf"(?<!(?:^| )(?:{edge}))(?:(?:^| )(?:{edge})(?= |$))++$", "")


def strip_claim_number(c: Column, section: Column) -> Column:
    return F.when(section == "claim", strip(F.regexp_replace(strip(c), r"(?U)^\d+\.\s*", ""))).otherwise(c)


def _count(c: Column, one: str) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(one), F.lit("")))


def trim_parentheses(c: Column) -> Column:
    """STRUCT<text, left, right>: leading '(' go while they outnumber ')', then trailing ')' likewise."""

    def lead(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.char_length(F.regexp_extract(c, r"^(\(*)", 1)), _count(c, "(") - _count(c, ")")))

    def tail(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.char_length(F.regexp_extract(c, r"(\)*)$", 1)), _count(c, ")") - _count(c, "(")))

    def cut(left: Column, rest: Column, right: Column) -> Column:
        return F.struct(F.substring(rest, F.lit(1), F.char_length(rest) - right).alias("text"), left.alias("left"), right.alias("right"))

    return let(c, lambda c: let(lead(c), lambda left: let(F.substring(c, left + 1, F.char_length(c)), lambda rest: let(tail(rest), lambda right: cut(left, rest, right)))))


def strip_capitals(c: Column) -> Column:
    """STRUCT<text, skipped>: without a leading run of words in capitals, and how many characters went."""

    def cut(t: Column, run: Column) -> Column:
        rest = F.substring(t, F.char_length(run) + 1, F.char_length(t))
        marks, some = F.regexp_extract(rest, r"^([.,;: \t\n]*)", 1), run != ""
        return F.struct(
            F.when(some, strip(F.substring(rest, F.char_length(marks) + 1, F.char_length(rest)))).otherwise(t).alias("text"),
            F.when(some, F.char_length(run) + F.char_length(marks)).otherwise(F.lit(0)).alias("skipped"),
        )

    return let(strip(c), lambda t: let(F.regexp_extract(t, r"(?U)^((?:[A-Z][A-Z0-9]+\s*)++)", 1), lambda run: cut(t, run)))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def poor_last_sentence(c: Column) -> Column:
    t = strip(c)
    return (F.char_length(t) < 20) | (n_words(t) <= 2) | ~t.rlike(r"[.?!]$")


def claim_references(text: Column, number: Column, most: Column) -> Column:
    """Sorted earlier claim numbers that a claim's text names: lists, ranges, or all preceding ones."""
    preceding = text.rlike(_PRECEDING)
    earlier = F.when(preceding & (number > 1), F.sequence(F.lit(1), number - 1)).otherwise(F.array().cast("array<int>"))
    lists = F.regexp_extract_all(text, F.lit(_CLAIM_LIST), F.lit(1))

    def named(part: Column) -> Column:
        nums = F.transform(F.regexp_extract_all(part, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
        span = part.rlike(r"(?i)\b(?:to|through)\b|[-–]") & (F.size(nums) == 2) & (F.get(nums, F.lit(0)) < F.get(nums, F.lit(1)))
        return F.when(span, F.sequence(F.get(nums, F.lit(0)), F.least(F.get(nums, F.lit(1)), number))).otherwise(nums)

    found = F.concat(earlier, F.flatten(F.transform(lists, named)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: (n >= 1) & (n < number) & (n <= most))))


def normal_ipc(c: Column) -> Column:
    """SECTION CLASS SUBCLASS GROUP/SUBGROUP without blanks and date; '' if it has no such form."""
    raw = F.replace(strip(c), F.lit(" "), F.lit(""))
    after = F.substring(raw, F.locate("/", raw) + 1, F.char_length(raw))
    dated, digits = F.regexp_extract(after, r"^(\d{1,6}?)(?:20\d{6}|19\d{6})", 1), F.regexp_extract(after, r"^(\d+)", 1)
    group = F.when(dated != "", dated).when(digits != "", digits).otherwise(after)
    fine = raw.rlike(r"^\p{L}") & F.contains(raw, F.lit("/")) & (group != "")
    return F.when(fine, F.upper(F.concat(F.substring_index(raw, "/", 1), F.lit("/"), group))).otherwise(F.lit(""))


def ipc_codes(header: Column) -> Column:
    """STRUCT<sc, sg>: sorted distinct subclasses and subgroups in a document's header."""
    old = F.regexp_extract_all(header, F.lit(_IPC_TAGS[0]), F.lit(1))
    new = F.regexp_extract_all(header, F.lit(_IPC_TAGS[1]), F.lit(1))
    raw = F.filter(F.concat(old, new), lambda x: F.replace(strip(x), F.lit(" "), F.lit("")).rlike(r"^\p{L}.{3}"))
    sub = F.transform(raw, lambda x: F.upper(F.substring(F.replace(strip(x), F.lit(" "), F.lit("")), 1, 4)))
    return F.struct(F.array_sort(F.array_distinct(sub)).alias("sc"), F.array_sort(F.array_distinct(F.filter(F.transform(raw, normal_ipc), lambda x: x != ""))).alias("sg"))


def section_of(passage: Column) -> Column:
    path = F.when(F.contains(passage, F.lit("::")), F.substring(passage, F.locate("::", passage) + 2, F.char_length(passage))).otherwise(F.lit("/abstract"))
    return F.when(F.contains(path, F.lit("/abstract")), "abstract").when(F.contains(path, F.lit("/claims")), "claim").otherwise("description")


def document_of(passage: Column) -> Column:
    return F.substring_index(passage, "::", 1)


def scheme_of(model: Column) -> Column:
    m = F.replace(F.lower(strip(F.coalesce(model, F.lit("")))), F.lit("\\"), F.lit("/"))
    plain = F.lit(False)
    for name in PLAIN_MODELS:
        plain = plain | F.contains(m, F.lit(name)) | F.endswith(m, F.lit(name.split("/")[-1]))
    return F.when((m != "") & plain, "no_section_markers").otherwise("section_tokens")


def format_section(section: Column, scheme: Column, title: Column, text: Column, sep: str = SEP, bare: bool = False) -> Column:
    """Encoder input of an abstract (with title), claim or invention. Without markers, an abstract of a blank title and
    a blank text is empty; with `bare` it is the separator alone, as it is with markers."""
    title, text, plain = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit(""))), scheme == "no_section_markers"
    abstract = F.when(plain, F.when(F.lit(bare) | (title != "") | (text != ""), strip(F.concat(title, F.lit(sep), text))).otherwise("")).otherwise(strip(F.concat(title, F.lit(sep + "[abstract] "), text)))
    other = F.when(plain, text).otherwise(strip(F.concat(F.lit("["), section, F.lit("] "), text)))
    return F.when(section == "abstract", abstract).otherwise(other)


def word_chunks(text: Column, words: int = 350) -> Column:
    """Blocks of `words` words; a text of no more is its own single chunk, unchanged."""
    w = F.regexp_extract_all(text, F.lit(r"((?U)\S+)"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / words).cast("int")), lambda k: F.array_join(F.slice(w, k * words + 1, F.lit(words)), " "))
    return F.when(F.size(w) <= words, F.array(text)).otherwise(blocks)


def sentence_chunks(text: Column, budget: int, special: int = 2, gap: int = 1) -> Column:
    """Sentences (or words, if there is one sentence) packed greedily under a budget of words, with
    `special` extra per chunk and `gap` between sentences; a text within budget stays whole."""
    whole = n_words(text) + special <= budget
    sents = F.filter(F.split(text, r"(?<=\.)\s+"), lambda s: strip(s) != "")
    parts = F.when(F.size(sents) <= 1, F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))).otherwise(sents)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(special).alias("n"))

    def step(s: Column, x: Column) -> Column:
        more = n_words(x) + F.when(s["cur"] != "", gap).otherwise(0)
        fits = s["n"] + more <= budget
        return F.struct(
            F.when(fits | (s["cur"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))).alias("done"),
            F.when(fits & (s["cur"] != ""), F.concat(s["cur"], F.lit(" "), x)).otherwise(x).alias("cur"),
            F.when(fits, s["n"] + more).otherwise(special + n_words(x)).cast("int").alias("n"),
        )

    packed = F.aggregate(parts, zero, step, lambda s: F.when(s["cur"] != "", F.concat(s["done"], F.array(s["cur"]))).otherwise(s["done"]))
    return F.when(whole | (F.size(packed) == 0), F.array(text)).otherwise(packed)


def strided_chunks(tokens: Column, size: int, ratio: float = 1.0) -> Column:
    """ARRAY<STRUCT<start, tokens>>: windows of `size`, a stride of ratio * size apart, up to the one that reaches the end."""
    stride = max(1, int(size * ratio))
    last = F.greatest(F.lit(0), F.ceil((F.size(tokens) - size) / stride)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * stride).alias("start"), F.slice(tokens, k * stride + 1, F.lit(size)).alias("tokens")))
