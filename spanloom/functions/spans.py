"""Span predicates, offsets and a deterministic span extractor, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, n_words, strip, strip_capitals, strip_claim_number, trim_parentheses

#: The word lists and patterns of the span filter, which decide its results.
HEADER_WORDS = ("field", "related", "art", "invention", "description", "background", "prior", "technical", "sep", "cls", "pad", "mask", "unk", "abstract", "claim")
HARD_STOP = ("which", "wherein", "thereof", "therein", "thereby", "herein", "hereby", "said", "such", "other", "another", "any", "each", "may", "can", "would", "could", "including", "include", "includes", "according", "respectively", "e.g.", "i.e.", "etc.", "cf.", "viz.")
GENERIC_HEADS = ("method", "methods", "system", "systems", "apparatus", "device", "devices", "technique", "techniques", "approach", "approaches", "solution", "solutions", "embodiment", "embodiments", "invention", "disclosure")
TEMPLATES = ("at least one", "plurality of", "the present invention", "embodiment of the invention", "one embodiment", "another embodiment", "the invention", "said invention", "the method", "the apparatus", "the system", "the device", "the present disclosure", "according to the invention", "in accordance with", "as described", "as shown", "as illustrated", "such as", "and the like")
STOPWORDS = ("a", "an", "the", "of", "for", "to", "in", "on", "at", "by", "with", "is", "are", "was", "were", "be", "been", "being", "or", "and", "but", "if", "as", "it", "this", "that", "these", "those")
JOURNALS = r"\b(?:j\.|amer\.|chem\.|soc\.|proc\.|trans\.|nature|science|lancet|jama|ieee|acm)\b"
CITATIONS = (r"\bpatent\s+applications?\b", r"\bpatent\s+no\.?\b", r"\bpatent\s+publications?\b", r"\bpublished\s+(?:patent|application)\b", r"\bcopyright\s+notice\b", r"\bcopyright\s+owner\b", r"\ball\s+copyright\s+rights?\b", r"\bportion\s+of\s+(?:this|the)\s+patent\s+document\b", r"\bno\s+objection\s+to\s+the\s+facsimile\s+reproduction\b", r"\b37\s*cfr\s*§?\s*1\.71\b", r"\bet\s+al\.?\b", r"\b\d{1,2},\d{3},\d{3}\b", JOURNALS)
PUBLICATION = r"(?i)\b(?:WO|EP|US|CN|JP|KR|DE|FR|GB|PCT)\s*(?:\d{4}/\d{4,8}|\d{6,12}(?:/\d{1,4})?)(?:\s*[A-Z]\d?)?\b"
FIGURE = r"(?i)^(?:figure|fig\.?)(?:\s+[A-Za-z0-9][A-Za-z0-9.-]*)++$"
AUTHOR = r"\b(?:[A-Z]\.){1,3}\s*[A-Z][a-z]+(?:[- ][A-Z][a-z]+)?\b"
NUMBERS = (r"^[\d\s\-.,;:()%°/]+$", r"\d{1,2},\d{3},\d{3}", r"\b\d{7,}\b")
SECTION_NAME, PATENT_NUMBER, DATABASES, WEEK = r"(?i)^section\s+[A-Z][A-Za-z]*(?:\s|$)", r"patent\s*no\.?", r"\b(derwent|espacenet|patent\s+central|world\s+patents)\b", r"\bweek\s+\d{4,8}\b"


def _any(*patterns: str) -> str:
    """One pattern for all, so that a text is searched and made ready once."""
    return "|".join(f"(?:{p})" for p in patterns)


def is_header(c: Column) -> Column:
    """A section token, one with a number or up to two words, or a lone header or model-token word."""
    s = strip(c)
    tail = F.regexp_extract(s, r"(?is)^\[(?:abstract|claim|invention)\]\s+(.*)$", 1)
    token = s.rlike(r"(?i)^\[(?:abstract|claim|invention)\]\s*$") | (s.rlike(r"(?i)^\[(?:abstract|claim|invention)\]\s+") & (n_words(tail) <= 2))
    return (s == "") | token | F.lower(s).isin(*HEADER_WORDS)


def is_formula(c: Column) -> Column:
    s = strip(c)
    return s.rlike(r"^\p{L}{1,2}$") | s.rlike(r"^\)\s*[A-Za-z]\s*$")


def is_bibliographic(c: Column, standalone: bool = False) -> Column:
    s, low = strip(c), F.lower(strip(c))
    year, pages, journal = s.rlike(r"\((?:19|20)\d{2}\)"), s.rlike(r"\b\d+\s*:\s*\d+\b"), low.rlike(JOURNALS)
    out = low.rlike(r"\bet\s+al\.?\b") | s.rlike(AUTHOR) | (year & pages) | (journal & (year | pages))
    return out | s.rlike(r"^(?:J\.|Amer\.|Chem\.?|Soc\.?|Proc\.?|Trans\.?)$") if standalone else out


def is_citation(sentence: Column) -> Column:
    return sentence.rlike("(?i)" + _any(*CITATIONS))


def is_good_span(c: Column, section: Column, standalone: bool = False) -> Column:
    """The quality filter; `standalone` is the lenient form for words outside phrases."""
    s, low = strip(c), F.lower(strip(c))
    words = F.regexp_extract_all(s, F.lit(r"([A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*+)"), F.lit(1))
    one = F.get(words, F.lit(0))
    plain = (F.size(words) == 1) & ~(one.rlike(r"^[A-Z]{2,}$") | one.rlike(r"[\d/-]"))
    generic = (n_words(low) <= 4) & F.regexp_extract(low, r"(?U)(\S+)$", 1).isin(*GENERIC_HEADS)
    toks = F.regexp_extract_all(low, F.lit(r"((?U)\S+)"), F.lit(1))
    stops = F.size(F.filter(toks, lambda t: t.isin(*STOPWORDS)))
    bad = is_header(s) | (F.char_length(c) < 3) | (F.char_length(c) > 100) | is_formula(s) | low.isin(*HARD_STOP)
    if not standalone:
        bad = bad | plain | generic
    bad = bad | c.rlike(_any(*NUMBERS, PUBLICATION, SECTION_NAME)) | low.rlike(_any(PATENT_NUMBER, DATABASES, WEEK, *(rf"\Q{t}\E" for t in TEMPLATES)))
    bad = bad | s.rlike(FIGURE) | ((section == "invention") & is_bibliographic(c, standalone))
    return ~(bad | (stops > 0.6 * F.size(toks)))


def body_offset(text: Column, section: Column, scheme: Column, sep: str) -> Column:
    """Where a formatted text's body starts, from 0."""
    marked = scheme == "section_tokens"
    head = F.concat(F.lit("["), section, F.lit("] "))
    at = F.locate(sep.strip(), text)
    mark = F.locate("[abstract] ", text, 1)
    plain_end = F.char_length(F.regexp_extract(F.substring(text, at + len(sep.strip()), F.char_length(text)), r"^( *)", 1)) + at - 1 + len(sep.strip())
    abstract = F.when(at == 0, 0).when(marked & (mark >= at), mark - 1 + len("[abstract] ")).when(marked, at - 1 + len(sep)).otherwise(plain_end)
    other = F.when(marked & F.startswith(text, head), F.char_length(head)).otherwise(0)
    return F.when(section == "abstract", abstract).otherwise(other).cast("int")


def token_span(tokens: Column, start: Column, end: Column) -> Column:
    """STRUCT<first, last> (last exclusive) over ARRAY<STRUCT<a, b>>: the first token with start in it, and
    the first from there with end in it; without the latter, one token; without the former, null."""
    places = F.transform(tokens, lambda t, i: F.struct(t["a"].alias("a"), t["b"].alias("b"), i.alias("i")))
    real = F.filter(places, lambda t: ~((t["a"] == 0) & (t["b"] == 0)))
    first = F.get(F.filter(real, lambda t: (t["a"] <= start) & (start < t["b"])), F.lit(0))["i"]
    last = F.get(F.filter(real, lambda t: (t["i"] >= first) & (t["a"] < end) & (end <= t["b"])), F.lit(0))["i"]
    return F.when(first.isNotNull(), F.struct(first.alias("first"), (F.coalesce(last, first) + 1).alias("last")))


def visible_end(tokens: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(tokens, lambda t: ~((t["a"] == 0) & (t["b"] == 0))), lambda t: t["b"])), F.lit(0))


def word_spans(text: Column) -> Column:
    """ARRAY<STRUCT<start, end, text>> of the runs of non-blanks, with code-point offsets."""
    pieces = F.filter(F.split(text, " "), lambda w: F.lit(True))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        n = F.char_length(w)
        return F.struct((s["at"] + n + 1).alias("at"), F.when(n > 0, F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"), w.alias("text"))))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, zero, step, lambda s: s["out"])


def clean_span(c: Column, section: Column) -> Column:
    """STRUCT<text, left, right>: claim number, capital run (invention) and unbalanced parentheses removed."""
    whole = lambda t: F.struct(t.alias("text"), F.lit(0).alias("skipped"))
    both = lambda caps, p: F.struct(p["text"].alias("text"), (caps["skipped"] + p["left"]).alias("left"), p["right"].alias("right"))
    caps = let(strip_claim_number(c, section), lambda t: F.when(section == "invention", strip_capitals(t)).otherwise(whole(t)))
    return let(caps, lambda caps: let(trim_parentheses(caps["text"]), lambda p: both(caps, p)))


def title_span(c: Column) -> Column:
    t = strip(c)
    lead = F.char_length(F.regexp_extract(c, r"(?U)^(\s*)", 1))
    return F.struct(lead.alias("start"), (lead + F.char_length(t)).alias("end"), t.alias("text"))


def is_marker(raw: Column, canonical: Column) -> Column:
    """A model's classification token, which is no span of the text: `cls` as canonical form, or [CLS]."""
    return (canonical == "cls") | (raw == "[CLS]")
