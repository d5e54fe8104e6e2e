"""Scalar functions on identifiers, titles and texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_doi(doi: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^https?://(?:dx\.)?doi\.org/", "")
    return _blank_to_null(F.regexp_replace(bare, "^/+|/+$", ""))


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; there is no built-in for it."""

    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        strip = lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
        return s.map(strip, na_action="ignore")

    return folded(c)


def plain_words(c: Column) -> Column:
    """Lower case, accents folded, other letters left out, everything else than ASCII letters and digits as one space."""
    bare = F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def normalize_title(title: Column) -> Column:
    """For dedup: without accents and signs, lower case, single spaces; null below 10 characters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(title)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.when(F.length(plain) >= 10, plain)


def title_hash(title: Column) -> Column:
    return F.md5(normalize_title(title))


def title_norm(title: Column) -> Column:
    """For ingest: ASCII letters and digits, lower case, single spaces; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def levenshtein_ratio(a: Column, b: Column, most_length_gap: float = 0.2) -> Column:
    """1 - distance / longer length; 0 if lengths differ by more than the gap or either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    near = (F.length(a) > 0) & (F.length(b) > 0) & (F.abs(F.length(a) - F.length(b)) / longer <= most_length_gap)
    return F.when(near, 1 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))


def clean_id(value: Column) -> Column:
    bare = F.regexp_replace(F.trim(value), r"^https?://(?:(?:dx\.)?doi\.org|(?:api\.)?openalex\.org(?:/works)?)/", "")
    return _blank_to_null(F.regexp_replace(bare, r"^W(?=\d)", ""))


def content_key(external_id: Column) -> Column:
    """One key for an external id with or without its source's prefix."""
    return F.concat(F.lit("ext:"), F.regexp_replace(F.lower(F.trim(external_id)), "^[a-z]+:", ""))


def clean_pmcid(value: Column) -> Column:
    digits = F.regexp_extract(value, r"(\d{5,10})", 1)
    return F.when(digits != "", F.concat(F.lit("PMC"), digits))


def token_count(text: Column) -> Column:
    words = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(words == "", 0).otherwise(F.size(F.split(words, " ")))


def display_name(name: Column, most: int = 255) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most), F.lit("…"))).otherwise(name)


def excerpt(text: Column, most: int = 300) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…"))).otherwise(text)


def any_of(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words, in any case."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def first_rule(text: Column, rules: list[tuple[str, str]], existing: Column | None = None) -> Column:
    """The value of the first rule (word, value) whose word the text holds; an existing value stays."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for word, value in reversed(rules):
        out = F.when(F.contains(low, F.lit(word)), F.lit(value)).otherwise(out)
    return out if existing is None else F.coalesce(existing, out)


#: The words that set each tag of a document.
TAGS = {
    "has_surveillance": ["surveillance", "monitoring", "epidemic intelligence"],
    "has_ai": ["artificial intelligence", "machine learning", "deep learning", " ai "],
    "has_spatial": ["spatial", "geographic", "geospatial", "spatiotemporal", "cluster"],
    "has_hospital": ["hospital", "nosocomial", "healthcare setting"],
    "has_genomics": ["genomic", "genomics", "sequencing", "molecular surveillance"],
    "has_climate": ["climate", "weather", "temperature", "pollution", "air quality"],
}

#: Section labels, weights of chunk types, and words that add to a weight.
SECTIONS = {
    "background": "abstract_background", "context": "abstract_background", "methods": "abstract_methods", "method": "abstract_methods",
    "results": "abstract_results", "findings": "abstract_results", "conclusion": "abstract_conclusion", "conclusions": "abstract_conclusion",
    "interpretation": "abstract_conclusion",
}
WEIGHTS = {
    "title": 1.35, "abstract_background": 0.95, "abstract_methods": 0.90, "abstract_results": 1.20, "abstract_conclusion": 1.25,
    "abstract_section": 1.00, "abstract_full": 1.05,
}
BONUSES = [(["surveillance", "outbreak", "epidemic intelligence", "public health"], 0.10), (["systematic review", "scoping review", "meta-analysis"], 0.08)]


def document_tags(text: Column) -> Column:
    return F.struct(*[any_of(text, words).alias(tag) for tag, words in TAGS.items()])


def section_type(label: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(F.trim(label))), F.lit("abstract_section"))


def chunk_weight(kind: Column, content: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    total = F.coalesce(F.try_element_at(weights, kind), F.lit(1.0))
    for words, bonus in BONUSES:
        total = total + F.when(any_of(content, words), bonus).otherwise(0.0)
    return F.round(total + F.when(content.rlike(r"\b\d{4}\b"), 0.03).otherwise(0.0), 3)


def finite(value: Column) -> Column:
    """The value as a double if it is one and finite, else null."""
    x = value.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def inverted_index_text(index: Column) -> Column:
    """The text of a map<word, array<position>>; where positions clash, the later word wins."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    by_place = F.aggregate(
        places, F.create_map().cast("map<bigint,string>"),
        lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["p"]), F.map_from_arrays(F.array(x["p"].cast("bigint")), F.array(x["w"]))),
    )
    return F.array_join(F.transform(F.array_sort(F.map_entries(by_place)), lambda e: e["value"]), " ")


def number_band(text: Column) -> Column:
    """The smallest and largest number written in a text."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    return F.struct(F.array_min(numbers).alias("low"), F.array_max(numbers).alias("high"))


def clean_email(value: Column) -> Column:
    """Lower case without white space around; null unless it has one @ with a dotted name after it."""
    bare = F.lower(F.trim(value))
    return F.when(bare.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), bare)


def highlight(text: Column, words: list[str], around: int = 80, marks: tuple[str, str] = ("<b>", "</b>")) -> Column:
    """The stretch of a text around the first of the words, which is marked, in any case; the start of the text without one."""
    words = [w for w in words if w]
    if not words:
        return excerpt(text, 2 * around)
    pattern = "(?i)(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"
    at = F.array_min(F.filter(F.array(*[F.locate(w.lower(), F.lower(text)) for w in words]), lambda x: x > 0))
    start = F.greatest(F.lit(1), at - around)
    part = F.substring(text, start, F.lit(2 * around))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(F.length(text) >= start + 2 * around, "…").otherwise(""))
    return F.when(at.isNull(), excerpt(text, 2 * around)).otherwise(F.regexp_replace(cut, F.lit(pattern), F.lit(f"{marks[0]}$1{marks[1]}")))


def as_fraction(value: Column, other: Column | None = None) -> Column:
    """A share that may be written in per cent: divided by 100 if it, or the one it belongs with, is above 1."""
    percent = value > 1 if other is None else (value > 1) | (other > 1)
    return F.when(percent, value / 100).otherwise(value)


def valid_ids(ids: Column, known: Column) -> Column:
    """Of an array of texts, the whole numbers that are known, each once, in their order."""
    numbers = F.transform(ids, lambda x: F.trim(x).try_cast("long"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & F.array_contains(known, x)))


#: The keys that an extracted record of population, intervention, comparator and outcome has to have.
PICO_KEYS = ("P", "I", "C", "O", "study_design", "pico_confidence")


def pico(payload: Column) -> Column:
    """The fields of an extracted JSON record; null unless it parses and has all PICO_KEYS (their values may be null).

    A confidence that is missing counts as 0.5, notes as empty.
    """
    keys = F.json_object_keys(payload)
    whole = F.size(F.array_except(F.array(*map(F.lit, PICO_KEYS)), F.coalesce(keys, F.array().cast("array<string>")))) == 0
    x = F.from_json(payload, "P string, I string, C string, O string, study_design string, pico_confidence double, pico_notes string")
    fields = [x[k].alias(k) for k in PICO_KEYS[:-1]]
    return F.when(whole, F.struct(*fields, F.coalesce(x["pico_confidence"], F.lit(0.5)).alias("pico_confidence"), F.coalesce(x["pico_notes"], F.lit("")).alias("pico_notes")))


#: Words and phrases of each kind of evidence signal, a star for any ending; the vocabulary is this library's own and a parameter.
SIGNALS = {
    "demand": ["demand", "attendance", "admission*", "calls", "surge"], "resource": ["ambulance*", "beds", "staff", "ventilator*", "capacity"],
    "intervention": ["vaccin*", "quarantine*", "isolation", "screening", "training"], "horizon": ["forecast*", "short term", "long term", "nowcast*"],
    "crisis": ["outbreak*", "pandemic*", "disaster*", "emergency", "heatwave*"], "border": ["cross border", "border*", "frontier*"],
}

#: Words that take back a signal within the three words after them.
NEGATORS = ("no", "not", "without", "never")


def with_signals(df: DataFrame, text: str = "text", name: str = "signals", rules: dict[str, list[str]] = SIGNALS, negators: tuple[str, ...] = NEGATORS) -> DataFrame:
    """``df`` with a struct of, by kind of signal, the rules that whole words of a text meet, in any case.

    A phrase meets words in a row; where one of the three words before it is a negator it doesn't count.
    """

    def meets(rule: str) -> Column:
        def at(i: Column) -> Column:
            same = F.lit(True)
            for j, part in enumerate(rule.split()):
                word = F.get("_words", i + j)
                same = same & F.coalesce(F.startswith(word, F.lit(part[:-1])) if part.endswith("*") else word == part, F.lit(False))
            before = F.slice("_words", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
            return same & ~F.exists(before, lambda w: w.isin(*negators)) if negators else same

        return F.exists(F.sequence(F.lit(0), F.size("_words") - 1), at)

    found = [F.filter(F.array(*[F.when(meets(r), r) for r in many]), lambda r: r.isNotNull()).alias(kind) for kind, many in rules.items()]
    none = F.array().cast("array<string>")
    rows = df.withColumn("_words", F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)([\p{L}\p{N}]+)"), F.lit(1)))
    full = F.struct(*found)
    empty = F.struct(*[none.alias(kind) for kind in rules])
    return rows.withColumn(name, F.when(F.size("_words") > 0, full).otherwise(empty)).drop("_words")


def evidence_strength(signals: Column, high: int = 3, some: int = 1, rules: dict[str, list[str]] = SIGNALS) -> Column:
    """strong, moderate or weak, by how many kinds of signal there are."""
    kinds = sum(((F.size(signals[k]) > 0).cast("int") for k in rules), F.lit(0))
    return F.when(kinds >= high, "strong").when(kinds >= some, "moderate").otherwise("weak")
