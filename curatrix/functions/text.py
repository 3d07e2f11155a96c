"""Text columns: normalisation, words, shingles, keywords, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"(?i)https?://\S+|www\.\S+"


def normalize(text: Column) -> Column:
    """Bars to sentence ends, no links, underscores to blanks, single blanks, trimmed; in this order."""
    t = F.regexp_replace(text, r"\|\|\|+", ". ")
    t = F.regexp_replace(t, URL, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, "_", " "), r"\s+", " "))


def normalize_light(text: Column) -> Column:
    """Links away, bars to blanks, trimmed."""
    t = F.regexp_replace(text, r"https?://\S+", "")
    return F.btrim(F.regexp_replace(t, r"\|\|\|", " "), F.lit(" \t\n\r\x0b\f"))


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clip_words(text: Column, most: int) -> Column:
    """The text itself, or its first words where it has more than `most`."""
    return F.when(word_count(text) <= most, text).otherwise(F.array_join(F.slice(words(text), 1, most), " "))


def strip_number(line: Column) -> Column:
    """A leading list number goes."""
    return F.regexp_replace(line, r"^\s*\d+[\)\.:\-]\s*", "")


def strip_tag(line: Column, tags: Sequence[str]) -> Column:
    """A leading class tag goes, with or without brackets, whatever its case."""
    return F.regexp_replace(line, rf"(?i)^\s*[\[\(]?({'|'.join(tags)})[\]\)]?\s*[:\-]?\s*", "")


def _windows(w: Column, n: int) -> Column:
    """Structs w0, w1, ... of each n neighbouring words: zipped with their shifts, as a slice inside a lambda would be made anew for every n-gram."""
    shifted = (F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(1, n))
    return F.slice(F.arrays_zip(w.alias("w0"), *shifted), 1, F.greatest(F.size(w) - n + 1, F.lit(0)))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct word n-grams of the lower-cased text; fewer words: the distinct words."""
    w = words(F.lower(text))
    grams = F.transform(_windows(w, n), lambda z: F.concat_ws(" ", *(z[f"w{i}"] for i in range(n))))
    return F.array_distinct(F.when(F.size(w) < n, w).otherwise(grams))


def shingle_hashes(w: Column, n: int = 3) -> Column:
    """The shingles of a column of words as 64-bit hashes. Give the words as a column of their own, or they are split once for every use."""
    grams = F.transform(_windows(w, n), lambda z: F.xxhash64(*(z[f"w{i}"] for i in range(n))))
    return F.array_distinct(F.when(F.size(w) < n, F.transform(w, lambda x: F.xxhash64(x))).otherwise(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def letters(text: Column) -> Column:
    """Lower-case words of ASCII letters only; a word with any other letter, digit or underscore is none."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]+$"))


def text_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def response_lines(text: Column, most: int, longer_than: int = 0) -> Column:
    """Trimmed lines that aren't empty (or not longer than `longer_than`), at most `most`."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\f")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > longer_than), 1, most)


def prefixed(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), text)


def readable(text: Column) -> Column:
    """At least 20 characters and 5 words, and not a link, tag or mention."""
    return (F.length(text) >= 20) & (word_count(text) >= 5) & ~F.btrim(text, F.lit(" \t\n\r\x0b\f")).rlike("^(http|#|@)")


#: Prompt templates; the slots are filled by prompt().
TEMPLATES = {
    "paraphrase": "Rewrite the text {n} times for class [{label}], keeping meaning and tone; use words such as: {keywords}.\nText A: {anchor}",
    "mix": "Write {n} new texts of class [{label}] in the tone of the examples.\nFrequent words: {keywords}.\n{examples}\nText A: {anchor}\nText B: {neighbor}",
}
LANGUAGES = {"auto": "", "en": " Write in English only.", "es": " Escribe solo en español."}


def prompt(mode: str, label: Column, n: int, keywords: Column, anchor: Column, neighbor: Column, examples: Column, most: int = 60, language: str = "auto", target_words: Column | None = None) -> Column:
    """A generation prompt: template, language hint, at most ten keywords, numbered clipped examples, length clause of ±20 %."""
    slots = {
        "n": F.lit(str(n)), "label": label, "keywords": F.array_join(F.slice(keywords, 1, 10), ", "), "anchor": clip_words(anchor, most), "neighbor": clip_words(neighbor, most),
        "examples": F.array_join(F.transform(examples, lambda x, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(": "), x)), "\n"),
    }
    parts, rest = [], TEMPLATES[mode]
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), F.coalesce(slots[name], F.lit(""))]
    parts += [F.lit(rest + LANGUAGES[language] + f"\nReturn exactly {n} texts, one a line.")]
    if target_words is not None:
        bound = lambda x: F.floor(target_words * x).cast("string")
        parts += [F.lit("\nEach text has about "), target_words.cast("string"), F.lit(" words (from "), bound(0.8), F.lit(" to "), bound(1.2), F.lit(").")]
    return F.concat(*parts)


def described(prompt_text: Column, description: Column) -> Column:
    """A class description ahead of the prompt, where there is one."""
    return F.when(description.isNull(), prompt_text).otherwise(F.concat(F.lit("Class: "), description, F.lit("\n\n"), prompt_text))


def contrasted(prompt_text: Column, others: Column) -> Column:
    """A closing section that tells the class apart from others (an array of names), where there are any."""
    return F.when(F.size(others) > 0, F.concat(prompt_text, F.lit("\n\nUnlike: "), F.array_join(others, ", "))).otherwise(prompt_text)


def length_instruction(mode: str, target: Column, low: Column, high: Column) -> Column:
    """How long a text should be: as a range, exactly, or loosely."""
    s = lambda c: c.cast("string")
    if mode == "strict":
        return F.concat(F.lit("Exactly "), s(target), F.lit(" words."))
    if mode == "range":
        return F.concat(F.lit("Between "), s(low), F.lit(" and "), s(high), F.lit(" words."))
    if mode == "loose":
        return F.concat(F.lit("About "), s(target), F.lit(" words."))
    raise ValueError(f"mode: {mode!r}")
