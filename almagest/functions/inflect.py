"""Singular and plural of English words, as patterns."""

from __future__ import annotations

import re
from typing import NamedTuple


class Ending(NamedTuple):
    """A plural ending: what stands in its place in the singular, the length
    that a word with it has at least, and whether acronyms may have it."""

    plural: str
    singular: str
    least: int
    acronyms: bool


# Plural endings, the longer before the shorter, and endings in s of words that are no plural.
PLURALS = [Ending("sses", "ss", 5, True), Ending("ches", "ch", 5, True), Ending("shes", "sh", 5, True), Ending("ies", "y", 5, True), Ending("xes", "x", 5, True), Ending("s", "", 4, False)]
NO_PLURALS = ["ss", "us", "is", "ous", "ics", "ays"]
# What a word adds in the plural, by how it ends (as patterns); the first that fits counts.
ADDED = [(r"[^aeiou]y$", "y", "(?:y|ies)"), (r"(?:s|x|z|ch|sh)$", "", "(?:es)?"), (r"", "", "(?:s|es)?")]


def quoted(s: str) -> str:
    """A text as a pattern of itself, for Java and for Python alike."""
    return "".join(c if c.isalnum() or c in "_ " or c.isspace() else "\\" + c for c in s)


def singular(word: str) -> str:
    """A word without its plural ending; "analysis" or "radius" stay."""
    low = word.lower()
    for e in PLURALS:
        if low.endswith(e.plural) and len(word) >= e.least:
            stays = e.plural == "s" and any(low.endswith(x) for x in NO_PLURALS) or not e.acronyms and word.isupper()
            stem, ending = word[: len(word) - len(e.plural)], word[len(word) - len(e.plural) :]
            return word if stays else stem + (e.singular.upper() if ending.isupper() else e.singular)
    return word


def inflected(word: str) -> str:
    """A pattern of a word in either number. Acronyms only take an s."""
    if word.isupper() and len(word) > 1:
        return quoted(word) + "s?"
    one = singular(word)
    _, drop, add = next(rule for rule in ADDED if re.search(rule[0], one.lower()))
    return quoted(one[: len(one) - len(drop)]) + add
