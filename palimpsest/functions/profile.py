"""What is particular to a dictionary, as data: a profile. The formats' fixed values are the default one; others are JSON documents.

Patterns are Java's; a class is a pattern class without its brackets. A token pattern has one group, the token's code.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import SparkSession

from palimpsest.functions import fixed


class Profile(NamedTuple):
    token: str = fixed.TOKEN
    #: rewrites of mapped pronunciations, in their order: (pattern, value)
    pronunciation: list[tuple[str, str]] = fixed.PRONUNCIATION
    #: what a reader sees for each markup of a mapped body
    body_markup: dict[str, str] = fixed.BODY_MARKUP
    #: classes of headwords' hyphens and of what signatures leave out; damaged hyphens; lengths of the two signatures
    hyphens: str = fixed.HYPHENS
    broken_hyphens: list[str] = fixed.BROKEN_HYPHENS
    signature_drops: str = fixed.SIGNATURE_DROPS
    signature: int = fixed.SIGNATURE
    prefix_signature: int = fixed.PREFIX_SIGNATURE
    #: how lines begin that are body text, readings, or ids; what a header may begin with, and headers that are replaced whole
    body_starts: list[str] = fixed.BODY_STARTS
    reading_marks: list[str] = fixed.READING_MARKS
    id_line: str = fixed.ID_LINE
    head_prefix: str = fixed.HEAD_PREFIX
    header_literals: dict[str, str] = fixed.HEADER_LITERALS
    #: the keys by which pronunciations are sought, in their order
    pronunciation_methods: list[str] = ["headword_exact", "headword_normalized", "orthography_normalized"]
    #: for entries that no key finds: (texts that all stand in the body, header of the entry, method), and (header, head line, body, method)
    clues: list[tuple[list[str], str, str]] = fixed.MANUAL_CLUES
    headers: list[tuple[str, str, str, str]] = fixed.MANUAL_HEADERS


DEFAULT = Profile()


def read_profile(spark: SparkSession, path: str) -> Profile:
    """A profile from a JSON object of its fields; those that it lacks are the default's, and one that it shouldn't have is an error."""
    document = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    if unknown := set(document) - set(Profile._fields):
        raise ValueError(f"a profile has no {sorted(unknown)}")
    for name in ("pronunciation", "clues", "headers"):
        if name in document:
            document[name] = [tuple(x) for x in document[name]]
    if wrong := set(document.get("pronunciation_methods", [])) - set(DEFAULT.pronunciation_methods):
        raise ValueError(f"no such method: {sorted(wrong)}")
    return DEFAULT._replace(**document)
