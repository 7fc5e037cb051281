"""License scans: license templates as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import arrow_map, table

#: The phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as templates: <<optional>> .. <<end>> may be missing, <<var:n>> stands for up to n words of any kind.
TEMPLATES = {
    "mit": (
        "<<optional>>this <<optional>>software <<end>><<optional>>work <<end>>is <<end>>"
        "<<optional>>released <<end>><<optional>>licensed <<end>><<optional>>distributed <<end>>under <<optional>>the <<end>><<optional>>terms of the <<end>>mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<var:4>> to deal in the software without restriction",
        "spdx license identifier mit",
    ),
    "apache": (
        "<<optional>>this <<var:2>> is <<end>>licensed under the apache license version 2 <<optional>>0<<end>>",
        "spdx license identifier apache 2 0",
    ),
    "gpl": (
        "<<optional>>this <<var:2>> is <<end>>licensed under the <<optional>>terms of the <<end>>gnu <<optional>>lesser <<end>><<optional>>affero <<end>>general public license <<optional>>as published by the free software foundation <<optional>>either <<end>><<end>>version <<var:1>>",
        "spdx license identifier <<optional>>l<<end>><<optional>>a<<end>>gpl <<var:2>>",
    ),
    "cc-by-nc": ("licensed under <<optional>>a <<end>><<optional>>the <<end>>cc by nc <<optional>>4 0<<end>>", "creative commons attribution noncommercial <<optional>>4 0 <<end>><<optional>>international <<end>>license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "<<optional>>licensed <<end>><<optional>>released <<end>>under <<optional>>the <<end>>bsd <<var:3>> license"),
    "proprietary": ("<<optional>>copyright <<var:8>> <<end>>all rights reserved",),
}

#: Bytes that part words become blanks, A-Z become a-z.
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Automaton:
    """Over words: arcs[state] has (word or None for any, next state); skips[state] the states reached without a word."""

    arcs: list[list[tuple[bytes | None, int]]] = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    final: int = 0
    n_mandatory: int = 0

    def state(self) -> int:
        self.arcs.append([])
        self.skips.append([])
        return len(self.arcs) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w, _ in self.arcs[s] if w is not None}

    def accepts_at(self, text: list[bytes], at: int) -> int | None:
        """The end of the longest match that starts there, or None."""
        states, end = self.closure({0}), None
        while states:
            if self.final in states:
                end = at
            if at >= len(text):
                break
            states = self.closure({n for s in states for w, n in self.arcs[s] if w is None or w == text[at]})
            at += 1
        return end


def compile_template(template: str) -> Automaton:
    """Optional regions may be left out and replaceable ones hold any words up to their bound; all other words are mandatory."""
    out = Automaton()
    here, opened = out.state(), []
    for part in re.findall(r"<<[^<>]*>>|[^<>]+", template):
        if part == "<<optional>>":
            opened.append(here)
        elif part == "<<end>>":
            if not opened:
                raise ValueError(f"<<end>> without <<optional>> in {template!r}")
            out.skips[opened.pop()].append(here)
        elif m := re.fullmatch(r"<<var:(\d+)>>", part):
            begin = [here]
            for _ in range(int(m[1])):
                there = out.state()
                out.arcs[here].append((None, there))
                here = there
                begin.append(here)
            for s in begin[:-1]:
                out.skips[s].append(here)
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part!r}")
        else:
            for w in words(part):
                there = out.state()
                out.arcs[here].append((w, there))
                here = there
                out.n_mandatory += not opened
    if opened:
        raise ValueError(f"<<optional>> without <<end>> in {template!r}")
    out.final = here
    return out


class LicenseScanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None):
        self.phrases = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.automata = [(label, a, a.first_words()) for label, ts in (TEMPLATES if templates is None else templates).items() for a in map(compile_template, ts)]

    def scan(self, text: str | None) -> dict:
        found = words(text)
        vocabulary = set(found)
        places: list[tuple[int, str]] = []
        for phrase, label in self.phrases:
            if vocabulary.issuperset(phrase):
                n, at = len(phrase), -1
                for _ in range(found.count(phrase[0])):
                    at = found.index(phrase[0], at + 1)
                    if found[at : at + n] == phrase:
                        places.append((at, label))
        spans: list[tuple[int, int, str]] = []
        for label, automaton, starts in self.automata:
            # of each run of matches that overlap, the leftmost and longest
            if not (starts & vocabulary) or not _may(automaton, vocabulary):
                continue
            reach = 0
            for at in sorted(i for w in starts & vocabulary for i in _places(found, w)):
                if at >= reach and (end := automaton.accepts_at(found, at)) is not None:
                    spans.append((at, end, label))
                    reach = end
        return {"n_words": len(found), "base": sorted(places), "spans": sorted(spans)}


def _places(found: list[bytes], word: bytes) -> Iterator[int]:
    at = -1
    for _ in range(found.count(word)):
        at = found.index(word, at + 1)
        yield at


def _may(automaton: Automaton, vocabulary: set[bytes]) -> bool:
    """Can the final state be reached with these words at all?"""
    seen = automaton.closure({0})
    todo = list(seen)
    while todo:
        for w, n in automaton.arcs[todo.pop()]:
            if n not in seen and (w is None or w in vocabulary):
                new = automaton.closure({n}) - seen
                seen |= new
                todo += new
    return automaton.final in seen


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, base (phrase places), spans (template matches), labels and score.

    Texts are words of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case.  base has
    (word, label) of every phrase of PHRASES; spans has (start, end, label), in words, of every template whose
    automaton accepts the words there: mandatory wording as it stands, optional regions there or not, replaceable ones
    with any words.  labels are those of both, distinct and sorted.  score is 1 if a template matches, 0.5 if phrases
    only do, else 0.

    Null and empty texts have no words, no labels and score 0.  Null or repeated doc_ids are rows like others.  Only
    doc_id and text are read, so that other columns may have any name.  An empty table gives an empty result.
    """
    scanner = LicenseScanner(templates)

    def scan(cols: dict):
        found = [scanner.scan(t) for t in cols["text"]]
        yield {
            "doc_id": cols["doc_id"],
            "n_words": [x["n_words"] for x in found],
            "base": [[{"word": w, "label": k} for w, k in x["base"]] for x in found],
            "spans": [[{"start": a, "end": b, "label": k} for a, b, k in x["spans"]] for x in found],
            "labels": [sorted({k for _, k in x["base"]} | {k for *_, k in x["spans"]}) for x in found],
            "score": [1.0 if x["spans"] else 0.5 if x["base"] else 0.0 for x in found],
        }

    schema = "doc_id long, n_words long, base array<struct<word:long,label:string>>, spans array<struct<start:long,end:long,label:string>>, labels array<string>, score double"
    return arrow_map(docs.select("doc_id", "text"), scan, schema, batch_rows=256)


def query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan_licenses(table(spark, sf_dir, "documents"))
    first, last = F.array_min(F.col("base.word")), F.array_max(F.col("base.word"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.col("base.label"))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
