"""License scans by template markup compiled to token automata.

A template is wording with two kinds of marked regions: ``[[ … ]]`` may be missing, ``{n}`` stands for one to n
words of any kind (a holder, a year). Everything else is mandatory and has to match word for word. A template
becomes a small automaton over words with empty moves around optional regions; it starts only where
its first mandatory words stand, found by one search per text, and accepts if it reaches its end.
Base phrases are templates without regions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from callmeter.llm.text import arrow_batches, id_and_text

# Phrases with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wordings of common licence notices, as templates.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction [[including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software]]",
    "mit-notice": "released under the mit license [[copyright {6}]]",
    "apache-2-notice": "licensed under the apache license version 2 0 [[the license]] [[you may not use this file except in compliance with the license]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3": "[[this {3} is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]] [[or at your option any later version]]",
    "gpl-2": "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]] [[or at your option any later version]]",
    "cc-by-nc-notice": "licensed under cc by nc {2}",
    "cc-by-sa": "licensed under [[a]] cc by sa [[{2}]]",
    "all-rights": "copyright {8} all rights reserved",
}
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """States 0 … n: ``steps[s]`` is (word or None for any, next state) or None at the end; ``jumps[s]`` are empty moves."""

    label: str
    steps: list[tuple[str | None, int]] = field(default_factory=list)
    jumps: dict[int, set[int]] = field(default_factory=dict)
    mandatory: int = 0
    lead: tuple[str, ...] = ()

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.jumps.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def longest(self, words: list[str], start: int) -> int:
        """End of the longest accepted run of words from ``start``, or -1."""
        end, states, at = -1, self.closure({0}), start
        while states:
            if len(self.steps) in states:
                end = at
            if at == len(words):
                break
            states = self.closure({self.steps[s][1] for s in states if s < len(self.steps) and self.steps[s][0] in (None, words[at])})
            at += 1
        return end


def compiled(label: str, template: str) -> Automaton:
    made, opened, plain = Automaton(label), [], []
    for token in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
        here = len(made.steps)
        if token == "[[":
            opened.append(here)
        elif token == "]]":
            made.jumps.setdefault(opened.pop(), set()).add(here)
        elif token[0] == "{":
            most = int(token[1:-1])
            for k in range(most):
                if k:
                    made.jumps.setdefault(here + k, set()).add(here + most)
                made.steps.append((None, here + k + 1))
        else:
            made.steps.append((token, here + 1))
            if not opened:
                made.mandatory += 1
                plain.append((here, token))
    # The longest run of mandatory words anchors the search.
    runs = [[plain[0]]]
    for place, word in plain[1:]:
        if place == runs[-1][-1][0] + 1:
            runs[-1].append((place, word))
        else:
            runs.append([(place, word)])
    made.lead = tuple(w for _, w in runs[0])
    return made


def _places(joined: str, phrase: str) -> Iterator[int]:
    """Word numbers at which a phrase stands in ``" a b c "``; occurrences may overlap."""
    needle, at, words, counted = f" {phrase} ", -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        words += joined.count(" ", counted, at)
        counted = at
        yield words


class Scanner:
    """Base phrases and templates, compiled once per task."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base = [(p, label, len(p.split())) for p, label in base.items()]
        self.automata = [compiled(label, t) for label, t in templates.items()]
        # Leads begin a template, but for those that open with an optional region: these are searched from a little before.
        self.back = [0 if a.steps[0][0] == a.lead[0] and 0 not in a.jumps else sum(1 for s in a.steps) for a in self.automata]

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = _WORD.findall(text.translate(_LOWER))
        joined = f" {' '.join(words)} "
        starts, base, labels, best = [], set(), set(), 0.0
        for phrase, label, n in self.base:
            for at in _places(joined, phrase):
                starts.append(at)
                base.add(label)
                best = max(best, n / (n + 2))
        for automaton, back in zip(self.automata, self.back, strict=True):
            for at in _places(joined, " ".join(automaton.lead)):
                if any(automaton.longest(words, s) >= 0 for s in range(max(0, at - back), at + 1)):
                    labels.add(automaton.label)
                    best = max(best, automaton.mandatory / (automaton.mandatory + 1))
        low, high = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(starts), low, high, ",".join(sorted(base)), ",".join(sorted(base | labels)), best


def licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``score`` grows with the number of mandatory words of the surest match, 0 without one. A null text counts as empty: no words, no labels
    (empty strings), null places. Every row is judged alone; repeated rows and null ids stay; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
