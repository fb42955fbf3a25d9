"""Licence scan: an Aho-Corasick automaton finds tags and phrases, tag expressions are evaluated."""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from driftline.llm.common import per_text, words_of

# The base phrases and labels of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases this scan adds.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "zlib",
              "unlicense", "cc0-1.0", "cc-by-4.0"}
_BINDS = {"or": 1, "and": 2, "with": 3}
_NOTICE = (" licensed under ", " released under ", " distributed under ", " terms of ")


def to_postfix(expression: str) -> list[str] | None:
    """Operands and operators of a licence expression in postfix order; None if malformed.

    Dijkstra's shunting yard: operators wait on a stack until one that binds less
    tightly, or a closing bracket, lets them go.
    """
    out, waiting, operand_next = [], [], True
    for token in re.findall(r"[()]|[^\s()]+", expression.lower()):
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in _BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next or not re.fullmatch(r"[a-z0-9][a-z0-9.+:-]*", token):
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str], allowed: set[str]) -> tuple[bool, list[str]]:
    """Whether some choice the expression offers lies wholly in ``allowed``; its licences."""
    stack: list[tuple[bool, list[str]]] = []
    for token in postfix:
        if token not in _BINDS:
            stack.append((token in allowed, [token]))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # an exception only adds permissions to its licence
            stack.append(left)
        elif token == "and":
            stack.append((left[0] and right[0], left[1] + right[1]))
        else:
            stack.append((left[0] or right[0], left[1] + right[1]))
    return stack[0]


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        automaton.add_word(f" {phrase} ", (phrase, label, phrase in BASE_PHRASES))
    automaton.add_word(f" {TAG} ", (TAG, None, False))
    automaton.make_automaton()
    return automaton


def scanner():
    """A function of a text's bytes that returns the columns of :func:`scan_licenses`."""
    automaton = build_automaton()

    def scan(data: bytes | None):
        words = words_of(data)
        # one character per byte, one space on either side of every word
        line = f" {b' '.join(words).decode('latin-1')} "
        base, labels, starts, tagged, noticed, own = set(), set(), [], False, False, False
        counted, at = 0, 0
        for end, (phrase, label, is_base) in automaton.iter(line):
            begin = end - len(phrase) - 1
            if label is None:
                tagged = True
                continue
            labels.add(label)
            own |= not is_base
            if is_base:
                base.add(label)
                if begin >= at:
                    counted, at = counted + line.count(" ", at, begin), begin
                    starts.append(counted)
                else:
                    starts.append(counted - line.count(" ", begin, at))
                noticed |= any(x in line[max(0, begin - 40):begin + 1] for x in _NOTICE)
        permissive, parsed = False, False
        if tagged:
            for found in TAG_LINE.findall(data):
                text = found.decode("utf-8", "replace").rstrip("*/#-> \t")
                postfix = to_postfix(text)
                if postfix:
                    free, names = evaluate(postfix, PERMISSIVE)
                    permissive, parsed = permissive or free, True
                    labels.update(names)
        score = (1.0 if parsed else 0.95 if noticed else 0.8 if base else 0.6 if own
                 else 0.3 if tagged else 0.0)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive)

    return scan


def scan_licenses(docs: DataFrame, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """One row per row of ``docs`` with the licence phrases and tags of its whole text.

    n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start, null without any), base_labels, labels (both distinct, sorted, joined
    by commas), score (0 to 1), permissive (some tag offers a choice of permissive licences
    only). A null text counts as empty: no words, no labels, score 0. Rows are judged one
    by one, so repeated rows repeat their result; other columns are not looked at.

    A phrase's place is where its words stand one after the other, whatever stands
    between them; the words that tags carry are read from the text itself.
    """
    return per_text(docs, id_column, text_column, scanner, {
        "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
        "base_labels": "string", "labels": "string", "score": "double",
        "permissive": "boolean"})
