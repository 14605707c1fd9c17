"""Licence recognition by sentence rules.

Lines lose their comment and list marks; lines up to a blank one are joined
and cut at sentence ends.  A sentence is normalised (lower case, single spaces,
no quotes) and searched for known licence sentences: they may run over line
breaks, colons and semicolons, and start and end only there or where the
sentence does.  The sequence of identifiers is then read from left to right: at
each place the first rule of an ordered list whose identifiers follow there is
recognised and passed over.  What speaks of licensing between known sentences
gets the identifier ``unknown``, once for each stretch; a known sentence that
no rule uses is reported as ``partial``.

Texts without a licence word are settled by one search.  Null and empty texts
have no sentence; repeated rows are read alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import series_udf

#: Known sentences (normalised patterns) and their identifiers.
SENTENCES = (
    ("mit-short", r"(?:released|licensed|distributed|available) under (?:the terms of )?the mit licen[sc]e"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this "
                  r"software and associated documentation files .*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies "
                   r"or substantial portions of the software"),
    ("as-is", r"the software is provided as is, without warranty of any kind, .*"),
    ("apache-short", r"licensed under the apache licen[sc]e,? version 2\.0(?: \(the licen[sc]e\))?"),
    ("apache-comply", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-copy", r"you may obtain a copy of the licen[sc]e at(?: .*)?"),
    ("gpl3-short", r"this (?:work|program|software) is licensed under the gnu general public licen[sc]e,? "
                   r"version 3(?:\.0)?"),
    ("gpl2-short", r"this (?:work|program|software) is licensed under the gnu general public licen[sc]e,? "
                   r"version 2(?:\.0)?"),
    ("gpl-free", r"this program is free software: you can redistribute it and/or modify it under the terms of "
                 r"the gnu general public licen[sc]e .*version 3.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms, with or without modification, are "
                  r"permitted provided that the following conditions are met"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-endorse", r"neither the name of .* may be used to endorse or promote products .*"),
    ("ccby-short", r"(?:this work is )?licensed under (?:a )?(?:cc by|creative commons attribution) 4\.0.*"),
    ("ccbync-short", r"(?:this work is )?licensed under (?:a )?(?:cc by-nc|creative commons "
                     r"attribution-noncommercial) 4\.0.*"),
    ("spdx-mit", r"spdx-license-identifier: mit"),
    ("spdx-apache", r"spdx-license-identifier: apache-2\.0"),
)
#: Rules in order, the more special first.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("spdx-mit",)),
    ("Apache-2.0", ("apache-short", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("spdx-apache",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-2.0", ("gpl2-short",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("ccbync-short",)),
    ("CC-BY-4.0", ("ccby-short",)),
)
#: A text or sentence without these is not about licences.
MARKS = re.compile(r"licen[sc]e|copyright|redistribut|permission\W+is\W+hereby|provided\W+as\W+is|"
                   r"without\W+warranty", re.IGNORECASE)
RESULT = "sentences array<string>, licenses array<string>, n_unknown long, n_partial long"

_LINE = re.compile(r"\r\n?|\n")
_OPENING = re.compile(r"^(?:[\s*#/>\-|%;!<]|rem\s|dnl\s|\(?(?:\d{1,2}|[a-z])\)\s)+", re.IGNORECASE)
#: A blank line ends a sentence, except before a bare address.
_PARAGRAPH = re.compile(r"\n{2,}(?!https?://)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_SOFT = re.compile(r"(?<=[;:])\s+|\n+")


def _known():
    """(name, pattern, open, rest) of each known sentence; an open one goes on to
    the next known sentence.  Any space may be a soft break, kept as a line feed.
    ``rest`` are the words after a gap: where they do not follow any more, the
    sentence need not be looked for, and where they do, its first words find them,
    so each part of a text is read once however often those are repeated."""
    for name, p in SENTENCES:
        tail = next((t for t in (r"(?: .*)?", ".*") if p.endswith(t)), "")
        p = p.removesuffix(tail)
        rest = p.rpartition(".*")[2] if ".*" in p else ""
        p = p.replace(".*", ".*?").replace(" ", r"\s")
        end = r"(?=\s|$)" if tail == r"(?: .*)?" else "" if tail else r"[ .!?;:]*(?=\n|$)"
        yield name, re.compile(p + end, re.DOTALL), bool(tail), rest


_KNOWN = list(_known())


def normalise(sentence: str) -> str:
    """Lower case, no quotes, single spaces; line breaks and the spaces after
    colons and semicolons become line feeds."""
    s = _SOFT.sub("\n", re.sub(r"[\"'`“”‘’]", "", sentence.lower()).strip())
    return re.sub(r"[^\S\n]+", " ", s)


def _bare(line: str) -> str:
    """A line without its comment and list marks."""
    line = _OPENING.sub("", line).rstrip().removesuffix("*/").removesuffix("-->")
    return line.rstrip("*#|" + string.whitespace)


def _sentences(text: str):
    for paragraph in _PARAGRAPH.split("\n".join(map(_bare, _LINE.split(text)))):
        if MARKS.search(paragraph) or "neither the name" in paragraph.lower().replace("\n", " "):
            yield from _SENTENCE.split(paragraph)


def _read(sentence: str) -> list[str]:
    s = normalise(sentence)
    found = []  # (start, end, name) of the known sentences
    at, flat = 0, s.replace("\n", " ")
    last = {rest: flat.rfind(rest) for *_, rest in _KNOWN if rest}
    while at < len(s):
        for name, p, goes_on, rest in _KNOWN:
            if (not rest or at <= last[rest]) and (m := p.match(s, at)):
                if found and found[-1][3]:
                    found[-1][1] = at
                found.append([at, m.end(), name, goes_on])
                break
        at = s.find("\n", max(at, found[-1][1] if found else 0)) + 1
        if not at:
            break
    if found and found[-1][3]:
        found[-1][1] = len(s)
    out, done = [], 0
    for start, end, name, _ in [*found, (len(s), len(s), "", False)]:
        if MARKS.search(s[done:start]):
            out.append("unknown")
        done = end
        out += [name] if name else []
    return out


def sentence_ids(text: str | None) -> list[str]:
    """Identifiers of the licence sentences of a text, in order."""
    if not isinstance(text, str) or not MARKS.search(text):
        return []
    return [i for s in _sentences(text) for i in _read(s)]


def match_rules(ids: list[str]) -> tuple[list[str], int]:
    """(licences in order of first appearance, known sentences left over)."""
    known = [i for i in ids if i != "unknown"]
    found, partial, at = [], 0, 0
    while at < len(known):
        for name, rule in RULES:
            if tuple(known[at:at + len(rule)]) == rule:
                found.append(name)
                at += len(rule)
                break
        else:
            partial += 1
            at += 1
    return list(dict.fromkeys(found)), partial


def license_udf():
    """Column function: struct ``RESULT`` of a text."""
    def run(batches):
        for texts in batches:
            rows = []
            for t in texts:
                ids = sentence_ids(t)
                names, partial = match_rules(ids)
                rows.append((ids, names, ids.count("unknown"), partial))
            yield pd.DataFrame(rows, columns=["sentences", "licenses", "n_unknown", "n_partial"])
    return series_udf(run, RESULT)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id`` and the fields of ``RESULT``."""
    return docs.select(F.col(doc_id).alias("doc_id"), license_udf()(F.col(text)).alias("r")).select(
        "doc_id", "r.*")
