"""Independent step-by-step model of the within-day labelling, for tests.

Written from the rule description (not from the Spark code): it walks the
rows one by one exactly as a person following the rules would, using the
full ``difflib.Differ`` output (no fast path).
"""

from __future__ import annotations

import difflib

MARKER = "Intimado(s)/Citado(s):"


def differ_facts(a: str, b: str, marker: str = MARKER, width: int = 5):
    ta, tb = a.split(), b.split()
    lines = [ln for ln in difflib.Differ().compare(ta, tb) if not ln.startswith("?")]
    n_diff = sum(1 for ln in lines if ln[0] in "+-")
    left = [ln for ln in lines if ln[0] in "- "]
    right = [ln for ln in lines if ln[0] in "+ "]
    dels = [i for i, ln in enumerate(left) if ln[0] == "-"]
    ins = [i for i, ln in enumerate(right) if ln[0] == "+"]
    fd = dels[0] if dels else None
    fi = ins[0] if ins else None
    two = n_diff > 0 and fd is not None and fi is not None
    mk = False
    if two:
        tag = "  " + marker
        mk = tag in left[fd - width:fd] and tag in right[fi - width:fi]
    return n_diff, fd, fi, two, mk


def label(rows):
    """rows: list of (row_id, case, text) of one day, any order.
    Returns {row_id: (noccur, similar)}."""
    rows = sorted(rows)
    ids = [r[0] for r in rows]
    case = {r[0]: r[1] for r in rows}
    text = {r[0]: r[2] for r in rows}
    noccur = {i: sum(1 for j in ids if case[j] == case[i]) for i in ids}
    sim = {i: -1 for i in ids}
    # singletons and exact copies
    for i in ids:
        if noccur[i] == 1:
            sim[i] = i
    for i in ids:
        if sim[i] != -1:
            continue
        same = [j for j in ids if j > i and case[j] == case[i] and sim[j] == -1 and text[j] == text[i]]
        for j in same:
            sim[j] = i
        if same:
            sim[i] = i
    # near copies: one pass per case, rows in id order
    for c in sorted(set(case.values())):
        members = [i for i in ids if case[i] == c]
        changed = True
        while changed:  # repeat passes until nothing moves
            before = dict(sim)
            started = False
            for i in members:
                if sim[i] != -1:
                    continue
                for j in members:
                    if j <= i or sim[j] != -1:
                        continue
                    _, _, _, two, mk = differ_facts(text[i], text[j])
                    if two:
                        started = True
                        if mk:
                            sim[j] = i
                if started:
                    sim[i] = i
            changed = sim != before
        left = [i for i in members if sim[i] == -1]
        if len(left) == 1:
            sim[left[0]] = left[0]
    return {i: (noccur[i], sim[i]) for i in ids}


def first_match(prev, cur, answer, prefix="D J E N", offset=2):
    """prev/cur: lists of (row_id, case, journal, text, similar) of filtered
    rows of yesterday/today.  ``answer(cur_row, prev_row)`` -> bool.
    Returns {today's row_id: match_row}."""
    prev_cases = {p[1] for p in prev}
    eligible = []
    for c in sorted(cur):
        if c[1] in prev_cases and c[2] is not None and c[2].startswith(prefix) and c[1] not in eligible:
            eligible.append(c[1])
    out = {c[0]: -1 for c in cur}
    for case in eligible:
        tries = sorted((p for p in prev if p[1] == case), key=lambda p: (p[4] == -1, p[0]))
        for c in sorted(x for x in cur if x[1] == case):
            for p in tries:
                if answer(c, p):
                    out[c[0]] = p[0] + offset
                    break
    return out
