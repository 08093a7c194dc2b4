"""Pairwise alignments as two gapped strings: scoring, choosing among equals, variants and CIGAR parts.

Plain functions for Arrow batches. Defined results: empty sequences align to gaps only; an alignment without differences has
no variants.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Op = tuple[str, int]


def align(a: str, b: str, match: float = 1, mismatch: float = -1, gap: float = -1) -> tuple[str, str, float]:
    """(gapped a, gapped b, score) of a global alignment of best score; of equal ones gaps come as far left as they can."""
    n, m = len(a), len(b)
    s = np.zeros((n + 1, m + 1))
    s[:, 0], s[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i, j] = max(s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), s[i - 1, j] + gap, s[i, j - 1] + gap)
    x, y, i, j = [], [], n, m
    while i or j:  # from the right: pairs first, so that gaps are left for the beginning
        if i and j and s[i, j] == s[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            x.append(a[i])
            y.append(b[j])
        elif i and s[i, j] == s[i - 1, j] + gap:
            i -= 1
            x.append(a[i])
            y.append("-")
        else:
            j -= 1
            x.append("-")
            y.append(b[j])
    return "".join(reversed(x)), "".join(reversed(y)), float(s[n, m])


def _gaps(target: str, query: str) -> list[tuple[int, int]]:
    """(start, length) of the runs of gaps in either string."""
    out, i = [], 0
    while i < len(target):
        if target[i] == "-" or query[i] == "-":
            j = i
            while j < len(target) and (target[j] == "-" or query[j] == "-"):
                j += 1
            out.append((i, j - i))
            i = j
        else:
            i += 1
    return out


def best(alignments: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """The one of least total gap length, then of leftmost gaps, then of longer gaps first; a tie that remains is an error."""
    keyed = sorted(((sum(n for _, n in g), [s for s, _ in g], [-n for _, n in g]), i) for i, g in enumerate(_gaps(*x) for x in alignments))
    if len(keyed) > 1 and keyed[0][0] == keyed[1][0]:
        raise ValueError("several alignments are equally good")
    return tuple(alignments[keyed[0][1]])


def variants(target: str, query: str, start0: int) -> list[tuple[int, str, str]]:
    """(position from 0, ref, alt) of the differences of an alignment whose target begins at ``start0``. Gaps of the query at
    both ends are no differences; runs of mismatches are one, neighbouring gaps of both kinds too (without a kept base)."""
    lead, trail = len(query) - len(query.lstrip("-")), len(query) - len(query.rstrip("-"))
    pos = start0 + sum(c != "-" for c in target[:lead])
    end = len(query) - trail
    out, i, last = [], lead, target[lead - 1] if lead else ""
    while i < end:
        if target[i] != "-" and query[i] != "-":
            j = i
            while j < end and target[j] != "-" and query[j] != "-" and target[j] != query[j]:
                j += 1
            if j > i:
                out.append((pos, target[i:j], query[i:j]))
            j = max(j, i + 1)
            pos, last = pos + j - i, target[j - 1]
        else:
            j = i
            while j < end and (target[j] == "-" or query[j] == "-"):
                j += 1
            gone, new = target[i:j].replace("-", ""), query[i:j].replace("-", "")
            out.append((pos, gone, new) if gone and new else (pos - 1, last + gone, last + new))
            pos, last = pos + len(gone), gone[-1] if gone else last
        i = j
    return out


def split_cigar(ops: Sequence[Op], start0: int, lo: int, hi: int) -> tuple[list[Op], list[Op], list[Op]]:
    """Operations before, inside and behind the reference range [lo, hi); those that take no reference base stay with what
    precedes them."""
    parts: tuple[list[Op], list[Op], list[Op]] = ([], [], [])
    pos = start0
    for op, n in ops:
        if op in "MDN=X":
            for k, (a, b) in enumerate(((pos, min(pos + n, lo)), (max(pos, lo), min(pos + n, hi)), (max(pos, hi), pos + n))):
                if b > a:
                    parts[k].append((op, b - a))
            pos += n
        else:
            parts[0 if pos < lo or pos == start0 < lo else 1 if pos < hi or pos == hi > lo else 2].append((op, n))
    return parts


def groups(sequences: Sequence[str], least: float = 0.7) -> list[int]:
    """Number of the group of each sequence: the longest comes first, every one joins the first group whose first member it
    resembles (score over the length of the shorter one)."""
    order = sorted(range(len(sequences)), key=lambda i: (-len(sequences[i]), i))
    heads: list[int] = []
    out = [0] * len(sequences)
    for i in order:
        for g, h in enumerate(heads):
            n = min(len(sequences[i]), len(sequences[h]))
            # the shorter one may lie anywhere in the longer one, so the gaps that this takes are not counted
            if n and align(sequences[h], sequences[i])[2] + (len(sequences[h]) - n) >= least * n:
                out[i] = g
                break
        else:
            out[i] = len(heads)
            heads.append(i)
    return out
