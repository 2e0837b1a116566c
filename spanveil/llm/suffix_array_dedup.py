"""Op 10: suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from spanveil.llm.batches import expand
from spanveil.llm.repeats import Units, remove_repeats

#: Bytes whose order is found by the first sort; the expansion starts at this length.
_FIRST = 5


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first ``depth`` bytes or more, by prefix doubling over those still tied; and which differ
    from the one before within the first ``_FIRST`` bytes."""
    n = len(s)
    bits = max(1, int(n + 1).bit_length())
    at = np.arange(n, dtype=np.uint64)
    padded = np.concatenate((s.astype(np.uint64) + np.uint64(1), np.zeros(_FIRST, np.uint64)))
    first = np.zeros(n, dtype=np.uint64)
    for i in range(_FIRST):
        first = first * np.uint64(257) + padded[i : i + n]
    order = np.argsort(first, kind="stable") if bits > 22 else (np.sort((first << np.uint64(bits)) | at) & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, dtype=np.int64)  # 0: past the end
    rank[order] = heads + 1
    start, length = new.copy(), _FIRST
    while length < depth:
        tied = np.ones(n, dtype=bool)
        tied[:-1] &= new[1:]
        tied = ~(tied & new)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        suffixes = order[places]
        one, two = rank[suffixes], rank[np.minimum(suffixes + length, n)]
        if 3 * bits <= 64:
            key = (one.astype(np.uint64) << np.uint64(2 * bits)) | (two.astype(np.uint64) << np.uint64(bits)) | suffixes.astype(np.uint64)
            key.sort()
            suffixes = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            suffixes = suffixes[np.lexsort((two, one))]
        order[places] = suffixes
        one, two = rank[suffixes], rank[np.minimum(suffixes + length, n)]
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new[places] = fresh
        rank[suffixes] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))] + 1
        length *= 2
    return order, start


def interval_expansion(units: Units, width: int) -> np.ndarray:
    """For each byte: whether the ``width`` bytes from it on, inside one content, stand at two places of the batch.

    Breadth first over string lengths: each interval of suffixes that start with a string is extended backward by every
    byte before it; the end of an extended interval that has no common-prefix length yet gets the current one. After
    ``width`` rounds just those boundaries are left whose common prefix is ``width`` or longer.
    """
    count = len(units.offs) - 1
    sizes = np.diff(units.offs)
    place = np.arange(len(units.buf)) + np.repeat(np.arange(count), sizes)
    s = np.full(len(units.buf) + count, 255, dtype=np.uint8)  # a byte that UTF-8 doesn't have ends each content
    s[place] = units.buf
    n = len(s)
    order, start = suffix_order(s, width)
    inverse = np.empty(n, dtype=np.int64)
    inverse[order] = np.arange(n)
    before = order - 1
    before[before < 0] = n - 1
    char = s[before].astype(np.int64)  # the transform
    back = inverse[before]  # its last-to-first mapping
    open_ = np.append(~start, False)  # boundaries without a common-prefix length
    open_[0] = False
    left = np.flatnonzero(start)
    right = np.append(left[1:], n)
    owner = np.zeros(n, dtype=np.int64)
    for _ in range(_FIRST, width):
        if not len(left):
            break
        t = expand(left, right - left)
        to = back[t]
        owner[to] = np.repeat(np.arange(len(left)), right - left) * 256 + char[t]
        to.sort()
        mine = owner[to]
        head = np.ones(len(to), dtype=bool)
        head[1:] = (mine[1:] != mine[:-1]) | (to[1:] != to[:-1] + 1)
        heads = np.flatnonzero(head)
        ends = to[np.append(heads[1:], len(to)) - 1] + 1
        fresh = open_[ends]
        left, right = to[heads[fresh]], ends[fresh]
        open_[right] = False
    twice = np.zeros(n, dtype=bool)
    twice[order] = open_[:-1] | open_[1:]
    return twice[place]


def suffix_array_dedup(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Removes every byte covered by a ``width``-byte string that also starts anywhere else, in any document.

    Returns a row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, what is left
    (bytes that no longer form UTF-8 at a cut are left out of the text, not of the digest). Matches never cross
    documents; overlapping occurrences count. Null texts are empty; texts under ``width`` bytes stay whole; repeated rows
    repeat each other; a null id is carried along; other columns are not read. An empty table gives an empty table.
    """
    out = remove_repeats(docs, "bytes", width, max(_FIRST + 3, width * 8 // 25), interval_expansion, id_col, text_col, keep_text)
    return out.withColumnsRenamed({"id": id_col, "n": "n_bytes"})
