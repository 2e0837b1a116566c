"""Op 4: substring dedup by suffix automata of reference shards.

The reference of a shard is the set of run contents (see ``repeats``) dealt to it by anchor, a bounded batch at a time:
that automaton is what a broadcast of the whole reference would hold for these documents, without its unbounded size.
Documents are streamed through it for matching statistics: after each word, the length of the longest suffix read so far
that ends at two places of the reference; where it reaches the threshold, the window is a repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from spanveil.llm.repeats import Units, remove_repeats


class SuffixAutomaton:
    """A suffix automaton of many sequences of integers with the number of places where each state's strings end."""

    def __init__(self) -> None:
        self.goto: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends = [0]

    def _split(self, p: int, symbol: int, q: int) -> int:
        """A state for the strings of ``q`` that are no longer than one more than those of ``p``."""
        goto, link, length = self.goto, self.link, self.length
        short = len(goto)
        goto.append(goto[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.ends.append(0)
        link[q] = short
        while p >= 0 and goto[p].get(symbol) == q:
            goto[p][symbol] = short
            p = link[p]
        return short

    def add(self, sequence: list[int]) -> None:
        goto, link, length, ends = self.goto, self.link, self.length, self.ends
        state = 0
        for symbol in sequence:
            q = goto[state].get(symbol)
            if q is not None:
                state = q if length[q] == length[state] + 1 else self._split(state, symbol, q)
            else:
                new = len(goto)
                goto.append({})
                length.append(length[state] + 1)
                link.append(0)
                ends.append(0)
                p = state
                while p >= 0 and symbol not in goto[p]:
                    goto[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = goto[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, symbol, q)
                state = new
            ends[state] += 1

    def repeated(self) -> list[int]:
        """By state: the length of the longest suffix of its strings that ends at two places."""
        length, link, ends = self.length, self.link, list(self.ends)
        order = np.argsort(np.array(length), kind="stable").tolist()
        for v in reversed(order[1:]):
            ends[link[v]] += ends[v]
        best = [0] * len(length)
        for v in order[1:]:
            best[v] = length[v] if ends[v] > 1 else best[link[v]]
        return best


def matching_statistics(units: Units, width: int) -> np.ndarray:
    """For each unit: whether the ``width`` units from it on, inside one content, stand at two places of the batch."""
    _, ids = np.unique(units.values, return_inverse=True)
    ids = ids.tolist()
    cuts = units.offs.tolist()
    contents = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    automaton = SuffixAutomaton()
    for x in contents:
        automaton.add(x)
    best, goto = automaton.repeated(), automaton.goto
    out = np.zeros(len(ids), dtype=bool)
    for at, x in zip(cuts, contents, strict=False):
        state = 0
        for i, symbol in enumerate(x):
            state = goto[state][symbol]
            if best[state] >= width:
                out[at + i - width + 1] = True
    return out


def substring_dedup(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Removes every word covered by a run of ``width`` words that also starts anywhere else, in any document.

    Returns a row per input row: id, n_words, n_removed, n_spans, kept_sha256 and, with ``keep_text``, the kept words
    joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; whole texts are judged as they came in.
    Null and empty texts have no words (digest of the empty string); fewer than ``width`` words: nothing to remove;
    repeated rows are documents of their own and so repeat each other; a null id is carried along; other columns are
    not read, so their names cannot clash. An empty table gives an empty table.
    """
    out = remove_repeats(docs, "words", width, max(1, width * 2 // 5), matching_statistics, id_col, text_col, keep_text)
    return out.withColumnsRenamed({"id": id_col, "n": "n_words"})
