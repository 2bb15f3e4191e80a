"""Token counts: greedy longest-match word pieces counted by one automaton, without building the pieces.

The vocabulary is a trie over bytes. A node's failure link leads to where matching goes on once the longest tokens
of its string are taken off, and its count says how many tokens that takes off; both are found breadth-first when
the automaton is built. Matching then reads each byte once.

Edge cases: null and empty texts have no words and no tokens; words that the vocabulary can't spell count as one
token (`unknown`); repeated rows count each for itself; an empty table gives an empty table; other columns are
ignored; a very long text is counted in one pass over its words.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import id_and_text, released, texts


class Automaton:
    """Counts the greedy pieces of words; tokens are byte strings, and a word is matched after `start`."""

    def __init__(self, tokens: list[bytes], start: bytes = b" "):
        self.start = start
        step: dict[int, int] = {}  # node << 8 | byte -> node
        fail, count, ends = [-1], [0], [False]
        kids: list[list[int]] = [[]]
        for token in tokens:
            node = 0
            for c in token:
                if (to := step.get(node << 8 | c)) is None:
                    step[node << 8 | c] = to = len(fail)
                    kids[node].append(c)
                    fail.append(-1)
                    count.append(0)
                    ends.append(False)
                    kids.append([])
                node = to
            ends[node] = node > 0
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for c in kids[u]:
                v = step[u << 8 | c]
                queue.append(v)
                if ends[v]:
                    fail[v], count[v] = 0, 1
                    continue
                z, n = fail[u], count[u]
                while z >= 0 and (z << 8 | c) not in step:
                    z, n = fail[z], n + count[z]
                if z >= 0:
                    fail[v], count[v] = step[z << 8 | c], n
        self.step, self.fail, self.count = step, fail, count

    def pieces(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word; 0 if the vocabulary can't spell it."""
        step, fail, count = self.step, self.fail, self.count
        u = n = 0
        for c in self.start + word:
            while (to := step.get(u << 8 | c)) is None:
                if fail[u] < 0:
                    return 0
                n += count[u]
                u = fail[u]
            u = to
        while u:
            if fail[u] < 0:
                return 0
            n += count[u]
            u = fail[u]
        return n


def byte_tokens(path: str) -> list[bytes]:
    """The tokens of a byte-level vocabulary file as bytes; a leading space marks a word's first piece."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(chars[c] for c in token) for token in vocabulary if all(c in chars for c in token)]


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", keep: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: one scan; the automaton, of the vocabulary's size, is broadcast.

    Words are runs of characters other than space and \\x09-\\x0D. Each distinct word is matched once per worker
    while at most `keep` words are kept.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(byte_tokens(tokenizer)))

    def run(batches):
        matcher = automaton.value

        class Known(dict):
            def __missing__(self, word):
                if len(self) > keep:
                    self.clear()
                self[word] = n = matcher.pieces(word)
                return n

        known = Known()
        for ids, batch in texts(batches):
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch:
                n = list(map(known.__getitem__, text.encode("utf-8", "surrogatepass").split()))
                missing = n.count(0)
                n_words.append(len(n))
                n_tokens.append(sum(n) + missing)
                n_unknown.append(missing)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n_words, n_tokens, n_unknown)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return id_and_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, n_words long, n_tokens long, n_unknown long")
