"""Token counts with a linear longest-match automaton.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``; each is matched as the word-start mark (a space) followed by its
UTF-8 bytes, and cut greedily into the longest pieces of the vocabulary. The automaton is the trie of the vocabulary's
byte strings; a node's failure link leads to the node of what is left of its string after the longest pieces in front are
popped, and carries how many pieces that pops. Counting a word takes one pass over its bytes and builds no piece.

A byte that no piece can start with counts as one unknown piece. Null and empty texts have no words and no tokens.
Rows that repeat an id give rows of their own; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import chunks, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a task remembers; the memory is emptied when it is full.
MEMO = 200_000


def read_vocabulary(path: str) -> list[bytes]:
    """Byte strings of a ranks file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(x.split()[0]) for x in f if x.strip()]


class LongestMatch:
    """Trie with failure links and popped-piece counts; ``mark`` opens each word."""

    def __init__(self, pieces: list[bytes], mark: bytes = b" "):
        self.mark = mark
        self.next: list[dict[int, int]] = [{}]
        final, parent, byte = [False], [-1], [0]
        for p in pieces:
            u = 0
            for c in p:
                v = self.next[u].get(c)
                if v is None:
                    v = len(self.next)
                    self.next[u][c] = v
                    self.next.append({})
                    final.append(False)
                    parent.append(u)
                    byte.append(c)
                u = v
            if u:
                final[u] = True
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        level = list(self.next[0].values())
        while level:  # by depth: a link only needs those of shorter strings
            for v in level:
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                u, c = parent[v], byte[v]
                z, k = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    k += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], k
            level = [w for v in level for w in self.next[v].values()]

    def count(self, word: bytes) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        s, i, u, k, start, at = self.mark + word, 0, 0, 0, 0, 0
        while i < len(s):
            v = nxt[u].get(s[i])
            if v is not None:
                u, i = v, i + 1
            elif u == 0:  # nothing starts with this byte
                k, i, start = k + 1, i + 1, i + 1
            elif fail[u] >= 0:
                k, u = k + popped[u], fail[u]
            else:  # a dead end that no split of its string covers: leave the automaton
                return self._plain(s)
        while u:
            if fail[u] < 0:
                return self._plain(s)
            k, u = k + popped[u], fail[u]
        return k

    def _plain(self, s: bytes) -> int:
        """Only for vocabularies that lack single bytes: match piece by piece, unknown bytes one by one."""
        i = k = 0
        while i < len(s):
            u, j, best = 0, i, i + 1
            while j < len(s) and (u := self.next[u].get(s[j], -1)) > 0:
                j += 1
                if self.fail[u] == 0 and self.popped[u] == 1:
                    best = j
            i, k = best, k + 1
        return k


_built: dict[str, LongestMatch] = {}


def token_counts(docs: DataFrame, pieces: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, n_bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hashlib.sha256(b"\0".join(pieces)).hexdigest()

    def run(batches):
        if key not in _built:  # once in each Python worker
            _built.clear()
            _built[key] = LongestMatch(shared.value)
        auto, memo = _built[key], {}
        for b in batches:
            words, tokens, size = [], [], []
            for _, texts in chunks(b.column(1).to_pylist()):
                for t in texts:
                    parts = t.split()
                    n = 0
                    for w in parts:
                        k = memo.get(w)
                        if k is None:
                            if len(memo) >= MEMO:
                                memo.clear()
                            k = memo[w] = auto.count(w)
                        n += k
                    words.append(len(parts))
                    tokens.append(n)
                    size.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (words, tokens, size)]], names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return spread(docs.withColumn(id_col, F.col(id_col).cast("long")), text_col, id_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
