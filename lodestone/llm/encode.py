"""Encoding of a corpus with a public byte-level BPE vocabulary, by prefix-sharing tries.

A text is cut into words by the tokenizer's pattern. The distinct words that a task has not met
yet are inserted into a trie of bytes, which is walked depth first: the state of a node is the
last token of the encoding of the prefix it stands for. It is the one vocabulary entry that ends
the prefix and may follow the last token of what remains, so a prefix shared by many words is
worked out once, and a word's encoding is read off backwards from its node.

Whether token v may follow u is a question of the merges along the border only: the pieces of u's
right edge and v's left edge grow in order of rank, and no pair of border pieces may merge before.

Defined results: a null or empty text has the empty list; special tokens' strings are ordinary
text; every row gives one row, repeated ids included.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of the trie and words kept by a task before it begins anew.
MAX_NODES, MAX_WORDS = 1_000_000, 400_000
#: Words of more characters are encoded on their own.
LONG = 1000
NO_RANK = 1 << 60


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary(ranks, public_tokenizers.PATTERN)


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.text = {r: b for b, r in ranks.items()}
        lengths = defaultdict(set)
        for b in ranks:
            lengths[b[-2:]].add(len(b))
        #: by the last two bytes of a prefix, the lengths of entries that may end it, longest first
        self.lengths = {k: tuple(sorted(v | ({1} if len(k) == 2 else set()), reverse=True)) for k, v in lengths.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.child: list[dict[int, int]] = [{}]
        self.parent, self.last, self.depth = [0], [-1], [0]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two entries whose merge makes this one; None for a single byte."""
        if token not in self.parts:
            b = self.text[token]
            self.parts[token] = tuple(self._merge(b, token)) if len(b) > 1 else None
        return self.parts[token]

    def _merge(self, b: bytes, below: int) -> list[int]:
        """Plain merging of a short text by the entries of rank less than ``below``."""
        pieces = [b[i : i + 1] for i in range(len(b))]
        while len(pieces) > 1:
            rank, i = min((self.ranks.get(pieces[i] + pieces[i + 1], NO_RANK), i) for i in range(len(pieces) - 1))
            if rank >= below:
                break
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return [self.ranks[p] for p in pieces]

    def _edge(self, token: int, side: int) -> list[int]:
        """The pieces at the token's left (0) or right (1) edge, from the whole token to the byte."""
        out = [token]
        while (s := self.split(out[-1])) is not None:
            if len(s) != 2:  # an entry that no merge reaches
                break
            out.append(s[side])
        return out

    def may_follow(self, u: int, v: int) -> bool:
        key = (u, v)
        got = self.follows.get(key)
        if got is None:
            got = self.follows[key] = self._may_follow(u, v)
            if len(self.follows) > 2_000_000:
                self.follows.clear()
        return got

    def _may_follow(self, u: int, v: int) -> bool:
        right, left = self._edge(u, 1), self._edge(v, 0)
        i, j = len(right) - 1, len(left) - 1
        while True:
            grow_u = right[i - 1] if i else NO_RANK
            grow_v = left[j - 1] if j else NO_RANK
            rank = self.ranks.get(self.text[right[i]] + self.text[left[j]], NO_RANK)
            # of equal ranks the leftmost merges first: u's own, then the border, then v's own
            if rank < grow_u and rank <= grow_v and rank < NO_RANK:
                return False
            if not i and not j:
                return True
            if grow_u <= grow_v:
                i -= 1
            else:
                j -= 1

    def learn(self, words: list[str]) -> None:
        """Encode words: insert them into the trie, set the new nodes' states, read the ids off."""
        if len(self.child) > MAX_NODES or len(self.words) > MAX_WORDS:
            self.restart()
        ends, child, parent, last, depth = [], self.child, self.parent, self.last, self.depth
        new: list[int] = []
        for w in words:
            node = 0
            for byte in w.encode():
                nxt = child[node].get(byte)
                if nxt is None:
                    nxt = child[node][byte] = len(child)
                    child.append({})
                    parent.append(node)
                    last.append(-1)
                    depth.append(depth[node] + 1)
                    if last[node] >= 0 or node == 0:
                        new.append(nxt)
                node = nxt
            ends.append(node)
        for top in new:
            self._walk(top)
        for w, node in zip(words, ends):
            ids = []
            while node:
                token = last[node]
                ids.append(token)
                for _ in range(len(self.text[token])):
                    node = parent[node]
            ids.reverse()
            self.words[w] = ids

    def _walk(self, top: int) -> None:
        """Depth first over the new nodes below ``top``, the bytes of the path at hand."""
        child, parent, last = self.child, self.parent, self.last
        path: list[int] = []
        nodes: list[int] = []
        node = parent[top]
        while node:
            up = parent[node]
            path.append(next(b for b, c in child[up].items() if c == node))
            nodes.append(node)
            node = up
        path.reverse()
        nodes.reverse()
        base = len(path)
        byte = next(b for b, c in child[parent[top]].items() if c == top)
        stack = [(top, byte, base)]
        text = bytearray(path)
        while stack:
            node, byte, at = stack.pop()
            del text[at:]
            del nodes[at:]
            text.append(byte)
            nodes.append(node)
            if last[node] < 0:
                last[node] = self._state(text, [last[x] for x in nodes[-self.longest - 1 : -1]])
            stack.extend((c, b, at + 1) for b, c in child[node].items() if last[c] < 0)

    def _state(self, text: bytearray, before: list[int]) -> int:
        """The last token of the encoding of ``text``; ``before`` has the states of its prefixes."""
        n, ranks = len(text), self.ranks
        for size in self.lengths.get(bytes(text[-2:]), (1,)):
            if size > n:
                continue
            token = ranks.get(bytes(text[n - size :]))
            if token is None:
                continue
            if size == n:
                s = self.split(token)
                if s is None or len(s) == 2:
                    return token
            elif self.may_follow(before[-size], token):
                return token
        raise AssertionError("a byte has no entry in the vocabulary")

    def line(self, word: str) -> list[int]:
        """A very long word on its own: the states along one line of prefixes, without a trie."""
        data, states, ids = word.encode(), [], []
        for end in range(1, len(data) + 1):
            known = min(end, self.longest + 1)
            whole = known == end
            # a window longer than any entry decides as the whole prefix would
            text = bytearray(data[end - known : end]) if whole else bytearray(b"\0") + data[end - known : end]
            states.append(self._state(text, states[-self.longest :]))
        end = len(data)
        while end:
            ids.append(states[end - 1])
            end -= len(self.text[ids[-1]])
        return ids[::-1]

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Ids of all texts laid end to end, and the offsets of each text."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.child) > MAX_NODES or len(self.words) > MAX_WORDS:
            self.restart()
        known = self.words
        fresh = {w for words in cut for w in words if w not in known and len(w) <= LONG}
        if fresh:
            self.learn(sorted(fresh))
            known = self.words
        flat: list[int] = []
        ends = [0]
        for words in cut:
            for w in words:
                flat += known[w] if len(w) <= LONG else self.line(w)
            ends.append(len(flat))
        return flat, ends


def encode_column(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids): the token ids of every row's text, in one pass and without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                piece = batch.slice(lo, 500)
                flat, ends = vocabulary.encode(piece.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("__key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).mapInArrow(work, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, tokens) by the same encoding."""
    return encode_column(docs, key, text, path).select(key, F.size("ids").cast("long").alias("tokens"))
