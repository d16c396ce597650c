"""Token ids of a whole corpus by a public byte-pair vocabulary.

Texts are cut into words by the vocabulary's pattern; each *distinct* word of a batch is encoded once. The
distinct words, in byte order, are the leaves of a trie met depth first, so the walk keeps one stack of states
along the current path and a word starts from the state of the prefix it shares with the word before. The state
of a prefix is its last token: of all tokens that end the prefix, the longest one that can follow the last token
of what precedes it. Whether one token can follow another depends on these two alone (their merge order), so the
states of shared prefixes are computed once, and a word's ids are read back from its leaf.

There is no shuffle: every task encodes the rows it reads, with a bounded memory of words across its batches.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies unless told otherwise, and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a task remembers; beyond it the memory starts afresh, which costs time but changes no result.
REMEMBERED = 400_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes -> id (which is the merge rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """A byte-pair vocabulary with what the walk needs: how each token was merged, and which pairs merge."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.token = {i: t for t, i in ranks.items()}
        self.split = {i: self._parts(t, i) for t, i in ranks.items()}
        self.merged = {pair: i for i, pair in self.split.items() if pair[0] != i}
        self._follows: dict[tuple[int, int], bool] = {}

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge made this one; a single byte was not merged and gives itself."""
        if len(token) == 1:
            return rank, rank
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            order = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best, at = min(order)
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            raise ValueError(f"token {rank} is no merge of two tokens")
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether right can come after left: no merge across their border happens before those inside them.

        The tokens are taken apart in the reverse order of their merges; at each moment the two pieces that
        touch must not be a pair that merges earlier than the merges still standing on either side.
        """
        known = self._follows.get((left, right))
        if known is not None:
            return known
        a, b, limit = left, right, 1 << 60
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                answer = False
                break
            # Undo the later merge of the two, left or right; a single byte cannot be taken apart.
            a_parts, b_parts = self.split[a], self.split[b]
            if a > b and a_parts[0] != a:
                limit, a = a, a_parts[1]
            elif b_parts[0] != b and (b >= a or a_parts[0] == a):
                limit, b = b + 1, b_parts[0]
            elif a_parts[0] != a:
                limit, a = a, a_parts[1]
            else:
                answer = True
                break
        self._follows[left, right] = answer
        return answer

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct non-empty words, by one depth-first walk of their trie."""
        ranks, follows, longest = self.ranks, self.follows, self.longest
        out: dict[bytes, list[int]] = {}
        last: list[int] = [-1]  # last[i]: last token of the current path's first i bytes
        width: list[int] = [0]
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], width[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(word[start:end])
                    if token is not None and (start == 0 or follows(last[start], token)):
                        last.append(token)
                        width.append(end - start)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= width[end]
            out[word] = ids[::-1]
            before = word
        return out


class Encoder:
    """Texts to ids, remembering the words it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.vocabulary, self.pattern, self.known = Vocabulary(ranks), regex.compile(pattern), {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """One list of ids for each text; an empty list for null and empty texts."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = {w for words in cut for w in words if w not in self.known}
        ids = self.vocabulary.encode_words(w.encode() for w in fresh)
        known = self.known
        known.update((w, ids[w.encode()]) for w in fresh)
        return [[i for w in words for i in known[w]] for words in cut]


_ENCODERS: dict[int, Encoder] = {}


def encoder(shared) -> Encoder:
    """This worker's encoder for a broadcast vocabulary; a reused worker keeps only the last one."""
    key = id(shared) if not hasattr(shared, "id") else shared.id
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def token_ids(docs: DataFrame, path: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every text, without special tokens.

    Null and empty texts have an empty list; strings of special tokens are ordinary text; repeated rows give
    repeated results; texts of any length are encoded whole; an empty table gives an empty result. The
    vocabulary (some 50,000 short strings, a fixed size) is broadcast, so only the driver needs the file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or encoder(shared)
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_column, "ids"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"{id_column} {kind}, ids array<int>")
