"""Encoding texts with the vocabulary of a public byte-level tokenizer.

The words of a batch of texts are encoded together: an index holds, for each mergeable pair of neighbouring tokens, all
places where it stands in the batch. Pairs are taken in ascending rank; all places of one are merged, left to right, and the
neighbours' entries are brought up to date. Every word of a batch is encoded once, however often it occurs.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before merging, as the tokenizer defines it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker keeps the ids of at most so many words (of at most so many bytes each) from batch to batch.
CACHE_WORDS, CACHE_BYTES = 400_000, 64


def tokenizer_file(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, else in $TOKENIZERS_DIR, else in the installed package of public tokenizers."""
    folder = folder or os.environ.get("TOKENIZERS_DIR")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class PairIndexEncoder:
    """Encodes words (byte strings) by ranks: the rank of a token is its id and its place in the order of merges."""

    def __init__(self, ranks: bytes):
        entries = (line.split() for line in ranks.splitlines() if line)
        self.ids = {base64.b64decode(token): int(rank) for token, rank in entries}
        self.bytes = {rank: token for token, rank in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.joint: dict[tuple[int, int], int] = {}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def rank(self, left: int, right: int) -> int:
        """The id of two tokens' merge, -1 if there is none."""
        found = self.joint.get((left, right))
        if found is None:
            found = self.joint[left, right] = self.ids.get(self.bytes[left] + self.bytes[right], -1)
        return found

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        token: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        for word in words:
            at = len(token)
            starts.append(at)
            token.extend(self.single[b] for b in word)
            before.append(-1)
            before.extend(range(at, at + len(word) - 1))
            after.extend(range(at + 1, at + len(word)))
            after.append(-1)
        places: dict[int, list[int]] = {}
        for i, j in enumerate(after):
            if j >= 0 and (r := self.rank(token[i], token[j])) >= 0:
                places.setdefault(r, []).append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            todo = sorted(places.pop(r, ()))
            for n, i in enumerate(todo):
                j = after[i]
                if token[i] < 0 or j < 0 or self.rank(token[i], token[j]) != r:
                    continue
                token[i], token[j] = r, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                lower = False
                for left, right in ((before[i], i), (i, k)):
                    if left >= 0 and right >= 0 and (new := self.rank(token[left], token[right])) >= 0:
                        if new not in places:
                            places[new] = []
                            heapq.heappush(active, new)
                        places[new].append(left)
                        lower |= new < r
                if lower and n + 1 < len(todo):  # a pair of lower rank appeared: it goes first
                    places.setdefault(r, []).extend(todo[n + 1 :])
                    heapq.heappush(active, r)
                    break
        found = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(token[at])
                at = after[at]
            found.append(tuple(ids))
        return found

    def encode_texts(self, texts: Iterable[str | None], split) -> list[list[tuple[int, ...]]]:
        """For each text the ids of its words; ``split`` cuts a text into words."""
        cut = [[w.encode() for w in split(text)] if text else [] for text in texts]
        new = list({w for words in cut for w in words} - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list({w for words in cut for w in words})
        known = dict(zip(new, self.encode(new)))
        self.cache.update((w, ids) for w, ids in known.items() if len(w) <= CACHE_BYTES)
        # Long words are not kept beyond this call; the ids of no word are empty.
        kept = self.cache.get
        return [[kept(w) or known[w] for w in words] for words in cut]


_encoders: dict[int, PairIndexEncoder] = {}


def token_ids(documents: DataFrame, *, doc_id: Column, text: Column, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>): one row for each row of ``documents``.

    The text is encoded as it stands and without special tokens; what looks like one is plain text. Null and empty texts
    have an empty list. ``vocabulary`` is the path of a rank file; it is read once by the driver and sent to the workers
    (a vocabulary has a fixed size). Any length of text is encoded whole.
    """
    with open(vocabulary or tokenizer_file(), "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        key = hash(ranks.value)
        encoder = _encoders.get(key) or _encoders.setdefault(key, PairIndexEncoder(ranks.value))
        for batch in batches:
            rows = encoder.encode_texts(batch.column("text").to_pylist(), split)
            sizes = np.fromiter((sum(map(len, row)) for row in rows), np.int32, len(rows))
            values = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.int32, int(sizes.sum(dtype=np.int64)))
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    rows = documents.select(doc_id.alias("doc_id"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")
