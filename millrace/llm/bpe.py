"""Byte-level BPE encoding and decoding with a contiguous rank array per word."""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_or_empty

#: Fixed value: the published pattern that splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 40
#: Words of up to so many bytes are merged in the rank array; longer ones, with the same result, by a heap.
SHORT = 96
#: Words, and words with their punctuation, whose ids a task remembers.
REMEMBERED = 150_000


class Remembered:
    """A map of at most twice limit words to ids; when the newer half is full, the older one goes."""

    def __init__(self, limit: int):
        self.limit = limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.get = self.new.get

    def put(self, word: str, ids: bytes) -> bytes:
        if len(word) <= SHORT:
            if len(self.new) >= self.limit:
                self.old, self.new = self.new, {}
                self.get = self.new.get
            self.new[word] = ids
        return ids


def _printable_bytes() -> dict[str, int]:
    """The published map of characters in vocabulary entries to bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder over a tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte_of = _printable_bytes()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in byte_of.items():
            self.byte_id[b] = vocab[c]
        self.rank, self.merged = {}, []
        for r, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[left] << 20 | vocab[right]] = r
            self.merged.append(vocab[left + right])
        self.chunks, self.words = Remembered(remembered), Remembered(remembered)
        self.pieces = regex.compile(SPLIT).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.special_starts = {t[0] for t in self.special}

    def merge(self, word: bytes) -> list[int]:
        """ids[i] is the part that begins at boundary i, ranks[i] the rank of joining it with the next part."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 20 | b, NO_RANK) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            i = ranks.index(low)  # the leftmost of equal ranks
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue  # a part has changed since
            ids[i], ids[j] = self.merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (r, h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.at_special(text) if any(c in text for c in self.special_starts) else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(self._encode_part(part))
        return b"".join(out)

    def _encode_part(self, text: str) -> bytes:
        """No piece reaches over a single space between two other characters, so that what lies between spaces is remembered whole."""
        get, out, space = self.chunks.get, [], ""
        for chunk in text.split(" "):
            ids = get(space + chunk)
            if ids is None:
                if not chunk or chunk[-1].isspace():  # wider white space: a piece may reach over it
                    return self._encode_pieces(text)
                ids = self.chunks.put(space + chunk, self.chunks.old.get(space + chunk) or self._encode_pieces(space + chunk))
                get = self.chunks.get
            out.append(ids)
            space = " "
        return b"".join(out)

    def _encode_pieces(self, text: str) -> bytes:
        out = []
        for piece in self.pieces(text):
            ids = self.words.get(piece)
            if ids is None:
                ids = self.words.put(piece, self.words.old.get(piece) or array("I", self.merge(piece.encode())).tobytes())
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with token_ids (array of int) and n_tokens added; null text is empty and has no tokens.

    A column of docs by one of these names is replaced. Rows stay where they are: no shuffle. Repeated rows give repeated rows, no rows none.
    """
    path = path or default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = load(path)
        return texts.map(lambda t: np.frombuffer(bpe.encode(t), "<u4").astype("int32"))

    return docs.withColumn("token_ids", ids(text_or_empty(text_col))).withColumn("n_tokens", F.size("token_ids").cast("long"))


def bpe_decode(docs: DataFrame, path: str | None = None, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for; null or no ids give an empty text, no rows none."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        bpe = load(path)
        return ids.map(lambda x: bpe.decode(np.asarray([] if x is None else x, "<u4").tobytes()))

    return docs.withColumn(to, text(F.col(ids_col)))


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of its ids and of the text decoded from them.

    Both ways run in one pass, so that ids don't travel back and forth. Null text is empty, null ids stay null;
    repeated rows give repeated rows, no rows none. Long texts go piece by piece, so that a text's ids are all that is held besides it.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
            })

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read(spark, sf_dir, "documents"))
