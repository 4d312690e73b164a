"""Token counts by a linear longest-match automaton over a fixed vocabulary."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import narrow, release, word_slices, worker_cache

RESULT = "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>"
SLICE = 8 << 20


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """A trie over the vocabulary whose nodes know where to go on, and how many tokens that emits, when no edge fits.

    ``edge[node << 8 | byte]`` is a child; ``link[node]`` the node to go on from, -1
    if the text so far cannot be cut into tokens; ``popped[node]`` the tokens that
    longest-match-first takes off the node's string before it is at ``link[node]``.
    """

    edge: dict[int, int]
    link: list[int]
    popped: list[int]

    @classmethod
    def build(cls, vocabulary: list[bytes]) -> "Automaton":
        edge: dict[int, int] = {}
        parent, symbol, is_token = [0], [0], [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                child = edge.get(key)
                if child is None:
                    child = edge[key] = len(parent)
                    parent.append(node), symbol.append(byte), is_token.append(False)
                node = child
            is_token[node] = node > 0
        depth = np.zeros(len(parent), np.int64)
        for node in range(1, len(parent)):  # parents are made before their children
            depth[node] = depth[parent[node]] + 1
        link, popped = [-1] * len(parent), [0] * len(parent)
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            if is_token[node]:
                link[node], popped[node] = 0, 1
                continue
            at, n, byte = link[parent[node]], popped[parent[node]], symbol[node]
            while at >= 0:
                to = edge.get(at << 8 | byte)
                if to is not None:
                    link[node], popped[node] = to, n
                    break
                n += popped[at]
                at = link[at]
        return cls(edge, link, popped)

    def count(self, word: bytes) -> int:
        """Tokens of longest match first, or -1 if it gets stuck; each byte is read once and each token popped once."""
        edge, link, popped = self.edge, self.link, self.popped
        node = n = 0
        for byte in word:
            to = edge.get(node << 8 | byte)
            while to is None:
                n += popped[node]
                node = link[node]
                if node < 0:
                    return -1
                to = edge.get(node << 8 | byte)
            node = to
        while node:
            n += popped[node]
            node = link[node]
            if node < 0:
                return -1
        return n


def token_counts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lead: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text.

    Words are separated by ASCII white space and matched with one blank in front, as
    vocabularies with leading blanks want it. A word that cannot be cut is one token
    and counts as unknown. A null or empty text has none of all. Rows are counted
    alone, so repeated rows get equal counts; an empty table gives an empty result.
    Only distinct words of a batch go through the automaton.
    """
    @F.arrow_udf(RESULT)
    def counts(texts: pa.Array) -> pa.Array:
        automaton = worker_cache(f"automaton:{vocabulary}", lambda: Automaton.build(read_vocabulary(vocabulary)))
        count, cols = automaton.count, []
        for _, _, codes, distinct, offsets in word_slices(texts, SLICE):
            each = np.fromiter((count(lead + w) for w in distinct.cast(pa.binary()).to_pylist()), np.int64, len(distinct))
            unknown = each < 0
            tokens = np.where(unknown, 1, each)
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[codes])])[offsets]) for x in (tokens, unknown)]
            cols.append((np.diff(offsets), *sums))
        release()
        joined = [np.concatenate([c[k] for c in cols]) if cols else np.empty(0, np.int64) for k in range(3)]
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in joined], ["n_words", "n_tokens", "n_unknown"])

    rows = narrow(df, doc_id=id_col, text=F.col(f"`{text_col}`").cast("string"))
    return rows.select("doc_id", counts("text").alias("r")).select("doc_id", "r.*")
