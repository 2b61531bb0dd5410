"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary has a whitespace marker after another
character, merges can't cross from a word to the next marker: a text falls into
chunks (markers, then the rest of the word) that are segmented independently.
Each batch of documents makes the table of its distinct chunks, segments every
chunk it hasn't met before once, and puts ids and decoded text together by
position. Tables are kept by each Python worker, emptied at a fixed number of bytes,
and hold no long chunks (words of unspaced scripts) beyond the text that has them, so
memory is bounded and nothing is shuffled; a table for the whole corpus would
have to be joined to every position of every text.

The model is checked for the property before use; where it doesn't hold, texts
are segmented whole by the library.

Defined results: a null text is empty: the begin and end ids only. Texts of any length
are encoded whole. Rows are encoded one by one; repeated rows get equal results. Of
columns only doc_id and text count, by their exact names. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Bytes of chunks, and of what they become, that one worker's table holds at most, with ENTRY for each; chunks of over LONG characters stay out of it.
TABLE_BYTES, ENTRY, LONG = 48 * 2**20, 200, 256
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def chunks_are_independent(model: sentencepiece.SentencePieceProcessor) -> bool:
    """No piece crosses into a marker, every byte has a piece, and the model leaves texts as they are but for the markers."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    if any(crossing.search(model.id_to_piece(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))):
        return False
    if sum(map(model.is_byte, range(model.get_piece_size()))) != 256:
        return False
    probes = [" a  b ", "\t\n\r\v\fx", "éÅﬁ 　  \x00\x01", "▁a▁", "\U0001f600 ​­"]
    return all(model.normalize(p) == MARK + p.replace(" ", MARK) for p in probes)


class Codec:
    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.apart = chunks_are_independent(self.model)
        self.table: dict[str, tuple[bytes, bytes]] = {}
        self.sizes: dict[str, int] = {}
        self.held = 0  # bytes of both tables
        self.passing: list[str] = []  # long chunks of the text at hand
        self.ends = (self.model.bos_id(), self.model.eos_id())
        if self.apart:
            # What each id stands for in the marked text, and in the decoded one.
            self.marked = [self._bytes(i) for i in range(self.model.get_piece_size())]
            self.plain = [x.replace(MARK.encode(), b" ") for x in self.marked]
            self.marked_size, self.plain_size = (np.fromiter(map(len, x), np.int64) for x in (self.marked, self.plain))

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        if self.model.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if self.model.is_control(i) or self.model.is_unknown(i) else piece.encode()

    def _segment(self, keys: list[str], whole: bool) -> None:
        """Adds chunks, named without their first marker, to the table: they are segmented in one call, end to end, and cut where each ends.

        Chunks of markers only would merge with the next; each is segmented
        behind a letter. Without whole, only their numbers of ids are kept.
        """
        lead = self.model.encode("a")
        for key in [k for k in keys if not k or k[-1] == MARK]:
            ids = self.model.encode("a" + MARK + key)[len(lead) :]
            self.sizes[key] = len(ids)
            if whole:
                self.table[key] = (np.array(ids, "<u4").tobytes(), b"".join([self.plain[i] for i in ids]))
        keys = [k for k in keys if k and k[-1] != MARK]
        if not keys:
            return
        ids = np.array(self.model.encode(MARK.join(keys)), np.int64)
        ends = np.searchsorted(np.cumsum(self.marked_size[ids]), np.cumsum([len(k.encode("utf-8", "surrogatepass")) + len(MARK.encode()) for k in keys])) + 1
        self.sizes.update(zip(keys, np.diff(ends, prepend=0).tolist()))
        if not whole:
            return
        decoded = b"".join([self.plain[i] for i in ids.tolist()])
        sizes = np.concatenate(([0], np.cumsum(self.plain_size[ids])))
        raw, at = ids.astype("<u4").tobytes(), 0
        for key, end, a, b in zip(keys, ends.tolist(), sizes[np.concatenate(([0], ends[:-1]))].tolist(), sizes[ends].tolist()):
            self.table[key] = (raw[4 * at : 4 * end], decoded[a:b])
            at = end

    def _chunks(self, text: str, whole: bool = True) -> list[str]:
        """The text's chunks in order, each without its first marker; all of them are in the table (without whole, their sizes) then."""
        known = self.table if whole else self.sizes
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))]
        else:
            chunks = text.split(" ")
        new = [c for c in set(chunks) if c not in known]
        if new:
            self._segment(new, whole)
            for c in new:
                if len(c) > LONG:
                    self.passing.append(c)
                else:
                    self.held += ENTRY + 2 * len(c) + (sum(map(len, self.table[c])) if whole else 0)
        return chunks

    def _trim(self) -> None:
        """Between texts: long chunks go, and all others once they hold TABLE_BYTES."""
        for c in self.passing:
            self.table.pop(c, None)
            self.sizes.pop(c, None)
        self.passing.clear()
        if self.held > TABLE_BYTES:
            self.table.clear()
            self.sizes.clear()
            self.held = 0

    def count(self, text: str | None) -> int:
        """Number of ids of a text, begin and end included."""
        if not text or not self.apart:
            return len(self.model.encode(text or "", add_bos=True, add_eos=True))
        n = 2 + sum(map(self.sizes.__getitem__, self._chunks(text, False)))
        self._trim()
        return n

    def round_trip(self, text: str | None) -> tuple[bytes, str]:
        """Ids (little-endian 32-bit) with begin and end, and the text decoded from them."""
        text = text or ""
        if not text or not self.apart:
            ids = self.model.encode(text, add_bos=True, add_eos=True)
            return np.array(ids, "<u4").tobytes(), self.model.decode(ids)
        chunks = self._chunks(text)
        found = list(map(self.table.__getitem__, chunks))
        self._trim()
        head, tail = (np.array([x], "<u4").tobytes() for x in self.ends)
        decoded = b"".join([x[1] for x in found])[1:].decode("utf-8", "surrogatepass")
        return b"".join([head, *(x[0] for x in found), tail]), decoded


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def encode(texts: pd.Series) -> pd.DataFrame:
        own = codec(model_path)
        rows = []
        for text in texts:
            ids, decoded = own.round_trip(text)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return common.pick(docs, "doc_id", "text").select("doc_id", encode("text").alias("_e")).select("doc_id", "_e.*")


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every row."""

    @F.pandas_udf("ids array<int>, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = codec(model_path)
        rows = [own.round_trip(x) for x in texts]
        return pd.DataFrame({"ids": [np.frombuffer(x[0], "<u4").astype(np.int32) for x in rows], "decoded": [x[1] for x in rows]})

    return common.pick(docs, "doc_id", "text").select("doc_id", run("text").alias("_e")).select("doc_id", "_e.*")
