"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads the text once.  At each
position its output links give every piece that ends there; each relaxes the
best score of a path to that position (Viterbi).  A character that no
one-character piece covers is an unknown node, scored below every piece, and
is written as its UTF-8 byte pieces.  Ties go to the longer last piece.

Where two neighbouring characters are inside no piece, every path ends a
piece between them.  A vocabulary is tested for two such rules when it is
read: no blank mark after another character, and nothing else after a letter.
As far as they hold, the text is cut there, the best path is made of the best
paths of the parts, and the paths of recent parts are kept in a bounded table
per worker (two generations, so frequent parts stay).

Normalisation is that of the given model file: none but one blank in front of
a text that is not empty, and the blank mark for each blank.  The sentencepiece
library reads the vocabulary file; it does not encode.

Defined results: null and empty texts have no ids.  The mark U+2581 in a text
is read as a blank, so such a text does not come back unchanged.  Texts are
taken whole, however long; memory is in proportion to the longest text.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import texts, vocabulary

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: A part ends after a run of letters; digits, the underscore and all that is no word character are not letters.
_OTHER = rf"(?:[^{MARK}\w]|[\d_])"
_PARTS = re.compile(rf"{MARK}*{_OTHER}*[^\W\d_]+|{MARK}*{_OTHER}+|{MARK}+")
_AFTER_LETTER = re.compile(r"[^\W\d_](?:[^\w]|[\d_])")
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"


class PieceCodec:
    """Automaton, scores and byte pieces of one vocabulary."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int] | None, unknown_id: int = 0, keep: int = 200_000):
        """``pieces``: (id, piece, score) of those that may match text; ``byte_ids``: ids of the 256 byte pieces."""
        self.automaton = ahocorasick.Automaton()
        for i, piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.single = {p for _, p, _ in pieces if len(p) == 1}
        self.unknown_score = min((s for _, _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.by_blank = not any(MARK in p.lstrip(MARK) for _, p, _ in pieces)
        by_letter = self.by_blank and not any(_AFTER_LETTER.search(p) for _, p, _ in pieces)
        self.parts = (_PARTS if by_letter else _WORDS).findall if self.by_blank else lambda text: [text]
        self.surface = {i: p.replace(MARK, " ").encode() for i, p, _ in pieces}
        if byte_ids:
            self.surface |= {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.keep, self.paths, self.older = keep, {}, {}   # words
        self.part_paths, self.older_parts = {}, {}

    @classmethod
    def from_file(cls, path: str) -> "PieceCodec":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        text = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in n
                if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in n) else None
        return cls(text, byte_ids, sp.unk_id())

    def path(self, word: str) -> list[int]:
        """Ids of the best path through one word: a single pass with relaxation at each end position."""
        n = len(word)
        best = [0.0] + [-np.inf] * n
        back: list = [None] * (n + 1)                     # (start, id); id -1: unknown character
        if self.single.issuperset(word):
            for end, (size, i, score) in self.automaton.iter(word):
                end += 1
                s = best[end - size] + score
                if s > best[end]:
                    best[end], back[end] = s, (end - size, i)
        else:
            done = 0                                      # positions up to here are final
            for end, (size, i, score) in self.automaton.iter(word):
                done = self._unknowns(word, best, back, done, end)
                end += 1
                s = best[end - size] + score
                if s > best[end]:
                    best[end], back[end] = s, (end - size, i)
            self._unknowns(word, best, back, done, n)
        out, at = [], n
        while at:
            start, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown_id)
            at = start
        return out[::-1]

    def _unknowns(self, word: str, best: list, back: list, done: int, end: int) -> int:
        """Closes the positions before ``end``: an uncovered character may end a path there."""
        while done < end:
            if word[done] not in self.single:
                s = best[done] + self.unknown_score
                if s > best[done + 1]:
                    best[done + 1], back[done + 1] = s, (done, -1)
            done += 1
        return done

    def _parts_path(self, marked: str) -> tuple:
        """Ids of the best path through marked text: the paths of its parts, one after the other."""
        out: tuple = ()
        for part in self.parts(marked):
            ids = self.part_paths.get(part) or self.older_parts.get(part) or tuple(self.path(part))
            if len(part) <= 64:
                if len(self.part_paths) >= self.keep:
                    self.older_parts, self.part_paths = self.part_paths, {}
                self.part_paths[part] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        out: list[int] = []
        if not self.by_blank:
            return self.path(marked)
        if MARK * 2 in marked or marked[-1] == MARK:
            for word in _WORDS.findall(marked):
                out += self._parts_path(word)
            return out
        paths, older = self.paths, self.older
        for word in marked[1:].split(MARK):                # single blanks: each word has one mark in front
            ids = paths.get(word)
            if ids is None:
                ids = older.get(word) or self._parts_path(MARK + word)
                if len(word) <= 64:
                    if len(paths) >= self.keep:
                        older, paths = paths, {}
                    paths[word] = ids
            out += ids
        self.paths, self.older = paths, older
        return out

    def decode(self, ids) -> str:
        """Text of the ids; control pieces have no text, wrong byte sequences give U+FFFD."""
        get = self.surface.get
        raw = b"".join([get(i, b"") for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


@functools.cache
def codec(name: str = MODEL) -> PieceCodec:
    """The codec of a vocabulary file, made once per Python worker."""
    return PieceCodec.from_file(vocabulary(name))


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids of every row of ``docs``; one map pass over whole texts."""

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([c.encode(t) for t in text], dtype=object)

    return texts(docs).select("doc_id", encode("text").alias("ids"))


def decode_documents(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give the empty text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series(["" if x is None else c.decode(x) for x in ids], dtype=object)

    return rows.select("doc_id", decode("ids").alias("text"))


def round_trip(docs: DataFrame, model: str = MODEL, rows_at_once: int = 256) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32, decoded_crc32, same: every text encoded, and its ids decoded again.

    Rows go out in small Arrow batches, so a worker holds few texts' ids.
    """
    def trip(batches):
        c = codec(model)
        for batch in batches:
            for a in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(a, rows_at_once)
                flat, ends, crcs, decoded, same = array("i"), [0], [], [], []
                for text in part.column("text").to_pylist():
                    ids = c.encode(text)
                    flat.extend(ids)
                    ends.append(len(flat))
                    crcs.append(zlib.crc32(np.asarray(ids, "<u4").tobytes()))
                    back = c.decode(ids)
                    decoded.append(zlib.crc32(back.encode("utf-8", "surrogatepass")))
                    same.append(back == text)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
                n = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, n, pa.array(crcs, pa.int64()), pa.array(decoded, pa.int64()), pa.array(same)],
                                                 ["doc_id", "ids", "n_tokens", "ids_crc32", "decoded_crc32", "same"])

    return texts(docs).mapInArrow(trip, "doc_id long, ids array<int>, n_tokens long, ids_crc32 long, decoded_crc32 long, same boolean")
