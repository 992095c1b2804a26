"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text becomes marked words: a space in front, spaces turned into the mark, and
cuts before each run of marks (no piece of the vocabulary has a mark after a
letter, so no piece crosses a cut and the best segmentation of the text is the
best of its words).  The distinct words of an Arrow batch are sorted, which is
the depth-first order of their trie: a word keeps the forward scores of the
prefix that it shares with the word before it and only extends them.  A
segmentation's score is the sum of its pieces' scores; of equal ones the one
with the longer last piece wins.  A character that is no piece and ends none
scores below every piece and becomes byte pieces.

The vocabulary file is a parameter; its pieces and scores are read as they are.
Decoding joins the pieces' bytes, turns marks to spaces and drops the first.

Defined results: null text counts as empty and has no ids; a text that holds
the mark itself decodes to a space in its place (``round_trip`` is false);
rows that share a doc_id are encoded one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"
UNKNOWN_BELOW = 10.0  # an uncovered character scores this much below the lowest piece
UNITS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
SWITCHED_OFF = -1e8   # pieces with a score below are in the file, but no segmentation should have them
CHUNK_CHARS = 4_000_000
#: Words whose ids are kept between batches: so many, each at most so long.
CACHED_WORDS, CACHED_CHARS = 500_000, 64
#: What no piece ends with (a score may be any number).
NO_PIECE = object()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.byte = [0] * 256
        surface, self.points = [], np.zeros(model.get_piece_size())
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                self.score[piece], self.number[piece] = model.get_score(i), i
                self.points[i] = model.get_score(i)
                surface.append(piece.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(x) for x in surface])))
        self.unknown = min(v for v in self.score.values() if v > SWITCHED_OFF) - UNKNOWN_BELOW
        self.points[self.byte] = self.unknown
        #: every ending of a piece, with the piece's score where it is one itself
        self.endings: dict[str, float | None] = {}
        for piece in self.score:
            for k in range(len(piece)):
                self.endings.setdefault(piece[k:], None)
        self.endings.update(self.score)
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (int32) of each word; ``words`` come sorted, so common prefixes keep their forward scores."""
        endings, unknown = self.endings, self.unknown
        best, back, out, before = [0.0], [0], {}, ""
        for word in words:
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del best[shared + 1:], back[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                top, start = None, end - 1
                for begin in range(end - 1, -1, -1):  # towards the front, as long as a piece can end this way
                    own = endings.get(word[begin:end], NO_PIECE)
                    if own is NO_PIECE:
                        break
                    if own is not None and (top is None or own + best[begin] >= top):
                        top, start = own + best[begin], begin
                best.append(best[end - 1] + unknown if top is None else top)
                back.append(start)
            out[word] = np.array(self._ids(word, back), dtype=np.int32).tobytes()
            before = word
        return out

    def _ids(self, word: str, back: list[int]) -> list[int]:
        ids: list[int] = []
        end = len(word)
        while end:
            piece = word[back[end]:end]
            number = self.number.get(piece)
            ids.extend([number] if number is not None else [self.byte[b] for b in reversed(piece.encode("utf-8", "replace"))])
            end = back[end]
        return ids[::-1]

    def encode(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts given as marked words; words met before are looked up, up to a fixed number of them."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        fresh = self.encode_words(sorted(set().union(*texts) - self.known.keys()))
        self.known |= {word: ids for word, ids in fresh.items() if len(word) <= CACHED_CHARS}
        long = {word: ids for word, ids in fresh.items() if len(word) > CACHED_CHARS}
        found = {**self.known, **long}.__getitem__ if long else self.known.__getitem__
        return [np.frombuffer(b"".join(map(found, words)), dtype=np.int32) for words in texts]

    def decode(self, ids: np.ndarray) -> str:
        size = self.surface_at[ids + 1] - self.surface_at[ids]
        ends = np.cumsum(size)
        text = self.surface[np.repeat(self.surface_at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        text = text.tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def marked_words(text: str) -> list[str]:
    return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, ids, n_words, score, round_trip (the ids decode to the text)."""
    path = model_path or default_model()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_CHARS):
                    size += len(texts[to])
                    to += 1
                words = [marked_words(t) for t in texts[at:to]]
                ids = model.encode(words)
                ends = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in ids]))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, to - at), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids))),
                    pa.array([len(w) for w in words], pa.int64()), pa.array([float(model.points[i].sum()) for i in ids]),
                    pa.array(np.array([model.decode(i) == t for i, t in zip(ids, texts[at:to])], dtype=bool))],
                    names=["doc_id", "ids", "n_words", "score", "round_trip"])
                at = to

    return docs.select("doc_id", "text").mapInArrow(
        encode, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, n_words long, score double, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of rows with ids (null ids give a null text)."""
    path = model_path or default_model()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in slices(batches):
            texts = [None if ids is None else model.decode(np.array(ids, dtype=np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
