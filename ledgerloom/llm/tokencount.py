"""Token counts: Viterbi over a unigram vocabulary that carries no path, only its count.

The public files have no unigram model. The pieces and scores of their BPE model, whose
scores are merge ranks, are read as one: counts are exact for that reading and by its tie
rules, and aren't those of the BPE encoder (the README has the difference).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, file_bytes, table

SPACE = "▁"
#: What an unknown character costs more than the worst piece.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 500_000


def vocabulary(model: bytes) -> tuple[list[tuple[str, float]], bool]:
    """(pieces with scores, byte fallback) of a sentencepiece model; its normal pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    kind = pb.ModelProto.SentencePiece
    pieces = [(p.piece, p.score) for p in proto.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED)]
    return pieces, any(p.type == kind.BYTE for p in proto.pieces)


class PieceCounter(dict):
    """Numbers of pieces of segments, remembered in two generations of bounded size.

    No piece goes on after a space (``▁`` begins a piece or continues a run of its own)
    or holds a line feed, which is checked; so the best segmentation of a text is that of
    its segments, each with the space before it.
    """

    def __init__(self, model: bytes, limit: int = REMEMBERED):
        import ahocorasick

        pieces, bytes_ = vocabulary(model)
        if not bytes_:
            raise ValueError("unknown characters are counted by byte pieces, which this model lacks")
        for piece, _ in pieces:
            if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                raise ValueError(f"piece {piece!r} spans what segments are cut at")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.limit, self.old = limit, {}

    def pieces(self, text: str) -> int:
        """Of the segmentation of largest score; among equal ones, at each place the piece
        that begins first, as the tokenizer does: it replaces a path only by a better one."""
        best, count = [0.0], [0]
        matches = self.automaton.iter(text)
        end, (size, score) = next(matches, (-1, (0, 0.0)))
        single, unknown = self.single, self.unknown
        for e, char in enumerate(text):
            top, n = None, 0
            while end == e:  # longest first: those that begin first
                s = e + 1 - size
                if top is None or best[s] + score > top:
                    top, n = best[s] + score, count[s] + 1
                end, (size, score) = next(matches, (-1, (0, 0.0)))
            if char not in single and (top is None or best[e] + unknown > top):
                top, n = best[e] + unknown, count[e] + len(char.encode(errors="surrogatepass"))
            best.append(top)
            count.append(n)
        return count[-1]

    def __missing__(self, word: str) -> int:
        got = self.old.get(word)
        if got is None:
            # A word after a line feed has no space before it; the line feed is a byte piece.
            got = 1 + self.pieces(word[1:]) if word[:1] == "\n" else self.pieces(SPACE + word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def count(self, text: str | None) -> int:
        """Tokens of the whole text after the dummy space; 0 for null and empty text."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
        if text[0] == "\n":
            words[0] = None  # stands for the dummy space alone
        elif "" not in words:
            return sum(map(self.__getitem__, words))
        # Runs of spaces: they belong to the word behind them, or end a line or the text.
        total, spaces = 0, 0
        for w in words:
            if w is None:
                spaces = 1
            elif w == "":
                spaces += 1
            elif w[0] == "\n":
                total += (self.pieces(SPACE * spaces) if spaces else 0) + self[w]
                spaces = 0
            else:
                total += self.pieces(SPACE * (spaces + 1) + w) if spaces else self[w]
                spaces = 0
        return total + (self.pieces(SPACE * spaces) if spaces else 0)


_counters: dict[int, PieceCounter] = {}


def token_counts(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens) of whole texts, however long; null and empty texts have 0.

    Of segmentations of equal score the one counts that the tokenizer's rule prefers.
    Repeated rows and shared doc_ids are counted each; other columns are ignored; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = zlib.crc32(model)

    def run(batches):
        if key not in _counters:
            _counters[key] = PieceCounter(shared.value)
        counter = _counters[key]
        for batch in batches:
            texts, out = batch.column(1), np.zeros(batch.num_rows, np.int64)
            for s, e in chunks([1024] * batch.num_rows, 1 << 20):
                out[s:e] = [counter.count(t) for t in texts[s:e].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long")


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), file_bytes(_path()))
