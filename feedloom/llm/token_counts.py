"""Token counts by a count-only Viterbi: Aho-Corasick enumerates the vocabulary's matches, dynamic programming carries score and pieces.

The vocabulary and scores of a SentencePiece file are read as a unigram model with byte fallback. Counts equal those of
the ``tokenizers`` library's Unigram model on the same pieces, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, table

#: A parameter: where the public vocabulary file lies.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Score of an unknown character below the lowest score of the vocabulary.
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) in the order of their ids."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter(dict):
    """The number of tokens of a chunk (a space sign and what follows up to the next), remembered for frequent chunks."""

    def __init__(self, pieces: list[tuple[str, float]], most: int = 300_000):
        super().__init__()
        self.automaton, self.room = ahocorasick.Automaton(), most
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, chunk: str) -> int:
        found = self.count(chunk)
        if len(self) < self.room:
            self[chunk] = found
        return found

    def count(self, chunk: str) -> int:
        """Pieces on the best path. Of equal scores the longest last piece wins, as the automaton lists longer matches first.

        A character that is no piece itself counts as its UTF-8 bytes and scores as unknown; it loses ties, being shortest.
        """
        best, pieces = [0.0] * (len(chunk) + 1), [0] * (len(chunk) + 1)
        done = 0

        def close(upto: int, matches: list[tuple[int, float]]) -> None:
            """Settles the position upto, given the matches that end there."""
            top, many, single = None, 0, False
            for n, score in matches:
                if top is None or best[upto - n] + score > top:
                    top, many = best[upto - n] + score, pieces[upto - n] + 1
                single |= n == 1
            if not single:
                if top is None or best[upto - 1] + self.unknown > top:
                    top, many = best[upto - 1] + self.unknown, pieces[upto - 1] + len(chunk[upto - 1].encode("utf-8", "surrogatepass"))
            best[upto], pieces[upto] = top, many

        open_matches: list[tuple[int, float]] = []
        for end, match in self.automaton.iter(chunk):
            while done < end:  # positions before this one are complete
                close(done + 1, open_matches)
                done, open_matches = done + 1, []
            open_matches.append(match)
        while done < len(chunk):
            close(done + 1, open_matches)
            done, open_matches = done + 1, []
        return pieces[-1]

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        chunks = text.replace(SPACE, " ").split(" ")
        if not chunks[0]:
            chunks = chunks[1:]  # no space sign is put before one that is there
        return sum(map(self.__getitem__, [SPACE + c for c in chunks]))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per document: id, n_tokens, n_chars (code points).

    Spaces become the space sign, one is put in front, and the text is cut before each sign; every chunk is then
    segmented by itself, as the tokenizer does. Null and empty texts have no tokens; repeated rows are counted each;
    extra columns are not read. The vocabulary (tens of thousands of pieces, its size is fixed by the file) is broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    held: list[Counter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held[0] if held else Counter(pieces.value)
        held[:] = [counter]
        for b in parts(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.of(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["id", "n_tokens", "n_chars"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_chars long").withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
