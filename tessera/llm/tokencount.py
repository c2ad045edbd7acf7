"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; for each end the best score and the number
of pieces of the best path are kept, no path itself, in a ring as long as the longest piece.  Ties go as in the tokenizer
that this counts for: candidates in order of their starts, a later one only if its score is greater, so of equal paths the
longer last piece wins; a character without a piece of its own may be unknown at the least score less 10, and an unknown
character counts as its UTF-8 bytes (byte fallback) or, without byte pieces, joins the unknowns beside it.  Scores are summed
in doubles from the left, as there.  Text is cut before each blank (shown as U+2581), one is put in front.

The vocabulary file is a parameter; the driver reads it and sends the pieces out (their number is fixed by the file).
Defined cases: null and empty texts have no tokens; any length works, in memory for one text; repeated rows count each; ids may be null
or of any type; an empty table gives an empty result; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
PENALTY = 10.0


def read_pieces(path: str = MODEL) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, by id; the scores serve as those of a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter(dict):
    """Tokens of each unit (a blank and what follows it up to the next); short units are kept until there are too many."""

    limit, longest = 500_000, 48

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.ring = max((len(p) for p, _ in pieces), default=0) + 1
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.bytes = all(f"<0x{k:02X}>" in {p for p, _ in pieces} for k in range(256)) if pieces else False

    def viterbi(self, unit: str) -> int:
        ring = self.ring
        scores, counts, open_ = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(unit)
        match = next(matches, None)
        for end, char in enumerate(unit):
            best, count, single, ends_unknown = None, 0, False, False
            while match is not None and match[0] == end:
                length, score = match[1]
                start = (end + 1 - length) % ring
                score += scores[start]
                if best is None or score > best:
                    best, count = score, counts[start] + 1
                single = single or length == 1
                match = next(matches, None)
            if not single:
                start = end % ring
                score = self.unknown + scores[start]
                if best is None or score > best:
                    best, ends_unknown = score, True
                    count = counts[start] + (len(char.encode("utf-8", "surrogatepass")) if self.bytes else not open_[start])
            at = (end + 1) % ring
            scores[at], counts[at], open_[at] = best, count, ends_unknown
        return counts[len(unit) % ring]

    def __missing__(self, unit: str) -> int:
        count = self.viterbi(BLANK + unit)
        if len(unit) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = count
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        units = text.replace(" ", BLANK).split(BLANK)
        return sum(map(self.__getitem__, units if units[0] else units[1:]))


def counted(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens) of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            sizes = pa.array([len(x or "") for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([counter.count(x) for x in texts], pa.int64())], names=[id_col, "n_chars", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, n_chars long, n_tokens long")
