"""Token counts by count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary pieces that end at each character; the
dynamic programme keeps only the best score and its piece count per position.
Tie rules are those of the ``tokenizers`` unigram model: a later candidate must
be strictly better, candidates come in order of their start, so of equal paths
the one with the longest last piece stands; a character that no single piece
covers may be unknown at the smallest score less 10, unknown neighbours fuse,
and an unknown run counts its UTF-8 bytes where the vocabulary has byte pieces.

No vocabulary piece holds a word mark after another character, so every best
path has a cut before each run of marks; segments between cuts are independent
and their counts are memoised in a bounded table.  (A vocabulary with a piece
across that cut is processed whole.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.common import table
from hearth.llm.registry import register

MARK = "▁"
UNKNOWN_PENALTY = 10.0
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order from a sentencepiece model file; id 0 is the unknown piece."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts tokens of texts under the best unigram segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int = 0, memo: int = 600_000):
        import ahocorasick
        # of equal pieces the last id wins, as in a token -> id map
        self.pieces = {p: s for p, s in vocabulary if p}
        self.single = {p for p in self.pieces if len(p) == 1}
        self.unknown_piece = vocabulary[unknown_id][0]
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        inside = re.compile(f"[^{MARK}]{MARK}")
        whole = MARK not in self.pieces or any(inside.search(p) for p in self.pieces)
        self.segment = None if whole else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo_size, self.memo = memo, {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score, piece == self.unknown_piece))
        self.automaton.make_automaton()

    def _run(self, run: str) -> int:
        """Tokens of a fused unknown run: itself, its bytes, or one unknown."""
        data = run.encode("utf-8")
        return len(data) if run not in self.pieces and all(f"<0x{b:02X}>" in self.pieces for b in data) else 1

    def _covered(self, s: str) -> int:
        """Tokens of the best path where every character is a piece of its own,
        so that nothing can be unknown."""
        best = [float("-inf")] * (len(s) + 1)
        best[0], count = 0.0, [0] * (len(s) + 1)
        for end, (length, score, _) in self.automaton.iter(s):  # longest first, so by rising start
            begin = end + 1 - length
            value = best[begin] + score
            if value > best[end + 1]:
                best[end + 1] = value
                count[end + 1] = count[begin] + 1
        return count[-1]

    def _viterbi(self, s: str) -> tuple[int, int]:
        """(tokens, unknown characters) of the best path of one segment."""
        if self.single.issuperset(s) and self.unknown_piece not in s:
            return self._covered(s), 0
        n = len(s)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)       # tokens of the best path up to here
        opened = [-1] * (n + 1)     # where the path's unknown run that ends here began, -1: none
        lost = [0] * (n + 1)
        ending = iter(self.automaton.iter(s))
        match = next(ending, None)
        for end in range(n):
            top, size, unknown, single = None, 1, True, False
            while match is not None and match[0] == end:  # longest first, so by rising start
                length, score, is_unknown = match[1]
                match = next(ending, None)
                single |= length == 1
                value = best[end + 1 - length] + score
                if top is None or value > top:
                    top, size, unknown = value, length, is_unknown
            if not single:
                value = best[end] + self.unknown
                if top is None or value > top:
                    top, size, unknown = value, 1, True
            begin, here = end + 1 - size, end + 1
            best[here], lost[here] = top, lost[begin] + (size if unknown else 0)
            if unknown:
                opened[here] = opened[begin] if opened[begin] >= 0 else begin
                count[here] = count[opened[here]] + self._run(s[opened[here]:here])
            else:
                count[here] = count[begin] + 1
        return count[n], lost[n]

    def _one(self, segment: str) -> tuple[int, int]:
        got = self._viterbi(segment)
        if len(segment) <= 64:
            if len(self.memo) >= self.memo_size:
                self.memo.clear()
            self.memo[segment] = got
        return got

    def count(self, text: str | None) -> tuple[int, int]:
        """(tokens, unknown characters).  Spaces become word marks and one mark
        goes in front; null and empty texts have none."""
        if not text:
            return 0, 0
        marked = text.replace(" ", MARK)
        marked = marked if marked[0] == MARK else MARK + marked
        if self.segment is None:
            return self._viterbi(marked)
        tokens = lost = 0
        known = self.memo.get
        for piece in self.segment.findall(marked):
            got = known(piece) or self._one(piece)
            tokens += got[0]
            lost += got[1]
        return tokens, lost


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], unknown_id: int = 0) -> DataFrame:
    """(doc_id, tokens long, unknown_chars long) for each row of ``docs(doc_id, text)``.

    Whole texts of any length; null and empty texts count 0; repeated rows give
    repeated results; a null doc_id stays null; no rows give none.  The
    vocabulary (a fixed size) is broadcast; each worker process builds its
    automaton once, beside the broadcast value, and its memo table is bounded.  Scores must be such that their sums
    are exact (sentencepiece BPE ranks are whole numbers)."""
    shared = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = shared.value
            if "counter" not in here:
                here["counter"] = Counter(here["vocabulary"], unknown_id)
            counter = here["counter"]
            got = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()),
                 pa.array([g[1] for g in got], pa.int64())], ["doc_id", "tokens", "unknown_chars"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long, unknown_chars long")


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every whole document."""
    return token_counts(table(spark, sf_dir, "documents"), load_vocabulary(VOCABULARY))
