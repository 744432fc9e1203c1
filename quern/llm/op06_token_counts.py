"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces in one walk along the text, and the
Viterbi recursion over ends carries the best score together with its number of pieces, so that
nothing is traced back. Ties are broken as the tokenizer breaks them: of several best ways to an
end, the one whose last piece begins first; a character without a piece of its own is unknown, at
ten below the least score, and loses ties to any piece. Neighbouring unknowns are one token, or
with byte fallback one token a byte.

Spaces become the mark U+2581, one is put before the text, and words are counted apart, as the
tokenizer's pre-tokenizer splits before each mark; counts of words met before are looked up. Null and the empty text count
0. A very long text is counted whole, word by word. Each row, repeated or not, is counted by itself; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import spread

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words in each of the two generations that a worker remembers, and the longest of them.
REMEMBERED, KEEP_CHARS = 400_000, 48


class Counter:
    """Counts for ``vocab``, (piece, score) by id, as the tokenizers library's Unigram model encodes."""

    def __init__(self, vocab: list[tuple[str, float]], unk_id: int, byte_fallback: bool = True):
        import ahocorasick

        self.pieces = {p for p, _ in vocab}
        self.unk_score = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.bytes_ok = byte_fallback and all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for i, (p, s) in enumerate(vocab):
            if p:
                self.automaton.add_word(p, (len(p), s, i == unk_id))
        self.automaton.make_automaton()
        # Sums of whole numbers are exact, so that a text may be cut at what no piece holds.
        self.cuttable = self.bytes_ok and all(float(s).is_integer() for _, s in vocab) and not any("\n" in p for p in self.pieces)
        self.new: tuple[dict, dict] = ({}, {})
        self.old: tuple[dict, dict] = ({}, {})

    def _unknown(self, run: str) -> int:
        return 1 if run in self.pieces or not self.bytes_ok else len(run.encode())

    def viterbi(self, text: str) -> int:
        """The number of tokens of ``text``, marks in place."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        #: Where the run of unknowns that ends here began, or -1; ``single``: characters with a piece.
        run, reached, single = [-1] * (n + 1), bytearray(n + 1), bytearray(n)
        reached[0] = 1
        at, ends = 0, self.automaton.iter(text)
        end, found = next(ends, (n, None))
        while at < n:
            best, pieces, opened, got = 0.0, 0, -1, False
            while end == at:  # longest first: those that begin earlier
                length, s, is_unk = found
                if length == 1:
                    single[at] = 1
                b = at + 1 - length
                if reached[b]:
                    c = s + score[b]
                    if not got or c > best:
                        best, got = c, True
                        if is_unk:
                            opened, pieces = (run[b] if run[b] >= 0 else b), count[b]
                        else:
                            opened, pieces = -1, count[b] + 1 + (self._unknown(text[run[b] : b]) if run[b] >= 0 else 0)
                end, found = next(ends, (n, None))
            if not single[at] and reached[at]:
                c = self.unk_score + score[at]
                if not got or c > best:
                    best, got, opened, pieces = c, True, (run[at] if run[at] >= 0 else at), count[at]
            at += 1
            score[at], count[at], run[at], reached[at] = best, pieces, opened, got
        return count[n] + (self._unknown(text[run[n] : n]) if run[n] >= 0 else 0)

    def _look(self, words: list[str], kind: int) -> int:
        """The sum of the words' counts; ``kind`` 1: without a mark before them."""
        new, old = self.new[kind], self.old[kind]
        got = list(map(new.get, words))
        if None in got:
            for i, c in enumerate(got):
                if c is None:
                    w = words[i]
                    if (c := new.get(w)) is None:
                        if (c := old.get(w)) is None:
                            c = self.viterbi(w if kind else MARK + w)
                        if len(w) <= KEEP_CHARS:
                            new[w] = c
                    got[i] = c
            if len(new) > REMEMBERED:
                self.old = tuple(self.new[k] if k == kind else self.old[k] for k in (0, 1))
                self.new = tuple({} if k == kind else self.new[k] for k in (0, 1))
        return sum(got)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0] and len(words) > 1:
            words = words[1:]  # the text's own mark stands first
        if not self.cuttable or "\n" not in text:
            return self._look(words, 0)
        plain, broken, breaks = [], [], 0
        for w in words:
            if "\n" in w:
                first, *rest = w.split("\n")
                plain.append(first)
                breaks += len(rest)
                broken += [r for r in rest if r]
            else:
                plain.append(w)
        return self._look(plain, 0) + (self._look(broken, 1) if broken else 0) + breaks


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) by id, and the id of the unknown piece, of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], sp.unk_id()


@cache
def counter(path: str) -> Counter:
    """One counter for all tasks of a worker."""
    return Counter(*vocabulary(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_chars and n_tokens of each row, under the pieces and scores of the model file."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = counter(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], names=[id_col, "n_chars", "n_tokens"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {id_type}, n_chars long, n_tokens long")
