"""Token counts of a unigram tokenizer, without its tokens.

An Aho-Corasick automaton lists every piece of the vocabulary in a word; a Viterbi pass over the word's positions
carries the best score and the number of pieces on that best path, and nothing else. Ties are settled as the
tokenizers library does: a path is replaced only by a strictly better one, and starts are tried from left to right,
so of equal scores at one end the piece that begins first wins. A character that no piece covers scores the lowest
score less 10; it counts as many pieces as it has UTF-8 bytes if the vocabulary has all byte pieces, else a run of
such characters counts once.

The vocabulary is that of a public SentencePiece file: its pieces and scores, read as a unigram model. Words are
runs without (Unicode) white space, each with U+2581 before it.

Defined cases: a null or empty text, or one of white space only, has 0 tokens; repeated rows each get their result.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import WordCache

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile("[^\t-\r \x85\xa0  -     　]+")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) in order of id. Control pieces can't be matched by text but keep their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cache = WordCache(lambda w: self.count("▁" + w))

    def count(self, word: str) -> int:
        n = len(word)
        score, pieces, known = [0.0] * (n + 1), [0] * (n + 1), [True] * (n + 1)

        def unknown(first: int, last: int) -> None:
            """Takes the character before each end as an unknown one, if nothing better leads there."""
            for e in range(first, last + 1):
                s = score[e - 1] + self.unknown
                if e in reached and score[e] >= s:
                    continue
                score[e], known[e] = s, False
                pieces[e] = pieces[e - 1] + (len(word[e - 1].encode()) if self.by_bytes else e == 1 or known[e - 1])

        end, single, reached = 0, True, set()
        for last, (size, value) in self.automaton.iter(word):  # of one end, the longest first: starts from left to right
            if last + 1 != end:
                if not single:
                    unknown(end, end)
                unknown(end + 1, last)
                end, single = last + 1, False
                best = None
            s = score[end - size] + value
            if best is None or s > best:
                best = score[end] = s
                pieces[end] = pieces[end - size] + 1
                reached.add(end)
            if size == 1:
                single = True
        if not single:
            unknown(end, end)
        unknown(end + 1, n)
        return pieces[n]

    def count_text(self, text: str | None) -> int:
        return sum(map(self.cache.__getitem__, _WORDS.findall(text))) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(text: Column, path: str | None = None) -> Column:
    """bigint: the tokens of each text. path: the SentencePiece file on the executors; None finds the installed one."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from threadloom.llm.bpe import tokenizer_path

        c = counter(path or tokenizer_path(VOCABULARY))
        for a in arrays:
            yield pa.array([c.count_text(t.as_py()) for t in a], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))
