"""Token counts by a count-only Viterbi: Aho-Corasick lists the vocabulary's matches, a DP carries score and number of pieces."""

from __future__ import annotations

import math
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltloom.llm.common import map_rows

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"


def unigram_vocabulary(path: str = VOCABULARY) -> tuple[tuple[str, float], ...]:
    """(piece, log probability) of a public vocabulary file: its pieces in file order, with Zipf scores; piece 0 is the unknown one.

    The file gives merge ranks; minus the logarithm of the rank stands for the log probability that a unigram model needs.
    Control and byte pieces are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return (("<unk>", -20.0), *((p, -math.log(2 + i)) for i, p in enumerate(pieces)))


class Counter(dict):
    """Pieces (and unknown ones) of a word, kept for the next time; cleared at ``most`` words to bound memory."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...], most: int = 300_000):
        super().__init__()
        self.most = most
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            self.matches.add_word(piece, (len(piece), score, i == 0))
        self.matches.make_automaton()

    def count(self, text: str) -> tuple[int, int]:
        """Number of pieces and of unknown pieces on the best path.

        Tie rule: for each end, starts are tried in ascending order and only a higher score replaces the best one, so the longest of equal
        candidates stays. A character that is no piece is unknown; neighbouring unknown pieces count as one.
        """
        ends: list[list] = [[] for _ in range(len(text) + 1)]
        for end, match in self.matches.iter(text):
            ends[end + 1].append(match)
        best, pieces, unknown, is_unknown = [0.0] * (len(text) + 1), [0] * (len(text) + 1), [0] * (len(text) + 1), [False] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            top, start, unk = None, 0, False
            single = False
            for length, score, own in ends[end]:  # longest first
                single |= length == 1
                x = score + best[end - length]
                if top is None or x > top:
                    top, start, unk = x, end - length, own
            if not single:
                x = self.unknown + best[end - 1]
                if top is None or x > top:
                    top, start, unk = x, end - 1, True
            new = not (unk and is_unknown[start])
            best[end], pieces[end], unknown[end], is_unknown[end] = top, pieces[start] + new, unknown[start] + (unk and new), unk
        return pieces[-1], unknown[-1]

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = self.count(SPACE + word.decode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _counter(vocabulary: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, path: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's (doc_id, n_words, n_tokens, n_unknown) under a unigram vocabulary.

    Words are ``[^\\x20\\x09-\\x0D]+``, each led by the space mark and segmented on its own, whole texts at any length. The vocabulary (one file, about
    32,000 pieces) is read on the driver and goes to the tasks. A null or empty text counts 0; nothing is shuffled.
    """
    vocabulary = unigram_vocabulary(path)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> dict:
        counter = _counter(held.value)
        words, tokens, unknown = [], [], []
        for t in batch.column("text").to_pylist():
            found = [counter[w] for w in t.split()] if t else []
            words.append(len(found))
            tokens.append(sum(n for n, _ in found))
            unknown.append(sum(u for _, u in found))
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_tokens": tokens, "n_unknown": unknown}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_rows(rows, "text", f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long", run)


def op5_count_only_viterbi(spark, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
