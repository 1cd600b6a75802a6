"""Token counts of a unigram model, by dynamic programming along a trie.

The model's pieces come from a public vocabulary file; a piece's log probability is that of its rank under Zipf's law, shifted
by SHIFT ranks. A pre-token is a word (a run of other than ASCII white space) with the mark of a word's start before it; its
tokens are those of the most probable segmentation, of equally probable ones the shortest. Characters that no piece covers are
bytes of their own.

The distinct new pre-tokens of a batch form a trie, which is walked in sorted order so that only the current path is held. A
node's forward score and count follow from those of its ancestors by the pieces that end there; pre-tokens that share a prefix share its
nodes, and what a word's last node has is its count. Counts are remembered for the next batches, CACHE words at most.

Null text counts as empty and has no token; repeated rows give repeated results; an empty table gives an empty result; other
columns are not read. Memory is bounded by a batch, the cache and the longest word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import documents, small_batches, text_or_empty

VOCABULARY = "piece_bpe_32k.model"
SHIFT = 20
#: The mark of a word's start.
START = "▁"
#: What a byte of its own costs more than the rarest piece.
BYTE_PENALTY = 10.0
#: Words that a worker remembers, the longest of them, and bytes of text whose words form one trie.
CACHE, CACHED_BYTES, BLOCK = 1_000_000, 64, 32 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def zipf_scores(path: str) -> dict[str, float]:
    """Log probability of each piece, by its rank among the pieces proper."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / (r + SHIFT) for r in range(1, len(pieces) + 1)))
    return {x: -math.log(r + SHIFT) - norm for r, x in enumerate(pieces, 1)}


class Unigram:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        ends: dict[str, set[int]] = {}
        for x in scores:
            ends.setdefault(x[-2:], set()).add(len(x))
        #: Lengths of the pieces that end in these two characters (or are the one).
        self.lengths = {k: tuple(sorted(v)) for k, v in ends.items()}
        self.counts: dict[bytes, int] = {}

    def learn(self, words: list[bytes]) -> dict[bytes, int]:
        """Counts of the words, which are walked as a trie."""
        out: dict[bytes, int] = {}
        scores, lengths, byte = self.scores, self.lengths, self.byte
        path = START
        best, count = [0.0], [0]
        self._extend(path, 0, best, count)
        before = path
        for word in sorted(words):
            text = START + word.decode("utf-8", "replace")
            shared = len(before) if text.startswith(before) else _common(before, text)
            del best[shared + 1 :], count[shared + 1 :]
            for d in range(shared, len(text)):
                end = d + 1
                # the byte way
                c = text[d]
                size = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
                top, n = best[d] + size * byte, count[d] + size
                one = scores.get(c)
                if one is not None and (best[d] + one > top or best[d] + one == top and count[d] + 1 < n):
                    top, n = best[d] + one, count[d] + 1
                if d:
                    for k in lengths.get(text[d - 1 : end], ()):
                        if k > end:
                            break
                        s = scores.get(text[end - k : end])
                        if s is not None:
                            s += best[end - k]
                            if s > top or s == top and count[end - k] + 1 < n:
                                top, n = s, count[end - k] + 1
                best.append(top)
                count.append(n)
            out[word] = count[-1]
            before = text
        return out

    def _extend(self, text: str, d: int, best: list[float], count: list[int]) -> None:
        one, size = self.scores.get(text[d]), len(text[d].encode())
        best.append(one if one is not None else size * self.byte)
        count.append(1 if one is not None else size)

    def count_words(self, texts: list[list[bytes]]) -> list[int]:
        """Tokens of each text, given as words; the distinct new ones of all form one trie."""
        counts = self.counts
        if len(counts) > CACHE:
            counts.clear()
        fresh = {w for words in texts for w in words if w not in counts}
        found = self.learn(list(fresh)) if fresh else {}
        counts.update((w, n) for w, n in found.items() if len(w) <= CACHED_BYTES)
        long = {w: n for w, n in found.items() if len(w) > CACHED_BYTES}
        if long:
            return [sum([counts[w] if w in counts else long[w] for w in words]) for words in texts]
        return [sum([counts[w] for w in words]) for words in texts]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


_models: dict[str, Unigram] = {}


def unigram(path: str | None) -> Unigram:
    path = path or vocabulary_path()
    if path not in _models:
        _models[path] = Unigram(zipf_scores(path))
    return _models[path]


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id, n_pretokens and n_tokens of each row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(vocabulary)
        for batch in batches:
            tokens: list[int] = []
            words: list[int] = []
            block: list[list[bytes]] = []
            size = 0
            for x in batch.column(1):
                raw = x.as_py()
                block.append(raw.split())  # at ASCII white space
                size += len(raw)
                if size > BLOCK:
                    tokens += model.count_words(block)
                    words += map(len, block)
                    block, size = [], 0
            tokens += model.count_words(block)
            words += map(len, block)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_pretokens": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(documents(spark, sf_dir))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict[str, str] = {}
