"""BPE encoding and decoding, by tree concatenation for long unsplit text.

Texts are cut at ASCII white space, which the tokenizer drops and never joins across; the encodings of the chunks are the
encoding of the text. Chunks are looked up in a bounded cache. A pre-token longer than LONG characters is cut into leaves;
the leaves are encoded in parallel by the library, then joined pairwise: a growing window of tokens around each join is
encoded again until its outermost tokens agree with both sides. Every pair of neighbours then stands in some encoding, which
for rank-ordered merges makes the whole sequence the encoding.

Null text counts as empty and gives no token; repeated rows give repeated results; an empty table gives an empty result. A very
long text is one row's work: its chunks are encoded one by one, and a long one without white space by leaves. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import ChainMap
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewing.llm.common import documents, small_batches, text_or_empty

VOCABULARY = "word_bpe_49k.json"
#: Letters of a pre-token beyond which the tree is used, and of a leaf; letters from which leaves are encoded in threads.
LONG, LEAF, THREADED = 12, 8, 1 << 16
#: Chunks that a worker remembers, and the longest of them.
CACHE, CACHED_BYTES = 600_000, 64
#: What the short way below is sound for: letters that lower one to one and never compose, then signs without an apostrophe
#: or a bracket, are two pre-tokens at most.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SIMPLE = re.compile("([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]{1,40})([.,;:!?*$%&#\"()-]{0,8})")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()
SCHEMA = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def join(left: list[int], right: list[int], text_of, encode, final: bool) -> list[int]:
    """The encoding of the two sides' text, from their own encodings. final: the text ends a word."""
    k = 4
    while True:
        a, b = left[-k:], right[:k]
        whole_a, whole_b = len(a) == len(left), len(b) == len(right)
        mid = encode("".join(map(text_of, a)) + "".join(map(text_of, b)), final and whole_b)
        if (whole_a or mid[0] == a[0]) and (whole_b or mid[-1] == b[-1]):
            return left[: len(left) - len(a)] + mid + right[len(b) :]
        k *= 2


class Codec:
    """Encodes and decodes as the library does with this file and add_special_tokens=False."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF):
        import json
        import os

        from tokenizers import Tokenizer, models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # its threads double the CPU time of small batches
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.long, self.leaf = long, leaf
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab, merges = model["vocab"], [tuple(x) for x in model["merges"]]
        self.inner = Tokenizer(models.BPE(vocab, merges))
        self.last = Tokenizer(models.BPE(vocab, merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.plain = spec["normalizer"] == NORMALIZER and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"]["Regex"] == PRE_TOKENS
        self.ids: dict[bytes, bytes] = {}
        self.texts: dict[bytes, bytes] = {}
        self.through_tree = 0  # letters of the pre-tokens that the tree has encoded

    def _text(self, i: int) -> str:
        t = self.token[i]
        return t[: -len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t

    def _piece(self, s: str, final: bool) -> list[int]:
        return (self.last if final else self.inner).encode(s, add_special_tokens=False).ids

    def tree(self, piece: str) -> list[int]:
        """Encoding of one long pre-token in the vocabulary's byte letters."""
        cuts = list(range(0, len(piece), self.leaf))
        leaves = [piece[i : i + self.leaf] for i in cuts]
        self.through_tree += len(piece)
        if len(piece) < THREADED:
            parts = [self._piece(x, False) for x in leaves[:-1]]
        else:
            with ThreadPoolExecutor(4) as pool:
                parts = [*pool.map(lambda x: self._piece(x, False), leaves[:-1])]
        parts.append(self._piece(leaves[-1], True))
        while len(parts) > 1:
            joined = [join(parts[i], parts[i + 1], self._text, self._piece, i + 2 == len(parts)) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0]

    def _long_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for raw in self._around_special(chunk):
            if raw in self.special:
                out.append(self.whole.token_to_id(raw))
                continue
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(raw)):
                out += self.tree(piece) if len(piece) > self.long else self._piece(piece, True)
        return out

    def _around_special(self, chunk: str) -> list[str]:
        return [x for x in re.split("(" + "|".join(map(re.escape, self.special)) + ")", chunk) if x] if self.special else [chunk]

    def chunk_ids(self, chunk: str) -> list[int]:
        if len(chunk) > self.long:
            return self._long_chunk(chunk)
        return self.whole.encode(chunk, add_special_tokens=False).ids

    def _learn(self, chunks: list[bytes]) -> tuple[dict[bytes, bytes], dict[bytes, bytes]]:
        """Encodings of new chunks, short ones into the cache, the others returned."""
        words = [c.decode("utf-8", "replace") for c in chunks]
        parts = [SIMPLE.fullmatch(w) if self.plain else None for w in words]
        # a word and the signs after it are two pre-tokens, which most chunks share with others
        plain = {x for m in parts if m for x in (m[1].lower(), m[2]) if x and x.encode() not in self.ids}
        plain = list(plain)
        mapped = [x if x.isascii() else "".join([_BYTE_LETTERS[b] for b in x.encode()]) for x in plain]
        whole = iter(self.last.encode_batch_fast([x for x in mapped if len(x) <= self.long], add_special_tokens=False))
        for x, letters in zip(plain, mapped, strict=True):
            self._keep(x.encode(), next(whole).ids if len(letters) <= self.long else self.tree(letters), self.ids, self.texts)
        other = [i for i, (m, w) in enumerate(zip(parts, words, strict=True)) if not m and len(w) <= self.long]
        found = dict(zip(other, (e.ids for e in self.whole.encode_batch_fast([words[i] for i in other], add_special_tokens=False)), strict=True))
        ids, texts = {}, {}
        for i, (c, m, w) in enumerate(zip(chunks, parts, words, strict=True)):
            if m:
                a, b = m[1].lower().encode(), m[2].encode()
                if c != a:
                    self.ids[c] = self.ids[a] + self.ids[b] if b else self.ids[a]
                    self.texts[c] = self.texts[a] + b" " + self.texts[b] if b else self.texts[a]
            else:
                kept = len(c) <= CACHED_BYTES
                self._keep(c, found[i] if i in found else self._long_chunk(w), self.ids if kept else ids, self.texts if kept else texts)
        return ids, texts

    def _keep(self, chunk: bytes, x: list[int], ids: dict, texts: dict) -> None:
        ids[chunk] = struct.pack(f"<{len(x)}I", *x)
        texts[chunk] = " ".join([self.token[i] for i in x]).encode()

    def encode_decode(self, text: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, the decoded text in UTF-8)."""
        chunks = text.split()  # at ASCII white space
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.texts.clear()
        ids, texts = self.ids, self.texts
        fresh = [c for c in set(chunks) if c not in ids]
        if fresh:
            more_ids, more_texts = self._learn(fresh)
            if more_ids:
                ids, texts = ChainMap(ids, more_ids), ChainMap(texts, more_texts)
        return b"".join([ids[c] for c in chunks]), b" ".join([x for c in chunks if (x := texts[c])])


_codecs: dict[str, Codec] = {}


def codec(path: str | None) -> Codec:
    path = path or vocabulary_path()
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """id, n_tokens, digests of ids and decoded text, and with with_ids the ids and the decoded text themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(vocabulary)
        for batch in batches:
            n, a, b, ids, texts = [], [], [], [], []
            for x in batch.column(1):
                raw, text = work.encode_decode(x.as_py())
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    ids.append(list(struct.unpack(f"<{len(raw) // 4}I", raw)))
                    texts.append(text.decode("utf-8", "replace"))
            cols = {"id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if with_ids:
                cols |= {"ids": pa.array(ids, pa.list_(pa.int64())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    out = rows.mapInArrow(run, SCHEMA + (", ids array<long>, decoded string" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


QUERIES = {"op7_bpe": op7_bpe}
ORACLE: dict[str, str] = {}
