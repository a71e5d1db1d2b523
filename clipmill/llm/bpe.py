"""BPE over a distinct-word table: split in the tasks, encode every distinct word once, put the ids back by position, decode by a join with the vocabulary.

1. ``split``: each task cuts its texts into the tokenizer's words and numbers them in blocks of at most 2^18 distinct words
   (most frequent first). One pass writes, bucketed by block, the number sequences of the documents and the words of the block.
2. ``encode_words``: the (block, number, word) rows meet by word, so each distinct word is encoded once whatever the
   number of its occurrences; its ids go back to the blocks. A word that fills a third of the corpus is one row per block here.
3. ``assemble``: the bucketed number sequences (not shuffled again) are co-grouped with their block's ids, and positions
   become ids. A block bounds what one task holds.
4. Decoding looks every id up in the (id, piece) table, which has as many rows as the tokenizer (a fixed bound, so it is sent to the tasks).

Special tokens in a text are words of their own, as the tokenizer treats them. Null and empty texts have no ids. Repeated rows are
documents of their own; a null id passes through. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipmill.llm.tables import bucketed

BLOCK_WORDS, BLOCK_TOKENS, ROW_TOKENS = 1 << 18, 1 << 23, 1 << 20
#: Letters and white space among the characters that ``OTHER`` lets through, written out: such classes match faster than negated ones.
LETTER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "\t-\r \xa0"
# Fixed values of the tokenizer file: its pattern for lower-case text and its special tokens.
WORD = re.compile(rf"[{LETTER}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACE}{LETTER}0-9]+")
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Texts with characters outside Latin letters, or with the few whose class differs between libraries, are cut by the tokenizer itself.
OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """The byte behind each character of byte-level pieces: printable ones stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_text(text: str, path: str) -> list[str]:
    """The words of a text in order; encoding them one by one gives the ids of the whole."""
    parts = SPECIAL.split(text) if "<|" in text else [text]
    out: list[str] = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(part)
        elif OTHER.search(part) is None:
            out += WORD.findall(part.lower())
        elif part:
            tok, byte = tokenizer(path), _byte_of()
            pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))
            out += [bytes(byte[c] for c in piece).decode() for piece, _ in pieces]
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Block:
    """Words seen so far in a block, and the documents cut with them."""

    def __init__(self, number: int):
        self.number, self.of, self.ids, self.docs, self.tokens = number, {}, [], [], 0

    def add(self, doc_id, words: list[str]) -> None:
        of = self.of
        row = np.fromiter((of.setdefault(w, len(of)) for w in words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.docs.append(row)
        self.tokens += len(row)

    def full(self) -> bool:
        return len(self.of) >= BLOCK_WORDS or self.tokens >= BLOCK_TOKENS

    def rows(self, id_type: pa.DataType):
        """Document rows of about ``ROW_TOKENS`` numbers, then the words."""
        every = np.concatenate(self.docs)
        order = np.argsort(-np.bincount(every, minlength=len(self.of)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        at, k = 0, 0
        while k < len(self.docs):
            size, first = 0, k
            while k < len(self.docs) and (size == 0 or size + len(self.docs[k]) <= ROW_TOKENS):
                size += len(self.docs[k])
                k += 1
            lens = pa.array([[len(d) for d in self.docs[first:k]]], pa.list_(pa.int32()))
            yield _row(1, block=[self.number], ids=pa.array([self.ids[first:k]], pa.list_(id_type)), lens=lens, numbers=pa.array([pack(rank[every[at:at + size]])], pa.binary()), id_type=id_type)
            at += size
        words = list(self.of)
        for start in range(0, len(words), 50_000):
            some = words[start:start + 50_000]
            yield _row(len(some), block=[self.number] * len(some), word=pa.array(some), number=pa.array(rank[start:start + 50_000].astype(np.int32)), id_type=id_type)


def _row(n: int, id_type, block, ids=None, lens=None, numbers=None, word=None, number=None) -> pa.RecordBatch:
    none = lambda value, kind: pa.nulls(n, kind) if value is None else value
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), none(ids, pa.list_(id_type)), none(lens, pa.list_(pa.int32())), none(numbers, pa.binary()), none(word, pa.string()), none(number, pa.int32())],
        names=["block", "ids", "lens", "numbers", "word", "number"])


def split(docs: DataFrame, path: str) -> DataFrame:
    """Document rows (block, ids, lens, numbers) and word rows (block, number, word) of ``docs`` (doc_id, text), bucketed by block."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        part, k, block = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if block is None:
                        block = _Block((part << 24) + k)
                        k += 1
                    block.add(doc_id, split_text(text or "", path))
                    if block.full():
                        yield from block.rows(id_type)
                        block = None
        if block is not None:
            yield from block.rows(id_type)

    rows = docs.mapInArrow(run, f"block long, ids array<{kind}>, lens array<int>, numbers binary, word string, number int")
    return bucketed(rows, "block", "bpe_split")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(block, numbers, sizes, ids) from (block, number, word): every distinct word is encoded once, where all its rows meet."""

    def run(batches):
        tok, last, ids = tokenizer(path), None, b""
        blocks: dict[int, list] = {}
        held = 0

        def flush():
            rows = [(b, pack(np.array(n)), pack(np.array(s)), pack(np.frombuffer(b"".join(i), "<u4"))) for b, (n, s, i) in blocks.items()]
            blocks.clear()
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "numbers", "sizes", "ids"])

        for batch in batches:
            column = batch.column(2).to_pylist()
            fresh = [w for w, before in zip(column, [last, *column]) if w != before]
            found = iter([np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(fresh, add_special_tokens=False)])
            for block, number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), column):
                if word != last:
                    last, ids = word, next(found)
                n, s, i = blocks.setdefault(block, ([], [], []))
                n.append(number)
                s.append(len(ids) // 4)
                i.append(ids)
            held += len(column)
            if held >= 400_000:
                yield flush()
                held = 0
        if blocks:
            yield flush()

    met = words.repartition("word").sortWithinPartitions("word")
    return met.mapInArrow(run, "block long, numbers binary, sizes binary, ids binary")


def vocabulary(spark, path: str) -> DataFrame:
    """(id, piece) of a tokenizer file, special tokens included."""
    tok = tokenizer(path)
    return spark.createDataFrame(sorted((i, p) for p, i in tok.get_vocab(with_added_tokens=True).items()), "id int, piece string")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by spaces), decoded_sha256, and ids if asked for."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    cut = split(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path)
    coded = encode_words(cut.filter("word is not null").select("block", "number", "word"), path)
    pieces = [r.piece for r in vocabulary(spark, path).orderBy("id").collect()]  # as many rows as the tokenizer has
    sent = spark.sparkContext.broadcast(pieces)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return out_schema.empty_table()
        join = lambda name: np.concatenate([unpack(x) for x in right.column(name).to_pylist()] or [np.zeros(0, "<u4")])
        numbers, sizes, ids = join("numbers"), join("sizes"), join("ids")
        start = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        at = np.empty(len(numbers), np.int64)
        at[numbers] = np.arange(len(numbers))
        piece_of = np.array(sent.value, dtype=object)
        text_of = np.array([str(i) for i in range(len(piece_of))], dtype=object)
        split_ids = [ids[start[k]:start[k + 1]] for k in at.tolist()]
        id_text = np.array([" ".join(text_of[w].tolist()) for w in split_ids], dtype=object)
        decoded = np.array([" ".join(piece_of[w].tolist()) for w in split_ids], dtype=object)
        count = sizes[at].astype(np.int64)
        out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
        for row in range(left.num_rows):
            seq = unpack(left.column("numbers")[row].as_py())
            pos = 0
            for doc_id, size in zip(left.column("ids")[row].as_py(), left.column("lens")[row].as_py()):
                own = seq[pos:pos + size]
                pos += size
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(int(count[own].sum()))
                out["ids_sha256"].append(hashlib.sha256(" ".join(id_text[own].tolist()).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(" ".join(decoded[own].tolist()).encode()).hexdigest())
                if with_ids:
                    n = count[own]
                    first = start[at[own]] - (np.cumsum(n) - n)
                    out["ids"].append(ids[np.repeat(first, n) + np.arange(n.sum())].astype(np.int32))
        if not with_ids:
            del out["ids"]
        return pa.table(out, schema=out_schema)

    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(docs.schema[id_col].dataType)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    out_schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    sequences = cut.filter("numbers is not null").select("block", "ids", "lens", "numbers")
    return sequences.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(assemble, schema)
