"""Byte-pair encoding of a corpus with a public vocabulary (problem 7).

Each Arrow batch is cut into chunks that end at white space, chunks into the words of the
vocabulary's split pattern, and the batch's distinct words that are not known yet are merged by a
recursive query of an in-process DuckDB. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIR = os.environ.get("LINKWRIGHT_TOKENIZERS", "/opt/tokenizers")
DEFAULT_VOCABULARY = "byte_bpe_50k.json"

# White space as the split pattern knows it.
_WS = "\t-\r \x85\xa0  -     　"
# The split pattern of the byte-level vocabularies.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same on text that is ASCII, for the quicker engine.
_ASCII_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
#: A chunk is a run without white space and one blank before it, or white space. No word crosses chunks.
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")

#: Words of more bytes than this are merged with a heap: a recursive query takes a step for each merge.
LONG_WORD = 400
#: Words in one recursive query, known words kept by a worker.
WORDS_PER_QUERY, KEPT_WORDS = 20_000, 400_000

_MERGE_SQL = """
WITH RECURSIVE state(word, pos, tok, step) AS (
    SELECT word, pos, tok, 0 FROM start
  UNION ALL (
    WITH pairs AS (
        SELECT word, pos, tok, step, lead(tok) OVER w AS next_tok, lead(pos) OVER w AS next_pos
        FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS (
        SELECT p.word, p.pos, p.next_pos, m.rank, m.merged
        FROM pairs p JOIN merges m ON p.tok = m.left_tok AND p.next_tok = m.right_tok),
    best AS (
        SELECT word, arg_min(pos, (rank, pos)) AS pos, arg_min(next_pos, (rank, pos)) AS gone, arg_min(merged, (rank, pos)) AS merged
        FROM ranked GROUP BY word)
    SELECT p.word, p.pos, CASE WHEN p.pos = b.pos THEN b.merged ELSE p.tok END, p.step + 1
    FROM pairs p JOIN best b ON p.word = b.word WHERE p.pos <> b.gone))
SELECT word, list(tok ORDER BY pos) AS ids
FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM state) WHERE step = last GROUP BY word
"""


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes words of one vocabulary; made once in a worker process."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = [vocab[x] for x in _byte_letters()]
        sides = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(sides)))}
        self.words, self.ascii_words = regex.compile(_WORDS), re.compile(_ASCII_WORDS)
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.execute("SET preserve_insertion_order = false")
        keys = list(self.merges)
        table = pa.table({"left_tok": pa.array([a for a, _ in keys], pa.int32()), "right_tok": pa.array([b for _, b in keys], pa.int32()), "rank": pa.array([self.merges[k][0] for k in keys], pa.int32()), "merged": pa.array([self.merges[k][1] for k in keys], pa.int32())})
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")

    def _merge_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The ids of each word, by the recursive query."""
        number, pos, tok = [], [], []
        for i, w in enumerate(words):
            b = w.encode("utf-8", "surrogatepass")
            number += [i] * len(b)
            pos += range(len(b))
            tok += [self.byte_ids[x] for x in b]
        start = pa.table({"word": pa.array(number, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())})
        self.db.register("start", start)
        done = self.db.execute(_MERGE_SQL).fetchall()
        self.db.unregister("start")
        for i, ids in done:
            yield words[i], ids

    def _merge_long(self, word: str) -> list[int]:
        """The ids of one long word: pairs in a heap by rank and place, over a linked list."""
        tok: list = [self.byte_ids[x] for x in word.encode("utf-8", "surrogatepass")]
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((tok[i], tok[j]))):
                heapq.heappush(heap, (m[0], i, tok[i], tok[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            if tok[i] != a or (j := after[i]) >= n or tok[j] != b:
                continue
            tok[i], tok[j] = merged, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in tok if t is not None]

    def learn(self, words: set[str]) -> None:
        """Make ``known`` hold the ids of all these words, as bytes of 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        new = [w for w in words if w not in self.known]
        short = [w for w in new if len(w) <= LONG_WORD // 4]
        for w in new:
            if len(w) > LONG_WORD // 4:
                self.known[w] = pa.array(self._merge_long(w), pa.int32()).buffers()[1].to_pybytes()
        for i in range(0, len(short), WORDS_PER_QUERY):
            for w, ids in self._merge_words(short[i : i + WORDS_PER_QUERY]):
                self.known[w] = b"".join([x.to_bytes(4, "little") for x in ids])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit integers; null and empty texts give none."""
        cut = [_CHUNKS.findall(t) if t else [] for t in texts]
        chunks = {c for x in cut for c in x}
        split = {c: (self.ascii_words if c.isascii() else self.words).findall(c) for c in chunks}
        self.learn({w for x in split.values() for w in x})
        known = self.known
        ids = {c: known[x[0]] if len(x) == 1 else b"".join([known[w] for w in x]) for c, x in split.items()}
        return [b"".join([ids[c] for c in x]) for x in cut]


def _pieces(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters, to bound a batch's memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{DEFAULT_DIR}/{DEFAULT_VOCABULARY}") -> DataFrame:
    """``id_col, ids``: the token ids of each text, without special tokens.

    Special tokens' strings are ordinary text. Null and empty texts give an empty list. Any script,
    broken characters and any length are encoded byte for byte; extra columns are ignored; repeated
    ids give repeated rows. ``path`` is a byte-level vocabulary with merges, present on every
    executor.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                found = encoder.encode(texts[a:b])
                ends = [0]
                for x in found:
                    ends.append(ends[-1] + len(x) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [id_col, "ids"])

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str = "text", path: str = f"{DEFAULT_DIR}/{DEFAULT_VOCABULARY}") -> DataFrame:
    """The rows without their text and with ``n_tokens``, 0 for null and empty texts."""
    rest = [c for c in df.columns if c != text_col]
    if "n_tokens" in rest:
        raise ValueError("the column name n_tokens is taken")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts = [len(x) // 4 for a, b in _pieces(texts) for x in encoder.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64())], [*rest, "n_tokens"])

    return df.select(F.col(text_col).cast("string").alias(text_col), *rest).mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str = f"{DEFAULT_DIR}/{DEFAULT_VOCABULARY}") -> str:
    """The text of a list of ids, for round trips."""
    with open(path, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    byte = {x: i for i, x in enumerate(_byte_letters())}
    return bytes(byte[c] for i in ids for c in names[i]).decode("utf-8", "replace")
