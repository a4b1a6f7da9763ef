"""Token ids in binary files: Simple-8b words with escapes and offsets per block.

A word has 64 bits: a selector in the upper four, and as many ids as its row of
``LANES`` says, lowest bits first. An id too wide for any lane is escaped: its word has
selector 0 and the place of the id in a list of plain 64-bit values. Every ``BLOCK`` ids
begin a new word, and the first word of each block is written down, so a reader starts
at any block and unpacks all words of one selector at once.

Documents are written in the order of their ids. They are range-partitioned and sorted,
encoded where they arrive, and each task cuts its ids into chunks of whole documents.
Spark's own text sink writes the chunks, with an eight-byte mark in place of a line end,
so files reach any store that Spark writes to, and the attempts of a lost executor are
discarded as always. A chunk holds, as little-endian 64-bit words: ``HEAD``, the ids of
its documents, their lengths, which ids are null, the blocks' first words, the packed
words, the escaped ids. A chunk knows its task and how many ids of the task precede
it; where a task's ids begin follows from one total for each task.

Encoding: a byte-level tokenizer splits a text before it merges: always between words,
marks and single spaces or line ends. So the texts are cut there and every distinct
piece is encoded once by the tokenizer and remembered, up to ``MEMORY`` pieces in a
worker. Where a piece begins or ends in other white space, where the text spells one of
the tokenizer's added tokens, and for other kinds of tokenizers, the whole text goes to
the tokenizer. The ids are the same.

Defined cases: a null text is an empty one; an empty one has only the end id. A null id
comes first. Rows with equal ids are ordered by a hash of their text; equal rows are all
written. No documents give no chunks. Ids may be any unsigned 64-bit numbers; the
checksum of ``read_ids`` takes them as 32-bit ones and refuses larger.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slimlake.llm.common import bounded_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Ids per word and bits per id, by selector; selector 0 is the escape.
LANES = [
    (1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]

BLOCK = 1024
CHUNK = 1 << 16
CHUNKS_IN_FILE = 128
#: Ids packed at a time, so that a long document needs no more memory than its ids.
STEP = 256 * BLOCK
MEMORY = 1 << 19
#: Texts looked up together.
AT_ONCE = 300
#: New words given to the tokenizer as one text.
TOGETHER = 64
#: No word takes more ids.
SPARE = 120

MARK = "\nS8B-END\n"[:8]
MAGIC = int.from_bytes(b"S8B-IDS1", "little")
HEAD = ("magic", "task", "before", "documents", "ids", "words", "escapes", "checksum")

_COUNT = np.array([n for n, _ in LANES], dtype=np.int64)
_WIDEST = 1 << 60


def _classes(ids: np.ndarray) -> np.ndarray:
    """The highest selector, that is the fewest ids in a word, that each id needs; 16: escaped."""
    limits = np.array([(1 << w) - 1 for _, w in LANES[1:]], dtype=np.uint64)
    return (np.searchsorted(limits, ids, side="left") + 1).astype(np.uint8)


_SMALL = _classes(np.arange(1 << 16, dtype=np.uint64))


def _selectors(need: np.ndarray) -> np.ndarray:
    """For a word begun at each place of ``need``: the selector that takes the most ids."""
    chosen = np.where(need == 16, 0, 15).astype(np.uint8)
    # The largest class among the next n ids; what lies behind the end needs nothing.
    widest, reach = need.copy(), 1
    for selector in range(14, 0, -1):
        n = LANES[selector][0]
        for step in range(reach, n):
            np.maximum(widest[:-step], need[step:], out=widest[:-step])
        reach = n
        fits = widest <= selector
        if not fits.any():
            # A wider view only needs more, and the lanes only get narrower.
            break
        chosen[fits] = selector
    return chosen


def _in_rows(ids: np.ndarray) -> np.ndarray:
    """A row per block, with room for the spare lanes of its last word."""
    rows = np.zeros((-(-len(ids) // BLOCK), BLOCK + SPARE), dtype=np.uint64)
    whole = len(ids) // BLOCK
    rows[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < len(rows):
        rows[whole, : len(ids) - whole * BLOCK] = ids[whole * BLOCK :]
    return rows


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, the first word of each block and the escaped ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    words, firsts, escapes, n_words, n_escapes = [], [], [], 0, 0
    for low in range(0, len(ids), STEP):
        part = ids[low : low + STEP]
        rows = _in_rows(part)
        flat = rows.reshape(-1)
        need = _SMALL[flat.astype(np.intp)] if part.max() < len(_SMALL) else _classes(flat)
        selectors = _selectors(need)
        steps, starts, heads = _COUNT[selectors].astype(np.uint8).tobytes(), [], []
        for at in range(0, len(flat), rows.shape[1]):
            heads.append(len(starts))
            stop = at + min(BLOCK, len(part) - len(heads) * BLOCK + BLOCK)
            while at < stop:
                starts.append(at)
                at += steps[at]
        starts = np.array(starts, dtype=np.int64)
        chosen = selectors[starts]
        packed = chosen.astype(np.uint64) << np.uint64(60)
        for selector, (count, width) in enumerate(LANES):
            own = np.flatnonzero(chosen == selector)
            if not len(own) or not width:
                continue
            if selector == 0:
                packed[own] |= np.arange(len(own), dtype=np.uint64) + np.uint64(n_escapes)
                escapes.append(flat[starts[own]])
                n_escapes += len(own)
                continue
            at, word = starts[own], packed[own]
            for lane in range(count):
                word |= flat[at + lane] << np.uint64(lane * width)
            packed[own] = word
        firsts.append(np.array(heads) + n_words)
        words.append(packed)
        n_words += len(packed)
    none = np.zeros(0, dtype=np.uint64)
    join = lambda parts: np.concatenate(parts).astype(np.uint64) if parts else none
    return join(words), join(firsts), join(escapes)


def unpack(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """The ids from ``low`` to ``high`` of ``n``, from the blocks that hold them alone."""
    high = n if high is None else min(high, n)
    if low >= high:
        return np.zeros(0, dtype=np.uint64)
    first_block, last_block = low // BLOCK, (high - 1) // BLOCK
    begin = int(firsts[first_block])
    end = int(firsts[last_block + 1]) if last_block + 1 < len(firsts) else len(words)
    words = words[begin:end]
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    counts = _COUNT[selectors]
    before = np.cumsum(counts) - counts
    heads = firsts[first_block : last_block + 1].astype(np.int64) - begin
    rows = np.zeros((len(heads), BLOCK + SPARE), dtype=np.uint64)
    flat = rows.reshape(-1)
    shift = np.arange(len(heads)) * rows.shape[1] - before[heads]
    place = before + np.repeat(shift, np.diff(np.append(heads, len(words))))
    for selector in np.flatnonzero(np.bincount(selectors, minlength=16)):
        own = np.flatnonzero(selectors == selector)
        count, width = LANES[selector]
        if not width:
            continue
        at, word = place[own], words[own]
        if selector == 0:
            flat[at] = escapes[(word & np.uint64(_WIDEST - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << width) - 1)
        for lane in range(count):
            flat[at + lane] = (word >> np.uint64(lane * width)) & mask
    # Spare lanes of a block's last word lie behind its ids.
    ids = rows[:, :BLOCK].reshape(-1)
    return ids[low - first_block * BLOCK : high - first_block * BLOCK]


def to_chunk(task: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, firsts, escapes = pack(ids)
    body = b"".join(
        part.astype("<u8").tobytes()
        for part in (
            np.array([i or 0 for i in doc_ids], dtype=np.int64).view(np.uint64),
            np.array(lengths, dtype=np.uint64),
            np.array([i is None for i in doc_ids], dtype=np.uint64),
            firsts, words, escapes,
        )
    )
    head = [MAGIC, task, before, len(doc_ids), len(ids), len(words), len(escapes), zlib.crc32(body)]
    return np.array(head, dtype="<u8").tobytes() + body


class Chunk:
    """One chunk of a file, whose ids are unpacked when asked for."""

    def __init__(self, content: memoryview, at: int):
        size = 8 * len(HEAD)
        head = dict(zip(HEAD, np.frombuffer(content, "<u8", len(HEAD), at).tolist(), strict=True))
        if head["magic"] != MAGIC:
            raise ValueError("not a chunk of token ids")
        self.task, self.before, self.n_ids = head["task"], head["before"], head["ids"]
        docs, blocks = head["documents"], -(-self.n_ids // BLOCK)
        parts = np.cumsum([0, docs, docs, docs, blocks, head["words"], head["escapes"]]).tolist()
        self.end = at + size + 8 * parts[-1]
        if self.end > len(content) or zlib.crc32(content[at + size : self.end]) != head["checksum"]:
            raise ValueError("damaged chunk of token ids")
        values = np.frombuffer(content, "<u8", parts[-1], at + size)
        cut = [values[a:b] for a, b in zip(parts, parts[1:], strict=False)]
        self.doc_ids, self.lengths, self.is_null = cut[0].view(np.int64), cut[1].astype(np.int64), cut[2] > 0
        self.firsts, self.words, self.escapes = cut[3:]

    def ids(self, low: int = 0, high: int | None = None) -> np.ndarray:
        return unpack(self.words, self.firsts, self.escapes, self.n_ids, low, high)


def chunks(content: bytes) -> Iterator[Chunk]:
    """The chunks of a file."""
    at, view = 0, memoryview(content)
    while at < len(view):
        chunk = Chunk(view, at)
        yield chunk
        at = chunk.end + len(MARK)


_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What a byte-level tokenizer encodes on its own: a word, marks, a line end, what else
#: stands between white space, and white space.
_PIECES = re.compile(
    rf" ?[{_LETTER}]+(?=[\x00-&(-@\[-`{{-\x7f]|\Z)"
    rf"| ?[!-&(-/:-@\[-`{{-~]+(?=[\s0-9{_LETTER}]|\Z)"
    r"|\n(?=\S)| ?\S+|\s+(?!\S)|\s",
    re.ASCII,
)


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer splits as ``_PIECES`` relies on."""
    split = spec.get("pre_tokenizer") or {}
    return (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
    )


class TextEncoder:
    """The ids of texts, as the tokenizer gives them for the whole text."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.by_piece = _cuts_at_spaces(parsed)
        self.added = [token["content"] for token in parsed.get("added_tokens", [])]
        if self.by_piece:
            (self.line_end,) = self.whole("\n").tolist()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece, remembered or encoded; None where its text must stay whole."""
        # What has been asked for again since the last turnover stays for the next.
        if len(self.known) > MEMORY // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        found = {piece: known.get(piece) for piece in pieces}
        new = []
        for piece in [piece for piece, ids in found.items() if ids is None]:
            ids = before.get(piece)
            if ids is None:
                new.append(piece)
            else:
                found[piece] = known[piece] = ids
        words = [p for p in new if p[0] == " " and p.isprintable()]
        # Line ends come between these words and nowhere else, so they mark where one ends.
        lines = ["\n".join(words[k : k + TOGETHER]) + "\n" for k in range(0, len(words), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for line in encoded for i in line.ids], dtype=np.uint32)
        ends = np.flatnonzero(ids == self.line_end)
        if words and len(ends) != len(words):
            raise ValueError("the tokenizer does not keep line ends apart")
        content, begin = ids.tobytes(), 0
        for piece, end in zip(words, (4 * ends).tolist(), strict=False):
            found[piece] = content[begin:end]
            begin = end + 4
        others = [p for p in new if p[0] != " " or not p.isprintable()]
        for piece, one in zip(others, self.tokenizer.encode_batch(others, add_special_tokens=False), strict=True):
            bare = piece.strip(" \t\n\r\v\f")
            if not (bare and (bare[0].isspace() or bare[-1].isspace())):
                found[piece] = np.array(one.ids, dtype=np.uint32).tobytes()
        self.known.update((p, found[p]) for p in new if len(p) <= 64 and found[p] is not None)
        return found

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return [self.whole(text) for text in texts]
        out = []
        for at in range(0, len(texts), AT_ONCE):
            out += self._some(texts[at : at + AT_ONCE])
        return out

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        cut = [_PIECES.findall(text) for text in texts]
        found = self._learn(set().union(*cut))
        out = []
        for text, pieces in zip(texts, cut, strict=True):
            parts = list(map(found.__getitem__, pieces))
            if None in parts or any(token in text for token in self.added):
                out.append(self.whole(text))
            else:
                out.append(np.frombuffer(b"".join(parts), dtype=np.uint32))
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(spec: str) -> TextEncoder:
    """Built once per Python worker."""
    if spec not in _ENCODERS:
        _ENCODERS[spec] = TextEncoder(spec)
    return _ENCODERS[spec]


def _chunker(spec, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(spec.value), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        before, held, doc_ids, lengths, parts = 0, 0, [], [], []

        def chunk():
            made = to_chunk(task, before, doc_ids, lengths, np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array([made], type=pa.binary())], ["chunk"])

        for batch in batches:
            texts = encode([text or "" for text in batch.column(1).to_pylist()])
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
                if held >= CHUNK:
                    yield chunk()
                    before, held, doc_ids, lengths, parts = before + held, 0, [], [], []
        if doc_ids:
            yield chunk()

    return write


def write_ids(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = 0) -> None:
    """Write the ids of every text, each followed by ``end_id``, in the order of doc_id.

    The tokenizer's file is read on the driver and broadcast, some megabytes whatever
    the input.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    with open(tokenizer, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    # Equal rows differ in the last key alone, so they do not all meet in one task.
    order = ["doc_id", "__hash", "__row"]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__hash"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = rows.mapInArrow(_chunker(spec, end_id), "chunk binary")
    writer = made.select(F.col("chunk").cast("string").alias("value")).write
    writer.option("lineSep", MARK).option("maxRecordsPerFile", CHUNKS_IN_FILE).text(path)


_FORMS = {"ids": pa.list_(pa.int64()), "crc32": pa.int64()}


def _parser(form: str):
    kind = _FORMS[form]

    def documents(chunk: Chunk) -> pa.RecordBatch:
        ids = chunk.ids()
        if form == "crc32":
            if len(ids) and ids.max() >= 1 << 32:
                raise OverflowError("an id has more than 32 bits")
            ids = ids.astype("<u4")
        ends = np.cumsum(chunk.lengths)
        if form == "ids":
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            value = pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int64)))
        else:
            bounds = zip(ends - chunk.lengths, ends, strict=True)
            value = pa.array([zlib.crc32(ids[a:b]) for a, b in bounds], type=kind)
        n = len(ends)
        columns = [
            pa.array(chunk.doc_ids, mask=chunk.is_null), pa.array(np.full(n, chunk.task)),
            pa.array(chunk.before + ends - chunk.lengths), pa.array(chunk.lengths), value,
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "task", "before", "n_tokens", form])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from map(documents, chunks(content.as_py()))

    return parse


def read_ids(spark: SparkSession, path: str, form: str = "ids") -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the ids of each document.

    ``form`` is ``ids`` for an array or ``crc32`` for the unsigned checksum of the ids
    as little-endian 32-bit numbers. The files are read once more, without unpacking, for
    the number of ids of each task; of those there is one row per task that wrote.
    """
    bounded_batches(spark)
    # One file in a batch, as each has some megabytes.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    column = {"ids": "ids array<long>", "crc32": "crc32 long"}[form]
    rows = files.mapInArrow(_parser(form), f"doc_id long, task long, before long, n_tokens long, {column}")
    totals = files.mapInArrow(_sizes, "task long, n long").groupBy("task").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    start = (F.col("offset") + F.col("before")).alias("start")
    return rows.join(F.broadcast(offsets), "task").select("doc_id", start, "n_tokens", form)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            found = [(c.task, c.n_ids) for c in chunks(content.as_py())]
            columns = [pa.array([x[k] for x in found], type=pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["task", "n"])
