"""Token ids of documents in binary files, in ascending id order.

A file is a run of frames. A frame holds whole documents: a header of four 64-bit words
(magic, documents, blocks, words), each document's id and number of token ids, the
first word of each block, the packed words (see simple8b), a checksum, and an end mark
that is a word too, so all parts stay aligned. All numbers are little-endian. The upper
bit of a document's number of ids tells that the document has no id of its own.

Documents are dealt to tasks by ranges of their id and sorted there; each task turns
texts into ids, packs them and hands frames to Spark's text writer, whose line separator
is the end mark. Tasks commit their files like those of any table. A file's number and a
document's place in it give the order; only the sums of files are added up across tasks.

Null counts as an empty text, an empty text has the end id only. Rows without an id come
last. Rows that repeat an id stand in the order of their texts' digests; rows that
repeat a text as well cannot be told apart. An empty table gives no frame and an empty
result. Only id and text are read, whatever other columns are called. A frame closes when
it has FRAME_IDS ids, so a very long text makes its own frame longer.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gateflow.llm import simple8b
from gateflow.llm.running import sums_before
from gateflow.llm.tables import prepared, stored
from gateflow.llm.words import buffers, slices

#: Ids from which a frame is closed, frames a file, bytes of texts turned into ids at once.
FRAME_IDS = 1 << 19
FRAMES_A_FILE = 16
SLICE = 2 << 20
#: Fixed values of the file format.
MAGIC, END = b"S8BFRAME", "S8BENDF\n"
NO_ID = 1 << 63
#: Words that a worker remembers the ids of, and ids remembered in all, twice: when so
#: many are new, those before are kept for as long again and older ones forgotten.
KNOWN_WORDS, KNOWN_IDS = 400_000, 4_000_000


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _UPPER = _marks(b"\t\n\x0b\x0c\r "), _marks(bytes(range(0x41, 0x5B)))
_LETTER = _UPPER | _marks(bytes(range(0x61, 0x7B)))
#: Signs that never go with a letter before them; neither apostrophes nor signs of
#: special tokens are among them.
_STOP = _marks(b'.,;:!?()[]{}"#$%&*+-/=@\\^_`~')
#: Texts that a tokenizer of words takes as one word: Latin letters that stay letters in
#: lower case. _WORD_END is the fixed mark of tokens that end a word.
_ONE_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+")
_WORD_END = "</w>"
_OTHER = _marks(bytes([*range(0x80, 0x100), ord("<")]))


def _cuts(body: np.ndarray) -> np.ndarray:
    """Places of signs of _STOP that stand behind a letter; of Latin-1 letters, the
    second byte of which tells the two signs among them."""
    at = np.flatnonzero(_STOP[body[1:]]) + 1
    last, lead = body[at - 1], body[np.maximum(at - 2, 0)]
    latin = (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    return at[_LETTER[last] | latin]


class WordCoder:
    """Ids of texts by a tokenizer whose tokens never cross white space.

    Texts are cut at ASCII white space, and between a letter (ASCII or Latin-1) and a sign
    of _STOP, where the tokenizer parts them too. Each different piece is given to the tokenizer
    once and remembered. Pieces of ASCII alone are lower-cased first, as the tokenizer
    does itself; one with `<` may hold a special token and stays as it is.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith(_WORD_END)]] = True
        self._begin()
        self.past: tuple[dict[bytes, int], np.ndarray, np.ndarray] = {}, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _begin(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("Q", [0])

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words remembered, and where each word's begin and the last's end."""
        return np.array(self.ids, np.uint32), np.array(self.ends, np.uint64).astype(np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word among those remembered."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.past = self.known, *self._tables()
            self._begin()
            fresh = words
        fresh = self._recalled(fresh)
        texts = [w.decode() for w in fresh]
        one = [bool(_ONE_WORD.fullmatch(t)) for t in texts]
        self._remember([w for w, o in zip(fresh, one, strict=True) if o], self._together([t for t, o in zip(texts, one, strict=True) if o]))
        self._remember([w for w, o in zip(fresh, one, strict=True) if not o], self._apart([t for t, o in zip(texts, one, strict=True) if not o]))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _recalled(self, words: list[bytes]) -> list[bytes]:
        """Take over those words that are remembered from before; the others."""
        before, ids, ends = self.past
        known = [w for w in words if w in before]
        if not known:
            return words
        place = np.fromiter(map(before.__getitem__, known), np.int64, len(known))
        self._remember(known, _gathered(ids, ends[place], ends[place + 1] - ends[place]))
        return [w for w in words if w not in before]

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text)."""
        coded = [c.ids for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int64)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of letters: each is one word of the tokenizer, so its ids
        end with the one that ends a word."""
        if not texts:
            return self._apart(texts)
        coded = self.tokenizer.encode_batch_fast([" ".join(texts[i : i + 512]) for i in range(0, len(texts), 512)], add_special_tokens=False)
        ids = np.array([i for c in coded for i in c.ids], np.uint32)
        ends = np.flatnonzero(self.final[ids])
        if len(ends) != len(texts) or ends[-1] != len(ids) - 1:
            return self._apart(texts)
        return ids, np.diff(ends, prepend=-1)

    def _remember(self, words: list[bytes], coded: tuple[np.ndarray, np.ndarray]) -> None:
        ids, n = coded
        first = len(self.ends) - 1
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.ends.frombytes((len(self.ids) + np.cumsum(n)).astype(np.uint64).tobytes())
        self.ids.frombytes(ids.tobytes())

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of each text's ids)."""
        offsets, body = buffers(texts)
        inside = ~_SPACE[body]
        starts = inside.copy()
        if len(body):
            edge = np.zeros(len(body) + 1, bool)
            edge[offsets] = True
            starts[1:] &= ~inside[:-1] | edge[1:-1]
            starts[_cuts(body)] = True
        begin = np.flatnonzero(starts)
        counts = np.diff(np.searchsorted(begin, offsets))
        if not len(begin):
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        kept = body[inside]
        at = np.cumsum(inside, dtype=np.int32)[begin] - 1  # a slice is far below 2 GB
        sizes = np.diff(np.append(at, len(kept)))
        plain = ~np.logical_or.reduceat(_OTHER[kept], at)
        kept = kept + np.uint8(32) * (_UPPER[kept] & np.repeat(plain, sizes))
        bounds = np.append(at, len(kept)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        number = self.numbers(_listed(coded.dictionary))[coded.indices.to_numpy()]
        known, ends = self._tables()
        ids, n = _gathered(known, ends[number], ends[number + 1] - ends[number])
        total = np.append(0, np.cumsum(n))
        return ids.astype(np.uint64), np.diff(total[np.append(0, np.cumsum(counts))])


def _gathered(ids: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n ids from each place, one after another; and n."""
    ends = np.cumsum(n)
    return ids[np.repeat(low - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


def _listed(words: pa.Array) -> list[bytes]:
    """Values of a large binary array; cut out of its buffer, which is far quicker than
    by way of its scalars."""
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


_coders: dict[str, WordCoder] = {}


def _coder(content) -> WordCoder:
    """The worker's coder, from a broadcast of the tokenizer file."""
    if content.value not in _coders:
        _coders.clear()
        _coders[content.value] = WordCoder(content.value)
    return _coders[content.value]


def frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One frame without its end mark."""
    words, first = simple8b.pack(ids, lengths)
    own = np.array([0 if i is None else i for i in doc_ids], "<i8")
    sizes = lengths.astype("<u8") | np.array([NO_ID if i is None else 0 for i in doc_ids], "<u8")
    starts = np.zeros(-(-len(first) // 2) * 2, "<u4")
    starts[: len(first)] = first
    parts = [struct.pack("<8s3Q", MAGIC, len(doc_ids), len(first), len(words)), own, sizes, starts, words.astype("<u8")]
    body = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return body + struct.pack("<Q", zlib.crc32(body))


def frames(content: memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, lengths, token ids) of each frame of a file."""
    at, end = 0, END.encode()
    while at < len(content):
        magic, docs, blocks, words = struct.unpack_from("<8s3Q", content, at)
        sizes = [docs * 8, docs * 8, -(-blocks // 2) * 8, words * 8]
        stop = at + 32 + sum(sizes)
        if magic != MAGIC or bytes(content[stop + 8 : stop + 8 + len(end)]) != end:
            raise ValueError(f"no frame at byte {at}")
        if struct.unpack_from("<Q", content, stop)[0] != zlib.crc32(content[at:stop]):
            raise ValueError(f"the frame at byte {at} is damaged")
        bounds = at + 32 + np.append(0, np.cumsum(sizes))
        own, told, first, packed = (
            np.frombuffer(content[lo:hi], kind) for lo, hi, kind in zip(bounds, bounds[1:], ("<i8", "<u8", "<u4", "<u8"), strict=False)
        )
        lengths = (told & np.uint64(NO_ID - 1)).astype(np.int64)
        ids = simple8b.unpack(packed, first[:blocks].astype(np.int64), lengths)
        yield [None if t >> 63 else i for i, t in zip(own.tolist(), told.tolist(), strict=True)], lengths, ids
        at = stop + 8 + len(end)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None,
    doc_id: str = "doc_id",
    text: str = "text",
    coder: Callable = _coder,
) -> None:
    """Write the token ids of all documents below `path`, `end_id` after each."""
    spark = docs.sparkSession
    prepared(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # one tokenizer file, a few MB
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.col(text).alias("text"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
        F.monotonically_increasing_id().alias("row"),  # parts a run of equal rows over tasks
    )
    order = [F.col("id").asc_nulls_last(), "tie", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths, ids, held = [], [], [], 0
        one = lambda: pa.RecordBatch.from_arrays(
            [pa.array([frame(own, np.concatenate(lengths), np.concatenate(ids))], pa.binary())], names=["frame"]
        )
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE):
                coded, n = coder(content)(batch.column(1).slice(i, j - i))
                if end_id is not None:
                    coded, n = np.insert(coded, np.cumsum(n), end_id), n + 1
                own += batch.column(0).slice(i, j - i).to_pylist()
                lengths.append(n)
                ids.append(coded)
                held += len(coded) + len(n)
                if held >= FRAME_IDS:
                    yield one()
                    own, lengths, ids, held = [], [], [], 0
        if own:
            yield one()

    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    made = dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string"))
    made.write.option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", FRAMES_A_FILE).text(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(part, file, seq, before, doc_id, n_tokens, ids_crc32 and, if asked for, ids) per
    document: `before` counts the ids before it in its file, `ids` are packed as
    little-endian unsigned 32-bit integers, and ids_crc32 is the checksum of those."""
    fields = [("part", pa.int64()), ("file", pa.int64()), ("seq", pa.int64()), ("before", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    ddl = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, file, content in zip(*batch.columns, strict=True):
                seq = before = 0
                for own, lengths, ids in frames(memoryview(content.as_buffer())):
                    data, ends = memoryview(ids.astype("<u4")).cast("B"), np.append(0, np.cumsum(lengths))
                    each = [data[4 * a : 4 * b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                    n = len(own)
                    columns = [np.full(n, part.as_py()), np.full(n, file.as_py()), seq + np.arange(n), before + ends[:-1], pa.array(own, pa.int64()), lengths, [zlib.crc32(x) for x in each]]
                    columns += [[bytes(x) for x in each]] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
                    seq, before = seq + n, before + int(ends[-1])

    prepared(spark)
    name = F.element_at(F.split("path", "/"), -1)
    number = lambda pattern: F.regexp_extract(name, pattern, 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)").alias("file"), "content").mapInArrow(run, ddl)


def token_index(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of read_tokens: `start` counts
    the ids of all documents before it, over all files."""
    facts = stored(tokens.select("part", "file", "before", "doc_id", "n_tokens", "ids_crc32"), "token-facts")
    files = facts.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    parts = stored(sums_before(files, "file", "n", ["part"], "in_part"), "token-file-sums")
    totals = parts.groupBy("part").agg(F.sum("n").alias("n"))
    before = sums_before(totals, "part", "n", [], "of_part").select("part", "of_part")
    starts = parts.join(before, "part").select("part", "file", (F.col("in_part") + F.col("of_part")).alias("base"))
    return facts.join(starts, ["part", "file"]).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
