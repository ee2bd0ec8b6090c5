"""Operator 8: byte-level BPE encoding and decoding.

Whole texts are encoded, an Arrow batch at a time: parted into pretokens by numpy, then each distinct pretoken by the tokenizers library,
once in a worker, and its ids put wherever it stands. A token stands for some bytes of the UTF-8 text, so
the running sum of the tokens' byte lengths gives byte offsets; a count of the bytes that begin a character maps these to
character offsets. A character that is split over tokens belongs to the span of each of them. Decoding looks every token's bytes up in
the reversed byte table and joins them before UTF-8 is read, so split characters come back whole.

Rows: a null text gives null ids, offsets and text; an empty text gives empty arrays and decodes to an empty text. Strings of special
tokens are ordinary text. Decoding ids of a sequence cut inside a character gives U+FFFD for the incomplete part; an id outside the
vocabulary is an error. Repeated rows are encoded alike. Further columns stay as they are; an added column whose name is taken gets one with a "_" behind it.
A vocabulary whose pre-tokenizer isn't the byte-level one without a prefix blank, or that has a normalizer, is an error: its ids would differ.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, map_rows, unused

#: Vocabulary file, a parameter of each function. It is sent to the executors from the driver's machine.
VOCABULARY = os.environ.get("BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")
#: Bytes of text given to the tokenizer at once.
STEP = 1 << 20
_loaded: dict[str, tuple] = {}


def byte_of_character() -> dict[str, int]:
    """The reversed byte table: printable bytes stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(path: str) -> None:
    """Raise if the vocabulary parts texts otherwise than PRETOKEN does."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    way = held.get("pre_tokenizer") or {}
    if held["model"]["type"] != "BPE" or held.get("normalizer") or way.get("type") != "ByteLevel" or way.get("add_prefix_space") or not way.get("use_regex", True):
        raise ValueError(f"{path}: not a byte-level BPE vocabulary with the usual pre-tokenizer and no normalizer")


def _sent(docs: DataFrame, path: str) -> str:
    """Send the vocabulary to all executors; the path by which workers ask for it."""
    check(path)
    docs.sparkSession.sparkContext.addFile(path)
    return path


def _load(path: str):
    """Tokenizer, all tokens' bytes in one array, and where each token's bytes begin; once in a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        where = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        check(where)
        t = Tokenizer.from_file(where)
        t.encode_special_tokens = True
        table, special = byte_of_character(), {i: a.content for i, a in t.get_added_tokens_decoder().items()}
        words = [special[i].encode() if i in special else bytes(table[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())]
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        _loaded[path] = t, np.frombuffer(b"".join(words), np.uint8), at
    return _loaded[path]


class _Words:
    """Ids and spans of the pretokens met so far in this worker, each encoded once by the library; emptied when large."""

    def __init__(self, path: str, most: int = 250_000) -> None:
        self.path, self.most = path, most
        self.index: defaultdict[str, int] = defaultdict(itertools.count().__next__)  # a new word gets the next number
        self.at, self.chars = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.ids, self.first, self.last = (np.zeros(0, np.int32) for _ in range(3))

    def look_up(self, words: list[str]) -> np.ndarray:
        """The number of each of the words, which differ."""
        if max(len(self.index), len(self.ids) // 8) > self.most:
            self.__init__(self.path, self.most)
        k = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = [words[i] for i in np.flatnonzero(k >= len(self.chars))]
        if new:
            t, _, at = _load(self.path)
            made = [e.ids for e in t.encode_batch_fast(new, add_special_tokens=False)]
            rows = np.concatenate([[0], np.cumsum([len(x) for x in made])])
            ids = np.fromiter(itertools.chain.from_iterable(made), np.int32, rows[-1])
            first, last = _spans(at[ids + 1] - at[ids], np.frombuffer("".join(new).encode(), np.uint8), rows)
            self.at = np.concatenate([self.at, self.at[-1] + rows[1:]])
            self.chars = np.concatenate([self.chars, [len(w) for w in new]])
            self.ids, self.first, self.last = (np.concatenate(x) for x in ((self.ids, ids), (self.first, first), (self.last, last)))
        return k


def _spans(length: np.ndarray, body: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token's span and the one after the last, counted in its row; length is in bytes, rows has where each row's tokens begin."""
    ends = np.cumsum(length)
    begins = ends - length
    heads = (body & 0xC0) != 0x80
    before = np.zeros(len(body) + 1, np.int32)  # characters that begin before each byte
    np.cumsum(heads, out=before[1:])
    inside = ~np.append(heads, True)[begins]
    first = np.repeat(before[np.append(begins, len(body))[rows[:-1]]], np.diff(rows))
    return before[begins] - inside - first, before[ends] - first


#: How the vocabulary's pre-tokenizer parts a text; a pretoken given alone isn't parted further, so its ids are the same there.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_words: dict[str, _Words] = {}


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of every code point in PRETOKEN."""
    chars, kinds = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, runs in ((_BLANK, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(runs, chars):
            kinds[m.start() : m.end()] = kind
    return kinds


def _kind_of_bytes(body: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of UTF-8 belongs to."""
    out = _kinds()[:256][body]
    lead = np.flatnonzero(body >= 0xC0)
    if len(lead):
        head = body[lead].astype(np.int32)
        more = 1 + (head >= 0xE0) + (head >= 0xF0)  # bytes behind the first
        code, behind = head & (0x3F >> more), [np.flatnonzero(more >= i) for i in (1, 2, 3)]
        for i, x in enumerate(behind, 1):
            code[x] = code[x] << 6 | body[lead[x] + i] & 0x3F
        kind = _kinds()[code]
        out[lead] = kind
        for i, x in enumerate(behind, 1):
            out[lead[x] + i] = kind[x]
    return out


def pretokens(body: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where PRETOKEN's matches begin in texts of UTF-8, whose bytes are body[rows[i]:rows[i + 1]].

    A pretoken is a run of one kind, but for three cases: the last character of blanks before something else stands alone or, if it is
    " ", belongs to what follows; an apostrophe that begins a pretoken takes the letters of a contraction; a run ends with its text."""
    n = len(body)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kind_of_bytes(body)
    edge, starts = np.zeros(n + 1, bool), np.ones(n + 1, bool)
    edge[rows] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:n])
    starts |= edge
    runs = np.flatnonzero(starts)
    begins, ends = runs[:-1], runs[1:]
    end = ends[(kind[begins] == _BLANK) & ~edge[ends]]
    last = end - 1
    for _ in range(2):  # no blank has more than three bytes
        last = last - ((body[last] & 0xC0) == 0x80)
    starts[last] = True
    starts[end[body[last] == ord(" ")]] = False
    one = begins[(body[begins] == ord("'")) & (ends - begins == 1) & ~edge[ends]]
    one = one[starts[one]] + 1
    two = np.where(edge[one + 1], 0, body[np.minimum(one + 1, n - 1)])
    short = np.isin(body[one], np.frombuffer(b"stmd", np.uint8))
    long = ((body[one] == ord("r")) | (body[one] == ord("v"))) & (two == ord("e")) | (body[one] == ord("l")) & (two == ord("l"))
    starts[one[short | long]] = False
    starts[one[short] + 1] = True
    starts[one[long] + 2] = True
    return np.flatnonzero(starts[:n])


def encode_texts(texts: list[str], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, for each id the first character of its span and the one after the last, and where each text's ids begin."""
    raw = [t.encode() for t in texts]
    data, bounds = b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    starts = pretokens(np.frombuffer(data, np.uint8), bounds)
    offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    parts = pa.Array.from_buffers(pa.string(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    known = _words.setdefault(path, _Words(path))
    k = known.look_up(parts.dictionary.to_numpy(zero_copy_only=False).tolist())[parts.indices.to_numpy()]
    of = np.searchsorted(starts, bounds)  # where each text's pretokens begin
    size, chars = known.at[k + 1] - known.at[k], known.chars[k]
    ends, place = np.concatenate([[0], np.cumsum(size)]), np.concatenate([[0], np.cumsum(chars)])
    place = (place[:-1] - np.repeat(place[of[:-1]], np.diff(of))).astype(np.int32)
    at = np.repeat(known.at[k] - ends[:-1], size)
    at += np.arange(ends[-1])
    place = np.repeat(place, size)
    return known.ids[at], known.first[at] + place, known.last[at] + place, ends[of]


def decode_ids(ids: np.ndarray, at_rows: np.ndarray, path: str = VOCABULARY) -> list[str]:
    """The texts of the id runs ids[at_rows[i]:at_rows[i + 1]]."""
    _, body, at = _load(path)
    if len(ids) and (ids.min() < 0 or ids.max() >= len(at) - 1):
        raise ValueError("an id is outside the vocabulary")
    size = at[ids + 1] - at[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = body[np.repeat(at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
    cut = ends[at_rows]
    return [flat[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:])]


def _lists(values: np.ndarray, rows: np.ndarray, null: np.ndarray) -> pa.Array:
    """Lists values[rows[i]:rows[i + 1]] for the rows that aren't null."""
    sizes = np.zeros(len(null), np.int64)
    sizes[~null] = np.diff(rows)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(values.astype(np.int32)))


def _encoded(part: list[str | None], path: str) -> tuple[list[pa.Array], list[str], np.ndarray, np.ndarray, np.ndarray]:
    some, null = [t for t in part if t is not None], np.array([t is None for t in part])
    ids, first, last, rows = encode_texts(some, path)
    return [_lists(x, rows, null) for x in (ids, first, last)], some, ids, rows, null


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    i = total = 0
    for j, s in enumerate(sizes):
        if total and total + s > STEP:
            yield i, j
            i, total = j, 0
        total += s
    if i < len(sizes):
        yield i, len(sizes)


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ids, starts and ends (arrays) in place of text."""
    path, added = _sent(docs, path), unused(docs, "ids", "starts", "ends")
    keep = [c for c in docs.columns if c != "text"]
    own = docs.select(*(col(c) for c in keep), F.col("text").cast("string").alias("text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(n, ints) for n in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sizes = pa.compute.binary_length(texts).fill_null(0).to_pylist()
            for i, j in _runs(sizes):
                part = texts.slice(i, j - i).to_pylist()
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(len(keep))), *_encoded(part, path)[0]], names=[*keep, *added])

    return map_rows(own, run, schema)


def decode(encoded: DataFrame, path: str = VOCABULARY, ids: str = "ids", offsets: tuple[str, ...] = ("starts", "ends")) -> DataFrame:
    """``encoded`` with text in place of the columns ``ids`` and ``offsets``."""
    path, text = _sent(encoded, path), unused(encoded, "text")[0]
    keep = [c for c in encoded.columns if c not in (ids, *offsets)]
    own = encoded.select(*(col(c) for c in keep), col(ids).cast("array<int>").alias(ids))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                held = part.column(part.num_columns - 1)
                at = held.offsets.to_numpy() - held.offsets[0].as_py()
                texts = decode_ids(held.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at, path) if held.null_count == 0 else _with_nulls(held, path)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, text])

    return map_rows(own, run, schema)


def _with_nulls(ids: pa.Array, path: str) -> list[str | None]:
    return [None if x is None else decode_ids(np.asarray(x, np.int64), np.array([0, len(x)]), path)[0] for x in ids.to_pylist()]


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, starts, ends, same) of every row: same says whether the decoded ids are the text again, byte for byte; null for a null text."""
    path = _sent(docs, path)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([own.schema["doc_id"], *(T.StructField(n, ints) for n in ("ids", "starts", "ends")), T.StructField("same", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for i, j in _runs(pa.compute.binary_length(texts).fill_null(0).to_pylist()):
                part = texts.slice(i, j - i).to_pylist()
                lists, some, ids, rows, null = _encoded(part, path)
                equal = np.zeros(len(part), bool)
                equal[~null] = [a == c for a, c in zip(some, decode_ids(ids.astype(np.int64), rows, path))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *lists, pa.array(equal, mask=null)], names=schema.names)

    return own.mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
