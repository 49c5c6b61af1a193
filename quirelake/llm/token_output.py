"""Token ids as Parquet lists: dictionary-coded ids, delta-coded numbers, bounded row groups and page indexes.

Texts are put in ascending doc_id order (range partitions, sorted inside), encoded, and written with
doc_id, part (the range), start (inside the part), n_tokens and ids. Row groups and pages are kept
small and the footer has page indexes, so a reader of some documents or only of the metadata skips
the rest. The range bounds and a running sum in each part give every document's place in the whole.

A text is encoded word by word, as its tokenizer never joins across ASCII white space. Arrow splits
a batch of texts and numbers its distinct words; ASCII words are put in lower case and the signs at
a word's end count as a word of their own, so fewer are distinct; not so where the tokenizer
looks at the raw text: words with other characters, which it composes before it lower-cases, and
words that may hold a special token. Words of Latin letters alone need its merges and nothing else
of it. Only the distinct words of a batch are looked up in Python; a
worker keeps the ids of words that it has seen (up to CACHE words, then it starts anew). That gives
the same ids as encoding the whole text.

Rows: a null or empty text is the end id alone; a null doc_id comes first; rows that repeat a doc_id
lie side by side, in order of a hash of the text; an empty table gives an empty result. Further
columns are not read. Very long texts are a single row; nothing is cut.
"""

from __future__ import annotations

import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, read_table, scratch, text_of

END_ID = 2
CACHE = 400_000
CHUNK = 512
TOKENS = "doc_id long, part int, start long, n_tokens int, ids array<int>"
#: Latin letters that compose with nothing before them and have one letter as their lower case.
_LETTERS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
_is_plain = re.compile(f"[{_LETTERS}]+").fullmatch
#: ASCII signs after such a letter, up to the word's end: a run of their own for the tokenizer.
_SIGNS = r"[%s](?P<signs>[!-/:-@\[-`{-~]+)$" % re.sub(r"\\u(....)", r"\\x{\1}", _LETTERS)
#: A special token begins with this; words that hold it are left to the tokenizer as they are.
_SPECIAL = "<|"


class _Index(dict):
    """Numbers words as they come; `new` lists those that have no ids yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of white-space separated words by a tokenizers file, each distinct word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has as many tasks as cores
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merger = Tokenizer.from_file(path)
        self.merger.normalizer = normalizers.Lowercase()
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.merger.model._resize_cache(0)  # each word comes once
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        if not all(_SPECIAL in w.content for w in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError(f"a special token without {_SPECIAL}")
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        # no word holds white space: the end's place; the empty word has no ids
        self._store(np.array([self.index[" "], self.index[""]]), np.array([END_ID], np.int32), np.array([1, 0]))
        self.index.new.clear()

    def _store(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        while len(self.index) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[numbers], self.length[numbers] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += len(ids)

    def _learn(self) -> None:
        """Encode the new words: plain ones in lines, cut again where a word's last piece stands; the others one by one."""
        new, self.index.new = self.index.new, []
        first = len(self.index) - len(new)
        plain = [i for i, w in enumerate(new) if _is_plain(w)]
        odd = sorted(set(range(len(new))).difference(plain))
        lines = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        encoded = (x for at in range(0, len(lines), 50) for x in self.merger.encode_batch_fast([" ".join([new[i] for i in x]) for x in lines[at : at + 50]], add_special_tokens=False))
        for line, got in zip(lines, encoded):
            ids = np.array(got.ids, np.int32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(line) or stops[-1] != len(ids):  # a word isn't one run of pieces
                odd += line
            else:
                self._store(np.array(line) + first, ids, np.diff(stops, prepend=0))
        for at in range(0, len(odd), 200):
            some = odd[at : at + 200]
            got = [x.ids for x in self.tokenizer.encode_batch_fast([new[i] for i in some], add_special_tokens=False)]
            self._store(np.array(some) + first, np.array([t for ids in got for t in ids], np.int32), np.array([len(ids) for ids in got]))

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of words' stems and of the signs after them (the empty word's if there are none)."""
        raw = pc.or_(pc.invert(pc.string_is_ascii(words)), pc.match_substring(words, _SPECIAL))
        low = pc.if_else(raw, words, pc.ascii_lower(words))
        signs = pc.fill_null(pc.struct_field(pc.extract_regex(low, _SIGNS), 0), "")
        signs = pc.if_else(pc.match_substring(words, _SPECIAL), "", signs)
        stems = pc.if_else(pc.equal(signs, ""), low, pc.utf8_rtrim(low, string.punctuation)).dictionary_encode()
        number = self.index.__getitem__
        return tuple(np.fromiter(map(number, x.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(x.dictionary))[x.indices.to_numpy()] for x in (stems, signs.dictionary_encode()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the number of ids of each."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(self.index) > CACHE:
            self.reset()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        pair = np.stack([*self._numbers(words.dictionary)], axis=1) if len(words.dictionary) else np.zeros((0, 2), np.int64)
        self._learn()
        # the ids of each distinct word, then of the end, side by side
        pieces = np.append(pair.ravel(), [0, 1])
        ids, ends = self._gather(pieces)
        ends = ends[1::2]
        length = np.diff(ends, prepend=0)
        # the texts' words with an end after each text
        edges = split.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        flat = np.full(edges[-1] + len(texts), len(length) - 1)
        after = np.ones(len(flat), bool)
        after[edges[1:] + np.arange(len(texts))] = False
        flat[after] = words.indices.to_numpy()
        many, begin = length[flat], (ends - length)[flat]
        last = np.cumsum(many)
        return ids[_spread(begin - last + many, many)], np.diff(last[~after], prepend=0)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these numbers' words, and where each one's ids end."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        return self.flat[_spread(self.offset[numbers] - ends + length, length)], ends


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each start so many times as its length, plus 0, 1, 2 and so on over all."""
    out = np.repeat(starts.astype(np.int32), lengths)
    out += np.arange(len(out), dtype=np.int32)
    return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _lists(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths], dtype=np.int32)), pa.array(ids, pa.int32()))


def _encode(path: str):
    def encode(batches):
        encoder, part, start = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                ids, lengths = encoder.encode(rows.column(1))
                starts = start + np.cumsum(lengths) - lengths
                start += int(lengths.sum())
                columns = [rows.column(0), pa.array([part] * rows.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), _lists(ids, lengths)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start", "n_tokens", "ids"])

    return encode


def write_tokens(docs: DataFrame, tokenizer: str, path: str, row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Encode the texts of docs (doc_id, text) and write them under path in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.xxhash64(text_of("text")).alias("h"))
    ordered = rows.repartitionByRange(parallelism(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    encoded = ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer), TOKENS)
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10,
        "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20,
    }
    encoded.write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; only the columns that are used are read."""
    tokens = spark.read.schema(TOKENS).parquet(path)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each range partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return tokens.join(F.broadcast(bases), F.col("part") == F.col("_part")).select("doc_id", (F.col("_base") + F.col("start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def _checksums(batches):
    for batch in batches:
        lists = batch.column(3)
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        edges = lists.offsets.to_pylist()
        sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """tokens with ids_crc32, of the ids as little-endian 32-bit integers, instead of the ids."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Every document's place and checksum, from the files that its ids have been written to."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), str(tokenizer), path)
    return checksums(read_tokens(spark, path))
