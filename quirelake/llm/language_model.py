"""Language-model scoring by a weighted backoff automaton.

The model is a bigram model with modified Kneser-Ney discounts over an add-1/2 unigram base, its
counts taken from every training document. As an automaton: a root state with an arc for each word
(log10 of its unigram probability), a state for each word (and the text's beginning) that has been
seen as a context, an arc for each seen bigram, and a failure arc from each context to the root that
bears the log10 of its backoff weight. A text is scored in one walk from left to right that carries
the state and adds up the weights. For every state the probabilities of all words sum to one.

The counts are never in one place. Texts become blocks of about BLOCK_TOKENS tokens (word hashes and
local ids). Each block asks for the counts of its distinct words and bigrams; the questions are
packed by hash range, merged where they meet, and the answers go back to the blocks, which then
hold just the part of the automaton that their texts walk on. A context with a large share of all
tokens is spread over the ranges by the next word, so that no range holds a hot context whole.
Words are known by 64-bit hashes, next words inside a context by 32 bits.

Rows: a null or empty text is one end token; a null doc_id learns like an id whose remainder is 0;
ids may repeat (each row is scored); a very long text is one row of one block, which it may make longer
than BLOCK_TOKENS; equal scores need no order; an empty table gives an empty result; with no training text
every probability comes from the empty base. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, parallelism, read_table, text_of
from .near_dedup import mix64, words_of_bytes

FOLDS, HELD_OUT = 5, 1
BLOCK_TOKENS = 1 << 20
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b" "))
_GOLD = np.uint64(0x9E3779B97F4A7C15)

_BLOCK = "block long, ids array<string>, held array<boolean>, lengths array<int>, words binary, tokens binary"
_QUESTION = "part int, block long, contexts binary, runs binary, keys binary, counts binary"
_ANSWER = "kind string, block long, part int, answer binary, stats array<long>"


def pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range that a hash falls into: in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _to_blocks(batches):
    """Texts to blocks: local word ids in order of text, and the sorted hashes of the words."""
    at, seq = TaskContext.get().partitionId(), 0
    ids, held, lengths, tokens, local = [], [], [], [], {}

    def block():
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
        hashes, rank = np.unique(np.append(hashes, END), return_inverse=True)
        flat = np.concatenate(tokens)
        flat = rank[np.where(flat < 0, len(local), flat)].astype(np.uint32)
        row = [[at << 32 | seq], [ids], [held], [lengths], [pack_sorted(hashes)], [pack(flat)]]
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["block", "ids", "held", "lengths", "words", "tokens"])

    n = 0
    for batch in batches:
        for i in range(batch.num_rows):
            words = words_of_bytes(batch.column(2)[i].as_py().encode())
            own = np.fromiter((local.setdefault(w, len(local)) for w in words), np.int64, len(words))
            tokens.append(np.append(own, -1))
            ids.append(batch.column(0)[i].as_py())
            held.append(batch.column(1)[i].as_py())
            lengths.append(len(words) + 1)
            n += len(words) + 1
            if n >= BLOCK_TOKENS:
                yield block()
                ids, held, lengths, tokens, local, n, seq = [], [], [], [], {}, 0, seq + 1
    if ids:
        yield block()


class Block:
    """A block read back: word hashes, the tokens of all its texts, and which of them are training tokens."""

    def __init__(self, row):
        self.words = unpack_sorted(row["words"])
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.ends = np.cumsum(self.lengths)
        self.train = np.repeat(~self.held, self.lengths)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.words)).astype(np.uint32)

    def bigrams(self, hot: np.ndarray, parts: int):
        """Distinct bigrams in the order of (part, context hash, next word): context and word (local; the beginning is
        the number of words), the context's hash, 32 bits of the next word's hash, part and training count."""
        n = len(self.words)
        before = np.empty_like(self.tokens)
        before[1:], before[0] = self.tokens[:-1], n
        before[self.ends[:-1]] = n
        pairs, inverse = np.unique(before * n + self.tokens, return_inverse=True)
        counts = np.bincount(inverse[self.train], minlength=len(pairs)).astype(np.uint32)
        context, word = np.divmod(pairs, n)
        hashes = np.append(self.words, BEGIN)[context]
        follower = (self.words[word] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        route = np.where(np.isin(hashes, hot), mix64(hashes ^ self.words[word]), hashes)
        part = part_of(route, parts)
        order = np.lexsort((follower, hashes, part))
        return tuple(x[order] for x in (context, word, hashes, follower, part, counts))


def _runs(part: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where a new (part, context) begins."""
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (hashes[1:] != hashes[:-1])
    return np.flatnonzero(new)


def _ask_words(parts: int):
    def ask(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                b = Block(row)
                counts, part = b.word_counts(), part_of(b.words, parts)
                edges = np.searchsorted(part, np.arange(parts + 1))
                rows = [(p, row["block"], b"", b"", pack_sorted(b.words[i:j]), pack(counts[i:j])) for p, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
                yield pd.DataFrame(rows, columns=["part", "block", "contexts", "runs", "keys", "counts"])

    return ask


def _ask_bigrams(parts: int, hot: np.ndarray):
    def ask(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                _, _, hashes, follower, part, counts = Block(row).bigrams(hot, parts)
                edges, rows = np.searchsorted(part, np.arange(parts + 1)), []
                for p, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                    if j > i:
                        at = _runs(part[i:j], hashes[i:j])
                        lengths = np.diff(np.append(at, j - i)).astype(np.uint32)
                        rows.append((p, row["block"], pack_sorted(hashes[i:j][at]), pack(lengths), follower[i:j].tobytes(), pack(counts[i:j])))
                yield pd.DataFrame(rows, columns=["part", "block", "contexts", "runs", "keys", "counts"])

    return ask


def _answers(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "block", "part", "answer", "stats"])


def _merge_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range's words for each block that asked; its tokens and words in all; its most frequent words."""
    asked = [unpack_sorted(k) for k in frame["keys"]]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate([unpack(c, np.uint32) for c in frame["counts"]]), len(keys)).astype(np.int64)
    ends, part = np.cumsum([len(a) for a in asked]), int(frame["part"].iloc[0])
    rows = [("word", b, part, pack(totals[inverse[e - len(a) : e]]), None) for b, a, e in zip(frame["block"], asked, ends)]
    rows.append(("sum", -1, part, None, [int(totals.sum()), int((totals > 0).sum())]))
    for k in np.argsort(-totals, kind="stable")[:16]:
        rows.append(("top", -1, part, None, [int(keys[k].view(np.int64)), int(totals[k])]))
    return _answers(rows)


def _merge_bigrams(hot: np.ndarray):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Totals of one range's bigrams, and for each context asked for how many bigrams it has once, twice, more often."""
        part = int(frame["part"].iloc[0])
        contexts = [unpack_sorted(c) for c in frame["contexts"]]
        runs = [unpack(r, np.uint32) for r in frame["runs"]]
        of = np.concatenate([np.repeat(c, r) for c, r in zip(contexts, runs)])
        key = mix64(of * _GOLD + np.frombuffer(b"".join(frame["keys"]), np.uint32))
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        totals = np.bincount(inverse, np.concatenate([unpack(c, np.uint32) for c in frame["counts"]]), len(keys)).astype(np.int64)
        seen = totals > 0
        known, at = np.unique(of[first][seen], return_inverse=True)
        times = np.minimum(totals[seen], 3)
        types = np.stack([np.bincount(at[times == k], minlength=len(known)) for k in (1, 2, 3)], axis=1).astype(np.int64) if len(known) else np.zeros((0, 3), np.int64)
        rows, end = [], 0
        for block, c, r in zip(frame["block"], contexts, runs):
            size = int(r.sum())
            place = np.minimum(np.searchsorted(known, c), max(len(known) - 1, 0))
            own = np.where((known[place] == c)[:, None], types[place], 0) if len(known) else np.zeros((len(c), 3), np.int64)
            rows.append(("bigram", block, part, pack(totals[inverse[end : end + size]]), None))
            rows.append(("types", block, part, pack(own), None))
            end += size
        rows.append(("sum", -1, part, None, [int((totals == k).sum()) for k in (1, 2, 3, 4)]))
        rows += [("hot", -1, part, None, [int(k.view(np.int64)), *map(int, t)]) for k, t in zip(known, types) if k in hot]
        return _answers(rows)

    return merge


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, 3 and over, from how many bigrams have counts 1 to 4."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    d1, d2, d3 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    d1 = min(max(d1, 0.1), 0.95)
    d2 = min(max(d2, d1), 1.9)
    return np.array([0.0, d1, d2, min(max(d3, d2), 2.9)])


class Automaton:
    """The part of the automaton that a block's texts walk on. States are the words' local ids, then the beginning."""

    def __init__(self, root: np.ndarray, arcs: dict[int, float], failure: np.ndarray):
        self.root, self.arcs, self.failure, self.n = root.tolist(), arcs, failure.tolist(), len(root)

    def score(self, tokens: list[int]) -> float:
        state, total, n = self.n, 0.0, self.n
        arcs, root, failure = self.arcs.get, self.root, self.failure
        for token in tokens:
            weight = arcs(state * n + token)
            total += weight if weight is not None else failure[state] + root[token]
            state = token
        return total


def _score(parts: int, hot: np.ndarray, hot_types: np.ndarray, tokens: int, words: int, texts: int, discount: np.ndarray):
    def score(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        row = block.iloc[0]
        b = Block(row)
        of = {k: f.sort_values("part")["answer"] for k, f in answers.groupby("kind")}
        joined = lambda k: np.concatenate([unpack(x, np.int64) for x in of[k]])
        count = joined("word")
        unigram = np.log10((count + 0.5) / (tokens + 0.5 * (words + 1)))
        context, word, hashes, _, part, _ = b.bigrams(hot, parts)
        total, types = joined("bigram"), joined("types").reshape(-1, 3)
        at = _runs(part, hashes)
        n = len(b.words)
        by_context = np.zeros((n + 1, 3))
        by_context[context[at]] = types
        place = np.searchsorted(hot, np.append(b.words, BEGIN))
        is_hot = (place < len(hot)) & (hot[np.minimum(place, len(hot) - 1)] == np.append(b.words, BEGIN))
        by_context[is_hot] = hot_types[place[is_hot]]
        seen = np.append(count, texts).astype(float)
        backoff = np.where(seen > 0, by_context @ discount[1:] / np.maximum(seen, 1), 1.0)
        arc = total > 0
        c, h, w = total[arc], context[arc], word[arc]
        weight = np.log10((c - discount[np.minimum(c, 3)]) / seen[h] + backoff[h] * 10.0 ** unigram[w])
        walker = Automaton(unigram, dict(zip((h * n + w).tolist(), weight.tolist())), np.log10(np.maximum(backoff, 1e-300)))
        starts = b.ends - b.lengths
        ids = b.tokens.tolist()
        return pd.DataFrame({
            "doc_id": row["ids"], "held_out": b.held, "n_tokens": b.lengths,
            "n_known": np.add.reduceat((count > 0)[b.tokens].astype(np.int64), starts),
            "base_score": np.add.reduceat(unigram[b.tokens], starts),
            "score": [walker.score(ids[i:j]) for i, j in zip(starts.tolist(), b.ends.tolist())],
        })

    return score


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column; rows where it is true are scored but not learnt from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_of("text").alias("text"))
    blocks = materialize(rows.mapInArrow(_to_blocks, _BLOCK), "lm-blocks")
    n_blocks, texts = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0))).first()
    parts = max(parallelism(spark), n_blocks // 4)
    asked = lambda ask: blocks.select("block", "held", "lengths", "words", "tokens").mapInPandas(ask, _QUESTION).repartition(parts, "part").groupBy("part")

    unigrams = materialize(asked(_ask_words(parts)).applyInPandas(_merge_words, _ANSWER), "lm-words", ["kind"])
    sums = unigrams.where("kind = 'sum'").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in (0, 1)]).first()
    tokens, words = int(sums[0]), int(sums[1])
    # at most 4 words for each range can have so large a share
    top = unigrams.where((F.col("kind") == "top") & (F.col("stats")[1] * 4 * parts >= tokens)).select(F.col("stats")[0]).limit(4 * parts).collect()
    hot = np.unique(np.append(np.array([r[0] for r in top], np.int64).view(np.uint64), BEGIN))

    bigrams = materialize(asked(_ask_bigrams(parts, hot)).applyInPandas(_merge_bigrams(hot), _ANSWER), "lm-bigrams", ["kind"])
    four = bigrams.where("kind = 'sum'").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)]).first()
    spread = bigrams.where("kind = 'hot'").groupBy(F.col("stats")[0].alias("k")).agg(*[F.sum(F.col("stats")[i]) for i in (1, 2, 3)]).collect()
    hot_types = np.zeros((len(hot), 3))
    for r in spread:
        hot_types[np.searchsorted(hot, np.array([r[0]], np.int64).view(np.uint64))[0]] = r[1:]

    answers = unigrams.where("kind = 'word'").union(bigrams.where(F.col("kind").isin("bigram", "types"))).select("kind", "block", "part", "answer")
    walk = _score(parts, hot, hot_types, tokens, words, int(texts), discounts(list(four)))
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(walk, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the model learnt from four fifths of the documents."""
    return score_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", FOLDS) == HELD_OUT)
