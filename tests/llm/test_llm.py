"""The training-data operators against brute-force versions, on whole small tables."""

import collections
import hashlib
import math
import re
import string
import time
import zlib
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelake.llm import common, decontamination, language_model, line_dedup, linear, mixing, near_dedup, quality_classifier, quality_rules, sharding, token_output, toxicity
from quirelake.llm import queries as Q
from quirelake.llm.components import components

from ..oracle import assert_same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in common.read_table(spark, SF, "documents").select("doc_id", "text").collect()}


def words(text):
    return text.encode().lower().split()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    assert_same(Q.QUERIES[name](spark, SF), Q.ORACLE_SQL[name], SF)


def test_op2_table_and_placement(spark, docs):
    table = sharding.lookup_table([f"shard-{k}" for k in range(7)], 1009)
    share = collections.Counter(table)
    assert len(table) == 1009 and set(share) == set(range(7)) and max(share.values()) - min(share.values()) <= 1
    fewer = sharding.lookup_table([f"shard-{k}" for k in range(6)], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)
    full = sharding.lookup_table([f"shard-{k}" for k in range(sharding.N_SHARDS)])
    for r in Q.QUERIES["op2_sharding"](spark, SF).collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, full[slot])


def brute_lm(docs):
    held = {d: crc32(str(d).encode()) % 5 == 1 for d in docs}
    text = {d: [*words(t), None] for d, t in docs.items()}
    train = [w for d, w in text.items() if not held[d]]
    one = collections.Counter(x for w in train for x in w)
    two = collections.Counter(p for w in train for p in zip([0, *w[:-1]], w))
    total, kinds = sum(one.values()), len(one)
    discount = language_model.discounts([sum(c == k for c in two.values()) for k in (1, 2, 3, 4)])
    types = collections.defaultdict(lambda: [0, 0, 0])
    for (h, _), c in two.items():
        types[h][min(c, 3) - 1] += 1
    context = {**one, 0: len(train)}

    def probability(h, w):
        low = (one[w] + 0.5) / (total + 0.5 * (kinds + 1))
        if not context.get(h):
            return low
        c = two[(h, w)]
        return ((c - discount[min(c, 3)]) / context[h] if c else 0) + sum(discount[i + 1] * types[h][i] for i in range(3)) / context[h] * low

    for d, w in text.items():
        yield d, held[d], len(w), sum(one[x] > 0 for x in w), total, sum(math.log10((one[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), sum(math.log10(probability(*p)) for p in zip([0, *w[:-1]], w))


@pytest.mark.parametrize("block", [language_model.BLOCK_TOKENS])
def test_op3_equals_brute_force_and_beats_the_base(spark, docs, block):
    got = {r.doc_id: r for r in Q.QUERIES["op3_lm_scoring"](spark, SF).collect()}
    gain = 0.0
    for d, held, n, known, total, base, score in brute_lm(docs):
        r = got.pop(d)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        gain += (score - base) * held
    assert not got and gain > 0


def test_op3_automaton_sums_to_one():
    # a context whose seen words take what the discounts leave
    root = np.log10(np.array([0.5, 0.3, 0.2]))
    backoff = np.array([0.4, 1.0, 1.0, 1.0])
    arcs = {0 * 3 + 1: math.log10(0.6 + 0.4 * 0.3)}
    walker = language_model.Automaton(root, arcs, np.log10(backoff))
    total = sum(10 ** (walker.score([0, w]) - walker.score([0])) for w in range(3))
    assert total == pytest.approx(1.0)


def test_op5_files_hold_what_the_tokenizer_gives(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(str(P.path("word_bpe_49k.json"))), 0
    got = {r.doc_id: r for r in Q.QUERIES["op5_token_output"](spark, SF).collect()}
    for d in sorted(docs):
        ids = [*t.encode(docs[d], add_special_tokens=False).ids, 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op5_words_encode_apart():
    P = pytest.importorskip("public_tokenizers")
    e = token_output.WordEncoder(str(P.path("word_bpe_49k.json")))
    hard = ["İstanbul. ΑΣ. ΟΔΟΣ, x", "don't it's WE'LL 3.14 a1b2 ###, <|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "", "é ́a\xa0 x y\x1cz\x85w", "日本語。 ÀÉ. ß, ŉ. ǅ.", "Ⅷ. ªº. 'S 'Tx", "K. ſ, ..", "a" * 50_000]
    ids, n = e.encode(pa.array(hard))
    ends = np.cumsum([0, *n])
    for i, h in enumerate(hard):
        assert ids[ends[i] : ends[i + 1]].tolist() == [*e.tokenizer.encode(h, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("text", [
    "<|EndOfText|>", "a <|ENDOFTEXT|> B. C", "x<|StartOfText|>y", "<|ENDOFTEXT|> <|endoftext|>", "T\u0308x", "J\u030c H\u0331. W\u030a,", "AT\u0308X Plain. WORDS, BESIDE", "A\u0328\u0301 E\u0323\u0302Z", "I\u0307 \u0130 S\u0323\u0307", "Z\u00c9 Q\u4e2d",
])
def test_op5_raw_text_decides(text):
    # one text to an encoder: what it has seen before can't help
    P = pytest.importorskip("public_tokenizers")
    e = token_output.WordEncoder(str(P.path("word_bpe_49k.json")))
    assert e.encode(pa.array([text]))[0].tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_op5_letters_and_signs():
    # every letter that is merged without the tokenizer's own rules, and every sign after a letter
    P = pytest.importorskip("public_tokenizers")
    e = token_output.WordEncoder(str(P.path("word_bpe_49k.json")))
    letters = [chr(c) for c in range(0x260) if chr(c).isalpha()]
    texts = [f"{c} a{c}b x{c}{c.upper()}{c}." for c in letters] + [f"a{a}{b} \u00e9{b}{a} 7{a} \u4e2d{b}" for a in string.punctuation for b in string.punctuation]
    ids, n = e.encode(pa.array(texts))
    ends = np.cumsum([0, *n])
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2], t
    assert sum(map(bool, map(token_output._is_plain, letters))) > 400


def test_op5_empty_table(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(P.path("word_bpe_49k.json")), str(tmp_path / "t"))
    assert token_output.checksums(token_output.read_tokens(spark, str(tmp_path / "t"))).count() == 0


def test_op1_passage_of_two_documents(spark):
    passage, short = " ".join(f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50)), "seen in two documents"
    form = "{} " + " ".join("form" + chr(97 + i) for i in range(24)) + " {}"
    texts = [f"one alone\n{passage}\n{short}", f"{short}\nanother\n{passage}", f"{form.format('same', 'ann')}\nx", f"y\n{form.format('same', 'bob')}", f"{passage[:-1]} changed"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id: r.text for r in line_dedup.clean(df, pair_tokens=20).collect()}
    assert kept == {0: f"one alone\n{short}", 1: f"{short}\nanother", 2: "x", 3: "y", 4: texts[4]}
    assert {r.doc_id: r.text for r in line_dedup.clean(df).collect()} == dict(enumerate(texts))
    assert line_dedup.PAIRS_SQL.count("THEN 2 ELSE 3") == line_dedup.ORACLE_SQL.count("count(DISTINCT doc) >= 3") == 4


def brute_em(patterns, n_rules, rounds):
    """patterns: {votes: count}; the same start, smoothing and steps, in plain Python."""
    q = {v: 0.9 if sum(2 * x if x < 0 else x for x in v) > 0 else 0.1 for v in patterns}
    for step in range(rounds + 1):
        if step:
            for v in patterns:
                like = [math.log(1 - prior), math.log(prior)]
                for k in (0, 1):
                    like[k] += sum(math.log(rate[k][r][x + 1]) for r, x in enumerate(v))
                q[v] = 1 / (1 + math.exp(min(700, like[0] - like[1])))
        good, total = sum(n * q[v] for v, n in patterns.items()), sum(patterns.values())
        prior = (1 + good) / (2 + total)
        share = [lambda v: 1 - q[v], lambda v: q[v]]
        rate = [[[(1 + sum(n * share[k](v) for v, n in patterns.items() if v[r] == vote)) / (3 + sum(n * share[k](v) for v, n in patterns.items())) for vote in (-1, 0, 1)] for r in range(n_rules)] for k in (0, 1)]
    return prior, rate


def test_op6_base_counts_and_expectation_maximisation(spark, docs):
    got = {r.doc_id: r for r in Q.QUERIES["op6_quality_rules"](spark, SF).collect()}
    for d, text in docs.items():
        w = WORD.findall(text)
        triples, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if triples[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    patterns = {(1, 1, 0): 30.0, (1, 0, 1): 20.0, (-1, 0, 0): 5.0, (-1, -1, 0): 9.0, (0, 0, 0): 4.0}
    df = spark.createDataFrame([(list(v),) for v, n in patterns.items() for _ in range(int(n))], "v array<int>")
    model = quality_rules.fit(df, "v", 3, 12)
    prior, rate = brute_em(patterns, 3, 12)
    assert model["prior"] == pytest.approx(prior)
    assert np.array(model["rate"]).ravel() == pytest.approx(np.array(rate).ravel())


def test_op4_long_item(spark):
    """An item of 20,000 words: window rows stay small, and passages of it are found in both ways of joining."""
    rng = np.random.default_rng(8)
    w = [f"w{x}" for x in rng.integers(0, 3000, 20_000)]
    bench = spark.createDataFrame([("long", " ".join(w)), ("long", " ".join(w))], "item_id string, text string")
    texts = [" ".join(w[i : i + 40]) + " z" * 10 for i in (0, 7, 9_999, 19_960)] + [" ".join(w[5:17]) + " z", "", " ".join(w)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks, _, _ = decontamination.windows(docs, bench)
    assert marks.agg(F.max(F.size("words"))).first()[0] == 13 and marks.count() <= 20_000
    expected = {0: 40, 1: 40, 2: 40, 3: 40, 4: 0, 5: 0, 6: 20_000}
    for most in (decontamination.MAX_BROADCAST, 0):
        assert {r.doc_id: r.n_hit for r in decontamination.report(docs, bench, max_broadcast=most).collect()} == expected


def test_op4_shared_passage(spark):
    """A passage that 1,000 items and 1,000 documents share, and items of one and two words: rows are their sum, results those of brute force."""
    passage = " ".join(f"shared{i}" for i in range(20))
    items = [(f"i{i}", f"own{i} task one {passage} end {i}") for i in range(1000)] + [("one", "Lonely"), ("two", "lonely PAIR"), ("again", passage.upper())]
    texts = [f"text {i} begins {passage} and goes on" if i % 100 else f"no passage {i} lonely pair" for i in range(1000)] + [f"x own7 task one {passage} end 7", "lonely", "pair lonely", None]
    bench, docs = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks, holders, singles = decontamination.windows(docs, bench)
    met = decontamination.own_tokens(decontamination.corpus_chunks(docs), "doc_id", singles=singles).join(marks, "token").count()
    assert singles and met < 20_000 and holders.count() <= 5
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    held = collections.defaultdict(set)
    for name, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - 12)):
            held[tuple(w[s : s + 13])].add(name)
    expected = {}
    for i, text in enumerate(texts):
        w, hit, names = words_of(text), set(), set()
        for n in (1, 2, 13):
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in held:
                    hit |= set(range(s, s + n))
                    names |= held[tuple(w[s : s + n])]
        expected[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    for most in (decontamination.MAX_BROADCAST, 0):
        got = decontamination.report(docs, bench, max_broadcast=most).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == expected


def test_broadcasts_are_measured(spark):
    df = spark.range(10).select(F.repeat(F.lit("x"), 200_000).alias("text"), F.array(F.lit("ab"), F.lit("c")).alias("words"))
    assert common.fits_broadcast(df, 10) and not common.fits_broadcast(df, 9) and not common.fits_broadcast(df, 10, 1) and common.fits_broadcast(df.limit(0), 0)


def brute_mix(rows, plan, shards=64):
    """taken of each (doc_id, text, source), by quotas of blocks and a walk along each cell's line, in plain Python; cells as Spark deals them."""
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    wanted = mixing.targets(dict(size), plan)
    # a block's words: 50 blocks for each shard of the smallest source, 64 words at most and one at least
    block = 1
    while block < plan.block_tokens and min(w for w in wanted.values() if w > 0) >= 50 * shards * (block + 1):
        block += 1

    def seats(wants, n):
        got = [0] * len(wants)
        for _ in range(n if sum(wants) > 0 else 0):
            k = max(range(len(wants)), key=lambda i: (wants[i] / (2 * got[i] + 1), -i))
            got[k] += 1
        return got

    sources = sorted(size, key=lambda s: (s is None, s or ""))
    won = dict(zip(sources, seats([wanted[s] for s in sources], round(sum(wanted.values()) / block))))
    taken = {}
    for s in sources:
        cells = collections.defaultdict(list)
        for r in rows:
            if r.source == s:
                cells[r.cell].append(r)
        order = sorted(cells)
        words = [sum(r.size for r in cells[c]) for c in order]
        blocks = [max(1, round(n / block)) if n else 0 for n in words]
        most = round(won[s] * block * sum(blocks) / size[s]) if size[s] else 0
        for c, line, n, quota in zip(order, words, blocks, seats([float(b) for b in blocks], min(most, int(plan.cap * sum(blocks))))):
            rounds, picks = divmod(quota, n) if n else (0, 0)
            end, at = line * picks // n if n else 0, 0
            for r in sorted(cells[c], key=lambda r: (r.at, r.doc_id)):
                taken[r.doc_id] = rounds * r.size + max(0, min(r.size, end - at))
                at += r.size
    return taken


def test_op10_choice_of_blocks_by_hand(spark):
    plan = mixing.MixPlan()
    got = Q.QUERIES["op10_mixing"](spark, SF).collect()
    docs = common.read_table(spark, SF, "documents")
    shards = max(plan.min_shards, -(-docs.count() // plan.docs_per_shard))
    size = F.regexp_count(common.text_of("text"), F.lit(common.WORD)).cast("long")
    dealt = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("at", F.xxhash64(F.lit(plan.seed), "doc_id", "size")).withColumn("cell", F.pmod("at", F.lit(shards)).cast("int"))
    assert {r.doc_id: r.taken for r in got} == brute_mix(dealt.collect(), plan)


def test_op10_many_sources(spark):
    docs = spark.range(15_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b c "), 20).alias("text"), F.concat(F.lit("s"), F.pmod("id", F.lit(5000)).cast("string")).alias("source"))
    began = time.time()
    per = mixing.mix(docs).groupBy(F.pmod("doc_id", F.lit(5000)).alias("s")).agg(F.count("*").alias("n"), F.max("taken").alias("most"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 5000 and all(r.n == 3 and r.most <= 120 and abs(r.taken - r.target) <= 64 for r in per)
    assert time.time() - began < 60


@pytest.mark.parametrize("large", [0, 1, 40_000])
def test_op10_small_sources_come_near_their_targets(spark, large):
    """500 sources of 1 to 40 words, alone or beside a large one."""
    rows = [(i, "w " * (1 + i % 40), f"s{i:04d}") for i in range(500)] + [(1000 + i, "w " * (20 + i % 300), "zz") for i in range(large // 10)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {r[0]: r[2] for r in rows}
    taken, target = collections.Counter(), {}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= max(1.0, 0.01 * t) for s, t in target.items())


def test_op10_every_source_is_near_on_the_given_table(spark):
    docs = common.read_table(spark, "/root/testdata/sf0.01", "documents")
    got = mixing.mix(docs.select("doc_id", "text", "source", F.col("source").alias("of")), keep=("of",))
    per = got.groupBy("of").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 20 and all(abs(r.taken - r.target) <= max(1.0, 0.01 * r.target) for r in per)


def brute_lookup(shards, slots):
    """Shards claim slots in turn along their permutations, which are written out in full."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
    prefers = [[(number(f"offset:{s}") + j * (number(f"skip:{s}") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards]
    assert all(len(set(p)) == slots for p in prefers)
    table, at = {}, [0] * len(shards)
    while len(table) < slots:
        for k, p in enumerate(prefers):
            while len(table) < slots and p[at[k]] in table:
                at[k] += 1
            if len(table) < slots:
                table[p[at[k]]] = k
    return [table[i] for i in range(slots)]


def test_op2_table_by_hand():
    names = [f"shard-{k}" for k in range(sharding.N_SHARDS)]
    assert sharding.lookup_table(names, 1009) == brute_lookup(names, 1009)
    assert sharding.lookup_table(names) == brute_lookup(names, sharding.SLOTS)


def test_edge_values_by_hand(spark):
    """What nulls, empty texts, ties and repeated rows come out as, value by value."""
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "one two", "a"), (3, "one two", "a"), (None, "one two", None)], schema)
    got = lambda df, *c: sorted((tuple(r[x] for x in c) for r in df.collect()), key=str)
    assert got(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (3, 1, 3, True), (None, 1, None, True)], key=str)
    scored = got(language_model.score_texts(docs, F.lit(False)), "doc_id", "n_tokens", "n_known", "train_tokens")
    assert scored == sorted([(1, 1, 1, 11), (2, 1, 1, 11), (3, 3, 3, 11), (3, 3, 3, 11), (None, 3, 3, 11)], key=str)
    q = quality_rules.judge(docs)
    assert got(q.select("doc_id", "_quality.*"), "doc_id", "n_words", "base_failed", "kept") == sorted([(1, 0, True, False), (2, 0, True, False), (3, 2, True, False), (3, 2, True, False), (None, 2, True, False)], key=str)
    mixed = got(mixing.mix(docs), "doc_id", "size", "source_size")
    assert mixed == sorted([(1, 0, 4), (2, 0, 2), (3, 2, 4), (3, 2, 4), (None, 2, 2)], key=str)
    placed = {(r.doc_id, r.slot) for r in sharding.shard_documents(docs).collect()}
    assert len(placed) == 4 and {r.slot for r in sharding.shard_documents(docs).where("doc_id IS NULL").collect()} == {int(hashlib.md5(b"").hexdigest()[:15], 16) % sharding.SLOTS}
    assert got(line_dedup.clean(docs, min_docs=2), "doc_id", "text") == sorted([(1, ""), (2, ""), (3, "one two"), (3, "one two"), (None, "one two")], key=str)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for classify in (toxicity.classify, quality_classifier.classify):
        assert {r.score for r in classify(docs, none, F.lit(True)).collect()} == {0.5}


def brute_votes(text):
    """The votes of the rules, measured in plain Python."""
    import regex

    plain = WORD
    w = plain.findall(text)
    lines = [x for x in text.split("\n") if plain.search(x)]
    triples, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    stutters, i = 0, 0
    while i + 1 < len(w):  # a pair of equal words is one, and the next begins behind it
        equal = w[i] == w[i + 1]
        stutters, i = stutters + equal, i + 1 + equal
    chars = sum(map(len, w))
    shape = regex.compile(r"[\"'(\[«„“]*[\p{L}\p{M}'’、。，！？-]+[.,;:!?\"')\]»”…]*")
    shouts = sum(bool(re.fullmatch(r"[^a-z]*[A-Z]{2}[^a-z]*!{2}.*", x, re.S)) for x in w)
    share = lambda x, of: x / of if of else None
    m = {
        "mean_word": share(chars, len(w)), "odd_share": share(sum(not shape.fullmatch(x) for x in w), len(w)), "symbol_share": share(sum(x in "#*$%&|<>" for x in text), chars),
        "repeat_share": share(len(covered), len(w)), "dup_line_share": (len(lines) - len(set(lines))) / len(lines) if len(lines) > 1 else None, "shout_share": share(shouts, len(w)),
        "bar_share": share(w.count("|"), len(w)), "stutter_share": share(2 * stutters, len(w)),
    }
    vote = lambda x, bad, good: 0 if x is None else -1 if x >= bad else 1 if good is not None and x < good else 0
    return tuple(vote(m[k], bad, good) for _, k, bad, good in quality_rules.RULES), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_op6_posterior_and_verdict_of_the_query(spark, docs):
    got = {r.doc_id: r for r in Q.QUERIES["op6_quality_rules"](spark, SF).collect()}
    judged = {d: brute_votes(t) for d, t in docs.items()}
    patterns = collections.Counter(v for v, failed in judged.values() if not failed)
    prior, rate = brute_em({v: float(n) for v, n in patterns.items()}, len(quality_rules.RULES), quality_rules.ROUNDS)
    assert len(patterns) > 3
    for d, (v, failed) in judged.items():
        odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1][r][x + 1] / rate[0][r][x + 1]) for r, x in enumerate(v))
        q = 1 / (1 + math.exp(-odds))
        assert got[d].posterior == pytest.approx(q, abs=1e-9), (d, v)
        assert got[d].kept == (not failed and q >= 0.5)


def test_op6_rejects_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    r = Q.QUERIES["op6_quality_rules"](spark, sf).join(common.read_table(spark, sf, "labels"), "doc_id").where("NOT base_failed AND quality = 0")
    kept, n = r.agg(F.count_if("kept"), F.count("*")).first()
    assert kept <= n / 4


def test_op6_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    r = Q.QUERIES["op6_quality_rules"](spark, sf).join(common.read_table(spark, sf, "labels"), "doc_id").where("NOT base_failed")
    counts = {(x.quality, x.kept): x["count"] for x in r.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.01 * counts[(1, True)] and counts[(0, False)] > 0


def accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    r = Q.QUERIES[name](spark, sf)
    assert r.count() == common.read_table(spark, sf, "documents").count()
    held = r.where("held_out").join(common.read_table(spark, sf, "labels"), "doc_id").select("score", "predicted", label).collect()
    assert all(0 <= x.score <= 1 for x in held)
    return sum(x.predicted == x[label] for x in held) / len(held)


def test_op7_held_out_accuracy(spark):
    assert accuracy(spark, "op7_toxicity", "toxic") > 0.9


def test_op8_held_out_accuracy(spark):
    assert accuracy(spark, "op8_quality_classifier", "quality") > 0.9


def test_op7_ratios_and_training_by_hand(spark):
    """The model of a small table against counts, ratios and AdaGrad steps in plain Python, run by run."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), 4)) for _ in range(14)]
    rows = [(i, " ".join(rng.choice(words[: 10 if i % 3 else 14], 30)) + " grim" * (i % 3 == 0), int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(df, df, F.lit(True)).collect()}

    def runs(text):
        line = f" {' '.join(text.lower().split())} "
        return collections.Counter(line[i : i + n] for n in (3, 4, 5) for i in range(len(line) - n + 1))

    counts = {0: collections.Counter(), 1: collections.Counter()}
    having = collections.Counter()
    for _, t, y in rows:
        counts[y].update(runs(t))
        having.update(set(runs(t)))
    size = 1 << toxicity.BITS
    total = [sum(counts[y].values()) + size for y in (0, 1)]
    ratio = {g: math.log((counts[1][g] + 1) / total[1]) - math.log((counts[0][g] + 1) / total[0]) for g in having if having[g] >= toxicity.MIN_TEXTS}
    ratio = {g: r for g, r in ratio.items() if r >= toxicity.MIN_RATIO}
    order = sorted(rows, key=lambda r: (linear.hash_of(r[1].encode()), r[2]))
    w, square, b, bs = collections.defaultdict(float), collections.defaultdict(lambda: 1.0), 0.0, 1.0
    values = {i: {g: math.log1p(n) * ratio[g] for g, n in runs(t).items() if g in ratio} for i, t, _ in rows}
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(order)):
            i, _, y = order[k]
            error = 1 / (1 + math.exp(-(b + sum(w[g] * x for g, x in values[i].items())))) - y
            for g, x in values[i].items():
                square[g] += (error * x) ** 2
                w[g] -= toxicity.RATE * error * x / math.sqrt(square[g])
            bs += error * error
            b -= toxicity.RATE * error / math.sqrt(bs)
    for i, _, _ in rows:
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(b + sum(w[g] * x for g, x in values[i].items())))), rel=1e-4)


def test_op8_follows_the_regularised_leader_by_hand(spark):
    """The model of a small table against FTRL-proximal in plain Python, coordinate by coordinate."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["oak", "elm", "ash", "fir", "yew", "###"][: 5 if i % 4 else 6], 12)) + "!" * (i % 4 == 0), int(i % 4 > 0)) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.classify(df, df, F.lit(True)).collect()}
    Q8 = quality_classifier

    def grams(text):
        t = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", text)
        return {*t, *((a, b) if a != b else "same" for a, b in zip(t, t[1:]))}

    order = sorted(rows, key=lambda r: (linear.hash_of(r[1].encode()), r[2]))
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    ones = sum(y for _, _, y in rows)
    weight = {1: 1.0, 0: ones / (len(rows) - ones)}

    def value(g):
        l1 = 0.0 if g == "bias" else Q8.L1
        return 0.0 if abs(z[g]) <= l1 else -(z[g] - math.copysign(l1, z[g])) / ((Q8.BETA + math.sqrt(n[g])) / Q8.ALPHA + Q8.L2)

    def predict(text):
        return 1 / (1 + math.exp(-sum(value(g) for g in [*grams(text), ("bias")])))

    for epoch in range(Q8.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(order)):
            _, t, y = order[k]
            step = weight[y] * (predict(t) - y)
            for g, v in [(g, value(g)) for g in [*grams(t), "bias"]]:
                z[g] += step - (math.sqrt(n[g] + step * step) - math.sqrt(n[g])) / Q8.ALPHA * v
                n[g] += step * step
    for i, t, _ in rows:
        assert got[i] == pytest.approx(predict(t), rel=1e-4)


def brute_components(docs):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having, common_n = collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for g in s:
            having[g].append(d)
    for ds in having.values():
        common_n.update((a, b) for i, b in enumerate(ds) for a in ds[:i])
    for (a, b), n in common_n.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


def test_op9_equals_brute_force(spark, docs):
    expected = brute_components(docs)
    got = Q.QUERIES["op9_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op9_chains_and_shared_passages(spark):
    rng = np.random.default_rng(3)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    base, passage, out = text(200), text(60), {}
    for i in range(40):  # near copies, each some words away from the last: a chain
        base = base.copy()
        base[int(rng.integers(200))] = f"v{i}"
        base[int(rng.integers(200))] = f"u{i}"
        out[i] = " ".join(base)
    for i in range(100, 180):  # a passage that many share, far under the threshold
        out[i] = " ".join(text(100) + passage)
    for i in range(200, 210):
        out[i] = out[100] if i % 2 else " ".join(text(3))
    df = spark.createDataFrame(list(out.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()} == brute_components(out)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    families = near_dedup._families()
    for share in (0.9, 0.75, 0.5):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:n], rng.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        s = near_dedup.odd_sketches(np.stack([near_dedup.min_hashes(x, *families) for x in (a, b)]))
        x = int(np.bitwise_count(s[0] ^ s[1]).sum())
        k = near_dedup.BANDS * near_dedup.ROWS
        assert 1 + near_dedup.SKETCH_BITS / (4 * k) * math.log(1 - 2 * x / near_dedup.SKETCH_BITS) == pytest.approx(share, abs=0.12)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op10_targets_and_quotas():
    plan = mixing.MixPlan()
    got = mixing.targets({"a": 100, "b": 1000, None: 500}, plan)
    # a wants 1200 but stops at 200; b and null share the rest 1 to 2; null stops at 1000
    assert got == {"a": 200.0, None: 1000.0, "b": pytest.approx(1200.0)}
    wants, blocks = [13.0, 7.5, 3.2, 0.0], 17
    seats = [0] * 4
    for _ in range(blocks):
        seats[max(range(4), key=lambda i: (wants[i] / (2 * seats[i] + 1), -i))] += 1
    assert mixing.apportion(wants, blocks) == seats and mixing.apportion([], 3) == [] and mixing.apportion([0.0], 3) == [0]


def test_op10_mix(spark, docs):
    rows = Q.QUERIES["op10_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, Q.QUERIES["op10_mixing"](spark, SF).collect()))
    source = {r.doc_id: r.source for r in common.read_table(spark, SF, "documents").select("doc_id", "source").collect()}
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(docs[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    assert target == pytest.approx(mixing.targets(dict(size)))
    assert all(r.source_size == size[source[r.doc_id]] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 64 + 0.05 * target[s] for s in target)
    whole = mixing.apply_mix(common.read_table(spark, SF, "documents"))
    per = {r.doc_id: r.n for r in whole.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(common.WORD))).alias("n")).collect()}
    assert per == {r.doc_id: r.taken for r in rows if r.taken}


def test_op10_more_cells_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 100, raising=False)  # the bound that there was
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 200)) AS text", "nullif(concat('s', id % 7), 's6') AS source")
    size = collections.Counter()
    for r in docs.collect():
        size[r.source] += len(r.text.split())
    got = mixing.mix(docs).collect()
    assert len(got) == 3000 and {r.source_size for r in got} == set(size.values())
    assert sorted({r.target for r in got}) == pytest.approx(sorted(set(mixing.targets(dict(size)).values())))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs, max_broadcast=0).collect()))


def test_op10_documents_stay_whole(spark):
    text = "concat_ws(' ', transform(sequence(1, int(100 + id % 300)), i -> concat('d', id, 'w', i))) || '\n'"
    docs = spark.range(2000).selectExpr("id AS doc_id", f"{text} AS text", "if(id % 10 = 0, 'small', 'hot') AS source", "id AS n_chars")
    whole = {r.doc_id: r.text for r in docs.collect()}
    cut = [r for r in mixing.apply_mix(docs).collect() if r.text != whole[r.doc_id]]
    assert all(whole[r.doc_id].startswith(r.text) and whole[r.doc_id][len(r.text)] == " " and r.n_chars == len(r.text) for r in cut)
    assert 0 < len(cut) <= 2 * mixing.MixPlan().min_shards  # one for each source and shard at most


CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_words int, slot int, kept boolean, _row int, h int, size int, _quality string"
LONG = "very long text of words " * 4000


def edge_docs(spark):
    data = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", 10), (4, LONG, "en", None, 10), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
        (6, "x y", None, "b", 3), (None, "no id here at all", "en", "b", 3), (None, None, None, None, None), (7, " \n\t ", "en", "b", 3), (8, "ünï ☃ code\n\nline", "de", "ü", 4),
    ]
    return spark.createDataFrame([(*r, 1, 2, True, 3, 4, 5, "q") for r in data], CLASH)


BENCH = [(1, "very long text of words very long text of words very long text"), (1, "one"), (None, "x y"), (3, None), (4, "  ")]
LABELS = [(2, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (99, 1, 0)]


def every_operator(spark, docs):
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    anyone = F.lit(True)
    yield "lines", line_dedup.clean(docs), docs.columns
    yield "shards", sharding.shard_documents(docs), None
    yield "lm", language_model.score_texts(docs, F.lit(False)), None
    yield "report", decontamination.report(docs, bench), None
    yield "quality", quality_rules.judge(docs), None
    yield "toxicity", toxicity.classify(docs, labels, anyone), None
    yield "classifier", quality_classifier.classify(docs, labels, anyone), None
    yield "near", near_dedup.near_duplicates(docs), None
    yield "mix", mixing.mix(docs), None


def test_edge_rows_in_every_operator(spark):
    docs = edge_docs(spark)
    for name, df, columns in every_operator(spark, docs):
        assert df.count() == docs.count(), name
        assert columns is None or df.columns == columns
    path = common.scratch(spark, "edge-tokens")
    P = pytest.importorskip("public_tokenizers")
    token_output.write_tokens(docs, str(P.path("word_bpe_49k.json")), path)
    assert token_output.checksums(token_output.read_tokens(spark, path)).count() == docs.count()


def test_edge_values(spark):
    docs = edge_docs(spark)
    near = [(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dedup.near_duplicates(docs).collect()]
    assert (4, 3, False, 5) in near and (3, 3, True, 5) in near and near.count((5, 5, True, 1)) == 2 and (None, None, True, 1) in near and (1, 1, True, 0) in near
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 6, 7, 8]
    bench = spark.createDataFrame(BENCH, "item_id int, text string")
    dirty = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.report(docs, bench).collect()}
    assert dirty[3] == (19_998, 1, True) and dirty[5] == (1, 1, True) and dirty[6] == (2, 1, True) and dirty[2] == (0, 0, False)
    shuffled = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.report(docs, bench, max_broadcast=0).collect()}
    assert shuffled == dirty
    assert sorted(r.doc_id or 0 for r in decontamination.drop_contaminated(docs, bench).collect()) == [0, 0, 1, 2, 7, 8]
    assert mixing.apply_mix(docs).columns == docs.columns and quality_rules.keep_good(docs).columns == docs.columns


def test_empty_tables(spark):
    empty = edge_docs(spark).where("false")
    for name, df, _ in every_operator(spark, empty):
        assert df.count() == 0, name
    no_bench = spark.createDataFrame([], "item_id int, text string")
    assert decontamination.report(edge_docs(spark), no_bench).where("contaminated").count() == 0


def test_pipeline_on_whole_table_and_edges(spark, tmp_path):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    first = [tuple(r) for r in out.collect()]
    assert 0 < len(first) and sorted(first, key=str) == sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=str)
    edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # all are short or repeat themselves


def test_sample_is_bounded(spark):
    docs = common.read_table(spark, SF, "documents")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert linear.labelled_sample(docs, labels, "toxic", F.lit(True), 10).count() == 10


@pytest.mark.parametrize("word", ["A" * 1_000_000, "7" * 1_000_000, "z" * 1_000_000, "Ab!" * 333_333, "A!" * 500_000, "#|" * 500_000])
def test_a_word_of_a_megabyte_is_read_in_linear_time(spark, word):
    df = spark.createDataFrame([(1, f"7 word {word} end!! {word} {word}\n{word}"), (2, "SOME WORDS!! HERE!! x")], "doc_id long, text string")
    one = line_dedup.lines_of(df.limit(0))  # the session is warm
    quality_rules.with_features(df.where("doc_id = 2"), "q").collect()
    one.collect()
    began = time.time()
    lines = line_dedup.lines_of(df).collect()
    between = time.time()
    features = {r.doc_id: r.q for r in quality_rules.with_features(df, "q").select("doc_id", "q").collect()}
    assert between - began < 10 and time.time() - between < 10
    assert [x if len(x) < 100 else "long" for x in lines[0].tokens] == ["<*>", "word", "<*>" if "7" in word else "long", "end!!", *["<*>" if "7" in word else "long"] * 2]
    assert features[1].n_words == 7 and features[1].n_shouts == 0 and features[2].n_shouts == 2 and features[1].n_stutters == 1


def shouts(text):
    """Words with two capitals and later two exclamation marks before any small letter, one by one."""
    n = 0
    for w in WORD.findall(text):
        head = re.match("[^a-z]*", w)[0]
        pair = re.search("[A-Z][A-Z]", head)
        n += bool(pair and "!!" in head[pair.end() :])
    return n


def test_op6_shouts_by_hand(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("AB!!a 9é"), 60)) for _ in range(400)] + ["AB!!", "AB!", "!!AB", "AAA!!x", "aAB!!", "!AB9!!!", "A!B!!AB!!", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.q.n_shouts for r in quality_rules.with_features(df, "q").collect()}
    assert [got[i] for i in range(len(texts))] == [shouts(t) for t in texts]
