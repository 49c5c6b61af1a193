"""WARC archives, the Merkle manifest and the prefix trie against brute-force versions, on edge rows and skewed ones."""

import collections
import gzip
import hashlib
import io
import os
import random
import zlib
from zlib import crc32

import pytest

from quirelake.llm import common, merkle, trie, warc

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, verified string, DIGEST int"
LONG = "<p>" + "word " * 30


def pages(spark):
    rows = [(9, "http://a/1", LONG), (4, "http://a/2", LONG), (4, "http://a/2", LONG), (7, "http://b/\r\nX: y", LONG + "é"), (3, None, None), (None, "u", LONG), (5, "", ""), (6, "x", "short"), (2, "x", "short"), (None, None, LONG * 2), (None, None, LONG * 2)]
    rows += [(100 + i, f"http://c/{i}", LONG * 3) for i in range(300)] + [(1, "http://long", "\r\n\r\nWARC/1.1\r\n" * 200_000), (8, "z", "a" * 100), (10, "z", "a" * 100), (11, "z", "b" * 99), (12, "z", "b" * 99)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGE), rows


def brute_pages(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        to = None if to == page else to
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_warc_round_trip_with_edge_rows(spark):
    df, rows = pages(spark)
    path = common.scratch(spark, "warc-test")
    files = warc.write_warc(df.repartition(3), path, file_mb=0)
    got = warc.read_warc(files).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_pages(rows)
    assert all(r.verified and r.error is None for r in got)
    want = collections.Counter((p, (h or "").encode()) for p, _, h in rows)
    assert all((r.page_id, bytes(r.payload)) in want for r in got if r.record_type == "response") and all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.target_uri for r in got if r.page_id == 7} == {"http://b/%0D%0AX:%20y"} and {r.target_uri for r in got if r.page_id == 3} == {"urn:page:3"}
    assert files.agg({"records": "sum"}).first()[0] == len(rows) and files.count() == len(rows)  # a new file as soon as one is full
    assert warc.dangling(common.materialize(warc.read_warc(files), "read")).count() == 0


def test_warc_verdicts_are_the_same_without_a_broadcast(spark):
    df, _ = pages(spark)
    some = [warc.with_verdicts(df, max_rows=n).drop("payload").collect() for n in (500_000, -1)]
    assert collections.Counter(some[0]) == collections.Counter(some[1]) and any(r.revisit for r in some[0])


def archive(spark, html):
    files = warc.write_warc(spark.createDataFrame([(i, f"http://a/{i}", h, "", 1) for i, h in enumerate(html)], PAGE).coalesce(1), common.scratch(spark, "warc-test"))
    return files, files.first().path


def test_warc_has_a_gzip_member_for_each_record_and_is_framed(spark):
    _, path = archive(spark, [LONG, LONG, "x"])
    data = open(path, "rb").read()
    members = []
    while data:
        z = zlib.decompressobj(31)
        members.append(z.decompress(data))
        data = z.unused_data
    assert [m.split(b"\r\n")[1] for m in members] == [b"WARC-Type: warcinfo", b"WARC-Type: response", b"WARC-Type: revisit", b"WARC-Type: response"]
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    for m in members:
        head, _, rest = m.partition(b"\r\n\r\n")
        assert int(head.rpartition(b"Content-Length: ")[2]) == len(rest) - 4
    assert b"Refers-To-Page-ID: 0" in members[2] and b"identical-payload-digest" in members[2] and LONG.encode() not in members[2]


def test_warc_reader_tells_wrong_digests_and_torn_files(spark):
    _, path = archive(spark, [LONG, "other " * 40, "x"])
    data = open(path, "rb").read()
    members, at = [], 0
    while at < len(data):
        z = zlib.decompressobj(31)
        members.append(z.decompress(data[at:]))
        at = len(data) - len(z.unused_data)
    changed = b"".join(gzip.compress(m.replace(b"other ", b"0ther ", 1)) for m in members)
    read = list(warc.records(io.BytesIO(changed), True))
    assert [r["error"] for r in read] == [None, "block digest, payload digest", None]
    for bad in (data[:-9], gzip.compress(members[1][:-4]), gzip.compress(members[1] + b"x"), gzip.compress(members[1].replace(b"Content-Length", b"Content-Width")), b"no gzip", gzip.compress(b"\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))
    whole = list(warc.records(io.BytesIO(data)))
    assert len(whole) == 3 and list(warc.records(io.BytesIO(b""))) == []
    # files in a table: strict ends the job, else a row says so and the rest is read
    torn = common.scratch(spark, "warc-torn")
    os.makedirs(torn)
    open(f"{torn}/a.warc.gz", "wb").write(data[:-9])
    both = spark.createDataFrame([(f"{torn}/a.warc.gz",), (path,)], "path string")
    rows = warc.read_warc(both, payloads=False, strict=False).collect()
    assert len(rows) == 6 and sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception, match="ends inside a member"):
        warc.read_warc(both, payloads=False).collect()


def test_warc_members_longer_than_a_piece_are_read_once_each(spark):
    rng = random.Random(5)
    long = ["".join(rng.choices("abcdefgh <>", k=n)) for n in (10, 600_000, 200, 262_144, 300_000, 7, 1_500_000, 40)]
    html = [*long, *(f"<p>{i} " * (i * 4000) for i in range(12)), *(LONG + str(i) for i in range(50))]
    files, path = archive(spark, html)
    assert files.count() == 1
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["error"]) for r in warc.records(open(path, "rb"))]
    assert got == [(i, len(h), hashlib.sha256(h.encode()).hexdigest(), None) for i, h in enumerate(html)]
    assert warc.read_warc(files, payloads=False).where("verified").count() == len(html)


def test_warc_revisits_without_a_response_are_told(spark):
    found = spark.createDataFrame([(1, 5, "d", "response", None), (2, 5, "d", "revisit", 1), (3, 5, "e", "revisit", 1), (4, 5, "d", "revisit", 9)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    for n in (500_000, -1):
        assert {r.page_id for r in warc.dangling(found, n).collect()} == {3, 4}


def test_empty_tables(spark):
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGE), common.scratch(spark, "warc-test"))).count() == 0
    assert merkle.manifest(spark.createDataFrame([], "source string, doc_id long, leaf binary, more long"), ["more"]).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """The root, and for each leaf the digests beside its way up."""
    level, proofs, where = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(where):
            run = level[at - at % 3 : at - at % 3 + 3]
            proofs[i] += run[: at % 3] + run[at % 3 + 1 :]
        where = [at // 3 for at in where]
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute_manifest(rows):
    """rows: (source, doc_id, leaf)."""
    by = collections.defaultdict(list)
    for source, doc, leaf in rows:
        by[source].append((doc is not None, doc, leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([leaf for _, _, leaf in sorted(by[s])]) for s in order]
    root, above = brute_tree([t[0] for t in trees])
    out = []
    for s, (sub, proofs), up in zip(order, trees, above):
        for (_, doc, leaf), proof in zip(sorted(by[s]), proofs):
            out.append((doc, leaf, sub, root, "".join(proof + up)))
    return sorted(out, key=str)


@pytest.mark.parametrize("band", [1, 2, 6])
def test_merkle_manifest_equals_brute_force(spark, band):
    rng = random.Random(band)
    sizes = {"hot": 90, None: 7, "": 1, "a": 3, "Z": 4, "é": 10, "a-b": 28, "one": 1}
    rows = [(s, rng.choice([None, *range(1000)]), h(str(rng.random()))) for s, n in sizes.items() for _ in range(n)]
    rows += [("rep", 5, h("same"))] * 5 + [("rep", 5, h("other"))]
    df = spark.createDataFrame([(s, d, bytes.fromhex(x), i) for i, (s, d, x) in enumerate(rows)], "source string, doc_id long, leaf binary, more long")
    proofs = common.materialize(merkle.manifest(df, ["more"], band), "proofs")
    got = proofs.collect()
    assert sorted(((r.doc_id, *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof"))) for r in got), key=str) == brute_manifest(rows)
    assert sorted(r.more for r in got) == list(range(len(rows)))
    folded = merkle.with_folded_root(proofs, ["more", "root"]).collect()
    assert {r.folded_root for r in folded} == {bytes(r.root).hex() for r in folded} and len(folded) == len(rows)


def test_merkle_single_leaf_and_single_source(spark):
    for n in (1, 2, 3, 4, 9, 10):
        rows = [("s", i, h(str(i))) for i in range(n)]
        df = spark.createDataFrame([(s, d, bytes.fromhex(x)) for s, d, x in rows], "source string, doc_id long, leaf binary")
        got = merkle.manifest(df, [], 1).collect()
        assert sorted(((r.doc_id, *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof"))) for r in got), key=str) == brute_manifest(rows)


def test_merkle_sweeps_move_any_change_to_the_root():
    leaves = [h(str(i)).encode() for i in range(25)]
    made = merkle.sweep(leaves, 0, 3)
    given = merkle.suffixes(made, 3, b"")
    assert made[3, 0].decode() == brute_tree([x.decode() for x in leaves])[0]
    for i, leaf in enumerate(leaves):
        assert merkle.fold(leaf, [(i, 25)], given[0, i]) == made[3, 0] != merkle.fold(h("no").encode(), [(i, 25)], given[0, i])
        assert merkle.fold(leaf, [((i + 1) % 25, 25)], given[0, i]) != made[3, 0]


def test_op12_leaves_by_hand(spark, tmp_path):
    rows = [(4, None, "en", 3, "a\nb"), (None, "é", None, None, None), (7, "é", "", 0, ""), (8, "é", "x", 1, "\n\n" + "w" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, root string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()}
    leaf = {r[0]: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)) for r in rows}
    assert {d: r.leaf for d, r in got.items()} == leaf
    sub = h(leaf[None], leaf[7], leaf[8])
    root = h(leaf[4], sub)
    assert {(r.subroot, r.root) for r in got.values()} == {(leaf[4], root), (sub, root)}
    assert got[4].proof_sha256 == h(sub) and got[7].proof_sha256 == h(leaf[None], leaf[8], leaf[4])
    for r in rows:
        changed = crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")
        assert got[r[0]].verified is not changed and (got[r[0]].folded_root == root) is not changed


def brute_trie(rows):
    """rows: (conv_id, turn, role, text); the nodes as in the contract."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn, key, (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        n = crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(int(c / 100) * 100, [])[:n] + mine[n:])  # the remainder has c's sign, as in SQL
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def random_conversations(seed):
    rng, rows = random.Random(seed), []
    for c in range(90, 330):
        if c % 100 or rng.random() < 0.7:
            rows += [(c, rng.choice([t, t, None, 1]) if c % 7 == 0 else t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", None, "", "é" * 3])) for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", "same") for c in range(1000, 1080) for t in range(4)]  # copies
    rows += [(c, t, "u", f"{t}") for c in (2000, 2001) for t in range(70)] + [(2000, 70, "u", "on"), (2100, 0, "u", "w " * 200_000)]
    rows += [(None, 1, "u", "lost"), (3001, 5, "u", "alone"), (-205, 1, "u", "minus"), (-205, 1, "u", "minus"), (-200, 0, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [3, 1024])
def test_prefix_trie_equals_brute_force(spark, chunk, monkeypatch):
    rows = random_conversations(chunk)
    if chunk == 3:  # and without any broadcast but of hot keys
        monkeypatch.setattr(common, "fits_broadcast", lambda *a, **k: False)
        monkeypatch.setattr(trie.prefixes, "__defaults__", (3,))
        monkeypatch.setattr(trie, "TEXT", 20)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, depth string, N_CONVS int")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(df).collect()), key=str)
    assert got == brute_trie(rows)


def test_subtree_totals_of_random_forests(spark):
    rng, rows, parent = random.Random(5), [], {}
    at = [(i, 0) for i in range(3)]
    for n in range(3, 400):
        up = at[-1] if rng.random() < 0.6 else rng.choice(at)  # long chains with twigs
        at.append((n, up[1] + 1))
        parent[n] = up[0]
    total = {c: c for c, _ in at}
    for c, _ in sorted(at, key=lambda x: -x[1]):
        if c in parent:
            total[parent[c]] += total[c]
    # a node's id is (conv_id, depth), and its parent's depth is one less
    rows = [(c, d, parent.get(c), c) for c, d in at]
    got = trie.subtree_totals(spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, v long"), ["v"]).collect()
    assert {r.conv_id: r.v for r in got} == total and len(got) == len(rows)


def test_ranked_places_equal_rows_and_nulls(spark):
    rows = [("a", None), ("a", 3), ("a", 3), ("b", 1), ("a", 1), *(("hot", i % 50) for i in range(500))]
    got = common.ranked(spark.createDataFrame(rows, "g string, v int").repartition(4), "g", ["v"], "ranked").collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.idx):
        by[r.g].append(r.v)
        assert r["size"] == sum(x[0] == r.g for x in rows)
    assert {g: sorted(r.idx for r in got if r.g == g) == list(range(len(v))) for g, v in by.items()} == {"a": True, "b": True, "hot": True}
    assert by["a"] == [None, 1, 3, 3] and by["hot"] == sorted(i % 50 for i in range(500))
