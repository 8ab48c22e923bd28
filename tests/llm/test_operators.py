"""Each operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import base64
import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from coordspark.llm import common, decontam, exact, langid, lines, mixing, planes, secrets, sharding, simhash, warc
from coordspark.llm.components import connected
from coordspark.llm.queries import END_ID, tokenizer_path

LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(6000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the wall for a long time."),
    (2, "the CAT sat on the mat and looked at the wall for a long time."),
    (3, "The cat sat on the mat and looked at the wall for a long time"),
    (4, None),
    (5, ""),
    (6, " \t\n"),
    (7, "one"),
    (8, "one two"),
    (9, LONG),
    (10, LONG + " end"),
    (11, "The  cat sat\non the mat and looked at the wall for a long time."),
    (None, "a row without a number"),
    (12, "dup"),
    (12, "dup"),
    (13, "Ünïcode ß text — with ﬁne “quotes” 日本語 and emoji 🙂"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if n % 3 else None, f"s{n % 2}" if n % 5 else None, len(t or ""), "x", 0) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, version int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def print_of(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    links = {frozenset(e) for e in edges}
    want = components({x for e in edges for x in e}, lambda a, b: frozenset((a, b)) in links)
    assert got == want
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprints(docs, none):
    got = Counter((r.doc_id, simhash.signed(print_of(r.text, 3)) == r.fp) for r in docs.select("doc_id", "text", simhash.fingerprint().alias("fp")).collect())
    assert got == Counter((i, True) for i, _ in TEXTS)
    found = simhash.near_duplicates(docs).collect()
    prints = {simhash.signed(print_of(t, 3)) for _, t in TEXTS}
    near = components(prints, lambda a, b: (a ^ b & (1 << 64) - 1).bit_count() <= 2 if a >= 0 and b >= 0 else bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    least = defaultdict(list)
    for i, t in TEXTS:
        if i is not None:
            least[near[simhash.signed(print_of(t, 3))]].append(i)
    want = Counter((i, min(least[near[simhash.signed(print_of(t, 3))]], default=None)) for i, t in TEXTS)
    assert Counter((r.doc_id, r.component_id) for r in found) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket", [1, 4, 64])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_of_dense_groups(spark, bucket, bits):
    """A crowd around one fingerprint, in every way of meeting."""
    random = np.random.default_rng(bits)
    centres = [int(x) for x in random.integers(0, 1 << 62, 3)]
    prints = {simhash.signed(c ^ sum(1 << int(b) for b in random.choice(64, int(random.integers(0, 5)), replace=False))) for c in centres for _ in range(60)}
    apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.links(frame, bits, bucket)
    assert all(apart(r.u, r.v) <= bits for r in edges.collect())
    got = {p: p for p in prints} | {r.node: r.root for r in connected(edges).collect()}
    assert got == components(prints, lambda a, b: apart(a, b) <= bits)


def test_near_dedup(spark, docs, none):
    base = [f"w{i}" for i in range(200)]
    edited = base[:100] + ["other"] + base[101:]
    far = base[:50] + [f"x{i}" for i in range(150)]
    rows = [(1, " ".join(base)), (2, " ".join(edited)), (3, " ".join(far)), (4, " ".join(base)), (4, " ".join(base)), (None, " ".join(base)), (9, None), (8, "")]
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 8]
    twice = simhash.dedup(spark.createDataFrame([(5, "same old text"), (5, "same old text")], "doc_id long, text string"))
    assert twice.count() == 1
    assert simhash.dedup(docs).columns == docs.columns and simhash.dedup(none).count() == 0


def test_near_dedup_finds_the_hub_of_many_copies(spark):
    base = [f"w{i}" for i in range(240)]
    random = np.random.default_rng(4)
    texts = [" ".join(base)]
    for n in range(600):
        changed = {60 * k + int(at) for k, at in enumerate(random.integers(4, 56, 4))}
        texts.append(" ".join(f"x{n}.{i}" if i in changed else w for i, w in enumerate(base)))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    like = [(i, j) for i, j in itertools.combinations(range(601), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    assert {(0, j) for j in range(1, 601)} <= set(like) and len(like) < 0.2 * 601 * 300
    kept = simhash.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]


def test_near_dedup_of_long_texts_is_exact(spark):
    rows, want = [], set()
    for n in range(120):
        shared, own = 1000 * (82 if n % 2 else 78) // 100, 1000 * (9 if n % 2 else 11) // 100  # a union of 1,000
        w = [f"p{n}.{i}" for i in range(shared + own + 4)]
        a, b = w, w[: shared + 4] + [f"q{n}.{i}" for i in range(own)]
        x, y = (set(simhash.shingle_hashes(" ".join(t), 5).tolist()) for t in (a, b))
        assert (len(x & y) / len(x | y) >= 0.8) == (n % 2 == 1) and len(x | y) == 1000
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        want |= {2 * n} if n % 2 else {2 * n, 2 * n + 1}
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == want


def test_near_dedup_against_brute_force(spark, monkeypatch):
    """1,000 texts, 600 of them edits of 30 bases that share boilerplate, others close to but below the limit; once
    more with every lookup by shuffle, so that crowded keys are split."""
    random = np.random.default_rng(11)
    boilerplate = [f"b{i}" for i in range(60)]
    texts = []
    for n in range(1000):
        base = [f"f{n % 30 if n < 600 else n}.{i}" for i in range(90)] + boilerplate
        for at in random.integers(0, len(base), int(random.integers(0, 6))):
            base[at] = f"e{n}.{at}"
        texts.append(" ".join(base))
    texts += [texts[0]] * 50 + ["", "one"] * 5
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = components(range(len(texts)), alike)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set(root.values())
    got = {r.doc_id for r in simhash.dedup(frame).collect()}
    assert want <= got  # nothing that is alone goes
    assert len(texts) - len(got) >= 0.98 * (len(texts) - len(want))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common.fits, "__defaults__", (0,))
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    assert {r.doc_id for r in simhash.dedup(frame).collect()} == got


@pytest.mark.parametrize("n", [1, 1 << 20, 1 << 23, 1 << 27, 1 << 40])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_rings_of_any_size_find_all_pairs(bits, n):
    random = np.random.default_rng(bits)
    ring = simhash.Ring.for_count(bits, n)
    assert ring.equal * bits // len(ring.segments) == 0 and sum(w for _, w in ring.segments) == 64
    for _ in range(200):
        a = int(random.integers(0, 1 << 62))
        apart = sum(1 << int(b) for b in random.choice(64, bits, replace=False))
        starts = [i for i, mask in ring.keys() if not apart & mask]
        m = len(ring.segments)
        chain = lambda i, length: bin(apart & ring.mask(i, length)).count("1")
        assert any(all(chain(i, k) <= k * bits // m for k in range(1, m + 1)) for i in starts), a


def test_matched_splits_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(common.fits, "__defaults__", (0,))
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    keys = [None, *[7] * 500, *range(50), *[8] * 300, *[99] * 200]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(60)], "k int, v string")
    for how in ("inner", "left"):
        met = common.matched(rows, one, ["k"], 20, how)
        want = [(k, i, f"v{k}" if k is not None and k < 60 else None) for i, k in enumerate(keys)]
        want = [w for w in want if how == "left" or w[2]]
        assert sorted(map(tuple, met.collect()), key=str) == sorted(want, key=str)
        salts = met._jdf.queryExecution().logical().toString().count("_salt")
        assert salts and "_salt" not in met.columns


def test_merges_against_brute_force():
    random = np.random.default_rng(5)
    for _ in range(20):
        bases = [random.permutation(400)[:60] for _ in range(4)]
        sets = [np.unique(np.r_[random.permutation(bases[n % 4])[: random.integers(45, 61)], random.integers(400, 10**6, random.integers(0, 9))]) for n in range(60)] + [np.empty(0, np.int64)] * 2
        start = {tuple(sorted(x)) for x in random.integers(0, 60, (10, 2)).tolist()}
        roots = components(range(62), lambda i, j: (i, j) in start)
        like = {(i, j) for i, j in itertools.combinations(range(62), 2) if len(u := np.union1d(sets[i], sets[j])) == 0 or len(np.intersect1d(sets[i], sets[j])) / len(u) >= 0.8}
        found = {(min(x), max(x)) for x in simhash._merges(sets, np.array([roots[i] for i in range(62)]), 0.8)}
        assert found <= like
        assert components(range(62), lambda i, j: (i, j) in start | found) == components(range(62), lambda i, j: (i, j) in start | like)


def test_exact_groups(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    got = exact.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, min(groups[norm(t)])[2] if not min(groups[norm(t)])[1] else None, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(n.encode()).hexdigest(): 1 for n in groups})
    assert exact.exact_groups(none).count() == 0


def test_counting_quotient_filter():
    random = np.random.default_rng(1)
    parts = [random.integers(0, 1 << 20, 3000).astype(np.uint64) * np.uint64(1 << 40) for _ in range(3)]
    filters = [exact.CountingQuotientFilter.of(60, p) for p in parts]
    again = [exact.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters]
    merged = again[0].merge(*again[1:])
    assert Counter(dict(zip(merged.values.tolist(), merged.counts.tolist(), strict=True))) == Counter(np.concatenate(parts).tolist())
    empty = exact.CountingQuotientFilter.of(60, np.empty(0, np.uint64))
    assert len(exact.CountingQuotientFilter.from_bytes(empty.to_bytes()).values) == 0


def test_shards(spark, docs, none, sf):
    got = sharding.shard_documents(docs, shards=3).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard_documents(none).count() == 0
    whole = sharding.shard_documents(spark.read.parquet(f"{sf}/documents.parquet")).groupBy("shard").sum("size").collect()
    loads, largest = [r[1] for r in whole], 40_000
    assert len(loads) == 16 and max(loads) - min(loads) < largest


def test_slot_map_edits_are_few():
    weight = {(s, -1): 100 + s % 7 for s in range(4096)}
    first = sharding.SlotMap.initial(sorted(weight), 16).rebalanced(weight)
    grown = dict(weight)
    grown[(5, -1)] += 5000
    second = first.rebalanced(grown)
    moved = sum(first.shard_of[u] != second.shard_of[u] for u in weight)
    loads = Counter()
    for u, w in grown.items():
        loads[second.shard_of[u]] += w
    assert 0 < moved < 120 and second.version == first.version + 1 and max(loads.values()) - min(loads.values()) < 200
    wider = second.rebalanced(grown, shards=17)
    assert all(wider.shard_of[u] == 16 for u in weight if wider.shard_of[u] != second.shard_of[u])


def test_a_stored_slot_map_is_edited(spark):
    path = common.new_path(spark, "map")
    rows = [(i, "x" * (50 + i % 90)) for i in range(4000)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.doc_id: r for r in sharding.shard_documents(frame(rows), 8, 256, path).collect()}
    assert {r.map_version for r in first.values()} == {2}
    grown = rows + [(10_000 + i, "y" * 300) for i in range(400)]
    second = {r.doc_id: r for r in sharding.shard_documents(frame(grown), 8, 256, path, stored=True).collect()}
    assert {r.map_version for r in second.values()} == {3}
    moved = {r.virtual_slot for i, r in first.items() if second[i].shard != r.shard}
    assert len(moved) < 40
    edits = spark.read.parquet(f"{path}/edits").where("version = 3").collect()
    assert {e.slot for e in edits} >= moved
    loads = Counter()
    for r in second.values():
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 3000
    wider = {r.doc_id: r for r in sharding.shard_documents(frame(grown), 9, 256, path, stored=True).collect()}
    assert all(r.shard == 8 for i, r in wider.items() if r.shard != second[i].shard) and any(r.shard == 8 for r in wider.values())
    # a slot that grows hot is split where it was, and all rows are placed independently of how they were read
    crowd = sharding.shard_documents(frame(grown + [(1, "z" * 200)] * 6000), 9, 256, path, stored=True).collect()
    loads = Counter()
    for r in crowd:
        loads[r.shard] += r["size"]
    assert len(crowd) == len(grown) + 6000 and max(loads.values()) < 1.2 * min(loads.values())
    assert map_versions(spark, path) == [1, 2, 3, 4, 5]


def map_versions(spark, path):
    return sorted(r[0] for r in spark.read.parquet(f"{path}/map").select("version").distinct().collect())


def test_exact_groups_of_string_ids_and_crowds(spark, monkeypatch):
    monkeypatch.setattr(common.fits, "__defaults__", (0,))
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    rows = [(f"d{i:03}", "a  b" if i == 40 else "a b" if i < 120 else f"t{i}") for i in range(200)] + [(None, "t150"), ("d151", "t151")]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter(
        (i, "d040" if t.startswith("a") else t.replace("t", "d"), 120 if t.startswith("a") else 2 if t in ("t150", "t151") else 1) for i, t in rows
    )
    assert sum(r.kept for r in got) == 81


def test_hot_slot_is_split(spark):
    rows = spark.createDataFrame([(7, "x" * 9000)] * 300 + [(i, "y" * 500) for i in range(600)], "doc_id long, text string")
    loads = [r[1] for r in sharding.shard_documents(rows, shards=4).groupBy("shard").sum("size").collect()]
    assert max(loads) - min(loads) < 10_000


SECRETS = [
    (1, "user = bob here\npassword: hunter2hunter2 and https://db.example.com:5432/x"),
    (2, "key " + "Ab1/" * 10 + " alone"),
    (3, "account: ops-team then " + "Ab1/" * 10 + " near"),
    (4, "AKIA" + "A1" * 8 + " " + "deadbeef" * 3 + " Token='abc' secret=\"abcdef\""),
    (5, "AKIA" + "A1" * 4 + " " + "deadbeef" * 2),
    (6, None),
    (7, "password=password=password=x SECRET : tok€n token=" + "é" * 3 + " 🙂 api-key api_key:'abcdefg'"),
    (8, "login: amy" + " z" * 600 + " " + "Ab1/" * 10),
    (9, ("token=abcdef12 " * 300)),
]


def brute_spans(text):
    t = text or ""
    found = []
    for n, pattern, group, least in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        found += [(m.start(), ("assign", "access", "hex").index(n), f"{n}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t) if len(m[group]) >= least]
    return [s for _, _, s in sorted(found)]


def test_secrets(spark, docs, none, sf):
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for frame in (spark.createDataFrame(SECRETS, "doc_id long, text string"), docs, whole):
        texts = Counter((r.doc_id, ",".join(brute_spans(r.text))) for r in frame.collect())
        rows = secrets.digest(secrets.scan(frame)).collect()
        base = lambda r: ",".join(s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert Counter((r.doc_id, base(r)) for r in rows) == texts
        for r in rows:
            assert r.base_sha256 == hashlib.sha256(base(r).encode()).hexdigest()
            kinds = Counter(s.split(":")[0] for s in r.spans.split(","))
            assert (kinds["assign"], kinds["access"], kinds["hex"]) == (r.n_assign, r.n_access, r.n_hex)
    assert secrets.scan(none).count() == 0


def test_linked_credentials(spark):
    rows = {r.doc_id: {s.split(":")[0] for s in r.spans.split(",")} for r in secrets.digest(secrets.scan(spark.createDataFrame(SECRETS, "doc_id long, text string"))).collect()}
    assert {"ident", "endpoint", "assign"} <= rows[1]
    assert not rows[2] & {"ident", "opaque", "endpoint"}
    assert {"ident", "opaque"} <= rows[3]
    assert not rows[8] & {"ident", "opaque"}  # too far apart


def test_warc(spark):
    html = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (4, None, None), (5, "u", ""), (6, "u", "é🙂"), (6, "u", "é🙂"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    path = warc.write_archives(pages, rows_per_file=2)
    records = warc.read_records(spark, path)
    assert Counter(r.kind for r in records.select("kind").collect()) == {"request": 8, "metadata": 8, "response": 4, "revisit": 4}
    captures = warc.assemble(records)
    nested = captures.collect()
    assert len(nested) == 8 and all(len(r.request) == 1 and len(r.metadata) == 1 and r.response for r in nested)
    assert Counter(bytes(r.response.payload).decode() for r in nested if r.response.kind == "response") == Counter({"<p>x</p>", "a\r\n\r\nWARC/1.1\r\n\r\nb", "", "é🙂"})
    last = {}
    for i, _, h in html:
        last[h or ""] = max(last.get(h or "", -1), i if i is not None else -1)
    digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.page_rows(captures).collect())
    assert got == Counter((i, len((h or "").encode()), digest(h or "")) for i, _, h in html)
    refs = {(r.page_id, r.refers_to) for r in warc.page_rows(captures).collect() if r.record_type == "revisit"}
    assert refs == {(1, 2), (4, 5), (6, 6), (None, 2)}
    assert warc.page_rows(warc.assemble(warc.read_records(spark, warc.write_archives(pages.where("false"))))).count() == 0


def test_warc_pieces():
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d"
    bodies = [b"", b"\r\n\r\n", b"x", b"a\r\n\r\nb", b"\r\n\r\n\r\n\r\n", b"WARC/1.1\r\n\r\n"]
    data = b"".join(head % (i, len(b)) + b"\r\n\r\n" + b + b"\r\n\r\n" for i, b in enumerate(bodies))
    pieces = data.split(b"\r\n\r\n")[:-1]  # a reader of lines gives none after the last separator
    assert [r[0] for r in warc.parse(pieces, True)] == [f"<{i}>" for i in range(len(bodies))]
    for wrong in (pieces[:-1], [*pieces[:6], *pieces[7:]], [b"HTTP/1.1 200 OK"]):
        with pytest.raises(ValueError):
            list(warc.parse(wrong, True))


def test_warc_of_long_pages_and_clashing_columns(spark):
    rows = [(1, "u", "x" * 3_000_000, "a"), (2, None, "y\r\n\r\n" * 200_000, "b"), (3, "u", "x" * 3_000_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").withColumn("row", F.lit(1))
    path = warc.write_archives(pages)
    got = sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.page_rows(warc.assemble(warc.read_records(spark, path))).collect())
    assert got == [(1, 3_000_000, 3), (2, 1_000_000, None), (3, 3_000_000, None)]
    # an archive of several gzip members is one stream
    import gzip

    folder = common.new_path(spark, "members").removeprefix("file://")
    os.makedirs(folder)
    head = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    with open(f"{folder}/x.warc.gz", "wb") as out:
        for i in range(5):
            out.write(gzip.compress(head % i))
    assert [r.record_id for r in warc.read_records(spark, "file://" + folder).collect()] == [f"<{i}>" for i in range(5)]


def test_assembly_by_any_direction(spark):
    rows = [("r1", "response", [], None), ("q1", "request", ["r1"], None), ("m1", "metadata", ["q1"], None), ("r2", "response", ["q2"], None), ("q2", "request", [], None), ("q3", "request", [], None)]
    frame = spark.createDataFrame(rows, "record_id string, kind string, concurrent_to array<string>, refers_to string")
    got = {r.capture_id: (r.response and r.response.record_id, [q.record_id for q in r.request], [m.record_id for m in r.metadata]) for r in warc.assemble(frame).collect()}
    assert got == {"r1": ("r1", ["q1"], ["m1"]), "r2": ("r2", ["q2"], []), "q3": (None, ["q3"], [])}


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_token_planes(spark, docs, none, plane):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    path = planes.write_tokens(docs, tokenizer_path(), END_ID, plane, block=512, shard_ids=3000)
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [END_ID])) for i, t in TEXTS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in planes.ids_of(spark, path).collect()) == want
    rows = sorted(planes.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == list(itertools.accumulate([0, *(r.n_tokens for r in rows[:-1])]))
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    assert Counter((r.doc_id, r.ids_crc32) for r in rows) == Counter((i, zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in want.elements())
    assert planes.read_tokens(spark, planes.write_tokens(none, tokenizer_path(), END_ID)).count() == 0


def test_word_cache_is_exact(spark, sf):
    from tokenizers import Tokenizer

    whole, cache = Tokenizer.from_file(tokenizer_path()), planes.WordCache(tokenizer_path(), limit=500)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["don't I'LL  we've'd", "ΣΑΣ İstanbul ﬁ Å é̂ x́ ́y", "a b　c\x1cd\x85e", "<|endoftext|>x <|startoftext|>", "...!? ,,a,, 12,5. A.B. x.,", "日本語。テスト!", "퟿", "ǅ ŉ K ſ."]
    for t in texts:
        assert np.frombuffer(cache.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_blocks_round_trip(plane):
    import zstandard

    for ids in ([], [0], [1, 65535, 3], list(range(1000)), [2**32 - 1, 0]):
        ids = np.array(ids, "<u4")
        packed = planes.pack_block(ids, plane, zstandard.ZstdCompressor())
        assert np.array_equal(planes.unpack_block(packed, len(ids), plane, zstandard.ZstdDecompressor()), ids)


def test_decontamination(spark, none):
    random = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    item = [str(w) for w in random.choice(words, 40)]
    edited = [w if i % 8 else "changed" for i, w in enumerate(item)]
    filler = lambda n: [str(w) for w in random.choice(words, n)]
    rows = [
        (1, " ".join(filler(300) + item + filler(300))),
        (2, " ".join(filler(50) + edited + filler(50))),
        (3, " ".join(filler(700))),
        (4, " ".join(filler(50) + item[:8] + filler(50))),
        (5, None),
        (6, " ".join(w.upper() + "," for w in item)),
        (7, " ".join(item)),
        (7, " ".join(item)),
        (None, " ".join(item)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (10, "a text that no document holds"), (11, None), (12, "one two")], "item_id long, text string")
    nameless = spark.createDataFrame([(None, " ".join(item))], "item_id long, text string")
    big = spark.createDataFrame([(2**60 + 1, " ".join(item)), (None, " ".join(item))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(big, nameless).collect()} == {(2**60 + 1, None), (None, None)}
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (7, 10), (None, 10)} and got[1, 10] == 1.0
    assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [3, 4, 5]
    assert decontam.contaminated(none, bench).count() == 0 and decontam.clean(docs, bench.where("false")).count() == len(rows)


def test_decontamination_against_alignment_of_whole_texts(spark):
    random = np.random.default_rng(7)
    kinds = [(each, copies) for each in (4, 5) for copies in (0, 1, 5)]
    items = [[f"i{n}.{i}" for i in range(40)] for n in range(len(kinds))]
    edit = lambda w, each: [x if (i + 1) % each else f"changed{i}" for i, x in enumerate(w)]
    around = lambda w, n: [f"f{x}" for x in random.integers(0, 500, n)] + w + [f"f{x}" for x in random.integers(0, 500, n)]
    rows = []
    for n, (each, copies) in enumerate(kinds):
        rows += [around(edit(items[n], each), 30) for _ in range(3)] + [around(items[n], 20) for _ in range(copies)]
        rows.append(around(items[n][:19] + items[n - 1][20:39], 10))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    want = {}
    for n, w in enumerate(items):
        number = {x: i + 1 for i, x in enumerate(w)}
        best = decontam.smith_waterman(np.arange(1, 41), [np.array([number.get(x, 0) for x in row]) for row in rows])
        want |= {(i, n): b / 40 for i, b in enumerate(best.tolist()) if b >= 20}
    assert len(want) == 6 * 3 + 2 * (1 + 5)
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()} == want


def test_decontamination_recall_of_random_edits(spark):
    """Words changed, left out and put in at random, against Smith-Waterman over whole texts; and words that are
    everywhere, so that rare seeds have to be told from frequent ones."""
    random = np.random.default_rng(12)
    common_words = [f"c{i}" for i in range(12)]
    items = []
    for n in range(40):
        size = int(random.integers(3, 60))
        items.append([f"i{n}.{i}" if random.random() < 0.6 else common_words[int(random.integers(12))] for i in range(size)])
    rows = []
    for _ in range(400):
        item, rate, out = items[int(random.integers(40))], random.random() * 0.5, []
        for w in item:
            r = random.random()
            out += [w] if r > rate else [] if r < rate / 3 else ["put", w] if r < rate * 2 / 3 else ["changed"]
        pad = lambda: [common_words[int(i)] if i < 12 else f"f{i}" for i in random.integers(0, 60, int(random.integers(0, 40)))]
        rows.append(pad() + out + pad())
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    docs = docs.withColumn("version", F.lit("x")).withColumn("region", F.lit(1))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    want = {}
    for n, w in enumerate(items):
        number = {x: i + 1 for i, x in enumerate(dict.fromkeys(w))}
        best = decontam.smith_waterman(np.array([number[x] for x in w]), [np.array([number.get(x, 0) for x in row] + [0]) for row in rows])
        want |= {(i, n): b / len(w) for i, b in enumerate(best.tolist()) if 2 * b >= len(w)}
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) > 250 and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    long = {k for k in want if len(items[k[1]]) >= 12}
    assert len(got) >= 0.95 * len(want) and len(long & set(got)) >= 0.98 * len(long)
    bad = {i for i, _ in got}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == set(range(400)) - bad
    assert decontam.clean(docs, bench).columns == docs.columns


def test_decontamination_of_short_and_unspaced_items(spark):
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u5427"
    items = [(1, "Yes"), (2, "two\u00a0words"), (3, chinese), (4, "some\u3000ideographic\u00a0blanks between words"), (5, " "), (6, "!?")]
    long = "x " * 300_000 + "some ideographic blanks between words" + " y" * 1000
    rows = [
        (1, "yes!"), (2, "He said yes."), (3, "Two words"), (4, "two words more"), (5, f"\u524d{chinese}\u540e"), (6, None),
        (7, "and some ideographic\u2003blanks between words"), (8, long), (9, ""), (10, "!?"), (11, " "),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 4), (8, 4)}


def test_alignment_against_the_plain_table():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    random = np.random.default_rng(0)
    for _ in range(30):
        a = random.integers(1, 5, random.integers(1, 15))
        bs = [random.integers(0, 5, random.integers(1, 30)) for _ in range(4)]
        assert decontam.smith_waterman(a, bs).tolist() == [plain(a.tolist(), b.tolist()) for b in bs]


def test_lines(spark, docs, none):
    block = "\n".join(f"a shared line {i} \x01 of text" for i in range(12))
    rows = [(i, f"own {i}\nfirst {i}\n{block}\nlast {i}\nend {i * 7}\n") for i in range(1, 6)] + [(20, None), (21, ""), (22, "\n\n"), (30, block), (30, block)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in lines.dedup_lines(frame).collect():
        got[r.doc_id].append(r)
    assert got[1][0].text == rows[0][1] and got[20][0].text is None and got[21][0].text == "" and got[22][0].text == "\n\n"
    for i in range(2, 6):
        (r,) = got[i]
        assert r.removed_chunks > 0 and f"own {i}\n" in r.text and r.text.endswith(f"end {i * 7}\n")
        assert r.text == f"own {i}\nfirst {i}\nlast {i}\nend {i * 7}\n"  # the passage whole, and nothing else
        assert r.removed_bytes == len(rows[i - 1][1]) - len(r.text) == len(block) + 1 and r.removed_lines == 12
    assert len(got[30]) == 2 and got[30][0] == got[30][1] and got[30][0].text == block.split("\n")[0]
    assert {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()} == set(TEXTS)
    assert lines.dedup_lines(none).count() == 0


def lines_left(rows):
    """The rule of ``dedup_lines`` stated again, for distinct doc_ids."""
    hashed = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:7], 16)
    cut = {}
    for i, text in sorted(rows):
        ls = text.split("\n")
        h = [hashed(x) for x in ls]
        parts, at = [], 0
        for k in range(len(ls)):
            if k == len(ls) - 1 or 0 < k < len(ls) - 2 and h[k] < min(h[k - 1], h[k + 1]):
                parts.append(ls[at : k + 1])
                at = k + 1
        cut[i] = parts
    places = defaultdict(list)
    for i, parts in cut.items():
        for n, part in enumerate(parts):
            if len(part) > 1:
                places[tuple(part)].append((i, n))
    proven = {p: c[0] for p, c in places.items() if len(c) > 1}
    out = {}
    for i, parts in cut.items():
        state = [None if tuple(p) not in proven else proven[tuple(p)] != (i, n) for n, p in enumerate(parts)]
        kept, n = [], 0
        while n < len(parts):
            if state[n] is not None:
                kept += [] if state[n] else parts[n]
                n += 1
                continue
            end = n
            while end < len(parts) and state[end] is None:
                end += 1
            own, a, z = [x for p in parts[n:end] for x in p], 0, 0
            if n and state[n - 1]:
                d, m = proven[tuple(parts[n - 1])]
                other = cut[d][m + 1] if m + 1 < len(cut[d]) else []
                while a < min(len(own), len(other)) and own[a] == other[a]:
                    a += 1
            if end < len(parts) and state[end]:
                d, m = proven[tuple(parts[end])]
                other = cut[d][m - 1] if m else []
                while z < min(len(own), len(other)) and own[-1 - z] == other[-1 - z]:
                    z += 1
            kept += own[a : max(a, len(own) - z)]
            n = end
        out[i] = "\n".join(kept)
    return out


def test_lines_against_brute_force(spark, monkeypatch):
    random = np.random.default_rng(8)
    passages = {n: [[f"p{n}.{k}.{i}" for i in range(n)] for k in range(20)] for n in (3, 4, 5, 6, 8, 12, 20)}
    rows = []
    for d in range(400):
        ls = [f"own {d} {i}" for i in range(int(random.integers(0, 9)))]
        for _ in range(int(random.integers(0, 3))):
            ps = passages[list(passages)[int(random.integers(7))]]
            ls += ps[int(random.integers(len(ps)))] + [f"mid {d} {i}" for i in range(int(random.integers(0, 4)))]
        rows.append((d, "\n".join(ls + ["the same end", "", "of each"][: int(random.integers(0, 4))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    want = lines_left(rows)
    assert {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()} == want
    monkeypatch.setattr(common.fits, "__defaults__", (0,))
    monkeypatch.setattr(common.small, "__defaults__", (0,))
    assert {r.doc_id: r.text for r in lines.dedup_lines(frame).collect()} == want


@pytest.mark.parametrize("n, least", [(5, 0.5), (6, 0.7), (8, 0.9), (12, 0.98), (20, 0.99)])
def test_share_of_repeated_lines_that_goes(n, least):
    """A passage of n lines in two documents that are otherwise different; the figures of the README."""
    rows = []
    for k in range(400):
        for d in range(2):
            own = [f"{k}.{d}.{i}" for i in range(24)]
            rows.append((2 * k + d, "\n".join(own[: 7 + k % 5] + [f"p{n}.{k}.{i}" for i in range(n)] + own[12:])))
    left = lines_left(rows)
    gone = sum(t.count("\n") - left[i].count("\n") for i, t in rows)
    assert gone >= least * 400 * n and all(left[i].startswith(t.split("\n")[0]) for i, t in rows)


def test_chunk_borders_resist_shifts(spark):
    text = "\n".join(f"line {i * i}" for i in range(300))
    frame = spark.createDataFrame([(1, text), (2, "new first line\n" + text)], "doc_id long, text string")
    a, b = (r[0] for r in frame.orderBy("doc_id").select(lines.chunks()).collect())
    assert "\n".join(a) == text and len(a) > 50 and len(set(a) - set(b)) <= 2


def test_mixing(spark, docs, none):
    rows = [(i, "w " * 10, "big" if i % 10 else f"s{i // 10 % 5}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(frame, target_entropy=0.9, max_repeats=4.0)
    a = mixed.first().mix_alpha
    shares = {"big": 0.9} | {f"s{i}": 0.02 for i in range(5)}
    entropy = lambda e: -sum(w / z * math.log(w / z) for w in [p**e for p in shares.values()]) if (z := sum(p**e for p in shares.values())) else 0
    repeats = lambda e: (0.02 / 0.9) ** (e - 1)
    assert repeats(a) <= 4.0001 and repeats(a - 1e-4) > 4.0 and entropy(a) <= 0.9 * math.log(6)
    read = {r["source"]: r["n"] for r in mixed.groupBy("source").agg({"mix_copies": "sum"}).withColumnRenamed("sum(mix_copies)", "n").collect()}
    assert read["big"] == 3600 and all(abs(read[s] - 80 * repeats(a)) <= 3 for s in shares if s != "big")
    loose = mixing.mix(frame, target_entropy=0.9).first().mix_alpha
    assert abs(entropy(loose) - 0.9 * math.log(6)) < 1e-4
    capped = mixing.mix(frame, budget=20_000)
    total = sum(r.mix_copies * 10 for r in capped.collect())
    assert abs(total - 20_000) < 600
    clash = docs.withColumnRenamed("row", "mix_copies")
    assert mixing.mixture(clash, 1.5).columns == clash.columns and mixing.mixture(clash, 1.0).count() == len(TEXTS)
    assert mixing.mix(none).count() == 0 and mixing.mixture(none, 2.0).count() == 0


def test_language_id(spark, docs, none, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(real).join(real.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert all(got[i] == ("und", 0.0) for i in (4, 5, 6)) and got[9][0] == "en"
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(real.limit(3).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert all(r.lang_pred == "und" for r in unlabelled)
    assert langid.identified(docs).columns == docs.columns


def test_forward_backward_against_enumeration():
    random = np.random.default_rng(5)
    lengths, k = np.array([3, 1, 4, 0, 2]), 3
    scores, t, s = random.normal(size=(10, k)), random.dirichlet(np.ones(k), k), random.dirichlet(np.ones(k))
    lanes = langid.Lanes(lengths)
    marginal, _, log_z = lanes.forward_backward(scores[lanes.place], t, s)
    back = np.empty_like(marginal)
    back[lanes.place] = marginal
    at, total = 0, 0.0
    for n in lengths:
        weights = defaultdict(float)
        for path in itertools.product(range(k), repeat=int(n)):
            weights[path] = (s[path[0]] if n else 1) * math.exp(sum(scores[at + i, y] for i, y in enumerate(path))) * math.prod(t[a, b] for a, b in zip(path, path[1:], strict=False))
        z = sum(weights.values())
        total += math.log(z)
        for i in range(n):
            for y in range(k):
                assert math.isclose(back[at + i, y], sum(w for p, w in weights.items() if p[i] == y) / z, abs_tol=1e-9)
        at += n
    assert math.isclose(total, log_z, abs_tol=1e-9)


def test_code_switching(spark, sf):
    """Words of a text of two halves are labelled by their own half."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang in ('en', 'fr')").orderBy("doc_id").collect()
    model = langid.fit([r.text for r in rows[20:]], [r.lang for r in rows[20:]])
    en, fr = (next(r.text for r in rows[:20] if r.lang == x and len(r.text) > 400).split()[:60] for x in ("en", "fr"))
    text = "\u00a7 " + " ".join(en) + "\n" + " ".join(fr) + " 42"
    spans = model.spans(text)
    right = sum(len(text[a:b].split()) for a, b, name, _ in spans if name == ("en" if b <= len(" ".join(en)) + 20 else "fr"))
    assert right >= 110 and all(0.5 <= p <= 1 for *_, p in spans)
    assert all(a < b <= c < d for (a, b, *_), (c, d, *_) in zip(spans, spans[1:], strict=False))
    (label, score, certain), = model.label([text])
    assert label in ("en", "fr") and score < 0.7 < certain
    frame = spark.createDataFrame([(1, text), (2, None), (3, "42 \u00bd")], "doc_id long, text string")
    found = langid.language_spans(frame, model).collect()
    assert [(r.doc_id, r.start, r.end, r.lang) for r in found] == [(1, *x[:3]) for x in spans]
    assert langid.Model.label(model, []) == [] and model.spans("") == []


def test_texts_without_a_letter_are_undetermined(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit_on(real)
    texts = ["\u00bd", "\u00b2 42", "\u2460", "\u2167", "\u0301", "...", "1 2 3", " \n", "_", "\U0001f600"]
    assert model.label(texts) == [("und", 0.0, 0.0)] * len(texts)
    assert all(label != "und" for label, *_ in model.label(["a", "\u00bd b", "\u4e2d", "\u02b0"]))


def test_labels_of_the_fit_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_LABELS", 2)
    rows = [(i, f"wort{i % 7} ja" if i % 3 else f"word{i % 7} yes", f"l{i % 3}") for i in range(300)] + [(900, "rare", "x")]
    model = langid.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 2 and "x" not in model.labels
