"""Near-duplicates, vectors, line chunks, archives, shards, URLs, and the pipeline."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueframe.llm import graph, itq, linechunks, minhash, sharding, urls, warc
from cueframe.llm.common import mix, span_hashes


def unite(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(500, i) for i in range(501, 530)] + [(900, 900)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = unite(links[:-1], {n for p in links for n in p if p[0] != p[1]})
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash_groups(spark, odd, none):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(10):  # near copies, some of them just beyond the threshold
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 18)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base).upper() + " ")
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    known = {x.doc_id: shingles(x.text) for x in df.collect() if x.doc_id is not None}
    ids = sorted(known)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if known[a] and known[b] and 100 * len(known[a] & known[b]) >= 75 * len(known[a] | known[b])]
    want = unite(links, ids)
    got = minhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(known[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert minhash.near_duplicates(none).count() == 0


def test_signature_estimate(spark):
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 60, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3600], r.integers(0, 1 << 60, 400, dtype=np.uint64)])  # 3600 of 4400
    sig = lambda s: (((minhash.minima(s) & np.uint64(15)).reshape(24, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)).view(np.int64).tolist()
    df = spark.createDataFrame([(sig(a), sig(b))], "a array<long>, b array<long>")
    assert abs(df.select(minhash.estimate(df.a, df.b).alias("e")).first().e - 3600 / 4400) < 0.12


def test_itq_links(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(12, 64))
    rows = []
    for i in range(500):
        v = (base[i % 12] + r.normal(size=64) * r.choice([0, 0.05, 0.1, 0.14, 0.3])) * r.choice([1.0, 2.0, 1e-3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3) if i % 17 else None))
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [float("nan")] * 64, 1), (2003, [None] + [1.0] * 63, 1), (2004, [1.0] * 64, 1), (2005, [2.0] * 64, 1), (2006, [1.0] * 64, 1), (2007, [float("inf")] + [1.0] * 63, 1), (None, [1.0] * 64, 1)]
    good = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in rows if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if label[a] == label[b] and good[a] @ good[b] >= 0.98]
    n = collections.Counter(x for p in links for x in p)
    want = unite(links, [i for i, _, _ in rows if i is not None])
    got = itq.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    found = sum(x.n_links for x in got) / 2
    assert 0.99 * len(links) <= found <= len(links)
    wrong = [x for x in got if x.vec_id is not None and (x.n_links, x.component_id) != (n[x.vec_id], want[x.vec_id])]
    assert len(wrong) <= 0.01 * len(rows)
    assert itq.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_many_lengths_and_shared_ids(spark):
    r = np.random.default_rng(14)
    rows = []
    for d in range(3, 90):  # more lengths than learn a rotation
        v = r.normal(size=d)
        rows += [(10 * d, v.tolist(), 1), (10 * d + 1, (2 * v).tolist(), 1), (10 * d + 2, (-v).tolist(), 1)]
    a, b = r.normal(size=(2, 64)).tolist()
    rows += [(1, a, 7), (1, b, 7), (2, [3 * x for x in a], 7), (2, [3 * x for x in a], 7)]
    df = spark.createDataFrame([(*x, "other", 1) for x in rows], "vec_id long, embedding array<double>, label int, rep string, code int")
    got = collections.Counter(itq.link(df).collect())
    want = collections.Counter()
    for d in range(3, 90):
        want.update([(10 * d, 1, 10 * d, True), (10 * d + 1, 1, 10 * d, False), (10 * d + 2, 0, 10 * d + 2, True)])
    want.update([(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (2, 2, 1, False)])
    assert collections.Counter(map(tuple, got.elements())) == want


def test_near_copies_that_are_just_too_far_apart(spark):
    """One group of near copies, most without a partner: every link is found, and few pairs are taken up."""
    r = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(260):
        copy = list(base)
        for k in range(3 if i % 20 == 0 else 6):
            copy[(r.randrange(25) + 25 * k) % 150] = f"own{i}x{k}"
        texts.append(" ".join(copy))
    known = [shingles(t) for t in texts]
    links = [(a, b) for a in range(260) for b in range(a) if 100 * len(known[a] & known[b]) >= 75 * len(known[a] | known[b])]
    want = unite(links, range(260))
    assert links and len(set(want.values())) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == want


def test_flipped_bits_bound_the_difference():
    r = np.random.default_rng(5)
    for n, apart in ((50, 3), (500, 140), (3000, 900), (40, 0)):
        a = r.integers(0, 1 << 60, n, dtype=np.uint64)
        b = np.concatenate([a[apart:], r.integers(0, 1 << 60, apart, dtype=np.uint64)])
        differ = int(np.bitwise_count(minhash.flipped(a) ^ minhash.flipped(b)).sum())
        assert differ <= 2 * apart and (2 * apart - differ) % 2 == 0
        assert differ >= 0.9 * 1024 * (1 - np.exp(-2 * 2 * apart / 2048)) - 10


def plain_chunks(docs, least=50):
    """Lines that go, by document: the same chunks, compared as bytes one by one."""
    gone = collections.defaultdict(set)
    found = collections.defaultdict(list)
    for i, text in docs:
        lines = (text or "").encode().split(b"\n")
        h = [span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] for x in lines]
        at = np.cumsum([0, *[len(x) + 1 for x in lines]])
        spans = set()
        for mask in (3, 1, 0):
            a = 0
            for k in range(len(lines)):
                before = h[k - 1] if k else np.uint64(0)
                roll = int(mix(np.array([h[k]]) * np.uint64(3) + mix(np.array([before])))[0])
                if k == len(lines) - 1 or roll & mask == 0:
                    spans.add((a, k))
                    a = k + 1
        for a, k in spans:
            chunk = b"\n".join(lines[a : k + 1])
            if len(chunk.split()) >= least:
                found[chunk].append((i, at[a], a, k))
    for places in found.values():
        for i, _, a, k in sorted(places)[1:]:
            gone[i] |= set(range(a, k + 1))
    return gone


def test_line_chunks(spark, odd, none):
    r = random.Random(5)
    line = lambda n: " ".join(r.choice(["a", "bc", "def", "é"]) + str(r.randrange(50)) for _ in range(n))
    passages = ["\n".join(line(r.choice([20, 60])) for _ in range(r.randint(1, 6))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [line(r.randint(3, 70)) for _ in range(r.randint(1, 5))]
        if r.random() < 0.7:
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        texts.append("\n".join(parts))
    df = odd.select("doc_id", "text").where("doc_id <> 5 OR doc_id IS NULL").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    known = {x.doc_id: x.text for x in df.collect() if x.doc_id is not None}
    gone = plain_chunks(known.items())
    assert gone
    got = linechunks.remove_repeats(df).collect()
    assert len(got) == df.count()
    for x in got:
        if x.doc_id is None:
            assert x.text == "no id"
            continue
        lines = (known[x.doc_id] or "").split("\n")
        kept = "\n".join(t for k, t in enumerate(lines) if k not in gone[x.doc_id])
        assert (x.text or "") == kept and (x.text is None) == (known[x.doc_id] is None)
        assert x.n_lines == len(lines) and x.n_removed_lines == len(gone[x.doc_id]) and x.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert linechunks.remove_repeats(none).count() == 0
    assert linechunks.remove_repeats(odd.withColumnRenamed("ratio", "n_lines")).columns.count("n_lines") == 1


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    rows = [(3, "http://a/é?x\n", "<p>same</p>"), (1, None, "<p>same</p>"), (2, "http://b", None), (4, "http://c", ""), (5, "http://d", "é🤖" * 5000), (6, "http://e", "WARC/1.1\r\n\r\n"), (7, "u", "x"), (8, "u", "x"), (None, "u", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, archive string")
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    got = {x.page_id: x for x in warc.archive_and_read(spark, pages, least, with_payload=True).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, url, html in rows:
        b, x = (html or "").encode(), got[i]
        ref = first.get(b) if len(b) >= least and first.get(b) != i else None
        assert (x.payload_bytes, x.payload_digest, x.refers_to) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), ref)
        assert x.record_type == ("response" if ref is None else "revisit") and x.url == url
        assert x.payload == (bytearray(b) if ref is None else None)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(spark, empty).count() == 0


def test_shards(spark, odd, none):
    df = spark.createDataFrame([(i, "t" * (i % 9)) for i in range(6000)] + [(5, "again"), (5, "again")], "doc_id long, text string")
    got = sharding.assign(df).collect()
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
        assert x.grown_shard in (x.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and sorted(by) == list(range(8))
    assert max(map(len, by.values())) < 1.3 * min(map(len, by.values()))
    assert 400 < sum(x.grown_shard == 8 for x in got) < 950
    assert {x.shard for x in got if x.doc_id == 5}.__len__() == 1
    for x in sharding.assign(odd).collect():
        assert x.law == "key" and x.size >= 1
    crc = {x.doc_id: (x.size, x.text_crc32) for x in sharding.assign(odd).collect()}
    assert crc[7] == (len("é ß 🤖 ñ".encode()) + 1, zlib.crc32("é ß 🤖 ñ".encode())) and crc[0] == (1, 0)
    assert sharding.assign(none).count() == 0


def test_weights_move_rows_into_heavier_subtrees_only(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' AS text")
    one = {x.doc_id: x.shard for x in sharding.assign(df).collect()}
    two = {x.doc_id: x.shard for x in sharding.assign(df, weights={6: 3.0}).collect()}
    moved = {i for i in one if one[i] != two[i]}
    assert moved and {two[i] for i in moved} <= {6, 7, 4, 5}  # into the region, rack or shard that grew
    assert not {i for i in moved if one[i] in (0, 1, 2, 3) and two[i] in (0, 1, 2, 3)}


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def plain_rule(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_url_rules(spark):
    given = [None, "", "no scheme", "http://", "http://A.COM", "http://a.com/", "https://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://m.www.example.com/en/1", "http://example.comx/en/", "http://x.net/es/1", "http://x.net/ES/1", "http://x.org/fr/", "a://b://c.com/d", "http://É.com/\n/x", "http://x.net?/es/", "http://x.net#/es/"]
    df = spark.createDataFrame([(i, u, "p") for i, u in enumerate([*given, given[5]])], "page_id long, url string, path string")
    got = {x.page_id: x for x in urls.judge(df.withColumns({c: F.lit("z") for c in ("host", "verdict", "t", "_node", "template")})).collect()}
    assert len(got) == len(given) + 1
    for i, u in enumerate([*given, given[5]]):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_template_tree(spark):
    rule = urls.TreeRule()
    rows = [("h", ["a", "*"], 50, 40, 40), ("h", ["b", "*"], 50, 40, 0), ("h", ["c", "*"], 50, 40, 39), ("h", ["d", "*"], 50, 0, 0), ("g", [f"s{i}" for i in range(1)], 1, 0, 0)]
    rows += [("w", [f"s{i}", "x"], 2, 1, 1) for i in range(30)]  # many rare siblings: one wildcard
    df = spark.createDataFrame(rows, "host string, t array<string>, n long, labelled long, blocked long")
    got = {(x.host, x.t[0]): x for x in urls.learn(df, rule).collect()}
    assert got["h", "a"].method_verdict == "block" and got["h", "b"].method_verdict == "allow" and got["h", "d"].method_verdict == "allow"
    assert got["h", "a"].template == got["h", "c"].template != got["h", "b"].template
    assert len({got["w", f"s{i}"].template for i in range(30)}) == 1 and got["w", "s0"].template.startswith("/*")
    assert got["w", "s0"].method_verdict == "block"


def plain_tree(rows, rule):
    """Verdict by (host, template) of the tree, built by recursion over one parent's templates at a time."""
    out = {}

    def go(host, group, level, way, beside=None):
        ended = [r for r in group if len(r[1]) == level]
        if ended:
            n, known, bad = (sum(r[k] for r in ended) for k in (2, 3, 4))
            purity = (bad + rule.strength * rule.prior) / (known + rule.strength)
            verdict = purity >= rule.limit and known >= rule.least_labelled * n
            if not known:
                verdict = beside is not None and beside >= rule.limit
            out.update({(host, tuple(r[1])): (way, "block" if verdict else "allow") for r in ended})
        children = {}
        for r in group:
            if len(r[1]) > level:
                children.setdefault(r[1][level], []).append(r)
        count = {seg: tuple(sum(r[k] for r in rs) for k in (2, 3, 4)) for seg, rs in children.items()}
        name = {seg: "*" for seg in count if len(count) > rule.max_children and count[seg][0] < rule.rare}
        told = [count[seg][2] / count[seg][1] for seg in count if count[seg][1]]
        if told:
            beside = (sum(told) + rule.beside * rule.prior) / (len(told) + rule.beside)
        silent = [seg for seg in count if seg not in name and count[seg][1] == 0]
        name |= {seg: "{?}" if len(silent) > 1 else seg for seg in silent}
        share = lambda seg: (count[seg][2] + rule.prior) / (count[seg][1] + 2 * rule.prior)
        error2 = lambda seg: share(seg) * (1 - share(seg)) / (count[seg][1] + 2 * rule.prior)
        branches = []
        for seg in sorted((x for x in count if x not in name), key=lambda x: (share(x), count[x][1])):
            if branches and share(seg) - share(branches[-1][-1]) <= rule.alike * (error2(seg) + error2(branches[-1][-1])) ** 0.5:
                branches[-1].append(seg)
            else:
                branches.append([seg])
        name |= {seg: seg if len(b) == 1 else "{%d}" % k for k, b in enumerate(branches) for seg in b}
        for to in set(name.values()):
            go(host, [r for seg, rs in children.items() if name[seg] == to for r in rs], level + 1, way + "/" + to, beside)

    for h in {r[0] for r in rows}:
        go(h, [r for r in rows if r[0] == h], 0, "")
    return out


def test_tree_against_recursion(spark):
    r = random.Random(9)
    seen = {}
    for _ in range(1500):
        t = tuple(f"s{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randrange(5)))
        n = r.randrange(1, 40)
        known = r.choice([0, 0, n, r.randrange(n + 1)])
        seen[r.choice("hk"), t] = (n, known, r.choice([0, known, r.randrange(known + 1)]))
    rows = [(h, list(t), *c) for (h, t), c in seen.items()]
    rule = urls.TreeRule()
    df = spark.createDataFrame(rows, "host string, t array<string>, n long, labelled long, blocked long")
    got = {(x.host, tuple(x.t)): (x.template, x.method_verdict) for x in urls.learn(df, rule).collect()}
    want = plain_tree(rows, rule)
    assert got == want and {v for _, v in want.values()} == {"allow", "block"}


def test_deep_paths_stay_apart(spark):
    same = "/a" * 12
    rows = [(i, f"http://h.net{same}/{'x' if i % 2 else 'y'}/{i}") for i in range(8)]
    got = [x.template for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).orderBy("page_id").collect()]
    assert len(set(got)) == 1  # two siblings without labels: one branch
    t = spark.range(1).select(urls.template_of(F.lit(same + "/x/7"), 8).alias("t"), urls.template_of(F.lit(same + "/y/7"), 8).alias("u")).first()
    assert t.t[-1] == "a/a/a/a/x/*" and t.u[-1] == "a/a/a/a/y/*"


def test_unlabelled_paths_follow_several_branches_that_agree(spark):
    pages = [f"http://{host}.net/{lang}/{k}" for host, langs in (("a", ["es", "fr", "de"]), ("b", ["es", "de", "en"]), ("c", ["de", "en"])) for lang in langs for k in range(4)]
    rows = [*enumerate(pages), (100, "http://a.net/de/deep/er/1"), (101, "http://a.org/de/1")]
    got = {x.page_id: x for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    verdict = {u: got[i].verdict for i, u in rows}
    assert verdict["http://a.net/de/1"] == verdict["http://a.net/de/deep/er/1"] == "block"  # es and fr are blocked there
    assert verdict["http://b.net/de/1"] == verdict["http://b.net/en/1"] == "allow"  # one blocked branch tells nothing
    assert verdict["http://c.net/de/1"] == verdict["http://a.org/de/1"] == "allow"


def test_unlabelled_paths_do_not_inherit_from_few_labels(spark):
    rows = [(i, f"http://h.net/{'es' if i < 6 else 'p' + chr(97 + i % 26)}/{i}") for i in range(100)]
    got = {x.page_id: x.verdict for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[i] == ("block" if i < 6 else "allow") for i in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    word = lambda: r.choice(["sol", "mar", "rio", "pan", "luz"]) + r.choice(["an", "er", "is", "os"]) + str(r.randrange(90))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(80)
    docs = [(i, text(120), "en", "s", 0) for i in range(20)]
    docs += [(20, text(30), "en", "s", 0), (21, "spam " * 200, "en", "s", 0)]  # too short; repetitive
    docs += [(22, passage + "\n" + text(70), "en", "s", 0), (23, text(70) + "\n" + passage, "en", "s", 0)]
    near = docs[0][1].split()
    near[60] = "zzz"
    docs += [(24, " ".join(near), "en", "s", 0), (25, text(60) + " mail me@host.example", "en", "s", 0), (26, docs[1][1], "en", "s", 0)]
    path = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    now, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, path)
        assert out.columns == now.columns
        now = spark.createDataFrame(out.collect(), out.schema)
        kept.append({x.doc_id: x.text for x in now.collect()})
    quality_, lines, near_, private = kept
    assert set(quality_) == set(range(27)) - {20, 21}
    assert passage in lines[22] and passage not in lines[23] and 26 not in lines
    assert 24 not in near_ and 0 in near_ and set(range(20)) <= set(near_)
    assert "me@host.example" not in private[25] and private[3] == docs[3][1]
    result = corpus_pipeline.run(spark, path).collect()
    assert {x.doc_id for x in result} == set(private)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, ties, a long text, columns with clashing names, and no rows."""
    import corpus_pipeline

    r = random.Random(16)
    text = lambda n: " ".join(f"{r.choice(['sol', 'mar', 'rio'])}{r.choice(['an', 'er', 'is'])}{r.randrange(90)}" for _ in range(n))
    same, own = text(120), text(130)
    docs = [(1, None), (2, ""), (3, same), (4, same), (5, own), (5, own), (None, text(140)), (None, None), (6, text(9000))]
    kind = "doc_id long, text string, lang string, source string, n_chars long, _kept string, kept_id int, c1 int, h int, all_spans string"
    df = spark.createDataFrame([(i, t, "en", None, 0, "k", 1, 2, 3, "s") for i, t in docs], kind)
    stages, wanted = dict(corpus_pipeline.STAGES), {"line dedup": [None, None, 1, 2, 3, 5, 5, 6], "near dedup": [None, None, 1, 2, 3, 5, 5, 6], "personal data": [None, None, 1, 2, 3, 4, 5, 5, 6]}
    for name, stage in stages.items():
        none = stage(spark, df.limit(0), str(tmp_path))
        assert none.count() == 0, name
        out = stage(spark, df, str(tmp_path))
        if name == "packing":
            assert out.where("start = 0").count() == len(docs)
            continue
        assert out.columns == df.columns, name
        rows = out.collect()
        assert all((x._kept, x.kept_id, x.c1, x.h, x.all_spans) == ("k", 1, 2, 3, "s") for x in rows)
        ids = sorted((x.doc_id for x in rows), key=lambda i: (i is not None, i or 0))
        if name == "quality":
            assert set(ids) <= {None, 3, 4, 5, 6} and ids.count(3) == ids.count(4) and ids.count(5) in (0, 2)
        else:
            assert ids == wanted[name], name


def plain_runs(docs, least=50):
    """Lines that go, by document: of every run of enough words that stands earlier without overlap."""
    gone, first = collections.defaultdict(set), {}
    for i, text in sorted(docs):
        lines = (text or "").encode().split(b"\n")
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += len(lines[b].split())
                if n >= least:
                    src, c, d = first.setdefault(tuple(lines[a : b + 1]), (i, a, b))
                    if src != i or d < a:
                        gone[i] |= set(range(a, b + 1))
    return gone


def test_runs_of_short_lines_go_whole(spark, odd, none):
    r = random.Random(8)
    line = lambda n: " ".join(r.choice(["a", "bc", "def", "é"]) + str(r.randrange(90)) for _ in range(n))
    passages = ["\n".join(line(n) for _ in range(k)) for n, k in ((5, 100), (30, 2), (7, 8), (49, 1), (25, 2), (60, 2))]
    texts = ["\n".join([line(4)] * 40), "\n".join([line(3), "", *[line(20)] * 9, ""])]
    for _ in range(50):
        parts = [line(r.randint(0, 30)) for _ in range(r.randint(1, 5))]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        texts.append("\n".join(parts))
    texts += [f"begin\n{passages[0]}\nend", f"{passages[1]}\nother words"]
    df = odd.select("doc_id", "text").where("doc_id <> 5 OR doc_id IS NULL").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    known = {x.doc_id: x.text for x in df.collect() if x.doc_id is not None}
    gone = plain_runs(known.items())
    got = {x.doc_id: x for x in linechunks.remove_repeats(df, linechunks.RUNS).collect() if x.doc_id is not None}
    assert set(got) == set(known)
    for i, text in known.items():
        lines = (text or "").split("\n")
        assert (got[i].text or "") == "\n".join(t for k, t in enumerate(lines) if k not in gone[i]), i
        assert got[i].n_removed_lines == len(gone[i])
        assert got[i].n_removed_words == sum(len(lines[k].encode().split()) for k in gone[i])
    assert got[152].text == "begin\nend" and got[153].text == "other words"
    assert linechunks.remove_repeats(none, linechunks.RUNS).count() == 0


@pytest.mark.parametrize("bits", [8, 10, 12, 13, 16])
def test_vector_links_at_every_substring_length(bits):
    """Pairs at the cosine 0.98 meet in some table as often by long substrings as by short ones."""
    r = np.random.default_rng(bits)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    projection = itq.learn_rotation(x)
    apart = itq.codes(x, projection) ^ itq.codes(y, projection)
    masks = itq.table_masks(bits)
    assert all(m.bit_count() == bits for m in masks) and len(set(masks)) == len(masks)
    met = np.any([apart & np.uint64(m) == 0 for m in masks], axis=0)
    assert met.mean() >= 0.99


@pytest.mark.parametrize("mean,noise,dim", [(0, 0.14, 64), (3, 0.3, 64), (1, 0.12, 64), (1, 0.3, 64), (0.3, 0.2, 256), (5, 0.5, 256), (2, 0.4, 16)])
def test_vector_links_beside_a_shared_mean(spark, mean, noise, dim):
    """Centred, shifted and clustered vectors: the cosine is seen from the origin, so no link may be lost."""
    r = np.random.default_rng(int(10 * mean) + dim)
    cluster = r.normal(size=(8, dim)) * (1 if mean == 0 else 0.15)
    x = mean + cluster[np.arange(300) % 8] + noise * r.normal(size=(300, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    got = {g.vec_id: g for g in itq.link(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(g.n_links for g in got.values())
    assert 0.99 * linked.sum() <= found <= linked.sum()
    want = unite([(int(a), int(b)) for a, b in zip(*np.nonzero(linked), strict=True)], range(300))
    assert sum(got[i].component_id != want[i] for i in range(300)) <= 3


def test_vector_links_by_long_substrings(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(150, 64))
    near = base + 0.17 * r.normal(size=base.shape)
    rows = [(i, [float(a) for a in v], 0) for i, v in enumerate(np.concatenate([base, near]))]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = int((np.triu(unit @ unit.T, 1) >= 0.98).sum())
    got = itq.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), itq.ItqRule(bits=16)).collect()
    assert links > 100 and 0.98 * links <= sum(x.n_links for x in got) / 2 <= links
