"""Filter interactions, divergence of sources, and packing by retrieval against plain versions."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from cueframe.llm import divergence, interaction, retrieval
from cueframe.llm.queries import BYTE_BPE_50K

DOC = "doc_id long, text string, lang string, source string, mask string, n int, LOT int, part string"


def documents(spark, rows):
    """With columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, "m", 1, 2, "p") for r in rows], DOC)


def plain_masks(rows):
    firsts = {}
    for doc, text, *_ in rows:
        if doc is not None:
            firsts[text or ""] = min(doc, firsts.get(text or "", doc))
    out = []
    for doc, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t) is not None, doc is not None and doc > firsts[t]]
        out.append((doc, source or "", sum(x << k for k, x in enumerate(fails))))
    return out


def odd_rows(seed, n):
    r = random.Random(seed)
    letters = [*"abcde ABC #é🤖日\n\t\x0b|", "ab ", "  ", "word "]
    texts = [None, "", "", " ", "x" * 70_000, "same text", "same text", "W " * 300, *(f"w{i} " * 3 for i in range(40))]
    texts += ["".join(r.choice(letters) for _ in range(r.choice([0, 3, 40, 900]))) for _ in range(n)]
    texts += [" ".join(f"t{r.randrange(k)}" for _ in range(260)) for k in (20, 129, 130, 131, 5000)]
    head = "long shared beginning " * 60
    texts += [head + str(i % 9) for i in range(40)]
    rows = [(i, t, r.choice(["en", "de", None, ""]), r.choice(["a", "b", None])) for i, t in enumerate(texts)]
    rows += [(r.randrange(len(rows)), *r.choice(rows)[1:]) for _ in range(60)]  # copies under other ids
    rows += rows[:12] + [(None, "same text", "en", "a"), (None, None, None, None)]
    return rows


def test_masks_as_by_hand(spark):
    rows = odd_rows(1, 300)
    got = collections.Counter()
    for x in interaction.masks(documents(spark, rows).repartition(7)).collect():
        got[x.doc_id, x.part, x["mask"]] += x.n
    assert got == collections.Counter(plain_masks(rows))
    assert interaction.masks(documents(spark, [])).count() == 0


def test_small_tries_and_split_ranges(spark, monkeypatch):
    """Tries that are begun anew, and more lots than ranges, change nothing."""
    rows = odd_rows(2, 150)
    want = collections.Counter(plain_masks(rows))
    lots = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    monkeypatch.setattr(interaction, "MOST_RANGES", 3)
    try:
        for size in (1, 5000):
            monkeypatch.setattr(interaction.Firsts, "full", lambda self, size=size: self.trie.size > size)
            got = collections.Counter()
            for x in interaction.masks(documents(spark, rows)).collect():
                got[x.doc_id, x.part, x["mask"]] += x.n
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", lots)


def test_trie_terminals():
    r = random.Random(5)
    trie, seen = interaction.Trie(), {}
    for _ in range(2000):
        text = "".join(r.choice("ab") for _ in range(r.randrange(12))).encode()
        node = trie.terminal(text)
        assert seen.setdefault(text, node) is node
        node.least = 1
    assert {t for t, _ in trie.terminals()} == set(seen)


def test_interactions_of_all_orders(spark):
    rows = odd_rows(3, 120)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 400, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1), (9, 0, 1)]
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    masks, want = plain_masks(rows), {}
    for part in {p for _, p, _ in masks}:
        own = [(d, m) for d, p, m in masks if p == part]
        removed_by = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            bits = [1 << "ABCDE".index(x) for x in order]
            for k, b in enumerate(bits):
                before = sum(bits[:k])
                gone = [d for d, m in own if m & b and not m & before]
                removed_by[b] += len(gone)
                want[part, "".join(order), k + 1] = [sum(not m & (before | b) for _, m in own), len(gone), sum(bool(m & b and m & before) for _, m in own), sum(m == b for _, m in own), sum(d in good for d in gone), sum(d in toxic for d in gone), b]
        for key, v in want.items():
            if key[0] == part:
                v[-1] = removed_by[v[-1]]
    got = interaction.audit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in got} == want
    assert len(got) == len(want)
    assert interaction.audit(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def plain_divergence(rows, least):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    out = []
    for lang in {g for _, g, _ in rows}:
        df, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for t, g, s in rows:
            if g == lang:
                found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
                df.update(set(found))
                counts[s].update(found)
        kept = sorted(w for w, n in df.items() if n >= least)
        p = {}
        for s, c in [*counts.items(), (None, sum(counts.values(), collections.Counter()))]:
            below = sum(c[w] for w in kept) + 2 * len(kept)
            p[s] = {w: 1 + 10**9 * (c[w] + 2) // below for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [("pair", o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in counts if o != s]
            terms = [("term", w, f(p[s][w], p[None][w])) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for some, most in ((pairs, None), (terms, 10)):
                ranked = sorted(some, key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k) for k, x in enumerate(ranked[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_as_by_hand(spark, monkeypatch, small):
    r = random.Random(7)
    words = [*(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)), "Éa", "日本", "ÄB", "x"]
    rows = [(i, " ".join(r.choice(words[: r.choice([5, 40, 76])]).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.choice([0, 5, 60]))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "ä", None])) for i in range(300)]
    rows += [(900, None, "xx", "only"), (901, "lonely", "xx", "other"), (902, "x1y2_z'É-e", "en", "a"), (903, "many " * 60_000 + "🤖", "en", "a"), (904, "same", "en", "b"), (904, "same", "en", "b")]
    if small:  # spills after every batch, long texts in parts, several lots of terms
        monkeypatch.setattr(divergence, "SPILL_COUNTS", 1)
        monkeypatch.setattr(divergence, "PART_BYTES", 50)
        monkeypatch.setattr(divergence, "LOT_TERMS", 7)
        monkeypatch.setattr(divergence, "CELLS", 12)
    got = divergence.audit(documents(spark, rows).repartition(9)).collect()
    assert sorted((x.lang, x.source, x.part, x.item, x.value, x["rank"]) for x in got) == plain_divergence(rows, 10)
    assert divergence.audit(documents(spark, [])).count() == 0


def test_scaled_counts_are_exact():
    r = random.Random(8)
    counts = [r.choice([0, 1, 7, 10**6, 10**12]) for _ in range(200)]
    for kept in (1, 1000, 10**7):
        total = sum(counts)
        got = divergence.scaled(np.array(counts), np.int64(total), kept).tolist()
        assert got == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]


def plain_fill(docs, idf, mean, capacity):
    """The greedy windows with every score computed from counts."""
    def score(seed, d):
        tf, dl = collections.Counter(docs[d]), len(docs[d])
        return sum(idf[t] * tf[t] * (retrieval.K1 + 1) / (tf[t] + retrieval.K1 * (1 - retrieval.B + retrieval.B * dl / mean)) for t in set(docs[seed]) if tf[t])

    left, windows, now, cut = list(range(len(docs))), [], [], None
    while left or cut:
        if cut:
            seed, start, cut = *cut, None
        else:
            seed, start = left.pop(0), 0
        queue, asked = [(seed, start)], False
        while queue:
            doc, at = queue.pop(0)
            take = min(capacity - sum(n for *_, n in now), len(docs[doc]) - at)
            now.append((doc, at, take))
            if at + take < len(docs[doc]):
                cut = (doc, at + take)
            if sum(n for *_, n in now) == capacity:
                windows.append(now)
                now = []
                break
            if not asked:
                asked = True
                queue = [(d, 0) for d in sorted(left, key=lambda d: (-round(score(seed, d), 9), d))]
            if queue:
                left.remove(queue[0][0])
    return windows, now


def test_windows_hold_the_nearest_unused():
    r = random.Random(9)
    for _ in range(30):
        docs = [[r.randrange(40) for _ in range(r.choice([1, 5, 20, 90]))] + [1] for _ in range(r.randint(1, 25))]
        docs += docs[:2]
        df = np.bincount([t for d in docs for t in set(d)], minlength=50)
        idf, mean, capacity = retrieval.weights(df, len(docs) + 10), 17.0, r.choice([16, 33, 64])
        at = np.cumsum([0, *map(len, docs)])
        got = retrieval.fill(np.array(sum(docs, []), np.uint16), at, idf, mean, capacity)
        full, rest = plain_fill(docs, idf, mean, capacity)
        assert got[: len(full)] == full
        assert [sum(n for *_, n in s) for s in got[len(full) :]] == [1 << b for b in reversed(range(12)) if sum(n for *_, n in rest) >> b & 1]
        assert sorted((d, a + k) for s in got for d, a, n in s for k in range(n)) == sorted((d, k) for d, t in enumerate(docs) for k in range(len(t)))


@pytest.mark.parametrize("small", [False, True])
def test_packed_pieces_hold_every_token(spark, odd, none, monkeypatch, small):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(BYTE_BPE_50K)
    t = Tokenizer.from_file(path)
    r = random.Random(6)
    letters = [*"abc de'st ÉÀßé\n,.12\t\x85\xa0　  \x1f", "<|endoftext|>", "  ", "日本", "🤖", "don't", "é   ", "—", "é\n", " '"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(900)] + ["long text, été " * 40_000, "copy of this text"] * 2
    if small:  # many shards, hot keys split
        monkeypatch.setattr(retrieval, "SHARD_TOKENS", 900)
        monkeypatch.setattr(retrieval, "SHARD_DOCS", 40)
    rows = [(i, x, 1, 2, 3) for i, x in enumerate(texts, 100)]
    df = spark.createDataFrame([(x.doc_id, x.text, 1, 2, 3) for x in odd.collect()] + rows, "doc_id long, text string, ids int, SHARD int, n int")
    got = retrieval.pack(df, path, capacity=256).collect()
    want = collections.defaultdict(list)
    for x in df.collect():
        want[x.doc_id].append([*t.encode(x.text or "", add_special_tokens=False).ids, 1])
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        pieces[x.doc_id, x.doc_tokens].append((x.start, x.length, x.ids_crc32))
        sequences[x.sequence_id].append((x.offset, x.length))
    expected = collections.Counter((doc, len(ids)) for doc, all_ids in want.items() for ids in all_ids)
    assert set(expected) == set(pieces)
    for doc, all_ids in want.items():
        for ids in all_ids:
            own = pieces[doc, len(ids)]
            covered = collections.Counter(k for a, n, _ in own for k in range(a, a + n))
            assert covered == collections.Counter({k: expected[doc, len(ids)] for k in range(len(ids))})
            if expected[doc, len(ids)] == 1:
                assert all(zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) == crc for a, n, crc in own)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0  # full, or of a length that needs no padding
    assert retrieval.pack(none, path).count() == 0


def test_tokens_of_texts_without_words_in_rows():
    """Batches in which no piece goes through a row of words."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cueframe.llm import packing
    from cueframe.llm.queries import WORD_BPE

    for texts in ([None], [""], ["?"], ["日本", "12"], ["x"], [" x"], ["x", None, " y z"]):
        ids, upto = retrieval.byte_ids(public_tokenizers.path(BYTE_BPE_50K)).encode(pa.array(texts, pa.string()))
        whole = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE_50K))
        assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        words = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
        got = packing.word_ids(public_tokenizers.path(WORD_BPE)).encode(pa.array(texts, pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [words.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_and_entries_are_handled_together():
    """Python takes no step for each word, and the index of a shard gets smaller as its documents are used."""
    import sys

    import pyarrow as pa

    r = random.Random(4)
    text = pa.array([" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)), "a b <c |d 　e é f"])
    coder, calls = retrieval.ByteIds(public_tokenizers.path(BYTE_BPE_50K)), collections.Counter()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        ids, upto = coder.encode(text)
    finally:
        sys.setprofile(None)
    assert calls["c_call"] + calls["call"] < 5_000
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [coder.whole.encode(t.as_py(), add_special_tokens=False).ids for t in text]

    docs = [[r.randrange(5000) for _ in range(50)] + [1] for _ in range(400)]
    idf = retrieval.weights(np.bincount([t for d in docs for t in set(d)], minlength=5001), 400)
    ids, at = np.array(sum(docs, []), np.uint16), np.cumsum([0, *map(len, docs)])
    index = retrieval.Index(ids, at, idf, 51.0)
    before, some = index.scores(ids[:51]), np.arange(400) % 3 == 0
    many = len(index.doc)
    index.keep(some)
    assert np.array_equal(index.scores(ids[:51]), np.where(some, before, 0.0)) and len(index.doc) < many / 2
