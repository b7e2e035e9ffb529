"""Byte BPE, quality rules, packing and personal data against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cueframe.llm import bpe, packing, pii, quality
from cueframe.llm.queries import BYTE_BPE, WORD_BPE

RANKS = public_tokenizers.path(BYTE_BPE)


def fuzz(seed, n, alphabet):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_byte_bpe_as_tiktoken(spark, odd, none):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = fuzz(1, 400, list("abcdefgh'st 12é\n\t\x85\xa0") + ["  ", "   ", "🤖", "日本", "the", " and"])
    texts += fuzz(11, 1500, [*"ab'sTt12 ,.!é\n\u3000\u2028\x1f\u0301", "'s", "don't", "…", "the ", " \u3000", "x\n y"]) + ["wide words, " * 500_000]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    want = collections.Counter()
    for r in df.collect():
        ids = own.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    got = bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_replay_takes_lower_rank_made_on_the_way():
    """A merge may make a pair that goes before places of the same rank that are left."""
    pairs = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 260, b"bc": 310}
    ranks = bpe.Ranks(pairs)
    assert bpe.replay([b"abcab", b"", b"bc", b"bcb"], ranks) == [[260, 300], [], [310], [310, 98]]


def plain_counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    many = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(spark, odd, none):
    texts = fuzz(2, 600, list("ab é\n\t#<\x0b\x85 "))
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    got = quality.judge(df).collect()
    assert len(got) == df.count()
    for r in got:
        want = plain_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judge(odd).columns.count("kept") == 1
    assert quality.judge(none).count() == 0


def test_compression_bands():
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    r = random.Random(3)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(3000)).encode()
    noise = bytes(r.randrange(33, 127) for _ in range(20_000))
    ok = lambda t: quality.in_bands(t, quality.Bands(), compress)[0]
    assert ok(prose) and ok(prose[:300]) and ok(b"") and ok(b"short")
    assert not ok(b"again " * 2000) and not ok(noise)
    half = prose[:4096] + b"again " * 4000
    assert not ok(half)


def test_encoded_and_repeated_blocks_are_found_in_texts_of_any_length():
    import base64

    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    r = random.Random(9)
    syllables = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]
    prose = " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(9000)).encode()
    encoded = base64.b64encode(r.randbytes(3072))
    spaced = b" ".join(encoded[i : i + 8] for i in range(0, len(encoded), 8))
    judged = lambda t: quality.in_bands(t, quality.Bands(), compress)
    for n in (200, 600, 1500, 3000, 4096, 4100, 8000, 8300, 30_000):
        kept, _, chunks, bad = judged(prose[:n])
        assert kept and bad == 0 and chunks >= n // 4096, n
    for block in (encoded, spaced, b"again and again " * 256):
        for text in (block, prose[:2000] + block, block + prose[:3000], prose[:8192] + block[:2000], prose[:12_288] + block + prose[:8192]):
            assert not judged(text)[0], (block[:20], len(text))
    # a leftover too short to judge alone is in the last full chunk
    assert judged(prose[:4100])[2] == 2 and judged(prose[:8192])[2] == 2 and judged(b"short")[2] == 1


def check_plan(counts, capacity):
    plan = packing.best_plan(dict(counts), capacity)
    fill, ranges = collections.defaultdict(list), collections.defaultdict(list)
    for n, a, b, first, each, offset in plan.entries:
        ranges[n].append((a, b))
        for q in range(a, b):
            fill[first + (q - a) // each].append((offset + (q - a) % each * n, n))
    for n, c in counts.items():
        rs = sorted(ranges[n])
        assert not c or (rs[0][0] == 0 and rs[-1][1] == c and all(x[1] == y[0] for x, y in zip(rs, rs[1:], strict=False)))
    assert sorted(fill) == list(range(plan.sequences))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return plan.sequences


def test_packing_plans():
    r = random.Random(4)
    for _ in range(60):
        capacity = r.choice([5, 8, 16, 50])
        counts = {n: r.randint(1, 30) for n in range(1, capacity + 1) if r.random() < 0.6}
        got, bound = check_plan(counts, capacity), -(-sum(n * c for n, c in counts.items()) // capacity)
        big = sum(c for n, c in counts.items() if 2 * n > capacity)
        assert max(bound, big) <= got <= 1.25 * max(bound, big) + 2
    assert check_plan({}, 2048) == 0
    assert check_plan({700: 1000}, 2048) == 500
    many = {n: 40 + n % 7 for n in range(1, 2049)}
    assert check_plan(many, 2048) <= 1.002 * -(-sum(n * c for n, c in many.items()) // 2048) + 1


def test_packing_pieces(spark, odd, none):
    from tokenizers import Tokenizer

    path, capacity = public_tokenizers.path(WORD_BPE), 64
    t = Tokenizer.from_file(path)
    marks = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "Å", "\x85", "\xa0", "\u0338", "\u0301", "=", "!'", "12", "don't", "…", "\x1f"]
    texts = fuzz(5, 600, list("abc de'st ÉÀßİΣσ\n,.") + marks) + fuzz(15, 200, list("ab <|endoftext|> ")) + ["hello <|endoftext|> x", "long text, " * 600_000]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    want = collections.Counter()
    for r in df.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack(df, path, capacity).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert packing.pack(none, path).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_base_spans(spark, odd, none):
    alphabet = ["a", "b.", "@", "x@y.z", "1", "12", ".", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "256.", "é", "🤖", "_", "\n", "+49 (30) 1234-5678", "00255"]
    texts = [*fuzz(6, 600, alphabet), "1" * 20_000, "a" * 20_000 + "@", "a.b@c.d_e@f.g"]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    known = {r.doc_id: r.text for r in df.collect()}
    for r in pii.digest(pii.find(df)).collect():
        want = plain_spans(known[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in want) for k in PLAIN)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert pii.digest(pii.find(none)).count() == 0


def test_disclosing_terms_and_redaction(spark):
    r = random.Random(7)
    filler = [" ".join(r.choice(["sun", "moon", "rain", "wind", "leaf"]) for _ in range(30)) for _ in range(200)]
    told = [f"{filler[i]} Zorblax mail zed@host.example now {filler[i + 1]}" for i in range(5)]
    apart = ["the zorblax came alone"]
    df = spark.createDataFrame(list(enumerate(told + filler + apart)), "doc_id long, text string")
    found = pii.find(df)
    terms = {s["value"].lower() for row in found.select("all_spans").collect() for s in row.all_spans if s["kind"] in ("term", "gone")}
    # each stands with the one address only; words that stand everywhere are left alone
    assert "zorblax" in terms and not terms & {"sun", "moon", "rain", "wind", "leaf"}
    texts = {row.doc_id: row.t for row in found.select("doc_id", pii.redacted(found.text, found.all_spans).alias("t")).collect()}
    assert "zed@host.example" not in texts[0] and "[EMAIL]" in texts[0] and "orblax" not in texts[0]
    assert texts[10] == filler[5]


@pytest.mark.parametrize("text,want", [("mail a@b.c, ip 1.2.3.4!", "mail [EMAIL], ip [IP]!"), ("🤖 a@b.c", "🤖 [EMAIL]"), ("none", "none"), ("", "")])
def test_redacted(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(pii.redacted(df.text, pii.base_spans(df.text)).alias("t")).first().t == want


def test_clashing_names_stay(spark):
    """Columns named like the operators' own, private or returned, do not break them."""
    from cueframe.llm import linechunks

    names = ["_text", "_terms", "_row", "_id", "_gone", "c0", "C1", "base", "KEPT", "n_lines"]
    rows = [(i, t, *range(len(names))) for i, t in enumerate(["mail a@b.c", None, "", "word " * 60, "word " * 60])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"{n} int" for n in names]]))
    for out in (pii.find(df), quality.judge(df), linechunks.remove_repeats(df, linechunks.RUNS)):
        assert out.count() == len(rows) and {"_text", "_terms", "_row", "_id", "_gone", "c0", "C1"} <= set(out.columns)
        assert all((r["_text"], r["_terms"], r["_row"], r["_id"], r["_gone"], r["c0"], r["C1"]) == (0, 1, 2, 3, 4, 5, 6) for r in out.collect())


def test_limits_are_learnt_from_labels(spark):
    """By script and length, from half of the clean documents that pass the base rules; classes with few parts keep theirs."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    wide = ["".join(chr(0x4E00 + r.randrange(900)) for _ in range(r.randint(1, 4))) for _ in range(3000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(250))) for i in range(700)]
    docs += [(1000 + i, " ".join(r.choice(wide) for _ in range(200))) for i in range(700)]
    docs += [(3000, None), (3001, ""), (3002, "again " * 400), (3003, "é" * 10)]
    labels = [(i, 1, 0) for i, _ in docs] + [(0, 1, None), (1, 0, 0), (2, 1, 1), (None, 1, 0), (9999, 1, 0)]
    d, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    used = quality.labelled(d, lb).count()
    assert used == len(docs) - 2  # not the one labelled bad, nor the toxic one
    bands = quality.learn(d, lb)
    plain = quality.Bands()
    changed = {(s, k) for s in range(3) for k in range(8) if bands.bands[s][k] != plain.bands[s][k]}
    assert changed == {(0, 4), (2, 4)} and all(bands.bands[s][4][0] == 1024 for s in (0, 2))
    out = {x.doc_id: x.kept for x in quality.judge(d, bands=bands).collect()}
    clean = [i for i, t in docs if i < 3000]
    assert sum(not out[i] for i in clean) <= 3 and not out[3002]
    # the same text in another alphabet has limits of its own
    assert bands.bands[0][4][1:] != bands.bands[2][4][1:]
    none = spark.createDataFrame([], lb.schema)
    assert quality.learn(d, none) == plain and quality.learn(d.limit(0), lb) == plain
    assert quality.learn(d, lb, most=10) == plain


def test_limits_are_learnt_from_all_labels(spark):
    """More clean documents than any bound: one of a thousand that compresses better than the others moves the limit."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(r.choice(words) for _ in range(170)) for _ in range(40)]
    odd = " ".join(r.choice(words) + " " + "yes" * 5 for _ in range(60))[:1200]
    docs = [(i, odd if i % 300 == 0 else texts[i % 40]) for i in range(9000)]
    d, lb = spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.range(9000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.labelled(d, lb).count() == 9000
    import zstandard

    compress = zstandard.ZstdCompressor(level=1).compress
    most = max(len(t) / len(compress(t.encode())) for _, t in docs[:300])
    assert abs(quality.learn(d, lb).bands[0][4][2] - most * 1.25) < 0.001
    assert quality.learn(d, lb) == quality.learn(d.repartition(3), lb.union(lb))


@pytest.mark.parametrize("text,script", [("plain text", 0), ("", 0), ("un été là-bas", 0), ("привет мир", 1), ("日本語の文", 2), ("🤖🤖", 2)])
def test_scripts(text, script):
    assert quality.script_of(text.encode()) == script
