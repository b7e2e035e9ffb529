"""How the sources of a language differ in their words, by stripes that are filled inside the mappers.

A task folds whole documents into stripes: for each language and term the number of documents that hold it
and its count by source. Full tables are spilled as rows; the shuffle brings a term's stripes together in
order, and neighbours are merged as they stream by. Of the merged stripes only terms in enough documents
stay. They are then read by language and lot of terms, and every lot gives its share of the divergence
between each two sources, and the terms in which a source exceeds its language most.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, slices, stored

#: Documents that a kept term stands in, and ranks that are returned of terms.
LEAST_DOCS, TOP = 10, 10
#: Counts that a task holds before it spills, bytes of a text that are cut into terms at once, kept terms
#: of a lot, and cells of a matrix of terms by sources.
SPILL_COUNTS, PART_BYTES, LOT_TERMS, CELLS = 400_000, 1 << 22, 8192, 1 << 21
SCALE = 1_000_000_000

#: A to Z as small letters; letters and all bytes of other scripts stay, all others are spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in parts that end between terms."""
    plain, at = text.translate(_TERMS), 0
    while at < len(plain):
        end = at + PART_BYTES
        if end < len(plain):
            gap = plain.find(b" ", end)
            end = len(plain) if gap < 0 else gap
        yield plain[at:end].split()
        at = end


_STRIPE = "lang string, term string, docs bigint, sources array<string>, counts array<bigint>"
_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    out = [pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)]
    out[1] = out[1].cast(pa.string())
    return pa.RecordBatch.from_arrays(out, names=_SCHEMA.names)


class Stripes:
    """Document counts by language and term, and counts by language, source and term."""

    def __init__(self):
        self.docs: dict[str, Counter] = defaultdict(Counter)
        self.counts: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes) -> None:
        own, counts = set(), self.counts[lang, source]
        for part in terms(text):
            counts.update(part)
            own.update(part)
        self.docs[lang].update(own)

    def full(self) -> bool:
        return sum(map(len, self.counts.values())) > SPILL_COUNTS

    def spill(self) -> Iterator[pa.RecordBatch]:
        by = defaultdict(list)
        for (lang, source), counts in self.counts.items():
            by[lang].append((source, counts))
        for lang, docs in self.docs.items():
            found: dict[bytes, tuple[list, list]] = {t: ([], []) for t in docs}
            for source, counts in by[lang]:
                for t, n in counts.items():
                    names, values = found[t]
                    names.append(source)
                    values.append(n)
            rows = [(lang, t, n, *found[t]) for t, n in docs.items()]
            for i in range(0, len(rows), 20_000):
                yield _rows(rows[i : i + 20_000])
        self.__init__()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for b in slices(batches):
        for text, lang, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            stripes.add(lang, source, text)
        if stripes.full():
            yield from stripes.spill()
    yield from stripes.spill()


def _folded(rows: pa.RecordBatch, starts: np.ndarray, least_docs: int) -> pa.RecordBatch:
    """One row for each group of equal keys (they begin at the starts) with enough documents."""
    docs = np.add.reduceat(rows["docs"].to_numpy(), starts)
    kept = np.flatnonzero(docs >= least_docs)
    sizes = np.diff(np.append(starts, rows.num_rows))
    own = pa.array(np.repeat(docs >= least_docs, sizes))
    group = np.repeat(np.arange(len(kept)), sizes[kept])
    lists = rows["sources"].filter(own)
    names = lists.flatten().dictionary_encode()
    many = max(1, len(names.dictionary))
    key = group[pc.list_parent_indices(lists).to_numpy()] * many + names.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, counts = key[order], rows["counts"].filter(own).flatten().to_numpy()[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(counts, first) if len(first) else counts
    at = pa.array(np.searchsorted(key[first] // many, np.arange(len(kept) + 1)).astype(np.int32))
    sources = names.dictionary.take(pa.array(key[first] % many))
    place = pa.array(starts[kept])
    cols = [rows["lang"].take(place), rows["term"].take(place), pa.array(docs[kept]), pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, pa.array(sums))]
    return pa.RecordBatch.from_arrays(cols, names=_SCHEMA.names)


def merged(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, docs, sources, counts of the terms that stand in enough documents of their language."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # rows of the last key, which may go on
        for b in batches:
            rows = b if open_ is None else pa.Table.from_batches([open_, b.cast(open_.schema)]).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            same = np.ones(rows.num_rows, bool)
            same[0] = False
            for c in ("lang", "term"):
                same[1:] &= pc.equal(rows[c][1:], rows[c][:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(~same)
            open_ = rows.slice(starts[-1])
            if open_.num_rows > 64:
                open_ = _folded(open_, np.zeros(1, np.int64), 0)
            if len(starts) > 1:
                yield _folded(rows.slice(0, starts[-1]), starts[:-1], least_docs)
        if open_ is not None:
            yield _folded(open_, np.zeros(1, np.int64), least_docs)

    lots = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.mapInArrow(_fold, _STRIPE).repartition(lots, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merge, _STRIPE)


def scaled(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), by long division in three steps of a thousand,
    each exact in 64 bits."""
    below = np.asarray(total, np.int64) + 2 * kept
    out, rest = np.divmod(counts + 2, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


_SHARE = "lang string, source string, part string, item string, value bigint"
_SHARES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shares(key: tuple, stripes: pa.Table, totals: pa.Table) -> pa.Table:
    """Of a lot of a language's terms: sums for each two sources, and each source's foremost terms."""
    if not totals.num_rows:
        return _SHARES.empty_table()
    t = totals.to_pylist()[0]
    sources = sorted(t["sources"], key=lambda s: s["source"].encode())
    names, n = [s["source"] for s in sources], np.array([s["n"] for s in sources], np.int64)
    place = {s: i for i, s in enumerate(names)}
    stripes = stripes.take(pc.sort_indices(stripes["term"].cast(pa.binary())))
    words = stripes["term"].to_pylist()
    sums = np.zeros((len(names), len(names)), np.int64)
    best: list[list[tuple[int, str]]] = [[] for _ in names]
    step = max(1, CELLS // len(names))
    for at in range(0, len(words), step):
        part = stripes.slice(at, step)
        lists = part["sources"].combine_chunks()
        row, col = pc.list_parent_indices(lists).to_numpy(), np.array([place[s] for s in lists.flatten().to_pylist()], np.int64)
        counts = np.zeros((part.num_rows, len(names)), np.int64)
        counts[row, col] = part["counts"].combine_chunks().flatten().to_numpy()
        p = scaled(counts, n, t["kept"])
        q = scaled(counts.sum(axis=1), n.sum(), t["kept"])
        for a in range(len(names)):
            sums[a, a + 1 :] += divergence(p[:, a, None], p[:, a + 1 :]).sum(axis=0)
            above = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
            f = divergence(p[above, a], q[above])
            first = np.argsort(-f, kind="stable")[:TOP]  # terms are in order
            best[a] = sorted(best[a] + [(-int(f[i]), at + int(above[i])) for i in first])[:TOP]
    out = [(t["lang"], names[a], "pair", names[b], int(sums[a, b])) for a in range(len(names)) for b in range(a + 1, len(names))]
    out += [(t["lang"], names[a], "term", words[i], -f) for a in range(len(names)) for f, i in best[a]]
    cols = list(zip(*out, strict=True)) or [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SHARES, strict=True)], schema=_SHARES)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of every source from each other one of its
    language (part `pair`), and the ten terms in which it exceeds its language most (part `term`).

    docs: text, lang, source; nulls in any of them are empty strings, other columns are not read, whatever
    their names. Every row is a document, repeated or not. A language without kept terms has pairs of value
    0; one source alone has none. Ties of a value rank by the item's bytes. An empty table gives an empty one.
    """
    given = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    kept = stored(merged(given, least_docs), "stripes")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    pairs = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    in_terms = kept.select("lang", pairs).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = given.select("lang", "source").distinct().join(in_terms, ["lang", "source"], "left")
    # one row a language, its sources and their totals; as many copies as there are lots of terms
    lots = 1 + kept.count() // LOT_TERMS
    totals = groups.groupBy("lang").agg(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))).alias("sources"))
    totals = totals.join(sizes, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    totals = totals.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("lot", F.col("lot").cast("long"))
    dealt = kept.withColumn("lot", F.pmod(F.xxhash64("term"), F.lit(lots)))
    shares = dealt.groupBy("lang", "lot").cogroup(totals.groupBy("lang", "lot")).applyInArrow(_shares, _SHARE)
    shares = stored(shares, "shares")
    forget(kept)
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pair = shares.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", both, "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    columns = ["lang", "source", "part", "item", "value", rank]
    return pair.select(columns).unionByName(shares.where("part = 'term'").select(columns).where(F.col("rank") <= TOP))


SQL = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), kept AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 10
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
    SELECT DISTINCT lang, source FROM d
), v AS (
    SELECT lang, count(kept.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang
), total AS (
    SELECT lang, source, v, coalesce(sum(n), 0)::BIGINT AS total FROM groups JOIN v USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY lang, source, v
), p AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS p
    FROM total JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), q AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 2)) // (any_value(t.total) + 2 * any_value(t.v)) AS q
    FROM p JOIN (SELECT lang, v, sum(total)::HUGEINT AS total FROM total GROUP BY lang, v) t USING (lang) GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
), said AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM said
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 10
"""
