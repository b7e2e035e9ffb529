"""Personal data: fixed kinds by pattern, and terms that disclose them by co-occurrence.

The values found by pattern (email, ip, card, phone) are the protected entities, and so are what groups them:
the mail domain, the first three parts of an address, the issuer's six digits of a card, country and area of
a phone number. Over the corpus, n(t) and n(e) count the documents that hold a term and an entity, and c(t, e)
those in which the term stands beside the entity. A term discloses an entity by the share
PMI(t; e) / IC(e), where IC(e) = -log p(e) is all there is to know and PMI(t; e) = log(p(t, e) / (p(t) p(e)))
what the term tells: 1 means that the term stands in no document without standing beside the entity there.
Terms that do so in enough documents, and whose share reaches the threshold, are treated wherever they stand:
from `remove_from` they are removed, below generalised to a placeholder.

All work is done by built-in functions. Positions come from the parts between matches: the lengths of
parts and matches, summed up, give starts and ends in code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, stored

# Every repetition is possessive where what follows cannot be part of it, so matching never goes back
# over a text; a look-behind (or the end of the last match) skips starts inside a run. Both find the
# same matches as the plain patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of the kind holds, to pass over texts quickly.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_WORD = r"[\p{L}\p{M}\p{N}_]+"
_SPLIT = r"[^\p{L}\p{M}\p{N}_]+"
LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "gone": ""}


@dataclass(frozen=True)
class Disclosure:
    """window: words of context on each side of a value; a number is no term. least_docs: documents in which
    term and entity must meet. share: the disclosed share of the entity's information from which a term is
    treated; remove_from: from which it is removed rather than generalised."""

    window: int = 3
    least_docs: int = 2
    share: float = 0.9
    remove_from: float = 0.999


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


_SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string,before:string,after:string>>"


def _matches(text: Column, pattern: Column | str, kind: Column | str, context: bool) -> Column:
    """Every match as (start, end, kind, value, text before it, text after it)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None).cast("string")
    found, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(parts.alias("p"), found.alias("v"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["p"])
        b = a + F.coalesce(F.length(x["v"]), F.lit(0))
        one = F.struct(a.alias("start"), b.alias("end"), kind.alias("kind"), x["v"].alias("value"), (x["p"] if context else none).alias("before"), none.alias("after"))
        return F.struct(b.alias("at"), F.when(x["v"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    if not context:
        return spans
    return F.transform(spans, lambda s, i: s.withField("after", F.get(parts, i + 1)))


def base_spans(text: Column, context: bool = False) -> Column:
    """The valid matches of all kinds, by start and then kind in the listed order. Only texts that hold
    a match pay for positions."""
    empty = F.array().cast(_SPAN)
    every = []
    for kind, pattern in PATTERNS.items():
        some = text.rlike("[0-9](?:[\\x20-]?[0-9]){13}") if kind == "card" else text.contains(_NEEDS[kind])
        every.append(F.when(some, F.filter(_matches(text, pattern, kind, context), partial(_valid, kind))).otherwise(empty))
    return _sorted(F.concat(*every))


def _order(kind: Column) -> Column:
    out = F.lit(9)
    for i, k in enumerate([*PATTERNS, "term", "gone"]):
        out = F.when(kind == k, i).otherwise(out)
    return out


def _sorted(spans: Column) -> Column:
    """By start, then kind."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), _order(s["kind"]).alias("k"), s["end"].alias("e"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _context(side: Column, last: bool, n: int) -> Column:
    """The n words nearest to the value, lower-cased."""
    words = F.filter(F.split(F.lower(side), _SPLIT), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    size = F.size(words)
    return F.slice(words, F.greatest(size - n + 1, F.lit(1)), F.lit(n)) if last else F.slice(words, 1, n)


def _entities(span: Column) -> Column:
    """A value and what groups it, each under a name of its kind."""
    value, kind = F.lower(span["value"]), span["kind"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    wider = F.when(kind == "email", F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))
    wider = wider.when(kind == "ip", F.concat(F.lit("net:"), F.substring_index(value, ".", 3)))
    wider = wider.when(kind == "card", F.concat(F.lit("issuer:"), F.left(digits, F.lit(6))))
    return F.array(F.concat(kind, F.lit(":"), value), wider.otherwise(F.concat(F.lit("area:"), F.left(digits, F.lit(4)))))


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT))


def disclosing_terms(docs: DataFrame, found: DataFrame, rule: Disclosure) -> DataFrame:
    """t, share: words whose presence discloses an entity. docs (text, one row a document), found (_row, base)."""
    spans = found.where(F.size("base") > 0).select("_row", F.explode("base").alias("s"))
    near = spans.select("_row", F.explode(_entities(F.col("s"))).alias("e"), F.array_distinct(F.concat(_context(F.col("s.before"), True, rule.window), _context(F.col("s.after"), False, rule.window))).alias("ts"))
    pairs = near.select("_row", "e", F.explode("ts").alias("t")).distinct().groupBy("e", "t").agg(F.count("*").alias("c"))
    pairs = stored(pairs.where(F.col("c") >= rule.least_docs), "pairs")
    entities = near.select("_row", "e").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    counts = docs.select(F.explode(_terms_of(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("n"))
    told = pairs.join(entities, "e").join(counts, "t").join(F.broadcast(total))  # one row
    ic = -F.log(F.col("n_e") / F.col("n"))
    pmi = F.log(F.col("c") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    # an entity that every document holds has nothing to tell
    return told.where("n_e < n").withColumn("share", pmi / ic).where(F.col("share") >= rule.share).groupBy("t").agg(F.max("share").alias("share"))


def find(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """docs (doc_id, text and others) with base and all_spans: arrays of (start, end, kind, value, ...).

    Kinds beside the fixed ones: `term` (generalise) and `gone` (remove). Positions are code points of the
    whole text, end exclusive. Null text: no spans. Rows with equal doc_id and text count as one document
    for the statistics, and each is returned. Columns of docs named base or all_spans give way (in any case of
    letters); all others stay, whatever their names. An empty table gives an empty one.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("base", "all_spans")])
    row = F.xxhash64("doc_id", "text")
    own, own_terms = private(docs, "_row", "_terms")
    found = docs.select(row.alias("_row"), base_spans(F.coalesce("text", F.lit("")), True).alias("base"))
    once = docs.select(row.alias("_row"), "text").dropDuplicates(["_row"]) if _repeats(docs, row) else docs.select("text")
    terms = stored(disclosing_terms(once, found.where(F.size("base") > 0), rule), "terms")
    # documents that hold such a term, with their terms as one pattern
    words = docs.select(row.alias("_row"), F.explode(_terms_of(F.col("text"))).alias("t"))
    level = F.when(F.col("share") >= rule.remove_from, "gone").otherwise("term")
    hits = words.join(terms.withColumn("kind", level), "t").groupBy(F.col("_row").alias(own)).agg(F.array_sort(F.collect_set(F.struct("t", "kind"))).alias(own_terms))
    full = docs.withColumn(own, row).join(hits, own, "left").drop(own)
    text, listed = F.coalesce("text", F.lit("")), F.col(own_terms)

    def of_kind(kind: str) -> Column:
        ts = F.array_join(F.transform(F.filter(listed, lambda t: t["kind"] == kind), lambda t: t["t"]), "|")
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}_])(?:"), ts, F.lit(r")(?![\p{L}\p{M}\p{N}_])"))
        return F.when(ts != "", _matches(text, pattern, kind, False)).otherwise(F.array().cast(_SPAN))

    added = F.when(listed.isNull(), F.array().cast(_SPAN)).otherwise(F.concat(of_kind("term"), of_kind("gone")))
    out = full.withColumn("base", base_spans(text))
    return out.withColumn("all_spans", _sorted(F.concat("base", added))).drop(own_terms)


def _repeats(docs: DataFrame, row: Column) -> bool:
    """Whether some row stands twice; only hashes are shuffled to tell."""
    return not docs.groupBy(row.alias("_row")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by the placeholder of its kind. Overlapping spans are one, with
    the placeholder of the first."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def label(kind: Column) -> Column:
        out = F.lit("")
        for k, v in LABEL.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), label(s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_terms."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    terms = F.size(F.filter("all_spans", lambda s: s["kind"].isin("term", "gone"))).cast("long").alias("n_terms")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all_spans")).alias("spans"), terms)
