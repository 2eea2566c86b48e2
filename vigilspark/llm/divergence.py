"""Operator 12: how far the sources of a language diverge in their terms.

Terms are counted within a task, a bounded table at a time, and added up by one
aggregation over (lang, source, term).  Each kept term of a language is then one
row with an array of its counts, indexed by the language's sources.  Higher-order
functions turn the counts into scaled probabilities, and these give the
contributions of the pairs of sources, each a row, which are added up before any exchange.
Terms with equal arrays contribute alike, so they are one row with a multiplicity.

All arithmetic is on whole numbers: a probability is 1 + floor(SCALE * (n + 1) /
(N + V)), found three decimal digits at a time so that nothing overflows below
2^63 / 1000 words of a source.

The pairs of a language's sources are its output, so a language has at most as
many sources as their square can be written; a row holds one array of that length.

Cases.  A null text, lang or source is an empty one.  A group without terms has
counts of zero, and so the least probabilities; where a language keeps no term,
its pairs have the value 0.  Ties are broken by the item's bytes.  Repeated rows
are documents of their own.  An empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import textkit
from vigilspark.llm.bpe import pieces
from vigilspark.llm.store import discard, settle

HELD = 1 << 17  # terms that a task counts before it passes them on
SALTS = 16
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")  # over UTF-8, the characters outside ASCII and its letters


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            size = len(terms) + 1  # a null term stands for the group itself
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([None, *terms], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *[docs[t] for t in terms]], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in it:
        for part in pieces(batch, 2):
            lang, source, text = (part.column(i) for i in range(3))
            for where, who, said in zip(lang.to_pylist(), source.to_pylist(), text.cast(pa.binary()).to_pylist()):
                n, docs = held.setdefault((where, who), (Counter(), Counter()))
                found = TERM.findall(said.lower())  # of bytes: A-Z only
                n.update(found)
                docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and for each group a row with a null term."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = read.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, size: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / size), for n + 1 <= size."""
    whole, rest = F.lit(0).cast("long"), n + 1
    for _ in range(3):
        more = rest * 1000
        rest = more % size
        whole = whole * 1000 + _div(more, size)
    return whole + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language the other sources by divergence, and its top terms against the language."""
    counts = settle(term_counts(docs, text, lang, source), "term-counts")
    entries = F.collect_list(F.struct("source", "n"))
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), entries.alias("entries")).filter(F.col("docs") >= min_docs)
    sources = counts.filter("term is null").groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    kept = settle(terms.select("lang", "term", "total", "entries"), "terms")
    langs = settle(sources.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("all")), "lang", "left").na.fill(0, ["v", "all"]), "langs")
    n_terms = langs.agg(F.sum("v")).first()[0] or 0
    named = textkit.meet(kept, langs.select("lang", "sources", "v"), "lang", "v", n_terms)
    by_source = F.map_from_entries("entries")
    wide = settle(named.select("lang", "term", "total", F.transform("sources", lambda s: F.coalesce(F.element_at(by_source, s), F.lit(0).cast("long"))).alias("counts")), "wide")
    sizes = wide.select("lang", F.posexplode("counts").alias("at", "n")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    inside = sizes.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("sizes"))
    none = F.transform("sources", lambda s: F.lit(0).cast("long"))
    facts = settle(langs.join(inside, "lang", "left").withColumn("sizes", F.coalesce("sizes", none)), "facts")

    alike = settle(wide.groupBy("lang", "counts").agg(F.count("*").alias("times")), "alike")
    # v is at least the number of a language's arrays: fewer than 256 languages have more than a 256th of all terms.
    dealt = textkit.meet(alike, facts.select("lang", "sizes", "v"), "lang", "v", n_terms).select("lang", "times", _probabilities().alias("p"))
    first = dealt.select("lang", "times", "p", F.posexplode("p").alias("a", "own"))
    # Pairs are rows before they are rated, so that this runs as compiled code; equal probabilities give 0, which the join below puts in.
    met = first.select("lang", "times", "a", "own", F.posexplode("p").alias("b", "other")).filter("a <> b and own <> other")
    added = met.groupBy("lang", "a", "b").agg(F.sum(divergence(F.col("own"), F.col("other")) * F.col("times")).alias("value"))
    one = facts.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    both = one.select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).filter("a <> b")
    valued = both.join(added, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = [F.desc("value"), F.asc("item")]
    pairs = valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    own = textkit.meet(wide, facts.select("lang", "sources", "sizes", "v", "all"), "lang", "v", n_terms)
    q = probability(F.col("total"), F.col("all") + F.col("v"))
    placed = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    over = own.select("lang", "term", "sources", "counts", _probabilities().alias("p"), q.alias("q")).select("lang", F.col("term").alias("item"), "q", F.explode(placed).alias("x"))
    rated = over.select("lang", F.col("x.sources").alias("source"), "item", divergence(F.col("x.p"), F.col("q")).alias("value"), F.pmod(F.hash("item"), F.lit(SALTS)).alias("salt"))
    # The best of each salt, then the best of those: no task sees all terms of a group.
    best = rated.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top)
    discard(counts, kept)
    return _part(pairs, "pair").unionByName(_part(ranked, "term"))


def _probabilities() -> Column:
    return F.zip_with("counts", "sizes", lambda n, size: probability(n, size + F.col("v")))


def _part(rows: DataFrame, part: str) -> DataFrame:
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
