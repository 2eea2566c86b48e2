r"""Operator 6: personal data, and terms that give it away.

Base spans are e-mails, IP addresses, card and phone numbers, found by patterns.
Their distinct values are the protected entities.  The words of a whole document
are counted with each of its entities over the corpus, and the information that a
term gives about an entity is their pointwise mutual information, as a share of
the entity's own information content -log p(e): a share of 1 means that the term
occurs only with the entity, as good as naming it.  Terms whose share reaches
GENERALISE are generalised wherever they stand in a document of the entity, and
removed from REMOVE on.  There is no least number of documents: of n documents,
an entity in one of them gets the words of that document that at most
n^(1 - GENERALISE) documents hold.

What a term tells depends on the documents that hold the entity, so entities of
the same documents are one class (told apart by their number and 128 bits over
them): a list of thousands of addresses in one document is one class, not
thousands.  Likewise the terms of the same documents: all words that only one
document holds are one class.  Terms too frequent to tell anything about the most
frequent entity of a document leave before classes meet (an exact bound).  What
is left of a document makes a row for each pair of an entity's class and a term's
class, and equal pairs of a task leave it as one row; a document of more than
PAIRS such pairs is dealt to several tasks.  Nothing grows with pairs of documents.

Everything is DataFrame operations.  Patterns are written so that a long run of
one character class costs one pass (look-behind and possessive repeats), and
loops over groups, which recurse in the JVM's matcher, are classes over marker
characters of the same length instead; the matches are those of the plain
patterns.  A match's place is the length of the gaps and matches before it.

Cases.  Null and empty texts hold nothing.  Rows alike in id and text count
once.  Other columns pass through sanitise(); those named like an output are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm import textkit
from vigilspark.llm.store import settle

KINDS = ("email", "ip", "card", "phone", "term")
GENERALISE, REMOVE = 0.8, 0.95
DOT, GAP = chr(0xE001), chr(0xE000)  # private-use characters; where a text has them, OTHER, which no pattern takes either, stands in
OTHER = chr(0xFFFD)
_LOCAL, _LABEL = f"A-Za-z0-9._%+{DOT}-", "A-Za-z0-9-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]+{DOT}[{_LABEL}{DOT}]*"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{GAP}])[0-9][0-9{GAP}]{{13,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}][\p{L}\p{N}_]{2,}+"
CHUNK = 64  # pieces placed at a time, or the square root of their number
PAIRS = 1 << 18  # pairs of classes of a document that one row holds
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _pieces(text: Column, pattern: str) -> Column:
    """Each match with the gap before it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda x: x["match"].isNotNull())


def _placed(pieces: Column, at: Column, rank: int) -> Column:
    start = F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(KINDS[rank]).alias("kind"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pieces, start, add, lambda acc: acc["spans"])


def located(text: Column, pattern: str, rank: int) -> Column:
    """All matches as spans, in code points: in chunks, so that the work doesn't grow with the square of their number."""
    let = lambda x, f: F.transform(F.array(x), f)[0]
    size = lambda p: F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(p).cast("double"))).cast("int"))
    deal = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size(p)).cast("int")), lambda i: F.slice(p, i * size(p) + 1, size(p)))
    long = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["match"]))
    before = lambda lengths, i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, x: n + x)
    place = lambda chunks: let(F.transform(chunks, long), lambda lengths: F.flatten(F.transform(chunks, lambda c, i: let(before(lengths, i), lambda at: _placed(c, at, rank)))))
    return let(_pieces(text, pattern), lambda p: F.when(F.size(p) > 0, let(deal(p), place)).otherwise(F.array().cast(f"array<{SPAN}>")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """The base spans of a text, by start and kind."""
    none = F.array().cast(f"array<{SPAN}>")
    clean = F.translate(text, DOT + GAP, OTHER + OTHER)
    dotted = F.regexp_replace(clean, rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])", DOT)
    emails = F.when(F.contains(text, F.lit("@")), located(dotted, EMAIL, 0)).otherwise(none)
    part = lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.try_to_number(F.right(p, F.lit(3)), F.lit("999")) <= 255))
    ips = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), F.filter(located(text, IP, 1), lambda s: part(s["value"]))).otherwise(none)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", GAP)
    right = lambda n: F.when(n.between(14, 19), True).otherwise(False)
    cards = F.when(text.rlike(r"(?:[0-9][\x20-]?){14}"), F.filter(F.filter(located(joined, CARD, 2), lambda s: right(F.length(digits(s["value"])))), lambda s: luhn(digits(s["value"])))).otherwise(none)
    phones = F.when(F.contains(text, F.lit("+")), F.filter(located(text, PHONE, 3), lambda s: F.length(digits(s["value"])).between(10, 15))).otherwise(none)
    # What the markers stand for: a dot in an address; a card's value is its digits.
    emails = F.transform(emails, lambda s: s.withField("value", F.translate(s["value"], DOT, ".")))
    cards = F.transform(cards, lambda s: s.withField("value", digits(s["value"])))
    return F.array_sort(F.concat(emails, ips, cards, phones))


def find(docs: DataFrame, generalise: float = GENERALISE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row_key, base (spans), terms (spans of terms that disclose an entity, value: what they get)."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), textkit.row_key(text, doc_id).alias("row_key"))
    based = named.withColumn("base", base_spans(F.col("text")))
    # The rows' own numbers are settled with the table.
    held = settle(based.withColumn("text", F.when(F.size("base") > 0, F.col("text"))).withColumn("uid", F.monotonically_increasing_id()), "pii")
    row, group, kin = ["doc_id", "row_key"], ["n_entity", "one", "two"], ["n_term", "t_one", "t_two"]
    size = held.groupBy(*row).count().agg(F.count("*").alias("total"), F.max("count").alias("most")).first()
    once = lambda df: df.dropDuplicates(row) if (size.most or 1) > 1 else df
    total = size.total
    # A share of generalise needs n_term <= total^(1 - generalise) * n_entity^generalise, as n_both <= n_entity; a little above it for rounding.
    limit = lambda n: F.pow(F.lit(float(total)), F.lit(1 - generalise)) * F.pow(n.cast("double"), F.lit(generalise)) * (1 + 1e-6)
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row_key") == F.col("c_key"))
    other = {"doc_id": "c_id", "row_key": "c_key"}

    own = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], F.lower(s["value"]))))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    marks = [F.xxhash64("doc_id", "row_key").alias("first"), F.xxhash64("row_key", "doc_id", F.lit(1)).alias("second")]
    links = settle(once(held.filter(F.col("text").isNotNull())).select(*row, *marks, own.alias("entities"), words.alias("words")), "links")
    places = links.select(*row, "first", "second", F.explode("entities").alias("entity"))
    entities = settle(places.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor("first").alias("one"), F.bit_xor("second").alias("two")), "entities")
    seen = entities.agg(F.sum("n_entity").alias("places"), F.max("n_entity").alias("most")).first()
    classes = textkit.meet(places, entities, "entity", "n_entity", seen.places or 0).groupBy(*row).agg(F.collect_set(F.struct(*group)).alias("classes"), F.max("n_entity").alias("top")).withColumnsRenamed(other)
    told_of = settle(links.join(classes, same).select(*row, "words", "classes", "top"), "classes")
    # Every term of every document is counted; equal terms of a task leave it as one row.
    spread = once(named).select(*marks, F.explode(words).alias("term"))
    terms = spread.groupBy("term").agg(F.count("*").alias("n_term"), F.bit_xor("first").alias("t_one"), F.bit_xor("second").alias("t_two"))
    terms = settle(terms.filter(F.col("n_term") <= limit(F.lit(seen.most or 0))), "terms")
    said = textkit.meet(told_of.select(*row, "top", F.explode("words").alias("term")), terms, "term", "n_term", terms.agg(F.sum("n_term")).first()[0] or 0)
    said = settle(said.filter(F.col("n_term") <= limit(F.col("top"))).select(*row, "term", *kin), "said")
    sets = said.groupBy(*row).agg(F.collect_set(F.struct(*kin)).alias("kin")).withColumnsRenamed(other)
    met = settle(told_of.join(sets, same).select(*row, "classes", "kin"), "met")
    # A document of many pairs is dealt to many tasks, some of its classes to each.
    product = F.size("classes").cast("long") * F.size("kin")
    part = F.greatest(F.lit(1), F.floor(F.lit(PAIRS) / F.size("kin"))).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), F.floor((F.size("classes") - 1) / part).cast("int")), lambda i: F.slice("classes", i * part + 1, part))
    many = met.filter(product > PAIRS).select(*row, "kin", F.posexplode(dealt).alias("share_ix", "classes")).repartition(*row, "share_ix")
    pairs = met.filter(product <= PAIRS).unionByName(many.drop("share_ix")).select(*row, "kin", F.explode("classes").alias("c")).select(*row, "c.*", F.explode("kin").alias("k")).select(*row, *group, "k.*").filter(F.col("n_term") <= limit(F.col("n_entity")))
    rated = pairs.groupBy(*group, *kin).agg(F.count("*").alias("n_both"))
    known = -F.log2(F.col("n_entity") / total)
    told = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    telling = settle(rated.withColumn("share", F.when(known > 0, told / known)).filter(F.col("share") >= generalise).select(*group, *kin, "n_both", "share"), "telling")

    told_by = textkit.meet(pairs, telling, [*group, *kin], "n_both", telling.agg(F.sum("n_both")).first()[0] or 0).groupBy(*row, *kin).agg(F.max("share").alias("share")).withColumnsRenamed(other | {k: f"of_{k}" for k in kin})
    on = same
    for k in kin:
        on = on & (F.col(k) == F.col(f"of_{k}"))
    hits = said.join(told_by, on).select(F.col("doc_id").alias("t_id"), F.col("row_key").alias("t_key"), "term", "share")
    # A word ends where the gaps and words up to it end.
    lengths = F.transform(_pieces(F.col("text"), TERM), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("n"), F.lower(x["match"]).alias("term")))
    running = Window.partitionBy("uid").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spoken = held.filter(F.col("text").isNotNull()).select("uid", *row, F.posexplode(lengths).alias("at", "w"))
    spoken = spoken.select("uid", *row, "w.term", "w.n", F.sum(F.col("w.gap") + F.col("w.n")).over(running).cast("int").alias("end")).withColumn("start", F.col("end") - F.col("n")).drop("n")
    spoken = spoken.join(hits, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("row_key") == F.col("t_key")) & (spoken["term"] == hits["term"])).select("uid", "start", "end", "share")
    # Words that no base span touches: of the spans that begin before a word's end, the greatest end is not above its start.
    fixed = held.filter(F.size("base") > 0).select("uid", F.explode("base").alias("s")).select("uid", "s.start", "s.end", F.lit(None).cast("double").alias("share"))
    before = Window.partitionBy("uid").orderBy(F.when(F.col("share").isNull(), F.col("start")).otherwise(F.col("end")), F.col("share").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = spoken.unionByName(fixed).withColumn("reach", F.max(F.when(F.col("share").isNull(), F.col("end"))).over(before))
    free = swept.filter(F.col("share").isNotNull() & (F.coalesce("reach", F.lit(0)) <= F.col("start")))
    shown = F.struct("start", F.lit(4).alias("rank"), F.lit(KINDS[4]).alias("kind"), "end", F.when(F.col("share") >= REMOVE, "").otherwise("[WORD]").alias("value"))
    found = free.groupBy(F.col("uid").alias("of")).agg(F.array_sort(F.collect_list(shown)).alias("terms"))
    none = F.array().cast(f"array<{SPAN}>")
    return held.join(found, F.col("uid") == F.col("of"), "left").select(*row, "base", F.coalesce(F.col("terms").cast(f"array<{SPAN}>"), none).alias("terms"))


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(found: DataFrame) -> DataFrame:
    """The contract's columns of find()'s rows."""
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(4)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """docs with pii (all spans) and sanitised: the text with [EMAIL] and so on for base spans, and telling terms generalised or removed."""
    found = find(docs, text=text, doc_id=doc_id, **settings).dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", F.array_sort(F.concat("base", "terms")).alias("pii"))
    names = [c for c in docs.columns if c == text or c not in ("pii", "sanitised")]
    rows = textkit.numbered(docs.select(*names))
    at = {c: f"in{i}" for i, c in enumerate(names)}
    joined = rows.withColumn("key", textkit.row_key(at[text], at[doc_id])).join(found, F.col(at[doc_id]).eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row_key")))
    body = F.coalesce(F.col(at[text]), F.lit(""))

    def add(acc: Column, s: Column) -> Column:
        shown = F.when(s["rank"] < 4, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(s["value"])
        longer = F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), shown)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], longer).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("pii", start, add, lambda acc: F.concat(acc["out"], F.substr(body, acc["at"] + 1, F.length(body))))
    return joined.select(*textkit.restored(names), "pii", F.when(F.col(at[text]).isNotNull(), made).alias("sanitised"))
