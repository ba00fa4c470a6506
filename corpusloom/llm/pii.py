"""Personal data: pattern spans, and the terms around them that give the same entity away. DataFrame functions only.

Base spans are leftmost matches of four patterns, one kind at a time; a match that fails its kind's test is dropped.
The possessive patterns below match what the plain ones do in time linear in the text: a run that fails from its first
character fails from every later one, so a match starts where the run does or where the last match ended.

The method then looks at the words of at least four letters of the whole text, spans apart. Over all documents it counts
how many hold entity e, hold term t, and hold both. The information of e is IC(e) = log2(N / df(e)), what t tells of it
is PMI(t, e) = log2(N df(t, e) / (df(t) df(e))). What few texts show is shrunk: of w witnesses PMI * w / (w + 1) counts.
At or above DISCLOSED * IC a term is generalised, at or above REMOVED * IC it is removed where the entity is spelled; in
documents that hold the term alone it is generalised as well. With DISCLOSED at 0.75 a term needs three witnesses that no
other document contradicts, whatever the table's size, and with REMOVED at 0.9 nine. So that chance does not count among
so many words, the pair's log-likelihood ratio, lowered by the share of its documents that are witnesses, must also reach
the level CHANCE shared among all pairs looked at.

Witnesses are different texts, not copies. Near copies share their words without being evidence for them: `alike` is the
share of a word's occurrences in an entity's texts that another text of it has too. Up to APART each text is a witness;
from SAME on, the level of near-duplicates, all are one; in between they count in proportion.

Defined cases: a null text counts as empty (sanitise leaves it null); an empty table gives an empty one; rows that
repeat are handled each for itself; overlapping base spans stay as they are in the list, and in sanitise give one
placeholder, of the first kind; sanitise masks again until nothing is left what a placeholder beside it turns into a
match; columns named like the added ones are replaced, all others pass through. Entities that the same texts hold are
counted as one class, so a text with many entities of its own meets its words once. Places in a text come from running
sums in parts of PART elements, so a text of any number of spans takes time near its length.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, let, staged, text_of

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP = r"^{0}\.{0}\.{0}\.{0}$".format(r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?")
WORD = r"\p{L}{4,}"
#: Least log-likelihood ratio of a pair: chi square with one degree of freedom at 0.0005.
SURE = 12.12
CHANCE = 0.05
DISCLOSED, REMOVED = 0.75, 0.9
#: Likeness of an entity's texts up to which each is a witness, and from which all are one.
APART, SAME = 0.5, 0.8
#: Elements that a running sum or a text's rebuilding takes at once.
PART = 64
#: Parts of a text's map of terms.
DRAWERS = 64
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
CUTS = "array<struct<start:int,end:int,put:string>>"
TERMS = "array<struct<start:int,end:int,removed:boolean>>"


def parts(values: Column) -> Column:
    """The array in arrays of PART elements."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / PART).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * PART + 1, PART))


def running(values: Column, step, first: int) -> Column:
    """What step makes of all elements before each one. Appending within parts keeps copies of the result short."""

    def plain(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")), lambda acc: acc["out"])

    def in_parts(xs: Column) -> Column:
        return let(parts(xs), lambda ps: F.flatten(F.zip_with(ps, plain(F.transform(ps, lambda p: F.aggregate(p, F.lit(first), step)), F.lit(first)), plain)))

    return let(values, lambda xs: F.when(F.size(xs) <= PART, plain(xs, F.lit(first))).otherwise(in_parts(xs)))


def places(text: Column, pattern: str) -> Column:
    """Array of start and m for a pattern's leftmost non-overlapping matches: the pieces between them give the places."""
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda e: e["g"] + F.coalesce(F.length(e["m"]), F.lit(0))), lambda a, n: a + n, 0)
        return F.filter(F.zip_with(x, before, lambda e, at: F.struct((at + e["g"]).alias("start"), e["m"].alias("m"))), lambda e: e["m"].isNotNull())

    return let(pairs, placed)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """SPAN array of a pattern's matches."""
    return F.transform(places(text, pattern), lambda e: F.struct(e["start"].alias("start"), F.lit(kind).alias("kind"), (e["start"] + F.length(e["m"])).alias("end"), e["m"].alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, -i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """SPAN array of all base spans, by start, then kind."""
    none = F.array().cast(SPAN)
    digit = text.rlike("[0-9]")
    email = F.when(F.contains(text, F.lit("@")), matches(text, PATTERNS["email"], 0)).otherwise(none)
    ip = F.when(digit, F.filter(matches(text, PATTERNS["ip"], 1), lambda s: s["value"].rlike(IP))).otherwise(none)
    card = F.when(digit, F.filter(F.filter(matches(text, PATTERNS["card"], 2), lambda s: F.length(digits(s["value"])).between(14, 19)), lambda s: luhn(digits(s["value"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PATTERNS["phone"], 3), lambda s: F.length(digits(s["value"])).between(10, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


def entity(span: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind"] + 1)
    return F.concat_ws(":", kind, F.when(span["kind"].isin(2, 3), digits(span["value"])).otherwise(F.lower(span["value"])))


def cuts_of(spans: Column, put) -> Column:
    """CUTS array of the places that the spans (by start) cover, each once: a span that reaches on from one before it gives its rest and puts nothing there. put: what stands in place of a span's n code points."""

    def cut(s: Column, reached: Column) -> Column:
        start = F.greatest(s["start"], reached)
        return F.struct(start.alias("start"), s["end"].alias("end"), put(s, s["end"] - start, s["start"] >= reached).alias("put"))

    return let(spans, lambda x: F.filter(F.zip_with(x, running(F.transform(x, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0), cut), lambda c: c["start"] < c["end"]))


def blanked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans: no word reaches into one, and places stay."""
    return F.when(F.size(spans) == 0, text).otherwise(rebuilt(text, cuts_of(spans, lambda s, n, first: F.repeat(F.lit(" "), n))))


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def marked_words(text: Column, risky: Column) -> Column:
    """TERMS array of the words that are keys of the map (in drawers), with its value, by start."""

    def found(e: Column) -> Column:
        removed = let(F.lower(e["m"]), lambda w: F.try_element_at(F.try_element_at(risky, drawer(w)), w))
        return F.struct(e["start"].alias("start"), (e["start"] + F.length(e["m"])).alias("end"), removed.alias("removed"))

    return F.filter(F.transform(places(text, WORD), found), lambda w: w["removed"].isNotNull())


def drawer(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(DRAWERS))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _spans and _key, a digest of the text."""
    return docs.withColumn("_spans", base_spans(text_of(text))).withColumn("_key", key_of(text))


def plain(text: str = "text") -> Column:
    """The text without its spans."""
    return F.when(F.size("_spans") > 0, blanked(text_of(text), F.col("_spans"))).otherwise(text_of(text))


def key_of(text: str = "text") -> Column:
    return F.unhex(F.md5(text_of(text)))


def likelihood_ratio(n: Column, a: Column, b: Column, both: Column) -> Column:
    """Dunning's ratio of two events in n documents that a, b and both of them hold."""

    def f(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    cells = f(both) + f(a - both) + f(b - both) + f(n - a - b + both)
    return 2 * (cells - f(a) - f(n - a) - f(b) - f(n - b) + f(n))


def shared_level(tried: int) -> float:
    """Least ratio that all of so many words together exceed by chance with probability CHANCE, SURE at least."""
    return max(SURE, NormalDist().inv_cdf(CHANCE / 2 / max(tried, 1)) ** 2)


def bounded(df: DataFrame) -> DataFrame:
    """df, staged before, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def disclosing_terms(found: DataFrame, text: str = "text", disclosed: float = DISCLOSED, removed: float = REMOVED) -> DataFrame:
    """One row a text that holds risky terms: _key, _risky (map of term to whether it is removed). found: with_base() rows, staged."""
    n = found.count()
    own = staged(found.where(F.size("_spans") > 0).select("_key", F.array_distinct(F.transform("_spans", entity)).alias("entities"), words_of(plain(text)).alias("words")), "pii-own")
    held = staged(own.select("_key", F.explode("entities").alias("entity")).groupBy("_key", "entity").agg(F.count("*").alias("docs")), "pii-held")
    # entities of the same texts have the same counts with every term
    same = F.struct(F.sum("docs").alias("df_e"), F.count("*").alias("texts"), F.bit_xor(F.xxhash64("_key")).alias("x"), F.bit_xor(F.xxhash64("_key", F.lit(1))).alias("y"))
    classes = held.groupBy("entity").agg(same.alias("class"))
    # fewer texts than this are shrunk below the threshold whatever they show
    least = math.ceil(disclosed / (1 - disclosed) - 1e-9)
    texts = staged(held.join(classes, "entity").where(F.col("class.texts") >= least).select("_key", "class", "docs").distinct(), "pii-classes")
    words = own.select("_key", F.explode("words").alias("term")).distinct()
    pairs = staged(texts.join(words, "_key"), "pii-pairs")
    both = staged(pairs.groupBy("class", "term").agg(F.sum("docs").alias("df_te"), F.count("*").alias("texts")), "pii-both")
    level = shared_level(both.count())
    shared = both.groupBy("class").agg((F.sum(F.col("texts") * (F.col("texts") - 1)) / ((F.first("class.texts") - 1) * F.sum("texts"))).alias("alike"))
    all_docs, df_e = F.lit(float(n)), F.col("class.df_e")
    ic = F.log2(all_docs / df_e)
    apart = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(SAME) - F.col("alike")) / (SAME - APART)))

    def judge(rows: DataFrame, df_t: Column) -> DataFrame:
        """Rows with told and ratio for so many documents with the term; both fall as that number rises."""
        told = F.log2(all_docs * F.col("df_te") / (df_t * df_e)) * F.col("w") / (F.col("w") + 1)
        return rows.withColumn("told", told).withColumn("ratio", likelihood_ratio(all_docs, df_e, df_t, F.col("df_te")) * F.col("w") / F.col("df_te")).where((ic > 0) & (F.col("told") >= disclosed * ic - 1e-9) & (F.col("ratio") >= level))

    # the documents with spans alone show that most terms are too frequent; only the others are counted in all documents
    near = own.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df_own"))
    able = both.where(F.col("texts") >= least).join(shared, "class").join(near, "term").withColumn("w", 1 + (F.col("texts") - 1) * apart)
    able = staged(judge(able, F.col("df_own")).select("class", "term", "df_te", "w"), "pii-able")
    holders = staged(found.select("_key", F.explode(words_of(plain(text))).alias("term")).join(bounded(staged(able.select("term").distinct(), "pii-terms")), "term"), "pii-holders")
    judged = judge(able.join(holders.groupBy("term").agg(F.count("*").alias("df_t")), "term"), F.col("df_t"))
    risky = bounded(staged(judged.select("class", "term", (F.col("told") >= removed * ic - 1e-9).alias("removed")), "pii-risky"))
    here = pairs.join(risky, ["class", "term"]).select("_key", "term", "removed")
    there = holders.distinct().join(risky.select("term").distinct(), "term").select("_key", "term", F.lit(False).alias("removed"))
    # of a term that discloses several entities the strictest decision holds
    terms = here.unionByName(there).groupBy("_key", "term").agg(F.max("removed").alias("removed"))
    drawers = terms.groupBy("_key", drawer(F.col("term")).alias("drawer")).agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("terms"))
    return drawers.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("drawer", "terms"))).alias("_risky"))


def with_spans(docs: DataFrame, text: str = "text", disclosed: float = DISCLOSED, removed: float = REMOVED) -> DataFrame:
    """docs with _spans (base) and _terms (start, end, removed; by start).

    Texts meet their terms by a join on the digest: Spark splits the part of a text with very many copies.
    """
    found = staged(with_base(docs.drop("_spans", "_key", "_risky", "_terms"), text), "pii-found")
    risky = staged(disclosing_terms(found, text, disclosed, removed), "pii-risky-texts")
    joined = found.join(risky, "_key", "left")
    terms = F.when(F.col("_risky").isNotNull(), marked_words(plain(text), F.col("_risky"))).otherwise(F.array().cast(TERMS))
    return joined.withColumn("_terms", terms).drop("_key", "_risky")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined. spans: structs that begin with start, kind, end."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def term_spans() -> Column:
    return F.array_distinct(F.transform("_terms", lambda w: F.struct(w["start"].alias("start"), F.lit(TERM).alias("kind"), w["end"].alias("end"))))


def find_personal_data(docs: DataFrame, text: str = "text", disclosed: float = DISCLOSED, removed: float = REMOVED) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    docs = docs.drop("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    made = with_spans(docs, text, disclosed, removed)

    def of_kind(i: int) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")

    for i, kind in enumerate(KINDS):
        made = made.withColumn(f"n_{kind}", of_kind(i))
    bare = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return made.withColumn("base_sha256", F.sha2(listed(bare), 256)).withColumn("spans", listed(F.array_sort(F.concat(bare, term_spans())))).drop("_spans", "_terms")


def rebuilt(text: Column, cuts: Column) -> Column:
    """The text with each cut (start, end, put; by start, apart) replaced. Each part of the cuts takes its own piece of the text."""

    def piece(own: Column, start: Column) -> Column:
        local = F.substring(text, start + 1, F.element_at(own, -1)["end"] - start)
        first = F.struct(start.alias("at"), F.array().cast("array<string>").alias("out"))
        made = let(local, lambda x: F.aggregate(own, first, lambda acc, c: F.struct(c["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(x, acc["at"] - start + 1, c["start"] - acc["at"]), c["put"])).alias("out")), lambda acc: acc["out"]))
        return F.array_join(made, "")

    def joined(ps: Column) -> Column:
        ends = F.transform(ps, lambda p: F.element_at(p, -1)["end"])
        starts = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ps))
        return F.concat(F.array_join(F.zip_with(ps, starts, piece), ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return F.when(F.size(cuts) == 0, text).otherwise(let(parts(cuts), joined))


def placeholders(spans: Column) -> Column:
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    return cuts_of(spans, lambda s, n, first: F.when(first, F.element_at(names, s["kind"] + 1)).otherwise(F.lit("")))


def masked(text: Column) -> Column:
    """The text with base spans replaced, again while the replacements leave a new match: a run that failed its test for what stood beside it.

    A pass that changes the text takes at least the five code points of a shortest span, so a text needs no more passes
    than a fifth of its length; those after the last change do nothing.
    """
    state = F.struct(text.alias("text"), F.lit(True).alias("open"))

    def once(t: Column) -> Column:
        return let(base_spans(t), lambda s: F.struct(F.when(F.size(s) == 0, t).otherwise(rebuilt(t, placeholders(s))).alias("text"), (F.size(s) > 0).alias("open")))

    return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(text) / 5).cast("int")), state, lambda acc, _: F.when(acc["open"], once(acc["text"])).otherwise(acc), lambda acc: acc["text"])


def sanitise(docs: DataFrame, text: str = "text", disclosed: float = DISCLOSED, removed: float = REMOVED) -> DataFrame:
    """docs with every base span replaced by its kind in brackets and every disclosing term generalised to [TERM] or removed."""
    made = with_spans(docs, text, disclosed, removed)
    terms = F.transform("_terms", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.when(w["removed"], F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    made = made.withColumn("_cuts", F.array_sort(F.concat(placeholders(F.col("_spans")), terms)))
    clean = F.when(F.size("_cuts") > 0, masked(rebuilt(text_of(text), F.col("_cuts")))).otherwise(F.col(text))
    return made.withColumn(text, clean).select(*docs.columns)


def op6_disclosure(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_personal_data(docs).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
