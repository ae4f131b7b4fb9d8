"""PII: information-theoretic sanitisation, in DataFrame functions alone.

Base kinds (email, ip, card, phone) are found by pattern and validated.  Each
found value is a protected entity, and so is the group that it shares with
others: an email's domain, an ip's first three numbers, a card's first six
digits, a phone number without its last seven digits.  So values that occur
once have terms too.  The kind itself is no secret: the mask names it.  A term
is a word in the sentence of an entity.  Over the whole corpus

    P(t)    share of the documents that hold the term t
    P(e)    share of the documents that hold the entity e
    P(e|t)  share of the documents with t that hold t in a sentence with e
    PMI     log2(P(e|t) / P(e))        IC = -log2 P(e)

A term discloses an entity when PMI >= DISCLOSURE * IC and it leaves at most
RESIDUAL bits of the entity unknown (IC - PMI = -log2 P(e|t)), with at least
SUPPORT distinct surroundings (copies of one sentence are one surrounding); for
an entity with fewer, but at least RARE, the term stands in all of them.  With
one bit, who reads the term guesses the entity right at least every second
time.  A word that merely stands in many copies of an entity's sentence, and in
more documents without it, is no term.  Wherever
such a term occurs, in any document, it becomes a span of kind ``term``: it is
generalised to [NUMBER] or [NAME] (digits, capital first letter), else removed
as [TERM].  Base spans are masked by their kind.

Defined results
  null or empty text   no spans; null stays null, empty stays empty
  null doc_id          passed through
  very long text       whole; patterns are possessive, so they are linear
  ties                 spans are ordered by start, then kind (email, ip, card,
                       phone, term), then end
  repeated rows        each row is returned, and counts in P(t), P(e), P(e|t) and
                       the document total; surroundings count distinct ones
  empty table          no rows
  extra columns        passed through; base and found (in any case) are replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flagged, materialise, result_columns, sieve

#: fixed values: the base patterns, written so that they neither backtrack nor recurse
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROBES = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SUPPORT, RARE, DISCLOSURE, RESIDUAL = 4, 2, 0.5, 1.0
#: words: letters and digits with what stands between them
WORD = r"[\p{L}\p{M}\p{N}]++(?:[^\x20\x09-\x0D\p{L}\p{M}\p{N}]++[\p{L}\p{M}\p{N}]++)*+"
#: ends of sentences; none lies inside a base span
BREAK = r"(?<=\n)|(?<=[.!?])(?=[\x20\x09-\x0D]++[^0-9().-])"
#: stands for a base span inside a word
MARK = "0\x010"


def found(text: Column, kind: str) -> Column:
    """array<struct<s, e, v>> of a kind's matches: start, end (code points) and value."""
    hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g))
    both = F.arrays_zip(gaps.alias("g"), hits.alias("h"))
    walked = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<s:int,e:int,v:string>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.coalesce(F.length(x["h"]), F.lit(0))).alias("at"),
            F.when(
                x["h"].isNotNull() & valid(x["h"], kind),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), (acc["at"] + x["g"] + F.length(x["h"])).alias("e"), x["h"].alias("v")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return walked


def valid(v: Column, kind: str) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    digits = F.regexp_replace(v, "[^0-9]", "")
    n = F.length(digits)
    if kind == "phone":
        return n.between(9, 15)
    total = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.least(n, F.lit(19))),
            lambda i: (lambda d: F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))(F.substring(digits, i, F.lit(1)).cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return n.between(12, 19) & (total % 10 == 0)


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, v>> of all base spans by start, then kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        probe = F.contains(text, F.lit(PROBES[kind])) if PROBES[kind] else F.lit(True)
        if kind in ("ip", "card", "phone"):
            probe = probe & F.col("__digits")
        hits = F.transform(found(text, kind), lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
        parts.append(F.when(probe, hits).otherwise(F.expr("cast(array() AS array<struct<s:int,k:int,e:int,v:string>>)")))
    return F.array_sort(F.concat(*parts))


def terms_of(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def entities_of(spans: Column) -> Column:
    """The protected entities of base spans: values and the groups that they share."""

    def pair(x: Column) -> Column:
        digits = F.regexp_replace(x["v"], "[^0-9]", "")
        value = F.when(x["k"] == 0, F.lower(x["v"])).when(x["k"] == 1, x["v"]).otherwise(digits)
        group = F.when(x["k"] == 0, F.substring_index(value, "@", -1)).when(x["k"] == 1, F.substring_index(value, ".", 3))
        group = group.when(x["k"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 7))
        return F.array(F.concat_ws(":", x["k"], value), F.concat_ws(":", x["k"], F.lit("group"), group))

    return F.array_distinct(F.flatten(F.transform(spans, pair)))


def surroundings(hits: DataFrame) -> DataFrame:
    """Sentences with base spans: (id, tk, copies, entities, around, terms), one row for each.

    hits: (id, tk, text, copies) of documents with base spans and the rows that hold them.
    """
    lines = hits.select("id", "tk", "copies", F.explode(F.split("text", BREAK)).alias("text"))
    lines = lines.withColumn("__digits", F.col("text").rlike("[0-9]"))
    lines = lines.where(F.col("__digits") | F.contains("text", F.lit("@"))).withColumn("x", base_spans(F.col("text"))).where(F.size("x") > 0)
    # a word that touches a span is no term
    words = F.filter(terms_of(masked(F.col("text"), F.col("x"), F.lit(MARK))), lambda w: ~F.contains(w, F.lit("\x01")))
    return lines.select("id", "tk", "copies", entities_of(F.col("x")).alias("entities"), F.xxhash64(F.trim("text", F.lit(" \t\n\x0b\f\r"))).alias("around"), words.alias("terms"))


def disclosing(docs: DataFrame, near: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, residual: float = RESIDUAL) -> DataFrame:
    """(entity, term) of the terms that disclose an entity, over all documents."""
    held = near.select("id", "tk", "copies", "around", "terms", F.explode("entities").alias("entity"))
    rows = lambda df, *key: df.select(*key, "id", "tk", "copies").distinct().groupBy(*key)
    places = held.groupBy("entity").agg(F.countDistinct("around").alias("all_places")).where(F.col("all_places") >= min(RARE, support))
    entities = materialise(places.join(rows(held, "entity").agg(F.sum("copies").alias("with_entity")), "entity"))
    each = held.join(entities.select("entity"), "entity").select("id", "tk", "copies", "around", "entity", F.explode("terms").alias("term"))
    places = each.groupBy("entity", "term").agg(F.countDistinct("around").alias("places")).join(entities, "entity").where(F.col("places") >= F.least(F.lit(support), F.col("all_places")))
    pairs = materialise(places.join(rows(each, "entity", "term").agg(F.sum("copies").alias("both")), ["entity", "term"]))
    total = docs.count()
    if not total or pairs.isEmpty():
        return pairs.select("entity", "term").limit(0)
    # few words pass the sieve, and their counts are summed before the exact join
    words = sieve(docs.select(F.explode(terms_of(F.col("text"))).alias("term")), pairs, "term").groupBy("term").agg(F.count("*").alias("with_term"))
    n = F.lit(float(total))
    told = F.col("both") / F.col("with_term")
    pmi = F.log2(told / (F.col("with_entity") / n))
    ic = F.log2(n / F.col("with_entity"))
    return pairs.join(words, "term").where((pmi >= F.lit(disclosure) * ic) & (told >= F.lit(2.0**-residual))).select("entity", "term")


def placed(text: Column, terms: Column) -> Column:
    """array<struct<s, k, e>> of a text's words that are among terms."""
    gaps = F.transform(F.split(text, WORD, -1), lambda g: F.length(g))
    at = F.aggregate(
        F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() AS array<struct<s:int,k:int,e:int>>)").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["g"] + F.coalesce(F.length(x["w"]), F.lit(0))).alias("at"),
            F.when(
                x["w"].isNotNull() & F.array_contains(terms, F.lower(x["w"])),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["g"]).alias("s"), F.lit(len(KINDS)).alias("k"), (acc["at"] + x["g"] + F.length(x["w"])).alias("e")))),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(terms.isNotNull(), at)


def with_base(df: DataFrame) -> DataFrame:
    """``df`` plus base, the base spans of its text."""
    none = F.expr("cast(array() AS array<struct<s:int,k:int,e:int,v:string>>)")
    probed = df.withColumn("__digits", F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)))
    return probed.withColumn("base", F.when(F.col("text").isNotNull() & (F.col("__digits") | F.contains("text", F.lit("@"))), base_spans(F.col("text"))).otherwise(none))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base and term spans masked in text.

    Adds found (array<struct<s, k, e>>, all spans) and base (those of the base
    kinds).  Only documents that may hold a disclosed term are shuffled for it.
    """
    extra = result_columns(docs, ["base", "found"])
    plain = docs.select(F.struct(*[c for c in extra if c != "text"]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tk"), "text")
    hits = with_base(plain).where(F.size("base") > 0).groupBy("id", "tk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    near = materialise(surroundings(hits))
    told = materialise(disclosing(docs, near).select("term").distinct())
    if told.isEmpty():
        terms = told.select("term").limit(0)
    else:
        words = sieve(plain.select("id", "tk", F.explode(terms_of(F.col("text"))).alias("term")), told, "term").join(told, "term", "left_semi")
        terms = materialise(words.groupBy(F.col("id").alias("t_id"), F.col("tk").alias("t_tk")).agg(F.collect_set("term").alias("terms")))
    none = F.lit(None).cast("array<string>")
    if terms.isEmpty():
        joined = with_base(plain.withColumn("terms", none))
    else:
        # texts without a term are not shuffled
        maybe = flagged(plain, terms, ["id", "tk"], "maybe")
        told = maybe.where("maybe").join(terms, F.col("id").eqNullSafe(F.col("t_id")) & F.col("tk").eqNullSafe(F.col("t_tk")), "left").select(*plain.columns, "terms")
        joined = with_base(told).unionByName(with_base(maybe.where(~F.col("maybe")).select(*plain.columns).withColumn("terms", none)))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    # a term inside a base span is covered already
    free = F.filter(F.coalesce(placed(F.col("text"), F.col("terms")), F.expr("cast(array() AS array<struct<s:int,k:int,e:int>>)")), lambda t: ~F.exists("base", lambda b: (t["s"] < b["e"]) & (b["s"] < t["e"])))
    spans = joined.select("row", "text", base.alias("base"), F.array_sort(F.concat(base, free)).alias("found"))
    return spans.select(*[F.col(f"row.{c}").alias(c) if c != "text" else masked(F.col("text"), F.col("found")).alias("text") for c in extra], "base", "found")


def masked(text: Column, spans: Column, same: Column | None = None) -> Column:
    """The text with each span replaced by its mask (or by ``same``); overlapping spans share one."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    word = F.lit("")

    def step(acc: Column, x: Column) -> Column:
        piece = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        term = F.when(piece.rlike("[0-9]"), "[NUMBER]").when(piece.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        mask = same if same is not None else F.when(x["k"] < len(KINDS), F.get(names, x["k"])).otherwise(term)
        skip = x["s"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), mask)).alias("out"),
        )

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), word.alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")
