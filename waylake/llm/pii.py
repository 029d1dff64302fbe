"""Operator 7: personal data by patterns and by information-theoretic disclosure, with DataFrame functions only.

Patterns find e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers. Then the corpus
tells which terms give a found value away. A protected entity e is a value, and also its class (the domain of an
address, the network of an IP address, the issuer of a card, the area of a phone number), as most values are rare. For
an entity e and a term t within ``context`` code points of it (or, with ``context=None``, anywhere in a text that holds it),

    disclosure(t, e) = PMI(t; e) / IC(e) = ln(n(t,e) N / (n(t) n(e))) / ln(N / n(e))

with counts of distinct texts. It is 1 when t occurs only with e. Terms (runs of at least ``min_chars`` letters and
digits) seen with e in at least ``support`` independent contexts, and in mostly independent ones, are removed from texts
with e when their disclosure reaches ``remove_at``, and generalised when it reaches ``generalise_at``: of a number the
first digit stays and zeros take the place of the others, a name becomes the mark of its class (CODE with a digit, NAME
with a capital, else TERM). Contexts with the same two min-hashes, as near copies have, are one.

Positions come from cutting a text at the matches: the pieces between and the matches alternate, so
sums of their lengths are code point offsets.

The patterns below find the same matches as the plain forms in their comments, but never scan a run
of characters twice: a match that fails at the start of a run fails inside it too.

Cases: null text counts as empty; texts of any length are searched whole; exact copies count once in
the statistics, and contexts that are equal count once; repeated rows get equal spans; an empty table
gives an empty result; other columns are carried along where texts are rewritten, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waylake.llm.common import materialise, packed

#: Patterns by kind, in the order of the output.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([ -]?[0-9])+ with 16 to 19 digits: a match is always a maximal run
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without such a character has no match.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
MOST_BROADCAST = 100_000


def _positions(text: Column, pattern: str, kind: str) -> Column:
    """All matches as (kind, start, end, value), in code points, end exclusive."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PASSES = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(_positions(text, PATTERNS[kind], kind), lambda s: PASSES[kind](s["value"]))
    possible = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else text.rlike("[0-9]")
    return F.when(possible & text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_pii``, the base spans by kind and start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("_pii", F.concat(*[base_spans(text, k) for k in PATTERNS]))


def text_key(text: str = "text") -> Column:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(t, F.length(t))


def _terms(part: Column, min_chars: int) -> Column:
    """Distinct terms of a text: lower-case runs of so many letters and digits or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(part), F.lit(TERM), F.lit(0)), lambda w: F.length(w) >= min_chars))


def _entities(kind: Column, value: Column) -> Column:
    """A value in the form that makes equal ones equal, and its class."""
    digits = _digits(value)
    own = F.when(kind.isin("card", "phone"), digits).otherwise(F.lower(value))
    wide = (
        F.when(kind == "email", F.regexp_extract(F.lower(value), "@.*", 0))
        .when(kind == "ip", F.regexp_extract(value, r"^[0-9]+\.[0-9]+", 0))
        .when(kind == "card", F.substring(digits, 1, 6))
        .otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat(kind, F.lit(":"), own), F.concat(kind, F.lit(" of "), wide))


def scanned(docs: DataFrame, context: int | None = 120, min_chars: int = 2) -> DataFrame:
    """(doc_id, th, spans) for every row, each span with the text around it; written once. Without a ``context`` the whole
    text but for what the patterns match is around each of its values: its terms come once, as ``near``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), text_key().alias("th"))

    def around(s: Column) -> Column:
        first = F.greatest(s["start"] - context, F.lit(0))
        before = F.substring(F.col("text"), first + 1, s["start"] - first)
        after = F.substring(F.col("text"), s["end"] + 1, F.lit(context))
        # terms cut off at the far ends go
        before = F.when(first > 0, F.regexp_replace(before, rf"^{TERM}", "")).otherwise(before)
        after = F.when(F.length(after) == context, F.regexp_replace(after, rf"{TERM}$", "")).otherwise(after)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.concat(before, F.lit("\n"), after).alias("context"))

    found = with_base(slim)
    if context is not None:
        return materialise(found.select("doc_id", "th", F.transform("_pii", around).alias("spans")), "pii")
    bare = F.col("text")
    for pattern in PATTERNS.values():
        bare = F.regexp_replace(bare, pattern, "\n")
    near = F.when(F.size("_pii") > 0, _terms(bare, min_chars)).otherwise(F.array().cast("array<string>"))
    return materialise(found.select("doc_id", "th", F.col("_pii").alias("spans"), near.alias("near")), "pii")


def disclosing_terms(docs: DataFrame, spans: DataFrame, support: int = 3, generalise_at: float = 0.75, remove_at: float = 0.9, min_chars: int = 2) -> DataFrame:
    """(entity, term, action): terms that give a protected value away, 'remove' or 'generalise'."""
    whole = "near" in spans.columns
    mentions = spans.where(F.size("spans") > 0).select("th", F.explode("spans").alias("s"), *(["near"] if whole else []))
    around = F.col("near") if whole else _terms(F.col("s.context"), min_chars)
    mentions = mentions.select("th", F.explode(_entities(F.col("s.kind"), F.col("s.value"))).alias("entity"), around.alias("terms"))
    per_entity = mentions.groupBy("entity").agg(F.count_distinct("th").alias("n_e"))
    # contexts of near copies have equal smallest hashes of their terms and count as one
    least = lambda seed: F.array_min(F.transform("terms", lambda w: F.xxhash64(w, F.lit(seed))))
    contexts = (mentions.dropDuplicates(["th", "entity"]) if whole else mentions).withColumn("c", F.xxhash64(least(1), least(2)))
    near = contexts.select("th", "entity", "c", F.explode("terms").alias("term"))
    near = materialise(near, "pii-near")
    together = near.groupBy("entity", "term").agg(F.count_distinct("c").alias("n_c"), F.count_distinct("th").alias("n_te"))
    n = materialise(docs.select(text_key().alias("th")).distinct().agg(F.count("*").alias("n")), "pii-n")
    supported = together.where((F.col("n_c") >= support) & (2 * F.col("n_c") >= F.col("n_te")))
    # a term occurs in the corpus at least as often as near any value: that bounds its score from above, so
    # common words go before their occurrences are counted
    anywhere = near.groupBy("term").agg(F.count_distinct("th").alias("m_t"))
    most = F.col("n_te") * F.pow(F.col("n") / F.col("n_e"), F.lit(1 - generalise_at))
    bounded = supported.join(per_entity, "entity").join(anywhere, "term").crossJoin(F.broadcast(n))  # n is one row
    candidates = materialise(bounded.where(F.col("m_t") <= most + 1e-6).drop("m_t"), "pii-candidates")
    empty = docs.sparkSession.createDataFrame([], "entity string, term string, action string")
    if candidates.isEmpty():
        return empty
    terms = candidates.select("term").distinct()
    small = terms.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    everywhere = docs.select(text_key().alias("th"), F.explode(_terms(F.coalesce(F.col("text").cast("string"), F.lit("")), min_chars)).alias("term"))
    held = everywhere.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    n_t = held.groupBy("term").agg(F.count_distinct("th").alias("n_t"))
    scored = candidates.join(n_t, "term")
    pmi = F.log(F.col("n_te") * F.col("n") / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.col("n") / F.col("n_e"))
    ratio = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))  # a value in every text gives nothing away
    action = F.when(ratio >= remove_at - 1e-9, "remove").when(ratio >= generalise_at - 1e-9, "generalise")
    return materialise(scored.select("entity", "term", action.alias("action")).where("action is not null"), "pii-terms")


def term_spans(docs: DataFrame, spans: DataFrame, terms: DataFrame) -> DataFrame:
    """(th, term_spans) for every text that holds both a protected value and a term that gives it away."""
    held = spans.where(F.size("spans") > 0).select("th", F.explode("spans").alias("s"))
    held = held.select("th", F.explode(_entities(F.col("s.kind"), F.col("s.value"))).alias("entity")).distinct()
    # a term may give several values away; removal is the stronger action
    strongest = held.join(terms, "entity").groupBy("th", "term").agg(F.max("action").alias("action"))
    wanted = strongest.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("acts"))
    wanted = materialise(wanted, "pii-wanted")
    small = wanted.limit(MOST_BROADCAST // 10 + 1).count() <= MOST_BROADCAST // 10
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key().alias("th"))
    texts = texts.join(F.broadcast(wanted) if small else wanted, "th").dropDuplicates(["th"])
    pieces = F.arrays_zip(F.split("text", TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
        act = F.col("acts")[F.lower(x["hit"])]
        span = F.struct(F.lit("term").alias("kind"), begin.alias("start"), end.alias("end"), act.alias("value"))
        return F.struct(end.alias("at"), F.when(act.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    return materialise(texts.select("th", F.aggregate(pieces, start, step, lambda a: a["out"]).alias("term_spans")), "pii-term-spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _n(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame, context: int | None = 120, **thresholds) -> DataFrame:
    """(doc_id, counts by kind, base_sha256, spans) for every row of ``docs``."""
    spans = scanned(docs, context)
    terms = disclosing_terms(docs, spans, **thresholds)
    if terms.isEmpty():
        rows = spans.withColumn("term_spans", F.array().cast(SPAN))
    else:
        rows = spans.join(term_spans(docs, spans, terms), "th", "left")
    base, extra = _listed(F.col("spans")), _listed(F.coalesce(F.col("term_spans"), F.array().cast(SPAN)))
    both = F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(extra, F.lit("")))
    return rows.select("doc_id", *[_n(k) for k in PATTERNS], F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))


def _rewritten(text: Column, spans: Column) -> Column:
    """The text with a mark instead of every span; overlapping spans share the first one's mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        own = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        wider = F.when(own.rlike("^[0-9]+$"), F.rpad(F.substring(own, 1, 1), F.length(own), F.lit("0")))
        wider = wider.when(own.rlike(r"\p{N}"), "[CODE]").when(own.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        term = F.when(s["value"] == "remove", F.lit("")).otherwise(wider)
        mark = F.when(s["kind"] == "term", term).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, context: int | None = 120, **thresholds) -> DataFrame:
    """``docs`` with marks like [EMAIL] for personal data, wider forms of generalised terms, and removed terms gone."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spans = scanned(slim, context)
    terms = disclosing_terms(slim, spans, **thresholds)
    rows = packed(docs).select("row", F.col("row.text").cast("string").alias("text"))
    rows = with_base(rows).withColumn("key", text_key())
    if terms.isEmpty():
        rows = rows.withColumn("terms", F.array().cast(SPAN))
    else:
        found = term_spans(slim, spans, terms).select(F.col("th").alias("key"), F.col("term_spans").alias("terms"))
        rows = rows.join(found, "key", "left").withColumn("terms", F.coalesce("terms", F.array().cast(SPAN)))
    every = F.concat("_pii", "terms")
    text = F.when(F.size(every) > 0, _rewritten(F.col("text"), every)).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
