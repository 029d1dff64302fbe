"""Operator 11: secrets by patterns and by corpus-wide ownership, with DataFrame functions only.

Patterns find assigned values, access keys and long hexadecimal runs. Wider candidates are runs of 20 or more
characters of base64 and its like with a letter and a digit. Every candidate value is hashed where it is found; only
hashes are written and shuffled. The corpus then tells whose a value is: its hash is counted by distinct owners and
distinct repositories of an owner, and is

    example   with ``example_owners`` owners or more, or with two or more owners and ``example_repositories``
              repositories or more: widely copied, as keys in documentation are
    live      with fewer, when it looks live: ``min_entropy`` bits a character or more by its own characters, at
              least ``min_chars`` of them, and no word like "example" or "changeme"
    weak      otherwise

Base findings stay whatever their verdict; a wider candidate becomes a span (kind "token") when it is live and shares
no character with a base finding. ``owner`` names the column of the owner, ``repository`` those that together name a
repository; nulls are one owner or repository.

Cases: null text counts as empty; texts of any length are searched whole, as positions are sums over the pieces of a
text rather than one growing list; a repeated row counts as one repository and gets equal spans; an empty table gives
an empty result; other columns are ignored, whatever their names. A value that a third of all texts hold is counted by
partial sums, and its verdict is broadcast (fewer than a thousand values are that frequent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from waylake.llm.common import join_uneven, materialise

_ASSIGN = r"(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key)[\"']?+\x20*+[:=]\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
#: Patterns by kind, in the order of ties. They find the matches of the plain forms in the comments, but never scan a
#: run of characters twice: a match that is too short at the start of a run is too short inside it.
PATTERNS = {
    # (password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+), group of 6 or more
    "assign": _ASSIGN,
    # AKIA[A-Z0-9]+ of 20 or more
    "access": r"AKIA[A-Z0-9]{16,}+",
    # [0-9a-f]+ of 24 or more
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
    "token": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
BASE = ["assign", "access", "hex"]
#: Words of values that nobody uses.
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your_|xxxx"
HIT = "array<struct<kind:string,gap:int,length:int,ok:boolean,h:string,live:boolean>>"


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters of a string, in bits a character."""
    n = F.length(value)
    kinds = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")

    def add(total: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.aggregate(kinds, F.lit(0.0), add)


def looks_live(value: Column, min_entropy: float, min_chars: int) -> Column:
    return (F.length(value) >= min_chars) & ~value.rlike(PLACEHOLDER) & (entropy(value) >= min_entropy - 1e-9)


def _hits(text: Column, kind: str, min_entropy: float, min_chars: int) -> Column:
    """Matches of a kind in order, each with the length of the text before it, then the rest of the text."""
    pattern = PATTERNS[kind]
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def hit(x: Column) -> Column:
        value = F.regexp_extract(x["hit"], _ASSIGN, 1) if kind == "assign" else x["hit"]
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") if kind == "token" else F.length(value) >= 6
        return F.struct(
            F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("length"), mixed.alias("ok"),
            F.sha2(value, 256).alias("h"), (mixed & looks_live(value, min_entropy, min_chars)).alias("live"),
        )

    found = F.transform(F.filter(pieces, lambda x: x["hit"].isNotNull()), hit)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(HIT))


def scanned(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), min_entropy: float = 3.0, min_chars: int = 16) -> DataFrame:
    """(rid, doc_id, owner, repo, hits) for every row, written once; rid numbers the rows."""
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    slim = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), named(owner).alias("owner"),
        F.to_json(F.array(*[named(c) for c in repository])).alias("repo"),
    )
    hits = F.concat(*[_hits(F.col("text"), k, min_entropy, min_chars) for k in PATTERNS])
    return materialise(slim.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", hits.alias("hits")), "secrets")


def occurrences(scan: DataFrame) -> DataFrame:
    """(rid, owner, repo, kind, place, start, end, h, live): base findings, and wider candidates apart from them."""
    rows = scan.where(F.size("hits") > 0).select("rid", "owner", "repo", F.posexplode("hits").alias("pos", "s")).repartition("rid")
    along = W.partitionBy("rid", "s.kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("s.gap") + F.col("s.length")).over(along)).where("s.ok")
    place = F.array_position(F.array(*[F.lit(k) for k in PATTERNS]), F.col("s.kind")) - 1
    rows = rows.select("rid", "owner", "repo", "s.kind", place.alias("place"), (F.col("end") - F.col("s.length")).alias("start"), "end", "s.h", "s.live")
    base = F.col("kind") != "token"
    ordered = W.partitionBy("rid").orderBy("start", "place")
    before = F.max(F.when(base, F.col("end"))).over(ordered.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(W.partitionBy("rid").orderBy(F.desc("start"), F.desc("place")).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", before).withColumn("after", after)
    apart = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return materialise(rows.where(base | apart).drop("before", "after"), "secrets-found")


def ownership(found: DataFrame, example_owners: int = 3, example_repositories: int = 8) -> DataFrame:
    """(h, n, owners, repositories, verdict) for every candidate value."""
    per_repo = found.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    per_owner = per_repo.groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repositories"), F.max("live").alias("live"))
    each = per_owner.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("live").alias("live"))
    wide = (F.col("owners") >= example_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= example_repositories))
    return each.select("h", "n", "owners", "repositories", F.when(wide, "example").when(F.col("live"), "live").otherwise("weak").alias("verdict"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), min_entropy: float = 3.0, min_chars: int = 16, **thresholds) -> DataFrame:
    """(doc_id, counts by kind, base_sha256, spans, counts by verdict) for every row of ``docs``."""
    scan = scanned(docs, owner, repository, min_entropy, min_chars)
    found = occurrences(scan)
    verdicts = materialise(ownership(found, **thresholds).select("h", "n", "verdict"), "secrets-owned")
    judged = join_uneven(found.select("rid", "kind", "place", "start", "end", "h"), verdicts, "h", "n")
    judged = judged.where((F.col("kind") != "token") | (F.col("verdict") == "live"))
    spans = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", "kind", "verdict"))).alias("s"))
    rows = scan.select("rid", "doc_id").join(spans, "rid", "left")
    every = F.coalesce(F.col("s"), F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,kind:string,verdict:string>>"))
    rows = rows.select("doc_id", every.alias("s"))
    n = lambda field, x: F.size(F.filter("s", lambda s: s[field] == x)).cast("long")
    return rows.select(
        "doc_id", *[n("kind", k).alias(f"n_{k}") for k in BASE], F.sha2(_listed(F.filter("s", lambda s: s["kind"] != "token")), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"), *[n("verdict", v).alias(f"n_{v}") for v in ("live", "example", "weak")],
    )


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
