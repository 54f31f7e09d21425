"""Secret scans with corpus-wide ownership frequency.

Base rules find assignments, access keys and long hexadecimal runs. The method adds further candidates (provider key
shapes, private key blocks, web tokens, mixed strings of high diversity), hashes the values of all candidates, base ones
too, and counts, over all documents, the distinct repositories and owners that hold each. A value in many repositories
or with many owners is a widely copied example; one of few owners looks like a live credential. Added spans stay only
where they look live; base spans always stay, and are told apart by the counts of live and copied candidates.

The repository is a document's source. Its owner, where no column names one, is its text: whoever wrote a different text
around a value is another owner, and copies of one text, however many, are one.

Only documents in which a pattern occurs take part in anything but the scan. Verdicts are made once per different text,
so that copies neither count again nor gather under one value.

Defined results: a null text is empty and has no spans; a repeated row has the spans of its text each time; a null
repository or owner is one of its own; offsets count code points; an empty table gives no row; a very long text of very
many matches is taken in parts of root length. Only doc_id, text and the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, packed, running, small, unpacked

#: Base rules: fixed values of the contract (pattern, group whose length counts, least length).
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Added candidates: published key shapes and long mixed strings; group 0 is the candidate.
ADDED = {
    "provider": r"(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{18,}|ASIA[A-Z0-9]{16,})",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----",
    "mixed": r"[A-Za-z0-9+/_-]{24,}={0,2}",
}
ORDER = [*BASE, *ADDED]
#: A value in more repositories or with more owners than this is a copied example.
MAX_REPOSITORIES = 2
MAX_OWNERS = 3
#: Distinct characters that a mixed string needs.
MIN_DISTINCT = 12
_SPANS = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches: the pieces between matches give each match its code point offset."""

    def placed(found: Column) -> Column:
        groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g: F.char_length(g).cast("long"))
        lengths = F.transform(found, lambda m: F.char_length(m).cast("long"))
        steps = F.zip_with(gaps, lengths, lambda g, m: F.struct(g.alias("gap"), m.alias("len")))

        def spans(s: Column) -> Column:
            before = running(F.transform(s, lambda x: x["gap"] + x["len"]))
            at = F.zip_with(before, s, lambda b, x: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["len"]).alias("end")))
            made = F.zip_with(at, groups, lambda x, g: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), g.alias("value")))
            return F.filter(made, lambda x: F.char_length(x["value"]) >= least).cast(_SPANS)

        return let(steps, spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _none() -> Column:
    return F.array().cast(_SPANS)


def scan(docs: DataFrame, repository: str = "source", owner: str | None = None) -> DataFrame:
    """doc_id, repository, owner, base and added candidate spans of every document; one narrow pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.col(owner).cast("string") if owner else F.md5(text)
    t = docs.select("doc_id", F.col(repository).alias("repository"), named.alias("owner"), text.alias("t"))
    t = t.withColumn("text_key", F.xxhash64("t"))
    # hexadecimal runs are maximal, so asking for 24 characters at once finds the same runs as a later length test
    at_once = {"assign": BASE["assign"], "access": BASE["access"], "hex": (r"[0-9a-f]{24,}", 0, 24)}
    base = [F.when(F.col("t").rlike(p), _spans(F.col("t"), p, ORDER.index(k), g, n)).otherwise(_none()) for k, (p, g, n) in at_once.items()]
    added = [F.when(F.col("t").rlike(p), _spans(F.col("t"), p, ORDER.index(k), 0, 1)).otherwise(_none()) for k, p in ADDED.items()]

    def diverse(s: Column) -> Column:
        """Long runs that may be keys: digits and both cases, and many different characters."""
        v = s["value"]
        return (s["kind"] != ORDER.index("mixed")) | (v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT))

    t = t.select("doc_id", "text_key", "repository", "owner", "t", F.concat(*base).alias("base"), F.filter(F.concat(*added), diverse).alias("added"))
    # the digest that verdicts are joined by, of the few texts with candidates
    return t.withColumn("text_md5", F.when(F.size("base") + F.size("added") > 0, F.md5("t"))).drop("t")


def _named(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def ownership(found: DataFrame, max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(value_hash, n_repositories, n_owners, live) of every candidate value, over all documents."""
    every = found.where(F.col("text_md5").isNotNull()).select(_named("repository").alias("repository"), _named("owner").alias("owner"), F.concat("base", "added").alias("c"))
    c = every.select("repository", "owner", F.explode(F.array_distinct(F.transform("c", lambda s: F.sha2(s["value"], 256)))).alias("value_hash"))
    per = c.groupBy("value_hash", "repository", "owner").agg(F.lit(1).alias("_one"))
    counts = per.groupBy("value_hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    return counts.withColumn("live", (F.col("n_repositories") <= max_repositories) & (F.col("n_owners") <= max_owners))


def find_secrets(docs: DataFrame, repository: str = "source", owner: str | None = None, max_repositories: int = MAX_REPOSITORIES, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per document: doc_id, base spans and all spans, each by start, then kind in the order of ORDER, and how many
    of its candidates look live and how many are copied."""
    found = materialize(scan(docs, repository, owner), "secret-spans")
    live = ownership(found, max_repositories, max_owners).where("live").select("value_hash")
    texts = found.where(F.col("text_md5").isNotNull()).dropDuplicates(["text_md5"])
    sites = texts.select("text_md5", F.explode(F.concat(F.transform("base", lambda s: F.struct(s.alias("s"), F.lit(False).alias("extra"))), F.transform("added", lambda s: F.struct(s.alias("s"), F.lit(True).alias("extra"))))).alias("x"))
    sites = sites.select("text_md5", "x.s", "x.extra", F.sha2("x.s.value", 256).alias("value_hash")).join(live, "value_hash", "left_semi")
    kept = sites.groupBy("text_md5").agg(F.count(F.lit(1)).alias("_live"), F.collect_list(F.when(F.col("extra"), F.col("s"))).alias("_more"))
    kept = small(materialize(kept, "secret-live"), 100_000)
    out = found.join(kept, "text_md5", "left")
    every = F.array_sort(F.concat("base", F.coalesce("_more", _none())))
    n_live = F.coalesce("_live", F.lit(0)).cast("long")
    n_copied = (F.size("base") + F.size("added")).cast("long") - n_live
    return out.select("doc_id", "text_key", F.array_sort("base").alias("base"), every.alias("spans"), n_live.alias("n_live"), n_copied.alias("n_copied"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == ORDER.index(kind))).cast("long")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """documents with every found span replaced by a mark; documents without spans are unchanged.

    Spans go back to their rows by doc_id and text hash, so rows that repeat a doc_id with other texts keep apart. Spans
    may overlap (an assignment holds a hexadecimal run): one that starts inside the last only extends it.
    """
    found = find_secrets(docs, **options).where(F.size("spans") > 0)
    found = found.groupBy("doc_id", "text_key").agg(F.first(F.transform("spans", lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))).alias("_spans"))
    found = small(materialize(found, "secret-redactions"), 20_000)
    keyed = packed(docs, "doc_id", "text").withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["_text_key"] == found["text_key"]), "left").select(keyed["text"], "_row", "_spans")
    # where all spans before a span end; text from there to its start stays, and nothing where it starts inside them
    ends = running(F.transform("_spans", lambda s: s["end"].cast("long")), F.greatest)

    def replaced(ended: Column) -> Column:
        pieces = F.zip_with(ended, "_spans", lambda e, s: F.when(s["start"] >= e, F.concat(F.substring(F.col("text"), e.cast("int") + 1, s["start"] - e.cast("int")), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform("_spans", lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), last + 1, F.char_length("text")))

    done = let(ends, replaced)
    out = joined.withColumn("_new", F.when(F.col("_spans").isNotNull(), done))
    return unpacked(out, docs.columns, F.col("_new"), F.col("_new").isNotNull())
