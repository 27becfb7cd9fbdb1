"""Secret scans that link the parts of multipart credentials.

Base secrets are found in every text by three patterns (leftmost, not
overlapping, per kind; a match that is too short is dropped, and the search goes
on behind it). Positions are code points, ends exclusive.

Weak candidates are parts that alone say little: identifiers (upper-case
identifiers of 16 to 24 characters, or values of id-like names), secrets (long
strings of mixed base64 letters, or hex of 16 to 31 digits) and endpoints (the
scheme and host of an URL). A part's scope reaches `reach` characters to both
sides. An interval join meets parts of one text whose distance is within the
scope: a weak identifier counts only with a secret in reach, a weak secret only
with an identifier, an endpoint only with both; base matches serve as partners.
Weak candidates that overlap a base match are not reported again.

The join is an equi-join on (text's digest, cell of `reach` characters) with the
distance as a condition: a part enters its own cells, its partner those within
reach, so a row meets only parts of a few hundred characters. Only parts are
shuffled, and texts that are alike send theirs once.

DataFrame functions only; no Python runs on the executors. A text's matches are
placed by sums over blocks, so work grows with their number.

Defined results: a null text is empty; ids may be null or repeated; every row
gets its own result; an empty table gives an empty result; other columns are not
used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._store import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: Kinds in the order in which they are listed: base kinds, then weak ones.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 200

WEAK_ID = r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[0-9])(?=[A-Z0-9]*[A-Z])[A-Z0-9]{16,24}(?![A-Za-z0-9])"
NAMED_ID = r"""(?i:access_?key_?id|account_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])[A-Za-z0-9+/]{24,}={0,2}"
SHORT_HEX = r"(?<![A-Za-z0-9])(?=[0-9a-f]*[0-9])[0-9a-f]{16,31}(?![A-Za-z0-9])"
ENDPOINT = r"""(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#"'<>]+"""


BLOCK = 256


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once: what a lambda takes from outside is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda acc, x: acc + x)


def _before(numbers: Column) -> Column:
    """For each number the sum of those before it: by sums of blocks, and sums within a block."""

    def by_block(n: Column, sums: Column, block: Column) -> Column:
        low = block * BLOCK
        base, own = _sum(F.slice(sums, F.lit(1), block)), F.slice(n, low + 1, F.lit(BLOCK))
        return _let(base, lambda b: _let(own, lambda o: F.transform(o, lambda _, i: b + _sum(F.slice(o, F.lit(1), i)))))

    def of(n: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(n) / BLOCK) - 1, F.lit(0)).cast("int"))
        sums = F.transform(blocks, lambda k: _sum(F.slice(n, k * BLOCK + 1, F.lit(BLOCK))))
        return _let(sums, lambda s: F.flatten(F.transform(blocks, lambda k: by_block(n, s, k))))

    return _let(numbers, of)


def _spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All matches as array<struct<start, kind, end>>; `keep` is a condition on the matched string.

    The lengths of the pieces between the matches give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")

    def placed(matches: Column, gaps: Column) -> Column:
        steps = F.zip_with(gaps, matches, lambda gap, m: gap + F.char_length(m))
        spans = F.zip_with(F.zip_with(gaps, _before(steps), lambda gap, at: gap + at), matches, lambda at, m: F.struct(at.alias("start"), m.alias("found")))
        if keep is not None:
            spans = F.filter(spans, lambda s: keep(s["found"]))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s["start"] + F.char_length(s["found"])).alias("end")))

    def cut(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda x: F.char_length(x).cast("long"))
        return _let(gaps, lambda g: placed(matches, g))

    return F.when(text.rlike(pattern), _let(found, cut)).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    """The three kinds of base matches; cheap searches for fixed strings come first."""
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    lower = F.lower(text)
    named = F.contains(lower, F.lit("passw")) | F.contains(lower, F.lit("secret")) | F.contains(lower, F.lit("token")) | F.contains(lower, F.lit("api"))
    # characters that only full Unicode case folding would bring to ASCII letters do not matter: the pattern folds ASCII alone
    return {
        "assign": F.when(named, _spans(text, ASSIGN, "assign", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 8)).otherwise(none),
        "access": F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, "access", lambda m: F.char_length(m) >= 16)).otherwise(none),
        "hex": _spans(text, HEX, "hex"),
    }


def weak_spans(text: Column) -> Column:
    return F.concat(_spans(text, WEAK_ID, "identifier"), _spans(text, NAMED_ID, "identifier"), _spans(text, WEAK_SECRET, "secret"), _spans(text, SHORT_HEX, "secret"), _spans(text, ENDPOINT, "endpoint"))


def _within(parts: DataFrame, partners: DataFrame, reach: int) -> DataFrame:
    """The parts that have a partner within reach: an interval semi-join by cells."""
    cell = lambda x: F.floor(x / reach).cast("long")
    left = parts.withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    right = partners.select("digest", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("end") - 1 + reach))).alias("cell"))
    met = left.join(right, (left["digest"] == right["digest"]) & (left["cell"] == right["cell"]) & (F.col("s") - F.col("end") <= reach) & (F.col("start") - F.col("e") <= reach), "left_semi")
    return met.select("digest", "start", "kind", "end").distinct()


def linked_parts(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(digest, start, kind, end): the weak candidates with their complements in reach."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A link needs an identifier and a secret; most texts show at once that they lack one.
    could = (text.rlike(WEAK_ID) | text.rlike(NAMED_ID) | F.contains(text, F.lit("AKIA"))) & (text.rlike(WEAK_SECRET) | text.rlike(r"[0-9a-f]{16}") | text.rlike(ASSIGN))
    source = docs.select(text.alias("text")).where(could)
    base = F.concat(*base_spans(F.col("text")).values())
    spans = source.select(F.sha2("text", 256).alias("digest"), base.alias("base"), weak_spans(F.col("text")).alias("weak"))
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"])))
    parts = written(spans.select("digest", F.explode(F.concat("base", free)).alias("p")).select("digest", "p.*").distinct(), "parts")
    kind = {k: i for i, k in enumerate(KINDS)}
    ids = parts.where(F.col("kind").isin(kind["access"], kind["identifier"]))
    secrets = parts.where(F.col("kind").isin(kind["assign"], kind["hex"], kind["secret"]))
    weak = {k: parts.where(F.col("kind") == kind[k]) for k in KINDS[3:]}
    found = _within(weak["identifier"], secrets, reach).unionAll(_within(weak["secret"], ids, reach))
    return written(found.unionAll(_within(_within(weak["endpoint"], ids, reach), secrets, reach)), "links")


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per text: id, base (spans per kind) and linked (weak candidates with complements)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    links = linked_parts(docs, text_col, reach)
    per_text = written(links.groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked")), "links")
    base = base_spans(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.sha2("text", 256).alias("digest"), *[c.alias(k) for k, c in base.items()])
    joined = rows.join(per_text.withColumnRenamed("digest", "__digest"), F.col("digest") == F.col("__digest"), "left")
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return joined.select(F.col("id").alias(id_col), *base, F.coalesce("linked", none).alias("linked"))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    base = F.concat(*KINDS[:3])
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.concat(base, "linked")).alias("spans"))
