"""Quality rules whose cutoffs are controlled for risk on labelled holdouts.

Each rule rejects a text if a measure is above a cutoff. The rules' cutoffs form
one ladder, fixed beforehand: rule after rule, each from lenient to strict. At a
step of the ladder all cutoffs so far are in force, so a step rejects whatever the
one before does, and a text's place on the ladder is the first step that rejects
it. As nothing of the ladder is chosen by the labels, every labelled text is
holdout.

For a stratum let k of n good holdout texts be rejected at a step. The step is
certified if P(Binomial(n, max_rejection) <= k) <= level, the exact test of "it
rejects more than `max_rejection` of the good texts". Steps are tested in the
order of the ladder up to the first failure (fixed-sequence testing: one level for
the whole ladder, however many rules and cutoffs it has), and a stratum's level is
`delta` divided by the number of strata with good texts (Bonferroni). Of the
certified steps, which hold together, that one comes into force that rejects the
most bad labelled texts net of good ones; the lenient one of equals. So with
probability 1 - delta no stratum loses more than `max_rejection` of its good texts.
A stratum with too few good texts (fewer than log(level) / log(1 - max_rejection),
144 for four strata) certifies nothing, and rejects nothing.

Measures come from one pass over the texts, and are written; counts come from one
aggregation, with a row for each stratum and step, whatever the number of texts.
What is in force goes back by a join on the stratum.

Defined results: a null text has no words; a null stratum is one of its own;
holdout texts are those with a label that pass the base rules; labels with a
null id or label count for nothing; of several labels of one id the worst
holds; repeated rows of a labelled id are several holdout texts; without labels
nothing but the base rules rejects; an empty table gives an empty result. A text
is measured as a whole: a task needs about 40 times the bytes of its longest text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._store import written
from quern.llm._text import NON_SPACE, as_text, byte_view, covered, find_words, hash_ranges, mix, release, rolling, same_text, slices

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]
MEASURES = T.StructType([T.StructField(x, T.LongType()) for x in FIELDS])

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def measure(texts: pa.Array) -> pa.Array:
    """The struct of counts for each text."""
    data, offsets = byte_view(as_text(texts))
    out = np.zeros((len(FIELDS), len(texts)), np.int64)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        words = find_words(part, at, NON_SPACE)

        def total(mask: np.ndarray, at=at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask)])
            return sums[at[1:]] - sums[at[:-1]]

        doc = words.doc()
        h = hash_ranges(words.data, words.starts, words.ends)
        trio = same_text(words.first, 3)
        repeated = np.zeros(len(h), bool)
        if len(trio):
            keys = mix(rolling(h, 3, 0x5851F42D4C957F2D))[trio] + mix(doc[trio].astype(np.uint64) + np.uint64(1))
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            again = np.zeros(len(trio), bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            repeated = covered(len(h), trio[again], 3)
        marks = np.concatenate([[0], np.cumsum(repeated)])
        raw = part.tobytes()
        dups, lines = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            worded = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            lines[i], dups[i] = len(worded), len(worded) - len(set(worded))
        out[:, lo:hi] = [
            words.counts, total(NON_SPACE[part] & ((part & 0xC0) != 0x80)), total(SYMBOLS[part]), dups,
            marks[words.first[1:]] - marks[words.first[:-1]], lines, total((part >= 0x41) & (part <= 0x5A)), total(part == 0x21),
        ]
    return pa.StructArray.from_arrays([pa.array(x) for x in out], FIELDS)


@F.arrow_udf(MEASURES)
def _measures(texts: pa.Array) -> pa.Array:
    out = measure(texts)
    release()
    return out


# A filter on a deterministic function's result is pushed below it, and the function runs twice.
_measures = _measures.asNondeterministic()


def base_failed(m: str = "m") -> Column:
    """Fewer than 50 words, or over half of the words in repeated three-word windows."""
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects where numerator > cutoff * denominator; cutoffs from lenient to strict."""

    name: str
    numerator: str
    denominator: str
    cutoffs: tuple[float, ...]


#: In the order of the ladder: what tells most comes first.
RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", (3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("word_length", "word_chars", "n_words", (30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0)),
    Rule("bangs_per_word", "n_bangs", "n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("capitals_per_character", "n_upper", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), by its terms from k down; 1 where k is not below n * p."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    term = total = 1.0
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(min(0.0, log + math.log(total))))


@F.arrow_udf(T.DoubleType())
def _tails(k: pa.Array, n: pa.Array, p: pa.Array) -> pa.Array:
    return pa.array([binomial_tail(*x) for x in zip(k.to_pylist(), n.to_pylist(), p.to_pylist(), strict=True)], pa.float64())


def ladder(rules: tuple[Rule, ...] = RULES) -> list[tuple[int, Rule, float]]:
    """(step, rule, cutoff) in the order in which they are tested."""
    return [(step, rule, cutoff) for step, (rule, cutoff) in enumerate((r, c) for r in rules for c in r.cutoffs)]


def _first_step(rule: Rule, rules: tuple[Rule, ...], m: str = "m") -> Column:
    """The first step at which this rule rejects the text; the ladder's length if none does."""
    low, high, steps = F.col(f"{m}.{rule.numerator}"), F.col(f"{m}.{rule.denominator}"), ladder(rules)
    own = [F.when(low > c * high, F.lit(step)) for step, r, c in steps if r is rule]
    return F.coalesce(*own, F.lit(len(steps)))


def certified_steps(holdout: DataFrame, max_rejection: float = 0.03, delta: float = 0.05, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(stratum, used): how many steps of the ladder are in force.

    `holdout` has a row for each labelled text: stratum, good and m, its measures.
    """
    first = F.least(*[_first_step(r, rules) for r in rules], F.lit(len(ladder(rules))))
    sums = [F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")]
    counts = written(holdout.select("stratum", "good", first.alias("first")).groupBy("stratum", "first").agg(*sums), "holdout")
    strata = max(1, counts.where("good > 0").select("stratum").distinct().count())
    totals = counts.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("first", "good", "bad")).alias("by"))
    steps = totals.select("stratum", "n", "by", F.explode(F.sequence(F.lit(0), F.lit(len(ladder(rules)) - 1))).alias("step"))

    def rejected(kind: str) -> Column:
        none = F.lit(0).cast("long")
        return F.aggregate("by", none, lambda acc, e: acc + F.when(e["first"] <= F.col("step"), e[kind]).otherwise(none))

    tested = steps.select("stratum", "n", "step", rejected("good").alias("k"), rejected("bad").alias("caught"))
    judged = tested.select("stratum", "step", "k", "caught", _tails("k", "n", F.lit(max_rejection)).alias("tail"))
    failing = judged.groupBy("stratum").agg(F.min(F.when(F.col("tail") > delta / strata, F.col("step"))).alias("first"), F.collect_list(F.struct((F.col("caught") - F.col("k")).alias("net"), (-F.col("step")).alias("lenient"), "step")).alias("all"))
    certified = F.filter("all", lambda x: F.col("first").isNull() | (x["step"] < F.col("first")))
    best = F.array_max(certified)
    return failing.select("stratum", F.when(best["net"] > 0, best["step"] + 1).otherwise(0).alias("used"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", max_rejection: float = 0.03, delta: float = 0.05, rules: tuple[Rule, ...] = RULES, columns: list[str] | None = None) -> DataFrame:
    """`docs`, or these `columns` of it, with structs: m (measures) and verdict (base_failed, rejected_by, kept).

    Columns of these two names are replaced. What is returned is written with the
    measures once, so that texts are measured once.
    """
    held = [c for c in (docs.columns if columns is None else columns) if c not in ("m", "verdict")]
    own = F.struct(*[F.col(c) for c in held]).alias("row")
    measured = written(docs.select(own, F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), _measures(F.col(text_col).cast("string")).alias("m")), "measures")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good")).withColumnRenamed("doc_id", "id")
    holdout = measured.select("id", "stratum", "m").where(~base_failed()).join(known, "id")
    used = written(certified_steps(holdout, max_rejection, delta, rules).withColumnRenamed("stratum", "of"), "cutoffs")
    joined = measured.join(used, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejects = [F.when(_first_step(r, rules) < F.coalesce("used", F.lit(0)), F.lit(r.name)) for r in rules]
    by, failed = F.array_compact(F.array(*rejects)), base_failed()
    verdict = F.struct(failed.alias("base_failed"), by.alias("rejected_by"), (~failed & (F.size(by) == 0)).alias("kept"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in held], "m", verdict.alias("verdict"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id"])
    return judged.select("doc_id", *[f"m.{x}" for x in FIELDS[:5]], "verdict.base_failed", "verdict.kept")


def _sql(max_rejection: float = 0.03, delta: float = 0.05) -> str:
    word, risk, n_steps = r"[^\x20\x09-\x0D]", f"{max_rejection!r}::DOUBLE", len(ladder())
    cases = " ".join(f"WHEN {r.numerator} > {c!r}::DOUBLE * {r.denominator} THEN {step}" for step, r, c in ladder())
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM documents),
trios AS (SELECT doc_id, i, run, count(*) OVER (PARTITION BY doc_id, run) AS times FROM (SELECT doc_id, i, w[i + 1:i + 3] AS run FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM t WHERE len(w) >= 3))),
again AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM trios WHERE times > 1) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs FROM t LEFT JOIN again ON again.doc_id = t.doc_id),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE {cases} ELSE {n_steps} END AS first FROM m),
known AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT lang, first, good FROM judged JOIN known USING (doc_id) WHERE NOT base_failed),
counts AS (SELECT lang, step, count_if(good)::BIGINT AS n, count_if(good AND first <= step)::BIGINT AS k, count_if(NOT good AND first <= step)::BIGINT AS caught FROM held, range({n_steps}) r(step) GROUP BY lang, step),
strata AS (SELECT greatest(1, count(DISTINCT coalesce(lang, '(none)'))) AS n_strata FROM held WHERE good),
tails AS (SELECT lang, step, any_value(k) AS k, any_value(caught) AS caught, CASE WHEN any_value(k) >= any_value(n) * {risk} THEN 1.0::DOUBLE ELSE sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) END AS tail FROM (SELECT *, unnest(range(CASE WHEN k >= n * {risk} THEN 1 ELSE k + 1 END)) AS i FROM counts) GROUP BY lang, step),
failing AS (SELECT lang, min(step) FILTER (WHERE tail > {delta!r}::DOUBLE / n_strata) AS fails FROM tails, strata GROUP BY lang),
used AS (SELECT lang, step FROM (SELECT t.*, row_number() OVER (PARTITION BY t.lang ORDER BY caught - k DESC, step) AS place FROM tails t JOIN failing f ON t.lang IS NOT DISTINCT FROM f.lang WHERE fails IS NULL OR step < fails) WHERE place = 1 AND caught - k > 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (u.step IS NULL OR first > u.step) AS kept FROM judged j LEFT JOIN used u ON j.lang IS NOT DISTINCT FROM u.lang
"""


SQL = _sql()
