"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Per text a few counts are taken (words, symbols, repeated lines, repeated word windows, capitals).
Each rule is a share of those counts, and rejects what lies above a cutoff. Cutoffs are learned per
stratum (language) from labelled documents, in two parts that share none. The first part, a quarter of them, gives each rule the end
of its path: the cutoff that gains most (share of junk rejected less share of good rejected), if that is ``min_gain`` at least. The path lowers the cutoffs of all
rules together, each as far as its end. Along it the second part, the holdout, is tested in fixed sequence, mildest step first, until a test fails: an exact
binomial test that all rules *together* reject at most ``alpha`` of the good documents. The level is divided over the strata
(Bonferroni), so with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents to the learned rules. Among the certified
steps the one is taken that gains most on the holdout (ties: the mildest).

Edge cases: null or empty text has no words and fails the base rule; a null language is a stratum of its
own; strata with too few labels keep the base rule alone; repeated doc_ids in the labels count
as bad if any says so; extra columns are ignored here and kept by ``apply_quality``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, stored, table

#: The symbol characters of the base counts.
SYMBOLS = r"#*$%&|<>"


@dataclass(frozen=True)
class QualityParams:
    """alpha: false rejection allowed to all rules of a stratum together; delta: chance that any certificate is wrong; tuning_below: labelled documents
    whose md5 of the id begins below this digit give the ends of the paths, the others are the holdout.

    rules: name -> (SQL share over the count columns, highest cutoff, lowest cutoff); steps: cutoffs of a grid, spaced
    geometrically; broadcast_strata: up to so many strata the learned cutoffs are broadcast.
    """

    alpha: float = 0.01
    delta: float = 0.05
    steps: int = 40
    min_gain: float = 0.01
    tuning_below: str = "4"
    min_words: int = 50
    max_repeat_percent: int = 50
    broadcast_strata: int = 5_000
    rules: dict = field(
        default_factory=lambda: {
            "symbols": ("n_symbols / greatest(n_words, 1)", 4.0, 0.01),
            "capitals": ("n_capitals / greatest(word_chars, 1)", 1.0, 0.05),
            "lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0, 0.05),
            "repeats": ("n_repeat_words / greatest(n_words, 1)", 1.0, 0.05),
        }
    )


def stratum_of(column: Column) -> Column:
    """The name of a stratum: the value behind a mark, so that a null one differs from an empty one."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and binds it to ``name`` in ``body``, whatever the optimizer moves where."""
    return f"transform(array({value}), {name} -> {body})[0]"


def counts_of(text: str = "text") -> str:
    """SQL for a struct of COUNTS of a text column.

    A word is a run of characters other than ASCII white space. Word windows are compared by a 64-bit hash of
    three words within one text, found by sorting (hash, position), so a long text costs n log n.
    """
    t = f"coalesce(`{text}`, '')"
    trimmed = rf"regexp_replace({t}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '')"
    words = rf"split({trimmed}, '[\\x20\\x09-\\x0D]+', -1)"
    lines = rf"filter(split({t}, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"
    windows = "sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> struct(xxhash64(x, get(w, i + 1), get(w, i + 2)) as h, i as i)))"
    twice = "sort_array(transform(filter(s, (x, j) -> x.h = get(s, j - 1).h or x.h = get(s, j + 1).h), x -> x.i))"
    # least() skips nulls, so the first window covers three words and each next one what it adds.
    repeats = _let(windows, "s", _let(twice, "p", "aggregate(transform(p, (x, k) -> least(3, x - get(p, k - 1))), 0L, (a, x) -> a + x)"))
    own = f"""named_struct(
        'n_words', if(size(w) = 1 and w[0] = '', 0L, cast(size(w) as bigint)),
        'word_chars', cast(length(array_join(w, '')) as bigint),
        'n_symbols', cast(length(regexp_replace({t}, '[^{SYMBOLS}]+', '')) as bigint),
        'n_dup_lines', cast(size(l) - size(array_distinct(l)) as bigint),
        'n_repeat_words', {repeats},
        'n_lines', cast(size(l) as bigint),
        'n_capitals', cast(length(regexp_replace({t}, '[^\\\\p{{Lu}}]+', '')) as bigint))"""
    return _let(words, "w", _let(lines, "l", own))


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` replaced by the long columns of COUNTS, row by row and without a shuffle."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != text and c not in COUNTS]
    return df.select(*keep, F.expr(counts_of(text)).alias("_counts")).select(*keep, "_counts.*")


def _stirling(x: str) -> str:
    """log gamma of x >= 1 as SQL: Stirling's series above 9, by the recurrence below."""
    z = f"({x} + 8D)"
    shift = " + ".join(f"ln({x} + {k}D)" for k in range(8))
    return (
        f"(({z} - 0.5D) * ln({z}) - {z} + 0.91893853320467274178D + 1D/(12D*{z}) - 1D/(360D*{z}*{z}*{z})"
        f" + 1D/(1260D*pow({z}, 5D)) - 1D/(1680D*pow({z}, 7D)) - ({shift}))"
    )


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(X <= k), X ~ Bin(n, p), exact to double precision.

    The largest term is taken in log space and the smaller ones are added downward by their ratio. From k below the
    mean the terms fall fast; beyond 60 standard deviations they are under 1e-300 of the first. Above the mean 1 is returned.
    """
    first = f"exp({_stirling(f'cast({n} as double) + 1D')} - {_stirling(f'cast({k} as double) + 1D')} - {_stirling(f'cast({n} - {k} as double) + 1D')} + {k} * ln({p}D) + ({n} - {k}) * ln(1D - {p}D))"
    ratio = (1 - p) / p
    steps = f"cast(least({k}, 100 + 60 * sqrt({n} * {p})) as int)"
    total = (
        f"aggregate(sequence(0, {steps}), named_struct('t', 1D, 's', 0D),"
        f" (a, j) -> named_struct('t', a.t * ({k} - j) / ({n} - {k} + j + 1) * {ratio}D, 's', a.s + a.t), a -> a.s)"
    )
    return f"case when {k} > {n} * {p} then 1D else least(1D, {first} * {total}) end"


def _chosen_step(steps: int, where: str, least_gain: float) -> str:
    """SQL for the struct (g, gain, false_rejects, caught) of most gain, ties to the mildest, over an array h of (cell, good, junk) with n_good and n_junk."""
    sums = ", ".join(f"'{name}', aggregate(filter(h, x -> x.cell <= g), 0L, (a, x) -> a + x.{what})" for name, what in (("false_rejects", "good"), ("caught", "junk")))
    tried = f"transform(sequence(0, {steps - 1}), g -> named_struct('g', g, {sums}))"
    gains = "transform(tried, x -> named_struct('gain', x.caught / greatest(n_junk, 1) - x.false_rejects / greatest(n_good, 1), 'mild', -x.g, 'g', x.g, 'false_rejects', x.false_rejects, 'caught', x.caught))"
    return _let(tried, "tried", f"array_max(filter({gains}, x -> x.gain >= {least_gain}D and ({where})))")


def learn_cutoffs(counts: DataFrame, labels: DataFrame, stratum: str = "lang", params: QualityParams = QualityParams()) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_junk, false_rejects, caught, p_value): the cutoffs of a stratum's rules; the figures are those of all its rules together.

    ``counts`` has doc_id, the stratum and COUNTS; ``labels`` has doc_id and quality (1 good, 0 junk).
    """
    p = params
    rules = list(p.rules)
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = counts.where(f"n_words >= {p.min_words} and 100 * n_repeat_words <= {p.max_repeat_percent} * n_words").join(marks, "doc_id")
    grid = lambda hi, lo: f"transform(sequence(0, {p.steps - 1}), g -> {hi}D * pow({lo / hi}D, g / {float(p.steps - 1)}D))"
    # The cell of a rule is the first cutoff of its grid that the document lies above.
    cells = F.expr("array(" + ", ".join(f"size(filter({grid(hi, lo)}, c -> ({share}) <= c))" for share, hi, lo in p.rules.values()) + ")")
    tunes = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < p.tuning_below
    good, junk = F.expr("cast(quality = 1 as bigint)").alias("good"), F.expr("cast(quality = 0 as bigint)").alias("junk")
    known = cut(known.select(stratum_of(F.col(stratum)).alias("stratum"), tunes.alias("tunes"), good, junk, cells.alias("cells")))
    # A histogram has at most steps + 1 cells per rule and stratum; it is summed up inside one array.
    tally = lambda df, *by: df.groupBy(*by, "cell").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk")).groupBy(*by).agg(F.collect_list(F.struct("cell", "good", "junk")).alias("h"), F.sum("good").alias("n_good"), F.sum("junk").alias("n_junk"))
    tuned = tally(known.where("tunes").select("stratum", "good", "junk", F.posexplode("cells").alias("rule", "cell")), "stratum", "rule")
    best = tuned.withColumn("best", F.expr(_chosen_step(p.steps, f"x.false_rejects <= {p.alpha}D * n_good", p.min_gain))).where("best is not null")
    ends = cut(best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("best.g")))).alias("ends")))
    # Step g of the path holds every rule at cutoff g or, from there on, at its own end; a document falls at the least of its cells that lie before the ends.
    joint = known.where("not tunes").join(_few(ends, p), "stratum")
    falls = F.expr(f"coalesce(array_min(array_compact(transform(cells, (c, r) -> if(c <= ends[r], c, null)))), {p.steps})")
    held = tally(joint.withColumn("cell", falls), "stratum")
    strata = held.agg(F.count("*").alias("n_strata"))
    false_rejects = "aggregate(filter(h, x -> x.cell <= g), 0L, (a, x) -> a + x.good)"
    fails = f"filter(sequence(0, {p.steps - 1}), g -> not (n_good > 0 and {_let(false_rejects, 'k', binomial_tail('n_good', 'k', p.alpha))} <= {p.delta}D / n_strata))"
    tested = held.crossJoin(F.broadcast(strata)).withColumn("stop", F.expr(f"coalesce(array_min({fails}), {p.steps})"))
    chosen = tested.withColumn("b", F.expr(_chosen_step(p.steps, "x.g < stop", p.min_gain))).where("b is not null").withColumn("p_value", F.expr(binomial_tail("n_good", "b.false_rejects", p.alpha)))
    hi = F.expr("array(" + ", ".join(f"{v[1]}D" for v in p.rules.values()) + ")[rule]")
    q = F.expr("array(" + ", ".join(f"{v[2] / v[1]}D" for v in p.rules.values()) + ")[rule]")
    told = chosen.join(_few(ends, p), "stratum").select("stratum", F.explode("ends").alias("rule", "end"), "n_good", "n_junk", "b.*", "p_value")
    name = F.expr("array(" + ", ".join(f"'{r}'" for r in rules) + ")[rule]")
    return told.select("stratum", name.alias("rule"), (hi * F.pow(q, F.least("g", "end") / float(p.steps - 1))).alias("cutoff"), "n_good", "n_junk", "false_rejects", "caught", "p_value")


def _few(df: DataFrame, params: QualityParams) -> DataFrame:
    """A table of one row per stratum, broadcast only when counted to be at most ``broadcast_strata`` rows."""
    return F.broadcast(df) if df.count() <= params.broadcast_strata else df


def _cutoff_maps(cutoffs: DataFrame, params: QualityParams) -> DataFrame:
    """(_stratum, _c): the cutoffs of each stratum as a map."""
    return _few(cut(cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_c"))), params)


def _verdict(params: QualityParams, of: str = "") -> tuple[str, str]:
    """SQL for base_failed and rules_failed over COUNTS (fields of the struct ``of``, or columns) and the map _c."""
    p = params
    own = lambda sql: re.sub(rf"\b({'|'.join(COUNTS)})\b", rf"{of}.\1" if of else r"\1", sql)
    base = own(f"(n_words < {p.min_words} or 100 * n_repeat_words > {p.max_repeat_percent} * n_words)")
    failed = "array_compact(array(" + ", ".join(f"if(({own(share)}) > _c['{r}'], '{r}', null)" for r, (share, _, _) in p.rules.items()) + "))"
    return base, failed


def judge(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang", params: QualityParams = QualityParams()) -> DataFrame:
    """``counts`` with base_failed, kept and rules_failed (array of the rules that reject the row)."""
    base, failed = _verdict(params)
    joined = counts.withColumn("_stratum", stratum_of(F.col(stratum))).join(_cutoff_maps(cutoffs, params), "_stratum", "left")
    out = joined.withColumn("base_failed", F.expr(base)).withColumn("rules_failed", F.expr(failed))
    return out.withColumn("kept", F.expr("not base_failed and size(rules_failed) = 0")).drop("_stratum", "_c")


def quality_verdicts(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Counts, cutoffs learned from ``labels`` and verdicts for every row of ``docs`` (doc_id, text, lang).

    Texts are scanned once; only the counts, some 80 bytes a document, are kept for the second look.
    """
    counts = cut(text_counts(docs.select("doc_id", "text", "lang")))
    return judge(counts, learn_cutoffs(counts, labels, "lang", params), "lang", params)


def apply_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns.

    Rows are stored with their counts, so texts are scanned once; cutoffs come from the counts of all rows, the verdict from each row's own, so
    rows sharing a doc_id are judged apart and no join on documents is needed.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = stored(docs.select(row, F.expr(counts_of("text")).alias("counts")))
    counts = whole.select("row.doc_id", "row.lang", "counts.*")
    cutoffs = learn_cutoffs(counts, labels, "lang", params)
    base, failed = _verdict(params, "counts")
    tagged = whole.withColumn("_stratum", stratum_of(F.col("row.lang"))).join(_cutoff_maps(cutoffs, params), "_stratum", "left")
    return tagged.where(F.expr(f"not {base} and size({failed}) = 0")).select("row.*")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rules_failed", ",").alias("rules_failed"))


def quality_sql(documents: str = "documents", labels: str = "labels", params: QualityParams = QualityParams()) -> str:
    """The rows of ``op8_quality`` in DuckDB SQL, from the counts by plain windows to the binomial tests by their sums."""
    p = params
    cutoff = lambda rule, g: f"(CASE {rule} " + " ".join(f"WHEN '{r}' THEN {hi} * pow({lo / hi}, ({g}) / {float(p.steps - 1)})" for r, (_, hi, lo) in p.rules.items()) + " END)"
    gain = "caught / greatest(n_junk, 1) - false_rejects / greatest(n_good, 1)"
    tail = f"""(CASE WHEN false_rejects > n_good * {p.alpha} THEN 1 ELSE list_sum([exp(lgamma(n_good + 1.0) - lgamma(j + 1.0) - lgamma(n_good - j + 1.0) + j * ln({p.alpha}) + (n_good - j) * ln(1 - {p.alpha}))
                FOR j IN range(0, CAST(false_rejects AS BIGINT) + 1)]) END)"""
    tried = lambda rows, by: f"""SELECT {by}, g, sum(CASE WHEN cell <= g THEN good ELSE 0 END) AS false_rejects, sum(CASE WHEN cell <= g THEN junk ELSE 0 END) AS caught, sum(good) AS n_good, sum(junk) AS n_junk
            FROM {rows}, (SELECT unnest(range(0, {p.steps})) AS g) GROUP BY {by}, g"""  # noqa: E731
    return rf"""
    WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t FROM {documents}),
    split AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
    words AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS a FROM split),
    windows AS (SELECT *, lead(a) OVER (PARTITION BY r ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY r ORDER BY i) AS c FROM words),
    twice AS (SELECT r, i FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
    repeats AS (SELECT r, sum(covered) AS n FROM (SELECT r, least(3, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i), 3)) AS covered FROM twice) GROUP BY r),
    counts AS MATERIALIZED (SELECT r, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_capitals FROM texts JOIN split USING (r) LEFT JOIN repeats USING (r)),
    judged AS MATERIALIZED (SELECT *, n_words < {p.min_words} OR 100 * n_repeat_words > {p.max_repeat_percent} * n_words AS base_failed FROM counts),
    shares AS MATERIALIZED ({" UNION ALL ".join(f"SELECT r, doc_id, stratum, base_failed, {k} AS k, '{rule}' AS rule, {share} AS share FROM judged" for k, (rule, (share, _, _)) in enumerate(p.rules.items()))}),
    marks AS (SELECT doc_id, min(quality) AS quality FROM {labels} WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    known AS MATERIALIZED (SELECT r, stratum, rule, left(md5(CAST(doc_id AS VARCHAR)), 1) < '{p.tuning_below}' AS tunes, CAST(quality = 1 AS BIGINT) AS good, CAST(quality = 0 AS BIGINT) AS junk,
        len(list_filter(range(0, {p.steps}), lambda g: share <= {cutoff("rule", "g")})) AS cell FROM shares JOIN marks USING (doc_id) WHERE NOT base_failed),
    ends AS MATERIALIZED (SELECT stratum, rule, g AS last FROM ({tried("(SELECT * FROM known WHERE tunes)", "stratum, rule")})
        WHERE false_rejects <= {p.alpha} * n_good AND {gain} >= {p.min_gain} QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY {gain} DESC, g) = 1),
    falls AS (SELECT k.r, k.stratum, any_value(good) AS good, any_value(junk) AS junk, coalesce(min(cell) FILTER (WHERE cell <= last), {p.steps}) AS cell
        FROM known k JOIN (SELECT DISTINCT stratum FROM ends) s ON k.stratum = s.stratum LEFT JOIN ends e ON k.stratum = e.stratum AND k.rule = e.rule WHERE NOT tunes GROUP BY k.r, k.stratum),
    path AS MATERIALIZED (SELECT * FROM ({tried("falls", "stratum")})),
    tested AS (SELECT *, coalesce(min(CASE WHEN n_good = 0 OR {tail} > {p.delta} / (SELECT count(DISTINCT stratum) FROM falls) THEN g END) OVER (PARTITION BY stratum), {p.steps}) AS stop FROM path),
    chosen AS (SELECT stratum, g FROM tested WHERE g < stop AND {gain} >= {p.min_gain} QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {gain} DESC, g) = 1),
    cutoffs AS MATERIALIZED (SELECT stratum, rule, {cutoff("rule", "least(g, last)")} AS cutoff FROM chosen JOIN ends USING (stratum)),
    failed AS (SELECT r, string_agg(rule, ',' ORDER BY k) AS rules_failed FROM shares JOIN cutoffs USING (stratum, rule) WHERE share > cutoff GROUP BY r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules_failed IS NULL AS kept, coalesce(rules_failed, '') AS rules_failed
    FROM judged LEFT JOIN failed USING (r)"""
