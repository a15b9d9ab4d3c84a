"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns (assignments, access identifiers, hex runs) are always reported. Weak candidates (short or unusual
identifiers, secrets and endpoints) are reported only when complementary parts of a credential lie in their scope,
``scope`` code points on either side, and don't overlap it: an identifier needs a secret, a secret an identifier, an endpoint both. The scopes are joined
as intervals: a part's end and start are marks in cells of ``scope`` code points, and a candidate probes two cells on either side.

Spans are in code points, end exclusive. Null or empty text has no spans; rows sharing a doc_id are scanned apart;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table


@dataclass(frozen=True)
class Pattern:
    """kind: name in the output; part: identifier, secret or endpoint; group and shortest: what must be how long; hint: cheap test before the pattern."""

    kind: str
    part: str
    regex: str
    group: int = 0
    shortest: int = 1
    longest: int = 1 << 30
    hint: str | None = None
    also: str | None = None  # a match must hold this, too


#: The strong patterns, in the order of the output, and the weak ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = (
    Pattern("assign", "secret", ASSIGN, group=1, shortest=12),
    Pattern("access", "identifier", "AKIA[A-Z0-9]+", shortest=18, hint="AKIA"),
    Pattern("hex", "secret", "[0-9a-f]{16,}+"),
)
WEAK = (
    Pattern("weak_identifier", "identifier", r"""(?i:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", group=1, shortest=3),
    Pattern("weak_assign", "secret", ASSIGN, group=1, shortest=6, longest=11),
    Pattern("weak_secret", "secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}", also="^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
    Pattern("weak_endpoint", "endpoint", r"""(?i:https?|ftp|jdbc|postgres|mysql|redis|mongodb|amqp)[a-z0-9:+]*://[^\x09-\x0D\x20"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"""),
)
CHUNK = 256


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sums(lens: str) -> str:
    """SQL for the running sums of an array of longs, in chunks so that long arrays don't cost their square."""
    inner = f"""transform(ch, (c, k) -> slice(aggregate(c, array(ba[k]), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, {CHUNK}))"""
    bases = "aggregate(ch, array(0L), (a, c) -> concat(a, array(element_at(a, -1) + aggregate(c, 0L, (s, x) -> s + x))))"
    chunks = f"transform(sequence(0, greatest(size(ln) - 1, 0) div {CHUNK}), k -> slice(ln, k * {CHUNK} + 1, {CHUNK}))"
    return f"flatten(transform(transform(transform(array({lens}), ln -> {chunks}), ch -> named_struct('ch', ch, 'ba', {bases})), v -> {inner.replace('(ch,', '(v.ch,').replace('ba[k]', 'v.ba[k]')})[0])"


def spans_of(text: str, p: Pattern) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches of a pattern in the SQL column ``text``.

    The pieces between matches and the matches themselves give the places. Only texts that match at all pay for it.
    """
    r = _quoted(p.regex)
    hint = f"contains({text}, {_quoted(p.hint)}) and " if p.hint else ""
    lens = f"transform(zz, (x, k) -> cast(length(x.s) + if(k = 0, 0, length(zz[k - 1].m)) as bigint))"
    held = f"regexp_extract_all({text}, {r}, {p.group})" if p.group else "ms"
    zipped = f"transform(array(regexp_extract_all({text}, {r}, 0)), ms -> zip_with(zip_with(slice(split({text}, {r}, -1), 1, size(ms)), ms, (s, m) -> named_struct('s', s, 'm', m)), {held}, (x, g) -> named_struct('s', x.s, 'm', x.m, 'g', g)))[0]"
    fits = f"length(x.g) between {p.shortest} and {p.longest}" + (f" and x.g rlike {_quoted(p.also)}" if p.also else "")
    starts = _sums(lens)
    found = f"""transform(array({zipped}), zz -> filter(zip_with({starts}, zz, (b, x) ->
        if({fits}, named_struct('start', b, 'end', b + length(x.m)), null)), y -> y is not null))[0]"""
    return F.expr(f"if({hint}{text} rlike {r}, {found}, cast(array() as array<struct<start: bigint, end: bigint>>))")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = 200) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<start, rank, end, kind>, sorted; base has the strong ones only.

    Texts are scanned once; what goes on is the spans, and only parts of texts that hold a weak candidate and a possible complement
    are joined.
    """
    read = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    all_kinds = [*STRONG, *WEAK]
    found = read.select("doc_id", "_row", *[spans_of("_t", p).alias(f"_{p.kind}") for p in all_kinds])
    tag = lambda p, k: f"transform(_{p.kind}, x -> named_struct('start', x.start, 'rank', {k}, 'end', x.end, 'kind', '{p.kind}'))"
    base = "sort_array(concat(" + ", ".join(tag(p, k) for k, p in enumerate(STRONG)) + "))"
    weak = "concat(" + ", ".join(tag(p, k + len(STRONG)) for k, p in enumerate(WEAK)) + ")"
    some = {part: " + ".join(f"size(_{p.kind})" for p in all_kinds if p.part == part) for part in ("identifier", "secret", "endpoint")}
    linkable = f"size({weak}) > 0 and {some['identifier']} > 0 and {some['secret']} > 0"
    none = "cast(array() as array<struct<start: bigint, rank: int, end: bigint, kind: string>>)"
    rows = cut(found.select("doc_id", "_row", F.expr(base).alias("base"), F.expr(f"if({linkable}, {weak}, {none})").alias("_weak")))

    part_of = F.create_map(*[F.lit(x) for p in all_kinds for x in (p.kind, p.part)])
    parts = rows.where("size(_weak) > 0").select("_row", F.explode(F.concat("base", "_weak")).alias("x")).select("_row", "x.*").withColumn("part", part_of[F.col("kind")])
    # A complement lies whole before a candidate, its end within the scope, or whole behind it, its start within the scope. So a value never completes itself. Parts of
    # one kind don't overlap, so a cell of ``scope`` code points holds few ends or starts, however many the text has.
    cell = lambda c: F.floor(F.col(c) / scope)
    mark = lambda side, c: parts.select("_row", "part", F.lit(side).alias("side"), cell(c).alias("cell"), F.col(c).alias("at")).distinct()
    marks = mark("before", "end").unionByName(mark("behind", "start"))
    seek = lambda side, c: F.struct(F.lit(side).alias("side"), c.alias("cell"))
    own = parts.where(F.col("kind").isin([p.kind for p in WEAK]))
    probes = own.withColumn("x", F.explode(F.array(seek("before", cell("start")), seek("before", cell("start") - 1), seek("behind", cell("end")), seek("behind", cell("end") + 1))))
    probes = probes.select("_row", "start", "rank", "end", "kind", "part", "x.side", "x.cell")
    needs = F.when(F.col("p.part") == "identifier", F.array(F.lit("secret"))).when(F.col("p.part") == "secret", F.array(F.lit("identifier"))).otherwise(F.array(F.lit("identifier"), F.lit("secret")))
    gap = F.when(F.col("p.side") == "before", F.col("p.start") - F.col("c.at")).otherwise(F.col("c.at") - F.col("p.end"))
    met = (
        probes.alias("p")
        .join(marks.alias("c"), (F.col("p._row") == F.col("c._row")) & (F.col("p.side") == F.col("c.side")) & (F.col("p.cell") == F.col("c.cell")) & gap.between(0, scope) & F.array_contains(needs, F.col("c.part")))
        .groupBy("p._row", "p.start", "p.rank", "p.end", "p.kind", F.size(needs).alias("_needed"))
        .agg(F.countDistinct("c.part").alias("_met"))
        .where("_met = _needed")
    )
    linked = met.groupBy("_row").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("_linked"))
    whole = rows.drop("_weak").join(linked, "_row", "left")
    return whole.select("doc_id", "base", F.expr(f"sort_array(concat(base, coalesce(_linked, {none})))").alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of secrets in every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    told = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, x -> x.kind = '{p.kind}')) as bigint)").alias(f"n_{p.kind}") for p in STRONG],
        F.sha2(F.expr(told("base")), 256).alias("base_sha256"),
        F.expr(told("spans")).alias("spans"),
    )


def _for_duckdb(p: Pattern) -> tuple[str, str]:
    """(pattern, condition on the match m and group g) for DuckDB, whose patterns know neither lookarounds nor ASCII case folding.

    Runs of the class that a lookbehind excludes are matched whole; of runs of digits and dots the addresses are kept.
    """
    either = lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")"
    folded = re.sub(r"\(\?i:((?:[^()]|\([^()]*\))*)\)", either, p.regex)
    runs = re.sub(r"\(\?<![^)]*\)|\}\+(?=$|=)", lambda m: "}" if m[0] == "}+" else "", folded)
    runs = re.sub(r"\[0-9\]\{1,3\}.*$", "[0-9.]+", runs)
    fits = f"length(g) BETWEEN {p.shortest} AND {p.longest}"
    if runs.endswith("[0-9.]+"):
        fits += r" AND (contains(m, '://') OR regexp_full_match(m, '[0-9]{1,3}(\.[0-9]{1,3}){3}'))"
    for ahead in re.findall(r"\(\?=\.\*(\[[^]]+\])\)", p.also or ""):
        fits += f" AND regexp_matches(m, '{ahead}')"
    return runs.replace("'", "''"), fits


def secrets_sql(documents: str = "documents", scope: int = 200) -> str:
    """The rows of ``op9_secrets`` in DuckDB SQL; weak parts are held against all parts of their text."""
    places = []
    for rank, p in enumerate([*STRONG, *WEAK]):
        r, fits = _for_duckdb(p)
        places.append(f"""
        SELECT r, '{p.kind}' AS kind, {rank} AS rank, '{p.part}' AS part, s AS "start", s + length(m) AS "end"
        FROM (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
              FROM (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(pieces[1:len(ms)]) AS piece
                    FROM (SELECT r, regexp_extract_all(t, '{r}', 0) AS ms, regexp_extract_all(t, '{r}', {p.group}) AS gs, string_split_regex(t, '{r}') AS pieces
                          FROM texts WHERE regexp_matches(t, '{r}'))))
        WHERE {fits}""")
    told = """coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank, "end"){}, '')"""
    strong = f"FILTER (WHERE rank < {len(STRONG)})"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{p.kind}') AS n_{p.kind}" for p in STRONG)
    return f"""
    WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {documents}),
    parts AS MATERIALIZED ({" UNION ALL ".join(places)}),
    met AS (SELECT p.r, p.kind, p.rank, p."start", p."end"
            FROM parts p JOIN parts c ON p.r = c.r AND (p."start" - c."end" BETWEEN 0 AND {scope} OR c."start" - p."end" BETWEEN 0 AND {scope})
            WHERE p.rank >= {len(STRONG)} AND (CASE p.part WHEN 'identifier' THEN c.part = 'secret' WHEN 'secret' THEN c.part = 'identifier' ELSE c.part IN ('identifier', 'secret') END)
            GROUP BY ALL HAVING count(DISTINCT c.part) = CASE any_value(p.part) WHEN 'endpoint' THEN 2 ELSE 1 END),
    spans AS (SELECT r, kind, rank, "start", "end" FROM parts WHERE rank < {len(STRONG)} UNION ALL SELECT r, kind, rank, "start", "end" FROM met)
    SELECT any_value(doc_id) AS doc_id, {counts}, sha256({told.format(" " + strong)}) AS base_sha256, {told.format("")} AS spans
    FROM texts LEFT JOIN spans USING (r) GROUP BY r"""
