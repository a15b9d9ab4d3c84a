"""Facts of source files: lines, functions, signatures, docs, variables, calls and data flow, by patterns and windows over a table of lines.

A lexical reading of conventional code: a function's name stands on the line that opens its header, whose parameters and return type may go over several lines. Strings, characters
and comments, over lines too, are told from code by a token pattern per language; nested comments to a depth of two, and no regular-expression literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edge_id, file_label, language_of, node_id, typed_edge_id
from .graph import cut, derive_child_ids

#: Words that look like calls and aren't.
NOT_CALLS = ("if", "while", "for", "match", "return", "fn", "loop", "let", "else", "in", "as", "move", "where", "impl")


_COMMENT = r"/\*(?:[^*/]++|\*(?!/)|/(?!\*)|/\*(?:[^*]++|\*(?!/))*+\*/)*+(?:\*/|\z)"
_LITERAL = r"{0}[^{0}\\{1}]*+(?:\\[\s\S][^{0}\\{1}]*+)*+"
#: What is no code: comments and literals, one alternative each; what runs to the end of the file without its end mark is an error.
_TOKENS = {
    "rust": rf"""//[^\n]*+|{_COMMENT}|\br(#{{0,3}})"[\s\S]*?(?:"\2|\z)|{_LITERAL.format('"', '')}(?:"|\z)|'(?:[^'\\\n]|\\(?:[^xu\n]|x[0-9a-fA-F]{{2}}|u\{{[0-9a-fA-F_]+\}}))'""",
    "python": rf"""#[^\n]*+|\"{{3}}(?:[^"\\]++|\\[\s\S]|"(?!""))*+(?:\"{{3}}|\z)|'{{3}}(?:[^'\\]++|\\[\s\S]|'(?!''))*+(?:'{{3}}|\z)|{_LITERAL.format('"', chr(92) + "n")}"|{_LITERAL.format("'", chr(92) + "n")}'""",
    "typescript": rf"""//[^\n]*+|{_COMMENT}|{_LITERAL.format('`', '')}(?:`|\z)|{_LITERAL.format('"', chr(92) + "n")}"|{_LITERAL.format("'", chr(92) + "n")}'""",
}
#: Stands in code for a comment or literal without an end.
OPEN_END = "\x01"


def code_of(content: Column, language: Column) -> Column:
    """``content`` with comments and the insides of literals as spaces, line ends and places kept; a literal keeps its outer marks, one without an end gets ``OPEN_END`` at its start."""
    comment = r"^(?://|/\*|#)"
    ended = r"""(?s)^(?://.*|#.*|/\*.*\*/|("{3}|'{3}).*\1|r(#*)".*"\2|(["'`]).*\3)$"""
    blank = lambda x: F.regexp_replace(x, r"[^\n]", " ")

    def one(x: Column) -> Column:
        inside = F.concat(F.substring(x, 1, 1), blank(F.substring(x, F.lit(2), F.length(x) - 2)), F.substring(x, -1, 1))
        whole = F.when(x.rlike(comment), blank(x)).otherwise(inside)
        return F.when(x.rlike(ended), whole).otherwise(F.concat(F.lit(OPEN_END), blank(F.substring(x, F.lit(2), F.length(x)))))

    def masked(name: str) -> Column:
        # What can begin no token is one piece up to where one may begin; # and ` are pieces of their own in every language.
        pieces = F.regexp_extract_all(content, F.lit(rf"({_TOKENS[name]})|[^/\"'#`{'r' if name == 'rust' else ''}]++|[\s\S]"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda x: F.when((F.length(x) < 2) & (x != "#"), x).when(x.rlike(r"""^(?://|/\*|#|r#*"|["'`])"""), one(x)).otherwise(x)), "")

    return F.when(language == "rust", masked("rust")).when(language == "python", masked("python")).when(language == "typescript", masked("typescript")).otherwise(content)


def source_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, text, code) with line numbers from 1; code is the text without comments and the insides of literals."""
    told = files.select("path", language_of("path").alias("language"), F.regexp_replace("content", r"\r(?=\n|\z)", "").alias("content")).withColumn("code", code_of(F.col("content"), F.col("language")))
    both = F.arrays_zip(F.split("content", "\n").alias("text"), F.split("code", "\n").alias("code"))
    lines = told.select("path", "language", F.posexplode(both).alias("_k", "x"))
    return lines.select("path", "language", (F.col("_k") + 1).alias("line_no"), F.col("x.text").alias("text"), F.col("x.code").alias("code"))


def _by_language(rust, python, typescript) -> Column:
    return F.when(F.col("language") == "rust", rust).when(F.col("language") == "python", python).when(F.col("language") == "typescript", typescript)


_HEADERS = {
    "rust": r"^(\s*)(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+([A-Za-z_][A-Za-z0-9_]*)",
    "python": r"^(\s*)(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    "typescript": r"^(\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][A-Za-z0-9_$]*)",
}
_PARAMS = {"rust": r"fn\s+\w+\s*(?:<[^(]*>)?\s*\(([^)]*)\)", "python": r"def\s+\w+\s*\(([^)]*)\)", "typescript": r"function\s*\*?\s*[\w$]+\s*(?:<[^(]*>)?\s*\(([^)]*)\)"}
_RETURNS = {"rust": r"\)\s*->\s*([^{;]+?)\s*(?:where\b.*)?(?:[{;].*)?$", "python": r"\)\s*->\s*([^:]+?)\s*:", "typescript": r"\)\s*:\s*([^{]+?)\s*(?:\{.*)?$"}


def _header(group: int, column: str) -> Column:
    return _by_language(*[F.regexp_extract(column, _HEADERS[k], group) for k in ("rust", "python", "typescript")])


def function_headers(lines: DataFrame) -> DataFrame:
    """Header lines (path, language, line_no, text, name, indent), repeats of a name included; where lines have their code, none in comments or literals."""
    read = "code" if "code" in lines.columns else "text"
    found = lines.withColumn("name", _header(2, read)).where("name <> ''")
    return found.withColumn("indent", F.length(_header(1, read)))


def _count(pattern: str) -> Column:
    return F.length(F.regexp_replace("code", rf"[^{pattern}]", ""))


def whole_headers(lines: DataFrame) -> DataFrame:
    """(path, language, name, line_no, _whole): the headers that begin on a line, up to the line that closes their brackets and opens the body; ``lines`` have their code.

    Depth is a running count of brackets in code over the lines of one file; comments at line ends are left out.
    """
    by = Window.partitionBy("path").orderBy("line_no")
    down = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    body = F.col("code").rlike(r"[{;]")
    ends = _by_language(body, F.col("code").rlike(r":\s*($|\S)"), body)
    told = lines.withColumn("_step", _count(r"\(\[") - _count(r"\)\]")).withColumn("name", F.nullif(_header(2, "code"), F.lit(""))).withColumn("_opens", F.col("name").isNotNull())
    deep = told.withColumn("_depth", F.sum("_step").over(by))
    opened = lambda c: F.last(F.when(F.col("_opens"), c), True).over(by)
    stop = deep.withColumn("_head", opened(F.col("line_no"))).withColumn("_from", opened(F.col("_depth") - F.col("_step"))).withColumn("_ends", (F.col("_depth") <= F.col("_from")) & F.coalesce(ends, F.lit(False)))
    first = F.coalesce(F.first(F.when(F.col("_ends"), F.col("line_no")), True).over(down), F.col("line_no"))
    own = stop.withColumn("_first", first).withColumn("_stop", opened(F.col("_first"))).where("line_no <= _stop")
    kept = F.substring("text", F.lit(1), F.length(F.rtrim("code")))
    joined = own.groupBy("path", "language", F.col("_head").alias("line_no")).agg(F.max("name").alias("name"), F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("n"), kept.alias("t")))).alias("_all"))
    text = F.array_join(F.transform("_all", lambda x, i: F.when(i == 0, F.rtrim(x["t"])).otherwise(F.trim(x["t"]))), " ")
    return joined.select("path", "language", "name", "line_no", text.alias("_whole"))


def scan_functions(lines: DataFrame) -> DataFrame:
    """(path, language, name, line_no, text): one function per file and name, the last header wins; text is the whole header where lines have their code."""
    heads = whole_headers(lines).withColumnRenamed("_whole", "text") if "code" in lines.columns else function_headers(lines)
    last = heads.groupBy("path", "language", "name").agg(F.max_by(F.struct("line_no", "text"), "line_no").alias("h"))
    return last.select("path", "language", "name", "h.line_no", "h.text")


def scan_signatures(functions: DataFrame) -> DataFrame:
    """``functions`` with signature: parameters in order with their types, the receiver left out, and the return type."""
    pick = lambda table: _by_language(*[F.regexp_extract("text", table[k], 1) for k in ("rust", "python", "typescript")])
    whole = F.transform(F.split(pick(_PARAMS), r",(?![^<\[(]*[>\])])"), lambda p: F.trim(p))
    plain = F.filter(whole, lambda p: p != "")
    name = lambda p: F.trim(F.regexp_replace(F.split_part(p, F.lit(":"), F.lit(1)), r"^mut\s+|\?$", ""))
    kind = lambda p: F.when(F.contains(p, F.lit(":")), F.trim(F.regexp_replace(p, r"^[^:]*:", ""))).otherwise(F.lit(""))
    receiver = r"^&?\s*('\w+\s+)?(mut\s+)?self\b"
    rust = F.filter(plain, lambda p: ~p.rlike(receiver))
    python = F.filter(F.transform(plain, lambda p, i: F.when(((i == 0) & p.rlike(r"^(self|cls)\b")) | p.rlike(r"^\*|=|^/$"), None).otherwise(p)), lambda p: p.isNotNull())
    typescript = F.filter(plain, lambda p: ~p.rlike(r"^\.\.\.|="))
    params = F.transform(_by_language(rust, python, typescript), lambda p: F.struct(name(p).alias("name"), kind(p).alias("type")))
    return functions.withColumn("signature", F.struct(params.alias("params"), F.coalesce(pick(_RETURNS), F.lit("")).alias("returns")))


def scan_docs(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, name, docs) of documented functions: the run of doc comments right above (Rust, TypeScript), or the string that opens the body (Python)."""
    mark = F.when(F.col("language") == "rust", F.col("text").rlike(r"^\s*///")).when(F.col("language") == "typescript", F.col("text").rlike(r"^\s*(/\*\*|\*)")).otherwise(F.lit(False))
    comments = lines.where(mark)
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    cleaned = F.when(F.col("language") == "rust", F.regexp_replace("text", r"^\s*/// ?", "")).otherwise(F.regexp_replace(F.regexp_replace("text", r"^\s*(/\*\*|\*(?!/)) ?", ""), r"\s*\*/\s*$", ""))
    runs = comments.withColumn("_i", island).withColumn("_t", cleaned).groupBy("path", "language", "_i").agg(F.max("line_no").alias("_last"), F.sort_array(F.collect_list(F.struct("line_no", "_t"))).alias("_ts"))
    parts = F.transform("_ts", lambda t: t["_t"])
    body = F.array_join(F.when(F.col("language") == "typescript", F.filter(parts, lambda t: F.trim(t) != "")).otherwise(parts), "\n")
    above = runs.select("path", (F.col("_last") + 1).alias("line_no"), body.alias("docs"))
    direct = functions.join(above, ["path", "line_no"]).select("path", "name", "docs")
    opener = lines.where("language = 'python'").select("path", (F.col("line_no") - 1).alias("line_no"), F.trim(F.regexp_extract("text", r'^\s*[rRuU]?(?:"""|\'\'\')(.*?)(?:"""|\'\'\')?\s*$', 1)).alias("docs"))
    python = functions.where("language = 'python'").join(opener.where("docs <> ''"), ["path", "line_no"]).select("path", "name", "docs")
    return direct.unionByName(python)


def file_docs(lines: DataFrame) -> DataFrame:
    """(path, docs): the leading //! lines of Rust files."""
    flagged = lines.where("language = 'rust'").withColumn("_doc", F.col("text").startswith("//!"))
    first_other = flagged.where("not _doc").groupBy("path").agg(F.min("line_no").alias("_stop"))
    led = flagged.where("_doc").join(first_other, "path", "left").where("_stop is null or line_no < _stop")
    listed = led.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", F.regexp_replace("text", "^//! ?", "").alias("t")))).alias("x"))
    return listed.select("path", F.array_join(F.transform("x", lambda t: t["t"]), "\n").alias("docs"))


def enclosing(lines: DataFrame) -> DataFrame:
    """Lines with fn, the function whose body they are in, and depth, the open braces before the line (Rust and TypeScript).

    Lines that are so marked already are taken as they are. The running sums are per file. A function's body is left when the depth falls back to its header's, or for Python when the indent does.
    """
    if "fn" in lines.columns:
        return lines
    coded = ["code"] if "code" in lines.columns else []
    return _enclosed(lines, ["text", *coded])


def _enclosed(lines: DataFrame, kept: list[str], wanted: Column | None = None) -> DataFrame:
    """(path, language, line_no, *kept, fn, depth) as in ``enclosing``. Of lines that aren't ``wanted`` only headers and those with braces are sorted, since no other bears on what a line is in."""
    by = Window.partitionBy("path").orderBy("line_no")
    coded = "code" in lines.columns
    code = F.col("code") if coded else F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"|//.*$', "")
    delta = F.length(F.regexp_replace(code, r"[^{]", "")) - F.length(F.regexp_replace(code, r"[^}]", ""))
    heads = lines.withColumn("_name", F.nullif(_header(2, "code" if coded else "text"), F.lit(""))).withColumn("_indent", F.length(F.regexp_extract("text", r"^(\s*)", 1)))
    deltas = heads.withColumn("_delta", delta)
    if wanted is not None:
        deltas = deltas.where(wanted | F.col("_name").isNotNull() | (F.col("_delta") != 0))
    deep = deltas.select("path", "language", "line_no", *kept, "_name", "_indent", "_delta").withColumn("depth", F.coalesce(F.sum("_delta").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("fn"), F.col("depth").alias("at"), F.col("_indent").alias("indent"), F.col("line_no").alias("from")))
    held = deep.withColumn("_h", F.last(top, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.when(F.col("language") == "python", F.col("_indent") > F.col("_h.indent")).otherwise(F.col("depth") > F.col("_h.at"))
    return held.select("path", "language", "line_no", *kept, F.when(inside, F.col("_h.fn")).alias("fn"), F.when(inside, F.col("depth") - F.col("_h.at")).alias("depth"))


_LET = r"^\s*let\s+(.+?)\s*(?::[^=;]+)?(?:=(?!=).*|;\s*)$"


def scan_variables(lines: DataFrame) -> DataFrame:
    """(path, fn, pos, var): local bindings; Rust only at the top of a body, with the names in a pattern, and one row per name; Python and TypeScript every one."""
    assigned = F.regexp_extract("text", r"^\s+([A-Za-z_]\w*)\s*(?::[^=]+)?=(?!=)", 1)
    declared = F.regexp_extract("text", r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)", 1)
    bound = lines.withColumn("_p", F.nullif(_by_language(F.regexp_extract("text", _LET, 1), assigned, declared), F.lit("")))
    own = bound if "fn" in lines.columns else _enclosed(bound, ["_p"], F.col("_p").isNotNull())
    own = own.where("fn is not null and _p is not null")
    names = F.filter(F.regexp_extract_all("_p", F.lit(r"(?<![\w:])([a-z_][a-z0-9_]*)(?![\w(:])"), 1), lambda n: ~n.isin("_", "mut", "ref"))
    rust = own.where("language = 'rust' and depth = 1").select("path", "fn", F.col("line_no").alias("pos"), F.explode(names).alias("var"))
    others = own.where("language in ('python', 'typescript')")
    return dedupe_bindings(rust).unionByName(others.select("path", "fn", F.col("line_no").alias("pos"), F.col("_p").alias("var")))


def dedupe_bindings(bindings: DataFrame) -> DataFrame:
    """One row per function and name; the last place wins."""
    return bindings.groupBy("path", "fn", "var").agg(F.max("pos").alias("pos")).select("path", "fn", "pos", "var")


def scan_calls(lines: DataFrame) -> DataFrame:
    """(path, caller, pos, callee, qualified, arg_kind, arg_name) of the calls in Rust bodies; arg_kind: call, name or other."""
    own = enclosing(lines).where("language = 'rust' and fn is not null")
    body = F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"|//.*$', '""')
    found = own.withColumn("_c", F.regexp_extract_all(body, F.lit(r"((?:\.|::)?\b[A-Za-z_]\w*\((?:\s*[A-Za-z_]\w*(?:\(|\s*[,)]))?)"), 1))
    each = found.select("path", F.col("fn").alias("caller"), "line_no", "depth", F.posexplode("_c").alias("_k", "_x"))
    nested = F.regexp_extract("_x", r"\(\s*([A-Za-z_]\w*)([(,)])?", 1)
    kind = F.regexp_extract("_x", r"\(\s*([A-Za-z_]\w*)\s*([(,)])", 2)
    parsed = each.select(
        "path", "caller", (F.col("line_no") * 1000 + F.col("_k")).alias("pos"), F.regexp_extract("_x", r"([A-Za-z_]\w*)\(", 1).alias("callee"), F.col("_x").rlike(r"^(\.|::)").alias("qualified"),
        F.when(kind == "(", "call").when(kind != "", "name").otherwise("other").alias("arg_kind"), F.nullif(nested, F.lit("")).alias("arg_name"),
    )
    inner = parsed.where("arg_kind = 'call'").select("path", "caller", (F.col("pos") + 500).alias("pos"), F.col("arg_name").alias("callee"), F.lit(False).alias("qualified"), F.lit("other").alias("arg_kind"), F.lit(None).cast("string").alias("arg_name"))
    return parsed.unionByName(inner).where(~F.col("callee").isin(*NOT_CALLS))


def resolve_calls(call_sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, caller, callee): bare calls of functions of the same file, each pair once."""
    known = functions.select("path", F.col("name").alias("callee")).distinct()
    return call_sites.where("not qualified").join(known, ["path", "callee"], "left_semi").select("path", "caller", "callee").distinct()


def _flow_edges(pairs: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, inner, outer) pairs of known functions as the two edges of a flow, once per caller."""
    known = functions.select("path", "name").distinct()
    for end in ("inner", "outer"):
        pairs = pairs.join(known.withColumnRenamed("name", end), ["path", end], "left_semi")
    both = F.array(F.struct(F.col("inner").alias("source"), F.lit("data_flows_from").alias("kind"), F.col("outer").alias("target")), F.struct(F.col("outer").alias("source"), F.lit("param_source").alias("kind"), F.col("inner").alias("target")))
    return pairs.select("path", "caller", "inner", "outer").distinct().select("path", "caller", F.explode(both).alias("e")).select("path", "caller", "e.*")


def data_flow_nested(call_args: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, caller, source, kind, target) of outer(inner())."""
    return _flow_edges(call_args.where("arg_kind = 'call'").select("path", "caller", F.col("arg_name").alias("inner"), F.col("callee").alias("outer")), functions)


def data_flow_bound(call_args: DataFrame, bindings: DataFrame, functions: DataFrame) -> DataFrame:
    """The same for outer(v) where v was last bound to inner(): an as-of join by a running last value. A binding to anything else clears the variable; at equal places the binding comes first."""
    uses = call_args.where("arg_kind = 'name'").select("path", "caller", F.col("arg_name").alias("var"), "pos", F.lit(1).alias("_use"), F.lit(None).cast("struct<inner: string>").alias("_b"), F.col("callee").alias("outer"))
    bound = bindings.select("path", F.col("fn").alias("caller"), "var", "pos", F.lit(0).alias("_use"), F.struct(F.col("init_callee").alias("inner")).alias("_b"), F.lit(None).cast("string").alias("outer"))
    by = Window.partitionBy("path", "caller", "var").orderBy("pos", "_use", F.col("_b.inner")).rowsBetween(Window.unboundedPreceding, 0)
    seen = uses.unionByName(bound).withColumn("_last", F.last("_b", ignorenulls=True).over(by))
    return _flow_edges(seen.where("_use = 1 and _last.inner is not null").select("path", "caller", F.col("_last.inner").alias("inner"), "outer"), functions)


def scan_bindings(lines: DataFrame) -> DataFrame:
    """(path, fn, pos, var, init_callee) of Rust bindings of one plain or typed name; init_callee is the bare call it is set from, else NULL."""
    own = enclosing(lines).where("language = 'rust' and fn is not null")
    var = F.regexp_extract("text", r"^\s*let\s+(?:mut\s+)?([a-z_]\w*)\s*(?::[^=]+)?=(?!=)", 1)
    init = F.nullif(F.regexp_extract("text", r"=\s*([A-Za-z_]\w*)\(.*\)\s*;?\s*$", 1), F.lit(""))
    return own.withColumn("var", var).where("var <> ''").select("path", "fn", (F.col("line_no") * 1000).alias("pos"), "var", init.alias("init_callee"))


def file_status(lines: DataFrame) -> DataFrame:
    """(path, status): error where brackets don't balance in code or a comment or literal has no end, else unknown; files of no known language stay unknown.

    Lines without a code column are taken each on its own.
    """
    if "code" not in lines.columns:
        lines = lines.withColumn("code", F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)\'|//.*$|#.*$', ""))
    pairs = (("p", "(", ")"), ("s", "[", "]"), ("c", "{", "}"))
    sums = lines.groupBy("path", "language").agg(*[F.sum(_count(rf"\{a}") - _count(rf"\{b}")).alias(n) for n, a, b in pairs], F.bool_or(F.contains("code", F.lit(OPEN_END))).alias("open"))
    bad = F.col("language").isNotNull() & ((F.col("p") != 0) | (F.col("s") != 0) | (F.col("c") != 0) | F.col("open"))
    return sums.select("path", F.when(bad, "error").otherwise("unknown").alias("status"))


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (with owner_file) of a corpus (path, content); a broken Rust file keeps only its own node."""
    lines = cut(source_lines(files))
    status = cut(file_status(lines))
    sound = lines.join(status.where("status = 'error'"), "path", "left_anti").unionByName(lines.where("language <> 'rust'").join(status.where("status = 'error'"), "path", "left_semi"))
    sound = cut(enclosing(sound))  # all facts are read from this table
    functions = cut(scan_signatures(scan_functions(sound)))
    docs = scan_docs(sound, functions).groupBy("path", "name").agg(F.min("docs").alias("docs"))
    none = lambda t: F.lit(None).cast(t)
    file_of, fn_of = node_id(F.lit("file"), "path", F.lit("")), lambda n: node_id(F.lit("function"), "path", n)
    file_nodes = files.select("path").distinct().join(status, "path", "left").join(file_docs(sound), "path", "left").select(file_of.alias("id"), F.lit("file").alias("type"), file_label("path").alias("label"), none("string").alias("parent_id"), F.coalesce("status", F.lit("unknown")).alias("status"), "docs", none(functions.schema["signature"].dataType).alias("signature"), "path")
    fn_nodes = functions.join(docs, ["path", "name"], "left").select(fn_of("name").alias("id"), F.lit("function").alias("type"), F.col("name").alias("label"), file_of.alias("parent_id"), F.lit("unknown").alias("status"), "docs", "signature", "path")
    variables = scan_variables(sound).select("path", "fn", "var").distinct()
    var_nodes = variables.select(node_id(F.lit("variable"), "path", F.concat("fn", F.lit(":"), "var")).alias("id"), F.lit("variable").alias("type"), F.col("var").alias("label"), fn_of("fn").alias("parent_id"), F.lit("unknown").alias("status"), none("string").alias("docs"), none(functions.schema["signature"].dataType).alias("signature"), "path")
    nodes = cut(file_nodes.unionByName(fn_nodes).unionByName(var_nodes).withColumn("owner_file", file_of))
    contains = nodes.where("parent_id is not null").select(edge_id("parent_id", "id").alias("id"), F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), "owner_file")
    calls = cut(scan_calls(sound))
    flows = resolve_calls(calls, functions).select("path", F.col("caller").alias("s"), F.lit("calls").alias("kind"), F.col("callee").alias("t"))
    for part in (data_flow_nested(calls, functions), data_flow_bound(calls, scan_bindings(sound), functions)):
        flows = flows.unionByName(part.select("path", F.col("source").alias("s"), "kind", F.col("target").alias("t")))
    ends = flows.distinct().select(fn_of("s").alias("source"), fn_of("t").alias("target"), "kind", file_of.alias("owner_file"))
    edges = contains.unionByName(ends.select(typed_edge_id("source", "target", "kind").alias("id"), "source", "target", "kind", "owner_file")).withColumn("hot", F.lit(False))
    return nodes.join(derive_child_ids(edges), "id", "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>"))), edges
