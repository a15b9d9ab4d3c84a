"""Column functions: ids, vocabulary maps, colours, texts and estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FLOW_OF_KIND, LANGUAGES, META, NODE_PREFIX, SIGNATURE, STATUS_OF_OUTCOME


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mapped(key: Column, mapping: dict[str, str]) -> Column:
    """The mapping as a CASE, NULL for other keys."""
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def id_prefix(type_) -> Column:
    return _mapped(_col(type_), NODE_PREFIX)


def type_of_id(id_) -> Column:
    """Node type of an id, by what stands before its first colon."""
    return _mapped(F.split_part(_col(id_), F.lit(":"), F.lit(1)), {v: k for k, v in NODE_PREFIX.items()})


def node_id(type_, path, symbol) -> Column:
    prefix, path, symbol = id_prefix(type_), _col(path), _col(symbol)
    return F.when(symbol == "", F.concat(prefix, F.lit(":"), path)).otherwise(F.concat(prefix, F.lit(":"), path, F.lit(":"), symbol))


def edge_id(source, target) -> Column:
    return F.concat(F.lit("e:"), _col(source), F.lit("->"), _col(target))


def typed_edge_id(source, target, kind) -> Column:
    return F.concat(edge_id(source, target), F.lit(":"), _col(kind))


def agent_node_id(agent) -> Column:
    """Injective: the percent sign is written out before the colon."""
    return F.concat(F.lit("agent:"), F.replace(F.replace(_col(agent), F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")))


def bare_agent_id(id_) -> Column:
    """The agent of an agent node's id."""
    bare = F.regexp_replace(_col(id_), "^agent:", "")
    return F.replace(F.replace(bare, F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))


def status_from_outcome(outcome) -> Column:
    return _mapped(_col(outcome), STATUS_OF_OUTCOME)


def hot_from_state(state) -> Column:
    return F.when(_col(state) == "enter", True).when(_col(state) == "exit", False)


def flow_class(kind) -> Column:
    return _mapped(_col(kind), FLOW_OF_KIND)


def agent_color(agent) -> Column:
    """# and the low 24 bits, in hex, of the FNV-1a hash of the id's UTF-8 bytes."""
    agent = _col(agent)
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(agent)), lambda i: F.conv(F.hex(F.substring(F.encode(agent, "utf-8"), i, F.lit(1))), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    folded = F.aggregate(codes, start, lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("long"), F.lit(4294967296).cast("long")))
    hashed = F.when(F.octet_length(agent) == 0, start).otherwise(folded)
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(hashed.bitwiseAND(F.lit(0xFFFFFF).cast("long"))), 6, "0")))


def agent_type(agent) -> Column:
    return F.when(_col(agent) == "", F.lit("agent")).otherwise(_col(agent))


def safe_color(text) -> Column:
    """The text if it is a plain hex or rgb colour, else NULL."""
    text = _col(text)
    digits = F.substring(text, F.lit(2), F.length(text))
    hexed = F.startswith(text, F.lit("#")) & F.length(digits).isin(3, 6, 8) & (F.translate(F.lower(digits), "0123456789abcdef", "") == "")
    inside = F.regexp_extract(text, r"^rgba?\(([^()]*)\)$", 1)
    channels = F.transform(F.split(inside, ","), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    number = lambda c: (F.length(c).between(1, 3)) & (F.translate(c, "0123456789", "") == "")
    alpha = F.get(channels, F.lit(3))
    share = F.endswith(alpha, F.lit("%")) & number(F.regexp_replace(alpha, "%$", ""))
    fraction = alpha.isin("0", "1") | alpha.rlike(r"^0?[.]\d+$")
    rgb = (inside != "") & F.size(channels).isin(3, 4) & F.forall(F.slice(channels, 1, 3), number) & F.coalesce(share | fraction, F.lit(True))
    return F.when(hexed | (rgb & ~F.endswith(text, F.lit("\n"))), text)


def file_label(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def language_of(path) -> Column:
    return _mapped(F.regexp_extract(_col(path), r"\.([^./]+)$", 1), LANGUAGES)


def format_bytes(n, largest: str = "TB") -> Column:
    """Bytes below 1024, then one decimal in steps of 1024 up to ``largest``."""
    n = _col(n)
    units = ("B", "KB", "MB", "GB", "TB")
    top = units.index(largest)
    out = F.format_string(f"%.1f {largest}", n / float(1024**top))
    for power in range(top - 1, 0, -1):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {units[power]}", n / float(1024**power))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def events_per_sec(milli) -> Column:
    return F.format_string("%.1f", _col(milli) / 1000.0)


def epoch_ms(ts) -> Column:
    """Milliseconds since 1970, microseconds rounded with halves away from zero."""
    micros = F.unix_micros(_col(ts).cast("timestamp"))
    rounded = micros + F.when(micros < 0, -500).otherwise(500)
    return ((rounded - rounded % 1000) / 1000).cast("long")


def rfc3339(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def signature_json(signature) -> Column:
    return F.to_json(_col(signature))


def signature_from_json(text) -> Column:
    return F.from_json(_col(text), SIGNATURE, {"mode": "FAILFAST"})


def meta_json(meta) -> Column:
    return F.to_json(_col(meta))


def meta_from_json(text) -> Column:
    return F.from_json(_col(text), META, {"mode": "FAILFAST"})


def docs_or_placeholder(docs, placeholder: str = "No documentation") -> Column:
    return F.coalesce(F.nullif(_col(docs), F.lit("")), F.lit(placeholder))


def estimate_memory(nodes, edges, files, node_bytes: int = 360, edge_bytes: int = 136, file_bytes: int = 64) -> Column:
    """Counts times sizes per element."""
    return _col(nodes) * node_bytes + _col(edges) * edge_bytes + _col(files) * file_bytes
