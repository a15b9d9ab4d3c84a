"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

from .collocation import collocations_sql
from .mixing import mix_sql
from .quality import quality_sql
from .secrets import secrets_sql
from .warc import OP4_SQL

#: query name -> module of this subpackage that defines a function of that name
QUERIES = {
    "op1_line_dedup": "line_dedup",
    "op2_packing": "packing",
    "op3_near_dedup": "near_dedup",
    "op4_fixity": "warc",
    "op5_toxicity": "toxicity",
    "op6_mixing": "mixing",
    "op7_language_model": "pitman_yor",
    "op8_quality": "quality",
    "op10_nearest": "anisotropic",
    "op9_secrets": "secrets",
    "op11_collocations": "collocation",
    "op12_spelling": "spelling",
    "op13_main_text": "wrappers",
}

#: query name -> DuckDB SQL with the same result; queries without an entry are tested against brute force
ORACLES: dict[str, str] = {"op4_fixity": OP4_SQL, "op6_mixing": mix_sql(), "op8_quality": quality_sql(), "op9_secrets": secrets_sql(), "op11_collocations": collocations_sql()}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
