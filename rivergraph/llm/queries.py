"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from . import decontaminate, linededup, mixing, secrets
from .decontaminate import op9_decontamination
from .licenses import op2_licenses
from .linededup import op4_line_dedup
from .mixing import op10_mixing
from .neardup import op7_near_dedup
from .quality import op5_quality
from .secrets import op1_secrets
from .substring import op6_substring_dedup
from .tokens import op8_tokens
from .toxicity import op3_toxicity


def pipeline(spark, sf_dir: str):
    """corpus_pipeline.run; the module lies at the top of the repository."""
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_secrets, op2_licenses, op3_toxicity, op4_line_dedup, op5_quality, op6_substring_dedup, op7_near_dedup, op8_tokens, op9_decontamination, op10_mixing, pipeline)
}
ORACLES = {"op1_secrets": secrets.ORACLE, "op4_line_dedup": linededup.ORACLE, "op9_decontamination": decontaminate.ORACLE, "op10_mixing": mixing.ORACLE}
