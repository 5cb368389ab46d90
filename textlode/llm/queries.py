"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .fingerprints import op3_fingerprints
from .licenses import op9_license_scan
from .licenses import oracle as _op9
from .near_dedup import op10_near_dedup
from .packing import op6_packing
from .quality import op1_quality
from .secrets import op2_secret_scan
from .substrings import ORACLE as _OP5
from .substrings import op5_substring_dedup
from .token_files import op8_token_files
from .toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_quality, op2_secret_scan, op3_fingerprints, op4_toxicity, op5_substring_dedup, op6_packing, op7_decontamination, op8_token_files, op9_license_scan, op10_near_dedup)}
ORACLES: dict[str, str] = {"op5_substring_dedup": _OP5, "op9_license_scan": _op9()}
