"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import alignment_query
from .decontaminate import decontamination_query
from .mixing import MIX_SQL, mix_query
from .ogg import ogg_query
from .packing import packing_query
from .passages import passages_query
from .pii import pii_query
from .quotes import quotes_query
from .resampling import RESAMPLING_SQL, resampling_query
from .secrets import secrets_query
from .toxicity import toxicity_query
from .warc import warc_query
from .simhash import simhash_query

QUERIES = {
    "op1_passages": passages_query,
    "op2_pii": pii_query,
    "op3_mixing": mix_query,
    "op4_decontamination": decontamination_query,
    "op5_ogg": ogg_query,
    "op6_toxicity": toxicity_query,
    "op7_warc": warc_query,
    "op8_secrets": secrets_query,
    "op9_quotes": quotes_query,
    "op10_simhash": simhash_query,
    "op11_alignment": alignment_query,
    "op12_resampling": resampling_query,
    "op13_packing": packing_query,
}

ORACLE_SQL = {"op3_mixing": MIX_SQL, "op12_resampling": RESAMPLING_SQL}
