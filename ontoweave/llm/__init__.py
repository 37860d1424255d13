"""Operators of a training-data pipeline, and their registered queries."""

from ontoweave.llm import (  # noqa: F401
    bitplanes, bpe, grid_join, kneser_ney, line_crf, mixing, ngram_join, quality_model, spelling, turn_repair, url_filter, warc, wrappers,
)
from ontoweave.llm.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
