"""Every threshold of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Routing:
    scan_density: float = 12.0  # characters per square inch under which text is sparse
    raster_share: float = 0.20
    garble: float = 0.45
    text_density: float = 3.0
    full_page: float = 0.60
    trust_prior_ocr: bool = False
    dpi: int = 300
    least_dpi: int = 150
    grid: int = 48
    least_pixels: int = 64


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 700
    overlap_tokens: int = 120
    min_tokens: int = 60
    max_table_tokens: int = 2000
    min_words: int = 6
    slack: float = 1.2
    prefix: bool = True


@dataclass(frozen=True)
class Retrieval:
    dense_limit: int = 30
    keyword_limit: int = 30
    rrf_k: int = 60
    fused_limit: int = 30
    top_k: int = 8
    min_score: float = 0.02
    prefer_newest: bool = True
    k1: float = 1.2
    b: float = 0.75
    weights: tuple[float, float, float] = (1.0, 0.5, 0.25)  # text, section, identifiers


EXTRACTOR_VERSION = 3
UPLOAD_LIMIT = 80 * 1024 * 1024
JOBS_KEPT = 50
#: Fixed values.
KINDS = ("digital", "scanned", "hybrid", "empty")
REFUSAL = "I could not find this in the indexed policy documents."
