"""Settings of the question-answering pipeline, with the values that take effect by default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    chunk_size: int = 512
    chunk_overlap: int = 50
    top_k: int = 3
    dimensions: int = 768
    metric: str = "cosine"
    collection: str = "documents"
    scope: str = "document"  # "document": a question sees its request's document; "corpus": all of them
    prefix: str = "passage: "
    strict_noise: bool = False  # word boundaries and case in the noise rules
    ocr_fixes: bool = True
    suppress_none: bool = True  # table cells that say "none" are left out
    row_terminator: str = ""  # put behind each table row; ". " makes rows sentences
    auth_enabled: bool = True
    auth_token: str = ""
    accept_any_api_key: bool = False
