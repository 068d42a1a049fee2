"""Settings of a comparison, checked together."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, field

MODES, HASHES, TEXT_HASHES, TEXT_CHANGES, SAMPLINGS = ("auto", "byte", "visual", "full"), ("both", "dhash", "phash"), ("minhash", "off"), ("fails", "scored"), ("auto", "all", "strategic", "thumbnail")


@dataclass(frozen=True)
class Options:
    mode: str = "auto"
    hash_type: str = "both"
    text_hash: str = "minhash"
    text_change: str = "fails"
    tiles: bool = True
    dpi: int = 150
    workers: int = field(default_factory=lambda: min(max(os.cpu_count() or 1, 1), 64))
    threshold: float = 0.95
    sampling: str = "auto"
    max_memory_mb: int = 512

    def __post_init__(self) -> None:
        """One error that names every problem."""
        wrong = [f"{name} must be one of {', '.join(among)}, not {getattr(self, name)!r}" for name, among in (("mode", MODES), ("hash_type", HASHES), ("text_hash", TEXT_HASHES), ("text_change", TEXT_CHANGES), ("sampling", SAMPLINGS)) if getattr(self, name) not in among]
        if not 36 <= self.dpi <= 1200:
            wrong.append(f"dpi must be from 36 to 1200, not {self.dpi}")
        if not 1 <= self.workers <= 64:
            wrong.append(f"workers must be from 1 to 64, not {self.workers}")
        if math.isnan(self.threshold) or not 0 <= self.threshold <= 1:
            wrong.append(f"threshold must be from 0 to 1, not {self.threshold}")
        if self.max_memory_mb <= 0:
            wrong.append(f"max_memory_mb must be positive, not {self.max_memory_mb}")
        if wrong:
            raise ValueError("; ".join(wrong))
