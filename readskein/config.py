"""Parameters of clustering runs, with presets for common kinds of reads."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EditCosts:
    """Costs of local alignment: a negative match is good."""

    table: tuple[tuple[int, ...], ...] = tuple(tuple(-1 if a == b else 2 for b in range(4)) for a in range(4))
    open: int = 1
    extend: int = 1


@dataclass(frozen=True)
class ClusterConfig:
    """Parameters of candidate search, filters and distance. Lengths count bases."""

    window_len: int = 100
    word_len: int = 6
    theta: int = 40
    common_word: int = 70  # windowed hits a strand needs
    sample_thresh: int = 4  # sample hits a strand must exceed
    skip: int = 1
    alpha: int = 3  # shared words a candidate pair needs
    beta: int = 45  # distance of the outermost of these words
    kmer_len: int = 16
    min_len: int = 40
    rc_check: bool = True
    distance: str = "d2"
    costs: EditCosts | None = None  # of the edit distance; None: its own
    max_word_freq: int | None = None  # words in more reads don't nominate candidates; None: all do

    def but(self, **changes) -> ClusterConfig:
        return replace(self, **changes)


SANGER = ClusterConfig(alpha=5, beta=36)
R454 = ClusterConfig(window_len=80, theta=60, common_word=36, sample_thresh=3, beta=16)
SOLEXA = ClusterConfig(window_len=58, theta=55, common_word=22, sample_thresh=2, kmer_len=14, beta=10)
PRESETS = {"default": ClusterConfig(), "sanger": SANGER, "454": R454, "solexa": SOLEXA}
