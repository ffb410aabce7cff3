"""Parameters of the feature plan, its models and the allele optimizer."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    flank_size: int = 500
    #: Bases of either flank that windows keep: DNA features, protein search and motif search.
    dna_buffer: int = 100
    protein_buffer: int = 300
    motif_radius: int = 150
    k_min: int = 2
    k_max: int = 7
    match: int = 1
    mismatch: int = -1
    min_repeat: int = 2
    max_repeat: int = 10
    min_repeats: int = 5
    min_protein: int = 10
    protein_gap: int = -8
    dna_cluster: int = 50
    protein_cluster: int = 30
    hmm_window: int = 250
    threshold: float = 0.513
    iterations: int = 50
    copies: int = 1
    decrease_threshold: float = -0.1
    retain_threshold: int = 1
    random_choices: int = 40
    benign_goal: float = 0.75
    scale_factor: float = 0.1

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """Values of flat `key: value` lines whose keys are known; others are ignored."""
        import yaml

        known = {k: v for k, v in (yaml.safe_load(text) or {}).items() if k in cls.__dataclass_fields__}
        return cls(**known)


DEFAULT = Config()
