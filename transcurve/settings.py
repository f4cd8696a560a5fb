"""Knobs of a fit."""

from __future__ import annotations

from dataclasses import dataclass

TARGETS = ("ENTROPY", "L2", "ICE_RAW", "ICE_SIMPLE", "ICE2", "ICE", "ICE_B", "ICE_STABLE_B")


@dataclass(frozen=True)
class Settings:
    """``random_shuffle`` permutes the rows of each part of the grid; ``validate`` evaluates each accepted result
    anew and compares; ``complex_results`` gives each result all derivatives (TIC, deviations). Models of more than
    ``newton_params`` free parameters are fitted by gradients alone. With ``block_groups`` the grid is laid out in so
    many groups of rows, of which trial steps read as many as decide. ``refit_starts`` of the starting curves of each
    regressor, status and type are refitted, the best first (0: all)."""

    seed: int = 1
    random_shuffle: bool = True
    polish_starting_params: bool = True
    allow_interaction_curves: bool = False
    bound_centrality: bool = True
    polish_start_points: int = 20
    min_calibration_count: int = 1
    improvement_ratio: float = 0.2
    aic_cutoff: float = -5.0
    z_score_cutoff: float = 1.0
    validate: bool = True
    target: str = "ENTROPY"
    l2_lambda: float = 0.0
    complex_results: bool = False
    max_steps: int = 40
    newton_params: int = 150
    max_gradient_steps: int = 300
    block_groups: int = 0
    refit_starts: int = 1
    curve_types: tuple[str, ...] = ("LOGISTIC", "GAUSSIAN")

    def __post_init__(self) -> None:
        if self.aic_cutoff > 0:
            raise ValueError("aic_cutoff must not be positive")
        if self.target not in TARGETS:
            raise ValueError(f"unknown target {self.target}")
