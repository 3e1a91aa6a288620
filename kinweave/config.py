"""Settings of the linkage engine, passed to its builders."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Settings:
    use_country_in_keys: bool = True
    #: Targets of a key, and pairs of a key, beyond which it is not used, before scaling.
    max_block_target: int = 300
    max_block_pairs: int = 20_000
    #: Records of the corpus that the limits were chosen on; 0: no scaling.
    ref_records: int = 0
    topk_joint: int = 20
    topk_name: int = 5
    topk_addr: int = 5
    min_cheap: float = 0.10
    name_weight: float = 0.55
    seed: int = 42
    n_folds: int = 3
    holdout_frac: float = 0.2
    neg_keep: float = 1.0
    mine_abbrev_min_count: int = 25
    use_context: bool = True
    #: Boosted trees of either stage.
    trees: int = 800
    depth: int = 7
    step: float = 0.04
    min_rows: int = 40
    row_share: float = 0.8
    feature_share: float = 0.8

    def to_dict(self) -> dict:
        return asdict(self)

    def tree_options(self) -> dict:
        """Keyword arguments of learning.fit_trees."""
        return {k: getattr(self, k) for k in ("trees", "depth", "step", "min_rows", "row_share", "feature_share", "seed")}

    def block_limits(self, n_records: int) -> tuple[float, float]:
        """Key limits grow with the corpus, four times at most."""
        scale = min(max(1.0, n_records / self.ref_records), 4.0) if self.ref_records else 1.0
        return self.max_block_target * scale, self.max_block_pairs * scale
