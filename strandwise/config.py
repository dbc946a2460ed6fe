"""Settings of a correction run, with their limits, and a loader for KEY=value files."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

ALGORITHMS = ("conservative", "consensus", "scored")


@dataclass(frozen=True)
class Conservative:
    max_iters: int = 2
    max_errors: int = 4
    max_trim: int = 0
    min_votes: int = 3


@dataclass(frozen=True)
class Consensus:
    max_kmer_threshold: int = 255
    max_extend: int = 5
    trimming: bool = True
    max_trimming_rate: float = 0.6
    max_n_ratio: float = 0.1
    max_error_ratio: float = 0.25
    subst_base: str = "A"
    qs_cutoff_ratio: float = 0.05
    qs_extreme_ratio: float = 0.01
    check_range_ratio: float = 0.07
    min_bases_after_trimming: int = 30
    min_solid_length: int = 2
    min_non_solid_length: int = 2
    suspect_length: int = 1
    adjust_range: int = 4
    max_paths: int = 74
    max_modification: int = 4
    min_qs_diff: int = 10
    allowed_fails: int = 2
    max_low_qs_bases: int = 3


@dataclass(frozen=True)
class Scored:
    max_kmer_threshold: int = 255
    max_extend: int = 5
    qs_cutoff: int = 10
    max_n_ratio: float = 0.3
    max_error_ratio: float = 0.5
    subst_base: str = "A"
    min_solid_length: int = 2
    min_non_solid_length: int = 2
    suspect_length: int = 1
    adjust_range: int = 4
    max_paths: int = 100
    max_changes: int = 1000
    max_first_candidates: int = 5
    max_first_paths: int = 30
    max_low_qs_bases: int = 4
    max_low_qs_positions: int = 6
    covering_weight: float = 1.0
    extension_weight: float = 0.5
    min_quality: float = 0.0


@dataclass(frozen=True)
class Settings:
    algorithms: tuple[str, ...] = ("conservative",)
    k: int = 21
    kmer_threshold: int = 0
    keep_order: bool = True
    compression: str | None = None
    partitions: int | None = None
    max_solid_bytes: int = 2 << 30
    conservative: Conservative = field(default_factory=Conservative)
    consensus: Consensus = field(default_factory=Consensus)
    scored: Scored = field(default_factory=Scored)

    def __post_init__(self):
        names = ALGORITHMS if [a.lower() for a in self.algorithms] == ["all"] else tuple(a.lower() for a in self.algorithms)
        if not names or set(names) - set(ALGORITHMS):
            raise ValueError(f"algorithms are {', '.join(ALGORITHMS)} or all, not {', '.join(self.algorithms)}")
        object.__setattr__(self, "algorithms", tuple(dict.fromkeys(names)))
        object.__setattr__(self, "k", max(2, min(32, self.k)))
        if self.kmer_threshold < 0 or self.kmer_threshold == 1:
            raise ValueError("kmer_threshold is 0 (automatic) or at least 2")
        for part in (self.conservative, self.consensus, self.scored):
            for f in dataclasses.fields(part):
                value = getattr(part, f.name)
                if isinstance(value, (int, float)) and value < 0:
                    raise ValueError(f"{f.name} is negative")
                if f.name.endswith("_ratio") and not 0 <= value <= 1:
                    raise ValueError(f"{f.name} isn't between 0 and 1")
                if f.name == "subst_base" and value not in tuple("ACGT"):
                    raise ValueError("subst_base is one of A, C, G, T")


def _typed(value: str, like):
    if isinstance(like, bool):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"not true or false: {value}")
        return value.lower() == "true"
    if isinstance(like, tuple):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return value if isinstance(like, str) or like is None else type(like)(value)


def load(path: str | None = None, **given) -> Settings:
    """Settings from a file of KEY=value lines (group.key for the algorithms'), then from the arguments given."""
    flat: dict[str, str] = {}
    if path:
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                line = line.strip()
                if line and line[0] not in "#!":
                    key, sep, value = line.partition("=")
                    if not sep:
                        raise ValueError(f"no = in {line}")
                    flat[key.strip().lower()] = value.strip()
    base = Settings()
    groups = {n: {} for n in ALGORITHMS}
    top = {}
    for key, value in flat.items():
        group, dot, name = key.partition(".")
        owner, name = (getattr(base, group), name) if dot and group in groups else (base, key)
        if not hasattr(owner, name):
            raise ValueError(f"unknown setting {key}")
        (groups[group] if owner is not base else top)[name] = _typed(value, getattr(owner, name))
    parts = {n: dataclasses.replace(getattr(base, n), **v) for n, v in groups.items()}
    return dataclasses.replace(base, **(top | parts | {k: v for k, v in given.items() if v is not None}))
